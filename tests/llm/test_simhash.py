import random
import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.llm import op06_simhash as S
from seqloom.llm.components import connected_components

from .data import documents, rows, table


def brute_print(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(points):
    """Smallest id reachable over pairs of at most three differing bits."""
    parent = {i: i for i, _ in points}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in points:
        for j, b in points:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: top(i) for i, _ in points}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_documents(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.digests(S.near_duplicates(documents(spark, extra=True))).collect()}
    prints = [(r[0], brute_print(r[1])) for r in rows()]
    want = groups(prints)
    assert got == {i: (f"{x:016x}", want[i]) for i, x in prints}
    assert len(set(want.values())) < len(want)
    assert S.near_duplicates(documents(spark).limit(0)).count() == 0
    none = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, "A B c d")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in S.near_duplicates(none).collect()) == ["5", "5", "5", "None"]
    assert [r.doc_id for r in S.representatives(none).collect()] == [5]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3))
def test_linked_points_share_a_grid_cell(a, flips):
    def embed(x):
        low = 0x5555555555555555
        return ((x | x >> 1) & low) | ((x & x >> 1 & low) << 1)

    b = a
    for f in flips:
        b ^= 1 << f
    differ = embed(a) ^ embed(b)
    assert differ.bit_count() <= (a ^ b).bit_count() <= 3
    shared = [g for g in S.GRIDS if differ & g % (1 << 64) == 0]
    assert shared
    for g in shared:
        assert any(differ & m % (1 << 64) == 0 for m in S._rest(g))


def test_links_are_all_found_also_in_crowded_cells(spark):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(6)]
    points = {rng.getrandbits(64) for _ in range(150)}
    for c in centres:
        for _ in range(120):
            x = c
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << b
            points.add(x)
    points = list(enumerate(sorted(points)))
    want = {(i, j) for i, a in points for j, b in points if signed(a) < signed(b) and (a ^ b).bit_count() <= 3}
    df = spark.createDataFrame([(i, signed(x)) for i, x in points], "node long, fp long")
    got = [tuple(r) for r in S.links(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert {r.e for r in df.select(F.bit_count(S.embedding(F.col("fp"))).alias("e")).collect()} <= set(range(65))


def test_components(spark):
    rng = random.Random(9)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]):
        parent = {n: n for e in edges for n in e if e[0] != e[1]}
        for _ in range(len(parent) + 1):
            for a, b in edges:
                if a != b:
                    parent[a] = parent[b] = min(parent[a], parent[b])
        assert table(connected_components(spark.createDataFrame(edges, "a long, b long"))) == sorted(parent.items(), key=repr)
