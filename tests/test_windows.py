"""Windows of k characters by NumPy against naive ones: at any cut of the texts, in any letters."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqloom.functions import windows as W
from seqloom.operators import stats as S
from tests.test_matching import table


def texts(letters, n, longest, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(longest))) for _ in range(n)] + [None, ""]


def naive(seqs, k):
    return [s[i : i + k] for s in seqs if s for i in range(len(s) - k + 1)]


LETTERS = ["ACGT", "abé漢😀 ", "".join(map(chr, range(0x4E00, 0x5200)))]


@pytest.mark.parametrize("letters", LETTERS)
@pytest.mark.parametrize("k", [1, 3, 8, 31, 70])
def test_counts_in_chunks(letters, k):
    seqs, total, held = texts(letters, 40, 300), Counter(), W.WindowCounts(k, 500)
    column = pa.array(seqs + seqs[:9])
    given = [x for text, whole in W.chunks([column[:20], column[20:]], k, 90) for x in held.add(text, whole)] + list(held.rest())
    for kmers, counts in given:
        total.update(dict(zip(kmers, map(int, counts))))
    assert total == Counter(naive(column.to_pylist(), k))
    by_hash = {}
    for text, whole in W.chunks([column[:20], column[20:]], k, 90):
        for i, h in zip(np.flatnonzero(whole).tolist(), W.hashes(W.code_points(text), k)[whole].tolist()):
            assert by_hash.setdefault(text[i : i + k], h) == h
    assert set(by_hash) == set(total) and len(set(by_hash.values())) == len(total)


def test_alphabets_follow_one_another():
    held, total, seqs = W.WindowCounts(8, 10**6), Counter(), [bytes(range(33, 127)).decode() * 2, *("".join(map(chr, range(a, a + 200))) for a in (0x400, 0x4E00)), "abcdefghij" * 3]
    for s in seqs:
        for kmers, counts in held.add(s, np.ones(len(s) - 7, bool)):
            total.update(dict(zip(kmers, map(int, counts))))
    for kmers, counts in held.rest():
        total.update(dict(zip(kmers, map(int, counts))))
    assert total == Counter(naive(seqs, 8))


def first(seqs, k, n):
    return sorted(Counter(naive(seqs, k)).items(), key=lambda x: (-x[1], x[0].encode()))[:n]


def test_top_counts_few_windows(spark, monkeypatch):
    """what is counted and shuffled for the first n does not grow with the distinct windows."""
    rng = random.Random(6)
    seqs = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(20_000)) for _ in range(10)] + ["frequent windows " * 50] * 3
    rows, count = [], S.count_kmers

    def counted(*a):
        rows.append((out := count(*a)).count())
        return out

    monkeypatch.setattr(S, "count_kmers", counted)
    got = [tuple(r) for r in S.top_kmers(table(spark, seqs), 8, 10).collect()]
    assert got == first(seqs, 8, 10)
    assert sum(rows) < 5_000 < len(set(naive(seqs, 8)))


def test_top_of_ties_and_of_few(spark):
    even = texts("abcdefghijklmnopqrst", 50, 2_000)  # the fullest buckets don't hold the first windows
    for seqs, k, n in ((even, 4, 7), (["AAAAC", None], 3, 9), (["é漢é漢", "é漢é"], 2, 1), ([None, "AA"], 3, 5), (even[:3], 8, 20_000), (["AAAA"], 2, 0)):
        assert [tuple(r) for r in S.top_kmers(table(spark, seqs), k, n).collect()] == first(seqs, k, n)


def test_enumeration_is_written_small(spark, tmp_path):
    """the order of the rows makes the files smaller; the rows are the same."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij é") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    seqs = [" ".join(rng.choice(words) for _ in range(rng.randrange(300))) for _ in range(300)]
    seqs += seqs[:9] + [None, "", "short", "漢" * 30 + "字字"]
    df = table(spark, seqs).coalesce(1)
    S.enumerate_kmers(df, 31).write.parquet(str(tmp_path / "out"))
    rows = [(no, i, s[i : i + 31]) for no, s in enumerate(seqs) if s for i in range(len(s) - 30)]
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select("rec_no", "position", "kmer").collect())) == rows
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 8.5 * len(rows)


def test_enumeration_of_long_records(spark):
    rng = random.Random(8)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (70_000, 69_990, 3, 2, 40_000)]
    got = sorted(map(tuple, S.enumerate_kmers(table(spark, seqs).coalesce(1), 3).select("rec_no", "position", "kmer").collect()))
    assert got == [(no, i, s[i : i + 3]) for no, s in enumerate(seqs) for i in range(len(s) - 2)]


def test_workers_get_small_batches(spark):
    """what a worker holds of long texts doesn't grow with the table."""
    import seqloom.operators.matching as M
    from seqloom.operators import patterns as P

    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20)}
    before = {k: spark.conf.get(k) for k in keys}

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    try:
        for use in (lambda df: M.hits(df, P.plan(["AA"])), lambda df: M.any_match(df, P.plan([f"A{i}" for i in range(20)])), lambda df: M.tallies(df, P.plan(["AA"])), lambda df: S.count_kmers(df, 3)):
            for k, v in keys.items():
                spark.conf.set(k, v)
            for text, n in (("AC", 3000), ("AC" * 100_000, 60)):
                df = spark.range(0, n, 1, 1).selectExpr("id as rec_no", "cast(id as string) as id", f"repeat('{text[:2]}', {len(text) // 2}) as seq")
                use(df)
                got = df.mapInArrow(sizes, "n long, bytes long").agg({"n": "max", "bytes": "max"}).first()
                assert got["max(n)"] <= 256 and got["max(bytes)"] <= 5 << 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("k", [1, 31, 52, 53, 60, 130])
def test_digests_of_many_windows(k):
    """the first bits of MD5, of one block or several, for all windows of a text together."""
    column, seen = pa.array(texts("abé漢😀 ", 30, 300) + ["x" * 200]), 0
    for text, whole in W.chunks([column], k, 500):
        for at, leads in W.md5_leads(text, whole, k, b"42:"):
            assert [hashlib.md5(f"42:{text[i : i + k]}".encode()).hexdigest()[:8] for i in at.tolist()] == [f"{x:08x}" for x in leads.tolist()]
            seen += len(at)
    assert seen == len(naive(column.to_pylist(), k))


def test_sample_digests_few_windows_alone(spark, monkeypatch):
    """of most windows no digest is made by itself; the sample is the same."""
    rng, made = random.Random(9), spark.sparkContext.accumulator(0)
    seqs = ["".join(rng.choice("abcdefghijklmnopqrsté") for _ in range(20_000)) for _ in range(10)] + ["repeated line " * 900, None]

    def digest(x):
        made.add(1)
        return hashlib.md5(x)

    monkeypatch.setattr(S, "md5", digest)  # what workers run is sent with it
    for n in (1, 100):
        least = sorted(set(naive(seqs, 31)), key=lambda w: (hashlib.md5(f"42:{w}".encode()).hexdigest(), w))[:n]
        assert [r.kmer for r in S.sample_kmers(table(spark, seqs), 31, n).collect()] == least
    assert 100 < made.value < 20_000 < len(set(naive(seqs, 31)))
