import random
import time

import numpy as np

import corpus_pipeline as C
from seqloom.llm import near_copies as N
from seqloom.llm import op06_simhash
from seqloom.llm.components import connected_components
from seqloom.llm.near_copies import near_copies

from .data import prose


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    top = {i: i for i, _ in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    sets = [(i, grams(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return {i: find(i) for i in top}


def texts(seed):
    rng = random.Random(seed)
    line = " ".join(prose(rng, 12).split())
    out = [None, "", "  ", "one two", "ONE  two", "one two three", line]
    for _ in range(25):
        base = prose(rng, rng.randrange(5, 200)).split()
        out.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            words = list(base)
            for _ in range(rng.randrange(1, 6)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            out.append(f"{line} {' '.join(words)}" if rng.random() < 0.2 else " ".join(words))
    rng.shuffle(out)
    return list(enumerate(out))


def test_every_similar_pair_is_linked(spark):
    rows = texts(3)
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and len(set(got.values())) < len(got) - 20


def test_bins_bound_what_sets_share():
    rng = np.random.default_rng(1)
    for _ in range(300):
        both = rng.integers(0, 2**64, rng.integers(0, 400), np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 2**64, rng.integers(0, 300), np.uint64)])) for _ in range(2))
        assert N.at_most_shared(N.bins(x), N.bins(y)) >= len(np.intersect1d(x, y))
    x, y = (np.unique(rng.integers(0, 2**64, 500, np.uint64)) for _ in range(2))
    assert N.at_most_shared(N.bins(x), N.bins(y)) < 400 and N.bins(np.zeros(300, np.uint64)) is None


def test_hints_do_not_change_the_result(spark):
    rows = texts(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hints = spark.createDataFrame([(i, (i * 7 + 3) % len(rows)) for i in range(len(rows))], "a long, b long")
    assert {r.doc_id: r.component_id for r in near_copies(df, hints=hints).collect()} == brute(rows)


def test_stage_drops_copies_that_differ_in_more_than_three_bits(spark, tmp_path):
    words = prose(random.Random(8), 200).split()
    changed = list(words)
    for k in (20, 90, 160):
        changed[k] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (None, " ".join(words)), (3, prose(random.Random(9), 200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in C.simhash_dedup(spark, docs, "").collect()) == ["1", "3", "None"]


def test_marks_bound_what_sets_differ_in():
    rng = np.random.default_rng(2)
    for _ in range(300):
        both = rng.integers(0, 2**64, rng.integers(0, 400), np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 2**64, rng.integers(0, 60), np.uint64)])) for _ in range(2))
        assert sum((int(a) ^ int(b)).bit_count() for a, b in zip(N.marks(x).view(np.uint64), N.marks(y).view(np.uint64))) <= len(np.setxor1d(x, y))


def test_a_group_of_copies_that_are_not_near_enough_makes_few_pairs(spark, monkeypatch):
    """Each differs from the first in some words, and most from each other in too many: the last step verifies few of all pairs."""
    rng, made, verified = random.Random(4), [], N._verified

    def counted(pairs, points, source, home):
        made.append((home.rpartition("/")[2], pairs.count()))
        return verified(pairs, points, source, home)

    monkeypatch.setattr(N, "_verified", counted)
    base, rows = prose(rng, 140).split(), []
    for i in range(90):
        words = list(base)
        for k in rng.sample(range(140), rng.choice((2, 5, 8))):
            words[k] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want and 10 < len(set(want.values())) < 80
    assert dict(made)["pairs"] < 400, made


def test_stage_drops_what_fingerprints_join(spark):
    """Texts that are mostly one passage again and again have equal fingerprints, though their sets are not similar."""
    passage = prose(random.Random(11), 61).split()
    rows = [(i, " ".join(passage * 60 + prose(random.Random(20 + i), 40).split())) for i in range(2)]
    rows += [(2, prose(random.Random(12), 200)), (3, None), (None, rows[0][1])]
    assert brute([r for r in rows[:2]]) == {0: 0, 1: 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in op06_simhash.near_duplicates(docs, shingle=5).collect()}[1] == 0
    assert sorted(str(r.doc_id) for r in C.simhash_dedup(spark, docs, "").collect()) == ["0", "2", "3", "None"]


def _shuffles(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_steps_leave_no_shuffles_behind(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(key, None), _shuffles(spark)
    found = connected_components(spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long"))
    for _ in range(50):
        if not _shuffles(spark) - before:
            break
        time.sleep(0.2)  # they are deleted behind the action
    assert not _shuffles(spark) - before
    assert spark.conf.get(key, None) == was
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(301)}
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(301)}


def test_few_edges_are_joined_in_one_task(spark):
    """Steps are some eight stages each: what one task holds is joined there, and gives what the steps give."""
    rng = random.Random(6)
    rows = [(rng.randrange(400), rng.randrange(400)) for _ in range(150)] + [(i, i + 1) for i in range(500, 600)] + [(-5, 2**62), (7, 7), (None, 3)]
    edges, sc = spark.createDataFrame(rows, "a long, b long"), spark.sparkContext

    def run(name, **kw):
        sc.setJobGroup(name, name)
        found, tracker = sorted(map(tuple, connected_components(edges, **kw).collect())), sc.statusTracker()
        sc.setLocalProperty("spark.jobGroup.id", None)
        return found, sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(name))

    (found, stages), (steps, more) = run("few edges"), run("many edges", few=0)
    assert found == steps and (2**62, -5) in found
    assert stages < 12 < more, (stages, more)
