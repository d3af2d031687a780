import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from seqloom.llm import op07_lm as M

from .data import SCHEMA, documents, rows, table


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


class Brute:
    def __init__(self, docs, order):
        self.order, self.c, self.n_grams = order, Counter(), [None, *(Counter() for _ in range(order))]
        for i, text in docs:
            if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
                w = ["<s>", *tokens(text), "</s>"]
                self.c.update(w[1:])
                self.n_grams[order].update(zip(*(w[k:] for k in range(order))))
                for k in range(2, order):
                    self.n_grams[k][tuple(w[:k])] += 1
        self.n, self.v = sum(self.c.values()), len(self.c)
        for k in range(order, 1, -1):  # below, and not at a text's beginning, the number of words before
            for g in list(self.n_grams[k]):
                self.n_grams[k - 1][g[1:]] += 1
        self.d = [None, *(M._discounts([list(x.values()).count(j) for j in (1, 2, 3, 4)]) for x in self.n_grams[1:])]
        self.total, self.follow = [defaultdict(int) for _ in range(order + 1)], [defaultdict(lambda: [0] * 4) for _ in range(order + 1)]
        for k in range(1, order + 1):
            for g, c in self.n_grams[k].items():
                self.total[k][g[:-1]] += c
                self.follow[k][g[:-1]][min(c, 3)] += 1

    def p(self, context, w):
        """P of a word after the words of a context, the longest order last."""
        k = len(context) + 1
        lower = self.p(context[1:], w) if k > 1 else 1 / (self.v + 1)
        total, d = self.total[k].get(context, 0), self.d[k]
        if not total:
            return lower if k > 1 else 1.0
        c = self.n_grams[k][(*context, w)]
        return max(c - d[min(c, 3)], 0) / total + sum(d[j] * self.follow[k][context][j] for j in (1, 2, 3)) / total * lower


@pytest.mark.parametrize("shard,fan,order", [(3_000_000, 1024, 3), (300, 1024, 3), (700, 2, 3), (300, 1024, 2), (300, 3, 2)])
def test_brute_force(spark, monkeypatch, shard, fan, order):
    monkeypatch.setattr(M, "SHARD", shard)
    monkeypatch.setattr(M, "FAN", fan)
    docs = [r for r in rows() if r[0] != 47]
    df = spark.createDataFrame(docs, SCHEMA)
    b = Brute([r[:2] for r in docs], order)
    about = M.train(df, order=order)
    got = {r.doc_id: r for r in M.score(df, about).collect()}
    assert about["train_tokens"] == b.n and about["vocabulary"] == b.v and about["types"] == len(b.n_grams[2])
    assert about["discounts"][1] == b.d[1] and about["discounts"][order] == b.d[order]
    for i, text, *_ in docs:
        w, r = ["<s>", *tokens(text), "</s>"], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(w) - 1, sum(b.c[x] > 0 for x in w[1:]), b.n)
        assert math.isclose(r.base_score, sum(math.log10((b.c[x] + 1) / (b.n + b.v + 1)) for x in w[1:]), rel_tol=1e-9)
        want = sum(math.log10(b.p(tuple(w[max(0, k - order + 1) : k]), w[k])) for k in range(1, len(w)))
        assert math.isclose(r.score, want, rel_tol=1e-9), i
    for context in (("<s>",), (b"the",), (b"never seen",), ("<s>", b"the"), (b"of", b"the"), (b"the", b"of"), (b"never", b"seen")):
        if len(context) < order:
            assert math.isclose(sum(b.p(context, w) for w in b.c) + b.p(context, "unseen"), 1.0, rel_tol=1e-9)
    assert len(b.c) > 150 and any(math.isclose(r.score, r.base_score) is False for r in got.values())


def test_a_text_of_very_many_words(spark):
    text = " ".join(f"w{i}" for i in range(1_100_000)) + " w5 w6 w7 w5 w6 w7"
    df = spark.createDataFrame([(4, text), (3, "w5 w6 w7 w8")], "doc_id long, text string")
    about = M.train(df)
    assert about["vocabulary"] == 1_100_001 and about["train_tokens"] == 1_100_012
    r = {x.doc_id: x for x in M.score(df, about).collect()}[3]
    b = Brute([(4, text), (3, "w5 w6 w7 w8")], 3)
    w = ["<s>", *tokens("w5 w6 w7 w8"), "</s>"]
    assert math.isclose(r.score, sum(math.log10(b.p(tuple(w[max(0, k - 2) : k]), w[k])) for k in range(1, len(w))), rel_tol=1e-9)


def test_files_are_let_go(tmp_path, monkeypatch):
    monkeypatch.setattr(M, "MAPS", 3)
    keys = np.sort(np.random.default_rng(2).integers(0, 2**64, (20, 500), np.uint64), axis=1)
    for i, k in enumerate(keys):
        file = M._File(f"file://{tmp_path}/model/f-{i}")
        file.put("a", k, np.arange(500), np.arange(500) * 2**40)
        file.close()
    files = M._Files(f"file://{tmp_path}")
    for i in [*range(20), *range(20)]:
        hit, values = files.find(f"f-{i}", "a", np.r_[keys[i], keys[i] + np.uint64(1 << 40)])
        assert hit[:500].all() and not hit[500:].any() and (values[1][:500] == np.arange(500) * 2**40).all()
        assert len(files.open) <= 3
    assert not files.find("f-99", "a", keys[0])[0].any()


def test_files_stay_mapped(tmp_path, monkeypatch):
    for i in range(300):
        file = M._File(f"file://{tmp_path}/model/f-{i}")
        file.put("a", np.array([5 << 40], np.uint64))
        file.close()
    files, mapped = M._Files(f"file://{tmp_path}"), []
    monkeypatch.setattr(files, "_map", lambda uri: mapped.append(uri) or M._Files._map(uri))
    for i in [*range(300), *range(300)]:
        assert files.find(f"f-{i}", "a", np.array([5 << 40, 6 << 40], np.uint64))[0].tolist() == [True, False]
    assert len(mapped) == 300


def test_lookups_follow_the_bytes_not_the_batches(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD", 300)
    docs = [(i, f"w{i % 7} of w{i % 5} and w{i % 3}") for i in range(600)]
    about = M.train(spark.createDataFrame(docs, "doc_id long, text string"))
    found, find = [], M._Files.find
    monkeypatch.setattr(M._Files, "find", lambda self, *a: found.append(a) or find(self, *a))
    batch = pa.table([[d[0] for d in docs], [d[0] % 2 == 0 for d in docs], pa.array([d[1].encode() for d in docs], pa.binary())], names=["doc_id", "held_out", "text"])

    def scored(rows):
        found.clear()
        out = pa.Table.from_batches(M._scored(about, iter(batch.to_batches(rows))))
        return len(found), out.combine_chunks().to_pydict()

    assert scored(10) == scored(600)
    monkeypatch.setattr(M, "GROUP", 100)  # each batch by itself
    many, rows = scored(10)
    assert many > 10 * scored(600)[0] and rows["doc_id"] == [d[0] for d in docs]
    assert np.allclose(rows["score"], scored(600)[1]["score"])


def test_beats_the_base_on_held_out_texts(spark):
    df = documents(spark)
    held = [r for r in M.perplexity(M.score(df, M.train(df))).where("held_out").collect()]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark):
    df = documents(spark, extra=True)
    assert M.score(df, M.train(df)).count() == df.count()
    nothing = M.train(df.limit(0))
    assert {(r.score, r.n_known) for r in M.score(df, nothing).collect()} == {(0.0, 0)}
    assert M.score(df.limit(0), nothing).count() == 0
    none = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert table(M.score(none, M.train(none)).select("held_out", "n_tokens", "score")) == [(False, 1, 0.0), (False, 3, 0.0)]


def test_packing():
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    b = rng.integers(0, 9, 1000)
    x, y = M.unpack(M.pack(a, b), 2)
    assert (x == a).all() and (y == b).all()
    hashes = np.sort(rng.integers(0, 2**63, 40).astype(np.uint64))
    for columns in (2, 3):
        grams = np.unique(rng.integers(0, 40, (500, columns)), axis=0)
        counts = rng.integers(1, 2**32, len(grams))
        used, cols, n = M._unpack_grams(M._pack_grams(hashes, list(grams.T), counts), columns)
        assert (n == counts).all() and all((used[c] == hashes[g]).all() for c, g in zip(cols, grams.T))
