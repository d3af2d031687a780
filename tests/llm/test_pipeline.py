import hashlib
import os
import random
import re

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from seqloom.llm import op01_lines, op02_bpe, op03_decontaminate, op04_quality, op06_simhash, queries

from seqloom.llm.wordbpe import tokenizer_path

from . import test_decontaminate as decontaminate
from . import test_lines as lines
from . import test_near_copies as copies
from . import test_quality_and_pii as quality
from .data import SCHEMA, prose, rows, table

DATA = "/root/testdata/sf0.001"


def tables(spark, folder):
    docs = [*rows(), (900, "# a " * 60, "en", "s", 1)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, rows()[7][1])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_take_effect(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, seen[-1], str(tmp_path))
        assert i == 4 or out.columns == docs.columns
        seen.append(spark.createDataFrame(out.collect(), out.schema))
    ids = [{r.doc_id for r in x.collect()} for x in seen]
    kept = {r.doc_id for r in op04_quality.verdicts(op04_quality.ledger(docs)).collect() if r.kept}
    assert ids[1] == kept and 900 not in kept
    lines = {r.doc_id: r for r in op01_lines.dedup(seen[1]).collect()}
    assert {r.doc_id: r.text for r in seen[2].collect()} == {i: r.text for i, r in lines.items() if not r.n_deleted or r.text.strip()}
    assert all(r.n_chars == len(r.text) for r in seen[2].collect())
    assert ids[3] == {r.doc_id for r in op06_simhash.representatives(seen[2]).collect()}
    bad = {r.doc_id for r in op03_decontaminate.contaminated(seen[3], bench).collect()}
    assert ids[4] == ids[3] - bad and bad == {7}
    want = table(op02_bpe.digests(op02_bpe.encode_decode(seen[4])))
    assert table(seen[5]) == want == table(C.run(spark, str(tmp_path)))


def plain_measures(text):
    n, word_chars, n_symbols, n_dup_lines, n_repeat, _ = quality.base(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    solid = "".join(words)
    return {
        "n_words": n, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat,
        "n_lines": sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n")), "n_exclaims": (text or "").count("!"),
        "n_letters": sum(map(str.isalpha, solid)), "n_capitals": sum(map(str.isupper, solid)), "longest_word": max(map(len, words), default=0),
    }


def test_a_plain_program_of_all_stages(spark, tmp_path):
    """The whole pipeline against quality rules, line dedup, near copies, windows of words and the tokenizer's library, each by brute force."""
    rng, library = random.Random(21), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = [t for _, t, *_ in rows()]
    items = [(i, " ".join(prose(rng, n).lower().replace(".", "").split())) for i, n in enumerate((8, 15, 40))]
    for _ in range(30):
        base = prose(rng, rng.randrange(60, 260))
        words = base.split(" ")
        changed = list(words)
        changed[rng.randrange(len(changed))] = "changed"
        texts += [base, " ".join(changed)][: rng.randrange(1, 3)]
        if rng.random() < 0.3:
            texts.append(f"{prose(rng, 70)}\n{rng.choice(items)[1]}\n{prose(rng, 30)}")
        if rng.random() < 0.3:
            texts.append(f"{prose(rng, 55)}\n{base}")
    texts += ["# a " * 60, "WHY NOT " * 3 + prose(rng, 80).upper(), prose(rng, 60).replace(" ", " ! ")]
    docs = list(enumerate(texts))
    names = ("measures", "fail_bits", "n_deleted", "__gone", "__bad", "a.b", "component_id", "row")
    spark.createDataFrame([(i, t, *"x" * len(names)) for i, t in docs], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes = [len(docs)]
    policy = [(n, r) for n, r in op04_quality.RULES if n in op04_quality.BASE.rules + op04_quality.V1.rules]
    docs = [(i, t) for i, t in docs if not any(eval(r, {}, plain_measures(t)) for _, r in policy)]
    sizes.append(len(docs))
    cut = lines.brute(docs, op01_lines.MIN_WORDS)
    assert any(n for _, n in cut.values())
    docs = [(i, t) for i, (t, n) in cut.items() if not n or t.strip(" \t\r\n\x0b\f")]
    sizes.append(len(docs))
    least = copies.brute(docs)
    docs = [(i, t) for i, t in docs if least[i] == i]
    sizes.append(len(docs))
    bad = {d for d, _ in decontaminate.brute(docs, items)}
    docs = [(i, t) for i, t in docs if i not in bad]
    sizes.append(len(docs))
    assert sorted(sizes, reverse=True) == sizes and len(set(sizes)) >= 4
    want = {i: hashlib.sha256(" ".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for i, t in docs}
    assert {r.doc_id: r.ids_sha256 for r in C.run(spark, str(tmp_path)).collect()} == want
    first = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, first, str(tmp_path)).columns == first.columns, name


def test_empty_table(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    for name_ in ("documents", "pages"):
        c.sql(f"create view {name_} as select * from '{DATA}/{name_}.parquet'")
    sql = c.sql(queries.ORACLE_SQL[name])
    cols = sorted(sql.columns)
    want = sorted(repr(tuple(dict(zip(sql.columns, r))[k] for k in cols)) for r in sql.fetchall())
    mine = queries.QUERIES[name](spark, DATA)
    assert sorted(mine.columns) == cols
    assert sorted(repr(tuple(r[k] for k in cols)) for r in mine.collect()) == want


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
