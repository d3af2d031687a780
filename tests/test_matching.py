import hashlib
from collections import Counter
import random

import pytest

from seqloom.operators import matching as M
from seqloom.operators import patterns as P
from seqloom.operators import stats as S
from seqloom.operators.extract import PairError, extract, extract_pairs, zip_mates
from seqloom.operators.tagging import MATCHING, NOT_MATCHING, TagError, check_tag, tag

RECORD = "file string, mate int, rec_no long, id string, seq string, qual string, raw string"
SIMPLE = ["ACGTACGT", "TTTTTTTT", "GGACGTCC"]


def table(spark, seqs, mate=1):
    return spark.createDataFrame([("f", mate, i, f"seq{i + 1}", s, None, f">{i}\n{s}\n") for i, s in enumerate(seqs)], RECORD)


def naive(seqs, patterns):
    out = set()
    for i, s in enumerate(seqs):
        b = (s or "").encode()
        for p in patterns:
            q = p.encode()
            out |= {(i, p, k) for k in range(len(b) - len(q) + 1) if b[k : k + len(q)] == q}
    return out


def got(df):
    return {(r.rec_no, r.pattern, r.position) for r in df.collect()}


def test_simple_search(spark):
    q = P.plan(P.prepare(["ACG"], reverse_complement=True))
    r = extract(table(spark, SIMPLE), q)
    assert [x.id for x in r.kept.orderBy("rec_no").collect()] == ["seq1", "seq3"]
    rows = [(x.record_id, x.pattern, x.position) for x in M.in_report_order(r.hits, q).collect()]
    assert rows == [("seq1", "ACG", 0), ("seq1", "ACG", 4), ("seq1", "CGT", 1), ("seq1", "CGT", 5), ("seq3", "ACG", 2), ("seq3", "CGT", 3)]
    assert {x["pattern"]: x["count"] for x in r.pattern_counts.collect()} == {"ACG": 2, "CGT": 2}  # records, not occurrences
    s = r.summary.first()
    assert (s.patterns_searched, s.patterns_found, s.found_percent, s.records_searched, s.characters_searched, s.matches, s.records_hit) == (2, 2, "100.00", 3, 24, 6, 2)
    inverted = extract(table(spark, SIMPLE), q, invert=True)
    assert [x.id for x in inverted.kept.collect()] == ["seq2"] and inverted.hits.count() == 6


def test_multi_pattern_search_counts_and_orders_by_match_end(spark):
    q = P.plan(P.prepare(["A", "AG", "G", "AA", "AGC"]), force_multi=True)
    r = extract(table(spark, ["AGCA", "TT"]), q)
    assert [(x.pattern, x.position) for x in M.in_report_order(r.hits, q).collect()] == [("A", 0), ("AG", 0), ("G", 1), ("AGC", 0), ("A", 3)]
    assert {x["pattern"]: x["count"] for x in r.pattern_counts.collect()} == {"A": 2, "AG": 1, "G": 1, "AA": 0, "AGC": 1}


@pytest.mark.parametrize("n", [1, 13, 14, 40])
def test_strategies_agree_with_naive_search(spark, n):
    rng = random.Random(n)
    seqs = ["".join(rng.choice("aAbéß😀") for _ in range(rng.randrange(60))) for _ in range(40)] + ["", None, "AAAA", "éAA"]
    patterns = P.prepare({"".join(rng.choice("aAbé") for _ in range(rng.randrange(1, 4))) for _ in range(n)} | {"AA"})
    q, df = P.plan(patterns, force_multi=True), table(spark, seqs)
    want = naive(seqs, patterns)
    assert got(M.hits(df, q)) == want
    assert got(M.hits_by_join(df, q.frame(spark))) == want
    assert {r.rec_no for r in df.where(M.any_match(df, q)).collect()} == {x[0] for x in want}
    found = {r.rec_no: r.f for r in df.select("rec_no", M.found_set(df, q).alias("f")).collect()}
    assert found == {i: sorted({p for j, p, _ in want if j == i}, key=str.encode) for i in range(len(seqs))}
    assert df.where(~M.any_match(df, q)).count() == len(seqs) - len({x[0] for x in want})


@pytest.mark.parametrize("more", [[], [f"x{i:02}" for i in range(20)]])
def test_case_folding_is_ascii_and_reports_each_spelling(spark, more):
    q = P.plan(P.prepare(["acg", "ACG", "éA", *more]), case_insensitive=True)
    df = table(spark, ["xAcG", "ÉA", "éa"])
    assert got(M.hits(df, q)) == {(0, "acg", 1), (0, "ACG", 1), (2, "éA", 0)}
    assert {r.rec_no: r.f for r in df.select("rec_no", M.found_set(df, q).alias("f")).collect()} == {0: ["ACG", "acg"], 1: [], 2: ["éA"]}
    assert {r.rec_no for r in df.where(M.any_match(df, q)).collect()} == {0, 2}


def test_overlaps_and_short_sequences(spark):
    q = P.plan(["AA"])
    assert got(M.hits(table(spark, ["AAAA", "A", "", None, "éAA"]), q)) == {(0, "AA", 0), (0, "AA", 1), (0, "AA", 2), (4, "AA", 2)}


def test_canonical_patterns_do_not_find_the_other_strand(spark):
    q = P.plan(P.prepare(["CGTT"], canonical=True))
    assert q.patterns == ("AACG",)
    assert extract(table(spark, ["CGTT", "AACG"]), q).kept.count() == 1


def test_pairs(spark):
    one, two = table(spark, ["ACTTGGGG", "GGGGGGGG", "GG"]), table(spark, ["GGGGGGGG", "GGGCTTGG", "AA"], 2)
    q = P.plan(["CTT"])
    r = extract_pairs(zip_mates(one, two), q)
    assert {(x.rec_no, x.mate) for x in r.kept.collect()} == {(0, 1), (0, 2), (1, 1), (1, 2)}
    s = r.paired_summary.first()
    assert (s.hits_1, s.hits_2, s.records_hit_1, s.records_hit_2, s.extracted) == (1, 1, 1, 1, 4)
    assert {(x.rec_no, x.mate) for x in extract_pairs(zip_mates(one, two), q, invert=True).kept.collect()} == {(2, 1), (2, 2)}
    for a, b in ((one, two.limit(2)), (one.limit(2), two)):
        with pytest.raises(PairError):
            zip_mates(a, b)


def test_several_pairs_of_files(spark, tmp_path):
    from seqloom.sources.fastx import read_fastx

    texts = {"a1": "@r0\nACGT\n+\nIIII\n@r1\nTTTT\n+\nIIII\n", "a2": "@r0\nCCCC\n+\nIIII\n@r1\nCCCC\n+\nIIII\n", "b1": "@r0\nTTTT\n+\nIIII\n@r1\nGATTACA\n+\nIIIIIII\n", "b2": "@r0\nCCCC\n+\nIIII\n@r1\nGATT\n+\nIIII\n"}
    for name, text in texts.items():
        (tmp_path / name[1]).mkdir(exist_ok=True)
        (tmp_path / name[1] / f"{name}.fq").write_text(text)
    both = zip_mates(read_fastx(spark, str(tmp_path / "1")), read_fastx(spark, str(tmp_path / "2"), 2))
    q = P.plan(["GATTACA", "CCCC"])
    r = extract_pairs(both, P.plan(["GATTACA"]))
    assert {(x.file, x.rec_no) for x in r.kept.collect()} == {("b1.fq", 1), ("b2.fq", 1)}
    assert {(x.file, x.rec_no) for x in extract_pairs(both, P.plan(["GATTACA"]), invert=True).kept.collect()} == {(f, i) for f in ("a1.fq", "a2.fq", "b1.fq", "b2.fq") for i in (0, 1)} - {("b1.fq", 1), ("b2.fq", 1)}
    r = extract_pairs(both, q)
    s = r.paired_summary.first()
    assert (s.hits_1, s.hits_2, s.records_hit_1, s.records_hit_2, s.extracted) == (1, 3, 1, 3, 8)
    assert {(x.mate, x.hits, x.records_hit) for x in S.density(r.hits).collect()} == {(1, 1, 1), (2, 3, 3)}
    (tmp_path / "2" / "b2.fq").write_text(texts["b2"] + texts["b2"])
    (tmp_path / "2" / "a2.fq").unlink()
    with pytest.raises(PairError):
        zip_mates(read_fastx(spark, str(tmp_path / "1")), read_fastx(spark, str(tmp_path / "2"), 2))


def test_files_of_one_name_are_told_apart(spark, tmp_path):
    from seqloom.sources.fastx import read_fastx

    for folder in "xy":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "s.fa").write_text(">r\nAACAA\n")
    r = extract(read_fastx(spark, f"{tmp_path}/*/s.fa"), P.plan(["AA", "C"]))
    assert r.summary.first().records_hit == 2 and {(x["pattern"], x["count"]) for x in r.pattern_counts.collect()} == {("AA", 2), ("C", 2)}


def test_one_search_gives_the_summary(spark):
    df = table(spark, ["AAAAC", "CAA", "TT", None, ""])
    for q in (P.plan(["AA", "C", "G"]), P.plan(["zz"])):
        h = M.hits(df, q)
        a, b = extract(df, q).summary.first(), S.search_summary(df, h, S.pattern_counts(h, q.frame(spark))).first()
        assert a.asDict() == b.asDict()
    assert extract(df.limit(0), P.plan(["A"])).summary.first().records_searched == 0


def test_pattern_tables_by_size(spark):
    df, patterns = table(spark, ["AAAAC", "CAA", None]), spark.createDataFrame([("AA",), ("C",), ("",), ("AA",)], "pattern string")
    want = {(0, "AA", 0), (0, "AA", 1), (0, "AA", 2), (0, "C", 4), (1, "C", 0), (1, "AA", 1)}
    assert got(M.hits_of_table(df, patterns)) == want == got(M.hits_of_table(df, patterns, 1))
    assert M.hits_of_table(df, patterns.limit(0)).count() == 0


def test_kmers_counted_in_workers(spark, monkeypatch):
    rng = random.Random(4)
    seqs = ["".join(rng.choice("ACé") for _ in range(rng.randrange(0, 90))) for _ in range(40)] + [None]
    every = [s[i : i + 3] for s in seqs if s for i in range(len(s) - 2)]
    df = table(spark, seqs)
    assert {(r["kmer"], r["count"]) for r in S.count_kmers(df, 3).collect()} == set(Counter(every).items())
    least = sorted(set(every), key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))[:7]
    assert [r.kmer for r in S.sample_kmers(df, 3, 7).collect()] == least


ALIGNED = "rec_no long, id string, qname string, seq string, tags array<struct<tag:string,type:string,value:string>>"


def test_tags(spark):
    rows = [(0, "a", "a", "TTCTCTT", [("NM", "i", "1")]), (1, "b", "b", "TTTT", [("km", "Z", "")]), (2, "c", "c", "GAG", [("km", "Z", "X,CTC"), ("AS", "i", "2")]), (3, "d", "d", None, [])]
    df = spark.createDataFrame(rows, ALIGNED)
    q = P.plan(P.prepare(["CTC"], reverse_complement=True))

    def tags(**kw):
        return {r.qname: [tuple(t) for t in r.tags] for r in tag(df, q, **kw).kept.collect()}

    every = {"a": [("NM", "i", "1"), ("km", "Z", "CTC")], "b": [("km", "Z", "")], "c": [("AS", "i", "2"), ("km", "Z", "CTC,GAG,X")], "d": [("km", "Z", "")]}
    assert tags() == every
    assert tags(mode=MATCHING) == {k: every[k] for k in "ac"}
    assert tags(mode=NOT_MATCHING) == {k: every[k] for k in "bd"}
    wrong = spark.createDataFrame([(0, "a", "a", "CTC", [("km", "i", "3")])], ALIGNED)
    with pytest.raises(Exception, match="not a string"):
        tag(wrong, q).kept.collect()
    for bad in ("k", "kmm", "é1"):
        with pytest.raises(TagError):
            check_tag(bad)


def test_recipes(spark):
    q = P.plan(["AA", "C", "G"])
    df = table(spark, ["AAAAC", "CAA", "TT"])
    h = M.hits(df, q)
    counts = S.pattern_counts(h, q.frame(spark))
    assert [(r["pattern"], r["count"]) for r in S.ranking(counts).collect()] == [("AA", 4), ("C", 2), ("G", 0)]
    assert [(r.n, r.header, r.pattern) for r in S.matched_fasta(counts).orderBy("n").collect()] == [(1, ">kmer_1 count=4", "AA"), (2, ">kmer_2 count=2", "C")]
    assert [(r.pattern, r.record_id, r.hits, r.positions) for r in S.multi_hits(h).collect()] == [("AA", "seq1", 3, [0, 1, 2])]
    assert [tuple(r) for r in S.multi_hit_summary(h).collect()] == [("AA", 1, 3, 3)]
    assert {r.record_id: r.matches for r in S.matches_per_record(h).collect()} == {"seq1": 4, "seq2": 2}
    assert {r.bin_start: r.hits for r in S.position_histogram(h, 2).collect()} == {0: 4, 2: 1, 4: 1}
    assert {(r.mate, r.hits, r.records_hit, r.density) for r in S.density(h).collect()} == {(1, 6, 2, 3.0)}
    assert sorted((r.rec_no, r.position, r.kmer) for r in S.enumerate_kmers(df, 3).collect()) == [(0, 0, "AAA"), (0, 1, "AAA"), (0, 2, "AAC"), (1, 0, "CAA")]
    assert [(r["kmer"], r["count"]) for r in S.top_kmers(df, 3, 2).collect()] == [("AAA", 2), ("AAC", 1)]
    assert S.sample_kmers(df, 2, 3).collect() == S.sample_kmers(df, 2, 3).collect()
    empty = S.search_summary(df.limit(0), h.limit(0), counts).first()
    assert (empty.records_searched, empty.characters_searched, empty.matches) == (0, 0, 0)


def test_windowed_counts_on_a_stream(spark, tmp_path):
    from seqloom.streaming.extract import extract_stream, hits_stream, windowed_counts

    schema = "at timestamp, rec_no long, id string, seq string"
    spark.sql("select timestamp'2024-01-01 00:01:00' at, 0L rec_no, 'a' id, 'AAC' seq union all select timestamp'2024-01-01 00:02:00', 1L, 'b', 'AA' union all select timestamp'2024-01-01 01:00:00', 2L, 'c', 'GG'").write.parquet(str(tmp_path / "in"))
    q, stream = P.plan(["AA", "C"]), spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df in (("kept", extract_stream(stream, q)), ("found", hits_stream(stream, q)), ("wins", windowed_counts(stream, q, "at"))):
        w = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "wins" else "append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        w.awaitTermination(120)
    assert {r.rec_no for r in spark.table("kept").collect()} == {0, 1}
    assert got(spark.table("found")) == {(0, "AA", 0), (0, "C", 2), (1, "AA", 0)}
    assert {(r.pattern, r.records) for r in spark.table("wins").collect()} == {("AA", 2), ("C", 1)}
