import pytest

from seqloom.operators import patterns as P


def test_file_lines_are_told_before_they_are_trimmed():
    assert P.parse_pattern_text(">h\nACG \n# c\n\n  #x\nTT\r\n") == ["ACG", "#x", "TT"]
    with pytest.raises(P.PatternError):
        P.parse_pattern_text("\n#only\n")
    assert P.parse_pattern_text(" \n") == [""]  # counts as a line; dropped with the empty patterns
    with pytest.raises(P.PatternError):
        P.prepare(P.parse_pattern_text(" \n"))


def test_steps_in_order(tmp_path):
    assert P.prepare(["ACG"], reverse_complement=True) == ["ACG", "CGT"]
    assert P.prepare(["acgr"], uppercase=True, reverse_complement=True) == ["ACGR", "YCGT"]
    assert P.prepare(["TTT", "ACG", "CGT"], canonical=True) == ["AAA", "ACG"]
    assert P.prepare(["B", "a", "", "B"]) == ["B", "a"]
    assert P.prepare(["ACGT"], lowercase=True, reverse_complement=True) == ["acgt"]
    path = tmp_path / "p.txt"
    path.write_text(">a\nACG\nTTT\n>b\nACG\n")
    assert P.prepare(["unused"], str(path)) == ["ACG", "TTT"]
    for bad in ([], [""]):
        with pytest.raises(P.PatternError):
            P.prepare(bad)
    with pytest.raises(P.PatternError):
        P.prepare(["é"], reverse_complement=True)
    with pytest.raises(P.PatternError):
        P.prepare()


def test_choice_of_search():
    few, many = ["A" * k for k in range(1, 14)], ["A" * k for k in range(1, 15)]
    assert P.plan(few).counting == P.RECORD and P.plan(many).counting == P.OCCURRENCE
    assert P.plan(["A" * 64]).algorithm == P.SINGLE and P.plan(["A" * 65]).algorithm == P.MULTI
    assert P.plan(["é" * 33]).algorithm == P.MULTI  # length in bytes
    assert P.plan(["A"], force_multi=True).algorithm == P.MULTI
    assert P.plan(["A"], case_insensitive=True, q_size=1).algorithm == P.MULTI
    assert P.plan(many, q_size=1).algorithm == P.SINGLE
    for bad, q in ((["AC"], 3), (["A" * 65], 2), (["A"], 0)):
        with pytest.raises(P.PatternError):
            P.plan(bad, q_size=q)
    assert [P.tune_q("A" * n) for n in (0, 1, 2, 3, 4, 8, 9, 30, 31, 55, 56, 64)] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6]
    with pytest.raises(P.PatternError):
        P.tune_q("A" * 65)


def test_frame_agrees(spark):
    words = ["ACG", "TTT", "CGT", "", "ACG"]
    frame = spark.createDataFrame([(w,) for w in words], "pattern string")
    for kw, fw in (({"reverse_complement": True}, {"both_strands": True}), ({"canonical": True}, {"one_strand": True}), ({"lowercase": True}, {"lowercase": True})):
        assert sorted(r.pattern for r in P.prepare_frame(frame, **fw).collect()) == P.prepare(words, **kw)
