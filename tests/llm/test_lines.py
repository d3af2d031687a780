import re

from seqloom.llm import op01_lines as L

from .data import documents, rows, table

SPACE = " \t\r\x0b\x0c"


def brute(docs, least):
    """For every document the lines that some repeated run of at least that many words deletes."""
    seqs = {}
    for d, text in docs:
        if text is not None:
            seqs[d] = [(at, x.strip(SPACE)) for at, x in enumerate(text.split("\n")) if x.strip(SPACE)]
    first, marks = {}, {d: set() for d in seqs}
    found = []
    for d in sorted(seqs):
        s = seqs[d]
        words = [len(re.split(f"[{SPACE}]+", x)) for _, x in s]
        spans = set()
        for a in range(len(s)):
            b = a
            while b < len(s) and sum(words[a : b + 1]) < least:
                b += 1
            if b < len(s):
                spans.add((a, b))
            b = a
            while b >= 0 and sum(words[b : a + 1]) < least:
                b -= 1
            if b >= 0:
                spans.add((b, a))
        for a, b in sorted(spans):
            key = tuple(x for _, x in s[a : b + 1])
            first.setdefault(key, (d, a, s[b][0]))
            found.append((key, d, a, s[a][0], s[b][0]))
    for key, d, a, at, end in found:
        fd, fa, fend = first[key]
        if (fd, fa) != (d, a):
            at = fend + 1 if fd == d and fend >= at else at
            marks[d] |= set(range(at, end + 1))
    return {d: ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in marks[d]), len(marks[d])) if t is not None and marks[d] else (t, 0) for d, t in docs}


def test_brute_force(spark):
    for least in (3, 20, 50):
        want = brute([(r[0], r[1]) for r in rows()], least)
        got = {r.doc_id: (r.text, r.n_deleted) for r in L.dedup(spark.createDataFrame([r[:2] for r in rows()], "doc_id long, text string"), min_words=least).collect()}
        assert got == want
        assert sum(n for _, n in got.values()) > 0


def test_maximal_runs(spark):
    a = [f"line number {i} of the text" for i in range(40)]
    docs = [(1, "\n".join(a)), (2, "\n".join(["other"] + a[5:30] + [""] + a[30:35] + ["end"])), (3, "\n".join(a[2:20] + ["x y"] + a[20:40])), (4, "one line")]
    found = L.runs(spark.createDataFrame(docs, "doc_id long, text string"), min_words=50)
    got = {tuple(r) for r in L.maximal_runs(found).collect()}
    assert got == {(2, 1, 30, 1, 31, 1, 5, 5, 34), (3, 0, 18, 0, 17, 1, 2, 2, 19), (3, 19, 20, 19, 38, 1, 20, 20, 39)}
    # The common prefix of the two suffixes is no longer and cannot begin earlier.
    lines = {d: [x for x in t.split("\n") if x.strip()] for d, t in docs}
    for doc, p, n, _, _, first, q, _, _ in got:
        x, y = lines[doc], lines[first]
        assert x[p : p + n] == y[q : q + n] and (x[p + n : p + n + 1] or ["end of one"]) != (y[q + n : q + n + 1] or ["end of the other"]) and (not p or not q or x[p - 1] != y[q - 1])


def test_long_runs_of_short_lines(spark):
    a = "\n".join(f"line {i}" for i in range(60))
    docs = [(1, a), (2, "intro\n" + a.replace("\n", "\n\n") + "\nend"), (3, "\n".join(a.split("\n")[10:30])), (4, "loop x\n" * 100)]
    got = {r.doc_id: (r.text, r.n_deleted) for r in L.dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_words=30).collect()}
    assert got == brute(docs, 30)
    assert got[2][0] == "intro\nend" and got[3][0] == "" and got[4][0].count("loop x") == 15


def test_edges(spark):
    df = documents(spark, extra=True)
    out = L.dedup(df, min_words=20)
    assert out.columns == [*df.columns, "n_deleted"] and out.count() == df.count()
    plain = {r.doc_id: r.text for r in L.dedup(documents(spark), min_words=20).collect()}
    assert {r.doc_id: r.text for r in out.collect()} == plain and plain[43] is None
    twice = [r for r in out.collect() if r.doc_id == 4]
    assert len(twice) == 3 and len({r.text for r in twice}) == 1
    assert L.dedup(df.limit(0)).count() == 0
    text = "a b c d e f\ng h i j"
    none = spark.createDataFrame([(None, text), (None, text), (1, text)], "doc_id long, text string")
    assert table(L.dedup(none, min_words=5).select("text", "n_deleted")) == [(text, 0)] * 3
