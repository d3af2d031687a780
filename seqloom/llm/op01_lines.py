"""Line dedup: repeated runs of lines found by prefix doubling over line ids; later copies are deleted.

Native: DataFrame functions only.

The suffixes are those of the sequences of line ids, one sequence per document. Doubling names the
first 2^k lines of each suffix by the first place that has them; the suffixes with one name are an
interval of the suffix array whose common prefix is at least 2^k lines long. Any run of lines, of
whatever length, is named by the two overlapping names of 2^k lines that cover it, so the interval of
suffixes that share it, and the earliest of them, come from one aggregation. A run counts from
``min_words`` words on. Every line of a longer common prefix lies in a shortest such run that starts
or ends at it, so those runs delete the same lines as the maximal ones; merged, they are the maximal
runs. Doubling ends at the length of the longest such run, log2(min_words) steps at most.

Only lines that the corpus has twice take part after the first step, and each step keeps only the
suffixes that share their prefix with another. A step is written to the shared folder.

Lines are the \\n-separated parts of a text; white space around them does not count, and lines
without a word are not compared: inside a run they go with it, elsewhere they stay. The first copy,
by doc_id and then by line, stays; a copy that overlaps its own original loses only what lies behind
it. A null text stays null and an empty one empty. Rows without an id are left as they are. Rows that
repeat an id count as one document and are treated alike. Extra columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import let, shared_dir, stored, where_few

#: Words from which on a repeated run of lines is deleted.
MIN_WORDS = 50

#: White space that does not count at either end of a line, and that separates words.
_SPACE = " \t\r\x0b\f"


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, p, at, h, g, w): number among the lines with a word and among all, two hashes that are the line's id, and words."""
    parts = F.transform(F.split(F.col(text_col).cast("string"), "\n", -1), lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(_SPACE)).alias("line")))
    worded = F.filter(parts, lambda x: x["line"] != "")
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.posexplode(worded).alias("p", "x"))
    words = F.size(F.split("x.line", f"[{_SPACE}]+"))
    return rows.select("doc", "p", "x.at", F.xxhash64("x.line").alias("h"), F.hash("x.line").alias("g"), words.alias("w"))


def runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, p, n, at, end, first_doc, first_p, first_at, first_end): shortest runs of min_words words that stand earlier too.

    p and n are a run's first line and length among the lines with a word, at and end its first and last
    among all; first_doc, first_p, first_at and first_end are where it stands first.
    """
    spark, home = df.sparkSession, shared_dir(df.sparkSession)
    source = lines(df, id_col, text_col)
    # Step 0: the name of a line is its first place. Lines without a second copy leave here.
    names = source.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "at")).alias("first")).where("n > 1").drop("n")
    names = stored(names, f"{home}/names0")
    shared = source.join(names, ["h", "g"]).select("doc", "p", "at", "w", "first").repartition("doc").distinct()
    # Islands: consecutive lines that all repeat. Those with too few words can hold no run.
    island = shared.withColumn("island", F.col("p") - F.dense_rank().over(Window.partitionBy("doc").orderBy("p")))
    inside = Window.partitionBy("doc", "island")
    upto = inside.orderBy("p").rangeBetween(Window.unboundedPreceding, 0)
    island = island.withColumn("total", F.sum("w").over(inside)).where(F.col("total") >= min_words)
    island = island.withColumn("stop", F.sum("w").over(upto)).withColumn("start", F.col("stop") - F.col("w"))
    ahead = inside.orderBy("start").rangeBetween(0, min_words - 1)
    behind = inside.orderBy("stop").rangeBetween(1 - min_words, 0)
    end = F.max(F.struct("p", "stop", "at")).over(ahead)
    begin = F.min(F.struct("p", "start", "at")).over(behind)
    placed = island.select("doc", "p", "at", F.col("first.doc").alias("d"), F.col("first.at").alias("q"), "start", "stop", end.alias("e"), begin.alias("b"))
    placed = placed.select(
        "doc", "p", "at", "d", "q",
        F.when(F.col("e.stop") - F.col("start") >= min_words, F.struct((F.col("e.p") - F.col("p") + 1).alias("n"), F.col("e.at").alias("end"))).alias("forth"),
        F.when(F.col("stop") - F.col("b.start") >= min_words, F.struct((F.col("p") - F.col("b.p") + 1).alias("n"), F.col("b.p").alias("p"), F.col("b.at").alias("at"))).alias("back"),
    )
    placed = stored(placed, f"{home}/places")
    wanted = placed.where("forth is not null").select("doc", "p", "forth.n", "at", "forth.end").unionByName(
        placed.where("back is not null").select("doc", "back.p", "back.n", "back.at", F.col("at").alias("end"))
    ).distinct()
    wanted = stored(wanted.withColumn("k", F.floor(F.log2("n") + 1e-9).cast("int")), f"{home}/wanted")
    lengths = [r.k for r in wanted.select("k").distinct().collect()]  # at most log2(min_words) + 1 numbers
    rank, out = placed.select("doc", "p", "d", "q"), spark.createDataFrame([], _RUN)
    out.write.parquet(f"{home}/runs")
    for k in range(max(lengths, default=-1) + 1):
        if k:
            rank = _doubled(rank, 1 << (k - 1), f"{home}/{{}}{k}")
        if k in lengths:
            _repeated(wanted.where(F.col("k") == k), rank, 1 << k, f"{home}/{{}}{k}").write.mode("append").parquet(f"{home}/runs")
    return spark.read.schema(_RUN).parquet(f"{home}/runs")


_RUN = "doc long, p int, n int, at int, end int, first_doc long, first_p int, first_at int, first_end int"


def _doubled(rank: DataFrame, half: int, home: str) -> DataFrame:
    """Names of twice the length: the first place of each pair of neighbouring names that occurs twice.

    The names are written before they are joined: AQE then splits the tasks of those that very many places have.
    """
    next_one = rank.select("doc", (F.col("p") - half).alias("p"), F.col("d").alias("d2"), F.col("q").alias("q2"))
    pairs = rank.join(next_one, ["doc", "p"])
    key = ["d", "q", "d2", "q2"]
    names = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "p")).alias("first")).where("n > 1").drop("n")
    named = pairs.join(stored(names, home.format("names")), key).select("doc", "p", F.col("first.doc").alias("d"), F.col("first.p").alias("q"))
    return stored(named, home.format("rank"))


def _repeated(wanted: DataFrame, rank: DataFrame, width: int, home: str) -> DataFrame:
    """The wanted runs, of width to 2 * width - 1 lines, that stand earlier too."""
    named = wanted.join(rank, ["doc", "p"]).withColumn("tail", F.col("p") + F.col("n") - width)
    if width > 1:
        tail = rank.select("doc", F.col("p").alias("tail"), F.col("d").alias("d2"), F.col("q").alias("q2"))
        named = named.join(tail, ["doc", "tail"])
    key = ["n", "d", "q"] + ["d2", "q2"] * (width > 1)
    interval = named.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "p", "at", "end")).alias("first")).where("copies > 1")
    return named.join(stored(interval, home.format("interval")), key).where("first.doc <> doc or first.p <> p").select(
        "doc", F.col("p").cast("int").alias("p"), F.col("n").cast("int").alias("n"), F.col("at").cast("int").alias("at"), F.col("end").cast("int").alias("end"),
        F.col("first.doc").alias("first_doc"), F.col("first.p").cast("int").alias("first_p"), F.col("first.at").cast("int").alias("first_at"), F.col("first.end").cast("int").alias("first_end"),
    )


def maximal_runs(found: DataFrame) -> DataFrame:
    """The runs of :func:`runs` on one diagonal with their first copies, joined where they meet: maximal common runs.

    The same columns; n is the length of the common prefix, in lines with a word, of the suffixes that begin
    at p and at first_p. A diagonal's runs, no more than a document's lines, come together in one task.
    """
    key = ["doc", "first_doc", F.col("p") - F.col("first_p")]
    order = Window.partitionBy(*key).orderBy("p", "n")
    before = F.max(F.col("p") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((before < F.col("p")).cast("int"), F.lit(1))
    numbered = found.distinct().withColumn("opens", opens).withColumn("part", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy(*key[:2], (F.col("p") - F.col("first_p")).alias("diagonal"), "part").agg(
        F.min("p").alias("p"), (F.max(F.col("p") + F.col("n")) - F.min("p")).alias("n"), F.min("at").alias("at"), F.max("end").alias("end"),
        F.min("first_p").alias("first_p"), F.min("first_at").alias("first_at"), F.max("first_end").alias("first_end"),
    )
    return joined.select(*(c.split()[0] for c in _RUN.split(", ")))


def later_copies(found: DataFrame) -> DataFrame:
    """(doc, at, end): the maximal stretches of lines that :func:`runs` makes later copies, merged per document."""
    at = F.when((F.col("first_doc") == F.col("doc")) & (F.col("first_end") >= F.col("at")), F.col("first_end") + 1).otherwise(F.col("at"))
    spans = found.select("doc", at.alias("at"), "end").where("at <= end")
    order = Window.partitionBy("doc").orderBy("at", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.coalesce(before, F.lit(-2)) + 1 < F.col("at")).cast("int")
    numbered = spans.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "stretch").agg(F.min("at").alias("at"), F.max("end").alias("end")).drop("stretch")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The table with the later copies of repeated runs taken out of its texts, and ``n_deleted`` lines (``n_deleted_`` where the table has such a column).

    The stretches of a document, fewer than its lines, are gathered with it; no group is larger than a document.
    Where a count shows them to be few they go to the texts, else both are shuffled.
    """
    copies = later_copies(runs(df, id_col, text_col, min_words))
    cut = copies.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "end"))).alias("cut"))
    mine = "__cut"
    while {mine, f"{mine}_doc"} & set(df.columns):
        mine += "_"
    count = "n_deleted"
    while count in df.columns:
        count += "_"
    cut = where_few(cut.select(F.col("doc").alias(f"{mine}_doc"), F.col("cut").alias(mine)), F.size(mine))
    joined = df.join(cut, F.col(id_col) == F.col(f"{mine}_doc"), "left")
    text, spans = F.col(text_col), F.col(mine)

    def kept_before(parts, i):
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"] + 1)
        end = F.coalesce(F.get(spans, i)["at"], F.size(parts))
        return F.slice(parts, begin + 1, F.greatest(end - begin, F.lit(0)))

    left = let(F.split(text, "\n", -1), lambda parts: F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: kept_before(parts, i))))
    rest = F.array_join(left, "\n")
    gone = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["at"] + 1)
    clean = F.when(spans.isNotNull(), rest).otherwise(text)
    n_deleted = F.when(spans.isNotNull(), gone).otherwise(F.lit(0).cast("long"))
    return joined.select(*(clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns), n_deleted.alias(count))
