"""Queries over the driver's tables and their SQL counterparts.

Documents are the records (``doc_id`` numbers them, ``text`` is the sequence); patterns are the first 31
characters of the benchmark's items; turns of a conversation, user and assistant, are the mates of pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.sequence import canonical, reverse_complement
from seqloom.operators import matching, stats, tagging
from seqloom.operators import patterns as pats
from seqloom.operators.extract import Result, extract, extract_pairs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Patterns with overlaps, with letters of several bytes, and with both cases.
OVERLAPPING = ["ana", "aa", "oè"]
MIXED_CASE = ["THE ", "Ana", "éLe"]

_PATTERNS = "patterns as (select distinct substr(text, 1, 31) as pattern from benchmark where text <> '')"
# Candidates are where a pattern's first character stands: the cumulative lengths of the pieces between them.
_HITS = """pieces as (
  select doc_id, pattern, unnest(string_split(text, left(pattern, 1))) as piece, generate_subscripts(string_split(text, left(pattern, 1)), 1) as n
  from documents join patterns on contains(text, pattern)),
starts as (
  select doc_id, pattern, sum(length(piece) + 1) over w as i, (sum(strlen(piece) + strlen(left(pattern, 1))) over w - strlen(left(pattern, 1)))::bigint as position
  from pieces window w as (partition by doc_id, pattern order by n)),
hits as (
  select doc_id as rec_no, pattern, position from starts join documents using (doc_id) where substr(text, i::bigint, length(pattern)) = pattern)"""
_COUNTS = "counts as (select p.pattern, count(h.pattern) as count from patterns p left join hits h using (pattern) group by p.pattern)"
_LITERALS = "patterns as (select unnest(['ana', 'aa', 'oè']) as pattern)"


def _sql(*parts: str, then: str) -> str:
    return f"with {', '.join(parts)}\n{then}"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_no"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("seq"))


def _pattern_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").where("text <> ''").select(F.substring("text", 1, 31).alias("pattern")).distinct()


def _benchmark_query(spark: SparkSession, sf_dir: str) -> pats.PatternList:
    """The query list is an argument of a search, so it is on the driver, as a command line's would be."""
    return pats.plan(pats.prepare([r.pattern for r in _pattern_frame(spark, sf_dir).collect()]), force_multi=True)


def _search(spark: SparkSession, sf_dir: str) -> Result:
    return extract(_records(spark, sf_dir), _benchmark_query(spark, sf_dir))


_PLAIN = ["rec_no", "pattern", "position"]
_ANY = "exists (select 1 from patterns where contains(text, pattern))"


@query(_sql(_PATTERNS, then=f"select doc_id as rec_no, text as seq from documents where {_ANY}"))
def extract_any(spark, sf_dir):
    return _search(spark, sf_dir).kept.select("rec_no", "seq")


@query(_sql(_PATTERNS, then=f"select doc_id as rec_no, text as seq from documents where not {_ANY}"))
def extract_invert(spark, sf_dir):
    return extract(_records(spark, sf_dir), _benchmark_query(spark, sf_dir), invert=True).kept.select("rec_no", "seq")


@query(_sql(_LITERALS, then=f"select doc_id as rec_no, length(text) as n from documents where {_ANY}"))
def extract_few_patterns(spark, sf_dir):
    q = pats.plan(pats.prepare(OVERLAPPING))
    return extract(_records(spark, sf_dir), q).kept.select("rec_no", F.length("seq").cast("long").alias("n"))


@query(_sql(_PATTERNS, _HITS, then="select rec_no, pattern, position from hits"))
def hits(spark, sf_dir):
    return _search(spark, sf_dir).hits.select(*_PLAIN)


@query(_sql(_LITERALS, _HITS, then="select rec_no, pattern, position from hits"))
def hits_overlapping(spark, sf_dir):
    return matching.hits(_records(spark, sf_dir), pats.plan(pats.prepare(OVERLAPPING))).select(*_PLAIN)


@query(_sql(_PATTERNS, _HITS, then="select rec_no, pattern, position from hits"))
def hits_by_kmer_join(spark, sf_dir):
    return matching.hits_by_join(_records(spark, sf_dir), _pattern_frame(spark, sf_dir)).select(*_PLAIN)


@query(_sql(_PATTERNS, _HITS, then="select rec_no, pattern, position from hits"))
def hits_by_table_size(spark, sf_dir):
    return matching.hits_of_table(_records(spark, sf_dir), _pattern_frame(spark, sf_dir)).select(*_PLAIN)


@query(_sql(_PATTERNS, _HITS, _COUNTS, then="select pattern, count from counts"))
def counts_occurrence(spark, sf_dir):
    r = _search(spark, sf_dir)
    return stats.pattern_counts(r.hits, r.query.frame(spark), pats.OCCURRENCE)


@query(_sql(_PATTERNS, then="select pattern, count(distinct doc_id) as count from patterns left join documents on contains(text, pattern) group by pattern"))
def counts_record(spark, sf_dir):
    r = _search(spark, sf_dir)
    return stats.pattern_counts(r.hits, r.query.frame(spark), pats.RECORD)


@query(
    _sql(
        _PATTERNS, _HITS, _COUNTS,
        then="""select (select count(*) from patterns) as patterns_searched, (select count(*) from counts where count > 0) as patterns_found,
  printf('%.2f', 100.0 * (select count(*) from counts where count > 0) / (select count(*) from patterns)) as found_percent,
  (select count(*) from documents) as records_searched, (select sum(strlen(text))::bigint from documents) as characters_searched,
  (select count(*) from hits) as matches, (select count(distinct rec_no) from hits) as records_hit""",
    )
)
def summary(spark, sf_dir):
    return _search(spark, sf_dir).summary


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_FOLDED = """spelt as (select unnest(['THE ', 'Ana', 'éLe']) as spelling), documents as (select doc_id, {} as text from main.documents),
patterns as (select distinct {} as pattern from spelt)""".format(_FOLD.format("text"), _FOLD.format("spelling"))


@query(_sql(_FOLDED, _HITS, then=f"select rec_no, spelling as pattern, position from hits join spelt on pattern = {_FOLD.format('spelling')}"))
def hits_case_insensitive(spark, sf_dir):
    q = pats.plan(pats.prepare(MIXED_CASE), case_insensitive=True)
    return matching.hits(_records(spark, sf_dir), q).select(*_PLAIN)


# Nucleotide codes and complements.
_RC = "reverse(translate({}, 'ACGTRYKMBVDHSWNUacgtrykmbvdhswnu', 'TGCAYRMKVBHDSWNAtgcayrmkvbhdswna'))"


@query(_sql(_PATTERNS, then=f"select pattern, {_RC.format('pattern')} as reverse_complement, least(pattern, {_RC.format('pattern')}) as canonical from patterns"))
def pattern_strands(spark, sf_dir):
    p = F.col("pattern")
    return _pattern_frame(spark, sf_dir).select(p, reverse_complement(p).alias("reverse_complement"), canonical(p).alias("canonical"))


@query(_sql(_PATTERNS, then=f"select pattern from patterns union select {_RC.format('pattern')} from patterns"))
def patterns_both_strands(spark, sf_dir):
    return pats.prepare_frame(_pattern_frame(spark, sf_dir), both_strands=True)


@query(_sql(_PATTERNS, then=f"select distinct least(lower(pattern), {_RC.format('lower(pattern)')}) as pattern from patterns"))
def patterns_canonical_lower(spark, sf_dir):
    return pats.prepare_frame(_pattern_frame(spark, sf_dir), one_strand=True, lowercase=True)


@query(_sql(_PATTERNS, then="select distinct upper(replace(pattern, 'ß', 'ss')) as pattern from patterns"))
def patterns_upper(spark, sf_dir):
    return pats.prepare_frame(_pattern_frame(spark, sf_dir), uppercase=True)


@query(_sql(_PATTERNS, then="select count(*) as patterns, max(strlen(pattern))::bigint as longest, count(*) >= 14 or max(strlen(pattern)) > 64 as multi from patterns"))
def select_algorithm(spark, sf_dir):
    found = pats.prepare([r.pattern for r in _pattern_frame(spark, sf_dir).collect()])
    one = (len(found), max(map(pats.byte_length, found)), pats.recommends_multi(found))
    return spark.createDataFrame([one], "patterns long, longest long, multi boolean")


# Pairs: the n-th user turn and the n-th assistant turn of a conversation.
_MATES = """turns as (select conv_id, case role when 'user' then 1 else 2 end as mate, text, row_number() over (partition by conv_id, role order by turn, text) as rec_no
  from conversations where role in ('user', 'assistant')),
mates as (select t.* from turns t join turns o on t.conv_id = o.conv_id and t.rec_no = o.rec_no and t.mate <> o.mate)"""
_PAIR_PATTERNS = "patterns as (select unnest(['then', 'ción', 'oè']) as pattern)"
_PAIRS_HIT = f"pairs_hit as (select distinct conv_id, rec_no from mates where {_ANY})"
PAIR_PATTERNS = ["then", "ción", "oè"]


def _mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both mates of every pair. One window brings a conversation's turns together; pairs need no join."""
    turns = _table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    n = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text"))
    turns = turns.select("conv_id", F.when(F.col("role") == "user", 1).otherwise(2).alias("mate"), n.cast("long").alias("rec_no"), F.col("text").alias("seq"))
    both = F.count(F.lit(1)).over(Window.partitionBy("conv_id", "rec_no"))
    return turns.withColumn("both", both).where("both = 2").select(
        F.col("conv_id").alias("pair_group"), "rec_no", "mate", "seq", F.concat_ws("/", "conv_id", "rec_no", "mate").alias("id"), F.col("conv_id").cast("string").alias("file")
    )


def _pairs(spark, sf_dir, invert=False) -> Result:
    return extract_pairs(_mates(spark, sf_dir), pats.plan(pats.prepare(PAIR_PATTERNS)), invert=invert)


_KEPT = "select m.conv_id, m.rec_no, m.mate::bigint as mate, m.text as seq from mates m {} join pairs_hit h on m.conv_id = h.conv_id and m.rec_no = h.rec_no"


@query(_sql(_MATES, _PAIR_PATTERNS, _PAIRS_HIT, then=_KEPT.format("semi")))
def paired_extract(spark, sf_dir):
    return _pairs(spark, sf_dir).kept.select(F.col("pair_group").alias("conv_id"), "rec_no", F.col("mate").cast("long").alias("mate"), "seq")


@query(_sql(_MATES, _PAIR_PATTERNS, _PAIRS_HIT, then=_KEPT.format("anti")))
def paired_extract_invert(spark, sf_dir):
    return _pairs(spark, sf_dir, True).kept.select(F.col("pair_group").alias("conv_id"), "rec_no", F.col("mate").cast("long").alias("mate"), "seq")


_PAIR_HITS = """hits as (
  select conv_id, mate, rec_no, pattern, i from (select *, unnest(range(1, length(text) - length(pattern) + 2)) as i from mates join patterns on contains(text, pattern))
  where substr(text, i, length(pattern)) = pattern)"""


@query(
    _sql(
        _MATES, _PAIR_PATTERNS, _PAIRS_HIT, _PAIR_HITS,
        then="""select count(*) filter (mate = 1) as hits_1, count(*) filter (mate = 2) as hits_2,
  count(distinct (conv_id, rec_no)) filter (mate = 1) as records_hit_1, count(distinct (conv_id, rec_no)) filter (mate = 2) as records_hit_2,
  (select count(*) * 2 from pairs_hit) as extracted from hits""",
    )
)
def paired_stats(spark, sf_dir):
    return _pairs(spark, sf_dir).paired_summary


@query(_sql(_MATES, _PAIR_PATTERNS, _PAIR_HITS, then="select mate::bigint as mate, count(*) as hits, count(distinct (conv_id, rec_no)) as records_hit, round(count(*) / count(distinct (conv_id, rec_no)), 2) as density from hits group by mate"))
def paired_density(spark, sf_dir):
    return stats.density(_pairs(spark, sf_dir).hits).withColumn("mate", F.col("mate").cast("long"))


_FOUND = "coalesce((select string_agg(pattern, ',' order by pattern) from patterns where contains(text, pattern)), '')"


def _alignments(spark, sf_dir, old: bool) -> DataFrame:
    none = F.array().cast("array<struct<tag:string,type:string,value:string>>")
    tags = F.array(F.struct(F.lit("km").alias("tag"), F.lit("Z").alias("type"), F.col("lang").alias("value"))) if old else none
    d = _table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("rec_no"), F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("qname"), F.col("text").alias("seq"), tags.alias("tags"))


def _tagged(spark, sf_dir, mode=tagging.ALL, old=False) -> DataFrame:
    r = tagging.tag(_alignments(spark, sf_dir, old), _benchmark_query(spark, sf_dir), mode=mode)
    return r.kept.select("rec_no", F.element_at("tags", -1)["value"].alias("km"))


@query(_sql(_PATTERNS, then=f"select doc_id as rec_no, {_FOUND} as km from documents"))
def tag_all(spark, sf_dir):
    return _tagged(spark, sf_dir)


@query(_sql(_PATTERNS, then=f"select doc_id as rec_no, {_FOUND} as km from documents where {_ANY}"))
def tag_matching(spark, sf_dir):
    return _tagged(spark, sf_dir, tagging.MATCHING)


@query(_sql(_PATTERNS, then=f"select doc_id as rec_no, {_FOUND} as km from documents where not {_ANY}"))
def tag_not_matching(spark, sf_dir):
    return _tagged(spark, sf_dir, tagging.NOT_MATCHING)


@query(
    _sql(
        _PATTERNS,
        then="""select doc_id as rec_no, coalesce((select string_agg(v, ',' order by v) from
  (select pattern as v from patterns where contains(text, pattern) union select lang where lang <> '')), '') as km from documents""",
    )
)
def tag_merge(spark, sf_dir):
    return _tagged(spark, sf_dir, old=True)


@query(_sql(_PATTERNS, _HITS, _COUNTS, then="select row_number() over (order by count desc, pattern) as n, pattern, count from counts"))
def recipe_ranking(spark, sf_dir):
    ranked = stats.ranking(_search(spark, sf_dir).pattern_counts)  # as many rows as patterns
    return ranked.withColumn("n", F.row_number().over(Window.orderBy(F.desc("count"), "pattern")).cast("long"))


@query(_sql(_PATTERNS, then=f"select count(*) as records, count(*) filter ({_ANY}) as hit, round(100.0 * count(*) filter ({_ANY}) / count(*), 3) as rate from documents"))
def recipe_rate(spark, sf_dir):
    records = _records(spark, sf_dir)
    found = matching.any_match(records, _benchmark_query(spark, sf_dir))
    one = records.agg(F.count(F.lit(1)).alias("records"), F.sum(found.cast("long")).alias("hit"))
    return one.withColumn("rate", stats.rate(F.col("hit"), F.col("records")))


@query(_sql(_PATTERNS, _HITS, _COUNTS, then="select row_number() over (order by count desc, pattern) as n, '>kmer_' || row_number() over (order by count desc, pattern) || ' count=' || count as header, pattern from counts where count > 0"))
def recipe_matched_fasta(spark, sf_dir):
    return stats.matched_fasta(_search(spark, sf_dir).pattern_counts).withColumn("n", F.col("n").cast("long"))


_MULTI = "multi as (select rec_no, pattern, count(*) as hits, string_agg(position::varchar, ',' order by position) as positions from hits group by rec_no, pattern having count(*) > 1)"


@query(_sql(_LITERALS, _HITS, _MULTI, then="select rec_no, pattern, hits, positions from multi"))
def recipe_multi_hits(spark, sf_dir):
    found = stats.multi_hits(matching.hits(_records(spark, sf_dir), pats.plan(pats.prepare(OVERLAPPING))))
    return found.select("rec_no", "pattern", "hits", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(_sql(_LITERALS, _HITS, _MULTI, then="select pattern, count(*) as records, sum(hits)::bigint as hits, max(hits) as most from multi group by pattern"))
def recipe_multi_hit_summary(spark, sf_dir):
    return stats.multi_hit_summary(matching.hits(_records(spark, sf_dir), pats.plan(pats.prepare(OVERLAPPING))))


@query(_sql(_LITERALS, _HITS, then="select rec_no, count(*) as matches from hits group by rec_no"))
def recipe_matches_per_record(spark, sf_dir):
    return stats.matches_per_record(matching.hits(_records(spark, sf_dir), pats.plan(pats.prepare(OVERLAPPING)))).select("rec_no", "matches")


@query(_sql(_LITERALS, _HITS, then="select (position // 100) * 100 as bin_start, count(*) as hits from hits group by 1"))
def recipe_histogram(spark, sf_dir):
    return stats.position_histogram(matching.hits(_records(spark, sf_dir), pats.plan(pats.prepare(OVERLAPPING))))


@query(_sql(_LITERALS, _HITS, then="select pattern, count(*) as count from hits group by pattern"))
def recipe_counts_table(spark, sf_dir):
    q = pats.plan(pats.prepare(OVERLAPPING))
    return stats.pattern_counts(matching.hits(_records(spark, sf_dir), q), q.frame(spark)).where("count > 0")


_KMERS = "kmers as (select doc_id as rec_no, unnest(list_transform(range(1, length(text) - {0} + 2), lambda i: substr(text, i, {0}))) as kmer, unnest(range(0, length(text) - {0} + 1)) as position from documents)"


@query(_sql(_KMERS.format(31), then="select rec_no, position, kmer from kmers"))
def kmer_enumerate(spark, sf_dir):
    return stats.enumerate_kmers(_records(spark, sf_dir), 31)


@query(_sql(_KMERS.format(8), then="select kmer, count(*) as count from kmers group by kmer order by count desc, kmer limit 100"))
def kmer_top(spark, sf_dir):
    return stats.top_kmers(_records(spark, sf_dir), 8, 100)


@query(_sql(_KMERS.format(31), then="select distinct kmer, md5('42:' || kmer) as m from kmers order by m, kmer limit 100").replace("select distinct kmer, md5", "select kmer from (select distinct kmer, md5") + ")")
def kmer_sample(spark, sf_dir):
    return stats.sample_kmers(_records(spark, sf_dir), 31, 100)


_PLACE = "row_number() over (partition by rec_no order by {})"


@query(_sql(_LITERALS, _HITS, then=f"select rec_no, pattern, position, {_PLACE.format('pattern, position')} as place from hits"))
def order_single(spark, sf_dir):
    h = matching.hits(_records(spark, sf_dir), pats.plan(pats.prepare(OVERLAPPING)))
    return h.select(*_PLAIN, F.row_number().over(Window.partitionBy("rec_no").orderBy("pattern", "position")).cast("long").alias("place"))


@query(_sql(_LITERALS, _HITS, then=f"select rec_no, pattern, position, {_PLACE.format('position + strlen(pattern), strlen(pattern) desc')} as place from hits"))
def order_multi(spark, sf_dir):
    h = matching.hits(_records(spark, sf_dir), pats.plan(pats.prepare(OVERLAPPING)))
    size = F.octet_length("pattern")
    return h.select(*_PLAIN, F.row_number().over(Window.partitionBy("rec_no").orderBy(F.col("position") + size, size.desc())).cast("long").alias("place"))
