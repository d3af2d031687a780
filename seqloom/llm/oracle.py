"""DuckDB SQL for the queries that SQL can express on whole tables.

The others are held against brute force in the tests: op 2 and 5 need a tokenizer, 3 its slot
bindings, 6 XXH64 and a transitive closure, 7 a model, 9 a DOM and 10 look-around.
"""

from __future__ import annotations

from seqloom.llm.op01_lines import MIN_WORDS
from seqloom.llm.op04_quality import BIT, MEASURES, RULES, V1

_OP1 = rf"""
with raw as (
  select doc_id, i - 1 as line_no, trim(string_split(text, chr(10))[i], E' \t\r\x0b\f') as line
  from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(i) where text is not null),
worded as (
  select doc_id, line_no, line, row_number() over (partition by doc_id order by line_no) as p,
         len(regexp_extract_all(line, '[^ \t\r\v\f]+')) as w from raw where line <> ''),
twice as (select line from worded group by line having count(*) > 1),
shared as (select worded.*, p - row_number() over (partition by doc_id order by p) as island from worded join twice using (line)),
summed as (select *, sum(w) over (partition by doc_id, island order by p) as stop from shared),
pairs as (
  select a.doc_id, a.p, a.line_no, b.p as q, b.line_no as last_no, a.island, a.stop - a.w as start, b.stop, a.w as wa, b.w as wb
  from summed a join summed b on a.doc_id = b.doc_id and a.island = b.island and b.p >= a.p
  where b.stop - (a.stop - a.w) >= {MIN_WORDS}
    and (b.stop - b.w - (a.stop - a.w) < {MIN_WORDS} or b.stop - a.stop < {MIN_WORDS})),
named as (
  select pairs.doc_id, pairs.line_no, pairs.last_no, pairs.p,
         (select string_agg(s.line, chr(10) order by s.p) from shared s where s.doc_id = pairs.doc_id and s.p between pairs.p and pairs.q) as content
  from pairs),
copies as (
  select *, first_value(doc_id) over w as first_doc, first_value(p) over w as first_p, first_value(last_no) over w as first_end
  from named window w as (partition by content order by doc_id, p rows between unbounded preceding and unbounded following)),
marks as (
  select doc_id, case when first_doc = doc_id and first_end >= line_no then first_end + 1 else line_no end as line_no, last_no
  from copies where first_doc <> doc_id or first_p <> p),
gone as (select distinct raw.doc_id, raw.line_no from raw join marks on raw.doc_id = marks.doc_id and raw.line_no between marks.line_no and marks.last_no),
n as (select doc_id, count(*) as n_deleted from gone group by doc_id),
left_over as (
  select r.doc_id, string_agg(r.line, chr(10) order by r.line_no) as text
  from (select doc_id, i - 1 as line_no, string_split(text, chr(10))[i] as line
        from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(i)) r
  anti join gone on r.doc_id = gone.doc_id and r.line_no = gone.line_no group by r.doc_id)
select d.doc_id, case when n.n_deleted is null then d.text else coalesce(l.text, '') end as text, coalesce(n.n_deleted, 0) as n_deleted
from documents d left join n on d.doc_id = n.doc_id left join left_over l on d.doc_id = l.doc_id
"""

_BITS = " + ".join(f"case when {rule} then {BIT[name]} else 0 end" for name, rule in RULES)

_OP4 = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
grams as (select doc_id, i, array_to_string(ws[i : i + 2], ' ') as gram from w, unnest(range(1, len(ws) - 1)) u(i)),
twice as (select doc_id, gram from grams group by doc_id, gram having count(*) > 1),
covered as (select distinct g.doc_id, g.i + k as pos from grams g join twice using (doc_id, gram), unnest([0, 1, 2]) v(k)),
rep as (select doc_id, count(*) as n from covered group by doc_id),
m as (
  select w.doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
         coalesce(rep.n, 0) as n_repeat_words, case when len(ws) = 0 then 0 else len(ls) end as n_lines,
         case when len(ws) = 0 then 0 else length(t) - length(replace(t, '!', '')) end as n_exclaims,
         length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) as n_letters, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) as n_capitals,
         coalesce(list_max(list_transform(ws, lambda x: length(x))), 0) as longest_word
  from w left join rep on w.doc_id = rep.doc_id),
b as (select *, ({_BITS})::bigint as fail_bits from m)
select doc_id, {", ".join(f"{x}::bigint as {x}" for x in MEASURES)}, fail_bits,
       fail_bits & {BIT["min_words"] | BIT["repeat_words"]} <> 0 as base_failed,
       fail_bits & {V1.mask | BIT["min_words"] | BIT["repeat_words"]} = 0 as kept
from b
"""

# The base32 form of a digest: its hexadecimal digits as bits, five of them a character.
_OP8 = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
last as (select html, max(page_id) as last from p group by html),
bits as (select page_id, html, array_to_string(list_transform(string_split(h, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', (instr('0123456789abcdef', c) - 1)::int * 4 + 1, 4)), '') as b from p),
digests as (select page_id, html, array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (16 * substr(b, i + 1, 1)::int + 8 * substr(b, i + 2, 1)::int + 4 * substr(b, i + 3, 1)::int + 2 * substr(b, i + 4, 1)::int + substr(b, i + 5, 1)::int + 1)::int, 1)), '') as digest from bits)
select page_id, strlen(html) as payload_bytes, digest as payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to
from digests join last using (html)
"""

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": _OP1, "op4_quality_rules": _OP4, "op8_warc_round_trip": _OP8}
