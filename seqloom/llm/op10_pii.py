"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Native: one projection of DataFrame functions, no shuffle and no Python on the executors.

A null text has no spans. Repeated rows are searched each by itself; an empty table gives an empty
result. Only the named columns are read, so others may have any name. Patterns are possessive where
a group repeats, so their time and stack stay bounded on very long texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import let

#: Elements that are summed in one go; see :func:`prefix_sums`.
CHUNK = 512
#: Code points looked at before and after a candidate for context words.
CONTEXT_BEFORE, CONTEXT_AFTER = 40, 20


@dataclass(frozen=True)
class Kind:
    """pattern: proposes spans. needs: a text without any of these has none. base: kept whatever the score.

    score: of a confirmed span; bonus: added when a context word is near. Spans under THRESHOLD go.
    """

    name: str
    pattern: str
    needs: tuple[str, ...]
    score: float
    bonus: float
    context: str
    base: bool = False


THRESHOLD = 0.5
#: Different characters that a key or an unquoted secret has at least.
DIFFERENT = 6

KINDS: tuple[Kind, ...] = (
    # A local part can begin after a character outside its class or where the last match ended.
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",), 0.8, 0.2, r"mail|contact|write|kontakt|courriel|correo", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", (".",), 0.6, 0.3, r"\bip\b|host|server|address|adresse", True),
    Kind("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+", (), 0.8, 0.2, r"card|visa|master|credit|karte|carte|tarjeta", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", ("+",), 0.7, 0.3, r"phone|tel|call|mobile|fax|anruf", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", (), 0.7, 0.3, r"iban|konto|account|compte|cuenta"),
    Kind("secret", r"(?i)(?<![a-z])(?:token|secret|passw(?:or)?d|(?:api|access|secret)[_-]?key)[\"']?[ ]{0,3}[=:][ ]{0,3}(?:[\"'][^\"'\s]{8,}+[\"']|[^\"'\s,;]{8,}+)", ("=", ":"), 0.6, 0.3, r"auth|login|bearer|export"),
    # Tokens that providers mark by how they begin, and private keys in text form.
    Kind("key", r"(?<![A-Za-z0-9_-])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9_-])", ("AKIA", "ASIA", "gh", "xox", "sk-", "AIza", "eyJ"), 0.8, 0.2, r"key|token|secret|bearer"),
    Kind("pem", r"-----BEGIN (?:[A-Z]{1,20} ){0,3}?PRIVATE KEY-----(?:[^-]*+-----END (?:[A-Z]{1,20} ){0,3}?PRIVATE KEY-----)?+", ("PRIVATE KEY-----",), 0.9, 0.1, r"key|ssh|cert"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ("-",), 0.3, 0.5, r"ssn|social security|sozialversicherung"),
)
BASE = tuple(k.name for k in KINDS if k.base)


def prefix_sums(lengths: Column) -> Column:
    """[0, l1, l1+l2, ...] of an array of lengths, in chunks so that long arrays don't cost their square."""
    def running(xs, start):
        return F.aggregate(xs, F.array(start.cast("int")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def summed(chunks):
        sums = F.transform(chunks, lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x))
        starts = F.slice(running(sums, F.lit(0)), F.lit(1), F.size(chunks))
        return F.flatten(F.transform(F.arrays_zip(chunks.alias("c"), starts.alias("b")), lambda z: F.slice(running(z["c"], z["b"]), F.lit(2), F.lit(CHUNK))))

    def cut(xs):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda c: F.slice(xs, c * CHUNK + 1, F.lit(CHUNK)))

    return let(lengths, lambda xs: let(cut(xs), summed))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    """Whether an account number has the remainder 1, its first four characters moved to its end and letters as 10 to 35."""
    bare = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))

    def step(acc, c):
        digit = (acc * 10 + c.cast("int")) % 97
        letter = (acc * 100 + F.ascii(c) - 55) % 97
        return F.when(F.ascii(c) < 58, digit).otherwise(letter)

    characters = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.substring(turned, i, F.lit(1)))
    return F.aggregate(characters, F.lit(0), step) == 1


def _different(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(F.substring(value, 1, 512), "")))


def _confirmed(kind: str, value: Column) -> Column:
    """The checksum or range that a proposed span must satisfy."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & (F.substring(F.regexp_replace(p, "^0+(?=[0-9])", ""), 1, 3).cast("int") <= 255))
    if kind == "card":
        n = F.length(_digits(value))
        return n.between(13, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return _mod97(value)
    if kind == "key":
        return _different(value) >= DIFFERENT
    if kind == "secret":
        # What is quoted is assigned; what is not must be unlike a word: letters and digits, and not few of them.
        said = F.regexp_replace(value, r"^[^=:]*+[=:] *+", "")
        return F.regexp_like(said, F.lit("^[\"']")) | (F.regexp_like(said, F.lit("[A-Za-z]")) & F.regexp_like(said, F.lit("[0-9]")) & (_different(said) >= DIFFERENT))
    return F.lit(True)


def _spans(kind: Kind, text: Column, values: Column) -> Column:
    """Confirmed spans of a kind: code points [start, end), the value and its score.

    What lies between matches gives both the positions and the context, so no text is scanned anew for each match.
    """
    def span(pieces, ends, i):
        value = F.get(values, i)
        near = F.concat_ws(" ", F.lower(F.substring(F.get(pieces, i), -CONTEXT_BEFORE, CONTEXT_BEFORE)), F.lower(F.substring(F.get(pieces, i + 1), 1, CONTEXT_AFTER)))
        score = F.lit(kind.score) + F.when(F.regexp_like(near, F.lit(kind.context)), F.lit(kind.bonus)).otherwise(F.lit(0.0))
        return F.struct(
            F.lit(kind.name).alias("kind"), F.get(ends, 2 * i).alias("start"), F.get(ends, 2 * i + 1).alias("end"),
            value.alias("value"), F.round(score, 2).alias("score"), _confirmed(kind.name, value).alias("ok"),
        )

    def found(pieces):
        places = F.sequence(F.lit(0), F.size(values) - 1)
        lengths = F.flatten(F.transform(places, lambda i: F.array(F.length(F.get(pieces, i)), F.length(F.get(values, i)))))
        every = let(prefix_sums(lengths), lambda ends: F.transform(places, lambda i: span(pieces, ends, i)))
        return F.filter(every, lambda s: s["ok"] if kind.base else s["ok"] & (s["score"] >= THRESHOLD))

    plain = ("kind", "start", "end", "value", "score")
    return F.transform(let(F.split(text, kind.pattern, -1), found), lambda s: F.struct(*(s[c].alias(c) for c in plain)))


_SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): all spans of every kind, in the order of KINDS and then of their start."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    values = []
    for k in KINDS:
        may = F.lit(False) if k.needs else F.lit(True)
        for x in k.needs:
            may = may | F.contains("text", F.lit(x))
        values.append(F.when(may, F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"v_{k.name}"))
    rows = rows.select("doc_id", "text", *values)
    spans = [F.when(F.size(f"v_{k.name}") > 0, _spans(k, F.col("text"), F.col(f"v_{k.name}"))).otherwise(F.array().cast(_SPAN)) for k in KINDS]
    return rows.select("doc_id", F.concat(*spans).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts with every base kind and accepted extra kind replaced by its name in brackets."""
    out = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), out.alias("text")).join(find(df, id_col, text_col), "doc_id")
    parts = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = F.aggregate(
        parts, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    return rows.select("doc_id", done.alias("text"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(_count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
