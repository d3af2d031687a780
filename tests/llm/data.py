"""Small tables with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and to in that was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people mr how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()


def prose(rng: random.Random, n: int) -> str:
    out, line = [], []
    for i in range(n):
        line.append(rng.choice(WORDS))
        if rng.random() < 0.08 or i == n - 1:
            out.append(" ".join(line).capitalize() + ".")
            line = []
    return "\n".join(" ".join(out[k : k + 4]) for k in range(0, len(out), 4))


def rows(seed: int = 1, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randrange(5, 160)) for _ in range(n)]
    shared = prose(rng, 70)
    texts += [texts[0], texts[0], texts[1] + " more", None, None, "", "   \n\t ", shared, f"{texts[2]}\n{shared}", f"{shared}\n{texts[3]}\n{shared}"]
    texts += ["é ñ ß 漢字 😀 'S it's", "x" * 30_000, "ab " * 9_000, "a\n" * 400, "   ", "One\rtwo\x0bthree\x0cfour"]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


def documents(spark, extra: bool = False):
    """Rows, two of them twice. extra: columns whose names the operators use themselves."""
    all_rows = rows()
    df = spark.createDataFrame(all_rows + [all_rows[4], all_rows[4], all_rows[47]], SCHEMA)
    if extra:
        names = ("ids", "decoded", "measures", "row", "spans", "fp", "component_id", "cut", "doc", "at", "h", "w", "n_deleted_before", "score", "slots", "pos")
        df = df.selectExpr("*", *(f"'x' as `{n}`" for n in names))
    return df


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
