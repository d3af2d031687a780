import random
import re

from seqloom.llm import op03_decontaminate as D

from .data import documents, prose, table

ITEMS = [
    (1, "A farmer named Tom has 12 apples and gives 5 apples to Anna before Tom walks 3 km to the market."),
    (2, "the quick brown fox jumps over the lazy dog while seven small birds sing in a tall green tree nearby today"),
    (3, "short one"),
    (4, None),
    (5, "A farmer named Tom has 12 apples and gives 5 apples to Anna before Tom walks 3 km to the market."),
    (6, ""),
]


def items(spark, rows=ITEMS):
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, slots string")


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id): r for r in D.contaminated(docs, items(spark)).collect()}


def test_verbatim_and_changed_questions(spark):
    rng = random.Random(2)
    texts = [
        prose(rng, 60) + "\n" + ITEMS[0][1] + "\n" + prose(rng, 60),
        ITEMS[0][1].replace("Tom", "Bob").replace("Anna", "Mary").replace("12", "40").replace("5", "9").replace("3 km", "8 miles"),
        # Tom becomes Bob and then Carl: the slots contradict one another.
        "A farmer named Bob has 40 apples and gives 9 apples to Mary before Carl walks 8 miles to the market.",
        ITEMS[1][1].upper(),
        "the quick brown fox jumps over a hedge",
        prose(rng, 300),
        None,
        "",
        "short one",
        " ".join(ITEMS[1][1].split()[3:17]),
        ITEMS[1][1] + " " + ITEMS[1][1],
    ]
    got = found(spark, texts)
    assert set(got) == {(0, 1), (1, 1), (3, 2), (9, 2), (10, 2)}
    assert not got[0, 1].changed and got[1, 1].changed and got[1, 1].n_slots == 6


def brute(docs, rows):
    """Documents with 13 words of an item, or four fifths of a shorter one, on one diagonal of five-word windows; lower case, no slots."""
    out = set()
    for d, text in docs:
        w = [x.strip(".,").lower() for x in (text or "").split()]
        for i, t in rows:
            v = [x.strip(".,").lower() for x in (t or "").split()]
            for shift in range(-len(v), len(w)):
                places = {k + j for k in range(len(v) - 4) if 0 <= k + shift and w[k + shift : k + shift + 5] == v[k : k + 5] and len(w) >= k + shift + 5 for j in range(5)}
                if places and len(places) >= min(13, -(-len(v) * 4 // 5)):
                    out.add((d, i))
    return out


def test_brute_force_without_slots(spark):
    rng = random.Random(5)
    plain = [(i, prose(rng, n).lower().replace("one", "a").replace("two", "b").replace("three", "c").replace("first", "d").replace("day", "e")) for i, n in enumerate([8, 12, 15, 20, 40, 60])]
    docs = []
    for d in range(60):
        words = prose(rng, rng.randrange(5, 80)).lower().split()
        t = rng.choice(plain)[1].split()
        a, b = sorted(rng.sample(range(len(t) + 1), 2))
        cut = rng.randrange(len(words))
        docs.append((d, " ".join(words[:cut] + t[a:b] + words[cut:])))
    got = {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items(spark, plain)).collect()}
    want = brute(docs, plain)
    # Number words are slots there and words here; no other difference is allowed.
    assert got == want and want


def slow_readings(text):
    """(kinds, tokens) of each reading of a text: W words, S slots, N with names that begin sentences."""
    raw = [(t, re.sub(r"^[\W_]+|[\W_]+$", "", t) if t != "%" else t) for t in (text or "").split()]
    rows, first = [], True
    for t, bare in raw:
        low = bare.lower()
        number = low in D.NUMBER_WORDS or bool(re.fullmatch(r"[0-9][0-9.,:/]*[a-z%]{0,3}", low)) or ("-" in low and all(x in D.NUMBER_WORDS for x in low.split("-")))
        kind = "n" if number else "p" if len(bare) > 1 and bare[0].isupper() and not bare.isupper() else "w"
        if bare:
            rows.append((low, kind, first, not t.endswith(bare)))
        first = bool(re.search(r"[.!?:][\"')\]»”]*$", t))
    out = [("W", [("w", low, low) for low, *_ in rows])]
    for reading in "SN":
        kinds = ["w" if k == "p" and begins and reading == "S" else k for _, k, begins, _ in rows]
        kinds = ["u" if k == "w" and i and kinds[i - 1] == "n" and rows[i][0] in D.UNITS else k for i, k in enumerate(kinds)]
        merged = []
        for i, k in enumerate(kinds):
            if i and k in "np" and k == kinds[i - 1] and not rows[i - 1][3]:
                merged[-1][2] += " " + rows[i][0]
            else:
                merged.append([k, rows[i][0] if k == "w" else k, rows[i][0]])
        if reading == "S" or any(k == "p" and b for _, k, b, _ in rows):
            out.append(("S", [tuple(m) for m in merged]))
    return out


def slow(docs, rows):
    """(doc, item) pairs: every reading of a text against every reading of an item, on every diagonal."""
    out = set()
    for d, text in docs:
        for i, item in rows:
            for kind, x in slow_readings(text):
                for other, y in slow_readings(item):
                    for shift in range(-len(y), len(x)) if kind == other else ():
                        places, bound = set(), set()
                        for k in range(len(y) - 4):
                            a = k + shift
                            if a < 0 or a + 5 > len(x):
                                continue
                            mine, its = x[a : a + 5], y[k : k + 5]
                            if [m[:2] for m in mine] == [m[:2] for m in its] and (kind == "W" or sum(m[0] == "w" for m in its) >= 3):
                                places |= set(range(k, k + 5))
                                bound |= {(m[0], p[2], m[2]) for m, p in zip(mine, its) if m[0] != "w"}
                        one_way = len({b[:2] for b in bound}) == len(bound)
                        if places and one_way and len(places) >= min(13, -(-len(y) * 4 // 5)):
                            out.add((d, i))
    return out


def test_brute_force_with_slots(spark):
    rng = random.Random(12)
    names, numbers = ["Tom", "Anna", "Mary Ann", "Bob", "Carl Smith"], ["3", "12", "1 200", "twenty-four", "seven", "1,200", "5"]
    shapes = [
        "{a} has {x} apples and gives {y} apples to {b} before {a} walks {z} km to the market with the rest",
        "{a} has {x} pens. {b} buys {y} more. How many pens do {a} and {b} have now together?",
        "a box holds {x} red pens and {y} blue pens on the wide shelf near the door of the long room",
        "the old man walked along the river until it was dark and nobody had seen where he went that day",
    ]

    def made(shape, wrong=False):
        a, b = rng.sample(names, 2)
        text = shape.format(a=a, b=b, x=rng.choice(numbers), y=rng.choice(numbers), z=rng.choice(numbers))
        return text.replace(a, "Zoe", 1) if wrong else text

    rows = [(i, made(shapes[i % 4])) for i in range(8)]
    docs = [f"{prose(rng, rng.randrange(0, 12))} {made(rng.choice(shapes), rng.random() < 0.3)} {prose(rng, rng.randrange(0, 12))}" for _ in range(50)]
    docs += [t for _, t in rows]
    got = {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), items(spark, rows)).collect()}
    every = slow(list(enumerate(docs)), rows)
    # Of the items of one template, those that a document holds word for word are named, else the smallest.
    assert {d for d, _ in got} == {d for d, _ in every} and got <= every and len(got) >= 30
    assert all((len(docs) - len(rows) + k, min(j for j, u in rows if u == t)) in got for k, (_, t) in enumerate(rows))


def test_numbers_of_several_forms(spark):
    text = "Tom has {} apples in the garden and {} pears in the house by the road"
    rows = [(1, text.format(12, 5))]
    assert pairs_of(spark, rows, [text.format(*x) for x in ((4, 4), ("twenty-four", "1 200"), ("thirteen", "ninety"), ("1,200", "3.5"))]) == {(i, 1, True) for i in range(4)}


def test_edges(spark):
    docs = documents(spark, extra=True)
    assert table(D.contaminated(docs, items(spark))) == []
    assert D.clean(docs, items(spark)).columns == docs.columns and D.clean(docs, items(spark)).count() == docs.count()
    assert D.contaminated(docs.limit(0), items(spark)).count() == 0 and D.contaminated(docs, items(spark).limit(0)).count() == 0
    bad = spark.createDataFrame([(1, ITEMS[1][1]), (1, ITEMS[1][1]), (None, ITEMS[1][1]), (2, "fine")], "doc_id long, text string")
    assert table(D.contaminated(bad, items(spark)).select("doc_id", "item_id")) == [(1, 2)]
    assert sorted(map(str, (r.doc_id for r in D.clean(bad, items(spark)).collect()))) == ["2", "None"]


def pairs_of(spark, rows, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id, r.changed) for r in D.contaminated(docs, items(spark, rows)).collect()}


def test_items_of_one_template_keep_their_values(spark):
    text = "A box holds {} red pens and {} blue pens and a jar holds {} green pens in total today"
    rows = [(1, text.format(3, 4, 3)), (2, text.format(6, 7, 9)), (3, text.format(6, 7, 9))]
    got = pairs_of(spark, rows, [rows[1][1], text.format(8, 5, 2), text.format(8, 5, 8), rows[0][1] + ". " + rows[1][1]])
    assert got == {(0, 2, False), (1, 2, True), (2, 1, True), (3, 1, False), (3, 2, False)}


def test_one_edited_slot_leaves_the_verbatim_rest(spark):
    text = "There were 12 people at the long table in the garden when the rain began and after a while most of them went inside to wait until it stopped while the other 12 people stayed out there"
    pens = "A box holds 3 red pens and 4 blue pens on the wide shelf near the door of the room"
    got = pairs_of(spark, [(1, text), (2, pens)], [text.replace("other 12", "other 13"), pens.replace("3", "7").replace("4", "7")])
    assert got == {(0, 1, False), (1, 2, True)}


def test_names_that_begin_sentences_and_longer_values(spark):
    apples = "Sarah has 5 apples. Sarah buys 7 more. How many apples does Sarah have now?"
    bus = "On the bus home Tom counted 12 red cars and then saw that Tom had lost the small green ticket"
    rows = [(1, apples), (2, bus)]
    texts = [apples.replace("Sarah", "Maria").replace("5", "8").replace("7", "9"), apples.replace("Sarah", "Mary Ann"), bus.replace("Tom", "Mary Ann").replace("12", "two hundred")]
    assert pairs_of(spark, rows, texts) == {(0, 1, True), (1, 1, True), (2, 2, True)}


def test_items_with_few_words_proper(spark):
    rows = [(1, "12 + 7 = 19, 30 - 4 = 26, 8 * 9 = 72"), (2, "Paris Rome Berlin Madrid Vienna Oslo Lisbon"), (3, "1914 1918 1939 1945 1989")]
    texts = [f"and so it went on. {t} and this is all that was there" for _, t in rows]
    assert {(d, i) for d, i, _ in pairs_of(spark, rows, texts)} == {(0, 1), (1, 2), (2, 3)}
