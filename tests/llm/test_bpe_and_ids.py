import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from seqloom.llm import op02_bpe, op05_ids, queries, rangecoder, wordbpe
from seqloom.llm.rangecoder import BLOCK, Corrupt, pack_block, unpack_block
from seqloom.llm.wordbpe import WordBpe, tokenizer_path

from .data import documents, prose, rows, table

PATH = tokenizer_path("word_bpe_49k.json")
KINDS = ["abcdefghij", "theandingion", "aA1!'", "éèàñß", "'sstt'", "0123456789", "!?.,;'\"-", "😀漢字あ한글", "ẹ́ŉİΣ　\u0085\x1c"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_text(rng, n):
    out = ""
    while len(out) < n:
        kind = rng.choice(KINDS)
        out += "".join(rng.choice(kind) for _ in range(rng.choice([3, 30, 200])))
        out += rng.choice(["", "", " ", "\n", "<|startoftext|>", "<|endoftext|>"]) if rng.random() < 0.2 else ""
    return out


def test_exact_on_random_text(library):
    rng, mine = random.Random(7), WordBpe(PATH)
    for n in [0, 1, 5, 50, 500, 3000] * 25:
        text = random_text(rng, n) if n else ""
        want = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text.encode()).tolist() == want
        assert mine.tree(text or "a", rng.choice([40, 100, 700])).ids.tolist() == (want if text else library.encode("a", add_special_tokens=False).ids)
        assert mine.decode(want) == library.decode(want, skip_special_tokens=False)


def test_long_unsplit_text(library):
    rng, mine = random.Random(8), WordBpe(PATH)
    for text in ("x" * 50_000, "".join(rng.choice("abcdefghilmnorst") for _ in range(60_000)), "!'s" * 9_000, "é" * 20_001, "12" * 9_999):
        assert mine.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_texts_go_through_the_tree(library):
    rng, mine = random.Random(9), WordBpe(PATH)
    plain = prose(rng, 9000)
    for text in (plain, plain.replace("the", "thé").replace(" and", " ＡＮＤ"), " ".join(random_text(rng, 200) for _ in range(200)), "don't we'll " * 3000, "a" * 4000 + " " + "!?" * 2000 + " b" * 4000, " \n" * 20_000, "x, " * 9000 + "<|endoftext|>" + "y" * 2000):
        before = mine.joins
        want = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text.encode()).tolist() == want
        assert mine.joins - before >= len(text.encode()) // wordbpe.TEXT_LEAF - 1
        for leaf in (30, 100, 777):
            assert b"".join(mine.text_tree(text.encode(), leaf)) == np.array(want, np.int32).tobytes()


def test_what_the_query_encodes_takes_the_tree(spark, tmp_path):
    """The encoder of the registered query joins leaves for each long text; the count is by the worker's own encoder."""
    text = prose(random.Random(10), 9000)
    mine = WordBpe(PATH)
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_bpe_round_trip(spark, str(tmp_path)).collect()}
    assert got[1].n_joins == -(-len(text) // wordbpe.TEXT_LEAF) - 1 and got[2].n_joins == 0
    assert got[1].n_tokens == len(mine.encode(text.encode()))


def test_encode_decode(spark, library):
    want = []
    for i, text, *_ in rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    want += [want[4], want[4], want[47]]
    df = documents(spark, extra=True)
    assert table(op02_bpe.digests(op02_bpe.encode_decode(df)).drop("n_joins")) == sorted(want, key=repr)
    assert op02_bpe.encode_decode(df.limit(0)).count() == 0


def test_blocks():
    rng = np.random.default_rng(3)
    for n in (1, 2, 63, 64, 1000, 70_001):
        for ids in (rng.integers(0, 49408, n), np.zeros(n, int), rng.zipf(1.3, n) % 49408, np.full(n, 49407)):
            block = pack_block(ids, 49408)
            back, end = unpack_block(block)
            assert (back == ids).all() and end == len(block)
    # A repeated cycle takes less than half of the 16 bits of a plain id; lanes of 64 ids spend much of it on learning.
    assert len(pack_block(np.tile(np.arange(40), 3000), 49408)) < 120_000
    block = bytearray(pack_block(rng.integers(0, 49408, 5000), 49408))
    for at in (0, 5, 30, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(Corrupt):
            unpack_block(bytes(bad))
    with pytest.raises(Corrupt):
        unpack_block(bytes(block[:-3]))
    assert BLOCK >= 1 << 16


def bits(ids):
    block = pack_block(ids, 49408)
    back, end = unpack_block(block)
    assert (back == ids).all() and end == len(block)
    return 8 * len(block) / len(ids)


def test_contexts_are_mixed():
    rng, n = np.random.default_rng(4), 1 << 19
    symbols = rng.permutation(49408)[:500]
    assert bits(np.tile(rng.permutation(symbols)[:300], n // 300 + 1)[:n]) < 0.5
    # Each of 500 ids has two equally likely successors: one bit an id.
    after, side, at = rng.integers(0, 500, (500, 2)), rng.integers(0, 2, n), [0]
    for s in side[1:].tolist():
        at.append(after[at[-1], s])
    assert bits(symbols[np.array(at)]) < 1.3
    # Where the ids before tell nothing, the contexts cost little.
    p = 1 / np.arange(1, 501)
    p /= p.sum()
    entropy = -(p * np.log2(p)).sum()
    assert entropy < bits(symbols[rng.choice(500, n, p=p)]) < 1.03 * entropy
    # Two ids before tell what one does not: every third is the sum of them, the others cost what order 0 gives them.
    pairs = rng.integers(0, 40, (n // 3, 2))
    assert bits(symbols[(np.column_stack([pairs, pairs.sum(axis=1) % 40]) + [0, 40, 80]).ravel()]) < (2 * np.log2(120)) / 3 * 1.06


def test_weights_are_learnt(monkeypatch):
    ids = np.tile(np.random.default_rng(5).permutation(49408)[:300], 400)
    learnt, third = bits(ids), np.int32(rangecoder._MIX // 3)
    monkeypatch.setattr(rangecoder._Model, "_weights", lambda self: vars(self).update(w2=np.full(256, third), w1=np.full(256, third), w0=np.full(256, rangecoder._MIX - 2 * third)))
    assert bits(ids) > learnt + 0.3


def test_files(spark, library, tmp_path):
    df = documents(spark, extra=True)
    want, start = [], 0
    docs = sorted([r[:2] for r in rows()] + [rows()[4][:2]] * 2 + [rows()[47][:2]])
    texts = {}
    for i, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        texts[i] = ids
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    files = op05_ids.write(df, f"file://{tmp_path}/a", roll=5000)
    assert files.count() > 3
    found = op05_ids.read(files).collect()
    assert sorted(tuple(r)[:4] for r in found) == want and all(r.ids == texts[r.doc_id] for r in found)
    assert op05_ids.round_trip(df.limit(0)).count() == 0
    none = spark.createDataFrame([(None, "the"), (0, "of")], "doc_id long, text string")
    assert sorted((r.start, r.doc_id) for r in op05_ids.round_trip(none).collect()) == [(0, None), (2, 0)]


def test_texts_are_encoded_together_as_the_library_does(library):
    """Each word is looked up once, whatever texts it is in; letters whose lower case is no simple Latin letter stay within their words."""
    odd = [None, "", "  ", " a\x0bb\x0c \tc\r\n", "Ɓa xƁa Ⱥ", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "İstanbul é", "日本語 text 한국", "é É", "x" * 5000 + " y", "don't DON'T 's,'s"]
    odd += ["a b c\u0085d\x1ce", "\x7f \x00 z", "1234 ½ ²³", "naïve Straße ǅ ŉ", "tail\n", prose(random.Random(1), 3000), "a, b. A, a b"]
    mine, seen = WordBpe(PATH), []
    pieces, mine.pieces.make = mine.pieces.make, lambda p: seen.append(p) or pieces(p)
    mine.pieces.most = 20  # words come and go
    for more in ((1,), (), (1, 2)):
        for some in (*([x] for x in odd), odd, odd[:9] * 2, odd[5:]):
            got = mine.encode_all(pa.array([(x or "").encode() for x in some], pa.binary()), more)
            assert [g.tolist() for g in got] == [[*library.encode(x or "", add_special_tokens=False).ids, *more] for x in some]
            assert [g.tolist() for g in got] == [mine.encode((x or "").encode(), more).tolist() for x in some]
    mine.pieces.most = 10**6
    seen.clear()
    mine.encode_all(pa.array([b"zyzzyva quux", b"quux, zyzzyva"] * 50, pa.binary()))
    assert len(seen) == len(set(seen)) <= 4
    assert mine.encode_all(pa.array([], pa.binary())) == []
