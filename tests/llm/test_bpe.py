"""Encoding by tree concatenation against the library on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from seqloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "日", "本", "1", "23", "'", "'re", "'s", "!", "<|endoftext|>", "<|endo", "ftext|>", " ", "🙂", "\t", " \n", "ab" * 20, "x" * 50, "　", "ß", "(", ")...."]


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(open(PATH, encoding="utf-8").read())


@pytest.mark.parametrize("seed", range(4))
def test_joins_are_exact(coder, seed):
    rng = random.Random(seed)
    for _ in range(250):
        some = rng.sample(BITS, rng.choice([1, 2, 3, len(BITS)]))
        text = "".join(rng.choice(some) for _ in range(rng.randint(2, 120)))
        pieces = [coder.piece(text[a:b], a) for a, b in bpe.leaves(len(text), rng.choice([5, 9, 17, 40]))]
        assert bpe.concatenated(text, pieces, coder).ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_packed(coder):
    for text in ("", "a", "x" * 300 + " é日🙂 <|endoftext|>", "one two"):
        p = coder.piece(text, 70)
        q = bpe.Piece.unpacked(p.packed(), 70)
        assert all(np.array_equal(getattr(p, k), getattr(q, k)) for k in ("ids", "counts", "sizes", "start"))


def test_split_is_the_library_s(coder):
    """Every character that is not set aside, next to letters, digits, marks and blanks."""
    cs = [chr(c) for c in range(0x558) if not bpe.ODD.match(chr(c))]
    assert len(cs) == 0x558 - 10
    for c in cs:
        text = f"a{c}1{c}!{c} {c}{c}\n{c}'s{c}  {c}"
        assert [m.span() for m in bpe.SPLIT.finditer(text)] == [x for _, x in coder.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_tokens_have_their_bytes(coder):
    assert coder.bytes and set(coder.table[:256]) <= {bytes([b]) for b in range(256)}
    for text in ("plain", "ünï 日本 🙂 <|endoftext|>", "\x1c²"):
        ids = coder.tokenizer.encode(text).ids
        assert coder.decode(ids) == text == coder.tokenizer.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == ids
    half = coder.tokenizer.encode("日").ids[:1]
    assert coder.decode(half) == coder.tokenizer.decode(half, skip_special_tokens=False)


def test_leaves_cover():
    for n in (0, 1, 7, 100):
        at = bpe.leaves(n, 3)
        assert at[0][0] == 0 and at[-1][1] == n and all(x[1] == y[0] for x, y in zip(at, at[1:])) and all(b - a <= 3 for a, b in at)


def test_encode_decode(spark, coder):
    rng = random.Random(9)
    texts = [None, "", "one", "a <|endoftext|> b", "x" * 5000, "acgt" * 999, "".join(rng.choice("acgt ") for _ in range(4000)), "tie", "tie", "日本" * 900]
    rows = [(i if i != 3 else None, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.ids_sha256): r for r in bpe.encode_decode(df, PATH, leaf_chars=200).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        ids = coder.tokenizer.encode(t or "", add_special_tokens=False).ids
        r = got[i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()]
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(df.where("doc_id < 0"), PATH).count() == 0


def test_other_vocabularies_are_encoded_whole(spark):
    """A tokenizer that changes the text, or has unknown tokens, gives the library's result on long texts too."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library = bpe.Coder(open(path, encoding="utf-8").read()).tokenizer
    texts = [None, "", "Some Words, of a text. " * 200, "日本 é ÀÉ  two  blanks\n" * 100, "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_decode(df, path, leaf_chars=300).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
