"""The queue of merges against the library of the tokenizer file, and exact round trips."""

import hashlib
import sys

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusmill.llm.heap_bpe import HeapCodec, heap_decode, heap_digest, heap_encode, read_vocabulary

PATH = P.path("byte_bpe_50k.json")
REF = Tokenizer.from_file(PATH)
VOCABULARY = read_vocabulary(PATH)
CODEC, PLAIN = HeapCodec(VOCABULARY), HeapCodec(VOCABULARY, special=False)
TEXTS = ["", " ", "Hello world, it's 2024!", "naïve Ünï cödé\n\n  x", "a" * 5000, "🙂🙂 日本語 \x00\x1c\x85 ▁", "  \n\t mixed   \r\n", "The the THE " * 500, "<|endoftext|>", "a <|endoftext|>  b<|endoftext|><|endoftext|>\n", "<|endoftext|", "abcdefgh" * 40]


def reference(text):
    return REF.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_known_texts(text):
    ids = CODEC.encode(text).tolist()
    assert ids == reference(text)
    assert CODEC.decode(ids).decode() == REF.decode(ids, skip_special_tokens=False) == text


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    ids = CODEC.encode(text).tolist()
    assert ids == reference(text) and CODEC.decode(ids) == text.encode()


@given(st.lists(st.integers(0, 50256), max_size=30))
@settings(max_examples=200, deadline=None)
def test_any_ids(ids):
    assert CODEC.decode(ids).decode() == REF.decode(ids, skip_special_tokens=False)


def test_every_character():
    """Classes of characters are those of the library, one by one between letters, digits, marks and spaces."""
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 4096):
        text = "".join(f"a{c}1{c}!{c} {c}{c}" for c in chars[at : at + 4096])
        assert CODEC.encode(text).tolist() == reference(text), hex(ord(chars[at]))


def test_special_tokens_as_text():
    ref = Tokenizer.from_file(PATH)
    ref.encode_special_tokens = True
    for text in TEXTS:
        assert PLAIN.encode(text).tolist() == ref.encode(text, add_special_tokens=False).ids


def test_long_texts():
    for text in ("some words, and more of them. " * 30_000, "x" * 300_000, "ab" * 10_000 + " " * 20_000):
        ids = CODEC.encode(text).tolist()
        assert ids == reference(text) and CODEC.decode(ids) == text.encode()


def test_generations_of_the_cache(monkeypatch):
    monkeypatch.setattr("corpusmill.llm.heap_bpe.CACHE", 10)
    codec = HeapCodec(VOCABULARY)
    text = " ".join(f"word{i % 37} {i}" for i in range(500))
    assert codec.encode(text).tolist() == reference(text)
    assert len(codec.known) <= 10 and len(codec.older) <= 10


def test_tables(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, None), (3, "dup", "y"), (3, "dup", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    want = []
    for i, t, _ in rows:
        ids = reference(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, heap_digest(df, PATH).collect()), key=str) == sorted(want, key=str)
    assert heap_digest(df.limit(0), PATH).count() == 0
    back = heap_decode(heap_encode(df, PATH), PATH)
    assert back.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert all(r.decoded == (r.text or "") and r.ids == reference(r.text or "") for r in back.collect())
    assert heap_encode(df.limit(0), PATH).count() == 0
    assert heap_decode(df.selectExpr("doc_id", "cast(null as array<int>) as ids").limit(2), PATH).where("decoded is null").count() == 2
    with pytest.raises(ValueError):
        heap_decode(back, PATH)


def test_odd_columns(spark):
    df = spark.createDataFrame([(1, "some text", "v", "w")], "doc_id long, text string, `a.b` string, `x``y` string")
    out = heap_decode(heap_encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "a.b", "x`y", "ids", "decoded"]
    assert tuple(out.first()) == (1, "some text", "v", "w", reference("some text"), "some text")


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        read_vocabulary(P.path("word_bpe_49k.json"))
