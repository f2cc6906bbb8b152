import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.byte_bpe import Codec, bpe_decode, bpe_digest, bpe_encode, read_ranks, serialise

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = read_ranks(PATH)
REF = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = Codec(serialise(RANKS), P.PATTERN)
TEXTS = ["", " ", "Hello world, it's 2024!", "naïve Ünï cödé\n\n  x", "a" * 3000, "🙂🙂 日本語 \x00\x1c\x85 ▁", "  \n\t mixed   \r\n", "The the THE " * 500, "<|endoftext|>"]


@pytest.mark.parametrize("text", TEXTS)
def test_known_texts(text):
    ids = CODEC.encode(text).tolist()
    assert ids == REF.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    ids = CODEC.encode(text).tolist()
    assert ids == REF.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


def test_every_entry_of_the_vocabulary():
    assert all(CODEC.pre_token(p) == (r,) for p, r in RANKS.items())


def test_long_text_in_parts():
    text = "some words, and more of them. " * 30000
    assert CODEC.encode(text).tolist() == REF.encode_ordinary(text)


def test_tables(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, None), (3, "dup", "y"), (3, "dup", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe_digest(df, PATH).collect()
    want = []
    for i, t, _ in rows:
        ids = REF.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe_digest(df.limit(0), PATH).count() == 0
    back = bpe_decode(bpe_encode(df, PATH), PATH)
    assert back.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())


def test_bad_vocabulary():
    with pytest.raises(ValueError):
        serialise({b"a": 0})
    with pytest.raises(ValueError):
        serialise({bytes([b]): b + 1 for b in range(256)})
