"""Alignment against brute force with the libraries of both files."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusmill.llm import align
from corpusmill.llm.heap_bpe import byte_characters

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TOK = Tokenizer.from_file(A)
TOK.encode_special_tokens = True
SP = sentencepiece.SentencePieceProcessor(model_file=B)
CHARS = {c: b for b, c in enumerate(byte_characters())}
TEXTS = [
    "The theatre, it's there; naïve Ünïcödé words", "", " ", "  leading and trailing  ", "tabs\tand\n\n new  \n lines \r\n x", "日本語とemoji 🙂🙂 mix", "a▁b keeps no bytes", "<|endoftext|> and <s> </s> <0x41> <unk>",
    "x" * 3000, "word " * 2000, "\x00 \x1c \x85   \xa0 nbsp", "the the the cat", "the cat", "the cat", "don't can't we'll 1234 56.78 %% ### ...", "éàü é combining", "end ", "a", "▁", "tail　 wide   spaces    here",
]


def spans(lengths):
    at, out = 0, []
    for n in lengths:
        out.append((at, at + n))
        at += n
    return out


def tokens(text):
    """Ids and byte ranges of both, or nothing."""
    if not text:
        return [], [], [], []
    a = TOK.encode(" " + text, add_special_tokens=False).ids
    b = SP.encode(text)
    raw_a = [bytes(CHARS[c] for c in TOK.id_to_token(i)) for i in a]
    raw_b = [bytes([int(SP.id_to_piece(i)[3:-1], 16)]) if SP.is_byte(i) else SP.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return [], [], [], []
    return a, b, spans(map(len, raw_a)), spans(map(len, raw_b))


def groups(a, b, sa, sb):
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    out, low = [], 0
    for c in cuts:
        out.append(([i for i, (x, y) in zip(a, sa, strict=True) if low < y <= c], [i for i, (x, y) in zip(b, sb, strict=True) if low < y <= c]))
        low = c
    return out


def links(a, b, sa, sb, rule):
    ok = (lambda p, q: p[1] == q[1]) if rule == "ends" else (lambda p, q: max(p[0], q[0]) < min(p[1], q[1]))
    return [(i, j) for i, p in zip(a, sa, strict=True) for j, q in zip(b, sb, strict=True) if ok(p, q)]


def brute(rows, rule="ends"):
    all_tokens = [tokens(t) for _, t in rows]
    all_links = [links(*t, rule) for t in all_tokens]
    count = Counter(x for each in all_links for x in each)
    most = {}
    for (_, j), n in count.items():
        most[j] = max(n, most.get(j, 0))
    out = []
    for (i, _), t, own in zip(rows, all_tokens, all_links, strict=True):
        g = groups(*t)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((i, len(t[0]), len(t[1]), len(g), len(own), sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str), count, most


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(TEXTS), (None, None), (3, "the cat"), (3, "the cat"), (100, None)]


@pytest.mark.parametrize("rule", ["ends", "overlap"])
@pytest.mark.parametrize("block", [1, 1 << 25])
def test_report(spark, rows, rule, block, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_BYTES", block)
    if rule == "overlap":
        rows = [r for r in rows if len(r[1] or "") < 2500]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_a string")
    want, count, most = brute(rows, rule)
    got = align.alignment_report(df, A, B, rule=rule)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    pairs = {(r.a, r.b): (r["count"], r.best) for r in align.token_pairs(df, A, B, rule=rule).collect()}
    assert pairs == {k: (n, n == most[k[1]]) for k, n in count.items()}


def test_weight_by_documents(spark):
    df = spark.createDataFrame([(1, "cat cat cat"), (2, "cat"), (3, "dog")], "doc_id long, text string")
    pairs = {(r.a, r.b): r["count"] for r in align.token_pairs(df, A, B, weigh="docs").collect()}
    cat, dog = ((TOK.encode(f" {w}").ids[0], SP.encode(w)[0]) for w in ("cat", "dog"))
    assert pairs == {cat: 2, dog: 1}
    with pytest.raises(ValueError):
        align.token_pairs(df, A, B, weigh="rows")


def test_documents_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 4000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, align.alignment_report(df, A, B).collect()), key=str) == brute(rows)[0]


def test_cache_and_stretches(spark, monkeypatch):
    models, _ = align._shared(spark.range(1), A, B)
    monkeypatch.setattr(align, "CACHE", 3)
    one = align.Aligner(1, models)
    whole = align.Aligner(1, models)
    whole.parted = False
    for t in TEXTS:
        text = lambda x, t=t: [b";".join(x.keys[i] for i in g) for g in x.groups([t])]
        assert text(one) == text(whole)


def test_groups_begin_anew(spark, rows, monkeypatch):
    monkeypatch.setattr(align, "GROUPS", 5)
    monkeypatch.setattr(align, "BLOCK_BYTES", 1)
    monkeypatch.setattr(align, "STEP", 10)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, align.alignment_report(df, A, B).collect()), key=str) == brute(rows)[0]


def test_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "some text", "v", "w"), (2, None, "v", "w")], "doc_id long, text string, `a.b` string, `x``y` string")
    out = align.align_tokens(df, A, B)
    assert out.columns == ["doc_id", "text", "a.b", "x`y", "groups"]
    a, b, sa, sb = tokens("some text")
    want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups(a, b, sa, sb))
    assert [tuple(r) for r in out.collect()] == [(1, "some text", "v", "w", want), (2, None, "v", "w", "")]
    assert align.align_tokens(df.limit(0), A, B).count() == align.alignment_report(df.limit(0), A, B).count() == align.token_pairs(df.limit(0), A, B).count() == 0
