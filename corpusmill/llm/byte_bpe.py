"""Byte-level BPE by a sentencepiece model that is serialised from a rank file.

Every byte is written as one character outside all scripts of the pattern's
concern; a vocabulary entry becomes the string of its bytes' characters with
its negative rank as score, under identity normalisation. Sentencepiece then
joins the pair of the best score, which is the pair of the lowest rank. Texts
are cut into pre-tokens first, and each is encoded by itself.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import itertools
import struct
from array import array

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import extend, numbered, quoted

#: The character of byte 0.
FIRST = 0x100
_CHARS = "".join(chr(FIRST + b) for b in range(256))
#: Pre-tokens of a generation that a task holds with their ids.
CACHE = 180_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def to_text(piece: bytes) -> str:
    return codecs.charmap_decode(piece, "strict", _CHARS)[0]


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ``ModelProto`` whose ids are the ranks; the last id is the unknown piece."""
    by_rank = {r: p for p, r in ranks.items()}
    if sorted(by_rank) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte needs a rank")
    # ModelProto: pieces 1 (piece 1, score 2, type 3: normal 1, unknown 2), trainer 2, normaliser 3
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind))
    body = [piece(to_text(by_rank[r]), -float(r), 1) for r in range(len(ranks))]
    body.append(piece("<unk>", 0.0, 2))
    # TrainerSpec: model type 3 (BPE: 2), vocabulary size 4, ids of unk, bos, eos, pad 40-43
    off = _varint((1 << 64) - 1)
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + b"".join(_varint(k << 3) + off for k in (41, 42, 43))
    # NormalizerSpec: name 1, dummy prefix 3, removal of extra white space 4, escaping 5
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(body) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary; made once per Python worker."""

    _made: dict[tuple, Codec] = {}

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size() - 1)]
        self.pieces = [bytes(ord(c) - FIRST for c in p) for p in pieces]
        self.whole = {p: (i,) for i, p in enumerate(self.pieces)}
        self.digits = [str(i).encode() for i in range(len(self.pieces))]
        #: ids of the pre-tokens met last, as bytes of int32, in two generations
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, model: bytes, pattern: str) -> Codec:
        key = (hash(model), pattern)
        if key not in cls._made:
            cls._made[key] = cls(model, pattern)
        return cls._made[key]

    def forget(self) -> None:
        """Let go of the pre-tokens that a task has met."""
        self.known, self.older = {}, {}

    def pre_token(self, token: bytes) -> tuple[int, ...]:
        return self.whole.get(token) or tuple(self.sp.encode(to_text(token)))

    def _learn(self, tokens: set[str]) -> None:
        if len(self.known) + len(tokens) > CACHE:
            self.older, self.known = self.known, {}
        new = []
        for t in tokens:
            if (ids := self.older.get(t)) is not None:
                self.known[t] = ids
            else:
                new.append(t)
        raw = [t.encode("utf-8", "replace") for t in new]
        for t, b, ids in zip(new, raw, self.sp.encode([to_text(b) for b in raw], num_threads=1), strict=True):
            self.known[t] = array('i', self.whole.get(b) or ids).tobytes()

    def ids(self, tokens: list[str]) -> bytes:
        """Ids of pre-tokens, one after the other, as bytes of int32."""
        parts = list(map(self.known.get, tokens))
        try:
            return b"".join(parts)
        except TypeError:  # some are not known yet
            missing = [i for i, p in enumerate(parts) if p is None]
            self._learn({tokens[i] for i in missing})
            for i in missing:
                parts[i] = self.known[tokens[i]]
            return b"".join(parts)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= 1 << 18:
            return np.frombuffer(self.ids(self.find.findall(text)), dtype=np.int32)
        out, found = [], (m.group() for m in self.find.finditer(text))
        while part := list(itertools.islice(found, 1 << 16)):
            out.append(self.ids(part))
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: list[int]) -> bytes:
        if ids and not 0 <= min(ids) <= max(ids) < len(self.pieces):
            raise ValueError("an id is outside the vocabulary")
        return b"".join(map(self.pieces.__getitem__, ids))


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str | None = None, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` as ``array<int>``.

    The rank file has a fixed size (some MB) and is read on the driver once; its
    model goes out as a broadcast. A null or empty text has no ids. Rows are
    encoded where they lie, nothing is shuffled; a column named ``into`` must
    not exist. An empty table gives an empty result.
    """
    import pyarrow as pa

    model = docs.sparkSession.sparkContext.broadcast(serialise(read_ranks(ranks_path)))
    pattern = pattern or _pattern()

    def run(texts):
        codec = Codec.of(model.value, pattern)
        ids = [codec.encode(t.decode("utf-8", "replace")) if t else np.zeros(0, np.int32) for t in texts]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
        flat = np.concatenate([*ids, np.zeros(0, np.int32)])
        return [pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(pa.list_(pa.int32()))]

    return extend(docs, run, [(into, "array<int>")], text, done=lambda: Codec.of(model.value, pattern).forget())


def bpe_decode(df: DataFrame, ranks_path: str, pattern: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the bytes of the token ids as ``binary``; null ids give null.

    Rows are decoded where they lie, repeated ones too; an empty table gives an
    empty result. A column named ``into`` must not exist.
    """
    import pyarrow as pa

    if into.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {into}")

    model = df.sparkSession.sparkContext.broadcast(serialise(read_ranks(ranks_path)))
    pattern = pattern or _pattern()
    names, at = [*df.columns, into], df.columns.index(ids)
    schema = ", ".join([f"{quoted(f.name)[0]} {f.dataType.simpleString()}" for f in df.schema.fields] + [f"{quoted(into)[0]} binary"])

    def run(it):
        codec = Codec.of(model.value, pattern)
        for batch in it:
            col = batch.column(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else codec.decode(x) for x in (v.as_py() for v in col)] if col.null_count else _decode_all(codec, col), pa.binary())], names)

    return numbered(df).mapInArrow(run, schema)


def _decode_all(codec: Codec, col) -> list[bytes]:
    flat, ends = np.asarray(col.flatten()), (np.asarray(col.offsets) - col.offsets[0].as_py()).tolist()
    return [codec.decode(flat[a:b].tolist()) for a, b in itertools.pairwise(ends)]


def sha256_of_ids(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256)


def bpe_digest(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoding and decoding each text.

    Ids are encoded, decoded and hashed in one pass, without leaving the worker.
    A null or empty text has no ids, and the hashes of nothing. Texts of any
    length are taken whole. Repeated rows stay, a null ``doc_id`` passes, further
    columns are ignored. An empty table gives an empty result.
    """
    import pyarrow as pa

    model = docs.sparkSession.sparkContext.broadcast(serialise(read_ranks(ranks_path)))
    pattern = _pattern()

    def run(texts):
        codec = Codec.of(model.value, pattern)
        n, of_ids, of_text = [], [], []
        for t in texts:
            ids = codec.encode(t.decode("utf-8", "replace")).tolist() if t else []
            n.append(len(ids))
            of_ids.append(hashlib.sha256(b" ".join(map(codec.digits.__getitem__, ids))).hexdigest())
            of_text.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]

    fields = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return extend(docs.select("doc_id", "text"), run, fields, keep=["doc_id"], done=lambda: Codec.of(model.value, pattern).forget())
