"""BPE by a priority queue of merge ranks, as a tokenizer file in JSON describes it.

A pre-token is a doubly linked list of symbols. The queue holds the rank and the
place of every pair that can be merged; the least is taken first, its pair joined
in place, and the pairs that arise at its two sides are queued. Entries whose pair
is no longer there are stale and skipped. Decoding concatenates the strings of the
vocabulary and reads their characters as bytes.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from array import array
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from .shared import extend, numbered, quoted

#: The pattern that a byte-level pre-tokenizer cuts texts by (a fixed value of that format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of a generation that a worker holds with their ids, and the longest of them.
CACHE, LONGEST = 150_000, 64


def byte_characters() -> list[str]:
    """The character of each byte: itself where it is printable Latin-1, otherwise the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = itertools.count(0x100)
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Vocabulary(NamedTuple):
    """``entries`` by id (None where there is none), ``merges`` as ``(left, right, joined)`` ids by rank, ``added`` tokens' ids."""

    entries: list[str | None]
    merges: list[tuple[int, int, int]]
    added: dict[str, int]


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a tokenizer file; a file that asks for anything but plain byte-level BPE is refused."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    model, pre = t["model"], t.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    cut = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    decodes = (t.get("decoder") or {}).get("type") == "ByteLevel"
    added = t.get("added_tokens") or []
    if not (plain and cut and decodes) or t.get("normalizer") or any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only plain byte-level BPE is supported")
    vocab = model["vocab"]
    if any(c not in vocab for c in byte_characters()):
        raise ValueError("every single byte needs an entry")
    entries: list[str | None] = [None] * (max([*vocab.values(), *(a["id"] for a in added)]) + 1)
    for s, i in [*vocab.items(), *((a["content"], a["id"]) for a in added)]:
        entries[i] = s
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return Vocabulary(entries, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], {a["content"]: a["id"] for a in added})


class HeapCodec:
    """Encoder and decoder of one vocabulary; made once per Python worker."""

    _made: dict[tuple, HeapCodec] = {}

    def __init__(self, vocabulary: Vocabulary, special: bool = True):
        import regex

        chars = byte_characters()
        by_char = {c: b for b, c in enumerate(chars)}
        ids = {e: i for i, e in enumerate(vocabulary.entries) if e is not None}
        self.first = [ids[c] for c in chars]
        self.width = len(vocabulary.entries)
        #: of a pair of ids, as one number: the rank of its merge; of a rank: the joined id
        self.rank = {a * self.width + b: r for r, (a, b, _) in reversed([*enumerate(vocabulary.merges)])}
        self.joined = [c for _, _, c in vocabulary.merges]
        self.raw = [b"" if e is None else bytes(by_char[c] for c in e) if all(c in by_char for c in e) else e.encode() for e in vocabulary.entries]
        self.digits = [str(i).encode() for i in range(self.width)]
        self.find = regex.compile(PATTERN)
        self.added = vocabulary.added if special else {}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        #: ids of the pre-tokens met last, as bytes of int32, in two generations
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, key: tuple, vocabulary, special: bool = True) -> HeapCodec:
        """The codec of ``key``; ``vocabulary`` is a broadcast, read only where the worker has none yet."""
        if (key, special) not in cls._made:
            cls._made[key, special] = cls(vocabulary.value, special)
        return cls._made[key, special]

    def merge(self, token: bytes) -> list[int]:
        """The ids of one pre-token."""
        s = [self.first[b] for b in token]
        n, width, rank, joined = len(s), self.width, self.rank.get, self.joined
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        queue = [r * n + i for i in range(n - 1) if (r := rank(s[i] * width + s[i + 1])) is not None]
        heapify(queue)
        while queue:
            r, i = divmod(heappop(queue), n)
            j = after[i]
            if s[i] < 0 or j == n or rank(s[i] * width + s[j]) != r:
                continue  # stale: one of the pair was merged meanwhile
            s[i], s[j] = joined[r], -1
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := rank(s[i] * width + s[k])) is not None:
                    heappush(queue, r * n + i)
            if h >= 0 and (r := rank(s[h] * width + s[i])) is not None:
                heappush(queue, r * n + h)
        return [x for x in s if x >= 0]

    def _of(self, token: str) -> bytes:
        if (ids := self.older.get(token)) is None:
            ids = array("i", self.merge(token.encode("utf-8", "replace"))).tobytes()
        if len(token) <= LONGEST:
            if len(self.known) >= CACHE:
                self.older, self.known = self.known, {}
            self.known[token] = ids
        return ids

    def plain(self, text: str) -> list[bytes]:
        """Ids of each pre-token of a text without added tokens, as bytes of int32."""
        if len(text) <= 1 << 18:
            known = self.known.get
            return [known(t) or self._of(t) for t in self.find.findall(text)]
        out, found = [], (m.group() for m in self.find.finditer(text))
        while part := list(itertools.islice(found, 1 << 16)):
            out.append(b"".join(self.known.get(t) or self._of(t) for t in part))
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids as int32; added tokens that stand in the text are their own ids where ``special`` is set."""
        if self.cut is None or not any(s in text for s in self.added):
            return np.frombuffer(b"".join(self.plain(text)), dtype=np.int32)
        parts: list[bytes] = []
        for part in self.cut.split(text):
            parts += [array("i", [self.added[part]]).tobytes()] if part in self.added else self.plain(part)
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids: list[int]) -> bytes:
        """The strings of the ids, read as bytes; what is no UTF-8 becomes U+FFFD; ids without an entry are left out."""
        if ids and not 0 <= min(ids) <= max(ids) < self.width:
            ids = [i for i in ids if 0 <= i < self.width]
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").encode()


def _shared(df: DataFrame, path: str):
    """The vocabulary as a broadcast (its size is that of the file, some MB), and a key of it for the workers."""
    vocabulary = read_vocabulary(path)
    return df.sparkSession.sparkContext.broadcast(vocabulary), (len(vocabulary.entries), hash(tuple(vocabulary.merges)))


def heap_encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids", special: bool = True) -> DataFrame:
    """``docs`` with the token ids of ``text`` as ``array<int>``.

    A null or empty text has no ids; texts of any length are taken whole. With
    ``special``, added tokens in a text are their own ids, otherwise ordinary
    text. Rows are encoded where they lie, repeated ones too; other columns pass,
    but none may be named ``into``. An empty table gives an empty result.
    """
    import pyarrow as pa

    vocabulary, key = _shared(docs, path)

    def run(texts):
        codec = HeapCodec.of(key, vocabulary, special)
        ids = [codec.encode(t.decode("utf-8", "replace")) if t else np.zeros(0, np.int32) for t in texts]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
        flat = np.concatenate([*ids, np.zeros(0, np.int32)])
        return [pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(pa.list_(pa.int32()))]

    return extend(docs, run, [(into, "array<int>")], text)


def heap_decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the text of the token ids as ``string``; null ids give null, none the empty text.

    Rows are decoded where they lie; other columns pass, but none may be named
    ``into``. An empty table gives an empty result.
    """
    import pyarrow as pa

    if into.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {into}")
    vocabulary, key = _shared(df, path)
    names, at = [*df.columns, into], df.columns.index(ids)
    schema = ", ".join([f"{quoted(f.name)[0]} {f.dataType.simpleString()}" for f in df.schema.fields] + [f"{quoted(into)[0]} string"])

    def run(it):
        codec = HeapCodec.of(key, vocabulary)
        for batch in it:
            texts = [None if x is None else codec.decode([i for i in x if i is not None]).decode() for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return numbered(df).mapInArrow(run, schema)


def heap_digest(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoding and decoding each text.

    Ids are joined by commas before hashing. A null or empty text has no ids, and
    the hashes of nothing. Repeated rows stay, a null ``doc_id`` passes, further
    columns are ignored. An empty table gives an empty result.
    """
    import pyarrow as pa

    vocabulary, key = _shared(docs, path)

    def run(texts):
        codec = HeapCodec.of(key, vocabulary)
        n, of_ids, of_text = [], [], []
        for t in texts:
            ids = codec.encode(t.decode("utf-8", "replace")).tolist() if t else []
            n.append(len(ids))
            of_ids.append(hashlib.sha256(b",".join(map(codec.digits.__getitem__, ids))).hexdigest())
            of_text.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]

    fields = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return extend(docs.select("doc_id", "text"), run, fields, keep=["doc_id"])
