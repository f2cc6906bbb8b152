"""Alignment of two tokenizers' tokens over a corpus, by a dictionary of token groups.

Tokenizer A is byte-level BPE of a JSON file and encodes a space and the text; B
is a sentencepiece model and encodes the text, to which it adds that space. The
byte offsets at which tokens of both end cut a text into groups. Few groups are
distinct, so they are interned: tasks hand out numbers within blocks of texts, and
each block has a dictionary of its groups with their counts. Links are expanded
once for each distinct group of the corpus, multiplied by its count, summed by id
pair, and the results go back to the blocks by group key.
"""

from __future__ import annotations

import hashlib
from array import array
from itertools import chain
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import Codec, serialise
from .heap_bpe import PATTERN, byte_characters, read_vocabulary
from .shared import extend, materialize, quoted, small_batches

#: Bytes of text, about, after which a task closes a block.
BLOCK_BYTES = 4 << 20
#: Stretches of text, and pre-tokens, of a generation that a task holds, and groups that it numbers before it begins anew.
CACHE, GROUPS = 40_000, 2_000_000
#: Bytes of text, about, that are looked at together.
STEP = 1 << 19
SPACE = "▁"


class Tokenizers(NamedTuple):
    """Sentencepiece models of both vocabularies; their sizes are those of the files."""

    a: bytes
    b: bytes


class Aligner:
    """Encodes stretches of text by both tokenizers and numbers their groups; one for each task."""

    _codecs: dict[int, tuple] = {}
    _made: dict[int, Aligner] = {}

    def __init__(self, key: int, tokenizers):
        if key not in self._codecs:
            self._codecs[key] = _codecs(tokenizers.value)
        self.a, self.b, self.cut, self.lengths_a, self.lengths_b, self.bytes_b, self.space_id, self.parted = self._codecs[key]
        #: groups of the stretches met last, as bytes of int32, in two generations
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.number: dict[bytes, int] = {}
        self.pairs: dict[int, int] = {}
        self.keys: list[bytes] = []
        #: numbers of A's and B's tokens of each group, one after the other
        self.sizes = array("q")

    @classmethod
    def of(cls, key: int, tokenizers) -> Aligner:
        """The task's own, or a new one where that has numbered too many groups."""
        if key not in cls._made or len(cls._made[key].keys) > GROUPS:
            cls._made[key] = cls(key, tokenizers)
        return cls._made[key]

    @classmethod
    def forget(cls, key: int) -> None:
        """Let go of what a task has met, as workers outlive tasks; the models stay."""
        if key in cls._made:
            cls._made.pop(key).a.forget()

    def stretches(self, text: str) -> list[str]:
        """The text without the spaces at which it is cut: those after what is no white space.

        No token of A goes on over such a space, and none of B where its pieces
        have spaces only in front; otherwise the text stays whole.
        """
        return self.cut.split(text) if self.parted else [text]

    def _intern(self, key: bytes, size: tuple[int, int]) -> int:
        if (g := self.number.get(key)) is None:
            g = self.number[key] = len(self.keys)
            self.keys.append(key)
            self.sizes.extend(size)
        return g

    def _pair(self, pair: int) -> int:
        """The number of a group of one token of each."""
        if (g := self.pairs.get(pair)) is None:
            g = self.pairs[pair] = self._intern(b"%d|%d" % divmod(pair, len(self.bytes_b)), (1, 1))
        return g

    def learn(self, new: list[str]) -> None:
        """Number the groups of stretches that aren't known yet; -1 stands for bytes that differ."""
        ids = [i or [self.space_id] for i in self.b.encode(new, num_threads=1)]
        joined = self.bytes_b.__getitem__
        if b"".join(map(joined, chain.from_iterable(ids))) != (" " + " ".join(new)).encode():
            same = [b"".join(map(joined, i)) == b" " + s.encode() for s, i in zip(new, ids, strict=True)]
            self.known |= {s: np.int32(-1).tobytes() for s, ok in zip(new, same, strict=True) if not ok}
            new, ids = ([x for x, ok in zip(some, same, strict=True) if ok] for some in (new, ids))
        if not new:
            return
        whole = [" " + s for s in new]
        flat_a = np.frombuffer(self.a.ids(list(chain.from_iterable(map(self.a.find.findall, whole)))), np.int32)
        flat_b = np.array(list(chain.from_iterable(ids)), np.int64)
        ends_a, ends_b = np.cumsum(self.lengths_a[flat_a]), np.cumsum(self.lengths_b[flat_b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        to_a, to_b = np.searchsorted(ends_a, both) + 1, np.searchsorted(ends_b, both) + 1
        from_a, from_b = np.concatenate([[0], to_a[:-1]]), np.concatenate([[0], to_b[:-1]])
        single = (to_a - from_a == 1) & (to_b - from_b == 1)
        numbers = np.empty(len(both), np.int32)
        pairs, inverse = np.unique(flat_a[from_a[single]].astype(np.int64) * len(self.bytes_b) + flat_b[from_b[single]], return_inverse=True)
        numbers[single] = np.array([self._pair(p) for p in pairs.tolist()], np.int32)[inverse] if len(pairs) else 0
        list_a, list_b = flat_a.tolist(), flat_b.tolist()
        many = np.flatnonzero(~single)
        for at, i, m, j, n in zip(many.tolist(), from_a[many].tolist(), to_a[many].tolist(), from_b[many].tolist(), to_b[many].tolist(), strict=True):
            numbers[at] = self._intern(("%s|%s" % (",".join(map(str, list_a[i:m])), ",".join(map(str, list_b[j:n])))).encode(), (m - i, n - j))
        raw = numbers.tobytes()
        stops = (4 * (np.searchsorted(both, np.cumsum([len(s.encode()) for s in whole])) + 1)).tolist()
        for s, start, stop in zip(new, [0, *stops], stops, strict=False):
            self.known[s] = raw[start:stop]

    def groups(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of each text's groups in order; none for empty texts and those whose bytes differ."""
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        if len(self.a.known) > CACHE:
            self.a.older, self.a.known = self.a.known, {}
        parts = [self.stretches(t) if t else [] for t in texts]
        if new := set(chain.from_iterable(parts)).difference(self.known):
            held = new.intersection(self.older)
            self.known |= {s: self.older[s] for s in held}
            if new := list(new - held):
                self.learn(new)
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, p)), np.int32) for p in parts]
        return [g if not len(g) or g.min() >= 0 else g[:0] for g in out]


def _codecs(tokenizers: Tokenizers) -> tuple:
    import regex
    import sentencepiece

    a = Codec(tokenizers.a, PATTERN)
    b = sentencepiece.SentencePieceProcessor(model_proto=tokenizers.b)
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    raw = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
    parted = not any(SPACE in p.lstrip(SPACE) for p in pieces)
    lengths = lambda entries: np.array([len(e) for e in entries], np.int64)
    return a, b, regex.compile(r"(?<=\S) "), lengths(a.pieces), lengths(raw), raw, b.piece_to_id(SPACE), parted


def _shared(docs: DataFrame, a_path: str, b_path: str):
    """Both models as a broadcast (their sizes are fixed, some MB), and a key of them for the workers."""
    with open(b_path, "rb") as f:
        model = f.read()
    vocabulary, by_char = read_vocabulary(a_path), {c: b for b, c in enumerate(byte_characters())}
    ranks = {bytes(by_char[c] for c in e): i for i, e in enumerate(vocabulary.entries) if e is not None and e not in vocabulary.added}
    if len(vocabulary.merges) + 256 != len(ranks) or any(i >= j for (_, _, i), (_, _, j) in zip(vocabulary.merges, vocabulary.merges[1:], strict=False)):
        raise ValueError("the ids of A must follow its merges")
    models = Tokenizers(serialise(ranks), model)
    return docs.sparkSession.sparkContext.broadcast(models), hash(models)


class Block:
    """The groups of some texts, and in how many places and texts each stands."""

    def __init__(self, name: str, key: int, tokenizers):
        self.name, self.aligner, self.bytes = name, Aligner.of(key, tokenizers), 0
        self.freq, self.docs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def texts(self, raw: list[bytes | None]) -> dict:
        """Columns of the texts, all of which are counted."""
        import pyarrow as pa

        found = self.aligner.groups([t.decode("utf-8", "replace") if t else "" for t in raw])
        none, n, keys = np.zeros(0, np.int32), len(self.aligner.keys), self.aligner.keys
        flat, ends = np.concatenate([*found, none]), np.cumsum([0, *map(len, found)], dtype=np.int64)
        grown = lambda old, numbers: np.pad(old, (0, n - len(old))) + np.bincount(numbers, minlength=n)
        self.freq, self.docs = grown(self.freq, flat), grown(self.docs, np.concatenate([*map(np.unique, found), none]))
        self.bytes += sum(len(t) for t in raw if t)
        sizes = np.array(self.aligner.sizes, np.int64).reshape(-1, 2)
        digests = [hashlib.sha256(b";".join(map(keys.__getitem__, g.tolist()))).hexdigest() if len(g) else "" for g in found]
        numbers = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(pa.list_(pa.int32()))
        return {"block": pa.array([self.name] * len(raw), pa.string()), "n_a": pa.array(_sums(sizes[flat, 0], ends)), "n_b": pa.array(_sums(sizes[flat, 1], ends)), "groups_sha256": pa.array(digests, pa.string()), "numbers": numbers}

    def dictionary(self) -> dict:
        """Columns of the groups that stand in a text; those of refused texts only are left out."""
        import pyarrow as pa

        held = np.flatnonzero(self.freq)
        keys = pa.array(self.aligner.keys, pa.binary()).cast(pa.string()).take(pa.array(held))
        return {"block": pa.array([self.name] * len(held), pa.string()), "number": pa.array(held, pa.int32()), "key": keys, "freq": pa.array(self.freq[held]), "docs": pa.array(self.docs[held])}


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the values between the ends."""
    return np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])[ends])


def interned(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A written table of the texts' groups by number, and of the dictionaries of the numbers.

    Rows of texts have the columns ``keep`` as ``_0, _1, ...``, ``block``, ``n_a``,
    ``n_b``, ``groups_sha256`` and the ``numbers`` of their groups in order; those
    of dictionaries have ``block``, ``number``, the group's ``key``
    (``a1,a2|b1``), its ``freq`` in the block and the ``docs`` that have it.
    Texts are encoded where they lie, whole, whatever their length.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    keep = docs.columns if keep is None else keep
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    small_batches(docs.sparkSession)
    tokenizers, code = _shared(docs, a_path, b_path)
    own = [f"_{i}" for i in range(len(keep))]
    fields = {"block": "string", "n_a": "long", "n_b": "long", "groups_sha256": "string", "numbers": "array<int>", "number": "int", "key": "string", "freq": "long", "docs": "long"}
    arrow = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}

    def run(it):
        types = {f: arrow[k] for f, k in fields.items()}

        def rows(columns: dict):
            n = len(columns["block"])
            return pa.RecordBatch.from_arrays([columns[f] if f in columns else pa.nulls(n, types[f]) for f in (*own, *fields)], [*own, *fields])

        block, made = None, 0
        for batch in it:
            types |= {c: batch.column(i + 1).type for i, c in enumerate(own)}
            block = block or Block(f"{TaskContext.get().partitionId()}-{made}", code, tokenizers)
            step = max(1, batch.num_rows * STEP // max(1, batch.column(0).nbytes))  # rows of about that many bytes
            for some in (batch.slice(low, step) for low in range(0, batch.num_rows, step)):
                yield rows(block.texts(some.column(0).cast(pa.binary()).to_pylist()) | {c: some.column(i + 1) for i, c in enumerate(own)})
            if block.bytes >= BLOCK_BYTES:
                yield rows(block.dictionary())
                block, made = None, made + 1
        if block:
            yield rows(block.dictionary())
        block = None
        Aligner.forget(code)
        pa.default_memory_pool().release_unused()

    schema = ", ".join([f"{c} {kinds[k]}" for c, k in zip(own, keep, strict=True)] + [f"{c} {k}" for c, k in fields.items()])
    source = docs.select(F.col(*quoted(text)).alias("_text"), *(F.col(*quoted(k)).alias(c) for c, k in zip(own, keep, strict=True)))
    return materialize(source.mapInArrow(run, schema), "interned")


def linked(a: list[int], b: list[int], rule: str) -> list[tuple[int, int]]:
    """Places of tokens in a group, given by their lengths, that end together or overlap."""
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    if rule == "ends":
        return [(int(i), int(j)) for i, j in zip(*(np.nonzero(np.isin(x, y))[0] for x, y in ((ends_a, ends_b), (ends_b, ends_a))), strict=True)]
    first, last = np.searchsorted(ends_b, ends_a - a, side="right"), np.searchsorted(ends_b, ends_a, side="left")
    return [(i, j) for i in range(len(a)) for j in range(int(first[i]), int(last[i]) + 1)]


def expanded(table: DataFrame, a_path: str, b_path: str, rule: str = "ends", weigh: str = "freq") -> DataFrame:
    """A written table ``key, weight, a, b, n`` of the links of each distinct group.

    ``rule`` is ``ends`` (tokens whose byte ranges end together) or ``overlap``
    (those that share bytes); ``n`` counts a group's links of one id pair;
    ``weight`` is the group's ``freq`` in the corpus or the number of ``docs``.
    """
    import pyarrow as pa

    if rule not in ("ends", "overlap") or weigh not in ("freq", "docs"):
        raise ValueError("rule is ends or overlap, weigh is freq or docs")
    tokenizers, code = _shared(table, a_path, b_path)
    distinct = table.where("number is not null").groupBy("key").agg(F.sum(weigh).alias("weight"))

    def run(it):
        aligner = Aligner.of(code, tokenizers)
        for batch in it:
            out = []
            for key, weight in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                a, b = ([*map(int, side.split(","))] for side in key.split("|"))
                found: dict[tuple[int, int], int] = {}
                places = linked(aligner.lengths_a[a], aligner.lengths_b[b], rule) if len(a) + len(b) > 2 else [(0, 0)]
                for i, j in places:
                    found[a[i], b[j]] = found.get((a[i], b[j]), 0) + 1
                out += [(key, weight, x, y, n) for (x, y), n in found.items()]
            names, kinds = ("key", "weight", "a", "b", "n"), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return materialize(distinct.mapInArrow(run, "key string, weight long, a int, b int, n long"), "links")


def id_pairs(links: DataFrame) -> DataFrame:
    """``a, b, count, best``: links of each id pair in the corpus, and whether no other pair of its B id has more."""
    pairs = links.groupBy("a", "b").agg(F.sum(F.col("weight") * F.col("n")).alias("count"))
    most = pairs.groupBy("b").agg(F.max("count").alias("_most"))  # as many rows as B has pieces at most
    return pairs.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("_most")).alias("best"))


def token_pairs(docs: DataFrame, a_path: str, b_path: str, text: str = "text", rule: str = "ends", weigh: str = "freq") -> DataFrame:
    """``a, b, count, best`` of all id pairs that are linked anywhere in the texts.

    Null and empty texts have no links, nor have those whose bytes B doesn't keep;
    repeated rows count each; no texts give no pairs; other columns are ignored.
    """
    return id_pairs(expanded(interned(docs, a_path, b_path, text, []), a_path, b_path, rule, weigh))


def align_tokens(docs: DataFrame, a_path: str, b_path: str, text: str = "text", into: str = "groups") -> DataFrame:
    """``docs`` with the groups of ``text`` as ``a1,a2|b1;a3|b2,b3``, the empty string where it has no tokens.

    Rows stay where they lie, repeated ones too; other columns pass, but none may
    be named ``into``. An empty table gives an empty result.
    """
    import pyarrow as pa

    tokenizers, code = _shared(docs, a_path, b_path)

    def run(texts):
        aligner = Aligner.of(code, tokenizers)
        found = aligner.groups([t.decode("utf-8", "replace") if t else "" for t in texts])
        return [pa.array([b";".join(map(aligner.keys.__getitem__, g.tolist())) for g in found], pa.binary()).cast(pa.string())]

    return extend(docs, run, [(into, "string")], text, done=lambda: Aligner.forget(code))


def alignment_report(docs: DataFrame, a_path: str, b_path: str, rule: str = "ends", weigh: str = "freq") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each document.

    ``n_best`` are the links whose pair no other one of the same B id exceeds in
    the corpus, ``count_sum`` is the sum of the pairs' counts over the links. Null
    and empty texts, and those that B doesn't keep byte by byte, have zeros and
    the hash ``''``. Repeated rows stay and count each; a null ``doc_id`` passes;
    further columns are ignored. An empty table gives an empty result.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    table = interned(docs.select("doc_id", "text"), a_path, b_path, keep=["doc_id"])
    links = expanded(table, a_path, b_path, rule, weigh)
    of_links = links.join(id_pairs(links), ["a", "b"])
    count = lambda c: F.sum(F.col("n") * c).alias
    of_groups = of_links.groupBy("key").agg(F.sum("n").alias("n_links"), count(F.col("best").cast("long"))("n_best"), count(F.col("count"))("count_sum"))
    numbers = table.where("number is not null").select(F.col("block").alias("in_block"), "number", "key").join(of_groups, "key").drop("key")
    texts = table.where("number is null").select("_0", "block", "n_a", "n_b", "groups_sha256", "numbers")
    sums = ["n_links", "n_best", "count_sum"]

    def gathered(left, right):
        at, size = right["number"].to_numpy(), (pc.max(right["number"]).as_py() or 0) + 1
        of = np.zeros((size, len(sums)), np.int64)
        of[at] = np.stack([right[c].to_numpy() for c in sums], axis=1)
        out = {c: [] for c in ("n_groups", *sums)}
        for lists in left["numbers"].chunks:
            for low in range(0, len(lists), 1000):  # a bounded number of texts at a time
                some = lists.slice(low, 1000)
                ends = np.concatenate([[0], np.cumsum(some.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                flat = some.flatten().to_numpy()
                out["n_groups"].append(np.diff(ends))
                for i, c in enumerate(sums):
                    out[c].append(_sums(of[:, i][flat], ends))
        n = {c: pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])) for c, parts in out.items()}
        return pa.table({"doc_id": left["_0"], "n_a": left["n_a"], "n_b": left["n_b"], **n, "groups_sha256": left["groups_sha256"]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("block").cogroup(numbers.groupBy("in_block")).applyInArrow(gathered, schema)
