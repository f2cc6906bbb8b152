"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

A token's probability is that of its class, given the tokens before it, times
its share of the class. Classes come from clustering what stands next to a word;
words outside the most frequent are clustered by their ending, so that every
word, known or not, has a class. The class softmax sums hashed features of the
history: the word before, the pair before (n-grams), and the words two and three
places back (skips). It is trained by synchronised rounds of gradient updates:
in each, all partitions compare what they see with what the same weights expect,
the tables are summed by a tree, and every weight takes one step. The first round
starts from the classes' shares, so that counts alone tell its gradient. Scores
don't depend on how rows are dealt to partitions, but for rounding.

The base is a smoothed unigram model with exact counts of all training tokens.
Counts of the most frequent words are broadcast (a fixed number); all others are
looked up by a shuffled join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import materialize, small_batches

U = np.uint64
#: Words with counts that are broadcast; words with features and a class of their own; endings.
HOT, OWN, TAILS = 1 << 18, 1 << 14, 1 << 12
#: Classes (0 is the end), rows of the weight table, kinds of features, neighbours told apart.
CLASSES, ROWS, KINDS, BESIDE = 32, 1 << 16, 4, 64
#: Tokens that are worked on at once; rows of a block of summed tables; tables that one task sums.
BATCH, BLOCK, FAN = 32_768, 256, 16
#: Training tokens of a table, at least on average: smaller partitions are read by one task.
SHARE = 2_000_000
#: Rounds of updates; steps of the first and of the others; pseudo-count that damps rare features.
ROUNDS, FIRST, RATE, DAMP, MOST = 3, 0.55, 0.45, 24.0, 15
END = np.array([0x5851F42D4C957F2D], dtype=U)
#: Ids of the places before a text.
START = OWN + TAILS


def in_training() -> Column:
    return ~held_out()


def held_out() -> Column:
    """Whether a row is kept from training: ``crc32(doc_id as text) mod 5 = 1``; false without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and endings of the tokens of all texts, an end after each, and per text the place of its first token."""
    h, off, tails = words.hash_words_and_ends(texts)
    at = off + np.arange(len(off))
    out, ends = np.empty(len(h) + len(texts), dtype=U), np.empty(len(h) + len(texts), dtype=np.int64)
    last = np.zeros(len(out), dtype=bool)
    last[at[1:] - 1] = True
    out[last], out[~last] = END, h
    ends[last], ends[~last] = 0, (words.mix(tails.astype(U)) >> U(52)).astype(np.int64)
    return out, ends, at


def token_counts(docs: DataFrame) -> DataFrame:
    """``(h, tail, c)`` for every distinct token of ``docs``, by hash."""

    def run(it):
        for batch in it:
            parts = [tokens(group)[:2] for _, group in words.batches(batch.column(0).cast(pa.binary()).to_pylist(), 16 << 20)]
            for h, tails in parts:
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(tails[first].astype(np.int32)), pa.array(n.astype(np.int64))], ["h", "tail", "c"])

    rows = docs.select("text").mapInArrow(run, "h long, tail int, c long")
    return rows.groupBy("h").agg(F.min("tail").alias("tail"), F.sum("c").alias("c"))


class Vocabulary:
    """The most frequent words by rank: hashes and counts; the first OWN have ids of their own.

    A word is found by a table of slots over some bits of its hash; the few that
    share a slot with a more frequent one are searched in a sorted list.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.h, self.c = np.append(hashes, U(0)), np.append(counts, -1)
        n = len(hashes)
        self.shift = U(64 - max(10, int(n).bit_length() + 3))
        self.slot = np.full(1 << int(U(64) - self.shift), n, dtype=np.int32)
        at = (hashes >> self.shift).astype(np.int64)
        self.slot[at[::-1]] = np.arange(n - 1, -1, -1, dtype=np.int32)
        rest = np.flatnonzero(self.slot[at] != np.arange(n))
        order = np.argsort(hashes[rest])
        self.rest, self.rest_rank = hashes[rest][order], rest[order].astype(np.int32)

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Ranks of words, the number of all for a word that isn't there."""
        n = len(self.h) - 1
        out = self.slot[(h >> self.shift).astype(np.int64)]
        miss = self.h[out] != h
        out[miss] = n
        if len(self.rest):
            at = np.flatnonzero(miss)
            k = np.minimum(np.searchsorted(self.rest, h[at]), len(self.rest) - 1)
            hit = self.rest[k] == h[at]
            out[at[hit]] = self.rest_rank[k[hit]]
        return out

    def counts(self, ranks: np.ndarray) -> np.ndarray:
        """Counts, and -1 for a word that isn't there."""
        return self.c[ranks]

    def ids(self, ranks: np.ndarray, tails: np.ndarray) -> np.ndarray:
        return np.where(ranks < min(OWN, len(self.h) - 1), ranks, OWN + tails)


def _vocabulary(vocab: DataFrame) -> Vocabulary:
    """The most frequent words, about HOT at most; of those that are as frequent as the last, the ones by hash."""
    level = F.floor(F.log2("c") * 16).cast("int")
    bins = sorted(((r.level, r.n) for r in vocab.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted, total = F.lit(False), 0
    for k, n in bins:
        if total + n > HOT:
            wanted = wanted | (level == k) & (F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int((HOT - total) / n * (1 << 30)))
            break
        wanted, total = level >= k, total + n
    top = vocab.where(wanted).select("h", "c").toPandas().sort_values(["c", "h"], ascending=[False, True])
    return Vocabulary(top["h"].to_numpy(np.int64).view(U), top["c"].to_numpy(np.int64))


def encoded(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The ids of all tokens, and the place of each text's first one, batch by batch as packed numbers; read once, used by every round."""
    share = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(it):
        for batch in it:
            for _, group in words.batches(batch.column(0).cast(pa.binary()).to_pylist(), 16 << 20):
                h, tails, at = tokens(group)
                ids = share.value.ids(share.value.ranks(h), tails).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([at.astype(np.int64).tobytes()])], ["ids", "at"])

    return materialize(texts.select("text").mapInArrow(run, "ids binary, at binary"), "ids")


def _sum_tables(df: DataFrame, fn, rows: int, width: int, n: int) -> np.ndarray:
    """The sum over partitions of the ``rows x width`` tables that ``fn`` makes of their batches of ids and places.

    Of ``n`` tokens, there is one table for ``SHARE`` or more, so that tables stay small beside the texts.

    Tables travel in blocks of rows and are summed by a tree, in which a task
    meets ``FAN`` of a block's tables at most, however many partitions there are.
    """

    def run(it):
        from pyspark import TaskContext

        packed = (pair for batch in it for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        total = fn((np.frombuffer(ids, np.uint16).astype(np.int64), np.frombuffer(at, np.int64)) for ids, at in packed)
        if total is not None:
            part = TaskContext.get().partitionId()
            for b in range(0, rows, BLOCK):
                block = np.ascontiguousarray(total[b : b + BLOCK], dtype=np.float32)
                if block.any():
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part // FAN], pa.int32()), pa.array([True]), pa.array([block.tobytes()])], ["b", "p", "small", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(n=pdf.v.map(len)).sort_values("v")  # in one order, however they came
        total = sum(np.frombuffer(v, np.float32 if small else np.float64).astype(np.float64) for v, small in zip(pdf.v, pdf.small, strict=True))
        return pd.DataFrame({"b": [pdf.b.iloc[0]], "p": [pdf.p.iloc[0] // FAN], "small": [False], "v": [total.tobytes()]})

    kind = "b int, p int, small boolean, v binary"
    parts = df.rdd.getNumPartitions()
    if parts > (most := max(1, n // SHARE)):
        df, parts = df.coalesce(most), most
    blocks = df.mapInArrow(run, kind)
    while parts > 0:
        blocks, parts = blocks.groupBy("b", "p").applyInPandas(add, kind), parts // FAN if parts > 1 else 0
    out = np.zeros((rows, width))
    for r in blocks.toLocalIterator():
        part = np.frombuffer(r.v, np.float64).reshape(-1, width)
        out[r.b : r.b + len(part)] += part
    return out


def _beside(ids: np.ndarray) -> np.ndarray:
    """What a neighbour is told apart by: itself if very frequent, else a hash of its id."""
    half = BESIDE // 2
    return np.where(ids < half, ids, half + ids % (half - 1))


def neighbours(groups) -> np.ndarray | None:
    """How often which neighbours stand before and after each id."""
    total = None
    for ids, at in groups:
        near = _beside(ids)
        inner = np.ones(len(ids), dtype=bool)
        inner[at[1:] - 1] = False  # a text's end has nothing after it
        i = np.flatnonzero(inner)
        both = np.concatenate([ids[i] * BESIDE + near[i + 1], ids[i + 1] * BESIDE + near[i]])
        n = np.bincount(both, minlength=(START + 1) * BESIDE).astype(np.float32)
        total = n if total is None else total + n
    return None if total is None else total.reshape(-1, BESIDE)


def cluster(table: np.ndarray, seed: int = 7, rounds: int = 25) -> np.ndarray:
    """A class (from 1) for every row by weighted k-means of the roots of its shares."""
    weight = table.sum(1)
    x = np.sqrt(table / np.maximum(weight, 1)[:, None])
    w = np.sqrt(weight)
    rng = np.random.Generator(np.random.PCG64(seed))
    k = CLASSES - 1
    some = np.flatnonzero(weight > 0)
    if not len(some):
        return np.ones(len(table), dtype=np.int64)
    centres = x[rng.choice(some, 1, p=w[some] / w[some].sum())]
    while len(centres) < k:
        d = ((x[some][:, None] - centres[-1:]) ** 2).sum(2)[:, 0]
        far = d if len(centres) == 1 else np.minimum(far, d)  # noqa: F821
        p = far * w[some]
        centres = np.vstack([centres, x[rng.choice(some, p=p / p.sum())] if p.sum() > 0 else x[some[0]]])
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        for j in range(k):
            own = (near == j) & (weight > 0)
            if own.any():
                centres[j] = np.average(x[own], axis=0, weights=w[own])
    return near + 1


class Features:
    """Classes, and rows of the weight table, of every token of some texts, out of ids and each text's first place."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, classes: np.ndarray):
        self.at = at
        self.cls = classes[ids]
        self.cls[self.at[1:] - 1] = 0
        n = len(ids)
        first = np.repeat(self.at[:-1], np.diff(self.at))
        place = np.arange(n)
        back = []
        for k in (1, 2, 3):
            b = np.full(n, START, dtype=np.int64)
            ok = place - k >= first
            b[ok] = ids[place[ok] - k]
            back.append(b)
        keys = [back[0], back[1] * (START + 1) + back[0], back[1], back[2]]
        self.rows = np.stack([(words.mix(key.astype(U) + U((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U(48)).astype(np.uint16) for i, key in enumerate(keys)], axis=1)


def logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights[rows[:, 0]]
    z += bias
    for k in range(1, KINDS):
        z += weights[rows[:, k]]
    return z


def log_softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = logits(weights, bias, rows)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _summed(p: np.ndarray, rows: np.ndarray, into: np.ndarray) -> None:
    """Add the rows of ``p`` to the columns of ``into`` that they belong to, class by class."""
    at = rows.T.ravel().astype(np.int64)
    for c in range(CLASSES):
        into[c] += np.bincount(at, np.tile(p[:, c].astype(np.float64), KINDS), minlength=ROWS)


def seen(classes: np.ndarray, groups) -> np.ndarray | None:
    """How often each feature stands before each class."""
    total = None
    for ids, at in groups:
        f = Features(ids, at, classes)
        n = sum(np.bincount(f.rows[:, k].astype(np.int64) * CLASSES + f.cls, minlength=ROWS * CLASSES) for k in range(KINDS))
        total = n if total is None else total + n
    return None if total is None else total.reshape(ROWS, CLASSES)


def expected(classes: np.ndarray, weights: np.ndarray, bias: np.ndarray, groups) -> np.ndarray | None:
    """How often the model expects each feature before each class, over the same tokens."""
    total = None
    for ids, at in groups:
        f = Features(ids, at, classes)
        total = np.zeros((CLASSES, ROWS)) if total is None else total
        for lo in range(0, len(f.cls), BATCH):
            rows = f.rows[lo : lo + BATCH]
            p = np.exp(logits(weights, bias, rows))
            p /= p.sum(1, keepdims=True)
            _summed(p, rows, total)
    return None if total is None else total.T


def stepped(weights: np.ndarray, seen: np.ndarray, expected: np.ndarray, share: np.ndarray, rate: float) -> np.ndarray:
    """The weights after one step along the gradient ``seen - expected``, scaled by what is expected.

    The step of a weight is the logarithm of the ratio of both counts, to first
    order the gradient over the count; pseudo-counts keep rare features small.
    """
    damp = DAMP * share[None, :]
    return np.clip(weights + rate * np.log((seen + damp) / (expected + damp)), -MOST, MOST).astype(np.float32)


@dataclass
class Model:
    vocabulary: Vocabulary
    classes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    log_size: np.ndarray  # log10 of the counts of a class, smoothed
    n: int
    v: int


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all ``docs``, and the table of token counts ``(h, tail, c)``.

    The model's size is fixed; what it is fitted on is every token, in every round.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("text")
    vocab = materialize(token_counts(texts), "counts")
    n, v = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    vocabulary = _vocabulary(vocab)
    ids = encoded(texts, vocabulary)
    table = _sum_tables(ids, neighbours, START + 1, BESIDE, n)
    classes = cluster(table)

    # sizes of the classes, from all counts
    names = spark.createDataFrame([(int(h), int(classes[i])) for h, i in zip(vocabulary.h[:-1][:OWN].view(np.int64).tolist(), range(OWN))], "h long, own int")
    by_tail = spark.createDataFrame([(t, int(classes[OWN + t])) for t in range(TAILS)], "tail int, other int")
    sized = vocab.join(F.broadcast(names), "h", "left").join(F.broadcast(by_tail), "tail").withColumn("cls", F.when(F.col("h") == int(END.view(np.int64)[0]), 0).otherwise(F.coalesce("own", "other")))
    size = np.zeros((CLASSES, 2))
    for r in sized.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        size[r.cls] = r.c, r.v
    # a class of words also holds one unknown word; the end is always known
    log_size = np.log10(size[:, 0] + 0.5 * (size[:, 1] + 1))
    if size[0, 0]:
        log_size[0] = np.log10(size[0, 0] + 0.5)
    bias = np.log((size[:, 0] + 0.5) / (size[:, 0].sum() + 0.5 * CLASSES)).astype(np.float32)

    plan = spark.sparkContext.broadcast(classes)
    counts = _sum_tables(ids, lambda groups: seen(plan.value, groups), ROWS, CLASSES, n)
    start = np.exp(bias) / np.exp(bias).sum()
    weights = stepped(np.zeros((ROWS, CLASSES)), counts, counts.sum(1, keepdims=True) * start, start, FIRST)
    for _ in range(ROUNDS - 1):
        now = spark.sparkContext.broadcast((weights, bias))
        wanted = _sum_tables(ids, lambda groups, now=now: expected(plan.value, *now.value, groups), ROWS, CLASSES, n)
        weights = stepped(weights, counts, wanted, start, RATE)
    return Model(vocabulary, classes, weights, bias, log_size, n, v), vocab


def score_texts(texts: list[bytes], m: Model) -> tuple[np.ndarray, ...]:
    """Per text: tokens, known among the frequent, their log10 counts, log10 of class shares and sizes; rare hashes."""
    h, tails, at = tokens(texts)
    ranks = m.vocabulary.ranks(h)
    f = Features(m.vocabulary.ids(ranks, tails), at, m.classes)
    c = m.vocabulary.counts(ranks)
    rare = c < 0
    known = np.where(rare, 0, np.log10(np.maximum(c, 0) + 0.5))
    p = np.empty(len(h))
    for lo in range(0, len(h), BATCH):
        own = f.cls[lo : lo + BATCH]
        z = logits(m.weights, m.bias, f.rows[lo : lo + BATCH])
        mine = z[np.arange(len(own)), own]
        p[lo : lo + BATCH] = mine - np.log(np.exp(z, out=z).sum(1))
    p = p / np.log(10) - m.log_size[f.cls]
    add = lambda x: np.add.reduceat(x, at[:-1]) if len(x) else np.zeros(0)
    where = np.concatenate(([0], np.cumsum(rare)))[at]
    return np.diff(at), add((~rare).astype(np.int64)), add(known), add(p), where, h[rare].view(np.int64)


def score_documents(docs: DataFrame, model: Model, vocab: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every row."""
    small_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "k", "s", "p", "rare"]

    def run(it):
        for batch in it:
            ids, i = batch.column("doc_id"), 0
            for _, group in words.batches(batch.column("text").cast(pa.binary()).to_pylist(), 16 << 20):
                n, k, s, p, where, rare = score_texts(group, share.value)
                rare = pa.LargeListArray.from_arrays(pa.array(where.astype(np.int64)), pa.array(rare)).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(group)), pa.array(n.astype(np.int64)), pa.array(k.astype(np.int64)), pa.array(s), pa.array(p), rare], names)
                i += len(group)

    each = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, k long, s double, p double, rare array<bigint>")
    each = materialize(each.withColumn("row", F.monotonically_increasing_id()), "tokens")
    rare = each.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("n"))
    rare = rare.join(vocab.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rk"), F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("rs"))
    out = each.drop("rare").join(rare, "row", "left")
    s = F.col("s") + F.coalesce("rs", F.lit(0.0))
    total = float(np.log10(model.n + 0.5 * (model.v + 1)))
    return out.select("doc_id", "n_tokens", (F.col("k") + F.coalesce("rk", F.lit(0))).alias("n_known"), (s - F.col("n_tokens") * F.lit(total)).alias("base_score"), (s + F.col("p")).alias("score"))


def lm_report(docs: DataFrame) -> DataFrame:
    """Scores of all rows of ``docs`` by a model of those that are not held out.

    Scores are a function of the table: they don't depend on the order of rows
    or on their partitions, but for rounding. Further columns are ignored; texts
    of any length are worked on in pieces.
    A null or empty text is its end alone. Repeated rows count as often as they
    are there. A null ``doc_id`` is trained on. Without training rows, scores
    come from an untrained model. An empty table gives an empty result. Words
    are told apart by 64-bit hashes.
    """
    docs = docs.select("doc_id", "text")
    model, vocab = fit(docs.where(in_training()))
    out = score_documents(docs, model, vocab)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
