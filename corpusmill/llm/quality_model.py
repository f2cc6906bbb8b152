"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

A document becomes a short vector of statistics of its whole text. Random
Fourier features approximate a Gaussian kernel over those; the normal equations
of ridge regression are sums over partitions, and the fitted values of rows that
ridge has not seen are calibrated by isotonic regression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import extend, fresh, materialize

U = np.uint64
#: Labelled rows to learn from, at most (about): the stated bound of the training sample.
TRAIN_ROWS = 200_000
#: Partitions whose normal equations meet on the driver.
SUMS = 16
#: Random features, ridge penalty, bins of the calibration.
FEATURES, RIDGE, BINS = 192, 1e-3, 2000

# Kinds of bytes, as columns of the statistics.
_KIND = np.full(256, 8, dtype=np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'\"()-", b"!?", b"|/\\[]{}<>")):
    _KIND[list(_chars)] = _k
_KIND[128:192] = 9  # a character counts by its first byte
_KIND[192:] = 10
NAMES = ["bytes", "words", "word_length", "word_deviation", "lower", "upper", "digits", "blanks", "breaks", "stops", "calls", "bars", "symbols", "letters_beyond", "entropy", "repeats", "concentration", "ends_in_symbol", "all_caps", "bytes_a_line", "lone_marks"]


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of :data:`NAMES` per text."""
    raw = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(raw, dtype=np.uint8)
    starts, ends = words.spans(buf, words.WHITE)
    h, off = words.hash_words(texts)
    kind = _KIND[buf]
    size = (ends - starts).astype(np.float64)
    mark = np.isin(kind[ends - 1], (6, 7, 8)) if len(ends) else np.zeros(0, bool)
    caps = (kind[starts] == 1) & (kind[ends - 1] != 0) & (size > 1) & (kind[np.minimum(starts + 1, len(kind) - 1)] != 0)
    lone = (size == 1) & mark
    again = np.zeros(len(h), dtype=bool)
    again[1:] = h[1:] == h[:-1]
    out = np.zeros((len(texts), len(NAMES)))
    at = 0
    for i, t in enumerate(texts):
        n, (a, b) = len(t), off[i : i + 2]
        k, at = kind[at : at + n], at + n + 1
        if n == 0:
            continue
        hist = np.bincount(k, minlength=11)
        chars = n - hist[9]
        byte = np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256)
        p = byte[byte > 0] / n
        w = b - a
        row = out[i]
        row[0], row[1], row[14] = np.log1p(n), np.log1p(w), -(p * np.log2(p)).sum()
        row[4:12] = hist[:8] / chars
        row[12], row[13] = hist[8] / chars, hist[10] / chars
        row[19] = np.log1p(n / (1 + hist[4]))
        if w:
            s = size[a:b]
            c = np.bincount((h[a:b] >> U(54)).astype(np.int64), minlength=1024)
            row[2], row[3] = np.log1p(s.mean()), np.log1p(s.std())
            row[15], row[16] = again[a + 1 : b].mean() if w > 1 else 0, np.sqrt(((c / w) ** 2).sum())
            row[17], row[18], row[20] = mark[a:b].mean(), caps[a:b].mean(), lone[a:b].mean()
    return out


@dataclass
class QualityModel:
    """All of the model; some 100 kB whatever it was fitted on."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def expand(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.shift)) * np.cos(z @ self.waves + self.shift), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1; ties of the calibration are broken by the fitted value."""
        raw = self.raw(stats)
        return np.clip(0.99 * np.interp(raw, self.x, self.y) + 0.01 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -50, 50))), 0, 1)


def document_statistics(docs: DataFrame, text: str = "text", into: str = "stats", keep: list[str] | None = None) -> DataFrame:
    """The statistics of each whole text, as ``array<double>``; zeros for null and empty texts."""

    def run(texts):
        rows = [s for _, group in words.batches(texts, 1 << 20) for s in statistics(group)]
        return [pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))]

    return extend(docs, run, [(into, "array<double>")], text, keep)


def _isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in the order of ``x``; the mean place and value of each pool."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, n, strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def _sums(df: DataFrame, fn, width: int) -> np.ndarray:
    """Sum over at most ``SUMS`` partitions of what ``fn`` makes of a batch's statistics and labels."""

    def run(it):
        total = np.zeros(width)
        for batch in it:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                total += fn(x, np.asarray(batch.column(1)).astype(np.float64), np.asarray(batch.column(2)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    rows = df.select("stats", "label", "fold").coalesce(SUMS).mapInArrow(run, "v array<double>").collect()
    return np.sum([r.v for r in rows], axis=0) if rows else np.zeros(width)


def fit_quality(stats: DataFrame, labels: DataFrame, seed: int = 6, rows: int = TRAIN_ROWS) -> QualityModel | None:
    """Fit on ``stats(doc_id, stats)`` and ``labels(doc_id, label)``; None without labelled rows.

    The largest label counts where a ``doc_id`` has several; rows without an id
    or a label are passed over. Above ``rows`` labelled rows, that many (about)
    are taken by a hash of their id.
    """
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg((F.max("label") > 0).cast("double").alias("label"))
    train = stats.join(known, "doc_id").select("stats", "label", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)).alias("fold"))
    train = materialize(train, "train")
    count = train.count()
    if not count:
        return None
    train = train.where(F.col("fold") < int(min(1.0, rows / count) * (1 << 30)) + 1)
    d = len(NAMES)
    base = _sums(train, lambda x, y, f: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 2 * d + 1)
    mean = base[1 : d + 1] / base[0]
    scale = np.sqrt(np.maximum(base[d + 1 :] / base[0] - mean**2, 1e-9)) + 1e-3
    rng = np.random.Generator(np.random.PCG64(seed))
    model = QualityModel(mean, scale, rng.normal(0, 1 / np.sqrt(d / 2), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    def normal(x, y, f):  # a quarter of the rows is left for the calibration
        own = f % 4 != 0 if len(x) else f
        z, y = model.expand(x[own]), y[own]
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    k = FEATURES + 1
    v = _sums(train, normal, k * k + k)
    gram = v[: k * k].reshape(k, k)
    model.weights = np.linalg.solve(gram + RIDGE * max(1.0, gram[-1, -1]) * np.diag([1.0] * FEATURES + [1e-6]) + 1e-9 * np.eye(k), v[k * k :])
    lo, hi = -0.5, 1.5

    def bins(x, y, f):
        own = f % 4 == 0
        raw = model.raw(x[own])
        at = np.clip(((raw - lo) / (hi - lo) * BINS).astype(np.int64), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, raw, BINS), np.bincount(at, y[own], BINS)])

    n, sx, sy = _sums(train, bins, 3 * BINS).reshape(3, BINS)
    if n.sum() < 1:
        model.x, model.y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    else:
        some = n > 0
        model.x, model.y = _isotonic(sx[some] / n[some], sy[some] / n[some], n[some])
    return model


def score_quality(docs: DataFrame, model: QualityModel | None, text: str = "text", into: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the score of each whole text; 0.5 throughout without a model.

    Null and empty texts count as statistics of zero; a column ``into`` must not exist.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        m = shared.value
        return [pa.array(np.concatenate([np.zeros(0)] + [m.score(statistics(group)) if m else np.full(len(group), 0.5) for _, group in words.batches(texts, 1 << 20)]), pa.float64())]

    return extend(docs, run, [(into, "double")], text, keep)


def held_out() -> F.Column:
    """Whether a row is kept from training: ``crc32(doc_id as text) mod 5 = 0``; false without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``; labels of held-out rows are not read.

    Null and empty texts are scored from statistics of zero. Repeated rows get
    equal scores; of several labels of one id the largest counts. A null
    ``doc_id`` is scored, not learned from, and not held out. Texts are taken
    whole; further columns are ignored. Without labels the score is 0.5
    throughout. An empty table gives an empty result.
    """
    stats = materialize(document_statistics(docs.select("doc_id", "text"), keep=["doc_id"]), "stats")
    known = labels.select("doc_id", F.col("quality").alias("label")).where(~held_out())
    model = fit_quality(stats, known)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        for batch in it:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            s = shared.value.score(x) if shared.value else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    out = stats.select("doc_id", "stats").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more; nulls, repeats and labels as in the report.

    Only labelled texts are looked at twice: no table of all texts is written.
    """
    known = labels.select("doc_id", F.col("quality").alias("label")).where(~held_out())
    labelled = docs.select("doc_id", "text").join(known.where("label is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    model = fit_quality(document_statistics(labelled, keep=["doc_id"]), known)
    score = fresh("score", docs.columns)
    return score_quality(docs, model, into=score).where(F.col(score) >= threshold).drop(score)
