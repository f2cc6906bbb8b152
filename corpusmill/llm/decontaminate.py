"""Benchmark decontamination by Wu-Manber search over word sequences.

A benchmark item is a set of patterns: its windows of ``window`` consecutive
words, or its whole word sequence if it is shorter. Texts are searched for all
patterns of one length at once: a shift table over blocks of two words says how
far the search may jump, the hash of a pattern's last block leads to the few
patterns that can end there, and those are compared word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import extend, fresh, quoted

U = np.uint64
#: Bytes of benchmark text compiled into one matcher, which is what a broadcast holds.
MATCHER_BYTES = 8 << 20
TABLE_BITS = 20


class Matcher:
    """Patterns of one length over word hashes."""

    def __init__(self, length: int, patterns: dict[bytes, set[int]]):
        self.length, self.block = length, min(2, length)
        keys = np.frombuffer(b"".join(patterns), dtype=U).reshape(-1, length)
        self.items = [tuple(sorted(v)) for v in patterns.values()]
        self.keys = list(patterns)
        slots = [self.slots(keys[:, j - self.block : j]) for j in range(self.block, length + 1)]
        self.shift = np.full(1 << TABLE_BITS, min(length - self.block + 1, 255), dtype=np.uint8)
        for j, s in enumerate(slots):
            np.minimum.at(self.shift, s, min(length - self.block - j, 255))
        self.bucket: dict[int, list[int]] = defaultdict(list)
        for i, s in enumerate(slots[-1].tolist()):
            self.bucket[s].append(i)

    def slots(self, blocks: np.ndarray) -> np.ndarray:
        h = blocks[:, 0] if self.block == 1 else blocks[:, 0] * U(0x9FB21C651E98DF25) + (blocks[:, 1] ^ (blocks[:, 1] >> U(29)))
        return (words.mix(h) >> U(64 - TABLE_BITS)).astype(np.int64)

    def jumps(self, h: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Per block end the shift, and the slot; entry ``i`` is the block that ends at word ``i + block - 1``."""
        blocks = h[:, None] if self.block == 1 else np.stack([h[:-1], h[1:]], axis=1)
        s = self.slots(blocks)
        return self.shift[s].tobytes(), s

    def find(self, h: np.ndarray, shifts: bytes, slots: np.ndarray, lo: int, hi: int) -> Iterable[tuple[int, int]]:
        """(first word, pattern) of every occurrence within the words ``lo`` to ``hi``."""
        back = self.block - 1
        pos, last = lo + self.length - 1, hi
        while pos < last:
            if jump := shifts[pos - back]:
                pos += jump
                continue
            if near := self.bucket.get(int(slots[pos - back])):
                first = pos - self.length + 1
                seen = h[first : pos + 1].tobytes()
                for p in near:
                    if self.keys[p] == seen:
                        yield first, p
            pos += 1


def compile_items(items: list[tuple[str | None, str | None]], window: int) -> list[Matcher]:
    """One matcher per pattern length; items are known by their place in ``items``."""
    by_length: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
    h, off = words.hash_words([(t or "").encode("utf-8", "replace") for _, t in items], words.ALNUM_GAP)
    for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        size = min(window, hi - lo)
        for k in range(lo, hi - size + 1) if size else ():
            by_length[size][h[k : k + size].tobytes()].add(i)
    return [Matcher(n, p) for n, p in sorted(by_length.items())]


def scan(texts: list[bytes], matchers: list[Matcher]) -> Iterable[tuple[int, int, list[tuple[int, int, int]]]]:
    """(index, words, occurrences as (first word, end, item)) per text."""
    for start, group in words.batches(texts):
        h, off = words.hash_words(group, words.ALNUM_GAP)
        prepared = [(m, *m.jumps(h)) for m in matchers if len(h) >= m.length]
        for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            found = [(first - lo, first - lo + m.length, item) for m, shifts, slots in prepared for first, p in m.find(h, shifts, slots, lo, hi) for item in m.items[p]]
            yield start + i, hi - lo, found


def merge(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping and adjoining occurrences of one item, joined."""
    out: list[list[int]] = []
    for first, end, item in sorted(found, key=lambda x: (x[2], x[0])):
        if out and out[-1][2] == item and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end, item])
    return [tuple(x) for x in out]


SPANS = "array<struct<first:int,last:int,item:string>>"


def benchmark_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", limit: int = MATCHER_BYTES) -> tuple[DataFrame, str, str]:
    """``docs`` with a column of its word count and one of its benchmark spans; and their names.

    A span is a run of words (first and last, counted from 0) that windows of
    one item cover. The benchmark goes to the executors in matchers of at most
    ``limit`` bytes of text (or one item); a larger benchmark takes several
    passes over the row, one after the other, each with its own matcher.

    Words are maximal runs outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after
    A-Z have become a-z. Null and empty texts have no words, items without words
    no patterns, and equal items are all reported. An item with a null id covers
    words without being listed. Columns keep their names; new ones give way.
    """
    import pyarrow as pa

    n_words, spans = fresh("n_words", docs.columns), fresh("spans", docs.columns)
    sc = docs.sparkSession.sparkContext
    out = docs
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("item", pa.string())]))
    parts = []
    for k, items in enumerate(_blocks(benchmark, limit)):
        names = sc.broadcast([i for i, _ in items])
        compiled = sc.broadcast(compile_items(items, window))

        def run(texts, names=names, compiled=compiled):
            counts, found = [], []
            for _, n, hits in scan([t or b"" for t in texts], compiled.value):
                counts.append(n)
                found.append([{"first": a, "last": b - 1, "item": names.value[i]} for a, b, i in merge(hits)])
            return [pa.array(counts, pa.int64()), pa.array(found, kind)]

        parts.append((fresh(f"w{k}_", out.columns), fresh(f"s{k}_", out.columns)))
        out = extend(out, run, [(parts[-1][0], "long"), (parts[-1][1], SPANS)], text)
    if not parts:
        raise AssertionError("a benchmark has at least one block")
    found = F.col(parts[0][1]) if len(parts) == 1 else F.concat(*(s for _, s in parts))
    return out.select(*quoted(*docs.columns), F.col(parts[0][0]).alias(n_words), found.alias(spans)), n_words, spans


def _blocks(benchmark: DataFrame, limit: int) -> Iterable[list[tuple[str | None, str | None]]]:
    """The items in consecutive groups of bounded size, streamed partition by partition; one group at least."""
    group: list[tuple[str | None, str | None]] = []
    size, some = 0, False
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        n = len(row.text or "") * 2 + 64
        if group and size + n > limit:
            yield group
            group, size, some = [], 0, True
        group.append((row.item_id, row.text))
        size += n
    if group or not some:
        yield group


def words_hit(spans: str) -> str:
    """SQL for the number of words that spans cover, overlaps counted once."""
    step = f"aggregate(array_sort(transform({spans}, s -> struct(s.first as first, s.last as last))), named_struct('n', 0L, 'end', -1), (a, s) -> named_struct('n', a.n + greatest(0, s.last - greatest(a.end, s.first - 1)), 'end', greatest(a.end, s.last)), a -> a.n)"
    return f"if(size({spans}) = 0, 0L, {step})"


def decontamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Null and empty texts have no words and are clean. Repeated rows get equal
    rows, a null ``doc_id`` passes, items with equal windows are all listed,
    further columns are ignored, texts are taken whole. Without documents the
    result is empty; without benchmark items all documents are clean.
    """
    out, n_words, spans = benchmark_spans(docs.select("doc_id", "text"), benchmark, window)
    out = out.select("doc_id", F.col(n_words).alias("n_words"), F.expr(words_hit(spans)).alias("n_hit"), F.expr(f"array_sort(array_distinct(filter(transform({spans}, s -> s.item), i -> i is not null)))").alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, that no benchmark window occurs in; nulls and repeats as in the report."""
    out, _, spans = benchmark_spans(docs, benchmark, window)
    return out.where(F.size(spans) == 0).select(*quoted(*docs.columns))


#: The same by joining all windows, for small tables.
REPORT_SQL = """
WITH f AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(text, u, l), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark, f),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, u, l), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents, f),
ip AS (SELECT DISTINCT item, k, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM ip),
dp AS (SELECT doc_id, i, k, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
h AS (SELECT dp.doc_id, dp.i, dp.k, ip.item FROM dp JOIN ip ON dp.k = ip.k AND dp.s = ip.s),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
