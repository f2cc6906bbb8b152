"""N-gram Jaccard self-join with vertical partitioning (exact).

The word n-grams of all documents are put into one global order, that of their
64-bit hashes, and the order is cut into fragments. Two sets whose union is
``u`` and whose similarity reaches the threshold differ in at most
``(1 - t) * u`` n-grams, so among more fragments than that at least one fragment
is the same in both. Equal fragments find the candidates, without loss; partial
overlaps of a candidate pair are then counted fragment by fragment and summed.

Candidates are never expanded into all pairs of a group:

1. sets that are equal collapse into one class;
2. in every bucket of equal fragments the classes are compared with the
   smallest one (as many pairs as rows);
3. buckets whose classes did not all end up in one component form clusters,
   which are compared exhaustively, block against block, by matrix products
   over the fragments; a block pair returns a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .components import components
from .shared import BLOOM_BITS, bloom, forget, fresh, in_bloom, integral_ids, materialize, quoted, small_batches

U = np.uint64
#: Ratio of the bounds of neighbouring size levels.
WIDTH = 1.5
#: Mask of a signature's level.
LEVELS = 127
#: n-grams of a fragment for counting; n-grams and sets of a block of the exhaustive step.
PART, BLOCK, MEMBERS = 64, 100_000, 1000


class Plan:
    """Size levels and fragment counts for a threshold of ``num / den``."""

    def __init__(self, num: int, den: int, part: int = PART, block: int = BLOCK):
        if not 0 < num <= den:
            raise ValueError("the threshold must be in (0, 1]")
        self.num, self.den, self.part, self.block = num, den, part, block
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(int(bounds[-1] * max(WIDTH, den / num)) + 1, bounds[-1] + 1))
        self.bounds = np.array(bounds)

    def differ(self, n: int) -> int:
        """Most n-grams in which a set of ``n`` can differ from a linked set that is no smaller."""
        return (self.den - self.num) * n // self.num

    def levels(self, n: int) -> Iterator[tuple[int, int, int]]:
        """(level, fragments, most fragments that differ from a linked set) at which a set of ``n`` is looked up."""
        k = int(np.searchsorted(self.bounds, n, side="right")) - 1
        for level in (k, k - 1):
            if level < 0 or (level < k and self.num * n > self.den * int(self.bounds[k] - 1)):
                continue
            most = self.differ(int(self.bounds[level + 1]) - 1)
            if least := min(most, self.differ(n)):  # else only equal sets link, and those are one class
                yield level, most + 3 + most // 8, least


def cut(s: np.ndarray, m: int) -> np.ndarray:
    """Ends of ``m`` equal ranges of the hash order within the sorted set ``s``."""
    where = (s >> U(32)) * U(m) >> U(32)
    return np.searchsorted(where, np.arange(m + 1, dtype=U))


def _full(s: np.ndarray, m: int, differ: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Cuts, the fragments to look the set up under, and how many of them it shares with any linked set."""
    at = cut(s, m)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full) <= differ:  # so few fragments hold something that the equal ones may be empty, and the partner not list those
        return at, np.arange(m), 1
    return at, full, len(full) - differ


def signatures(s: np.ndarray, plan: Plan) -> np.ndarray:
    """Hashes of the fragments under which the set is looked up; the low bits hold the level."""
    out = []
    sums = np.zeros(len(s) + 1, dtype=U)
    np.cumsum(words.mix(s), out=sums[1:])
    for level, m, differ in plan.levels(len(s)):
        at, full, _ = _full(s, m, differ)
        key = (full.astype(U) << U(8)) + U(level)
        sig = words.mix((sums[at[full + 1]] - sums[at[full]]) ^ words.mix(key))
        out.append(sig & ~U(LEVELS) | U(level))
    return np.concatenate(out) if out else np.zeros(0, dtype=U)


def shared_least(s: np.ndarray, plan: Plan) -> list[dict]:
    """Per level the number of signatures that a set has in common with any linked set, at least."""
    return [{"level": level, "least": _full(s, m, differ)[2]} for level, m, differ in plan.levels(len(s))]


def class_of(s: np.ndarray) -> int:
    h = words.mix(words.mix(s ^ U(0xA24BAED4963EE407)).sum(dtype=U).reshape(1) + U(len(s)))
    return int(h.view(np.int64)[0])


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    for start, group in words.batches(texts):
        for i, s in enumerate(words.shingle_sets(group, k)):
            yield start + i, s


class _Recent:
    """A fixed number of slots for classes that a task has met; saves repeated rows, decides nothing."""

    def __init__(self, bits: int = 16):
        self.slots, self.mask = {}, (1 << bits) - 1

    def new(self, c: int) -> bool:
        if self.slots.get(c & self.mask) == c:
            return False
        self.slots[c & self.mask] = c
        return True


def classes_of(docs: DataFrame, k: int, plan: Plan) -> DataFrame:
    """``(doc_id, th, n, cls, needs)`` per row: ``th`` is a hash of the text, ``cls`` null for a text without words."""
    needs_type = pa.list_(pa.struct([("level", pa.int32()), ("least", pa.int32())]))

    def run(it):
        for batch in it:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            cls, needs = [None] * batch.num_rows, [[]] * batch.num_rows
            for i, s in _sets(batch, k):
                n[i] = len(s)
                if len(s):
                    cls[i], needs[i] = class_of(s), shared_least(s, plan)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n), pa.array(cls, pa.int64()), pa.array(needs, needs_type)], ["doc_id", "th", "n", "cls", "needs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, th long, n long, cls long, needs array<struct<level:int,least:int>>")


def signature_rows(docs: DataFrame, k: int, plan: Plan) -> DataFrame:
    def run(it):
        recent = _Recent()
        for batch in it:
            sigs, owners = [], []
            size = 0
            for _, s in _sets(batch, k):
                if len(s) and recent.new(c := class_of(s)):
                    sigs.append(signatures(s, plan))
                    owners.append(np.full(len(sigs[-1]), c, dtype=np.int64))
                    size += len(sigs[-1])
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(owners))], ["sig", "cls"])
                    sigs, owners, size = [], [], 0
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(owners))], ["sig", "cls"])

    return docs.select("text").mapInArrow(run, "sig long, cls long")


def _cuts(n: int, plan: Plan) -> list[int]:
    low, high = ((-(-x // plan.part) - 1).bit_length() for x in (n, plan.den * n // plan.num))
    return [1 << k for k in range(low, high + 1)]


def fragment_rows(docs: DataFrame, k: int, plan: Plan, wanted: bytes) -> DataFrame:
    """``(cls, n, m, frag, part, own)`` of the classes that the bitmap ``wanted`` holds."""
    bits = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(it):
        recent = _Recent()
        has = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in it:
            out = {x: [] for x in ("cls", "n", "m", "frag", "part", "own")}
            size = 0
            for _, s in _sets(batch, k):
                if not len(s) or not has[(c := class_of(s)) & (BLOOM_BITS - 1)] or not recent.new(c):
                    continue
                for j, m in enumerate(_cuts(len(s), plan)):
                    at = cut(s, m)
                    for f in np.flatnonzero(at[1:] > at[:-1]).tolist():
                        part = s[at[f] : at[f + 1]].view(np.int64)
                        size += len(part)
                        for x, v in zip(out, (c, len(s), m, f, part, j == 0), strict=True):
                            out[x].append(v)
                if size > 500_000:
                    yield _fragments(out)
                    out, size = {x: [] for x in out}, 0
            if out["cls"]:
                yield _fragments(out)

    return docs.select("text").mapInArrow(run, "cls long, n long, m int, frag int, part array<bigint>, own boolean")


def _fragments(out: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out["cls"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["m"], pa.int32()), pa.array(out["frag"], pa.int32()), pa.array(out["part"], pa.list_(pa.int64())), pa.array(out["own"], pa.bool_())], list(out))


def _m(n: str, part: int) -> str:
    """SQL for the number of counting fragments of a set of ``n``."""
    return f"if({n} <= {part}, 1, shiftleft(1, length(bin(({n} - 1) div {part}))))"


def _linked(plan: Plan, o: str, a: str, b: str) -> str:
    return f"{plan.den} * {o} >= {plan.num} * ({a} + {b} - {o})"


def overlaps(pairs: DataFrame, parts: DataFrame, plan: Plan) -> DataFrame:
    """Partial overlaps per fragment, summed per pair; the linked pairs ``(a, b)``."""
    jobs = pairs.select("a", "b", "na", "nb", F.expr(_m("greatest(na, nb)", plan.part)).alias("m")).withColumn("frag", F.explode(F.expr("sequence(0, m - 1)")))
    left = parts.select(F.col("cls").alias("a"), "m", "frag", F.col("part").alias("pa"))
    right = parts.select(F.col("cls").alias("b"), "m", "frag", F.col("part").alias("pb"))
    each = jobs.join(left, ["a", "m", "frag"]).join(right, ["b", "m", "frag"])
    each = each.select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).cast("long").alias("o"))
    return each.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o")).where(_linked(plan, "o", "na", "nb")).select("a", "b")


def count_blocks(pdf, plan: Plan):
    """Spanning forest of the links between two blocks (or within one) across components."""
    import pandas as pd

    sides = []
    for side in (0, 1):
        rows = pdf[pdf.side == side]
        ids, at = np.unique(rows.cls.to_numpy(), return_inverse=True)
        n, comp = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        n[at], comp[at] = rows.n.to_numpy(), rows.comp.to_numpy()
        lens = rows.part.map(len).to_numpy() if len(rows) else np.zeros(0, dtype=np.int64)
        sides.append((ids, n, comp, np.repeat(at, lens), np.concatenate(list(rows.part)) if len(rows) else np.zeros(0, dtype=np.int64)))
    same = not len(sides[1][0])
    a, b = sides[0], sides[0] if same else sides[1]
    cols = np.intersect1d(a[4], b[4])
    shared = np.zeros((len(a[0]), len(b[0])), dtype=np.float32)

    def index(side):
        c = np.searchsorted(cols, side[4])
        ok = (c < len(cols)) & (cols[np.minimum(c, max(len(cols) - 1, 0))] == side[4]) if len(cols) else np.zeros(len(side[4]), dtype=bool)
        order = np.argsort(c[ok], kind="stable")
        return c[ok][order], side[3][ok][order]

    (ca, da), (cb, db) = index(a), index(b)
    step = max(64, 2_000_000 // (1 + len(a[0]) + len(b[0])))
    for lo in range(0, len(cols), step):  # fragments of the order, counted one after the other
        i, j = np.searchsorted(ca, (lo, lo + step)), np.searchsorted(cb, (lo, lo + step))
        x, y = np.zeros((len(a[0]), step), dtype=np.float32), np.zeros((len(b[0]), step), dtype=np.float32)
        x[da[i[0] : i[1]], ca[i[0] : i[1]] - lo] = 1
        y[db[j[0] : j[1]], cb[j[0] : j[1]] - lo] = 1
        shared += x @ y.T
    o = shared.astype(np.int64)
    p, q = np.nonzero(plan.den * o >= plan.num * (a[1][:, None] + b[1][None, :] - o))
    parent: dict[int, int] = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for i, j in zip(p.tolist(), q.tolist(), strict=True):
        ri, rj = find(int(a[2][i])), find(int(b[2][j]))
        if ri != rj:
            parent[ri] = rj
            out.append((int(a[0][i]), int(b[0][j])))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def ngram_groups(docs: DataFrame, n: int, num: int, den: int, part: int = PART, block: int = BLOCK) -> DataFrame:
    """``(doc_id, th, n, root)`` per row; rows of one group of linked texts have one ``root``, null without words."""
    plan = Plan(num, den, part, block)
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = materialize(classes_of(docs, n, plan), "classes")
    sizes = rows.where("cls is not null").groupBy("cls").agg(F.first("n").alias("n"), F.min("doc_id").alias("low"), F.first("needs").alias("needs"))
    sizes = materialize(sizes, "sizes")

    # buckets are known by their smallest and largest class, so that none meets in one place
    bounds = lambda rows: rows.groupBy("sig").agg(F.min("cls").alias("hub"), F.max("cls").alias("top")).where("hub < top")
    listed = signature_rows(docs, n, plan).repartition("sig")  # moved once, for both uses
    multi = listed.join(bounds(listed), "sig").select("sig", "cls").distinct()
    buckets = materialize(multi.withColumn("level", F.expr(f"cast(sig & {LEVELS}L as int)")), "buckets")
    # a linked set shares a known number of signatures; classes that share fewer with all others leave
    needs = sizes.select("cls", F.inline("needs")).where("least > 1")
    few = buckets.groupBy("cls", "level").agg(F.count("*").alias("k")).join(needs, ["cls", "level"]).where("k < least").select("cls", "level")
    likely = materialize(buckets.join(few, ["cls", "level"], "left_anti").select("sig", "cls"), "likely")
    forget(buckets)
    multi = materialize(likely.join(bounds(likely), "sig"), "candidates")
    forget(likely)

    pairs = multi.where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    pairs = pairs.join(sizes.select(F.col("cls").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("cls").alias("b"), F.col("n").alias("nb")), "b")
    pairs = materialize(pairs.where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)"), "pairs")
    wanted = bloom(multi.select("cls"))
    parts = materialize(fragment_rows(docs, n, plan, wanted).dropDuplicates(["cls", "m", "frag"]), "fragments")

    links = materialize(overlaps(pairs, parts, plan), "links")
    forget(pairs)
    found = materialize(components(links), "found")
    more = _exhaustive(multi, found, sizes, parts, plan)
    forget(multi, parts, sizes, found)
    final = components(links.unionByName(more)).withColumnRenamed("node", "cls")
    forget(links, more)

    return rows.join(final, "cls", "left").select("doc_id", "th", "n", F.coalesce("root", "cls").alias("root"))


def ngram_jaccard_join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, **sizes: int) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``.

    Documents link when ``den * |A & B| >= num * |A | B|`` over the sets of
    distinct ``n``-word shingles; a text of fewer words is one shingle.
    ``component_id`` is the smallest ``doc_id`` reachable by links.

    Null and empty texts have no shingles and link with nothing. Repeated rows
    (equal ``doc_id`` too) are separate rows of one class. A null ``doc_id``
    takes part and never is a smallest id; without any other it stays null.
    Further columns are ignored, texts are taken whole, and a pair at exactly the
    threshold is a link. An empty table gives an empty result. Classes are told apart by 64-bit hashes of their sets.
    """
    rows = materialize(ngram_groups(docs, n, num, den, **sizes), "groups")
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each_group(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one of each group of linked texts.

    The smallest ``doc_id`` stays (a null one only where there is no other).
    Texts without words (null and empty ones too) all stay; of rows that repeat,
    one does. All columns pass, whatever their names. ``doc_id`` must be an
    integer column (an error otherwise). An empty table gives an empty result.
    """
    integral_ids(docs)
    d, th, h, nth = (fresh(x, docs.columns) for x in ("d", "th", "h", "nth"))
    key = F.expr("coalesce(cast(doc_id as long), -9223372036854775808L)")
    rows = materialize(ngram_groups(docs, n, num, den), "groups")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    best = rows.where("root is not null").groupBy("root").agg(F.min(rank).alias("best"))
    told = rows.join(best, "root", "left").select(key.alias(d), F.col("th").alias(th), F.coalesce(rank != F.col("best"), F.lit(False)).alias("gone"))
    told = told.groupBy(d, th).agg(F.first("gone").alias("gone"), (F.count("*") > 1).alias("repeated")).withColumn(h, F.xxhash64(d, th))
    told = materialize(told, "told")
    forget(rows)
    # two bitmaps of fixed size settle nearly all rows where they are: those that share no bit with a row to look at stay, and
    # of the others those that share none with a row that isn't simply gone go; only the rest is dealt with its texts
    some = bloom(told.where("gone or repeated").select(h))
    open_ = bloom(told.where(in_bloom(h, some) & ~F.col("gone")).select(h))
    each = docs.withColumn(d, key).withColumn(th, F.xxhash64("text")).withColumn(h, F.xxhash64(d, th))
    plain = each.where(~in_bloom(h, some))
    gone = told.where(F.col("gone") & in_bloom(h, open_)).select(d, th)
    left = each.where(in_bloom(h, some) & in_bloom(h, open_)).join(gone.hint("shuffle_hash"), [d, th], "left_anti")
    left = left.withColumn(nth, F.row_number().over(Window.partitionBy(d, th).orderBy(F.lit(1))))
    left = left.where((F.col(nth) == 1) | ~F.coalesce(F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"), F.lit(False)))
    return plain.select(*quoted(*docs.columns)).unionByName(left.select(*quoted(*docs.columns)))


def _exhaustive(multi: DataFrame, found: DataFrame, sizes: DataFrame, parts: DataFrame, plan: Plan) -> DataFrame:
    """Links that comparing with the smallest class of each bucket has not decided."""
    each = multi.join(found.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("comp", F.coalesce("root", "cls"))
    each = materialize(each.select("sig", "cls", "hub", "top", "comp"), "placed")
    undecided = each.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.expr("cls <> hub and cls <> top")).alias("inner")).where("lo <> hi and inner")
    open_ = materialize(each.join(undecided.select("sig"), "sig", "left_semi").select("cls", "comp", "hub").distinct(), "open")
    clusters = components(open_.select(F.col("cls").alias("a"), F.col("hub").alias("b"))).select(F.col("node").alias("cls"), F.col("root").alias("cluster"))
    members = clusters.join(sizes.select("cls", "n"), "cls").join(found.select(F.col("node").alias("cls"), "root"), "cls", "left")
    members = members.select("cluster", "cls", "n", F.coalesce("root", "cls").alias("comp"), F.floor(F.log2(F.col("n").cast("double")) * 4).cast("int").alias("size"))
    # sets of about one size are dealt into blocks by hash
    loads = members.groupBy("cluster", "size").agg(F.ceil(F.greatest(F.sum("n") * 1.5 / plan.block, F.count("*") * 1.5 / MEMBERS)).alias("ways"))
    members = members.join(loads, ["cluster", "size"]).withColumn("block", F.col("size") * F.lit(1 << 32) + F.pmod(F.xxhash64("cls", F.lit(6)), F.col("ways")))
    members = materialize(members.select("cluster", "cls", "n", "comp", "block"), "members")
    spans = members.groupBy("cluster", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    i, j = spans.alias("i"), spans.alias("j")
    duels = i.join(j, F.expr(f"i.cluster = j.cluster and i.block <= j.block and {plan.den} * i.hi >= {plan.num} * j.lo and {plan.den} * j.hi >= {plan.num} * i.lo")).selectExpr("i.cluster", "i.block as bi", "j.block as bj")
    first = members.join(duels.withColumn("block", F.col("bi")), ["cluster", "block"]).withColumn("side", F.lit(0))
    second = members.join(duels.where("bi < bj").withColumn("block", F.col("bj")), ["cluster", "block"]).withColumn("side", F.lit(1))
    jobs = first.unionByName(second).select("cluster", "bi", "bj", "side", "cls", "comp", "n")
    jobs = jobs.join(parts.where("own").select("cls", "part"), "cls")
    more = materialize(jobs.groupBy("cluster", "bi", "bj").applyInPandas(lambda pdf: count_blocks(pdf, plan), "a long, b long"), "more")
    forget(each, open_, members)
    return more


#: The same by comparing all pairs, for small tables.
REPORT_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""
