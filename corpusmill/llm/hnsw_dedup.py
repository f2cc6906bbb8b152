"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Vectors of one label lie in shards of a bounded size, next to the pivot that is
closest to them, and every shard gets a graph. A vector searches its own shard's
graph, and those of all shards whose pivots are no more than a margin further
than its own; vectors travel to graphs, never graphs to each other. Beam and
margin widen, label by label, until an audit against brute force passes; at the
widest, all is compared that a bound on the pivots does not exclude. Pairs that
were found are verified by their cosine in double precision.

Equal vectors are one class, searched once and counted with their number. A
search returns link counts per vector and a spanning forest of its links, so
dense groups don't turn into all their pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import materialize

#: Vectors of a shard, about; links of a node (twice as many on the ground); nodes that a descent begins with, at most.
SHARD, LINKS, START = 6000, 16, 512
#: Pivots of a label, at most: members with the smallest hashes. Larger labels have several shards a pivot.
PIVOTS = 1024
#: Similarity within a tight group.
TIGHT = 0.9
#: Beams in a vector's own shard, by round of its audit; then everything is compared.
BEAMS = (12, 48)
#: Beam and margin of each round of searches in other shards; None compares all that can link.
ROUNDS = ((16, 0.06), (48, 0.2), (None, None))
#: Queries with links that an audit asks for (or it takes all queries), and its recall.
AUDIT, RECALL = 64, 0.97
#: Queries of a label that the audit of other shards draws at random, and among those with links.
DRAWN, LINKED = 1024, 256
#: Queries that one task searches for, and that it searches for at once.
BLOCK, BATCH = 20_000, 1024
#: Room for rounding in single precision, before the exact check.
SLACK = 1e-5


class Graph:
    """A small-world graph over unit vectors, by inner product; layers of linked nodes, the ground first."""

    def __init__(self, v: np.ndarray, links: int = LINKS, seed: int = 9):
        self.v = np.ascontiguousarray(v, dtype=np.float32)
        n = len(v)
        heights = np.floor(-np.log(np.random.Generator(np.random.PCG64(seed)).random(n) + 1e-12) / np.log(links)).astype(int)
        self.nodes, self.near = [], []
        members = np.arange(n, dtype=np.int32)
        while len(members):
            self.nodes.append(members)
            self.near.append(linked(self.v[members], links, 2 * links if len(self.near) == 0 else links))
            if len(members) <= START:  # all of it is compared when a search begins
                break
            members = members[heights[members] >= len(self.nodes)]

    def state(self) -> tuple:
        return self.nodes, self.near

    @classmethod
    def restored(cls, v: np.ndarray, state: tuple) -> Graph:
        g = cls.__new__(cls)
        g.v, (g.nodes, g.near) = np.ascontiguousarray(v, dtype=np.float32), state
        return g

    def descend(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the ground, and their similarities, at which the searches of ``q`` begin."""
        top = self.nodes[-1]
        s = q @ self.v[top].T
        k = min(max(1, beam // 2), len(top))
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        ids, sims = top[at], np.take_along_axis(s, at, 1)
        for layer in range(len(self.nodes) - 2, 0, -1):
            where = np.searchsorted(self.nodes[layer], ids)
            at, sims = beam_search(self.v[self.nodes[layer]], self.near[layer], q, where, sims, max(beam // 2, k))
            ids = np.where(at < 0, -1, self.nodes[layer][at])
        return ids, sims

    def within(self, q: np.ndarray, least: float, beam: int, own: np.ndarray | None = None) -> np.ndarray:
        """Which nodes the searches of the rows of ``q`` find at that similarity.

        The search of a query that is a node itself (``own``) begins there. A
        beam that is full of links is widened to all nodes.
        """
        n = len(self.v)
        hits = np.zeros((len(q), n), dtype=bool)
        for lo in range(0, len(q), BATCH):
            some = np.ascontiguousarray(q[lo : lo + BATCH], dtype=np.float32)
            rows = np.arange(lo, lo + len(some))
            if beam >= n:
                full = rows
            else:
                if own is not None:
                    ids, sims = own[rows][:, None], np.ones((len(some), 1), dtype=np.float32)
                else:
                    ids, sims = self.descend(some, beam)
                ids, sims = beam_search(self.v, self.near[0], some, ids, sims, beam)
                i, j = np.nonzero(sims >= least - SLACK)
                hits[rows[i], ids[i, j]] = True
                full = rows[sims.min(axis=1) >= least - SLACK]
            if len(full):
                hits[full] = q[full].astype(np.float32) @ self.v.T >= least - SLACK
        return hits


def beam_search(v: np.ndarray, near: np.ndarray, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``beam`` nodes that searches from ``ids`` meet, for all queries at once; -1 for none."""
    size = len(q)
    seen = np.zeros((size, len(v)), dtype=bool)
    held = ids >= 0
    seen[np.nonzero(held)[0], ids[held]] = True
    pad = max(0, beam - ids.shape[1])
    ids = np.hstack([ids, np.full((size, pad), -1, dtype=ids.dtype)]).astype(np.int32)
    sims = np.hstack([np.where(held, sims, -np.inf), np.full((size, pad), -np.inf)]).astype(np.float32)
    open_ = ids >= 0
    rows = np.arange(size)
    while len(rows):
        todo = np.where(open_[rows], sims[rows], -np.inf)
        at = todo.argmax(axis=1)
        alive = todo[np.arange(len(rows)), at] > -np.inf
        rows, at = rows[alive], at[alive]
        if not len(rows):
            break
        open_[rows, at] = False
        new = near[ids[rows, at]]
        i, j = np.nonzero(~seen[rows[:, None], new])
        t = new[i, j]
        r = rows[i]
        seen[r, t] = True
        s = np.full(new.shape, -np.inf, dtype=np.float32)
        s[i, j] = np.einsum("ij,ij->i", q[r], v[t])
        both = np.hstack([sims[rows], s])
        best = np.argpartition(-both, beam - 1, axis=1)[:, :beam]
        sims[rows[:, None], np.arange(beam)] = np.take_along_axis(both, best, 1)
        ids[rows[:, None], np.arange(beam)] = np.take_along_axis(np.hstack([ids[rows], np.where(s > -np.inf, new, -1)]), best, 1)
        open_[rows[:, None], np.arange(beam)] = np.take_along_axis(np.hstack([open_[rows], s > -np.inf]), best, 1)
    return np.where(sims > -np.inf, ids, -1)[:, :beam], sims[:, :beam]


def linked(v: np.ndarray, links: int, most: int) -> np.ndarray:
    """For each row its neighbours in the graph, ``most`` places filled up with the row itself.

    A row links to close rows that are closer to it than to any that it links to
    already, then to the closest of the rest. One in a tight group larger than
    that takes half of its links from what surrounds the group. Links go back
    as well, the closest first, where there is room.
    """
    n = len(v)
    k = min(2 * links, n - 1)
    if k < 1:
        return np.zeros((n, most), dtype=np.int32)
    src, dst, sim = [], [], []
    for lo in range(0, n, 512):
        s = v[lo : lo + 512] @ v.T
        own = np.arange(lo, lo + len(s))
        s[np.arange(len(s)), own] = -np.inf
        at, near = _closest(s, k)
        crowded = np.flatnonzero(near[:, -1] >= TIGHT)
        if len(crowded) and k > links:
            s = np.where(s[crowded] >= TIGHT, -np.inf, s[crowded])
            far, far_sim = _closest(s, links)
            at[crowded, k - links :], near[crowded, k - links :] = far, far_sim
        chosen = _spread(v[at], near, links)
        i, j = np.nonzero(chosen & (near > -np.inf))
        src.append(own[i])
        dst.append(at[i, j])
        sim.append(near[i, j])
    a, b, s = np.concatenate(src), np.concatenate(dst), np.concatenate(sim)
    back = np.concatenate([np.zeros(len(a), dtype=np.int8), np.ones(len(a), dtype=np.int8)])
    a, b, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
    _, first = np.unique(a.astype(np.int64) * n + b, return_index=True)  # forward ones come first
    a, b, s, back = a[first], b[first], s[first], back[first]
    order = np.lexsort((-s, back, a))
    a, b = a[order], b[order]
    nth = np.arange(len(a)) - np.searchsorted(a, a, side="left")
    out = np.repeat(np.arange(n, dtype=np.int32)[:, None], most, axis=1)
    some = nth < most
    out[a[some], nth[some]] = b[some]
    return out


def _closest(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.repeat(np.arange(s.shape[1])[None], len(s), axis=0)
    sims = np.take_along_axis(s, at, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(at, order, 1), np.take_along_axis(sims, order, 1)


def _spread(v: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Which of the candidates (rows of ``v`` by query, in order of closeness) are linked to."""
    among = v @ v.transpose(0, 2, 1)
    k = sims.shape[1]
    chosen = np.zeros(sims.shape, dtype=bool)
    for c in range(k):
        blocked = (chosen & (among[:, c] > sims[:, c, None])).any(axis=1)
        chosen[:, c] = ~blocked & (chosen.sum(axis=1) < most)
    rest = np.cumsum(~chosen, axis=1) <= most - chosen.sum(axis=1, keepdims=True)
    return chosen | rest


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one. They are scaled by their largest component first, as squares of very large or small ones leave the doubles."""
    v = v / np.abs(v).max(axis=1, initial=0, keepdims=True)
    return v / np.sqrt((v * v).sum(1))[:, None]


def verified(hits: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Only the pairs of that cosine in double precision."""
    i, j = np.nonzero(hits)
    for k in range(0, len(i), 100_000):
        x, y = i[k : k + 100_000], j[k : k + 100_000]
        hits[x, y] = np.einsum("ij,ij->i", a[x], b[y]) >= least
    return hits


def search_shard(v: np.ndarray, graph: Graph, least: float, beams: tuple[int, ...] = BEAMS) -> tuple[np.ndarray, int, int, int, float | None]:
    """Linked pairs within a shard as a matrix; the beam, audited queries, their true links and the recall of the audit that passed.

    Queries are drawn until ``AUDIT`` of them have links, or there are no more.
    Where the whole shard has no link there is no recall to tell.
    """
    order, met = np.random.Generator(np.random.PCG64(11)).permutation(len(v)), 0
    true = []
    for lo in range(0, len(order), 512):
        some = order[lo : lo + 512]
        t = graph.v[some] @ graph.v.T >= least
        t[np.arange(len(some)), some] = False
        true.append(t)
        met += int(t.any(axis=1).sum())
        if met >= AUDIT:
            break
    true = np.concatenate(true) if true else np.zeros((0, len(v)), dtype=bool)
    audit, links = order[: len(true)], int(true.sum())
    for beam in (*beams, len(v)):
        hits = graph.within(v, least, beam, np.arange(len(v)))
        hits |= hits.T
        np.fill_diagonal(hits, False)
        recall = float((hits[audit] & true).sum() / links) if links else None
        if beam >= len(v) or recall is None or recall >= RECALL:
            break
    return verified(hits, v, v, least), min(beam, len(v)), len(audit), links, recall


def _forest(hits: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Links ``(a, b)`` that connect what all links connect."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(hits)), strict=True):
        x, y = int(a[i]), int(b[j])
        if (p := find(x)) != (q := find(y)):
            parent[p] = q
            out.append((x, y))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64").assign(n=0)


def _packed(v: np.ndarray) -> bytes:
    """In single precision where that is exact."""
    small = v.astype(np.float32)
    return b"f" + small.tobytes() if (small == v).all() else b"d" + v.tobytes()


def _unpacked(v: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(v[1:], dtype=np.float32 if v[:1] == b"f" else np.float64).astype(np.float64).reshape(-1, dim)


def _vectors(column) -> np.ndarray:
    return unit(np.stack(column.to_numpy()).astype(np.float64))


FOUND = "kind string, a long, b long, n long, beam int, audited long, true_links long, recall double, cls binary, times binary, v binary, graph binary"


def _own(pdf: pd.DataFrame, least: float, stored: bool) -> pd.DataFrame:
    """A shard's links within itself, its audit, and the shard with its graph if others are to search it."""
    import pickle

    pdf = pdf.sort_values("cls")
    raw = np.stack(pdf.embedding.to_numpy()).astype(np.float64)
    v, cls, times = unit(raw), pdf.cls.to_numpy(np.int64), pdf.times.to_numpy(np.int64)
    graph = Graph(v)
    hits, beam, audited, true, recall = search_shard(v, graph, least)
    n = hits @ times
    parts = [pd.DataFrame({"a": cls, "b": cls, "n": n})[n > 0].assign(kind="count"), _forest(np.triu(hits), cls, cls).assign(kind="edge"), pd.DataFrame({"kind": ["audit"], "beam": [beam], "audited": [audited], "true_links": [true], "recall": [recall]})]
    if stored:
        blob = pickle.dumps(graph.state(), protocol=5)
        parts.append(pd.DataFrame({"kind": ["graph"], "cls": [cls.tobytes()], "times": [times.tobytes()], "v": [_packed(raw)], "graph": [blob]}))
    return _table(parts, pdf.iloc[0])


def _table(parts: list[pd.DataFrame], first) -> pd.DataFrame:
    """All parts with all columns; long ones never pass through floats."""
    kinds = {"long": "Int64", "int": "Int32", "double": "Float64"}
    whole = []
    for part in parts:
        columns = {}
        for c in FOUND.split(", "):
            name, kind = c.split(" ")
            columns[name] = pd.array(part[name].tolist() if name in part else [None] * len(part), dtype=kinds.get(kind, "object"))
        whole.append(pd.DataFrame(columns))
    return pd.concat(whole).assign(label=first.label, dim=first.dim, shard=first.shard)


def _visit(probes: pd.DataFrame, shards: pd.DataFrame, least: float, beam: int | None) -> pd.DataFrame:
    """What the vectors of ``probes`` link to in one shard."""
    import pickle

    names = ["kind", "a", "b", "n"]
    if not len(probes) or not len(shards):
        return pd.DataFrame(columns=names)
    r = shards.iloc[0]
    v = unit(_unpacked(r.v, int(r.dim)))
    graph = Graph.restored(v, pickle.loads(r.graph))
    b, tb = np.frombuffer(r.cls, np.int64), np.frombuffer(r.times, np.int64)
    right, parts = np.zeros(len(b), dtype=np.int64), []
    for lo in range(0, len(probes), 4 * BATCH):
        some = probes.iloc[lo : lo + 4 * BATCH]
        q, a, ta = _vectors(some.embedding), some.cls.to_numpy(np.int64), some.times.to_numpy(np.int64)
        hits = verified(graph.within(q, least, beam or len(v)), q, v, least)
        left = hits @ tb
        right += ta @ hits
        parts += [pd.DataFrame({"a": a, "b": a, "n": left})[left > 0].assign(kind="count"), _forest(hits, a, b).assign(kind="edge")]
    parts.append(pd.DataFrame({"a": b, "b": b, "n": right})[right > 0].assign(kind="count"))
    return pd.concat(parts).astype({"a": "int64", "b": "int64", "n": "int64"})[names]


def _visitor(least: float, beam: int | None):
    return lambda probes, shards: _visit(probes, shards, least, beam)


def _routed(rows: pd.DataFrame, pivots: pd.DataFrame, margin: float | None, least: float) -> pd.DataFrame:
    """The pivot that each vector is closest to, and the others that its links may be closest to."""
    p = _vectors(pivots.sort_values("cls").embedding) if len(pivots) else np.zeros((1, 1))
    apart = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T) * (2 - 2 * least)) + 1e-9
    cell, others = [], []
    for lo in range(0, len(rows), BATCH):
        part = rows.iloc[lo : lo + BATCH]
        s = _vectors(part.embedding) @ p.T
        home = s.argmax(axis=1)
        gap = s[np.arange(len(s)), home][:, None] - s
        # |x - y|**2 = 2 - 2 cos, so no link of a vector is further behind another pivot than that
        near = gap <= (apart[home] if margin is None else np.minimum(apart[home], margin))
        near[np.arange(len(s)), home] = True
        cell += home.tolist()
        others += [np.flatnonzero(x).tolist() for x in near]
    return rows[["label", "dim", "cls", "times", "embedding"]].assign(cell=np.array(cell, dtype=np.int32), others=others)


def _true(asked: pd.DataFrame, shards: pd.DataFrame, least: float) -> pd.DataFrame:
    """Rows of a shard that each audited vector truly links to."""
    if not len(asked) or not len(shards):
        return pd.DataFrame({"cls": [], "n": []}).astype("int64")
    r = shards.iloc[0]
    v, q, cls = unit(_unpacked(r.v, int(r.dim))), _vectors(asked.embedding), np.frombuffer(r.cls, np.int64)
    a = asked.cls.to_numpy(np.int64)
    hits = verified(q.astype(np.float32) @ v.astype(np.float32).T >= least - SLACK, q, v, least) & (a[:, None] != cls[None, :])
    return pd.DataFrame({"cls": a, "n": hits @ np.frombuffer(r.times, np.int64)})


VALID = "label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and x = x and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
KEY = ["label", "dim"]


def _anew(df: DataFrame) -> DataFrame:
    """The same under new column ids, so that both sides of a join may descend from it."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def _share(c: str, seed: int, part) -> F.Column:
    """Whether the hash of a row falls into that part of all hashes."""
    return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1 << 30)) < part * float(1 << 30)


def vector_links(vectors: DataFrame, least: float = 0.93, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(vec_id, cls, times)`` of every row, what the searches found, and their audits.

    The second table has a row ``(a, a, n)`` of kind ``count`` for the ``n``
    linked rows that class ``a`` has in a shard, and rows ``(a, b)`` of kind
    ``edge`` for a spanning forest of links. Audits tell by label, shard and
    round how many queries were compared with everything, how many true links
    those have, and the share found; it is null, and not 1, where there is none.
    """
    rows = vectors.select("vec_id", "label", "embedding", F.expr(f"coalesce({VALID}, false)").alias("ok"))
    key = F.xxhash64(F.lit(9), "label", F.size("embedding"), "embedding")
    rows = rows.withColumn("cls", F.when(F.col("ok"), key)).withColumn("dim", F.size("embedding"))
    kind = rows.schema["label"].dataType.simpleString()
    item = rows.schema["embedding"].dataType.simpleString()
    classes = rows.where("ok").groupBy("cls").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("embedding").alias("embedding"), F.count("*").alias("times"))
    classes = materialize(classes, "vectors")
    ids = rows.join(classes.select("cls", "times"), "cls", "left").select("vec_id", "cls", "times")
    sizes = classes.groupBy(KEY).agg(F.count("*").alias("size")).withColumn("ways", F.ceil(F.col("size") / shard))
    found_kind = f"label {kind}, dim int, shard long, {FOUND}"

    small = classes.join(sizes.where("ways = 1").select(KEY), KEY, "left_semi").withColumn("shard", F.lit(0).cast("long"))
    own = small.groupBy(KEY).applyInPandas(lambda pdf: _own(pdf, least, False), found_kind)
    audit_columns = [*KEY, "shard", "beam", "audited", "true_links", "recall"]
    large = materialize(sizes.where("ways > 1"), "large")
    if not large.take(1):
        own = materialize(own, "searched")
        return ids, own.where("kind <> 'audit'").select("kind", "a", "b", "n"), own.where("kind = 'audit'").select(*audit_columns, F.lit(0).alias("round"))

    members = classes.join(large, KEY)
    wanted = F.least("ways", F.lit(PIVOTS))
    # twice as many as are wanted, of which the smallest hashes stay; some always do
    some = members.where(_share("cls", 21, 2 * wanted / F.col("size") + 16 / F.col("size"))).groupBy(*KEY, "ways").agg(F.array_sort(F.collect_list(F.struct("cls", "embedding"))).alias("p"))
    pivots = materialize(some.select(*KEY, F.expr(f"inline(slice(p, 1, cast(least(ways, {PIVOTS}) as int)))")), "pivots")
    members = members.select(*KEY, "cls", "times", "embedding", F.pmod(F.xxhash64("cls", F.lit(23)), F.ceil(F.col("size") / BLOCK)).alias("block"))
    blocks = large.select(*KEY, F.explode(F.expr(f"sequence(0L, ceil(size / {BLOCK}) - 1)")).alias("block"))
    members = materialize(members, "members")
    dealt = pivots.join(blocks, KEY)
    route_kind = f"label {kind}, dim int, cls long, times long, embedding {item}, cell int, others array<int>"

    def routed(left: DataFrame, margin: float | None) -> DataFrame:
        a, b = (_anew(x).groupBy(*KEY, "block") for x in (left, dealt.join(left.select(*KEY).distinct(), KEY, "left_semi")))
        return materialize(a.cogroup(b).applyInPandas(lambda p, q: _routed(p, q, margin, least) if len(p) else pd.DataFrame(columns=["label", "dim", "cls", "times", "embedding", "cell", "others"]), route_kind), "routed")

    first = routed(members, ROUNDS[0][1])
    cells = materialize(first.groupBy(*KEY, "cell").agg(F.ceil(F.count("*") / shard).cast("long").alias("subs")), "cells")
    # a shard's number tells its pivot, and which part of the pivot's vectors it has
    at_home = lambda r: r.join(cells, [*KEY, "cell"]).withColumn("shard", F.col("cell") * F.lit(1 << 20).cast("long") + F.pmod(F.xxhash64("cls", F.lit(4)), F.col("subs")))
    homes = at_home(first.drop("others")).groupBy(*KEY, "shard").applyInPandas(lambda pdf: _own(pdf, least, True), found_kind)
    index = materialize(own.unionByName(homes), "index")
    graphs = index.where("kind = 'graph'").select(*KEY, "shard", "cls", "times", "v", "graph")
    shards = cells.select(*KEY, F.col("cell").alias("to"), F.explode(F.expr(f"transform(sequence(0L, subs - 1), s -> cell * {1 << 20}L + s)")).alias("target"))
    found = index.where("kind in ('count', 'edge')").select("kind", "a", "b", "n")
    audits = index.where("kind = 'audit'").select(*audit_columns, F.lit(0).alias("round"))

    # the same queries are audited in every round: some of all, and some of those with links
    counts = found.where("kind = 'count'").select(F.col("a").alias("cls")).distinct()
    with_links = members.join(counts, "cls", "left_semi")
    n_linked = with_links.groupBy(KEY).agg(F.count("*").alias("n_linked"))
    drawn = members.join(large, KEY).where(_share("cls", 25, DRAWN / F.col("size"))).select(*KEY, "cls", "embedding")
    drawn = drawn.unionByName(with_links.join(n_linked, KEY).where(_share("cls", 26, LINKED / F.col("n_linked"))).select(*KEY, "cls", "embedding")).distinct()
    asked = drawn.join(graphs.select(*KEY, "shard"), KEY)
    true = _anew(asked).groupBy(*KEY, "shard").cogroup(graphs.groupBy(*KEY, "shard")).applyInPandas(lambda a, s: _true(a, s, least), "cls long, n long")
    true = materialize(drawn.select(*KEY, "cls").join(true.groupBy("cls").agg(F.sum("n").alias("true")), "cls"), "true")

    left = members
    for i, (beam, margin) in enumerate(ROUNDS):
        paths = first if i == 0 else routed(left, margin)
        probes = at_home(paths).withColumn("to", F.explode("others")).join(shards, [*KEY, "to"])
        # of two shards, one's vectors visit the other
        visits = F.when((F.col("shard") + F.col("target")) % 2 == 0, F.col("shard") < F.col("target")).otherwise(F.col("shard") > F.col("target"))
        probes = probes.where(visits).select(*KEY, F.col("target").alias("shard"), "cls", "times", "embedding")
        loads = probes.groupBy(*KEY, "shard").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
        jobs = probes.join(loads, [*KEY, "shard"]).withColumn("part", F.pmod(F.xxhash64("cls", F.lit(27)), F.col("parts")))
        held = graphs.join(loads, [*KEY, "shard"]).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
        met = _anew(jobs).groupBy(*KEY, "shard", "part").cogroup(held.groupBy(*KEY, "shard", "part")).applyInPandas(_visitor(least, beam), "kind string, a long, b long, n long")
        met = materialize(met, "met")
        got = found.unionByName(met).where("kind = 'count'").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("got"))
        judged = true.join(got, "cls", "left").groupBy(KEY).agg(F.count("*").alias("audited"), F.sum("true").alias("true_links"), F.sum(F.least("true", F.coalesce("got", F.lit(0)))).alias("got"))
        judged = judged.withColumn("recall", F.when(F.col("true_links") > 0, F.col("got") / F.col("true_links")))
        # without a true link there is no recall to tell: that passes only where every class was asked
        missed = F.coalesce(F.col("recall") < RECALL, F.col("audited") < F.col("size"))
        judged = materialize(judged.join(left.select(KEY).distinct(), KEY, "left_semi").join(large.select(*KEY, "size"), KEY).withColumn("failed", missed & F.lit(beam is not None)), "audits")
        audits = audits.unionByName(judged.select(*KEY, F.lit(None).cast("long").alias("shard"), F.lit(beam).cast("int").alias("beam"), "audited", "true_links", "recall", F.lit(i + 1).alias("round")))
        failed = judged.where("failed").select(KEY)
        if not failed.take(1):
            found = found.unionByName(met)
            break
        again = materialize(left.join(failed, KEY, "left_semi"), "again")
        # labels that passed keep what they met; the others search anew
        found = found.unionByName(met.join(again.select(F.col("cls").alias("a")), "a", "left_anti").select("kind", "a", "b", "n"))
        left = again
    return ids, found, audits


def embedding_near_dedup(vectors: DataFrame, least: float = 0.93, shard: int = SHARD) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors link when they have equal labels and dimensions and a cosine of
    ``least`` or more. Null and zero vectors, vectors with null or non-finite
    components, and rows without a label link with nothing. Equal vectors always
    link. ``component_id`` is the smallest ``vec_id`` reachable; a null
    ``vec_id`` takes part without being one. Repeated rows are rows of their own,
    ties at exactly ``least`` are links, further columns are ignored. An empty
    table gives an empty result.
    """
    rows, found, _ = vector_links(vectors, least, shard)
    counts = found.where("kind = 'count'").groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "cls")
    roots = components(found.where("kind = 'edge'")).withColumnRenamed("node", "cls")
    rows = rows.join(counts, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    low = rows.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("low"))
    rows = rows.join(low, "root", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("low")).cast("long")
    out = rows.select("vec_id", F.coalesce(F.col("times") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: The same by comparing all pairs of a label, for small tables.
REPORT_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT vec_id, label, list_transform(v, lambda x: x / list_max(list_transform(v, lambda y: abs(y)))) AS v FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, least(e.vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = e.vec_id), e.vec_id)) AS component_id FROM e)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM c
"""
