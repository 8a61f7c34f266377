"""The k most similar vectors of every vector, over balanced posting lists.

Equal vectors are folded into classes first. A bounded sample is split by a balanced tree into leaves whose means are the
centroids; leaf numbers follow the tree, so a run of them (a shard) is one region. Every vector is indexed: it joins its
nearest list and, at a boundary, the others whose centroid is nearly as near. The centroids are searched by a graph held in
memory. A query visits the lists whose centroid distance is within a ratio of the nearest one. Vectors and queries travel to
a shard once, with their lists; there each list is searched exactly, and the shards' answers are merged by query."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm.topn import top_n
from kelpie.operators.arrowrun import starts
from kelpie.sources.tables import durable


@dataclass(frozen=True)
class Params:
    """list_size: vectors a list aims at. max_lists, train_rows, most_rows: bounds of the centroids and of the sample they are
    fitted on, `train_rows` for each list, `most_rows` in all (the index itself holds every row). Lists have equal shares of
    the sample, so they stay level wherever vectors crowd; beyond max_lists * list_size vectors of a space (4.2 million) lists
    grow in proportion, and the cost of a query with them. near: how much farther than the nearest centroid another may be for
    a boundary vector to join it as well, and joins the most lists it may join. ratio, probes: the same for the lists a query
    visits. lists_per_shard: lists kept together."""

    list_size: int = 64
    max_lists: int = 65_536
    train_rows: int = 32
    most_rows: int = 262_144
    near: float = 0.10
    joins: int = 4
    ratio: float = 0.45
    probes: int = 32
    lists_per_shard: int = 32
    seed: int = 7


def balanced_leaves(x: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Centroids of `lists` (a power of two) equally large leaves of a two-means tree, in the order of its leaves."""
    rng = np.random.default_rng(seed)

    def split(rows: np.ndarray, parts: int) -> list[np.ndarray]:
        if parts == 1 or len(rows) < 2:
            return [x[rows].mean(0)] * parts if len(rows) else []
        pts = x[rows]
        a, b = pts[rng.choice(len(rows), 2, replace=False)]
        for _ in range(6):
            side = pts @ (b - a)
            cut = np.median(side)
            low = side <= cut
            if low.all() or not low.any():
                break
            a, b = pts[low].mean(0), pts[~low].mean(0)
        order = np.argsort(pts @ (b - a), kind="stable")
        half = len(rows) // 2
        return split(rows[order[:half]], parts // 2) + split(rows[order[half:]], parts // 2)

    return np.array(split(np.arange(len(x)), lists))


@dataclass
class Graph:
    """Centroids, their nearest neighbours and far-spread entry points."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @staticmethod
    def build(c: np.ndarray, degree: int = 16, entries: int = 32) -> Graph:
        k = len(c)
        links = np.zeros((k, min(degree, max(k - 1, 1))), np.int32)
        norm = (c**2).sum(1)
        block = max(64, min(1024, (1 << 24) // k))
        for lo in range(0, k, block):
            d = norm[None] - 2 * c[lo : lo + block] @ c.T
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            links[lo : lo + block] = np.argpartition(d, min(links.shape[1], k - 1), 1)[:, : links.shape[1]]
        at, far = [0], np.full(k, np.inf)
        while len(at) < min(entries, k):
            far = np.minimum(far, ((c - c[at[-1]]) ** 2).sum(1))
            at.append(int(far.argmax()))
        return Graph(c, links, np.array(sorted(set(at)), np.int32))

    def search(self, q: np.ndarray, want: int, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """For each query the nearest `want` centroids found, nearest first: (numbers, distances); -1 where there are fewer.

        All queries of a block walk the graph together: each round they open their `width` nearest centroids that are not
        opened yet, until the pool of the nearest holds opened ones only."""
        k, block = len(self.centroids), max(16, min(1024, (1 << 24) // len(self.centroids)))
        parts = [self._walk(q[lo : lo + block].astype(np.float32), min(want, k), width) for lo in range(0, len(q), block)]
        ids, dist = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros((0, min(want, k)), np.int32), np.zeros((0, min(want, k))))
        return ids, dist

    def _walk(self, q: np.ndarray, want: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        c = self.centroids.astype(np.float32)
        norm, qn = (c * c).sum(1), (q * q).sum(1)[:, None]
        pool = min(len(c), max(want + 16, 48))
        row = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(c)), bool)  # one for the block, which is cut so that this stays small
        seen[:, self.entries] = True
        ids = np.repeat(self.entries[None], len(q), 0)
        dist = qn + norm[self.entries][None] - 2 * q @ c[self.entries].T
        todo = dist.copy()  # the distance while an entry is not opened, infinite afterwards
        while True:
            if ids.shape[1] > pool:
                near = np.argpartition(dist, pool - 1, 1)[:, :pool]
                ids, dist, todo = ids[row, near], dist[row, near], todo[row, near]
            n = min(width, ids.shape[1])
            pick = np.argpartition(todo, n - 1, 1)[:, :n] if n < ids.shape[1] else np.repeat(np.arange(n)[None], len(q), 0)
            live = np.isfinite(todo[row, pick])
            on = np.flatnonzero(live.any(1))
            if not len(on):
                break
            at = ids[row, pick]
            todo[row, pick] = np.inf
            new = np.where(live[on][:, :, None], self.links[at[on]], at[on][:, :, None]).reshape(len(on), -1)
            new.sort(1)
            fresh = ~seen[on[:, None], new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            seen[on[:, None], new] = True
            d = np.full((len(q), new.shape[1]), np.inf, np.float32)
            i, j = np.nonzero(fresh)
            cand = new[i, j]
            d[on[i], j] = qn[on[i], 0] + norm[cand] - 2 * np.einsum("nd,nd->n", q[on[i]], c[cand])
            wide = np.zeros((len(q), new.shape[1]), np.int32)
            wide[on] = new
            ids, dist, todo = np.hstack([ids, wide]), np.hstack([dist, d]), np.hstack([todo, d])
        order = np.argsort(dist, 1, kind="stable")[:, :want]
        ids, dist = ids[row, order], np.sqrt(np.maximum(dist[row, order], 0)).astype(np.float64)
        return np.where(np.isfinite(dist), ids, -1), dist


def _within(ids: np.ndarray, dist: np.ndarray, ratio: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance-ratio pruning: (row, list) of the lists no farther than (1 + ratio) times the nearest, at most `most` a row, by row and list."""
    ok = (ids[:, :most] >= 0) & (dist[:, :most] <= (1 + ratio) * dist[:, :1] + 1e-12)
    row, j = np.nonzero(ok)
    lists = ids[row, j]
    order = np.lexsort((lists, row))
    return row[order], lists[order]


def _by_shard(row: np.ndarray, lists: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """(row, shard, its lists there) for every shard that a row goes to."""
    shard = lists // per
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])
    at = np.flatnonzero(first)
    return row[at], shard[at], pa.ListArray.from_arrays(pa.array(np.append(at, len(row)), pa.int32()), pa.array(lists, pa.int32()))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def _route(graph: Graph, p: Params, dim: int):
    """(shard, role, id, lists, vec): role 0 to be indexed, 1 to ask; once per shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                x = _matrix(b.column(1), dim)
                ids, dist = graph.search(x, p.probes)
                for role, (ratio, most) in enumerate(((p.near, p.joins), (p.ratio, p.probes))):
                    row, shard, lists = _by_shard(*_within(ids, dist, ratio, most), p.lists_per_shard)
                    rows = b.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(np.full(len(row), role), pa.int32()), rows.column(0), lists, rows.column(1)], ["shard", "role", "id", "lists", "vec"])

    return run


def nearest(q: np.ndarray, x: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact (query, row, distance) of the k nearest rows of x to each of q and of all that tie with the last; own: the row that is the query itself, or -1."""
    d = (q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T
    mine = np.flatnonzero(own >= 0)
    d[mine, own[mine]] = np.inf
    if d.shape[1] > k:
        last = np.partition(d, k - 1, 1)[:, k - 1]
        i, j = np.nonzero(d <= (last + 1e-9 * (1 + np.abs(last)))[:, None])
    else:
        i, j = np.nonzero(np.isfinite(d))
    return i, j, np.sqrt(((q[i] - x[j]) ** 2).sum(1))


def _ask(k: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, index = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            edges = [*np.flatnonzero(starts(b, ["shard", "role"], None)).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                part = b.slice(lo, hi - lo)
                s, role = part.column(0)[0].as_py(), part.column(1)[0].as_py()
                if s != shard:
                    shard, parts, index = s, [], None
                if role == 0:
                    parts.append(part)
                    continue
                if index is None:
                    index, parts = _index(parts, dim), []
                for at in range(0, part.num_rows, 512):
                    yield from _answers(part.slice(at, 512), index, k, dim)

    return run


def _index(parts: list[pa.RecordBatch], dim: int):
    """(ids, vectors, list -> rows, id -> row) of a shard."""
    if not parts:
        return np.array([], object), np.zeros((0, dim)), {}, {}
    t = pa.Table.from_batches(parts).combine_chunks()
    ids = np.array(t.column(2).to_pylist(), object)
    x = _matrix(t.column(4).combine_chunks(), dim)
    rows: dict[int, list[int]] = {}
    for i, mine in enumerate(t.column(3).to_pylist()):
        for one in mine:
            rows.setdefault(one, []).append(i)
    return ids, x, {n: np.array(r) for n, r in rows.items()}, {v: i for i, v in enumerate(ids.tolist())}


def _answers(part: pa.RecordBatch, index, k: int, dim: int) -> Iterator[pa.RecordBatch]:
    ids, x, rows, number = index
    if not len(ids):
        return
    qid, q = part.column(2).to_pylist(), _matrix(part.column(4), dim)
    own = np.array([number.get(i, -1) for i in qid])
    by: dict[int, list[int]] = {}
    for i, mine in enumerate(part.column(3).to_pylist()):
        for one in mine:
            by.setdefault(one, []).append(i)
    got = []
    for one, asks in by.items():
        if (r := rows.get(one)) is None:
            continue
        asks = np.array(asks)
        place = np.searchsorted(r, own[asks])
        here = np.where((place < len(r)) & (r[np.minimum(place, len(r) - 1)] == own[asks]), place, -1)
        i, j, d = nearest(q[asks], x[r], k, here)
        got.append((asks[i], r[j], d))
    if not got:
        return
    i, j, d = (np.concatenate(c) for c in zip(*got))
    name = ids[j].astype(str)
    order = np.lexsort((name, d, i))
    i, j, d = i[order], j[order], d[order]
    new = np.ones(len(i), bool)  # replicas of a row in several lists of the shard lie together
    new[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    i, j, d = i[new], j[new], d[new]
    first = np.ones(len(i), bool)
    first[1:] = i[1:] != i[:-1]
    at = np.arange(len(i))
    keep = at - np.maximum.accumulate(np.where(first, at, 0)) < k
    yield pa.RecordBatch.from_arrays([pa.array([qid[n] for n in i[keep]]), pa.array(ids[j[keep]].tolist(), pa.string()), pa.array(d[keep])], ["a", "b", "dist"])


def _space(reps: DataFrame, n: int, dim: int, k: int, p: Params) -> DataFrame:
    """(a, b, dist): for each of the n distinct vectors of one space, its k nearest others."""
    lists = 1
    while lists * p.list_size < n and lists < p.max_lists:
        lists *= 2
    share = min(1.0, min(p.most_rows, max(4096, p.train_rows * lists)) / n)  # so many rows come to the driver, whatever n
    sample = reps.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "vec").toArrow().sort_by("id")
    x = _matrix(sample.column("vec").combine_chunks(), dim)
    graph = Graph.build(balanced_leaves(x, lists, p.seed))
    shared = reps.sparkSession.sparkContext.broadcast(graph)  # at most max_lists centroids and 16 links each

    def route(batches):
        return _route(shared.value, p, dim)(batches)

    flow = reps.select("id", "vec").mapInArrow(route, "shard int, role int, id string, lists array<int>, vec array<double>")
    flow = flow.repartitionById(max(1, lists // p.lists_per_shard), F.col("shard")).sortWithinPartitions("shard", "role")
    near = flow.mapInArrow(_ask(k, dim), "a string, b string, dist double")
    best = near.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct("dist", "b"))), 1, k).alias("best"))  # at most k from each shard
    return best.select("a", F.explode("best").alias("x")).select("a", "x.b", "x.dist")


def knn(df: DataFrame, id_col: str, vec: str, space: str, dims: dict[int, int], k: int = 5, params: Params = Params()) -> DataFrame:
    """(id, neighbour, dist, rnk): the k nearest others of every usable vector of its space, by Euclidean distance, ties by rising id.

    df: one row per id. dims: the length of each space's vectors; a vector of another length or space, a null one and one
    of zeros only is not usable. Null, NaN and infinite entries count as 0. Equal vectors are neighbours at distance 0, by
    rising id, however many they are. Other columns are ignored; an empty table gives an empty result."""
    clean = F.transform(F.col(vec).cast("array<double>"), lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x + F.lit(0.0)))
    rows = df.select(F.col(id_col).alias("id"), F.col(space).alias("space"), clean.alias("vec")).where(F.col("id").isNotNull())
    fits = F.lit(False)
    for s, n in dims.items():
        fits = fits | ((F.col("space") == s) & (F.size("vec") == n))
    rows = durable(rows.where(fits & F.exists("vec", lambda x: x != 0)))
    classes = durable(rows.groupBy("space", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    counts = classes.groupBy("space").agg(F.count(F.lit(1)), F.sum("n")).collect()
    sizes, total = {r[0]: r[1] for r in counts}, sum(r[2] for r in counts)
    # Vectors that a 4096th of all rows bear number under 4096, so they may be broadcast; the rest have no skew to join.
    multi, hot = classes.where("n > 1").select(F.col("space").alias("ms"), F.col("vec").alias("mv"), F.col("id").alias("rep"), "n"), F.col("n") > total / 4096
    same = (F.col("space") == F.col("ms")) & (F.col("vec") == F.col("mv"))
    crowd = durable(rows.join(F.broadcast(multi.where(hot)), same).select("rep", "id"))
    crowded = F.broadcast(multi.where(hot).select(F.col("rep").alias("hrep")))
    few = durable(rows.join(multi.where(~hot), same).select("rep", "id"))
    members = crowd.unionByName(few)
    found = None
    for s, dim in dims.items():
        if sizes.get(s):
            one = _space(classes.where(F.col("space") == s), sizes[s], dim, k, params)
            found = one if found is None else found.unionByName(one)
    if found is None:
        return df.sparkSession.createDataFrame([], "id string, neighbour string, dist double, rnk int")
    leads = top_n(members, ["rep"], [F.asc("id")], k + 1).select(F.col("rep").alias("lrep"), F.col("id").alias("lid"))
    leads = durable(leads)
    other = found.join(leads, F.col("b") == F.col("lrep"), "left").select("a", "dist", F.coalesce("lid", "b").alias("b"))
    own = leads.select(F.col("lrep").alias("a"), F.lit(0.0).alias("dist"), F.col("lid").alias("b"))
    ranked = other.unionByName(own).groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "b"))), 1, k + 1).alias("best"))  # at most (k + 1)^2 in a list
    ranked = durable(ranked)
    plain = ranked.join(crowded, F.col("a") == F.col("hrep"), "left_anti").join(few.select(F.col("rep").alias("a"), F.col("id").alias("mid")), "a", "left").select(F.coalesce("mid", "a").alias("id"), "best")
    thick = F.broadcast(ranked.join(crowded, F.col("a") == F.col("hrep"), "left_semi"))  # one row for each of the crowded vectors
    each = plain.unionByName(crowd.join(thick, F.col("rep") == F.col("a")).select("id", "best"))
    each = each.select("id", F.posexplode(F.slice(F.filter("best", lambda x: x["b"] != F.col("id")), 1, k)).alias("i", "x"))
    return each.select("id", F.col("x.b").alias("neighbour"), F.col("x.dist").alias("dist"), (F.col("i") + 1).cast("int").alias("rnk"))
