"""Exact nearest neighbours of a stated query set, cosine, set and graph distances (M01..M11, J12, T08)."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.operators.graphs import per_graph
from kelpie.sources.tables import durable


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of other length or without norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def knn_blocks(queries: DataFrame, df: DataFrame, key: str, vec: str, k: int, block: int = 16_384) -> DataFrame:
    """(query, neighbour, dist, rnk): the exact k nearest rows of a stated query set, ties by rising key, itself left out.

    The queries go out in blocks of at most `block` vectors, whose size is thus bounded; each partition of the table keeps its
    k best per query, and only those are exchanged. Keys are BIGINT. Null vectors and those of other lengths take no part."""
    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(vec).cast("array<double>").alias("v")).where("v is not null")
    asked = queries.select(F.col(key).cast("bigint").alias("k"), F.col(vec).cast("array<double>").alias("v")).where("v is not null")
    n = asked.count()
    out = None
    for part in range(max(1, -(-n // block))):
        some = asked.where(F.pmod(F.xxhash64("k"), F.lit(max(1, -(-n // block)))) == part).toArrow()
        ids = some.column("k").to_numpy()
        vecs = np.array(some.column("v").to_pylist(), dtype=np.float64)
        if not len(ids):
            continue
        shared = df.sparkSession.sparkContext.broadcast((ids, vecs))
        got = rows.mapInArrow(_nearest(shared, k), "query bigint, neighbour bigint, dist double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return df.sparkSession.createDataFrame([], "query bigint, neighbour bigint, dist double, rnk int")
    best = out.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "neighbour"))), 1, k).alias("b"))  # k from each partition
    return best.select("query", F.posexplode("b").alias("i", "x")).select("query", "x.neighbour", "x.dist", (F.col("i") + 1).cast("int").alias("rnk"))


def _nearest(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best = [[] for _ in ids]
        for b in batches:
            col = b.column(1)
            size = np.diff(col.offsets.to_numpy())
            ok = np.flatnonzero(size == q.shape[1])
            if not len(ok):
                continue
            x = b.take(pa.array(ok)).column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ok), -1)
            names = b.column(0).to_numpy(zero_copy_only=False)[ok]
            for lo in range(0, len(q), 512):
                part = q[lo : lo + 512]
                d = (part**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * part @ x.T
                d[ids[lo : lo + 512, None] == names[None]] = np.inf
                few = min(k, d.shape[1])
                cut = np.partition(d, few - 1, 1)[:, few - 1]
                i, j = np.nonzero(d <= (cut + 1e-9 * (1 + np.abs(cut)))[:, None])
                dist = np.sqrt(((part[i] - x[j]) ** 2).sum(1))
                for a, c, v in zip(i, j, dist):
                    if np.isfinite(d[a, c]):
                        best[lo + a].append((v, int(names[c])))
            best = [sorted(x)[:k] for x in best]
        rows = [(int(i), n, v) for i, found in zip(ids, best) for v, n in found]
        if rows:
            a, n, v = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(v, pa.float64())], ["query", "neighbour", "dist"])

    return run


def fast_distance(a: Column, b: Column, edges_a: Column, edges_b: Column) -> Column:
    """Symmetric difference of the node signatures plus the difference in edges."""
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)) + F.abs(edges_a - edges_b)


def edit_distance(a: tuple[dict, list], b: tuple[dict, list], beam: int = 64) -> tuple[float, list[str]]:
    """Graph edit distance and its edits, by a beam search over node assignments (exact while the beam isn't cut).

    A graph is (node -> label, list of (source, destination)). A relabelling, an insertion, a deletion of a node or edge cost 1."""
    na, nb = list(a[0]), list(b[0])
    ea, eb = set(map(tuple, a[1])), set(map(tuple, b[1]))
    beams = [(0.0, (), frozenset())]
    for i, u in enumerate(na):
        nxt = []
        for cost, done, used in beams:
            for v in [*[x for x in nb if x not in used], None]:
                c = cost + (1.0 if v is None or a[0][u] != b[0][v] else 0.0)
                for j, w in enumerate(done):
                    x = na[j]
                    for s, t, p, q in ((u, x, v, w), (x, u, w, v)):
                        in_a, in_b = (s, t) in ea, v is not None and w is not None and (p, q) in eb
                        c += in_a != in_b
                c += ((u, u) in ea) != (v is not None and (v, v) in eb)
                nxt.append((c, (*done, v), used | {v} if v is not None else used))
        nxt.sort(key=lambda x: (x[0], str(x[1])))
        beams = nxt[: beam * max(1, len(nb))]
    best, path = float("inf"), ()
    for cost, done, used in beams:
        left = [v for v in nb if v not in used]
        extra = sum((s in left) or (t in left) for s, t in eb)
        if cost + len(left) + extra < best:
            best, path = cost + len(left) + extra, done
    edits = [f"delete {u}" if v is None else f"relabel {u} to {b[0][v]}" for u, v in zip(na, path) if v is None or a[0][u] != b[0][v]]
    return best, edits + [f"insert {b[0][v]}" for v in nb if v not in path]


def edit_distances(graphs: DataFrame, base: tuple[dict, list] | None, most: int = 30) -> DataFrame:
    """(pipeline_id, distance, edits) of every graph to `base`: by edits up to `most` nodes together, else M03's distance and no edits.

    graphs: owner_id, nodes (path, label), edges (source, destination), known; null nodes are none. A graph that isn't known has no distance."""

    def one(nodes: list | None, edges: list | None) -> tuple[float, list[str] | None]:
        a = {x["path"]: x["label"] for x in nodes or []}
        b = [(x["source"], x["destination"]) for x in edges or []]
        if len(a) + len(base[0]) <= most:
            return edit_distance(base, (a, b))
        return float(len(set(a.values()) ^ set(base[0].values())) + abs(len(b) - len(base[1]))), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(n, e) if known and base else (None, None) for n, e, known in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array([x for _, x in found], pa.list_(pa.string()))], ["pipeline_id", "distance", "edits"])

    return graphs.select("owner_id", "nodes", "edges", "known").mapInArrow(run, "pipeline_id string, distance double, edits array<string>")


def weighted_label_cost(same: Column, family: Column, hops: Column, known: Column) -> Column:
    """0 for equal operators, 1.0 within a family, 2.0 a hop, 5.0 where there is no path."""
    return F.when(same, 0.0).when(family, 1.0).when(known, 2.0 * hops).otherwise(5.0)


def ascii_lower(text: Column) -> Column:
    """Only A to Z in lower case, so no other letter turns into one of an identifier."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def token_set(text: Column, keywords: list[str], lower: Callable[[Column], Column] = F.lower) -> Column:
    """Distinct identifiers of a text in lower case, without keywords."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(lower(text), F.lit(r"([a-z_][a-z0-9_]+)"), F.lit(1))), F.array(*map(F.lit, keywords)))


def jaccard(a: Column, b: Column) -> Column:
    """0 for two empty sets."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / u)


def wl_rows(nodes: list[tuple], edges: list[tuple], rounds: int) -> list[tuple]:
    """(node, round, label) of one graph."""
    short = lambda text: hashlib.md5(text.encode()).hexdigest()[:12]
    label = {n: short(x) for n, x in nodes}
    near: dict = {n: set() for n in label}
    for a, b in edges:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    out = [(n, 0, x) for n, x in label.items()]
    for r in range(1, rounds + 1):
        label = {n: short(f"{x}|{','.join(sorted([label[m] for m in near[n]]))}") for n, x in label.items()}
        out += [(n, r, x) for n, x in label.items()]
    return out


def wl_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(graph, node, round, label): labels refined by the sorted labels of the neighbours, the graph taken as undirected.

    nodes(graph, node, label), edges(graph, src, dst). A graph is one document and so fits a task: it is brought together by one
    exchange and all rounds are run on it there. Round 0 is the node's own label, a null one being empty. A label is the first
    12 digits of an MD5. Repeated nodes are one; edges to nodes that are not there don't count."""
    n = nodes.select("graph", F.col("node").cast("string").alias("node"), "label").where("node is not null")
    e = edges.select("graph", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    return per_graph(n, e, partial(wl_rows, rounds=rounds), "node string, round int, label string")


def wl_kernel(labels: DataFrame, base) -> DataFrame:
    """(graph, kernel): the sum over shared labels of the lesser count, of every graph against `base`."""
    h = durable(labels.groupBy("graph", "round", "label").agg(F.count(F.lit(1)).alias("n")))
    one = h.where(F.col("graph") == base).select("round", "label", F.col("n").alias("m"))
    return h.join(one, ["round", "label"]).groupBy("graph").agg(F.sum(F.least("n", "m")).alias("kernel"))


def nystroem(df: DataFrame, key: str, vec: str, landmarks: int = 32, gamma: float = 1.0, rank: int = 16) -> DataFrame:
    """(key, embedding): coordinates whose products approximate the RBF kernel, from a fixed number of landmarks (those of
    least hash). The eigenvectors of the landmarks' kernel are found on the driver and broadcast; both are of fixed size.
    Null vectors and those of other lengths than the landmarks' have no embedding."""
    rows = df.select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v")).where("v is not null")
    picked = rows.select("v", F.xxhash64("k").alias("h")).orderBy("h").limit(landmarks).toPandas()["v"]
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, embedding array<double>"
    if not len(picked):
        return df.sparkSession.createDataFrame([], schema)
    size = int(np.bincount([len(x) for x in picked]).argmax())
    c = np.array([x for x in picked if len(x) == size], dtype=np.float64)
    kernel = lambda a, b: np.exp(-gamma * np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))
    value, vector = np.linalg.eigh(kernel(c, c))
    top = np.argsort(-value)[:rank]
    top = top[value[top] > 1e-10]
    shared = df.sparkSession.sparkContext.broadcast((c, vector[:, top] / np.sqrt(value[top]), gamma))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, w, gamma = shared.value
        for b in batches:
            ok = np.flatnonzero(np.diff(b.column(1).offsets.to_numpy()) == c.shape[1])
            if not len(ok):
                continue
            part = b.take(pa.array(ok))
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ok), -1)
            d = (x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array((np.exp(-gamma * np.maximum(d, 0)) @ w).tolist(), pa.list_(pa.float64()))], [key, "embedding"])

    return rows.mapInArrow(run, schema)
