"""Machine-learning operators and the user-function surface (L, V, C02)."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.operators.quality import quantiles
from kelpie.operators.relational import ranked, running, with_places
from kelpie.operators.similarity import knn_blocks
from kelpie.sources.tables import durable


def scale(df: DataFrame, cols: list[str], how: str) -> DataFrame:
    """Standard (population deviation), minmax or robust (interquartile range) in one pass for the bounds and one for the rows.

    A constant column becomes 0. Nulls stay."""
    if how == "standard":
        pair = lambda c: (F.avg(c), F.stddev_pop(c))
    elif how == "minmax":
        pair = lambda c: (F.min(c), F.max(c) - F.min(c))
    elif how == "robust":
        pair = None
    else:
        raise ValueError(how)
    if pair is None:  # quantiles from range-partitioned histograms, one row each
        parts = [quantiles(df, c, [0.25, 0.5, 0.75]).select(F.col("q1").alias(f"_a{i}"), (F.col("q2") - F.col("q0")).alias(f"_b{i}")) for i, c in enumerate(cols)]
        one = reduce(DataFrame.crossJoin, parts)
    else:
        one = df.agg(*[x.alias(f"_{n}{i}") for i, c in enumerate(cols) for x, n in zip(pair(c), "ab")])
    out = df.crossJoin(F.broadcast(one))  # one row
    new = {c: F.when(F.col(f"_b{i}") > 0, (F.col(c) - F.col(f"_a{i}")) / F.col(f"_b{i}")).otherwise(F.when(F.col(c).isNotNull(), 0.0)) for i, c in enumerate(cols)}
    return out.withColumns(new).select(*df.columns)


def quantile_transform(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """A value's percent rank within its group."""
    out = with_places(df, by, col)
    share = (F.col("n_upto") - F.col("n_at")) / F.nullif(F.col("n_group") - 1, F.lit(0))
    return out.withColumn(f"{col}_q", F.coalesce(share, F.lit(0.0))).drop("n_at", "n_upto", "n_group")


def ordinal_encode(df: DataFrame, col: str) -> DataFrame:
    """Categories numbered from 0 in their order. The dictionary is ranked, not the rows; null stays null."""
    book = ranked(df.select(F.col(col).alias("_c")).where("_c is not null").distinct(), [F.asc("_c")], f"{col}_code")
    book = book.withColumn(f"{col}_code", F.col(f"{col}_code") - 1)
    return df.join(book, F.col(col) == F.col("_c"), "left").drop("_c")


def one_hot(df: DataFrame, col: str, categories: list) -> DataFrame:
    """A 0/1 column for each of the named categories."""
    return df.withColumns({f"{col}_{c}": F.coalesce((F.col(col) == c).cast("int"), F.lit(0)) for c in categories})


def normalise_rows(df: DataFrame, cols: list[str], norm: str = "l2") -> DataFrame:
    """Each row's `cols` divided by their norm (l1, l2 or max); a row of zeros stays, and so do nulls, which count as 0 in the norm."""
    x = [F.coalesce(F.abs(F.col(c)).cast("double"), F.lit(0.0)) for c in cols]
    size = {"l1": sum(x[1:], x[0]), "l2": F.sqrt(sum((v * v for v in x[1:]), x[0] * x[0])), "max": F.greatest(*x) if len(x) > 1 else x[0]}[norm]
    return df.withColumns({c: F.col(c) / F.when(size > 0, size).otherwise(1.0) for c in cols})


def _yeo_johnson(x, lam: float):
    if abs(lam) < 1e-9:
        up = F.log1p(x)
    else:
        up = (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def power_transform(df: DataFrame, col: str, out: str = "y", low: float = -2.0, high: float = 4.0) -> tuple[DataFrame, float]:
    """Yeo-Johnson's transform of a column and its parameter, the likeliest in steps of 0.01 between low and high.

    Two passes, each one aggregation of sums: steps of 0.1 over the whole span, then of 0.01 around the best. Nulls and NaN stay."""
    x = F.when(~F.isnan(col), F.col(col).cast("double"))

    def best(grid: list[float]) -> float:
        trend = F.sum(F.when(x >= 0, F.log1p(x)).otherwise(-F.log1p(-x)))
        row = df.agg(F.count(x).alias("n"), trend.alias("t"), *[F.var_pop(_yeo_johnson(x, lam)).alias(f"v{i}") for i, lam in enumerate(grid)]).first()
        score = [-row["n"] / 2 * math.log(row[f"v{i}"]) + (lam - 1) * row["t"] if row[f"v{i}"] else -math.inf for i, lam in enumerate(grid)]
        return grid[max(range(len(grid)), key=lambda i: score[i])]

    coarse = best([round(low + 0.1 * i, 1) for i in range(round((high - low) / 0.1) + 1)])
    lam = best([round(coarse + 0.01 * i, 2) for i in range(-9, 10)])
    return df.withColumn(out, _yeo_johnson(x, lam)), lam


def select_k_best(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """(feature, f, place): the F statistic of a one-way analysis of variance over the label, largest first; one pass. SelectKBest keeps the
    first k places, SelectPercentile a share of them. Rows with a null label are left out; a feature without variance has no f."""
    per = df.where(F.col(label).isNotNull()).groupBy(label).agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols) for f, n in ((F.count, "n"), (F.sum, "s"), (lambda v: F.sum(v * v), "q"))])
    total = lambda c: F.sum(c)
    one = per.agg(F.count(F.lit(1)).alias("k"), *[total(f"{n}{i}").alias(f"{n}{i}") for i in range(len(cols)) for n in "nsq"], *[F.sum(F.col(f"s{i}") * F.col(f"s{i}") / F.nullif(F.col(f"n{i}"), F.lit(0))).alias(f"b{i}") for i in range(len(cols))])
    rows = []
    for i, c in enumerate(cols):
        n, between = F.col(f"n{i}"), F.col(f"b{i}") - F.col(f"s{i}") * F.col(f"s{i}") / F.col(f"n{i}")
        within = F.col(f"q{i}") - F.col(f"b{i}")
        rows.append(F.struct(F.lit(c).alias("feature"), (between / (F.col("k") - 1) / F.nullif(within / (n - F.col("k")), F.lit(0.0))).alias("f")))
    out = one.select(F.posexplode(F.array_sort(F.array(*rows), lambda a, b: F.when(F.coalesce(a["f"], F.lit(-1.0)) > F.coalesce(b["f"], F.lit(-1.0)), -1).when(F.coalesce(a["f"], F.lit(-1.0)) < F.coalesce(b["f"], F.lit(-1.0)), 1).otherwise(0))).alias("i", "x"))
    return out.select("x.feature", "x.f", (F.col("i") + 1).alias("place"))


def truncated_svd(df: DataFrame, cols: list[str], k: int) -> tuple[DataFrame, list[float]]:
    """(df with s0 .. s{k-1}, singular values): projections on the leading right singular vectors of the uncentred columns.

    The columns' products are summed in one pass; only that small matrix is decomposed on the driver. Signs are fixed by the
    largest entry. Nulls count as 0."""
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]
    d = len(cols)
    got = df.agg(*[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    gram = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            gram[i, j] = gram[j, i] = got[f"p{i}_{j}"] or 0.0
    value, vec = np.linalg.eigh(gram)
    order = np.argsort(-value)[:k]
    vec = vec[:, order] * np.sign(vec[np.abs(vec[:, order]).argmax(0), order])
    proj = {f"s{a}": sum((x[i] * float(vec[i, a]) for i in range(1, d)), x[0] * float(vec[0, a])) for a in range(len(order))}
    return df.withColumns(proj), [float(math.sqrt(max(v, 0.0))) for v in value[order]]


def mean_and_covariance(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows without null or NaN: sums of products within each partition by matrix product, added up entry by entry."""
    n = len(cols) + 1

    def sums(batches):
        total = np.zeros((n, n))
        for b in batches:
            if b.num_rows:
                z = np.column_stack([*(c.to_numpy(zero_copy_only=False) for c in b.columns), np.ones(b.num_rows)])
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n), pa.int32()), pa.array(total.ravel())], ["i", "v"])

    got = df.select(*[F.col(c).cast("double") for c in cols]).dropna().mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # one row an entry
    total = np.zeros(n * n)
    for r in got:
        total[r.i] = r.v
    total = total.reshape(n, n)
    rows = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / rows
    return mean, total[:-1, :-1] / rows - np.outer(mean, mean)


def fast_ica(df: DataFrame, cols: list[str], k: int, steps: int = 30, seed: int = 42) -> DataFrame:
    """Df with the independent components i0 .. i{k-1} (unit variance), by the fixed-point iteration with tanh, all components at once.

    Means and covariances come from one aggregation; every step is one pass of sums over Arrow batches, of which only a k by k
    matrix reaches the driver. Nulls and NaN leave a row out of the fit and without components; fewer than k directions with
    variance give fewer components."""
    d, x = len(cols), [F.col(c).cast("double") for c in cols]
    clean = df.select(*[v.alias(f"x{i}") for i, v in enumerate(x)]).dropna()
    mean, cov = mean_and_covariance(clean, clean.columns)
    value, vec = np.linalg.eigh(cov)
    top = [i for i in np.argsort(-value)[:k] if value[i] > 1e-12 * max(value.max(), 1e-300)]
    white = (vec[:, top] / np.sqrt(value[top])).T
    n = len(top)

    def even(w: np.ndarray) -> np.ndarray:
        u, _, v = np.linalg.svd(w)
        return u @ v

    w = even(np.random.default_rng(seed).normal(size=(n, n))) if n else np.zeros((0, 0))
    for _ in range(steps if n else 0):

        def sums(batches, w=w):
            total, slope, rows = np.zeros((n, n)), np.zeros(n), 0
            for b in batches:
                if b.num_rows:
                    z = (np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) - mean) @ white.T
                    g = np.tanh(z @ w.T)
                    total += g.T @ z
                    slope += (1 - g * g).sum(0)
                    rows += len(z)
            at = np.arange(n * n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()), pa.array(np.repeat(slope, n)), pa.array(np.full(n * n, rows))], ["i", "t", "s", "n"])

        got = clean.mapInArrow(sums, "i int, t double, s double, n bigint").groupBy("i").agg(F.sum("t").alias("t"), F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # one row an entry of the matrix
        rows = {r.i: r for r in got}
        size = rows[0].n or 1
        new = even(np.array([[rows[i * n + j].t / size for j in range(n)] for i in range(n)]) - np.array([rows[i * n].s / size for i in range(n)])[:, None] * w)
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < 1e-6
        w = new
        if done:
            break
    mix = w @ white
    return df.withColumns({f"i{a}": sum(((x[j] - float(mean[j])) * float(mix[a, j]) for j in range(d)), F.lit(0.0)) for a in range(n)})


def kernel_pca(df: DataFrame, cols: list[str], key: str, k: int, gamma: float, landmarks: int = 64) -> DataFrame:
    """Df with the leading components k0 .. of the Gaussian kernel, over its Nystroem features from a bounded number of landmarks."""
    out = nystroem(df, cols, key, landmarks, gamma)
    feats = [c for c in out.columns if c not in df.columns]
    mean, cov = mean_and_covariance(out, feats)
    value, vec = np.linalg.eigh(cov)
    vec = vec[:, np.argsort(-value)[:k]]
    vec = vec * np.sign(vec[np.abs(vec).argmax(0), range(vec.shape[1])])
    return out.withColumns({f"k{a}": sum(((F.col(c) - float(mean[i])) * float(vec[i, a]) for i, c in enumerate(feats)), F.lit(0.0)) for a in range(vec.shape[1])}).drop(*feats)


class ExtraTrees:
    """Extremely randomised trees (0/1 labels): at every node the best by Gini of a few features, each cut at one random place. They are grown
    on the driver on at most `most` rows, those with the least hash, and applied as JVM expressions to all rows."""

    def __init__(self, cols: list[str], label: str, trees: int = 8, depth: int = 4, most: int = 20_000, seed: int = 42):
        self.cols, self.label, self.trees, self.depth, self.most, self.seed = cols, label, trees, depth, most, seed

    def fit(self, df: DataFrame) -> ExtraTrees:
        rows = df.select(*[F.col(c).cast("double").alias(c) for c in self.cols], F.col(self.label).cast("double").alias("_y")).dropna()
        got = rows.orderBy(F.xxhash64(*rows.columns)).limit(self.most).toPandas().to_numpy()
        rng = np.random.default_rng(self.seed)
        few = max(1, round(math.sqrt(len(self.cols))))

        def gini(y: np.ndarray) -> float:
            p = y.mean() if len(y) else 0.0
            return 2 * p * (1 - p) * len(y)

        def grow(m: np.ndarray, depth: int):
            y = m[:, -1]
            if depth == 0 or len(m) < 10 or y.min() == y.max():
                return float(y.mean()) if len(y) else 0.5
            best = None
            for c in rng.choice(len(self.cols), few, replace=False):
                lo, hi = m[:, c].min(), m[:, c].max()
                if lo < hi:
                    cut = float(rng.uniform(lo, hi))
                    left = m[:, c] < cut
                    score = gini(y[left]) + gini(y[~left])
                    if best is None or score < best[0]:
                        best = (score, int(c), cut, left)
            if best is None:
                return float(y.mean())
            return best[1], best[2], grow(m[best[3]], depth - 1), grow(m[~best[3]], depth - 1)

        self.forest = [grow(got, self.depth) for _ in range(self.trees)] if len(got) else [0.5]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        def say(t):
            return F.lit(t) if isinstance(t, float) else F.when(F.col(self.cols[t[0]]) < t[1], say(t[2])).otherwise(say(t[3]))

        vote = sum((say(t) for t in self.forest), F.lit(0.0)) / len(self.forest)
        return df.withColumn("prediction", (vote > 0.5).cast("double"))


class Perceptron:
    """Spark's multilayer perceptron with one hidden layer, over columns; features are standardised first."""

    def __init__(self, cols: list[str], label: str, hidden: int = 6):
        self.cols, self.label, self.hidden = cols, label, hidden

    def fit(self, df: DataFrame) -> Perceptron:
        from pyspark.ml.classification import MultilayerPerceptronClassifier
        from pyspark.ml.feature import StandardScaler

        v = vectors(df, self.cols, "_raw").select("_raw", F.col(self.label).cast("double").alias("label"))
        self.scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(v)
        self.model = MultilayerPerceptronClassifier(layers=[len(self.cols), self.hidden, 2], seed=42, maxIter=30).fit(self.scaler.transform(v))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.scaler.transform(vectors(df, self.cols, "_raw"))).drop("_raw", "features", "rawPrediction", "probability")


def rbf_weights(d: int, n: int, gamma: float, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(size=(n, d)) * math.sqrt(2 * gamma), 6), np.round(rng.uniform(0, 2 * math.pi, n), 6)


def rbf_sampler(df: DataFrame, cols: list[str], n: int, gamma: float, seed: int = 42) -> DataFrame:
    """N random Fourier features f0 .. of the Gaussian kernel exp(-gamma d^2), as JVM expressions."""
    w, b = rbf_weights(len(cols), n, gamma, seed)
    out = {f"f{j}": math.sqrt(2 / n) * F.cos(sum((F.col(c) * float(w[j, i]) for i, c in enumerate(cols)), F.lit(float(b[j])))) for j in range(n)}
    return df.withColumns(out)


def nystroem(df: DataFrame, cols: list[str], key: str, landmarks: int, gamma: float) -> DataFrame:
    """Features f0 .. whose inner products approximate the Gaussian kernel: kernels to the `landmarks` rows with the least key hash, a
    bounded sample, times the root of the landmarks' inverse kernel matrix."""
    got = df.select(*cols).where(" and ".join(f"`{c}` is not null" for c in cols)).orderBy(F.md5(F.col(key).cast("string").cast("binary"))).limit(landmarks).collect()
    m = np.unique(np.array([[float(v) for v in r] for r in got]).reshape(-1, len(cols)), axis=0)
    gram = np.exp(-gamma * ((m[:, None] - m[None]) ** 2).sum(2))
    value, vec = np.linalg.eigh(gram)
    root = (vec / np.sqrt(np.maximum(value, 1e-12))) @ vec.T
    near = F.array(*[F.exp(-gamma * sum((F.pow(F.col(c) - float(p[i]), 2) for i, c in enumerate(cols)), F.lit(0.0))) for p in m])
    dot = lambda j: F.aggregate(F.zip_with(F.col("_k"), F.array(*[F.lit(float(v)) for v in root[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return df.withColumn("_k", near).withColumns({f"f{j}": dot(j) for j in range(len(m))}).drop("_k")


def knn_impute(df: DataFrame, key: str, features: str, target: str, k: int = 5) -> DataFrame:
    """Null targets become the mean target of the k nearest rows that have one, by the feature vector; ties by rising key.

    Rows to be filled are the stated query set, searched exactly in blocks against the rest. Rows without features stay null."""
    known = df.where(F.col(target).isNotNull())
    near = knn_blocks(df.where(F.col(target).isNull()), known, key, features, k)
    mean = near.join(known.select(F.col(key).alias("neighbour"), F.col(target).alias("_t")), "neighbour").groupBy(F.col("query").alias("_q")).agg(F.avg("_t").alias("_m"))
    return df.join(mean, F.col(key) == F.col("_q"), "left").withColumn(target, F.coalesce(target, "_m")).drop("_q", "_m")


def knn_classify(queries: DataFrame, known: DataFrame, key: str, features: str, label: str, k: int = 5) -> DataFrame:
    """(key, prediction): the most frequent label of the k nearest rows of a stated query set; ties to the least label."""
    near = knn_blocks(queries, known, key, features, k).join(known.select(F.col(key).alias("neighbour"), F.col(label).alias("_l")), "neighbour")
    votes = near.groupBy("query", "_l").agg(F.count(F.lit(1)).alias("_n"))
    return votes.groupBy(F.col("query").alias(key)).agg(F.min(F.struct((-F.col("_n")).alias("n"), "_l"))["_l"].alias("prediction"))


class Discriminant:
    """Linear (one covariance) and quadratic discriminants. Sums of products per class come from one aggregation; scores are
    JVM expressions. `ridge` is added to the covariances' diagonal."""

    def __init__(self, cols: list[str], label: str, shared: bool, ridge: float = 1e-6):
        self.cols, self.label, self.shared, self.ridge = cols, label, shared, ridge

    def fit(self, df: DataFrame) -> Discriminant:
        d, x = len(self.cols), [F.col(c).cast("double") for c in self.cols]
        rows = df.groupBy(self.label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]).collect()  # one row a class
        total = sum(r["n"] for r in rows)
        cov = {r[0]: np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) for r in rows}
        pooled = sum(cov[r[0]] * r["n"] / total for r in rows)
        self.classes = []
        for r in rows:
            c = (pooled if self.shared else cov[r[0]]) + self.ridge * np.eye(d)
            self.classes.append((float(r[0]), np.array([r[f"m{i}"] for i in range(d)]), np.linalg.inv(c), float(np.linalg.slogdet(c)[1]), math.log(r["n"] / total)))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        scores = []
        for label, mean, inv, det, prior in self.classes:
            z = [F.col(c).cast("double") - float(m) for c, m in zip(self.cols, mean)]
            quad = sum((z[i] * z[j] * float(inv[i, j]) for i in range(len(z)) for j in range(len(z))), F.lit(0.0))
            scores.append(F.struct((-0.5 * quad - 0.5 * det + prior).alias("s"), F.lit(label).alias("l")))
        return df.withColumn("prediction", F.array_max(F.array(*scores))["l"])


class AveragedLinear:
    """A linear model trained by stochastic steps within each partition; the partitions' weights are averaged, by rows, after every
    epoch. loss: log (logistic SGD), hinge (linear SVM by SGD) or pa (passive-aggressive). Labels are 0 and 1; features are
    standardised. Only weights move between executors and driver."""

    def __init__(self, cols: list[str], label: str, loss: str, epochs: int = 3, rate: float = 0.05):
        self.cols, self.label, self.loss, self.epochs, self.rate = cols, label, loss, epochs, rate

    def fit(self, df: DataFrame) -> AveragedLinear:
        one = df.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(self.cols)], *[F.stddev_pop(c).alias(f"b{i}") for i, c in enumerate(self.cols)]).first()
        d = len(self.cols)
        self.mean, self.scale = np.array([one[f"a{i}"] or 0.0 for i in range(d)]), np.array([one[f"b{i}"] or 1.0 for i in range(d)])
        self.weight = np.zeros(d + 1)
        rows = df.select(*[F.col(c).cast("double") for c in self.cols], F.col(self.label).cast("double").alias("_y"))
        mean, scale, loss = self.mean, self.scale, self.loss
        for epoch in range(self.epochs):
            start, rate = self.weight, self.rate / (1 + epoch)

            def step(batches, start=start, rate=rate):
                w, n = start.copy(), 0
                for b in batches:
                    if not b.num_rows:
                        continue
                    m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                    m = m[np.isfinite(m).all(1)]
                    x, y = np.column_stack([(m[:, :d] - mean) / scale, np.ones(len(m))]), 2 * m[:, d] - 1
                    for lo in range(0, len(x), 32):
                        xs, ys = x[lo : lo + 32], y[lo : lo + 32]
                        margin = ys * (xs @ w)
                        if loss == "log":
                            pull = ys / (1 + np.exp(np.clip(margin, -30, 30)))
                        elif loss == "hinge":
                            pull = ys * (margin < 1)
                        else:
                            pull = ys * np.minimum(np.maximum(1 - margin, 0) / (xs * xs).sum(1), 1.0)
                        w = w + (1.0 if loss == "pa" else rate) * (pull @ xs) / len(xs)
                        n += len(xs)
                yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(w * n), pa.array([float(n)] * (d + 1))], ["i", "w", "n"])

            got = rows.mapInArrow(step, "i int, w double, n double").groupBy("i").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()  # one row a weight
            for r in got:
                self.weight[r.i] = r.w / r.n if r.n else 0.0
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        z = sum(((F.col(c) - float(m)) / float(s) * float(w) for c, m, s, w in zip(self.cols, self.mean, self.scale, self.weight)), F.lit(float(self.weight[-1])))
        return df.withColumn("prediction", (z > 0).cast("double"))


class AdaBoost:
    """Boosted decision stumps (labels 0 and 1): every round fits a weighted tree of depth one and raises the weights of its errors."""

    def __init__(self, cols: list[str], label: str, rounds: int = 4):
        self.cols, self.label, self.rounds = cols, label, rounds

    def fit(self, df: DataFrame) -> AdaBoost:
        from pyspark.ml.classification import DecisionTreeClassifier

        v = durable(vectors(df, self.cols).select("features", F.col(self.label).cast("double").alias("label")))
        self.parts, boost = [], F.lit(0.0)
        for i in range(self.rounds):
            rows = v
            for j, (m, _) in enumerate(self.parts):
                rows = m.setPredictionCol(f"p{j}").setRawPredictionCol("").setProbabilityCol("").transform(rows)
            w = F.exp(sum((a * (F.col(f"p{j}") != F.col("label")).cast("double") for j, (_, a) in enumerate(self.parts)), boost))
            rows = rows.withColumn("w", w).select("features", "label", "w")
            m = DecisionTreeClassifier(maxDepth=1, seed=42, weightCol="w").fit(rows)
            one = m.transform(rows).agg(F.sum(F.when(F.col("prediction") != F.col("label"), F.col("w")).otherwise(0.0)).alias("e"), F.sum("w").alias("t")).first()
            err = min(max((one.e or 0.0) / (one.t or 1.0), 1e-9), 1 - 1e-9)
            if err >= 0.5:
                break
            self.parts.append((m, math.log((1 - err) / err)))
            if err <= 1e-9:
                break
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = vectors(df, self.cols)
        vote = F.lit(0.0)
        for j, (m, a) in enumerate(self.parts):
            out = m.setPredictionCol(f"_p{j}").setRawPredictionCol("").setProbabilityCol("").transform(out)
            vote = vote + a * (2 * F.col(f"_p{j}") - 1)
        return out.withColumn("prediction", (vote > 0).cast("double")).drop("features", *[f"_p{j}" for j in range(len(self.parts))])


def own_classifiers(cols: list[str], label: str) -> dict[str, Callable]:
    """The classifiers that Spark has no built-in for."""
    return {"lda": lambda: Discriminant(cols, label, True), "qda": lambda: Discriminant(cols, label, False), "sgd": lambda: AveragedLinear(cols, label, "log"), "sgd_hinge": lambda: AveragedLinear(cols, label, "hinge"), "passive_aggressive": lambda: AveragedLinear(cols, label, "pa"), "ada_boost": lambda: AdaBoost(cols, label), "extra_trees": lambda: ExtraTrees(cols, label), "mlp": lambda: Perceptron(cols, label)}


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve of 0/1 labels, ties counting half, from running sums over the distinct scores; one row.

    Rows without a label or score are left out; null if either label is absent."""
    hist = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    run = running(hist, [], [F.asc("_s")], {"below": F.col("neg")})
    one = run.agg(F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return one.select((F.col("u") / F.nullif((F.col("p") * F.col("n")).cast("double"), F.lit(0.0))).alias("auc"))


def variance_threshold(df: DataFrame, cols: list[str], least: float) -> list[str]:
    """The columns whose variance exceeds `least`."""
    one = df.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
    return [c for c in cols if one[c] is not None and one[c] > least]


def bins(col, edges: list[float]):
    """The number of the bin that a value lies in."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(col >= e, 1).otherwise(0)
    return out


def polynomial(df: DataFrame, cols: list[str]) -> DataFrame:
    """Squares and products of two."""
    new = {f"{a}*{b}": F.col(a) * F.col(b) for i, a in enumerate(cols) for b in cols[i:]}
    return df.withColumns(new)


def vectors(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="skip").transform(df)


def principal_components(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """(component, ratio) of explained variance."""
    from pyspark.ml.feature import PCA

    model = PCA(k=k, inputCol="features", outputCol="pc").fit(vectors(df, cols))
    return df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(model.explainedVariance)], "component int, ratio double")


def classifiers() -> dict[str, Callable]:
    """The built-in classifiers, seeded."""
    from pyspark.ml import classification as c

    return {
        "logistic_regression": lambda: c.LogisticRegression(maxIter=20),
        "decision_tree": lambda: c.DecisionTreeClassifier(seed=42, maxDepth=4),
        "random_forest": lambda: c.RandomForestClassifier(seed=42, numTrees=10, maxDepth=4),
        "gradient_boosting": lambda: c.GBTClassifier(seed=42, maxIter=5, maxDepth=3),
        "naive_bayes": lambda: c.NaiveBayes(),
        "linear_svc": lambda: c.LinearSVC(maxIter=10),
        "factorisation_machine": lambda: c.FMClassifier(seed=42, maxIter=10, factorSize=2),
    }


def train_and_score(df: DataFrame, cols: list[str], label: str, key: str, names: list[str]) -> DataFrame:
    """(model, accuracy) on the fifth of the rows that a hash of the key holds out."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    v = vectors(df, cols).select("features", F.col(label).cast("double").alias("label"), (F.pmod(F.xxhash64(key), F.lit(5)) == 0).alias("test"))
    train, test = v.where("not test"), v.where("test")
    acc = MulticlassClassificationEvaluator(metricName="accuracy")
    rows = [(n, float(acc.evaluate(classifiers()[n]().fit(train).transform(test)))) for n in names if n in classifiers()]
    own, plain = own_classifiers(cols, "label"), df.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(label).cast("double").alias("label"), (F.pmod(F.xxhash64(key), F.lit(5)) == 0).alias("test")).dropna()
    rows += [(n, float(acc.evaluate(own[n]().fit(plain.where("not test")).transform(plain.where("test"))))) for n in names if n in own]
    return df.sparkSession.createDataFrame(rows, "model string, accuracy double")


def covariate_shift(train: DataFrame, test: DataFrame, cols: list[str], seed: int = 42) -> float:
    """How well a forest tells the two apart (area under ROC, 5 folds); shifted over 0.55."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    both = train.select(*cols).withColumn("label", F.lit(0.0)).unionByName(test.select(*cols).withColumn("label", F.lit(1.0)))
    cv = CrossValidator(estimator=RandomForestClassifier(seed=seed, numTrees=10, maxDepth=4), estimatorParamMaps=ParamGridBuilder().build(), evaluator=BinaryClassificationEvaluator(), numFolds=5, seed=seed, parallelism=2)
    return float(cv.fit(vectors(both, cols)).avgMetrics[0])


def surrogate(df: DataFrame, cols: list[str], target: str, key: str, trees: int = 10) -> DataFrame:
    """(key, mu, sigma): mean and deviation of the predictions of a bootstrap forest's trees."""
    from pyspark.ml.regression import RandomForestRegressor

    v = vectors(df, cols).select(key, "features", F.col(target).cast("double").alias("label"))
    model = RandomForestRegressor(seed=42, numTrees=trees, maxDepth=4, subsamplingRate=0.8).fit(v)
    parts = v
    for i, t in enumerate(model.trees):
        parts = t.setPredictionCol(f"t{i}").transform(parts)
    each = F.array(*[F.col(f"t{i}") for i in range(trees)])
    mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / trees
    sd = F.sqrt(F.aggregate(each, F.lit(0.0), lambda a, x: a + x * x) / trees - mean * mean)
    return parts.select(key, mean.alias("mu"), F.coalesce(F.nanvl(sd, F.lit(0.0)), F.lit(0.0)).alias("sigma"))


def class_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of 0/1 labels, in one pass."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    one = df.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == F.col(guess)).alias("ok"))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return one.select((F.col("ok") / F.nullif(F.col("n"), F.lit(0))).alias("accuracy"), p.alias("precision"), r.alias("recall"), (2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))).alias("f1"))


def regression_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """MSE, RMSE, MAE and R2, each under its own name."""
    e = F.col(truth) - F.col(guess)
    return df.agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.nullif(F.regr_syy(F.col(truth), F.col(truth)), F.lit(0.0))).alias("r2"))


def snippet(f: Callable[[pd.Series], pd.Series], kind: str):
    """A registered function of a column, run on Arrow batches."""
    return F.pandas_udf(f, kind)


def evaluation_procedure(df: DataFrame, by: str, f: Callable[[pd.DataFrame], float]) -> DataFrame:
    """(group, score) of a user's procedure over each group; a group must fit a task, as a fold does."""
    kind = dict(df.dtypes)[by]
    return df.groupBy(by).applyInPandas(lambda p: pd.DataFrame({"key": [p[by].iloc[0]], "score": [float(f(p))]}), f"key {kind}, score double")


#: The callables that a pipeline may name; nothing else is resolved.
JOBS: dict[str, Callable] = {"scale": scale, "quantile_transform": quantile_transform, "ordinal_encode": ordinal_encode, "one_hot": one_hot, "polynomial": polynomial, "normalise_rows": normalise_rows}


def resolve(name: str) -> Callable:
    if name not in JOBS:
        raise KeyError(f"{name} is not a registered operator")
    return JOBS[name]


def run_steps(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Registered operators, one after the other."""
    for name, args in steps:
        df = resolve(name)(df, **args)
    return df
