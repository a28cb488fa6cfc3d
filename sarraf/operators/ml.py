"""Unsupervised scores: encoding, imputing, scaling, isolation forest, reconstruction, attributions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sarraf.operators import distribution
from sarraf.operators.windows import global_rank


def ordinal_codes(rows: DataFrame, column: str, name: str) -> DataFrame:
    """`rows` with `name`: the rank of the value among the different values, null for null. Levels are a table, of any number."""
    levels = global_rank(rows.select(column).where(F.col(column).isNotNull()).distinct(), [F.col(column)], "_place")
    return rows.join(levels.select(column, (F.col("_place") - 1).cast("int").alias(name)), column, "left")


def robust_scale(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each column as (x - median) / (1.4826 MAD), nulls and NaN as the median; where the MAD is 0 the deviation, else 1."""
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    medians = distribution.medians(rows, clean)
    centred = {c: clean[c] - F.lit(medians[c] if medians[c] is not None else 0.0) for c in columns}
    away = distribution.medians(rows, {c: F.abs(centred[c]) for c in columns})
    spreads = rows.agg(*[F.stddev_samp(centred[c]).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    scaled = {}
    for i, c in enumerate(columns):
        spread = 1.4826 * (away[c] or 0.0) or spreads[f"s{i}"] or 1.0
        scaled[c] = F.coalesce(centred[c] / F.lit(float(spread)), F.lit(0.0))
    return rows.withColumns(scaled)


def _grow(points: np.ndarray, depth: int, most: int, rng: np.random.Generator, tree: list) -> int:
    """Adds a node (feature, threshold, left, right, path length) and returns its place."""
    place = len(tree)
    tree.append(None)
    spans = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
    if depth >= most or len(points) <= 1 or not spans.any():
        tree[place] = (-1, 0.0, -1, -1, depth + _expected(len(points)))
        return place
    feature = int(rng.choice(np.flatnonzero(spans)))
    at = rng.uniform(points[:, feature].min(), points[:, feature].max())
    low = points[:, feature] < at
    left, right = _grow(points[low], depth + 1, most, rng, tree), _grow(points[~low], depth + 1, most, rng, tree)
    tree[place] = (feature, at, left, right, 0.0)
    return place


def _expected(n: int) -> float:
    """The mean path length of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def isolation_forest(rows: DataFrame, key: str, columns: list[str], trees: int = 300, sample: int = 256, seed: int = 42) -> DataFrame:
    """`key`, `isolation`: anomaly scores 0 to 1 of every row by an isolation forest.

    The forest is fitted on at most trees * sample rows, those of least hash, which is the
    method; every row is scored, block by block.
    """
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)]
    # The rows of least hash, each task keeping its own; a bounded sample.
    some = rows.select(F.col(key).alias("_k"), *numbers).orderBy(F.xxhash64(F.col("_k").cast("string"), F.lit(seed)), "_k").limit(trees * sample)
    table = some.toArrow()
    schema = T.StructType([rows.schema[key], T.StructField("isolation", T.DoubleType())])
    if not table.num_rows:
        return rows.sparkSession.createDataFrame([], schema)
    points = np.stack([table.column(f"c{i}").to_numpy() for i in range(len(columns))], axis=1)
    rng = np.random.default_rng(seed)
    size = min(sample, len(points))
    forest = []
    for _ in range(trees):
        tree: list = []
        _grow(points[rng.choice(len(points), size, replace=False)], 0, math.ceil(math.log2(max(size, 2))), rng, tree)
        forest.append(tuple(np.array(x) for x in zip(*tree)))
    scale = _expected(size) or 1.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(1 + i).to_numpy() for i in range(len(columns))], axis=1)
            total = np.zeros(len(x))
            for feature, at, left, right, length in forest:
                node = np.zeros(len(x), np.int64)
                while True:
                    inner = feature[node] >= 0
                    if not inner.any():
                        break
                    here = node[inner]
                    node[inner] = np.where(x[inner, feature[here]] < at[here], left[here], right[here])
                total += length[node]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(2.0 ** (-total / len(forest) / scale))], names=[key, "isolation"])

    return rows.select(F.col(key), *numbers).mapInArrow(score, schema)


def reconstruction_gap(rows: DataFrame, key: str, columns: list[str], rank: int) -> DataFrame:
    """`key`, `gap`, `gaps`, `signed`: what principal components of the rows cannot reconstruct, its parts by column, and these before squaring.

    Stands in for a denoising autoencoder. Moments are summed over all rows; only the
    columns-by-columns covariance reaches the driver.
    """
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(a).alias(f"s{i}") for i, a in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]).first()
    n = max(sums["n"], 1)
    mean = np.array([(sums[f"s{i}"] or 0.0) / n for i in range(len(x))])
    second = np.array([[(sums[f"p{min(i, j)}_{max(i, j)}"] or 0.0) / n for j in range(len(x))] for i in range(len(x))])
    _, vectors = np.linalg.eigh(second - np.outer(mean, mean))
    rest = vectors[:, : len(x) - rank]  # the directions of least variance are left out
    project = rest @ rest.T
    centred = [a - F.lit(float(m)) for a, m in zip(x, mean)]
    gaps = [sum((c * F.lit(float(w)) for c, w in zip(centred[1:], line[1:])), centred[0] * F.lit(float(line[0]))) for line in project]
    parts = F.array(*[g * g for g in gaps])
    return rows.select(key, F.sqrt(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)).alias("gap"), parts.alias("gaps"), F.array(*gaps).alias("signed"))


def attributions(parts: str, names: list[str], least: float = 0.03, most: int = 5, signed: str | None = None, categories: tuple[str, ...] = ()) -> Column:
    """The largest shares of an array of non-negative parts: structs of name and share, shares under `least` left out.

    With `signed`, the array of the parts' signs, also a direction: `increases` above what was
    expected, `reduces` otherwise, `unexpected` for categories.
    """
    total = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
    at = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i)
    way = lambda i: F.when(at([n in categories for n in names], i), "unexpected").when(F.get(signed, i) > 0, "increases").otherwise("reduces")
    more = lambda i: [way(i).alias("direction")] if signed else []
    named = F.transform(parts, lambda p, i: F.struct((-p / F.nullif(total, F.lit(0.0))).alias("order"), at(names, i).alias("name"), *more(i)))
    kept = F.filter(F.array_sort(named), lambda s: -s["order"] >= least)
    return F.transform(F.slice(kept, 1, most), lambda s: F.struct(s["name"].alias("name"), F.round(-s["order"], 4).alias("share"), *([s["direction"].alias("direction")] if signed else [])))


def ml_scores(isolation: DataFrame, reconstruction: DataFrame, key: str) -> DataFrame:
    """`key`, `ml_score`: the mean of the percentile ranks of `isolation` and `gap`; keys are unique in both."""
    a = percentile_ranks(isolation.select(key, "isolation"), key, "isolation", "_i")
    b = percentile_ranks(reconstruction.select(key, "gap"), key, "gap", "_g")
    return a.join(b, key).select(key, ((F.col("_i") + F.col("_g")) / 2).alias("ml_score"))


def percentile_ranks(rows: DataFrame, key: str, score: str, name: str) -> DataFrame:
    """`rows` with a stable rank 0 to 100 of the score; ties by key; numbered without a single-task sort."""
    ranked = global_rank(rows, [F.col(score), F.col(key)], "_place")
    n = rows.agg((F.greatest(F.count("*") - 1, F.lit(1))).alias("_all"))
    return ranked.crossJoin(F.broadcast(n)).withColumn(name, (F.col("_place") - 1) / F.col("_all") * 100).drop("_place", "_all")


def flagged(scores: DataFrame, score: str, share: float, name: str) -> DataFrame:
    """`scores` with `name`: whether a row's score is beyond the exact percentile that leaves `share` of the rows above it."""
    at = distribution.percentiles(scores, [], score, {"_at": 1 - share}).select("_at")
    return scores.crossJoin(F.broadcast(at)).withColumn(name, F.col(score) > F.col("_at")).drop("_at")  # one row


def stable_sample(rows: DataFrame, key: str, columns: list[str], size: int, seed: int) -> np.ndarray:
    """At most `size` rows as a matrix, those whose key has the least hash: the bounded sample a model is fitted on."""
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)]
    some = rows.select(F.col(key).cast("string").alias("_k"), *numbers).orderBy(F.xxhash64("_k", F.lit(seed)), "_k", *[f"c{i}" for i in range(len(columns))]).limit(size)
    table = some.toArrow()
    return np.stack([table.column(f"c{i}").to_numpy() for i in range(len(columns))], axis=1)


def score_rows(rows: DataFrame, key: str, columns: list[str], model, names: list[str]) -> DataFrame:
    """`key` and one number for each of `names`: `model` maps a matrix (rows by columns) to one of (rows by names), block by block over all rows."""
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = model(np.stack([batch.column(1 + i).to_numpy() for i in range(len(columns))], axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, i].astype(np.float64)) for i in range(len(names))]], names=[key, *names])

    schema = T.StructType([rows.schema[key], *[T.StructField(n, T.DoubleType()) for n in names]])
    return rows.select(F.col(key), *numbers).mapInArrow(score, schema)


class BoostedTrees:
    """Least-squares gradient boosting over binned values: depth-wise trees, a least leaf, shrinkage and an L2 term."""

    def __init__(self, x: np.ndarray, y: np.ndarray, iterations: int = 300, rate: float = 0.08, depth: int = 6, least: int = 40, l2: float = 1.0, bins: int = 64):
        self.start = float(y.mean()) if len(y) else 0.0
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        self.depth, self.trees = depth, []
        binned, guess = self._binned(x), np.full(len(y), self.start)
        for _ in range(iterations if len(y) else 0):
            tree, leaf = self._grow(binned, y - guess, least, l2, rate, bins)
            self.trees.append(tree)
            guess += tree[2][leaf]

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def _grow(self, binned, rest, least, l2, rate, bins):
        """(feature, bin) of the inner nodes in heap order, the values of the leaves, and the leaf of each row."""
        inner = 2**self.depth - 1
        feature, cut_at = np.full(inner, -1), np.zeros(inner, np.int64)
        node = np.zeros(len(rest), np.int64)  # within the level
        for level in range(self.depth):
            width, best = 2**level, np.full(2**level, 1e-12)
            for j in range(binned.shape[1]):
                cells = node * bins + binned[:, j]
                total = np.bincount(cells, rest, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                count = np.bincount(cells, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                all_t, all_n = total[:, -1:], count[:, -1:]
                gain = total**2 / (count + l2) + (all_t - total) ** 2 / (all_n - count + l2) - all_t**2 / (all_n + l2)
                gain[(count < least) | (all_n - count < least)] = 0
                at = gain.argmax(axis=1)
                better = gain[np.arange(width), at] > best
                best = np.where(better, gain[np.arange(width), at], best)
                feature[width - 1 : 2 * width - 1][better] = j
                cut_at[width - 1 : 2 * width - 1][better] = at[better]
            node = node * 2 + self._right(feature, cut_at, width - 1 + node, binned)
        total, count = (np.bincount(node, w, minlength=2**self.depth) for w in (rest, np.ones(len(rest))))
        return (feature, cut_at, rate * total / (count + l2)), node

    @staticmethod
    def _right(feature, cut_at, heap, binned):
        f = feature[heap]
        return ((f >= 0) & (binned[np.arange(len(heap)), np.maximum(f, 0)] > cut_at[heap])).astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        binned, guess = self._binned(x), np.full(len(x), self.start)
        for feature, cut_at, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = node * 2 + self._right(feature, cut_at, 2**level - 1 + node, binned)
            guess += leaves[node]
        return guess


def boosted_expectation(rows: DataFrame, key: str, columns: list[str], target: str, sample: int = 20_000, seed: int = 42, **shape) -> tuple[DataFrame, BoostedTrees]:
    """(`key`, `expected` of every row, the model): boosted trees fitted on at most `sample` rows, those of least hash."""
    some = stable_sample(rows, key, [*columns, target], sample, seed)
    model = BoostedTrees(some[:, :-1], some[:, -1], **shape)
    return score_rows(rows, key, columns, lambda x: model(x)[:, None], ["expected"]), model


def substitutions(rows: DataFrame, key: str, columns: list[str], model, medians: list[float]) -> DataFrame:
    """`key`, `prediction`, `base` and one column a feature: additive contributions of each feature to what sets a prediction apart.

    Each feature in turn is put back to its median; the drops are scaled to add up to the
    whole difference from the prediction at all medians, or share it evenly where they cancel.
    """

    def explain(x: np.ndarray) -> np.ndarray:
        here, base = model(x), model(np.tile(np.array(medians, float), (len(x), 1)))
        drops = np.empty(x.shape)
        for j, m in enumerate(medians):
            put_back = x.copy()
            put_back[:, j] = m
            drops[:, j] = here - model(put_back)
        total, whole = drops.sum(axis=1), here - base
        flat = np.abs(total) < 1e-9
        scaled = np.where(flat[:, None], whole[:, None] / max(len(medians), 1), drops * (whole / np.where(flat, 1.0, total))[:, None])
        return np.column_stack([here, base, scaled])

    return score_rows(rows, key, columns, explain, ["prediction", "base", *columns])


def additivity(explained: DataFrame, columns: list[str], tolerance: float) -> DataFrame:
    """`rows`, `largest`, `beyond`: how far contributions are from adding up to prediction less base, in one aggregation."""
    off = F.abs(F.col("prediction") - F.col("base") - sum((F.col(c) for c in columns[1:]), F.col(columns[0])))
    return explained.agg(F.count("*").alias("rows"), F.max(off).alias("largest"), F.count_if(off > tolerance).alias("beyond"))


class DenoisingAutoencoder:
    """A network that learns to restore rows from rows with noise: layers down to a narrow code and up again, fitted by Adam."""

    def __init__(self, x: np.ndarray, widths: tuple[int, ...] = (128, 64, 24), noise: float = 0.15, epochs: int = 60, batch: int = 256, rate: float = 1e-3, seed: int = 42):
        rng = np.random.default_rng(seed)
        sizes = [x.shape[1], *widths, *widths[-2::-1], x.shape[1]]
        self.weights = [rng.standard_normal((a, b)) * math.sqrt(2 / max(a, 1)) for a, b in zip(sizes, sizes[1:])]
        self.biases = [np.zeros(b) for b in sizes[1:]]
        parameters = [*self.weights, *self.biases]
        first, second, step = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
        for _ in range(epochs if len(x) else 0):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                clean = x[order[at : at + batch]]
                layers = self._layers(clean + noise * rng.standard_normal(clean.shape))
                slope = 2 * (layers[-1] - clean) / clean.size
                grads_w, grads_b = [], []
                for k in range(len(self.weights) - 1, -1, -1):
                    grads_w.append(layers[k].T @ slope)
                    grads_b.append(slope.sum(axis=0))
                    slope = (slope @ self.weights[k].T) * (layers[k] > 0)
                step += 1
                for p, g, m, v in zip(parameters, [*grads_w[::-1], *grads_b[::-1]], first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _layers(self, x: np.ndarray) -> list[np.ndarray]:
        layers = [x]
        for k, (w, b) in enumerate(zip(self.weights, self.biases)):
            z = layers[-1] @ w + b
            layers.append(z if k == len(self.weights) - 1 else np.maximum(z, 0))
        return layers

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._layers(x)[-1]


def autoencoder_gap(rows: DataFrame, key: str, columns: list[str], sample: int = 8192, seed: int = 42, **shape) -> DataFrame:
    """`key`, `gap`, `gaps`, `signed` as of `reconstruction_gap`, from a denoising autoencoder fitted on at most `sample` rows of least hash; every row is scored."""
    clipped = lambda x: np.clip(x, -8, 8)
    model = DenoisingAutoencoder(clipped(stable_sample(rows, key, columns, sample, seed)), seed=seed, **shape)
    names = [f"_s{i}" for i in range(len(columns))]
    found = score_rows(rows, key, columns, lambda x: x - model(clipped(x)), names)
    squares = F.array(*[F.col(n) * F.col(n) for n in names])
    return found.select(key, F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, b: a + b)).alias("gap"), squares.alias("gaps"), F.array(*names).alias("signed"))
