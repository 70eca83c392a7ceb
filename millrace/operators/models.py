"""Models, search, scoring and packaging on Spark ML and Spark aggregates (FEA5, FEA6, FEA8, MOD1-MOD15, UDF1)."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from millrace.operators.features import gram, moments, scaled
from millrace.operators.similarity import dense_nearest
from millrace.sources.stores import cut, cut_at, shared_folder

#: Different values of the features together up to which a forest's trees learn from sums.
CELLS = 20_000
#: Numbers that a task gathers before it groups rows by their features; targets of one of its groups at most.
GATHERED, TARGETS = 4_000_000, 1000


def assembled(rows: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name, handleInvalid="skip").transform(rows)


def knn_regress(queries: DataFrame, training: DataFrame, k: int = 5) -> DataFrame:
    """query_id, pred: mean y of the k nearest training vectors by Euclidean distance, ties to the smaller id (MOD1)."""
    near = dense_nearest(queries, training, k, "euclidean", carry=["y"])
    return near.groupBy("query_id").agg(F.avg("y").alias("pred"))


def ridge(rows: DataFrame, columns: list[str], y: str, alpha: float):
    """Ridge regression, penalty alpha on unscaled coefficients (MOD2): Spark's lambda is alpha * sd_pop(y) / n."""
    n, sd = rows.agg(F.count(y), F.stddev_pop(y)).first()
    if not n:
        raise ValueError("no rows to learn from")
    model = LinearRegression(featuresCol="features", labelCol=y, elasticNetParam=0.0, standardization=False, solver="normal", regParam=alpha * (sd or 1.0) / max(n, 1))
    return model.fit(assembled(rows, columns))


def pls(rows: DataFrame, columns: list[str], y: str, components: int = 2) -> tuple[dict[str, float], float]:
    """Coefficients and intercept of partial least squares on scaled columns (MOD3).

    Spark adds up the products of columns; the component loop runs on that (columns x columns) matrix.
    """
    products, sums, n = gram(rows, [*columns, y])
    mean = sums / n
    cov = products / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd == 0] = 1.0
    scaled = cov / np.outer(sd, sd) * n
    s_matrix, s = scaled[:-1, :-1].copy(), scaled[:-1, -1].copy()
    w_all, p_all, q_all = [], [], []
    for _ in range(min(components, len(columns))):
        size = np.linalg.norm(s)
        if size < 1e-12:
            break
        w = s / size
        sw = s_matrix @ w
        tau = w @ sw
        if tau < 1e-12:
            break
        p, q = sw / tau, (s @ w) / tau
        s_matrix -= tau * np.outer(p, p)
        s = s - tau * q * p
        w_all.append(w)
        p_all.append(p)
        q_all.append(q)
    b = np.zeros(len(columns))
    if w_all:
        w, p = np.column_stack(w_all), np.column_stack(p_all)
        b = w @ np.linalg.solve(p.T @ w, np.array(q_all))
    b = b * sd[-1] / sd[:-1]
    return dict(zip(columns, b.tolist(), strict=True)), float(mean[-1] - b @ mean[:-1])


def forest(regression: bool = True, trees: int = 100, depth: int = 5, min_leaf: int = 1, seed: int = 56, y: str = "y", features: str = "features"):
    """Random forest estimator (MOD4, MOD5); regression looks at all features at each split."""
    common = {"featuresCol": features, "labelCol": y, "numTrees": trees, "maxDepth": depth, "minInstancesPerNode": min_leaf, "seed": seed}
    return RandomForestRegressor(featureSubsetStrategy="all", **common) if regression else RandomForestClassifier(**common)


def bootstrapped(rows: DataFrame, columns: list[str], y: str, trees: int, seed: int) -> DataFrame:
    """columns, tree, w, m: each tree's bootstrap of rows, by different values of the columns; weight and mean target.

    Every row is drawn for every tree by itself (Poisson, mean 1), as Spark's forests do; only then are draws
    of rows alike in the columns added up. A split's gain needs no more than these sums.
    """
    d = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        place, sums = {}, np.zeros((0, 2, trees))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, target = np.column_stack([batch.column(i).to_numpy() for i in range(d)]), batch.column(d).to_numpy()
            cells, own = np.unique(x, axis=0, return_inverse=True)
            order = np.argsort(own.ravel(), kind="stable")
            first = np.searchsorted(own.ravel()[order], np.arange(len(cells)))
            times = rng.poisson(1.0, (len(x), trees))[order].astype(np.float64)
            at = np.array([place.setdefault(tuple(c), len(place)) for c in cells.tolist()])
            if len(place) > len(sums):
                sums = np.concatenate([sums, np.zeros((len(place), 2, trees))])
            sums[at, 0] += np.add.reduceat(times, first, axis=0)
            sums[at, 1] += np.add.reduceat(times * target[order, None], first, axis=0)
        cells = np.array(list(place)).reshape(-1, d)
        for lo in range(0, len(cells), 1000):
            some = cells[lo : lo + 1000]
            values = [np.repeat(some[:, i], trees) for i in range(d)]
            told = [np.tile(np.arange(trees, dtype=np.int32), len(some)), *(sums[lo : lo + len(some), i].ravel() for i in range(2))]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*values, *told)], names=[*names, "tree", "w", "wy"])

    names = [f"x{i}" for i in range(d)]
    known = rows.select(*[F.col(c).cast("double").alias(n) for n, c in zip(names, columns, strict=True)], F.col(y).cast("double").alias("y"))
    known = known.where(" and ".join(f"{n} is not null and not isnan({n})" for n in names))
    drawn = known.mapInArrow(run, ", ".join(f"{n} double" for n in names) + ", tree int, w double, wy double").where("w > 0")
    sums = drawn.groupBy(*names, "tree").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
    return sums.select(*[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)], "tree", "w", (F.col("wy") / F.col("w")).alias("m"))


def importances(rows: DataFrame, columns: list[str], y: str, trees: int = 100, seed: int = 56) -> np.ndarray:
    """Importance of each column in a regression forest of depth 5 (FEA5).

    Where columns have few different values together (CELLS at most), rows are read once and each tree
    learns from the sums of its bootstrap by these; else Spark's forest goes over all rows for each level.
    """
    kinds = rows.agg(F.approx_count_distinct(F.struct(*columns))).first()[0]
    if not kinds:
        raise ValueError("no rows to learn from")
    if kinds > CELLS:
        return forest(trees=trees, seed=seed, y=y).fit(assembled(rows, columns)).featureImportances.toArray()
    sums = bootstrapped(rows, columns, y, trees, seed)
    path = f"{shared_folder(rows.sparkSession)}/bootstrap-{uuid.uuid4().hex}"
    sums.repartition("tree").write.partitionBy("tree").parquet(path)
    stored = rows.sparkSession.read.schema(sums.schema).parquet(path)
    tree = DecisionTreeRegressor(featuresCol="features", labelCol="m", weightCol="w", maxDepth=5, seed=seed)

    def one(t: int) -> np.ndarray:
        mine = stored.where(F.col("tree") == t)
        return tree.fit(assembled(mine, columns)).featureImportances.toArray() if not mine.isEmpty() else np.zeros(len(columns))

    with ThreadPool(8) as pool:
        found = sum(pool.map(inheritable_thread_target(rows.sparkSession)(one), range(trees)))
    return found / (found.sum() or 1.0)


def eliminate(rows: DataFrame, columns: list[str], y: str, keep: int, trees: int = 100, seed: int = 56) -> list[str]:
    """Columns left when the least important one goes, one fit after another, until keep are left (FEA5)."""
    left = list(columns)
    while len(left) > keep:
        left.pop(int(importances(rows, left, y, trees, seed).argmin()))
    return left


def eliminate_cv(rows: DataFrame, columns: list[str], y: str, fold: str, least: int = 1, trees: int = 100, seed: int = 56) -> list[str]:
    """eliminate() to the size of best mean R2 over the folds of column fold (FEA6)."""
    folds = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]
    scores: dict[int, list[float]] = {}
    for f in folds:
        train, test = rows.where(F.col(fold) != f), rows.where(F.col(fold) == f)
        left = list(columns)
        while True:
            model = forest(trees=trees, seed=seed, y=y).fit(assembled(train, left))
            scores.setdefault(len(left), []).append(RegressionEvaluator(labelCol=y, metricName="r2").evaluate(model.transform(assembled(test, left))))
            if len(left) <= least:
                break
            left.pop(int(model.featureImportances.toArray().argmin()))
    best = max(sorted(scores), key=lambda n: float(np.mean(scores[n])))
    return eliminate(rows, columns, y, best, trees, seed)


def _drawn(n: int, d: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and phases of n random Fourier features of d columns."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, np.sqrt(2 * gamma), (n, d)), rng.uniform(0, 2 * np.pi, n)


def fourier_features(rows: DataFrame, columns: list[str], n: int = 64, gamma: float = 1.0, seed: int = 3, name: str = "z") -> DataFrame:
    """rows with n random Fourier features of the Gaussian kernel exp(-gamma |x - y|^2), an approximation (MOD6, MOD7)."""
    w, b = _drawn(n, len(columns), gamma, seed)
    one = lambda i: F.lit(float(np.sqrt(2 / n))) * F.cos(sum((F.col(c) * F.lit(float(w[i, j])) for j, c in enumerate(columns)), F.lit(float(b[i]))))
    return rows.withColumn(name, F.array(*[one(i) for i in range(n)]))


def svr(rows: DataFrame, y: str, z: str = "z", c: float = 1.0, epsilon: float = 0.1, rounds: int = 40, rate: float = 1.0, weight: str | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept of support-vector regression on z: epsilon-insensitive loss plus |w|^2 / 2c, by full gradients summed on Spark (MOD6).

    weight names a column that says how many equal rows a row stands for.
    """
    one = rows.select(z).first()
    if one is None:
        raise ValueError("no rows to learn from")
    n_features = len(one[0])
    times = F.col(weight).cast("double") if weight else F.lit(1.0)
    told = rows.select(F.col(z).cast("array<double>").alias("z"), F.col(y).cast("double").alias("y"), times.alias("times"))
    total, n = told.agg(F.sum(F.col("y") * F.col("times")) / F.sum(F.when(F.col("y").isNotNull(), F.col("times"))), F.sum("times")).first()

    def gradient(batch: pa.RecordBatch, w: np.ndarray, bias: float) -> np.ndarray:
        x = batch.column(0).flatten().to_numpy().reshape(-1, n_features)
        off = x @ w + bias - batch.column(1).to_numpy(zero_copy_only=False)
        sign = np.where(off > epsilon, 1.0, np.where(off < -epsilon, -1.0, 0.0)) * batch.column(2).to_numpy()
        return np.append(x.T @ sign, sign.sum())

    return _descent(told, gradient, n_features, float(total), n, c, rounds, rate)


def _descent(told: DataFrame, gradient: Callable[[pa.RecordBatch, np.ndarray, float], np.ndarray], n_features: int, bias: float, n: float, c: float, rounds: int, rate: float) -> tuple[np.ndarray, float]:
    """Weights and intercept after rounds of steps along gradients of the loss, which tasks add up batch by batch; bias is where it begins."""
    w = np.zeros(n_features)
    for t in range(rounds):
        here, there = w.copy(), bias

        def run(batches: Iterator[pa.RecordBatch], here=here, there=there) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n_features + 1)
            for batch in batches:
                total += gradient(batch, here, there)
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(n_features + 1), pa.int32()), "g": pa.array(total)})

        sums = told.mapInArrow(run, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas().sort_values("i")["g"].to_numpy()
        step = rate / np.sqrt(t + 1)
        w = w - step * (sums[:-1] / n + w / (c * n))
        bias -= step * sums[-1] / n
    return w, bias


def by_features(rows: DataFrame) -> DataFrame:
    """x, ys: the targets (last column of rows) of rows alike in the columns before it, as they meet in a task.

    A task gathers GATHERED numbers at a time, and a group has TARGETS values at most, so nothing is shuffled
    and no group grows with the table. Every row is in one group.
    """

    def grouped(table: np.ndarray) -> pa.RecordBatch:
        table = table[np.lexsort(table[:, :-1].T)]
        x, n = table[:, :-1], len(table)
        new = np.append(True, (x[1:] != x[:-1]).any(axis=1))
        place = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        starts = np.flatnonzero(place % TARGETS == 0)
        width = x.shape[1]
        lists = [
            pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * width, pa.int32()), pa.array(x[starts].ravel())),
            pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), pa.array(table[:, -1].copy())),
        ]
        return pa.RecordBatch.from_arrays(lists, names=["x", "ys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
                n += held[-1].size
            if n >= GATHERED:
                yield grouped(np.concatenate(held))
                held, n = [], 0
        if held:
            yield grouped(np.concatenate(held))

    return rows.select(*[F.col(c).cast("double").alias(c) for c in rows.columns]).mapInArrow(run, "x array<double>, ys array<double>")


def kernel_svr(rows: DataFrame, columns: list[str], y: str, n: int = 64, gamma: float = 1.0, seed: int = 3, c: float = 1.0, epsilon: float = 0.1, rounds: int = 40, rate: float = 1.0) -> tuple[np.ndarray, float]:
    """svr() on the fourier_features() of columns, which are made where the gradients are, never written (MOD6).

    Written are the targets, by different values of the columns (by_features()): the features of a group are
    made once a round. Rows with a column that is null or NaN take no part.
    """
    known = rows.select(*columns, y).where(" and ".join(f"`{x}` is not null and not isnan(`{x}`)" for x in columns))
    mean, total = known.agg(F.avg(y), F.count("*")).first()
    if not total:
        raise ValueError("no rows to learn from")
    w, b = _drawn(n, len(columns), gamma, seed)

    def gradient(batch: pa.RecordBatch, weights: np.ndarray, bias: float) -> np.ndarray:
        z = np.sqrt(2 / n) * np.cos(batch.column(0).flatten().to_numpy().reshape(-1, len(columns)) @ w.T + b)
        times = batch.column(1).value_lengths().to_numpy()
        off = np.repeat(z @ weights + bias, times) - batch.column(1).flatten().to_numpy()
        sign = np.add.reduceat((off > epsilon).astype(np.float64) - (off < -epsilon), np.cumsum(times) - times) if len(times) else np.zeros(0)
        return np.append(z.T @ sign, sign.sum())

    return _descent(cut(by_features(known), "targets"), gradient, n, float(mean), total, c, rounds, rate)


def kernel_predicted(rows: DataFrame, columns: list[str], weights: np.ndarray, bias: float, gamma: float = 1.0, seed: int = 3, name: str = "pred") -> DataFrame:
    """rows with the predictions of kernel_svr()'s weights; null where a column is null or NaN (MOD6)."""
    w, b = _drawn(len(weights), len(columns), gamma, seed)

    @F.pandas_udf("double")
    def predicted(x: pd.DataFrame) -> pd.Series:
        return pd.Series(np.cos(x.to_numpy(np.float64) @ w.T + b) @ (np.sqrt(2 / len(weights)) * weights) + bias)

    whole = " and ".join(f"`{x}` is not null" for x in columns)
    return rows.withColumn(name, F.when(F.expr(whole), predicted(F.struct(*columns))))


def svc(rows: DataFrame, y: str, z: str = "z", c: float = 1.0, weight: str | None = None):
    """Support-vector classification of y in {0, 1} on kernel features (MOD7).

    weight names a column that says how many equal rows a row stands for. Spark takes deviations of
    weighted rows with another correction than of as many single ones; the penalty is taken to the same scale.
    """
    told = rows.withColumn("_z", array_to_vector(z))
    if weight is None:
        return LinearSVC(featuresCol="_z", labelCol=y, regParam=1.0 / c).fit(told)
    n, squares = told.agg(F.sum(F.col(weight).cast("double")), F.sum(F.col(weight).cast("double") ** 2)).first()
    scale = (n - 1) / (n - squares / n) if n and n > squares / n else 1.0
    return LinearSVC(featuresCol="_z", labelCol=y, weightCol=weight, regParam=1.0 / c / scale).fit(told)


class _Stage(Params, DefaultParamsReadable, DefaultParamsWritable):
    """Column names that the stages below share."""

    features = Param(Params._dummy(), "features", "vector column", TypeConverters.toString)
    label = Param(Params._dummy(), "label", "target column", TypeConverters.toString)

    def _settle(self, given: dict, **defaults) -> None:
        self._setDefault(features="features", label="y", **defaults)
        self._set(**{k: v for k, v in given.items() if v is not None})

    def _arrays(self, rows: DataFrame) -> DataFrame:
        return rows.select(vector_to_array(self.getOrDefault("features")).alias("z"), F.col(self.getOrDefault("label")).cast("double").alias("y"))


class LinearPrediction(Model, _Stage):
    """Predicts with given weights and intercept, as a DataFrame expression."""

    weights = Param(Params._dummy(), "weights", "weight of each feature", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, weights: list[float] | None = None, intercept: float | None = None, features: str | None = None):
        super().__init__()
        self._settle(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(w) for w in self.getOrDefault("weights")])
        terms = F.zip_with(vector_to_array(self.getOrDefault("features")), weights, lambda x, w: x * w)
        return dataset.withColumn("prediction", F.aggregate(terms, F.lit(self.getOrDefault("intercept")), lambda total, x: total + x))


class PartialLeastSquares(Estimator, _Stage):
    """pls() on a vector column (MOD3)."""

    components = Param(Params._dummy(), "components", "number of components", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, components: int | None = None, features: str | None = None, label: str | None = None):
        super().__init__()
        self._settle(self._input_kwargs, components=2)

    def _fit(self, dataset: DataFrame) -> LinearPrediction:
        arrays = self._arrays(dataset)
        one = arrays.select(F.size("z")).first()
        if one is None:
            raise ValueError("no rows to learn from")
        names = [f"x{i}" for i in range(one[0])]
        weights, intercept = pls(arrays.select(*[F.get("z", F.lit(i)).alias(n) for i, n in enumerate(names)], "y"), names, "y", self.getOrDefault("components"))
        return LinearPrediction(weights=list(weights.values()), intercept=intercept, features=self.getOrDefault("features"))


class KernelFeatures(Transformer, _Stage):
    """Random Fourier features of a vector column, as fourier_features() has them for single columns (MOD6, MOD7)."""

    n = Param(Params._dummy(), "n", "number of features made", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the draw", TypeConverters.toInt)
    made = Param(Params._dummy(), "made", "column made", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, n: int | None = None, gamma: float | None = None, seed: int | None = None, made: str | None = None, features: str | None = None):
        super().__init__()
        self._settle(self._input_kwargs, n=64, gamma=1.0, seed=3, made="kernel")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        n, gamma, seed = (self.getOrDefault(k) for k in ("n", "gamma", "seed"))

        @F.pandas_udf("array<double>")
        def mapped(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return vectors
            x, rng = np.stack(vectors.to_numpy()), np.random.default_rng(seed)
            w, b = rng.normal(0, np.sqrt(2 * gamma), (n, x.shape[1])), rng.uniform(0, 2 * np.pi, n)
            return pd.Series(list(np.sqrt(2 / n) * np.cos(x @ w.T + b)))

        return dataset.withColumn(self.getOrDefault("made"), array_to_vector(mapped(vector_to_array(self.getOrDefault("features")))))


class SupportVectorRegression(Estimator, _Stage):
    """svr() on a vector column, the target taken to mean 0 and deviation 1 for the fit; epsilon is in such deviations (MOD6)."""

    c = Param(Params._dummy(), "c", "weight of the loss", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "deviation without loss", TypeConverters.toFloat)
    rounds = Param(Params._dummy(), "rounds", "gradient rounds", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, c: float | None = None, epsilon: float | None = None, rounds: int | None = None, features: str | None = None, label: str | None = None):
        super().__init__()
        self._settle(self._input_kwargs, c=1.0, epsilon=0.1, rounds=40)

    def _fit(self, dataset: DataFrame) -> LinearPrediction:
        arrays = self._arrays(dataset).persist()
        mean, sd = moments(arrays, ["y"])["y"]
        weights, intercept = svr(scaled(arrays, {"y": (mean, sd)}), "y", "z", self.getOrDefault("c"), self.getOrDefault("epsilon"), self.getOrDefault("rounds"))
        arrays.unpersist()
        return LinearPrediction(weights=[float(w * sd) for w in weights], intercept=float(intercept * sd + mean), features=self.getOrDefault("features"))


class Ridge(Estimator, _Stage):
    """Ridge regression on a vector column, penalty alpha on unscaled coefficients, as ridge() has it (MOD2)."""

    alpha = Param(Params._dummy(), "alpha", "penalty", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, alpha: float | None = None, features: str | None = None, label: str | None = None):
        super().__init__()
        self._settle(self._input_kwargs, alpha=1.0)

    def _fit(self, dataset: DataFrame):
        features, y = self.getOrDefault("features"), self.getOrDefault("label")
        n, sd = dataset.agg(F.count(y), F.stddev_pop(y)).first()
        return LinearRegression(featuresCol=features, labelCol=y, elasticNetParam=0.0, standardization=False, solver="normal", regParam=self.getOrDefault("alpha") * (sd or 1.0) / max(n, 1)).fit(dataset)


class NeighbourPrediction(Model, _Stage):
    """Mean target of the nearest rows of a written training table (MOD1). Rows need an id that is theirs alone."""

    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    id = Param(Params._dummy(), "id", "column that tells rows apart", TypeConverters.toString)
    path = Param(Params._dummy(), "path", "folder of the training table", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, k: int | None = None, id: str | None = None, path: str | None = None, features: str | None = None):
        super().__init__()
        self._settle(self._input_kwargs, k=5, id="id")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key = self.getOrDefault("id")
        training = dataset.sparkSession.read.parquet(self.getOrDefault("path"))
        asked = dataset.select(F.col(key).alias("id"), vector_to_array(self.getOrDefault("features")).alias("vec"))
        near = knn_regress(asked, training, self.getOrDefault("k")).select(F.col("query_id").alias(key), F.col("pred").alias("prediction"))
        return dataset.join(near, key, "left")


class NearestNeighbours(Estimator, _Stage):
    """Writes the training rows once into the shared folder; the model holds the path, and saved models need that folder (MOD1)."""

    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    id = Param(Params._dummy(), "id", "column that tells rows apart", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, k: int | None = None, id: str | None = None, features: str | None = None, label: str | None = None):
        super().__init__()
        self._settle(self._input_kwargs, k=5, id="id")

    def _fit(self, dataset: DataFrame) -> NeighbourPrediction:
        features, key = self.getOrDefault("features"), self.getOrDefault("id")
        rows = dataset.select(F.col(key).alias("id"), vector_to_array(features).alias("vec"), F.col(self.getOrDefault("label")).cast("double").alias("y"))
        return NeighbourPrediction(k=self.getOrDefault("k"), id=key, path=cut_at(rows, "neighbours"), features=features)


def _kernel(model: Callable, n: int = 64, gamma: float = 1.0, seed: int = 3, **own) -> Pipeline:
    return Pipeline(stages=[KernelFeatures(n=n, gamma=float(gamma), seed=seed), model(**own)])


#: Estimators by name (MOD8); nothing is looked up by evaluating text.
REGISTRY: dict[str, Callable] = {
    "ridge": lambda y="y", alpha=None, **k: Ridge(label=y, alpha=float(alpha)) if alpha is not None else LinearRegression(featuresCol="features", labelCol=y, elasticNetParam=0.0, standardization=False, solver="normal", **k),
    "forest": lambda y="y", **k: forest(True, y=y, **k),
    "forest_classifier": lambda y="y", **k: forest(False, y=y, **k),
    "neighbours": lambda y="y", **k: NearestNeighbours(label=y, **k),
    "pls": lambda y="y", **k: PartialLeastSquares(label=y, **k),
    "svr": lambda y="y", **k: _kernel(lambda c=1.0, **o: SupportVectorRegression(features="kernel", label=y, c=float(c), **o), **k),
    "svc": lambda y="y", **k: _kernel(lambda c=1.0, rounds=100: LinearSVC(featuresCol="kernel", labelCol=y, regParam=1.0 / c, maxIter=rounds), **k),
}


def pipeline(columns: list[str], name: str, y: str = "y", selectors: list = (), constants: bool = True, scaled: bool = False, **params) -> Pipeline:
    """Selectors, assembler, stages fitted with the model, and a model by name (MOD8, FEA8).

    constants=False leaves out columns that don't vary in training, scaled=True takes columns to mean 0
    and deviation 1. params are '<stage>__<param>' or the model's own.
    """
    own = {k.split("__", 1)[1] if k.startswith(f"{name}__") else k: v for k, v in params.items()}
    steps: list = [] if constants else [VarianceThresholdSelector(featuresCol="_assembled", outputCol="_varying" if scaled else "features", varianceThreshold=0.0)]
    if scaled:
        steps.append(StandardScaler(inputCol="_assembled" if constants else "_varying", outputCol="features", withMean=True))
    return Pipeline(stages=[*selectors, VectorAssembler(inputCols=columns, outputCol="_assembled" if steps else "features"), *steps, REGISTRY[name](y=y, **own)])


def at_once(spark: SparkSession, function: Callable, values: list, parallelism: int = 2) -> list:
    """function of each value, in order, with so many Spark jobs running at the same time."""
    with ThreadPool(max(1, min(parallelism, len(values) or 1))) as pool:
        return pool.map(inheritable_thread_target(spark)(function), values)


def search(rows: DataFrame, splits: DataFrame, make: Callable[[dict], Pipeline], combinations: list[dict], y: str = "y", classes: bool = False, parallelism: int = 2) -> tuple[dict, PipelineModel, list[tuple[int, str, float]]]:
    """Best combination by mean validation R2 (accuracy for classes) over given folds, refitted on train and val (MOD9, MOD10).

    splits: (cv, id, split), folds may overlap. The first combination wins ties. Gives (combination,
    model, [(number, cv, score)]). parallelism fits of a fold run at the same time. Rows meet the splits
    in one join, written once; folds are read from that.
    """
    judge = MulticlassClassificationEvaluator(labelCol=y, metricName="accuracy") if classes else RegressionEvaluator(labelCol=y, metricName="r2")
    folds = [r[0] for r in splits.where("cv != 'refit'").select("cv").distinct().orderBy("cv").collect()]
    parts = [(cv, s) for cv in folds for s in ("train", "val")]
    member = [F.max((F.col("cv") == cv) & (F.col("split") == s)).alias(f"_in{i}") for i, (cv, s) in enumerate(parts)]
    used_at_all = F.max(F.col("split").isin("train", "val")).alias("_used")
    placed = cut(rows.join(splits.groupBy("id").agg(*member, used_at_all), "id"), "placed")
    part = lambda cv, s: placed.where(f"_in{parts.index((cv, s))}").select(*rows.columns)
    log = []
    for cv in folds:
        train, val = part(cv, "train"), part(cv, "val")
        score = lambda one, train=train, val=val: float(judge.evaluate(make(one).fit(train).transform(val)))
        log += [(i, cv, s) for i, s in enumerate(at_once(rows.sparkSession, score, combinations, parallelism))]
    mean = [np.mean([s for j, _, s in log if j == i]) for i in range(len(combinations))]
    best = combinations[int(np.argmax(mean))]
    return best, make(best).fit(placed.where("_used").select(*rows.columns)), log


def scored(rows: DataFrame, models: dict[str, PipelineModel], keep: list[str]) -> DataFrame:
    """rows' columns to keep and a prediction column for each named model (MOD12)."""
    out = rows
    for name, model in models.items():
        before = set(out.columns)
        done = model.transform(out)
        made = [c for c in done.columns if c not in before and c != "prediction"]
        out = done.withColumnRenamed("prediction", name).drop(*made)
    return out.select(*keep, *models)


def batch_scored(rows: DataFrame, functions: dict[str, Callable[[pd.Series], pd.Series]], column: str, timed: bool = False) -> DataFrame:
    """rows with a double column for each batch function of a column, a value it can't make being null; timed adds seconds a row (MOD12, UDF1, FN2, FN11)."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{n}` double" + (f", `{n}_time` double" if timed else "") for n in functions])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, function in functions.items():
                began = time.perf_counter()
                frame[name] = pd.to_numeric(function(frame[column]), errors="coerce").astype("float64")
                if timed:
                    frame[f"{name}_time"] = (time.perf_counter() - began) / max(len(frame), 1)
            yield frame

    return rows.mapInPandas(run, schema)


def save_model(model: PipelineModel, path: str, info: dict) -> None:
    """The fitted model, and its info as one JSON line beside it (MOD11)."""
    model.write().save(f"{path}/model")
    SparkSession.getActiveSession().createDataFrame([(json.dumps(info, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/info")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/info").first()[0])


def run_record(spark: SparkSession, key: dict, settings: dict, metrics: DataFrame, seconds: float) -> DataFrame:
    """One row: the model's key, settings, metrics by 'split metric', seconds and environment (MOD14)."""
    found = metrics.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "data_split", "metric"), "value"))).alias("metrics"))
    head = [F.lit(v).alias(k) for k, v in key.items()]
    return found.select(*head, F.lit(json.dumps(settings, sort_keys=True)).alias("settings"), "metrics", F.lit(seconds).alias("seconds"), F.lit(spark.version).alias("spark_version"))


def check_data(log: DataFrame, public: Column, splits: tuple[str, ...] = ("test",)) -> DataFrame:
    """id, task, reference: mean predictions of public items in the given splits, to check a package with (MOD15, D32)."""
    return log.where(public & F.col("data_split").isin(*splits)).groupBy("id", "task").agg(F.avg("pred").alias("reference"))
