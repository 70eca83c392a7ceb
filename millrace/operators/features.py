"""Feature preparation and graph tables (AGG7, AGG23, FEA1-FEA15, FN12, WIN7-WIN9, UDF2, UDF4, UDF8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import one_of_k


def constant_columns(rows: DataFrame, columns: list[str]) -> list[str]:
    """Columns with one value and no missing one, found in one aggregation (FEA1)."""
    both = rows.agg(F.count("*").alias("_n"), *[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns], *[F.count(c).alias(f"_k_{c}") for c in columns]).first()
    return [c for c in columns if both["_n"] and both[f"_k_{c}"] == both["_n"] and both[f"_lo_{c}"] == both[f"_hi_{c}"]]


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for each pair of columns, a before b, in one aggregation; null with a constant column (AGG7)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    r = [F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)).alias(f"{a}|{b}") for a, b in pairs]
    wide = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).agg(*r)
    return wide.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r").select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r")


def gram(rows: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of products, sums and the number of rows, for many columns: each task adds up a matrix, Spark its cells (MOD3)."""
    p = len(columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p + 1, p + 1))
        for frame in frames:
            x = np.column_stack([np.ones(len(frame)), frame.to_numpy(np.float64)])
            total += x.T @ x
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "v": total.ravel()[at]})

    cells = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop().mapInPandas(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    full = np.zeros((p + 1) ** 2)
    full[cells["at"].to_numpy(np.int64)] = cells["v"]
    full = full.reshape(p + 1, p + 1)
    return full[1:, 1:], full[0, 1:], int(full[0, 0])


def prune_correlated(pairs: list[tuple[str, str, float | None]], columns: list[str], cutoff: float = 0.9) -> list[str]:
    """Columns to remove: pairs from the strongest down, the later column of a pair goes unless either is gone; stops below cutoff (WIN7, FEA2).

    The list has a pair of columns a row, not data. Ties go by position; a null never removes.
    """
    place = {c: i for i, c in enumerate(columns)}
    known = sorted(((-abs(r), *sorted((place[a], place[b]))) for a, b, r in pairs if r is not None))
    gone: set[int] = set()
    for minus, i, j in known:
        if -minus < cutoff:
            break
        if i not in gone and j not in gone:
            gone.add(j)
    return [columns[j] for j in sorted(gone)]


def moments(rows: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each column, 1 for a constant one (FEA3)."""
    got = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]).first()
    return {c: (got[f"_m_{c}"] or 0.0, got[f"_s_{c}"] or 1.0) for c in columns}


def scaled(rows: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns to mean 0 and deviation 1 by what was fitted on the training rows (FEA3, FEA4)."""
    return rows.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


def unscaled(value: Column, mean: float, sd: float) -> Column:
    """A prediction back in the target's units (FEA4, UDF8)."""
    return value * F.lit(sd) + F.lit(mean)


class _Selector(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    inputCols = Param(Params._dummy(), "inputCols", "columns to choose from", TypeConverters.toListString)
    cutoff = Param(Params._dummy(), "cutoff", "absolute correlation from which a column goes", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, cutoff: float = 0.9):
        super().__init__()
        self._setDefault(cutoff=0.9)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})


class SelectorModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Drops the columns that the fit removed; n_removed is their number (FEA7)."""

    removed = Param(Params._dummy(), "removed", "columns that go", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, removed: list[str] | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def n_removed(self) -> int:
        return len(self.getOrDefault(self.removed))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*self.getOrDefault(self.removed))


class ConstantFilter(_Selector):
    """fit finds constant columns (FEA1, FEA7)."""

    def _fit(self, dataset: DataFrame) -> SelectorModel:
        return SelectorModel(removed=constant_columns(dataset, self.getOrDefault(self.inputCols)))


class CorrelationFilter(_Selector):
    """fit finds columns correlated with earlier ones (FEA2, FEA7)."""

    def _fit(self, dataset: DataFrame) -> SelectorModel:
        columns = [c for c in self.getOrDefault(self.inputCols) if c in dataset.columns]
        pairs = [tuple(r) for r in correlations(dataset, columns).collect()]
        return SelectorModel(removed=prune_correlated(pairs, columns, self.getOrDefault(self.cutoff)))


def with_features(rows: DataFrame, registry: dict[str, Column], names: list[str] | None = None, extra: list[str] = (), name: str = "x") -> DataFrame:
    """rows with the chosen features and extra columns as one array of doubles, put together row by row (FEA9, FEA10, D33)."""
    chosen = [registry[n] for n in (names if names is not None else registry) if n in registry] + [F.col(c) for c in extra]
    return rows.withColumn(name, F.array(*[c.cast("double") for c in chosen]))


def node_table(nodes: DataFrame, groups: dict[str, list], unknown: tuple[str, ...] = (), chosen: list[str] | None = None) -> DataFrame:
    """graph_id, node_id, feats: one-of-k marks of the chosen columns; those in unknown have a last slot for other values (FEA11)."""
    parts = [one_of_k(F.col(c), levels, c in unknown) for c, levels in groups.items() if chosen is None or c in chosen]
    return nodes.select("graph_id", "node_id", F.transform(F.concat(*parts), lambda v: v.cast("double")).alias("feats"))


def adjacency(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """graph_id, node, neighbours (sorted, distinct) of undirected edges (FEA12, WIN9); nodes without an edge have none."""
    both = edges.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("to")).union(edges.select("graph_id", "dst", "src"))
    lists = both.groupBy("graph_id", "node").agg(F.array_sort(F.collect_set("to")).alias("neighbours"))
    if nodes is None:
        return lists
    return nodes.select("graph_id", F.col("node_id").alias("node")).join(lists, ["graph_id", "node"], "left").withColumn("neighbours", F.coalesce("neighbours", F.expr("array()").cast(lists.schema["neighbours"].dataType)))


def master_nodes(nodes: DataFrame, node_id: int = -1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one more node a graph: the mean of all features, joined to every node (AGG23, FEA13)."""
    mean = nodes.select("graph_id", F.posexplode("feats").alias("i", "v")).groupBy("graph_id", "i").agg(F.avg("v").alias("v"))
    rows = mean.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("feats"))
    master = rows.select("graph_id", F.lit(node_id).cast(nodes.schema["node_id"].dataType).alias("node_id"), "feats")
    edges = nodes.select("graph_id", F.lit(node_id).cast(nodes.schema["node_id"].dataType).alias("src"), F.col("node_id").alias("dst"))
    return master, edges


def dataset_shape(rows: DataFrame, x: str = "x") -> DataFrame:
    """n_rows and n_features (AGG24)."""
    return rows.agg(F.count("*").alias("n_rows"), F.max(F.size(x)).alias("n_features"))
