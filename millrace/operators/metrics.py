"""Metrics of (truth t, prediction p) pairs and their summaries (MET1-MET16, AGG8, AGG9, AGG19, WIN1, WIN4)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ranking import average_rank, joined, running_sum, with_row_number


def correlation(t: Column, p: Column) -> Column:
    """Pearson; null for fewer than two pairs or a constant side, never an error (MET7)."""
    return F.when(F.count_if(t.isNotNull() & p.isNotNull()) > 1, F.try_divide(F.covar_samp(t, p), F.stddev_samp(t) * F.stddev_samp(p)))


def regression_metrics(t: Column, p: Column) -> dict[str, Column]:
    """Aggregates by name (MET1-MET7, MET14); pairs must not be null."""
    d = p - t
    return {
        "r2": F.lit(1.0) - F.try_divide(F.sum(F.pow(d, 2)), F.var_pop(t) * F.count(F.lit(1))),
        "rmsd": F.sqrt(F.avg(F.pow(d, 2))),
        "mse": F.avg(F.pow(d, 2)),
        "bias": F.avg(d),
        "sdep": F.stddev_pop(d),
        "mae": F.avg(F.abs(d)),
        "pearson": correlation(t, p),
        "y_stddev_pop": F.stddev_pop(t),
        "y_stddev_samp": F.stddev_samp(t),
    }


def evaluated(predictions: DataFrame, keys: list[str], metrics: dict[str, Column], places: int | None = None) -> DataFrame:
    """keys, metric, value: all metrics of all groups in one aggregation (MET15). Rows without truth or prediction count nowhere."""
    wide = predictions.groupBy(*keys).agg(*[(F.bround(m, places) if places is not None else m).cast("double").alias(n) for n, m in metrics.items()])
    return wide.unpivot(keys, list(metrics), "metric", "value")


def spearman(rows: DataFrame, keys: list[str], t: str, p: str) -> DataFrame:
    """keys, spearman: Pearson of average ranks (MET8)."""
    base = rows.where(F.col(t).isNotNull() & F.col(p).isNotNull()).select(*keys, t, p)
    ranked = average_rank(average_rank(base, keys, t, "_rt"), keys, p, "_rp")
    return ranked.groupBy(*keys).agg(correlation(F.col("_rt"), F.col("_rp")).alias("spearman"))


def kendall(rows: DataFrame, keys: list[str], t: str, p: str) -> DataFrame:
    """keys, kendall: tau-b, (P-Q) / sqrt((P+Q+T)(P+Q+U)); null for one pair or a constant side (MET9).

    Distinct (t, p) with counts are numbered by t within the group. On each level of a binary tree
    over those numbers a running sum in the order of p counts, for each row of a left half, the rows
    of its right half with smaller and larger p: n log n rows, none of the n * n pairs.
    """
    pairs = rows.where(F.col(t).isNotNull() & F.col(p).isNotNull()).groupBy(*keys, F.col(t).alias("t"), F.col(p).alias("p")).agg(F.count("*").alias("w"))
    number = with_row_number(pairs.select(*keys, "t").distinct(), ["t"], "i", 0, keys)
    most = number.agg(F.max("i")).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit(max(int(most).bit_length() - 1, 0)))
    leaves = joined(pairs, number, [*keys, "t"]).select(*keys, "p", "w", "i", F.explode(levels).alias("level"))
    half = F.expr("i >> level")
    nodes = leaves.withColumn("half", half).groupBy(*keys, "level", F.expr("half >> 1").alias("node"), "p").agg(F.sum(F.when(F.col("half") % 2 == 0, F.col("w")).otherwise(0)).alias("left"), F.sum(F.when(F.col("half") % 2 == 1, F.col("w")).otherwise(0)).alias("right"))
    group = [*keys, "level", "node"]
    totals = nodes.groupBy(*group).agg(F.sum("right").alias("all_right"))
    counted = joined(running_sum(nodes, group, ["p"], "right", "less"), totals, group)
    sums = counted.groupBy(*keys).agg(F.sum(F.col("left") * F.col("less")).cast("double").alias("q"), F.sum(F.col("left") * (F.col("all_right") - F.col("less") - F.col("right"))).cast("double").alias("c"))
    tied = lambda by, name: pairs.groupBy(*keys, by).agg(F.sum("w").alias("w")).groupBy(*keys).agg(F.sum(F.col("w") * (F.col("w") - 1) / 2).alias(name))
    both = pairs.groupBy(*keys).agg(F.sum(F.col("w") * (F.col("w") - 1) / 2).alias("both"))
    all_ = sums
    for part in (tied("t", "in_t"), tied("p", "in_p"), both):
        all_ = joined(all_, part, keys) if keys else all_.crossJoin(part)  # a row each
    only_t, only_p = F.col("in_t") - F.col("both"), F.col("in_p") - F.col("both")
    s = F.col("c") + F.col("q")
    return all_.select(*keys, F.try_divide(F.col("c") - F.col("q"), F.sqrt((s + only_t) * (s + only_p))).alias("kendall"))


def classification_metrics(rows: DataFrame, keys: list[str], t: str, p: str) -> DataFrame:
    """keys, accuracy, and micro-averaged recall and precision over classes (MET10-MET12)."""
    right = (F.col(t) == F.col(p)).cast("long")
    marks = F.array(F.struct(F.col(t).cast("string").alias("c"), right.alias("tp"), (1 - right).alias("fn"), F.lit(0).cast("long").alias("fp")), F.struct(F.col(p).cast("string").alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fn"), (1 - right).alias("fp")))
    per_class = rows.where(F.col(t).isNotNull() & F.col(p).isNotNull()).select(*keys, F.explode(marks).alias("m")).groupBy(*keys, "m.c").agg(F.sum("m.tp").alias("tp"), F.sum("m.fn").alias("fn"), F.sum("m.fp").alias("fp"))
    return per_class.groupBy(*keys).agg(
        F.try_divide(F.sum("tp").cast("double"), F.sum(F.col("tp") + F.col("fn"))).alias("accuracy"),
        F.try_divide(F.sum("tp").cast("double"), F.sum(F.col("tp") + F.col("fn"))).alias("recall"),
        F.try_divide(F.sum("tp").cast("double"), F.sum(F.col("tp") + F.col("fp"))).alias("precision"),
    )


def top_class(scores: Column) -> Column:
    """Index from 0 of the largest score, the first on ties (MET13)."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def user_metric(function: Callable[[np.ndarray, np.ndarray], float]):
    """A caller's metric of (truth, prediction) arrays as an aggregate of two columns, null where it isn't a number (UDF3).

    A group is handed over whole, so it suits groups that fit one task; the built-in metrics are
    partial aggregates and have no such bound.
    """

    @F.pandas_udf("double")
    def run(t: pd.Series, p: pd.Series) -> float:
        value = float(function(t.to_numpy(), p.to_numpy()))
        return value if np.isfinite(value) else None

    return run


def unmatched(truth: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Ids on one side only, before scoring; none if the shapes agree (MET16)."""
    a, b = truth.select(key).distinct(), predictions.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("truth")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("prediction")))


def summary(values: DataFrame, z: float = 1.69, bounded: tuple[str, ...] = ("rmsd",), keys: list[str] = ()) -> DataFrame:
    """keys, dataset, metric, mean, std, sem, ci95_lower, ci95_upper over resamples (AGG8, AGG9, D14)."""
    keys = [*keys, "dataset", "metric"]
    base = values.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("_n"))
    base = base.withColumn("sem", F.try_divide(F.col("std"), F.sqrt("_n")))
    has = F.col("metric").isin(*bounded)
    return base.select(*keys, "mean", "std", "sem", F.when(has, F.col("mean") - z * F.col("sem")).alias("ci95_lower"), F.when(has, F.col("mean") + z * F.col("sem")).alias("ci95_upper"))


def drift(rows: DataFrame, keys: list[str], stored: str, fresh: str, id_column: str) -> DataFrame:
    """keys, rmsd, mean_diff, largest_diff and where: stored against fresh predictions, ties to the smaller id (AGG19, WIN4)."""
    d = F.col(fresh) - F.col(stored)
    at = F.max_by(F.struct(F.abs(d).alias("size"), F.col(id_column).alias("id")), F.struct(F.abs(d), -F.col(id_column)))
    return rows.where(d.isNotNull()).groupBy(*keys).agg(F.sqrt(F.avg(F.pow(d, 2))).alias("rmsd"), F.avg(d).alias("mean_diff"), at.alias("_at")).select(*keys, "rmsd", "mean_diff", F.col("_at.size").alias("largest_diff"), F.col("_at.id").alias("largest_at"))
