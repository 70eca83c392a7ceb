"""Ensembles, uncertainty and averages over refits (AGG13-AGG18, FIL5, FIL6, JN3, JN4, MOD13, SET6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import round_half_up


def mean_and_spread(members: DataFrame, key: str = "id", value: str = "pred", places: int | None = None) -> DataFrame:
    """key, mean and population standard deviation over members (AGG13); places rounds half up, as for single models."""
    out = members.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"))
    return out.withColumn("mean", round_half_up(F.col("mean"), places)).withColumn("spread", round_half_up(F.col("spread"), places))


def draw_uncertainty(draws: DataFrame, key: str = "id", pred: str = "pred", variance: str = "variance") -> DataFrame:
    """key, mean, total, aleatoric, epistemic from repeated draws with predicted variances (AGG14).

    aleatoric = sqrt(E[v]), epistemic = sqrt(E[p^2] - E[p]^2), total = sqrt(of both squares' sum).
    """
    spread, noise = F.var_pop(pred), F.avg(variance)
    return draws.groupBy(key).agg(F.avg(pred).alias("mean"), F.sqrt(spread + noise).alias("total"), F.sqrt(noise).alias("aleatoric"), F.sqrt(spread).alias("epistemic"))


def total_uncertainty(members: DataFrame, key: str = "id", pred: str = "pred", uncertainty: str = "uncertainty") -> DataFrame:
    """key, as_published = sqrt(var(u) + var(p)), total_variance = sqrt(E[u^2] + var(p)) (AGG15, D30)."""
    spread = F.var_pop(pred)
    return members.groupBy(key).agg(F.sqrt(F.var_pop(uncertainty) + spread).alias("as_published"), F.sqrt(F.avg(F.pow(F.col(uncertainty), 2)) + spread).alias("total_variance"))


def refit_average(log: DataFrame) -> DataFrame:
    """task, id, pred: mean over resamples of the refitted models' predictions where the item was in test (AGG16)."""
    return log.where("cv_fold = 'refit' and data_split = 'test'").groupBy("task", "id").agg(F.avg("pred").alias("pred"))


def refit_rows(log: DataFrame) -> DataFrame:
    """refit_average as prediction-log rows under resample -1, fold av_over_refits, model -1; items with a mean for every task only."""
    mean = refit_average(log)
    n_tasks = mean.agg(F.count_distinct("task")).first()[0]
    whole = mean.groupBy("id").agg(F.count("pred").alias("n")).where(F.col("n") == n_tasks).select("id")
    return mean.join(whole, "id", "left_semi").select(F.lit(-1).alias("resample"), F.lit("av_over_refits").alias("cv_fold"), F.lit(-1).alias("model_number"), F.lit("test").alias("data_split"), "task", "id", "pred")


def mean_by_split(log: DataFrame, splits: list[str]) -> DataFrame:
    """task, id and the mean prediction in each split as a column (AGG17, SET6)."""
    return log.groupBy("task", "id").pivot("data_split", splits).agg(F.avg("pred"))


def rmsd_of_means(log: DataFrame, truth: DataFrame) -> DataFrame:
    """task, data_split, rmsd of the items' mean predictions against truth (task, id, t) (AGG18, JN3)."""
    mean = log.groupBy("task", "data_split", "id").agg(F.avg("pred").alias("pred"))
    return mean.join(truth, ["task", "id"]).groupBy("task", "data_split").agg(F.sqrt(F.avg(F.pow(F.col("pred") - F.col("t"), 2))).alias("rmsd"))


def selected_models(log: DataFrame, selected: DataFrame, keys: tuple[str, ...] = ("resample", "cv_fold", "model_number")) -> DataFrame:
    """Rows of the log of selected models (JN4)."""
    return log.join(selected.select(*keys).distinct(), list(keys), "left_semi")


def linear_members(features: DataFrame, members: DataFrame, most: int = 10_000) -> DataFrame:
    """id, member, pred of every linear member over features made once (MOD13, FEA4).

    members: member, weights array, intercept, y_mean, y_sd; predictions are put back to the target's
    units. Members are models, broadcast up to most of them.
    """
    if members.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} members")
    raw = F.aggregate(F.zip_with("x", "weights", lambda a, b: a * b), F.col("intercept").cast("double"), lambda s, v: s + v)
    return features.select("id", "x").crossJoin(F.broadcast(members)).select("id", "member", (raw * F.col("y_sd") + F.col("y_mean")).alias("pred"))
