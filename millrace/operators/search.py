"""Hyperparameter grids, work lists, choice of the best model and early stopping (SPL12, SPL13, AGG10-AGG12, AGG20-AGG22, WIN3, WIN5, WIN6, JN5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.rows import unfinished


def grid(spark: SparkSession, space: dict[str, list]) -> DataFrame:
    """model_number from 0 and one text column for each hyperparameter, in the order of _order, the last changing fastest (SPL12)."""
    names = space.get("_order", [k for k in space if k != "_order"])
    total = 1
    for n in names:
        total *= len(space[n])
    out, block = spark.range(total).select(F.col("id").alias("model_number")), total
    for n in names:
        block //= len(space[n])
        values = F.array(*[F.lit(str(v)) for v in space[n]])
        at = (F.floor(F.col("model_number") / block) % len(space[n])).cast("int")
        out = out.withColumn(n, F.get(values, at))
    return out


def grid_of(frames: dict[str, DataFrame]) -> DataFrame:
    """The grid where each hyperparameter's values are a one-column table."""
    out = None
    for frame in frames.values():
        out = frame if out is None else out.crossJoin(frame)
    return out


def sampled_grid(combinations: DataFrame, n: int, seed: int, resample: int = 0) -> DataFrame:
    """n different combinations, drawn by md5 of seed + resample and the number (SPL13)."""
    return combinations.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed + resample)), F.col("model_number").cast("string"))), "model_number").limit(n)


def work_list(folds: DataFrame, combinations: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Every fold (resample, cv_fold) with every combination, less what is done (JN5, FIL13)."""
    work = folds.select("resample", "cv_fold").distinct().crossJoin(combinations)
    return work if done is None else unfinished(work, done, [c for c in work.columns if c != "model_number"])


def fold_means(log: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Mean over folds for each combination (AGG10)."""
    return log.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures], F.count_distinct("cv_fold").alias("n_folds"))


def complete_resamples(log: DataFrame, n_folds: int, n_models: int) -> DataFrame:
    """Resamples of which every fold has every model (AGG11)."""
    per_fold = log.groupBy("resample", "cv_fold").agg(F.count_distinct("model_number").alias("models"))
    found = per_fold.groupBy("resample").agg(F.count("*").alias("folds"), F.min("models").alias("least"))
    return found.where((F.col("folds") == n_folds) & (F.col("least") == n_models)).select("resample")


def best_configuration(log: DataFrame, metric: str = "loss", largest: bool = False) -> DataFrame:
    """For each resample the model_number of best mean metric over folds, ties to the smaller number (WIN3)."""
    mean = log.groupBy("resample", "model_number").agg(F.avg(metric).alias(metric))
    best = Window.partitionBy("resample").orderBy(F.desc_nulls_last(metric) if largest else F.asc_nulls_last(metric), "model_number")
    return mean.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def mean_epochs(log: DataFrame, epochs: str = "epochs") -> DataFrame:
    """resample and the rounded mean of the stopping epochs (AGG12)."""
    return log.groupBy("resample").agg(F.round(F.avg(epochs)).cast("int").alias("epochs"))


def class_counts(rows: DataFrame, column: str) -> DataFrame:
    """Number of distinct classes or tasks (AGG20, AGG21)."""
    return rows.agg(F.count_distinct(column).alias("n_classes"))


def largest_over(sets: list[DataFrame], column: str) -> DataFrame:
    """Maximum over several sets (AGG22)."""
    out = sets[0].select(column)
    for s in sets[1:]:
        out = out.unionByName(s.select(column))
    return out.agg(F.max(column).alias(column))


def running_best(epochs: DataFrame, run: str = "run", epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """epochs with the lowest loss so far and its first epoch (WIN5)."""
    upto = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    best = F.min(F.struct(F.col(loss).alias("loss"), F.col(epoch).alias("epoch"))).over(upto)
    return epochs.withColumn("_best", best).select(*epochs.columns, F.col("_best.loss").alias("best_loss"), F.col("_best.epoch").alias("best_epoch"))


def stopping_epoch(epochs: DataFrame, limit: int, patience: int, threshold: float, run: str = "run", epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """run and the epoch to use under the early-stop rule (WIN6); null where a run ends before it decides.

    A check falls due after min(patience, limit) epochs. There, a run at its limit stops with the
    limit; one whose best loss fell by threshold or less since the last check stops with its best
    epoch; else the next check is at best epoch + patience, the limit at most. Losses fold over a
    run's epochs, of which there are limit at most. Epochs count from 1.
    """
    series = F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("int").alias("epoch"), F.col(loss).cast("double").alias("loss"))))
    runs = epochs.where((F.col(epoch) <= limit) & F.col(loss).isNotNull()).groupBy(run).agg(series.alias("s"))
    inf = F.lit(float("inf"))
    start = F.struct(F.lit(min(patience, limit)).alias("due"), inf.alias("before"), inf.alias("best"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("stop"))

    def step(state, x):
        better = x["loss"] < state["best"]
        best, at = F.when(better, x["loss"]).otherwise(state["best"]), F.when(better, x["epoch"]).otherwise(state["at"])
        check = state["stop"].isNull() & (x["epoch"] == state["due"])
        stop = F.when(check & (x["epoch"] == limit), F.lit(limit)).when(check & (state["before"] - best <= threshold), at).otherwise(state["stop"])
        due = F.when(check, F.greatest(F.least(at + patience, F.lit(limit)), x["epoch"] + 1)).otherwise(state["due"])
        return F.struct(due.alias("due"), F.when(check, best).otherwise(state["before"]).alias("before"), best.alias("best"), at.alias("at"), stop.alias("stop"))

    return runs.select(run, F.aggregate("s", start, step)["stop"].alias("stop_epoch"))
