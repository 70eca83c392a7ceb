"""Scoring and profiling of arriving rows with Structured Streaming (STR1-STR4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.scalar import bin_index
from millrace.operators.profile import histogram
from millrace.plans.jobs import ScoringJob, run_scoring
from millrace.sources.stores import append_run, merged


def arriving(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """Parquet files as a stream, so many a batch (SRC5)."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def score_stream(rows: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Scores what has arrived and appends it (STR1)."""
    return score(rows).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scoring_stream(rows: DataFrame, job: ScoringJob, folder: str, checkpoint: str, name: str) -> StreamingQuery:
    """A whole scoring job on each batch: scored rows, rejects, profile and counters under one run, (name, batch) (STR1).

    A batch that is run again replaces all of its tables, and jobs.totals() takes finished batches only, so after a
    stop and restart the totals are those of the job over all rows at once.
    """

    def score(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            run_scoring(batch, job, folder, f"{name}-{number}")
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_histogram(rows: DataFrame, widths: dict[str, str | float]) -> DataFrame:
    """The running profile of a stream, for update or complete mode (STR2)."""
    return histogram(rows, widths)


def profile_stream(rows: DataFrame, widths: dict[str, str | float], store: str, checkpoint: str, name: str) -> StreamingQuery:
    """Adds each batch's profile to a store under (name, batch): a batch that is run again replaces itself (STR3, D8)."""

    def add(batch: DataFrame, number: int) -> None:
        append_run(histogram(batch, widths), store, f"{name}-{number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_profile(spark: SparkSession, store: str) -> DataFrame:
    return merged(spark, store, ["value_name", "bin_idx"], schema="value_name string, bin_idx long, n long")


def windowed_histogram(rows: DataFrame, time: str, value: str, width: str | float, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, bin_idx, n for each window of event time; rows later than the watermark are dropped (STR4)."""
    binned = rows.withWatermark(time, late).withColumn("bin_idx", bin_index(F.col(value), width)).where("bin_idx is not null")
    return binned.groupBy(F.window(time, window).alias("w"), "bin_idx").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "bin_idx", "n")
