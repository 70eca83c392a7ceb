"""Results, rejects, logs and packages (SNK1-SNK13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.profile import pivoted


def ranged_name(prefix: str, start: int, end: int) -> str:
    """Output name that carries the row range (SNK2)."""
    return f"{prefix}_{start}_{'end' if end == -1 else end}"


def write_scored(rows: DataFrame, path: str, kind: str = "parquet", overwrite: bool = False) -> None:
    """Scored rows; csv is ';'-separated, gzipped and has a header. An existing output is refused (SNK1, SNK2)."""
    writer = rows.write.mode("overwrite" if overwrite else "errorifexists")
    if kind == "csv":
        writer.option("sep", ";").option("header", True).option("compression", "gzip").csv(path)
    else:
        writer.parquet(path)


def write_rejects(rejects: DataFrame, path: str) -> None:
    """id;structure without a header (SNK3)."""
    rejects.select("id", "structure").write.mode("errorifexists").option("sep", ";").csv(path)


def export_profile(profile: DataFrame, path: str, flags: list[str] | None = None) -> None:
    """One CSV: bin and count, or bin and a count for each flag (SNK4, SNK5). A profile has a row a bin, so one file is small."""
    wide = pivoted(profile, flags) if flags else profile
    wide.orderBy("bin_idx").coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def write_splits(splits: DataFrame, path: str) -> None:
    """The split table, a folder for each resample (SNK7)."""
    splits.write.mode("errorifexists").partitionBy("resample").parquet(path)


def append_predictions(predictions: DataFrame, path: str) -> None:
    """Long prediction rows by resample and split (SNK8, SNK9)."""
    predictions.write.mode("append").partitionBy("resample", "data_split").parquet(path)


def wide_predictions(predictions: DataFrame, resamples: list[int]) -> DataFrame:
    """A row for each (dataset, id), a column for each resample (SNK9)."""
    return predictions.groupBy("dataset", "id").pivot("resample", resamples).agg(F.first("pred"))


def append_run_log(rows: DataFrame, path: str) -> None:
    """One row for each trained model (SNK10)."""
    rows.write.mode("append").parquet(path)


def export_performance(performance: DataFrame, path: str) -> None:
    """The average performance as one CSV, a few dozen rows (SNK11)."""
    performance.orderBy("dataset", "metric").coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def epoch_table(epochs: DataFrame, names: list[str]) -> DataFrame:
    """Epochs from 1, a column for each 'split metric' (SNK12)."""
    named = epochs.withColumn("name", F.concat_ws(" ", "split", "metric"))
    return named.groupBy("run", (F.col("epoch") + 1).alias("Epoch")).pivot("name", names).agg(F.first("value")).orderBy("run", "Epoch")


def package_training_data(rows: DataFrame, path: str, rename: dict[str, str], fingerprint: str | None = None) -> None:
    """Chosen columns under public names; a binary fingerprint as base64 text (SNK13)."""
    out = rows.select(*[(F.base64(F.col(c)) if c == fingerprint else F.col(c)).alias(n) for c, n in rename.items()])
    out.write.mode("errorifexists").parquet(path)
