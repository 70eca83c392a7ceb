"""Shared storage: cutting lineage, run-tagged stores, manifests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it gets a temporary folder, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_at(df: DataFrame, tag: str) -> str:
    """Writes df as Parquet into the shared folder and gives its path."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back."""
    return df.sparkSession.read.schema(df.schema).parquet(cut_at(df, tag))


def there(spark: SparkSession, path: str) -> bool:
    """Whether a store holds the path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """Adds partial results under a run's key. Writing a run again replaces it, with no rows too, so retries and restarts don't count twice (SNK4, SNK6, AGG3)."""
    df.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def merged(spark: SparkSession, path: str, keys: list[str], measure: str = "n", schema: str | None = None) -> DataFrame:
    """Totals over all runs of a store: what stands in one only counts as it is (SRC14, JN8). With a schema, a store without runs is empty."""
    stored = spark.createDataFrame([], schema) if schema and not there(spark, path) else spark.read.parquet(path)
    return stored.groupBy(*keys).agg(F.sum(measure).alias(measure))


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and md5 of each file under a folder, computed where the files are read (SNK14)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.md5("content").alias("md5"))


def changed_files(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded files that are missing or differ, and files that are not recorded."""
    gone = recorded.join(current, ["path", "md5"], "left_anti").select("path", F.lit("missing or changed").alias("reason"))
    new = current.join(recorded, "path", "left_anti").select("path", F.lit("not recorded").alias("reason"))
    return gone.unionByName(new)
