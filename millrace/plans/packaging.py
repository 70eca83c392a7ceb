"""Packaging of a model-building job's result in one call (MOD15, SNK13, SNK14).

A package is written into a staging folder beside its place, its files are listed with their digests,
it is read back and checked, and only then it is moved to its place. What stands there is whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.jobs import _descriptors, _prepared
from millrace.sources.stores import changed_files, manifest, there
from millrace.sources.writers import package_training_data


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _copied(spark: SparkSession, source: str, target: str) -> None:
    """Copies a folder of model files, which don't grow with the data but for neighbours."""
    util, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil, spark.sparkContext._jsc.hadoopConfiguration()
    if not util.copy(_system(spark, source), _path(spark, source), _system(spark, target), _path(spark, target), False, conf):
        raise OSError(f"could not copy {source}")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path under the package, length and md5 of its files."""
    root = _path(spark, path).toUri().getPath()
    return manifest(spark, path).withColumn("path", F.substr("path", F.locate(f"{root}/", F.col("path")) + len(root) + 1))


def package(items: DataFrame, folder: str, out: str, rename: dict[str, str], public: Column | None = None, info: dict | None = None) -> None:
    """Puts the last job under folder, which was built from items, into a package at out.

    It has the models by resample and task, the training data with the columns of rename under their
    public names, check data (resample, task, id, reference) of the public items in test, the job's settings and
    info, and the list of all files. A package that is there already is refused, as is a job that kept no models.
    """
    spark = items.sparkSession
    if there(spark, out):
        raise ValueError(f"{out} exists")
    key = spark.read.parquet(f"{folder}/current").first().key
    at = lambda kind: f"{folder}/{kind}/job={key}"
    if not there(spark, at("models")):
        raise ValueError("the job kept no models")
    settings = json.loads(spark.read.parquet(at("run_log")).first().settings)
    staging = f"{out}.staging-{uuid.uuid4().hex}"
    _copied(spark, at("models"), f"{staging}/models")
    data = settings["dataset"]
    known = items.withColumn("_id", F.col(data.get("id_field", "id")))
    package_training_data(known.where(public) if public is not None else known, f"{staging}/training", rename)
    log = spark.read.parquet(at("predictions")).where("split = 'test'").select("resample", F.col("target").alias("task"), F.col("task").alias("task_number"), "id", F.col("prediction").alias("reference"))
    shown = known.select(F.col("_id").alias("id")) if public is None else known.where(public).select(F.col("_id").alias("id"))
    log.join(shown, "id", "left_semi").write.parquet(f"{staging}/check")
    whole = {"settings": settings, "key": key, "spark": spark.version, "info": info or {}}
    spark.createDataFrame([(json.dumps(whole, sort_keys=True),)], "value string").coalesce(1).write.text(f"{staging}/info")
    _files(spark, staging).write.parquet(f"{staging}/_manifest")
    checked_package(spark, staging)
    if (worst := reproduced(spark, staging, items).agg(F.max("largest_diff")).first()[0] or 0.0) > 1e-6:
        raise ValueError(f"the package's models differ by {worst} from the job's predictions")
    if not _system(spark, out).rename(_path(spark, staging), _path(spark, out)):
        raise OSError(f"could not move {staging}")


def checked_package(spark: SparkSession, path: str) -> dict:
    """A package's info; an error names what is missing, changed or not listed."""
    if not there(spark, f"{path}/_manifest/_SUCCESS"):
        raise ValueError(f"{path} is no whole package")
    wrong = changed_files(_files(spark, path), spark.read.parquet(f"{path}/_manifest")).collect()
    if wrong:
        raise ValueError(f"files of {path}: {sorted((r.path, r.reason) for r in wrong)}")
    return json.loads(spark.read.text(f"{path}/info").first()[0])


def packaged_model(spark: SparkSession, path: str, resample: int = 0, task: int = 0) -> PipelineModel:
    return PipelineModel.load(f"{path}/models/resample={resample}/task={task}")


def reproduced(spark: SparkSession, path: str, items: DataFrame) -> DataFrame:
    """resample, task, n, rmsd and largest_diff of the package's models against its check data, on the items of the job (AGG19)."""
    told = json.loads(spark.read.text(f"{path}/info").first()[0])["settings"]
    usable = _prepared(items, told["dataset"]).select("id", *_descriptors(told["dataset"]))
    check = spark.read.parquet(f"{path}/check")
    out = None
    for r, number in sorted(map(tuple, check.select("resample", "task_number").distinct().collect())):
        mine = check.where((F.col("resample") == r) & (F.col("task_number") == number))
        found = packaged_model(spark, path, r, number).transform(usable.withColumn("y", F.lit(0.0)).join(mine, "id"))
        d = F.col("prediction") - F.col("reference")
        one = found.groupBy("resample", "task").agg(F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmsd"), F.max(F.abs(d)).alias("largest_diff"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "resample int, task string, n long, rmsd double, largest_diff double")
