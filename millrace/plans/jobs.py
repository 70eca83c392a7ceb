"""Whole jobs in one call each, which take up where they stopped.

A scoring job: rejects, rule cascade, expansion, scores, profiles and counters, by run (FIL1-FIL3,
EXP1, SNK1, SNK3, SNK4, SNK6, AGG1-AGG6, FIL13, FIL14). A model-building job: splits, search by a work
list, refit, predictions and performance (SPL1-SPL10, SPL12, SPL13, MOD8-MOD10, MOD12, FIL13, JN5).
"""

from __future__ import annotations

import hashlib
import json
import time
import warnings
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalar import typed_value
from millrace.operators import ensemble, metrics, models, profile, rows, search, selection, splits
from millrace.operators.scoring import BatchModel, with_models
from millrace.plans.spec import ScoreSpec, checked_settings
from millrace.sources.stores import cut, there


@dataclass
class ScoringJob:
    """What a job does with its items (id and the caller's columns).

    Invalid items are rejects. Items that break a rule of the cascade are rejects too, with its codes
    as the reason, but for those that break only rules with the prefix tolerated. variants, if given,
    makes several rows of an item before names are scored. models run over those rows in one pass; their
    outputs are columns that names and profiles may use, with seconds a row if timed.
    """

    spec: ScoreSpec
    names: list[str]
    valid: Column = field(default_factory=lambda: F.lit(True))
    rules: list[tuple[str, Column]] = field(default_factory=list)
    tolerated: str | None = None
    variants: Column | None = None
    models: dict[str, BatchModel] = field(default_factory=dict)
    timed: bool = False


def _folder(folder: str, kind: str, run_id: str) -> str:
    return f"{folder}/{kind}/run_id={run_id}"


def _stored(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    # run ids are text: 001 is not 1
    own = spark.read.parquet(f"{folder}/{kind}/run_id=*").schema
    return spark.read.schema(own.add("run_id", "string")).parquet(f"{folder}/{kind}")


def run_scoring(items: DataFrame, job: ScoringJob, folder: str, run_id: str) -> None:
    """Writes scored, rejects, profile and counters of one run under folder, which all executors share.

    A run that is done again replaces its own tables, so restarts and retries don't count twice. Items
    are scored once: profiles are taken from what was written. Without items the run warns and writes
    empty tables.
    """
    spark = items.sparkSession
    ok = F.coalesce(job.valid, F.lit(False))
    passes = F.col("pass")
    if job.tolerated is not None:  # of several broken rules, all have to be tolerated
        passes |= F.coalesce(F.forall(F.split("warning", ":"), lambda code: code.startswith(job.tolerated)), F.lit(False))
    judged = rows.cascade(items, job.rules)
    judged = judged.withColumn("reason", F.when(~ok, F.lit("invalid")).when(~passes, F.col("warning")))
    good = judged.where("reason is null")
    if job.variants is not None:
        good = rows.expanded(good, job.variants)
    good = with_models(good.drop("reason", "pass"), job.models, job.timed)
    job.spec.score(good, job.names).write.mode("overwrite").parquet(_folder(folder, "scored", run_id))
    judged.where("reason is not null").drop("pass", "warning").write.mode("overwrite").parquet(_folder(folder, "rejects", run_id))
    scored = spark.read.parquet(_folder(folder, "scored", run_id))
    flags = job.spec.flags
    profiled = profile.histogram_by_flag(scored, job.spec.profiles, flags) if flags else profile.histogram(scored, job.spec.profiles)
    profiled.write.mode("overwrite").parquet(_folder(folder, "profile", run_id))
    bad = F.col("reason") == "invalid"
    rules = {"items": F.lit(True), "valid": F.col("reason").isNull() | ~bad, "invalid": bad, "passed": F.col("reason").isNull()}
    counted = profile.counters(judged, rules)
    counted.write.mode("overwrite").parquet(_folder(folder, "counters", run_id))
    if not spark.read.parquet(_folder(folder, "counters", run_id)).where("counter = 'items' and n > 0").count():
        warnings.warn(f"run {run_id} has no items", stacklevel=2)


def finished_runs(spark: SparkSession, folder: str) -> DataFrame:
    """run_id of the runs whose last table is written, to take from the work list with rows.unfinished()."""
    return _stored(spark, folder, "counters").select("run_id").distinct()


def totals(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Profile and counters, summed over all finished runs."""
    profiled = _stored(spark, folder, "profile").join(finished_runs(spark, folder), "run_id", "left_semi")
    return profile.merge(profiled.drop("run_id")), profile.merge(_stored(spark, folder, "counters").drop("run_id"))


def _outer(items: DataFrame, how: dict, seed: int) -> DataFrame:
    """resample, id, split by the settings of the train / test split."""
    n, test = int(how.get("n_splits", 1)), float(how.get("frac_test", 0.25))
    train = float(how["frac_train"]) if "frac_train" in how else None
    by = how.get("strat_field")
    match how.get("split_method", "random"):
        case "rand" | "random":
            return splits.random_splits(items, n, test, train, seed)
        case "strat" | "stratified":
            return splits.stratified_splits(items, by, n, 1 - test if train is None else train, seed)
        case "group":
            return splits.grouped_splits(items, by, n, 1 - test if train is None else train, seed)
        case "predefined":
            lists = items.sparkSession.read.parquet(how["from_file"])
            return splits.predefined_splits(items, lists).select(F.lit(0).alias("resample"), "id", "split")
    raise ValueError(f"unknown split method {how['split_method']}")


def _nested(outer: DataFrame, items: DataFrame, how: dict, seed: int) -> DataFrame:
    """resample, cv, id, split by the settings of the train / validation split, from the outer split.

    A predefined split is a table (id, split) with a column cv for several folds and resample for those
    of one resample. Balanced folds of whole groups are walked one resample after another.
    """
    n, by, method, test = int(how.get("n_splits", 5)), how.get("strat_field"), how.get("split_method", "k-fold"), float(how.get("frac_test", 0.25))
    if method == "predefined":
        return splits.nested_predefined(outer, items.sparkSession.read.parquet(how["from_file"]))
    if method in ("stratified", "strat"):
        return splits.nested_drawn(outer, method, n, 1 - float(how["frac_train"]) if "frac_train" in how else test, seed, items.select("id", F.col(by).alias("stratum")))
    if method != "group":
        return splits.nested_drawn(outer, method, n, test, seed)

    def drawn(ids: DataFrame, resample: int) -> DataFrame:
        folds = splits.grouped_kfold(items.join(ids, "id", "left_semi"), by, n).withColumn("cv", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return folds.select("cv", "id", F.when(F.col("cv") == F.col("fold"), "test").otherwise("train").alias("split"))

    return splits.nested(outer, drawn)


def _measures(classes: bool) -> dict[str, Column]:
    """Aggregates of y and prediction; loss is what selection takes if nothing else is named."""
    if classes:
        right = F.avg((F.col("y") == F.col("prediction")).cast("double"))
        return {"loss": 1 - right, "accuracy": right}
    found = metrics.regression_metrics(F.col("y"), F.col("prediction"))
    return {"loss": found["mse"], **{n: found[n] for n in ("r2", "rmsd", "bias", "mae", "pearson")}}


#: Settings that belong to engines which this library doesn't have; a job that names them is refused.
REFUSED = {"early_stopping", "early_stopping_patience", "early_stopping_threshold", "epochs", "uncertainty"}


def _checked(settings: dict) -> dict:
    """The job's settings; what the job wouldn't act on is an error."""
    told = checked_settings(settings)
    data, training = told["dataset"], told["training"]
    ignored = sorted({k for k in REFUSED if training.get(k)} | {k for k in ("preprocessing", "trained_model", "training_data", "test_data", "output_options") if told.get(k)} | {k for k in ("fingerprints",) if data.get(k)})
    if ignored:
        raise ValueError(f"a job doesn't act on {ignored}")
    if training["model_fn_str"] not in models.REGISTRY.keys() | selection.PIPELINES.keys():
        raise ValueError(f"unknown model {training['model_fn_str']}")
    if not data["tasks"] or len(set(data["tasks"])) < len(data["tasks"]):
        raise ValueError("a job has targets, each once")
    if training["save_model"] not in ("refit", "none") or training["save_predictions"] != "refit":
        raise ValueError("save_model is refit or none, save_predictions refit, as a restart needs them")
    return told


def _prepared(items: DataFrame, data: dict, extra: list[str] = ()) -> DataFrame:
    """id, descriptors, fields to split by and a column _y<i> for each target. Rows without id, a descriptor or any target go."""
    columns = _descriptors(data)
    targets = [f"_y{i}" for i in range(len(data["tasks"]))]
    usable = items.select(
        F.col(data.get("id_field", "id")).alias("id"), *[F.col(c).cast("double").alias(c) for c in columns], *[F.col(c).alias(f"_by_{c}") for c in extra],
        *[F.nanvl(F.col(t).cast("double"), F.lit(None).cast("double")).alias(y) for t, y in zip(data["tasks"], targets, strict=True)],
    )
    return usable.na.drop(subset=["id", *columns]).na.drop("all", subset=targets)


def _descriptors(data: dict) -> list[str]:
    return list(dict.fromkeys([*data["descriptors"], *data.get("extra_desc", [])]))


def job_key(usable: DataFrame, told: dict, seed: int) -> str:
    """What a job's splits and fits depend on, but for the values tried: model, settings, seed and the data's count and sum of row hashes."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in usable.columns])
    n, total = usable.agg(F.count("*"), F.sum(row.cast("decimal(38,0)"))).first()
    space = told.get("hyperparams", {})
    parts = [told["dataset"], told.get("train_test_split"), told.get("train_val_split"), told["training"]["model_fn_str"], sorted(k for k in space if k != "_order"), seed, n, str(total)]
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:24]


def external_items(spark: SparkSession, told: dict) -> dict[str, DataFrame]:
    """The prepared external sets of the settings, each read from its dataset_file with the main set's settings where it gives none (SRC9)."""
    found = {}
    sets = told.get("ext_datasets") or {}
    for name in sets.get("_order", [k for k in sets if k != "_order"]):
        own = told["dataset"] | sets[name]
        path = own["dataset_file"]
        table = spark.read.option("header", True).csv(path) if path.removesuffix(".gz").endswith(".csv") else spark.read.parquet(path)
        found[name] = _prepared(table, own | {"tasks": told["dataset"]["tasks"]})
    if wrong := {"train", "test", "ensemble"} & found.keys():
        raise ValueError(f"external sets can't be called {sorted(wrong)}")
    return found


def run_models(items: DataFrame, settings: dict, folder: str, seed: int = 0, parallelism: int | None = None) -> DataFrame:
    """Builds models as the settings say, under folder, and returns task, dataset, metric, mean, std, sem, ci95_lower, ci95_upper.

    Settings: dataset (tasks, descriptors, extra_desc, id_field, mode regression or classification),
    train_test_split, train_val_split, training (model_fn_str a name in models.REGISTRY or selection.PIPELINES, search, n_iter,
    selection_metric, select_max_value, n_cpus fits at a time, save_model refit or
    none, calculate_ensemble_performance), hyperparams (lists of values) and ext_datasets. What a job
    wouldn't act on is refused. Items without an id, a descriptor or any target take no part; ids must be
    unique. Each target has models of its own, learned and judged on the items that have it; splits and
    the chosen combination are those of all targets together.

    Folder gets, under the job's key, splits, a log row for each model of each fold, and for each resample and target
    the refitted model, its predictions of train, test and external items, and a row of the run log;
    further averages (mean of the refits' predictions of an item where it was in test, for items whole in
    all targets) and performance. A job that is called again does only what isn't written yet. Another
    model, target, column, split, seed or data has another key, so nothing of it is taken. The driver
    loops over models, never rows.
    """
    spark, told = items.sparkSession, _checked(settings)
    data, training = told["dataset"], told["training"]
    classes, name, columns, tasks = data.get("mode") == "classification", training["model_fn_str"], _descriptors(data), list(data["tasks"])
    parallelism = parallelism or int(training.get("n_cpus", 2))
    fields = sorted({told.get(k, {}).get("strat_field") for k in ("train_test_split", "train_val_split")} - {None})
    usable = _prepared(items, data, fields)
    how = {k: {n: f"_by_{v}" if n == "strat_field" else v for n, v in told.get(k, {}).items()} for k in ("train_test_split", "train_val_split")}
    key = job_key(usable, told, seed)
    at = lambda kind: f"{folder}/{kind}/job={key}"

    def draw() -> DataFrame:
        outer = splits.cut(_outer(usable, how["train_test_split"], seed), "outer")
        return _nested(outer, usable, how["train_val_split"], seed)

    table = splits.stored_splits(spark, at("splits"), draw)
    grid = search.grid(spark, told.get("hyperparams", {}))
    names = [c for c in grid.columns if c != "model_number"]
    folds = [(r[0], r[1]) for r in table.where("cv != 'refit'").select("resample", "cv").distinct().orderBy("resample", "cv").collect()]
    if not folds:
        raise ValueError("the settings give no inner split")
    targets = spark.createDataFrame([(t,) for t in tasks], "task string")
    done = _log(spark, at("log")).select("resample", "cv_fold", "task", *names) if there(spark, at("log")) else None

    def make(values: dict):
        if name in selection.PIPELINES:
            return selection.staged_pipeline(columns, name, **values)
        return models.pipeline(columns, name, constants=False, **values)

    stands = [*folds, *[(r, "refit") for r in sorted({r for r, _ in folds})]]
    in_split = lambda r, cv: F.col(f"_in{stands.index((r, cv))}")
    met: list[DataFrame] = []

    def placed() -> DataFrame:
        """Usable rows with the split of each (resample, cv), joined once and written."""
        if not met:
            member = [F.max(F.when((F.col("resample") == r) & (F.col("cv") == cv), F.col("split"))).alias(f"_in{i}") for i, (r, cv) in enumerate(stands)]
            met.append(cut(usable.join(table.groupBy("id").agg(*member), "id"), "placed"))
        return met[0]

    part = lambda r, cv, s: placed().where(in_split(r, cv) == s).select(*usable.columns)
    having = lambda rows, t: rows.withColumn("y", F.col(f"_y{tasks.index(t)}")).where("y is not null")
    measures = _measures(classes)
    for r, cv in folds:
        tried = search.sampled_grid(grid, int(training.get("n_iter", 10)), seed, r) if training["hyperparam_search"] == "random" else grid
        one_fold = spark.range(1).select(F.lit(r).alias("resample"), F.lit(cv).alias("cv_fold"))
        work = search.work_list(one_fold, tried.crossJoin(targets), done).orderBy("model_number", "task").collect()
        if not work:
            continue
        train, val = part(r, cv, "train"), part(r, cv, "val")

        def fit(row, train=train, val=val, r=r, cv=cv) -> None:
            values, began = {n: typed_value(row[n]) for n in names}, time.monotonic()
            judged = make(values).fit(having(train, row.task)).transform(having(val, row.task)).agg(*[m.cast("double").alias(n) for n, m in measures.items()])
            kept = judged.select("*", F.lit(row.task).alias("task"), *[F.lit(row[n]).alias(n) for n in names], F.lit(time.monotonic() - began).alias("seconds"))
            kept.coalesce(1).write.mode("overwrite").parquet(f"{at('log')}/resample={r}/cv_fold={cv}/fit={_fit_key([row.task, *[row[n] for n in names]])}")

        models.at_once(spark, fit, work, parallelism)
    # numbers are those of this call's grid, whatever grid the log was begun with
    log = _log(spark, at("log")).join(grid, names) if names else _log(spark, at("log")).crossJoin(grid)
    best = search.best_configuration(log, training["selection_metric"], training["select_max_value"])
    chosen = {int(r.resample): r for r in best.join(grid, "model_number").collect()}
    external = external_items(spark, told)

    fit_of = lambda r, task: (_fit_key([task, *[chosen[r][n] for n in names]]), f"resample={r}/task={tasks.index(task)}")

    def missing(work) -> bool:
        fit_id, place = fit_of(*work)
        return not there(spark, f"{at('predictions')}/{place}/_SUCCESS") or spark.read.parquet(f"{at('predictions')}/{place}").where((F.col("fit") == fit_id) & F.col("split").isin("train", *external)).select("split").distinct().count() != 1 + len(external)

    def refit(work) -> None:
        (r, task), (fit_id, place), began = work, fit_of(*work), time.monotonic()
        model = make({n: typed_value(chosen[r][n]) for n in names}).fit(having(part(r, "refit", "train"), task))
        if training["save_model"] == "refit":
            model.write().overwrite().save(f"{at('models')}/{place}")
        judge = lambda rows, *more: model.transform(rows.withColumn("y", F.col(f"_y{tasks.index(task)}"))).select("id", *more, "y", "prediction")
        found = judge(placed().withColumn("split", in_split(r, "refit")).where("split is not null"), "split")
        for label, rows_ in external.items():
            found = found.unionByName(judge(rows_, F.lit(label).alias("split")))
        found = found.select(F.lit(task).alias("target"), "*", F.lit(int(chosen[r].model_number)).alias("model_number"), F.lit(fit_id).alias("fit"))
        found.write.mode("overwrite").parquet(f"{at('predictions')}/{place}")  # what stands here is whole, the model before it
        stored = spark.read.parquet(f"{at('predictions')}/{place}").where("y is not null")
        figures = metrics.evaluated(stored, ["split"], measures).select(F.col("split").alias("data_split"), "metric", "value")
        told_key = {"resample_number": r, "target": task, "model_fn_str": name, "model_number": int(chosen[r].model_number)}
        models.run_record(spark, told_key, told, figures, time.monotonic() - began).coalesce(1).write.mode("overwrite").parquet(f"{at('run_log')}/{place}")

    refits = [w for w in ((r, t) for r in sorted(chosen) for t in tasks) if missing(w)]
    if refits:
        placed()
        models.at_once(spark, refit, refits, parallelism)
    predicted = spark.read.parquet(at("predictions"))
    as_log = predicted.select("resample", F.lit("refit").alias("cv_fold"), F.col("split").alias("data_split"), F.col("target").alias("task"), "id", F.col("prediction").alias("pred"))
    ensemble.refit_rows(as_log).drop("resample", "cv_fold", "model_number", "data_split").write.mode("overwrite").parquet(at("averages"))
    valued = metrics.evaluated(predicted.where("y is not null"), ["resample", "target", "split"], measures)
    if training.get("calculate_ensemble_performance"):
        truth = usable.select("id", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"_y{i}").alias("y")) for i, t in enumerate(tasks)])).alias("t")).select("id", "t.*")
        mean = spark.read.parquet(at("averages")).select(F.col("task").alias("target"), "id", F.col("pred").alias("prediction")).join(truth.where("y is not null"), ["target", "id"])
        valued = valued.unionByName(metrics.evaluated(mean, ["target"], measures).select(F.lit(-1).alias("resample"), "target", F.lit("ensemble").alias("split"), "metric", "value"))
    valued.write.mode("overwrite").parquet(at("performance"))
    spark.createDataFrame([(key,)], "key string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/current")
    performance = spark.read.parquet(at("performance"))
    return metrics.summary(performance.withColumnRenamed("split", "dataset"), keys=["target"]).withColumnRenamed("target", "task")


def _fit_key(values: list) -> str:
    return hashlib.md5(json.dumps(values).encode()).hexdigest()


def _log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path).withColumns({"resample": F.col("resample").cast("int"), "cv_fold": F.col("cv_fold").cast("string")})


def built_model(folder: str, resample: int = 0, task: int = 0) -> PipelineModel:
    """The model of the last job under folder for a resample and the task-th target (MOD11)."""
    key = SparkSession.getActiveSession().read.parquet(f"{folder}/current").first().key
    return PipelineModel.load(f"{folder}/models/job={key}/resample={resample}/task={task}")
