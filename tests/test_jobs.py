import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import models, rows, similarity
from millrace.plans import jobs
from millrace.plans.spec import ScoreSpec


def _job(**more):
    spec = ScoreSpec({"double": F.col("size") * 2, "more": F.col("double") + 1}, {"more": ["double"]}, {"more": 1})
    return jobs.ScoringJob(spec, ["more"], F.col("size") > 0, [("D1", F.col("size") > 8), ("X1", F.col("size") == 5)], **more)


def _items(spark, sizes):
    return spark.createDataFrame([(str(i), s) for i, s in enumerate(sizes)], "id string, size int")


def test_counts_rejects_and_restart(spark, tmp_path):
    items = _items(spark, [1, 2, 5, 9, 0, None])
    for run_id in ("a", "b", "a"):
        jobs.run_scoring(items, _job(tolerated="D"), str(tmp_path), run_id)
    profiled, counted = jobs.totals(spark, str(tmp_path))
    assert dict(map(tuple, counted.collect())) == {"items": 12, "valid": 8, "invalid": 4, "passed": 6}
    assert {(r.bin_idx, r.n) for r in profiled.collect()} == {(3, 2), (5, 2), (19, 2)}
    rejects = spark.read.parquet(f"{tmp_path}/rejects").where("run_id = 'a'")
    assert {(r.id, r.reason) for r in rejects.collect()} == {("2", "X1"), ("4", "invalid"), ("5", "invalid")}
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    assert [r.run_id for r in rows.unfinished(work, jobs.finished_runs(spark, str(tmp_path)), ["run_id"]).collect()] == ["c"]


def test_variants_and_no_tolerance(spark, tmp_path):
    job = _job(variants=F.expr("sequence(1, size)"))
    jobs.run_scoring(_items(spark, [1, 2, 9]), job, str(tmp_path), "a")
    scored = spark.read.parquet(f"{tmp_path}/scored")
    assert {r.id for r in scored.collect()} == {"0.s0", "1.s0", "1.s1"}


def test_no_items_warns_and_goes_on(spark, tmp_path):
    with pytest.warns(UserWarning, match="no items"):
        jobs.run_scoring(_items(spark, []), _job(), str(tmp_path), "a")
    profiled, counted = jobs.totals(spark, str(tmp_path))
    assert profiled.count() == 0 and {r.n for r in counted.collect()} == {0}


def test_pipeline_stages_leave_least_squares_alone(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(3, [1, 50], (80, 2))
    y = x @ [2.0, -0.5] + rng.normal(0, 1, 80)
    frame = spark.createDataFrame([(float(a), float(b), 7.0, float(t)) for (a, b), t in zip(x, y)], "a double, b double, c double, y double")
    plain = np.linalg.lstsq(np.column_stack([x, np.ones(80)]), y, rcond=None)[0]
    for constants, scaled in ((False, False), (False, True)):
        model = models.pipeline(["a", "b", "c"], "ridge", constants=constants, scaled=scaled, regParam=0.0).fit(frame)
        got = np.array([r.prediction for r in model.transform(frame).select("prediction").collect()])
        assert np.allclose(got, np.column_stack([x, np.ones(80)]) @ plain)


def test_one_rule_that_is_not_tolerated_rejects(spark, tmp_path):
    job = _job(tolerated="D")
    job.rules.append(("X2", F.col("size") == 10))
    jobs.run_scoring(_items(spark, [9, 10]), job, str(tmp_path), "a")
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/scored").collect()] == ["0"]
    assert [r.reason for r in spark.read.parquet(f"{tmp_path}/rejects").collect()] == ["D1:X2"]


def _modelled(spark, n=120, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 2))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 5 + rng.normal(0, 0.1, n)
    return spark.createDataFrame(pd.DataFrame({"item": np.arange(n), "a": x[:, 0], "b": x[:, 1], "flat": 1.0, "target": y, "kind": (y > 5).astype(float)}))


def _settings(model="ridge", space=None, **training):
    return {
        "dataset": {"tasks": ["target"], "descriptors": ["a", "b", "flat"], "id_field": "item"},
        "train_test_split": {"split_method": "random", "n_splits": 2, "frac_test": 0.25},
        "train_val_split": {"split_method": "k-fold", "n_splits": 2},
        "training": {"model_fn_str": model, **training},
        "hyperparams": {"regParam": [0.0, 100.0]} if space is None else space,
    }


def test_model_job_against_least_squares_and_restart(spark, tmp_path, monkeypatch):
    items, folder = _modelled(spark), str(tmp_path / "job")
    found = {(r.dataset, r.metric): r for r in jobs.run_models(items, _settings(), folder, seed=4).collect()}
    log = spark.read.parquet(f"{folder}/log").toPandas()
    assert len(log) == 2 * 2 * 2
    split = spark.read.parquet(f"{folder}/splits").where("cv = 'refit'").toPandas()
    frame, rmsd = items.toPandas(), []
    for r in (0, 1):
        own = split[split["resample"] == r].merge(frame, left_on="id", right_on="item")
        train, test = own[own.split == "train"], own[own.split == "test"]
        assert len(test) == 30 and len(train) == 90
        x = lambda f: np.column_stack([f.a, f.b, np.ones(len(f))])
        w = np.linalg.lstsq(x(train), train.target, rcond=None)[0]
        rmsd.append(np.sqrt(np.mean((x(test) @ w - test.target) ** 2)))
    assert np.isclose(found["test", "rmsd"]["mean"], np.mean(rmsd))
    assert set(spark.read.parquet(f"{folder}/predictions").select("model_number").distinct().toPandas().model_number) == {0}
    kept = jobs.built_model(folder, 1).transform(items.withColumn("y", F.lit(0.0)))
    assert kept.where("prediction is null").count() == 0

    fits = []
    make = models.pipeline
    monkeypatch.setattr(models, "pipeline", lambda *a, **k: fits.append(k) or make(*a, **k))
    again = jobs.run_models(items, _settings(), folder, seed=4)  # nothing is drawn or fitted again
    assert not fits and {(r.dataset, r.metric): r for r in again.collect()} == found
    jobs.run_models(items, _settings(space={"regParam": [0.0, 100.0, 3.0]}), folder, seed=4)
    assert len(fits) == 4 and all(k["regParam"] == 3.0 for k in fits)


@pytest.mark.parametrize(("model", "space", "least"), [("neighbours", {"k": [1, 3]}, 0.8), ("pls", {"components": [1, 2]}, 0.99), ("svr", {"gamma": [0.05], "c": [100.0], "rounds": [30]}, 0.5)])
def test_model_job_by_name(spark, tmp_path, model, space, least):
    told = _settings(model, space, selection_metric="r2", select_max_value=True)
    told |= {"train_test_split": {"n_splits": 1}, "train_val_split": {"split_method": "random", "n_splits": 1, "frac_test": 0.3}}
    found = jobs.run_models(_modelled(spark), told, str(tmp_path / "job"))
    assert found.where("dataset = 'test' and metric = 'r2'").first()["mean"] > least


def test_classification_job_drops_items_without_target_or_descriptor(spark, tmp_path):
    items = _modelled(spark).withColumn("kind", F.when(F.col("item") != 7, F.col("kind"))).withColumn("a", F.when(F.col("item") != 8, F.col("a")))
    told = _settings("svc", {"gamma": [0.2], "rounds": [15]})
    told["dataset"] |= {"tasks": ["kind"], "mode": "classification"}
    told |= {"train_test_split": {"n_splits": 1}, "train_val_split": {"split_method": "random", "n_splits": 1, "frac_test": 0.3}}
    found = {(r.dataset, r.metric): r["mean"] for r in jobs.run_models(items, told, str(tmp_path / "job")).collect()}
    assert found["test", "accuracy"] > 0.7
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/job/splits").select("id").distinct().collect()} == set(range(120)) - {7, 8}


def test_settings_that_a_job_refuses(spark, tmp_path):
    for change in ({"training": {"model_fn_str": "other"}}, {"train_test_split": {"split_method": "other"}}, {"dataset": {"tasks": ["a", "a"], "descriptors": []}}, {"training": {"model_fn_str": "ridge", "epochs": 5}}, {"preprocessing": {"ph": 7}}):
        with pytest.raises(ValueError):
            jobs.run_models(_modelled(spark), _settings() | change, str(tmp_path / "job"))


def test_nearest_of_blocks_against_plain(spark):
    rng = np.random.default_rng(0)
    x, q = rng.integers(0, 4, (60, 3)).astype(float), rng.integers(0, 4, (9, 3)).astype(float)
    make = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    got = similarity.dense_nearest(make(q), make(x), 4, "euclidean", block=2)
    for i, v in enumerate(q):
        d = np.sqrt(((x - v) ** 2).sum(1))
        want = sorted(range(60), key=lambda j: (round(d[j], 9), j))[:4]
        assert [r.id for r in got.where(f"query_id = {i}").orderBy("rank").collect()] == want
    assert similarity.dense_nearest(make(q), make(x[:2]), 4).groupBy("query_id").count().where("count = 2").count() == 9


def test_rows_meet_the_splits_once(spark, tmp_path, monkeypatch):
    make, plans = models.pipeline, []

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def fit(self, rows):
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
            return self.inner.fit(rows)

    monkeypatch.setattr(models, "pipeline", lambda *a, **k: Watched(make(*a, **k)))
    jobs.run_models(_modelled(spark), _settings(), str(tmp_path / "job"), seed=4)
    data = _modelled(spark).selectExpr("item AS id", "a", "target AS y")
    given = data.selectExpr("id", "explode(array('0', '1')) AS cv").selectExpr("cv", "id", "if(cv = id % 2, 'val', 'train') AS split")
    models.search(data, given, lambda o: models.pipeline(["a"], "ridge", **o), [{"regParam": 0.0}])
    assert len(plans) == 2 * 2 * 2 + 2 + 2 + 1 and not [p for p in plans if "Join" in p or "Exchange" in p]


def test_another_model_data_or_seed_takes_nothing_of_the_last_job(spark, tmp_path):
    items, folder = _modelled(spark), str(tmp_path / "job")
    r2 = lambda found: found.where("dataset = 'test' and metric = 'r2'").first()["mean"]
    ridge = r2(jobs.run_models(items, _settings(space={"alpha": [1.0]}), folder))
    forest = r2(jobs.run_models(items, _settings("forest", {"trees": [5]}), folder))
    alone = r2(jobs.run_models(items, _settings("forest", {"trees": [5]}), str(tmp_path / "alone")))
    assert forest == alone != ridge
    changed = items.withColumn("target", F.col("target") * F.when(F.col("item") < 60, 1).otherwise(-1))
    assert r2(jobs.run_models(changed, _settings(space={"alpha": [1.0]}), folder)) < 0.9 < ridge
    assert r2(jobs.run_models(items, _settings(space={"alpha": [1.0]}), folder)) == ridge
    assert r2(jobs.run_models(items, _settings(space={"alpha": [1.0]}), folder, seed=5)) != ridge


def test_targets_that_some_items_lack_external_sets_and_averages(spark, tmp_path):
    items = _modelled(spark).withColumn("other", F.when(F.col("item") % 4 > 0, F.col("b") * 2 - F.col("a")))
    items.where("item < 30").select(F.col("item").alias("code"), "a", "b", "flat", "target").withColumn("other", F.lit(None).cast("double")).write.parquet(f"{tmp_path}/ext")
    told = _settings(space={"alpha": [0.001]}, calculate_ensemble_performance=True, n_cpus=3)
    told["dataset"] |= {"tasks": ["target", "other"]}
    told |= {"ext_datasets": {"far": {"dataset_file": f"{tmp_path}/ext", "id_field": "code"}}, "train_val_split": {"split_method": "stratified", "strat_field": "kind", "n_splits": 1, "frac_train": 0.7}}
    found = {(r.task, r.dataset, r.metric): r["mean"] for r in jobs.run_models(items, told, f"{tmp_path}/job").collect()}
    assert {k[:2] for k in found} == {("target", d) for d in ("train", "test", "far", "ensemble")} | {("other", d) for d in ("train", "test", "ensemble")}
    assert found["other", "test", "r2"] > 0.999 and found["target", "far", "r2"] > 0.99
    predicted = spark.read.parquet(f"{tmp_path}/job/predictions").toPandas()
    log = spark.read.parquet(f"{tmp_path}/job/log").toPandas()
    assert len(log) == 2 * 2 and set(log.task) == {"target", "other"} and (log.seconds > 0).all()
    tests = predicted[predicted.split == "test"]
    mean = tests.groupby(["target", "id"]).prediction.mean()
    kept = spark.read.parquet(f"{tmp_path}/job/averages").toPandas().set_index(["task", "id"]).pred
    assert set(kept.index) == set(mean.index) and all(abs(kept[k] - mean[k]) < 1e-9 for k in kept.index)
    truth = items.toPandas().set_index("item").target
    errors = [kept["target", i] - truth[i] for i in kept["target"].index]
    assert np.isclose(found["target", "ensemble", "rmsd"], np.sqrt(np.mean(np.square(errors))))
    runs = spark.read.parquet(f"{tmp_path}/job/run_log").collect()
    assert len(runs) == 4 and all(r.metrics["test r2"] > 0.9 and '"alpha"' in r.settings for r in runs)


def test_ridge_by_name_has_the_penalty_of_ridge(spark):
    rows = _modelled(spark).withColumn("y", F.col("target"))
    named = models.pipeline(["a", "b"], "ridge", alpha=7.0).fit(rows).stages[-1]
    plain = models.ridge(rows, ["a", "b"], "y", 7.0)
    assert np.allclose(named.coefficients.toArray(), plain.coefficients.toArray()) and np.isclose(named.intercept, plain.intercept)


def test_predefined_inner_split(spark, tmp_path):
    spark.createDataFrame([(i, r, "val" if i % 3 == r else "train") for i in range(120) for r in (0, 1)], "id long, resample int, split string").write.parquet(f"{tmp_path}/lists")
    told = _settings() | {"train_val_split": {"split_method": "predefined", "from_file": f"{tmp_path}/lists"}}
    jobs.run_models(_modelled(spark), told, f"{tmp_path}/job")
    split = spark.read.parquet(f"{tmp_path}/job/splits").toPandas()
    inner = split[(split.cv == "0") & (split.split != "test")]
    assert all((r.split == "val") == (r.id % 3 == r.resample) for r in inner.itertuples()) and len(inner) == 2 * 90


def test_runs_keep_their_names_and_empty_ones_replace(spark, tmp_path):
    from millrace.sources.stores import append_run, merged

    store = f"{tmp_path}/store"
    rows_ = spark.createDataFrame([("a", 5)], "k string, n long")
    append_run(rows_, store, "r1")
    append_run(rows_, store, "002")
    append_run(rows_.limit(0), store, "r1")
    assert [tuple(r) for r in merged(spark, store, ["k"]).collect()] == [("a", 5)]
    assert merged(spark, f"{tmp_path}/none", ["k"], schema="k string, n long").collect() == []


def test_groups_with_a_null_key_keep_their_rank_metrics(spark):
    from millrace.operators import metrics

    pairs = spark.createDataFrame([(g, float(i), float(i * i % 7)) for g in ("a", None) for i in range(9)], "g string, t double, p double")
    for found in (metrics.spearman(pairs, ["g"], "t", "p"), metrics.kendall(pairs, ["g"], "t", "p")):
        by = {r[0]: r[1] for r in found.collect()}
        assert by.keys() == {"a", None} and by["a"] == by[None]


def test_a_package_is_whole_or_refused(spark, tmp_path):
    from millrace.plans import packaging

    items = _modelled(spark).withColumn("other", F.col("a") - F.col("b"))
    told = _settings(space={"alpha": [0.1]})
    told["dataset"]["tasks"] = ["target", "other"]
    jobs.run_models(items, told, f"{tmp_path}/job")
    rename = {"item": "code", "target": "value"}
    packaging.package(items, f"{tmp_path}/job", f"{tmp_path}/pack", rename, public=F.col("item") < 60, info={"by": "test"})
    info = packaging.checked_package(spark, f"{tmp_path}/pack")
    assert info["info"] == {"by": "test"} and info["settings"]["training"]["model_fn_str"] == "ridge"
    again = packaging.reproduced(spark, f"{tmp_path}/pack", items).collect()
    tests = spark.read.parquet(f"{tmp_path}/job/predictions").where("split = 'test' and id < 60").groupBy("resample", "target").count()
    assert {(r.resample, r.task): r.n for r in again} == {(r.resample, r.target): r["count"] for r in tests.collect()} and max(r.largest_diff for r in again) < 1e-9
    assert spark.read.parquet(f"{tmp_path}/pack/training").columns == ["code", "value"] and spark.read.parquet(f"{tmp_path}/pack/training").count() == 60
    with pytest.raises(ValueError, match="exists"):
        packaging.package(items, f"{tmp_path}/job", f"{tmp_path}/pack", rename)

    part = next((tmp_path / "pack" / "check").glob("part-*"))
    whole = part.read_bytes()
    part.write_bytes(whole[:-5] + bytes([whole[-5] ^ 1]) + whole[-4:])
    part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="missing or changed"):
        packaging.checked_package(spark, f"{tmp_path}/pack")
    part.write_bytes(whole)
    packaging.checked_package(spark, f"{tmp_path}/pack")
    (tmp_path / "pack" / "more.txt").write_text("x")
    with pytest.raises(ValueError, match="not recorded"):
        packaging.checked_package(spark, f"{tmp_path}/pack")
    (tmp_path / "half").mkdir()
    with pytest.raises(ValueError, match="no whole package"):
        packaging.checked_package(spark, f"{tmp_path}/half")


def _stage_rows(spark, n=150):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (n, 3))
    frame = pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "twin": x[:, 0] * 2 + 1e-3 * x[:, 2], "flat": 1.0, "noise": x[:, 2]})
    return spark.createDataFrame(frame.assign(y=5 * x[:, 0] + 2 * x[:, 1], kind=(x[:, 0] > 0.3).astype(float)))


def test_selection_stages_against_plain_loops(spark, tmp_path):
    from millrace.operators import selection

    rows_ = _stage_rows(spark)
    columns = ["flat", "a", "b", "twin", "noise"]
    model = selection.staged_pipeline(columns, "forest_uncorrelated", trees=3).fit(rows_)
    kept = [m.getOrDefault("indices") for m in model.stages if isinstance(m, selection.KeptFeatures)]
    assert kept == [[1, 2, 3, 4], [0, 1, 3]]
    fitted = selection.staged_pipeline(["a", "b", "noise"], "ridge_eliminate", eliminate__keep=2, eliminate__trees=8, alpha=0.0).fit(rows_)
    want = models.eliminate(rows_, ["a", "b", "noise"], "y", 2, trees=8)
    assert [["a", "b", "noise"][i] for i in fitted.stages[2].getOrDefault("indices")] == want == ["a", "b"]
    fitted.write().save(f"{tmp_path}/model")
    stored = type(fitted).load(f"{tmp_path}/model").transform(rows_)
    assert stored.where("abs(prediction - y) > 1e-6").count() == 0
    scaled = selection.PopulationScaler(source="features", made="z").fit(models.assembled(rows_, ["a", "b"])).transform(models.assembled(rows_, ["a", "b"])).toPandas()
    z = np.stack([v.toArray() for v in scaled.z])
    assert np.allclose(z.mean(0), 0) and np.allclose(z.std(0), 1)
    with pytest.raises(ValueError, match="no stage"):
        selection.staged_pipeline(columns, "ridge_eliminate", scale__x=1)


@pytest.mark.parametrize("stratified", [False, True])
def test_elimination_over_folds_against_a_plain_loop(spark, stratified):
    from millrace.operators import selection

    rows_, columns = models.assembled(_stage_rows(spark).withColumn("y", F.col("kind")), ["a", "b", "noise"]), ["a", "b", "noise"]
    stage = selection.CrossValidatedElimination(folds=3, trees=5, stratified=stratified, regression=not stratified)
    dealt = stage.with_folds(rows_)
    sizes = dealt.groupBy("_fold", *(["y"] if stratified else [])).count().toPandas()
    for _, part in sizes.groupby("y") if stratified else [(0, sizes)]:
        assert len(part) == 3 and part["count"].max() - part["count"].min() <= 1
    kept = [columns[i] for i in stage.fit(rows_).getOrDefault("indices")]
    if not stratified:
        from pyspark.ml.functions import vector_to_array

        plain = dealt.select("y", "_fold", *[vector_to_array("features")[i].alias(c) for i, c in enumerate(columns)])
        assert kept == models.eliminate_cv(plain, columns, "y", "_fold", trees=5)
    assert "a" in kept
