"""Models in a scoring job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators.scoring import BatchModel, with_embedding, with_models
from millrace.plans import jobs
from millrace.plans.spec import ScoreSpec


def test_two_outputs_and_a_failing_row(spark):
    def _two(w, a, b):  # local, so that workers don't look for this module
        if np.isnan(a).any():
            raise ValueError("no number")
        return a * w, a + b

    rows = spark.createDataFrame([(i, float(i) if i != 7 else None, i % 3, "x") for i in range(40)], "id int, a double, b int, twice string").repartition(3)
    models = {"m": BatchModel(["a", "b"], ["twice", "total"], _two, 2.0), "n": BatchModel(["twice"], ["length"], lambda _, s: [len(x) for x in s])}
    got = with_models(rows, models, timed=True)
    assert got.columns == ["id", "a", "b", "twice", "total", "twice_time", "length", "length_time"]
    for r in got.collect():
        want = (None, None) if r.id == 7 else (2.0 * r.id, r.id + r.id % 3)
        assert (r.twice, r.total, r.length) == (*want, 1.0) and r.twice_time >= 0
    assert with_models(rows.limit(0), models).collect() == [] and with_models(rows, {}) is rows


def test_a_model_of_the_wrong_kind_gives_nulls_or_is_refused(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,)], "a double")
    assert [r.x for r in with_models(rows, {"m": BatchModel(["a"], ["x", "y"], lambda _, a: a)}).collect()] == [None, None]
    for models in ({"m": BatchModel(["a"], ["x"], None), "n": BatchModel(["a"], ["x"], None)}, {"m": BatchModel([], ["x"], None)}):
        with pytest.raises(ValueError):
            with_models(rows, models)


def test_job_scores_variants_with_models_and_profiles_them(spark, tmp_path):
    items = spark.createDataFrame([(str(i), i) for i in (1, 2, 3)], "id string, size int")
    spec = ScoreSpec({"more": F.col("half") + 1}, {}, {"half": 1})
    job = jobs.ScoringJob(spec, ["more"], variants=F.expr("sequence(1, size)"), models={"m": BatchModel(["size"], ["half"], lambda w, s: s * w, 0.5)}, timed=True)
    jobs.run_scoring(items, job, str(tmp_path), "001")
    scored = spark.read.parquet(f"{tmp_path}/scored").collect()
    assert sorted((r.id, r.half, r.more) for r in scored) == sorted((f"{i}.s{v}", i / 2, i / 2 + 1) for i in (1, 2, 3) for v in range(i))
    profiled, _ = jobs.totals(spark, str(tmp_path))
    assert {(r.bin_idx, r.n) for r in profiled.collect()} == {(0, 1), (1, 5)}
    assert [r.run_id for r in jobs.finished_runs(spark, str(tmp_path)).collect()] == ["001"]


def test_embeddings_are_cut_to_the_items_and_a_failing_one_is_null(spark):
    def layer(w, a, b):
        assert len(a) == 8  # always a whole batch
        if (a == 5).any():
            raise ValueError("five")
        return np.stack([a, b], 1) @ w

    rows = spark.createDataFrame([(i, float(i), i * 2, "x") for i in range(21)], "id int, a double, b int, z string").repartition(2)
    model = BatchModel(["a", "b"], ["z"], layer, np.array([[1.0, 0, 2], [0, 1, 1]]))
    got = {r.id: r.z for r in with_embedding(rows, model, 8).collect()}
    assert got == {i: None if i == 5 else [i, 2.0 * i, 4.0 * i] for i in range(21)}
    assert with_embedding(rows.limit(0), model, 8).collect() == []
    assert with_embedding(rows, BatchModel(["a"], ["z"], lambda _, a: a), 8).where("z is not null").count() == 0
