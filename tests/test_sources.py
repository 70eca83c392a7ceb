"""Readers, writers, stores, settings and streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import profile
from millrace.plans import spec
from millrace.sources import readers, stores, writers
from millrace.streaming import profiles


def test_readers_by_ending(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;structure;x\n1;CCO;2\n2;;3\n")
    with gzip.open(tmp_path / "b.inchi.gz", "wt") as f:
        f.write("InChI=1 x y\nInChI=2\n")
    assert [tuple(r) for r in readers.read_items(spark, f"{tmp_path}/a.csv", keep=("id",)).collect()] == [("1", "CCO"), ("2", None)]
    tokens = readers.read_items(spark, f"{tmp_path}/b.inchi.gz", spread=2)
    assert sorted(r[0] for r in tokens.collect()) == ["InChI=1", "InChI=2"] and tokens.rdd.getNumPartitions() == 2
    with pytest.raises(ValueError, match="unknown kind"):
        readers.read_items(spark, "x.xlsx")
    lines = readers.numbered(readers.read_tokens(spark, f"{tmp_path}/b.inchi.gz"), start=5)
    assert {r.structure: r.line_no for r in readers.row_range(lines, 6).collect()} == {"InChI=2": 6}
    assert readers.row_range(lines, 0, 6).count() == 1
    assert readers.asserted(tokens, "structure like 'InChI%'", "bad").count() == 2
    with pytest.raises(Exception, match="bad"):
        readers.asserted(tokens, "structure like 'X%'", "bad").collect()


def test_training_and_external_sets(spark, tmp_path):
    (tmp_path / "t.csv").write_text("ID,S,y1,x1\na,CC,1.5,7\nb,CO,,8\n")
    got = readers.training_set(spark, f"{tmp_path}/t.csv", "ID", "S", ["y1"], ["x1", "x1"]).orderBy("id").collect()
    assert [(r.id, r.structure, r.y.y1, r.x.x1, r.w) for r in got] == [("a", "CC", 1.5, 7.0, 1.0), ("b", "CO", None, 8.0, 1.0)]
    bare = readers.training_set(spark, f"{tmp_path}/t.csv", "ID", "S", []).first()
    assert bare.y is None and bare.w is None
    main = {"dataset_file": f"{tmp_path}/t.csv", "id_field": "ID", "feature_field": "S", "tasks": ["y1"]}
    assert {r.dataset for r in readers.external_sets(spark, main, {"e1": {}, "e2": {}, "_order": ["e1", "e2"]}).collect()} == {"e1", "e2"}


def test_two_header_rows(spark, tmp_path):
    (tmp_path / "s.csv").write_text("resample;0;;1\ncv;0;refit;0\nm1;train;test;val\nm2;test;train;\n")
    got = sorted((r.id, r.first, r.second, r.value) for r in readers.two_header_table(spark, f"{tmp_path}/s.csv").collect())
    assert got == [("m1", "0", "0", "train"), ("m1", "0", "refit", "test"), ("m1", "1", "0", "val"), ("m2", "0", "0", "test"), ("m2", "0", "refit", "train")]


def test_two_header_rows_stand_in_the_first_of_several_files(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "part-0.csv").write_text("x;0\nid;a\n")
    (folder / "part-1.csv").write_text("".join(f"m{i};v{i}\n" for i in range(500)))
    got = sorted(map(tuple, readers.two_header_table(spark, str(folder)).collect()))
    assert got == sorted((f"m{i}", "0", "a", f"v{i}") for i in range(500))


def test_writers(spark, tmp_path):
    frame = spark.createDataFrame([("a", "CC", 1.0)], "id string, structure string, score double")
    writers.write_scored(frame, f"{tmp_path}/{writers.ranged_name('out', 0, -1)}", "csv")
    assert readers.read_column(spark, f"{tmp_path}/out_0_end", "structure").first()[0] == "CC"
    with pytest.raises(Exception, match="exist"):
        writers.write_scored(frame, f"{tmp_path}/out_0_end", "csv")
    writers.write_rejects(frame, f"{tmp_path}/rejects")
    assert spark.read.text(f"{tmp_path}/rejects").first()[0] == "a;CC"
    found = profile.histogram(frame, {"score": 1})
    writers.export_profile(profile.with_edges(found, {"score": 1}), f"{tmp_path}/hist")
    assert spark.read.option("header", True).csv(f"{tmp_path}/hist").first().n == "1"
    log = spark.createDataFrame([(0, "d", "test", "a", 1.0), (1, "d", "test", "a", 2.0)], "resample int, dataset string, data_split string, id string, pred double")
    writers.append_predictions(log, f"{tmp_path}/log")
    writers.append_predictions(log, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    wide = writers.wide_predictions(log, [0, 1]).first()
    assert (wide["0"], wide["1"]) == (1.0, 2.0)
    epochs = spark.createDataFrame([("r", 0, "train", "loss", 3.0), ("r", 1, "train", "loss", 2.0)], "run string, epoch int, split string, metric string, value double")
    assert [(r.Epoch, r["train loss"]) for r in writers.epoch_table(epochs, ["train loss"]).collect()] == [(1, 3.0), (2, 2.0)]
    writers.package_training_data(spark.createDataFrame([("a", bytearray(b"\x01\x02"))], "id string, fp binary"), f"{tmp_path}/p", {"id": "ID", "fp": "FP"}, "fp")
    assert readers.packaged_training_data(spark, f"{tmp_path}/p", "FP").first().FP == bytearray(b"\x01\x02")


def test_store_counts_a_run_once(spark, tmp_path):
    one = spark.createDataFrame([("v", 1, 2), ("v", 3, 1)], "value_name string, bin_idx long, n long")
    for run in ("a", "b", "a"):
        stores.append_run(one, f"{tmp_path}/s", run)
    assert sorted(map(tuple, stores.merged(spark, f"{tmp_path}/s", ["value_name", "bin_idx"]).collect())) == [("v", 1, 4), ("v", 3, 2)]


def test_manifest_finds_changes(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a").write_text("x")
    (tmp_path / "f/b").write_text("y")
    recorded = stores.cut(stores.manifest(spark, f"{tmp_path}/f"), "manifest")
    assert stores.changed_files(stores.manifest(spark, f"{tmp_path}/f"), recorded).collect() == []
    (tmp_path / "f/b").write_text("z")
    (tmp_path / "f/c").write_text("new")
    assert {r.path[-1] for r in stores.changed_files(stores.manifest(spark, f"{tmp_path}/f"), recorded).collect()} == {"b", "c"}


def test_settings(spark, tmp_path):
    settings = {"dataset": {"dataset_file": "x", "tasks": ["y"]}, "training": {"hyperparam_search_iterations": 5, "hyperparam_search": "random"}, "hyperparams": {"a": [1], "_order": ["a"]}}
    (tmp_path / "run.json").write_text(json.dumps(settings, indent=1))
    got = spec.load_settings(spark, f"{tmp_path}/run.json")
    assert got["training"]["n_iter"] == 5 and got["training"]["save_model"] == "refit"
    for bad in ({"datset": {}}, {"training": {"epoch": 1}}, {"training": {"hyperparam_search": "x"}}):
        with pytest.raises(ValueError):
            spec.checked_settings(bad)
    assert spec.name_value_pairs(["a", "0.5", "b", "3"]) == {"a": 0.5, "b": 3}
    with pytest.raises(ValueError, match="alternate"):
        spec.name_value_pairs(["a"])
    assert spec.closure(["mpo"], {"mpo": ["pfi"], "pfi": ["rings", "logp"]}) == ["rings", "logp", "pfi", "mpo"]
    with pytest.raises(ValueError, match="needs itself"):
        spec.closure(["a"], {"a": ["b"], "b": ["a"]})
    registry = {"a": F.lit(1), "b": F.lit(2)}
    assert spec.chosen_outputs(None, registry) == [] and spec.chosen_outputs([], registry) == ["a", "b"] and spec.chosen_outputs(["b", "q"], registry) == ["b"]


def test_stream_equals_batch_and_restarts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    (source := tmp_path / "in").mkdir()
    events.repartition(4).write.mode("append").parquet(str(source))
    run = lambda: profiles.profile_stream(profiles.arriving(spark, str(source), events.schema, 1), {"value": 5}, f"{tmp_path}/store", f"{tmp_path}/cp", "q").awaitTermination()
    run()
    run()
    events.where("event_id % 2 = 0").write.mode("append").parquet(str(source))
    run()
    want = profile.histogram(events.unionByName(events.where("event_id % 2 = 0")), {"value": 5})
    got = profiles.stored_profile(spark, f"{tmp_path}/store")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    score = lambda rows: rows.select("event_id", (F.col("value") * 2).alias("score"))
    profiles.score_stream(profiles.arriving(spark, str(source), events.schema), score, f"{tmp_path}/scored", f"{tmp_path}/cp2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/scored").count() == events.count() + events.where("event_id % 2 = 0").count()


def test_reference_histogram_arithmetic(spark):
    # the printed form: edges without gaps, integer widths without decimals, totals kept
    frame = spark.createDataFrame([(float(x),) for x in (240.2, 244.9, 251, 430)], "molwt double")
    got = profile.with_edges(profile.gap_filled(profile.histogram(frame, {"molwt": 5})), {"molwt": 5}).orderBy("bin_idx").collect()
    assert got[0].edge == 240 and got[-1].edge == 430 and sum(r.n for r in got) == 4
    assert all(b.edge - a.edge == 5 for a, b in zip(got, got[1:]))
