"""Operators against plain Python: brute force, identities and independence from partitions."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import ranking, scalar, vectors
from millrace.operators import ensemble, features, metrics, models, profile, rows, search, similarity, splits


def test_running_sum_spreads_a_hot_group(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.8 else f"g{rng.randrange(5)}" if rng.random() < 0.9 else None, i, rng.randrange(5)) for i in range(3000)]
    got = {r.i: r.s for r in ranking.running_sum(spark.createDataFrame(data, "g string, i long, v long").repartition(7), ["g"], ["i"], "v", "s").collect()}
    total = {}
    for g, i, v in data:
        assert got[i] == total.get(g, 0)
        total[g] = total.get(g, 0) + v


def test_row_numbers_do_not_depend_on_partitions(spark):
    ids = spark.range(1000).select(F.col("id"))
    a = splits.random_splits(ids, 2, 0.3, 0.6, 5).collect()
    b = splits.random_splits(ids.orderBy(F.rand(3)).repartition(9), 2, 0.3, 0.6, 5).collect()
    assert sorted(a) == sorted(b) and len(a) == 2 * 900
    for r in (0, 1):
        assert sum(x.split == "test" for x in a if x.resample == r) == 300


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], "id long, g string")
    assert splits.random_splits(none, 2, 0.3).collect() == []
    assert splits.kfold(none, 3).collect() == []
    assert splits.stratified_splits(none, "g", 2, 0.7).collect() == []
    assert profile.histogram(none, {"id": 1}).collect() == []


def greedy_folds(sizes, k):
    load, out = [0] * k, {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = min(range(k), key=lambda i: (load[i], i))
        out[g] = f
        load[f] += n
    return out


@pytest.mark.parametrize("k", [2, 3, 7])
def test_grouped_kfold_is_the_greedy_walk(spark, k):
    rng = random.Random(k)
    sizes = {f"g{i:03d}": rng.choice([1, 1, 1, 2, 2, 3, 5, 40]) for i in range(60)}
    data = [(f"{g}-{j}", g) for g, n in sizes.items() for j in range(n)]
    got = splits.grouped_kfold(spark.createDataFrame(data, "id string, g string"), "g", k).collect()
    want = greedy_folds(sizes, k)
    assert len(got) == len(data) and all(r.fold == want[r.id.split("-")[0]] for r in got)


def test_groups_are_never_divided_and_strata_are_shared(spark):
    data = [(i, f"g{i % 11}", "abc"[i % 7 % 3]) for i in range(300)]
    frame = spark.createDataFrame(data, "id long, g string, s string")
    group = {i: g for i, g, _ in data}
    got = splits.grouped_splits(frame, "g", 3, 0.7, 1).collect()
    for r in range(3):
        sides = {}
        for x in got:
            if x.resample == r:
                sides.setdefault(group[x.id], set()).add(x.split)
        assert all(len(s) == 1 for s in sides.values()) and sum(s == {"test"} for s in sides.values()) == math.ceil(11 * 0.3)
    strat = splits.stratified_splits(frame, "s", 1, 0.7, 1).collect()
    stratum = {i: s for i, _, s in data}
    for s in "abc":
        n = sum(v == s for v in stratum.values())
        assert abs(sum(x.split == "test" for x in strat if stratum[x.id] == s) - 0.3 * n) < 1


def test_nested_tables_agree_and_pass_the_check(spark):
    ids = spark.range(100).select("id")
    whole = splits.nested_kfold(ids, 2, 0.25, 3, 4)
    assert splits.split_faults(whole, 100).collect() == []
    outer = splits.random_splits(ids, 2, 0.25, None, 4)

    def inner(train, resample):
        folds = splits.kfold(train, 3, 10 + resample)
        return folds.withColumn("cv", F.explode(F.array(*[F.lit(i) for i in range(3)]))).select("cv", "id", F.when(F.col("cv") == F.col("fold"), "test").otherwise("train").alias("split"))

    table = splits.nested(outer, inner)
    assert splits.split_faults(table, 100).collect() == []
    assert {(r.cv, r.split) for r in table.select("cv", "split").distinct().collect()} == {("refit", "train"), ("refit", "test")} | {(c, s) for c in "012" for s in ("train", "val", "test")}


def test_stored_splits_are_read_again(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return splits.nested_kfold(spark.range(30).select("id"), 1, 0.2, 2)

    a = splits.stored_splits(spark, f"{tmp_path}/s", make).count()
    assert splits.stored_splits(spark, f"{tmp_path}/s", make).count() == a and len(made) == 1


def tau(pairs):
    c = d = t = u = 0
    for i, (a, b) in enumerate(pairs):
        for x, y in pairs[:i]:
            s = (a - x) * (b - y)
            c, d = c + (s > 0), d + (s < 0)
            t, u = t + (a == x and b != y), u + (a != x and b == y)
    return (c - d) / math.sqrt((c + d + t) * (c + d + u)) if (c + d + t) * (c + d + u) else None


def test_kendall_and_spearman_equal_brute_force(spark):
    rng = random.Random(2)
    data = [(g, float(rng.randrange(m)), float(rng.randrange(m))) for g, m, n in (("a", 8, 90), ("b", 1000, 120), ("c", 1, 5), ("d", 9, 1)) for _ in range(n)]
    frame = spark.createDataFrame(data, "g string, t double, p double")
    got = {r.g: r.kendall for r in metrics.kendall(frame, ["g"], "t", "p").collect()}
    for g in "abcd":
        want = tau([(t, p) for h, t, p in data if h == g])
        assert (got[g] is None) == (want is None) and (want is None or abs(got[g] - want) < 1e-12)
    ranks = {r.g: r.spearman for r in metrics.spearman(frame, ["g"], "t", "p").collect()}
    assert ranks["c"] is None and ranks["d"] is None and -1 <= ranks["a"] <= 1


def test_metrics_never_fail_on_constant_or_single_groups(spark):
    frame = spark.createDataFrame([("one", 1.0, 2.0), ("same", 3.0, 1.0), ("same", 3.0, 2.0)], "g string, t double, p double")
    got = {(r.g, r.metric): r.value for r in metrics.evaluated(frame, ["g"], metrics.regression_metrics(F.col("t"), F.col("p"))).collect()}
    assert got["one", "pearson"] is None and got["same", "pearson"] is None and got["same", "r2"] is None
    assert got["same", "mae"] == 1.5 and got["one", "rmsd"] == 1.0


def test_user_metrics_stand_beside_built_in_ones(spark):
    frame = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 5.0), ("b", 1.0, 1.0)], "g string, t double, p double")
    worst = metrics.user_metric(lambda t, p: np.abs(t - p).max())
    odd = metrics.user_metric(lambda t, p: float("nan"))
    got = {r.g: (r.worst, r.odd) for r in frame.groupBy("g").agg(worst("t", "p").alias("worst"), odd("t", "p").alias("odd")).collect()}
    assert got["a"][0] == 2.0 and got["b"][0] == 0.0 and got["a"][1] is None or np.isnan(got["a"][1])


def test_summary_arithmetic(spark):
    # two resamples: sem = std / sqrt(2), bounds = mean -+ 1.69 sem
    frame = spark.createDataFrame([("test", "rmsd", 1.0), ("test", "rmsd", 2.0), ("test", "mae", 0.5)], "dataset string, metric string, value double")
    got = {r.metric: r for r in metrics.summary(frame).collect()}
    r = got["rmsd"]
    assert math.isclose(r.sem, r.std / math.sqrt(2)) and math.isclose(r.ci95_lower, r.mean - 1.69 * r.sem) and math.isclose(r.ci95_upper, r.mean + 1.69 * r.sem)
    assert got["mae"].std is None and got["mae"].ci95_lower is None


def plain_stop(losses, limit, patience, threshold):
    cur, prev, step = 0, math.inf, min(patience, limit)
    while True:
        cur += step
        if cur > len(losses):
            return None
        best = min(losses[:cur])
        at = losses.index(best) + 1
        if cur == limit:
            return limit
        if prev - best <= threshold:
            return at
        prev = best
        step = max(1, min(at + patience - cur, limit - cur))


def test_early_stop_equals_a_plain_loop(spark):
    rng = random.Random(3)
    runs = {i: [round(5 / (1 + j * rng.random()) + rng.random(), 3) for j in range(rng.randrange(1, 40))] for i in range(80)}
    frame = spark.createDataFrame([(i, j + 1, x) for i, xs in runs.items() for j, x in enumerate(xs)], "run long, epoch int, loss double")
    for limit, patience, threshold in ((30, 3, 0.1), (10, 4, 0.0), (5, 10, 1.0)):
        got = {r.run: r.stop_epoch for r in search.stopping_epoch(frame, limit, patience, threshold).collect()}
        assert got == {i: plain_stop(xs[:limit], limit, patience, threshold) for i, xs in runs.items()}


def test_profiles_add_up_and_do_not_depend_on_partitions(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    whole = profile.histogram(events, {"value": "0.1"})
    halves = profile.merge(profile.histogram(events.where("event_id % 3 = 0"), {"value": "0.1"}), profile.histogram(events.where("event_id % 3 != 0").repartition(5), {"value": "0.1"}))
    assert sorted(whole.collect()) == sorted(halves.select(*whole.columns).collect())
    assert whole.agg(F.sum("n")).first()[0] == events.where("value is not null").count()


def test_profile_by_flag_shares_a_range_and_keeps_empty_flags(spark):
    frame = spark.createDataFrame([(-2.5, "ab"), (0.3, "a"), (float("nan"), "a"), (None, "b"), (3.9, "b")], "v double, s string")
    flags = profile.pattern_flags("s", [("a", "a"), ("b", "b"), ("z", "z")])
    got = {(r.flag, r.bin_idx): r.n for r in profile.gap_filled(profile.histogram_by_flag(frame, {"v": 1}, flags), ["a", "b", "z"]).collect()}
    assert got == {(f, b): n for f, bins in (("a", {-3: 1, 0: 1}), ("b", {-3: 1, 3: 1}), ("z", {})) for b in range(-3, 4) for n in [bins.get(b, 0)]}
    with pytest.raises(ValueError, match="no such"):
        profile.histogram(frame, {"missing": 1})
    patterns = spark.createDataFrame([("a", "a"), ("both", "ab")], "flag string, pattern string")
    assert profile.matching_patterns(frame.withColumn("id", F.monotonically_increasing_id()), "s", patterns, "id").count() == 4


def test_scalars(spark):
    frame = spark.createDataFrame([(-2.5, 2, "12"), (2.5, 7, "x"), (None, None, None)], "v double, k int, s string")
    got = frame.select(scalar.round_half_up(F.col("v"), 0).alias("u"), scalar.round_half_even(F.col("v"), 0).alias("e"), scalar.class_label(F.col("k")).alias("c"), scalar.number_column(F.col("s")).alias("n")).collect()
    assert [tuple(r) for r in got] == [(-2.0, -2.0, "High", 12.0), (3.0, 2.0, "7", None), (None, None, None, None)]
    assert [scalar.decimals(w) for w in ("0.1", 5, "0.25", "10")] == [1, 0, 2, 0]
    assert [scalar.typed_value(x) for x in ("3", "3.5", "-1e3", "true", "None", "__import__('os')")] == [3, 3.5, -1000.0, True, None, "__import__('os')"]
    with pytest.raises(Exception, match="unknown level"):
        frame.select(scalar.one_of_k(F.col("s"), ["12"])).collect()
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = v.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.continuous_tanimoto(F.col("a"), F.col("b")).alias("t")).collect()
    assert math.isclose(got[0].c, 1 / math.sqrt(2)) and got[0].t == 0.5 and got[1].c is None


def test_rows(spark):
    frame = spark.createDataFrame([(1, "a,b"), (2, ""), (3, None)], "id long, s string")
    split = rows.variants_of(lambda x: x.split(",") if x else [])
    out = rows.expanded(frame.select(rows.item_id(F.col("id")).alias("id"), split("s").alias("v")), F.col("v")).collect()
    assert [(r.id, r.variant) for r in out] == [("a-i1.s0", "a"), ("a-i1.s1", "b")]
    assert rows.without_variants(frame.withColumn("v", split("s")), F.col("v")).count() == 2
    checked = rows.cascade(frame, [("D1", F.col("s").isNull()), ("X", F.col("id") > 1)])
    assert [(r.warning, r["pass"]) for r in checked.orderBy("id").collect()] == [(None, True), ("X", False), ("D1:X", False)]
    assert rows.cascade(frame, [("X", F.col("id") > 1)], drop=True).count() == 1
    with pytest.raises(ValueError, match="repeat"):
        rows.assert_unique(frame.union(frame), "id")
    size = rows.in_batches(frame, lambda f: f.assign(n=f["s"].str.len().fillna(-1).astype("int64"))[["id", "n"]], "id long, n long", 1)
    assert {r.id: r.n for r in size.collect()} == {1: 3, 2: 0, 3: -1}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    both = rows.features_joined(frame, frame.union(frame).select("id", F.lit(1).alias("f")), "id")
    assert both.count() == 3
    assert rows.renamed_ids(frame, spark.createDataFrame([(1, 10)], "id long, new_id long")).collect()[0].id == 10


def test_grid_numbers_in_order_and_sampling_is_seeded(spark):
    got = search.grid(spark, {"b": [1, 2], "a": ["x", "y", "z"], "_order": ["a", "b"]}).orderBy("model_number").collect()
    assert [(r.a, r.b) for r in got] == [(a, b) for a in "xyz" for b in ("1", "2")]
    frame = spark.range(20).withColumnRenamed("id", "model_number")
    one, two, other = (sorted(r[0] for r in search.sampled_grid(frame, 5, 1, s).collect()) for s in (0, 0, 1))
    assert one == two != other and len(one) == 5


def test_selectors_fit_on_train_and_save(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [(float(a), float(2 * a + 0.001 * b), float(b), 7.0, None if i % 9 == 0 else 1.0) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    frame = spark.createDataFrame(data, "a double, b double, c double, k double, nul double")
    columns = ["a", "b", "c", "k", "nul"]
    constant = features.ConstantFilter(inputCols=columns).fit(frame)
    assert constant.getOrDefault(constant.removed) == ["k"] and constant.n_removed == 1
    model = features.CorrelationFilter(inputCols=columns, cutoff=0.9).fit(constant.transform(frame))
    assert model.getOrDefault(model.removed) == ["b"] and model.transform(frame).columns == ["a", "c", "k", "nul"]
    model.write().save(f"{tmp_path}/m")
    assert features.SelectorModel.load(f"{tmp_path}/m").n_removed == 1
    assert features.prune_correlated([("a", "b", 0.95), ("b", "c", 0.97), ("a", "c", None)], ["a", "b", "c"]) == ["c", "b"][::-1]
    moments = features.moments(frame, ["a", "k"])
    back = features.scaled(frame, moments).agg(F.avg("a"), F.stddev_pop("a"), F.max("k")).first()
    assert abs(back[0]) < 1e-9 and math.isclose(back[1], 1) and back[2] == 0


def test_graph_tables(spark):
    nodes = spark.createDataFrame([(1, 0, "C"), (1, 1, "N"), (1, 2, "?"), (2, 0, "C")], "graph_id long, node_id long, atom string")
    table = features.node_table(nodes, {"atom": ["C", "N", "other"]}, unknown=("atom",))
    assert {(r.graph_id, r.node_id): r.feats for r in table.collect()}[1, 2] == [0.0, 0.0, 1.0]
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "graph_id long, src long, dst long")
    near = {(r.graph_id, r.node): r.neighbours for r in features.adjacency(edges, nodes).collect()}
    assert near == {(1, 0): [1], (1, 1): [0], (1, 2): [], (2, 0): []}
    master, links = features.master_nodes(table)
    assert {r.graph_id: r.feats for r in master.collect()}[1] == [1 / 3, 1 / 3, 1 / 3] and links.count() == 4


def test_linear_models_equal_closed_forms(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) * [1, 2, 3, 4]
    y = x @ [1.0, -2.0, 0.5, 0.0] + 3 + 0.1 * rng.normal(size=300)
    names = list("abcd")
    frame = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], ", ".join(f"{n} double" for n in [*names, "y"]))
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 5 * np.eye(4), xc.T @ yc)
    assert np.allclose(models.ridge(frame, names, "y", 5.0).coefficients.toArray(), want, atol=1e-6)
    full, intercept = models.pls(frame, names, "y", components=4)
    plain = np.linalg.lstsq(np.column_stack([np.ones(300), x]), y, rcond=None)[0]
    assert np.allclose([intercept, *full.values()], plain, atol=1e-6)
    assert len(features.correlations(frame, names).collect()) == 6


def test_forest_elimination_keeps_what_matters(spark):
    rng = np.random.default_rng(3)
    data = [(float(a), float(b), float(c), float(3 * b + 0.01 * a), int(i % 3)) for i, (a, b, c) in enumerate(rng.normal(size=(150, 3)))]
    frame = spark.createDataFrame(data, "a double, b double, c double, y double, fold int")
    assert models.eliminate(frame, ["a", "b", "c"], "y", 1, trees=5) == ["b"]
    assert "b" in models.eliminate_cv(frame, ["a", "b", "c"], "y", "fold", trees=3)


def test_kernel_models_learn(spark):
    rng = np.random.default_rng(4)
    data = [(float(a), float(b), float(np.sin(2 * a) + b), float(a * a + b * b < 1)) for a, b in rng.uniform(-1.5, 1.5, (500, 2))]
    z = models.fourier_features(spark.createDataFrame(data, "a double, b double, y double, c double"), ["a", "b"], 80, 1.0).cache()
    w, bias = models.svr(z, "y", c=100.0, rounds=60, epsilon=0.05, rate=2.0)
    got = np.array([(r.y, np.dot(r.z, w) + bias) for r in z.select("y", "z").collect()])
    assert np.mean((got[:, 0] - got[:, 1]) ** 2) < 0.3 * got[:, 0].var()
    from pyspark.ml.functions import array_to_vector

    model = models.svc(z, "c", c=1000.0)
    right = model.transform(z.withColumn("_z", array_to_vector("z"))).agg(F.avg((F.col("c") == F.col("prediction")).cast("double"))).first()[0]
    assert right > 0.85


def test_search_scores_saves_and_reports(spark, tmp_path):
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame([(i, float(a), float(2 * a + 0.1 * b)) for i, (a, b) in enumerate(rng.normal(size=(90, 2)))], "id long, a double, y double")
    nested = splits.nested_kfold(frame.select("id"), 1, 0.2, 2).where("resample = 0")
    best, model, log = models.search(frame, nested, lambda o: models.pipeline(["a"], "ridge", **o), [{"regParam": 100.0}, {"regParam": 0.0}])
    assert best == {"regParam": 0.0} and len(log) == 4
    scored = models.scored(frame, {"m1": model, "m2": model}, ["id", "y"])
    assert scored.columns == ["id", "y", "m1", "m2"] and scored.where("m1 != m2").count() == 0
    models.save_model(model, f"{tmp_path}/model", {"notes": "x"})
    again, info = models.load_model(spark, f"{tmp_path}/model")
    assert info == {"notes": "x"} and again.transform(frame).count() == 90
    timed = models.batch_scored(frame, {"twice": lambda s: s * 2}, "a", timed=True)
    assert timed.where("twice != a * 2").count() == 0 and "twice_time" in timed.columns
    values = spark.createDataFrame([("test", "rmsd", 1.5)], "data_split string, metric string, value double")
    record = models.run_record(spark, {"resample": 0}, {"a": 1}, values, 2.0).first()
    assert record.metrics == {"test rmsd": 1.5} and record.resample == 0


def test_similarity_equals_brute_force(spark):
    rng = random.Random(6)
    items = {i: sorted({rng.randrange(30) for _ in range(rng.randrange(8))}) for i in range(60)}
    frame = spark.createDataFrame(list(items.items()), "id long, bits array<int>")
    queries = frame.where("id % 10 = 0")
    want = {}
    for q in range(0, 60, 10):
        s = sorted((len(set(items[q]) & set(v)) / len(set(items[q]) | set(v)) if set(items[q]) | set(v) else 0 for v in items.values()), reverse=True)
        want[q] = sum(s[:3]) / 3
    got = {r.query_id: r.applicability for r in similarity.applicability(queries, similarity.tanimoto_hits(queries, frame), 60).collect()}
    assert all(abs(got[q] - want[q]) < 1e-12 for q in want)
    same = frame.where("id = 0 or id = 100").unionByName(spark.createDataFrame([(100, items[0] or [1])], "id long, bits array<int>"))
    assert similarity.minhash_candidates(same.where(F.size("bits") > 0)).count() <= 1
    pair = spark.createDataFrame([([1, 2], [2, 3]), ([], [])], "a array<int>, b array<int>").select(similarity.tanimoto(F.col("a"), F.col("b")).alias("t")).collect()
    assert pair[0].t == 1 / 3 and pair[1].t is None


def test_dense_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 5))
    x[3] = x[7]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = similarity.dense_nearest(frame, frame, 4, "euclidean", block=7).collect()
    for q in range(80):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = sorted((round(float(v), 7), i) for i, v in enumerate(d))[:4]
        mine = sorted((round(-r.similarity, 7), r.id) for r in got if r.query_id == q)
        assert [a for a, _ in mine] == pytest.approx([a for a, _ in want], abs=1e-6)


def test_refit_rows_need_every_task(spark):
    log = spark.createDataFrame([(0, "refit", "test", t, i, float(i)) for i, tasks in ((1, "ab"), (2, "a")) for t in tasks], "resample int, cv_fold string, data_split string, task string, id long, pred double")
    assert {(r.id, r.task, r.cv_fold, r.resample) for r in ensemble.refit_rows(log).collect()} == {(1, "a", "av_over_refits", -1), (1, "b", "av_over_refits", -1)}
    check = models.check_data(log.withColumn("public", F.lit(True)), F.col("public"))
    assert check.count() == 3


def test_long_ranges_are_dealt_and_stray_values_refused(spark, monkeypatch):
    from millrace.functions import ranking

    monkeypatch.setattr(ranking, "RANGE_BLOCK", 10)
    got = ranking.exploded_range(spark.createDataFrame([("a", -5, 37), ("b", 3, 3)], "k string, x long, y long"), F.col("x"), F.col("y"), "i").select("k", "i").collect()
    assert sorted(map(tuple, got)) == [("a", i) for i in range(-5, 38)] + [("b", 3)]
    far = spark.createDataFrame([("v", 0, 1), ("v", 10**16, 1)], "value_name string, bin_idx long, n long")
    with pytest.raises(Exception, match="bins: v"):
        profile.gap_filled(far).collect()


def test_sets(spark):
    a, b = (spark.createDataFrame(x, "id long, v string") for x in ([(1, "a"), (2, "b"), (2, "b")], [(2, "c"), (3, "d")]))
    assert [r.id for r in rows.common_ids(a, b).collect()] == [2]
    assert sorted((r.id, r.a_v, r.b_v) for r in rows.side_by_side({"a": a.distinct(), "b": b}).collect()) == [(1, "a", None), (2, "b", "c"), (3, None, "d")]


@pytest.mark.parametrize("method", ["random", "k-fold", "stratified"])
def test_inner_splits_of_all_resamples_at_once(spark, method):
    ids = spark.range(50).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("stratum"))
    outer = splits.cut(splits.random_splits(ids, 3, 0.2, None, 1), "outer")
    found = splits.nested_drawn(outer, method, 4, 0.25, 1, ids)
    assert splits.split_faults(found, 50).count() == 0
    counts = {(r.resample, r.cv, r.split): r["count"] for r in found.groupBy("resample", "cv", "split").count().collect()}
    assert {k[1] for k in counts} == {"refit", "0", "1", "2", "3"}
    assert all(n == {"test": 10, "val": 10, "train": 40 if cv == "refit" else 30}[s] for (_, cv, s), n in counts.items())
    if method == "stratified":
        for r in found.where("split = 'val'").join(ids, "id").groupBy("resample", "cv", "stratum").count().collect():
            size = outer.where(f"split = 'train' and resample = {r.resample}").join(ids.where(F.col("stratum").eqNullSafe(F.lit(r.stratum))), "id").count() if r.cv == "0" else None
            assert size is None or abs(r["count"] - size / 4) < 1
    again = splits.nested_drawn(outer.repartition(3), method, 4, 0.25, 1, ids)
    assert again.exceptAll(found).count() == 0


def test_empty_training_rows_are_one_defined_error(spark):
    rows = spark.createDataFrame([], "a double, y double, z array<double>")
    for fit in (lambda: models.ridge(rows, ["a"], "y", 1.0), lambda: models.svr(rows, "y")):
        with pytest.raises(ValueError, match="no rows to learn from"):
            fit()


def test_hashed_runs_are_those_of_the_texts(spark):
    rows = spark.createDataFrame([("a b a b c",), ("a",), ("",), ("x x x x",)], "t string")
    tokens = F.split("t", " ")
    for n in (1, 2, 3):
        for r in rows.select(F.size(similarity.ngrams(tokens, n)).alias("texts"), F.size(similarity.ngram_hashes(tokens, n)).alias("hashes")).collect():
            assert r.texts == r.hashes
    sets = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 3, 4]), (3, []), (4, None), (None, [1])], "id long, bits array<int>")
    by_text = sets.withColumn("bits", F.transform("bits", lambda x: x.cast("string")))
    for block in (1, 100):
        want = {(1, 1, 1.0), (1, 2, 0.5), (2, 1, 0.5), (2, 2, 1.0)}
        assert {tuple(r) for r in similarity.tanimoto_hits(sets, sets, block=block).collect()} == want == {tuple(r) for r in similarity.tanimoto_hits(by_text, by_text, block=block).collect()}
    assert {(r.query_id, r.id) for r in similarity.tanimoto_hits(sets, sets, k=1).collect()} == {(1, 1), (2, 2)}


def test_shares_of_millions_of_rows_are_those_of_sql(spark):
    cases = [(9_000_000, 1 - 0.7), (90_000_000, 0.3), (60_000_000, 0.7), (150_000, 1 - 0.7), (11, 0.3), (0, 0.2)]
    sql = [duckdb.sql(f"SELECT round({n}::BIGINT * {f!r}::DOUBLE, 9)").fetchall()[0][0] for n, f in cases]
    assert [splits.share(n, f) for n, f in cases] == sql
    assert math.ceil(splits.share(*cases[0])) == 2_700_001
    frame = spark.createDataFrame([(n,) for n, _ in cases], "n long")
    for (n, f), expected in zip(cases, sql, strict=True):
        assert frame.where(F.col("n") == n).select(splits.share_of(F.col("n"), f)).first()[0] == expected


def test_a_row_with_a_weight_is_as_many_rows_to_kernel_models(spark):
    rng = np.random.default_rng(11)
    data = [([float(a), float(b)], float(a - b > 0), float(a - b), int(k)) for (a, b), k in zip(rng.normal(size=(60, 2)), rng.integers(1, 9, 60), strict=True)]
    alike = spark.createDataFrame(data, "z array<double>, c double, y double, times long").coalesce(1).cache()
    single = alike.withColumn("one", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "one").cache()
    a, b = models.svr(alike, "y", rounds=3, weight="times"), models.svr(single, "y", rounds=3)
    assert np.allclose(a[0], b[0]) and np.isclose(a[1], b[1])
    a, b = models.svc(alike, "c", weight="times"), models.svc(single, "c")
    z, label, times = np.array([d[0] for d in data]), np.array([2 * d[1] - 1 for d in data]), np.array([d[3] for d in data])
    sd = np.repeat(z, times, 0).std(0, ddof=1)

    def loss(m):
        w = m.coefficients.toArray()
        return np.average(np.maximum(0, 1 - label * (z @ w + m.intercept)), weights=times) + ((w * sd) ** 2).sum() / 2

    assert abs(loss(a) - loss(b)) < 1e-3  # the hinge has a kink, at which Spark's search stops early


def test_kernel_regression_writes_targets_and_no_features(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(12)
    data = [(float(a), float(b), float(a - b + e)) for a, b, e in zip(rng.integers(0, 4, 3000), rng.integers(0, 3, 3000), rng.normal(size=3000), strict=True)]
    rows = spark.createDataFrame([*data, (1.0, 1.0, None)], "a double, b double, y double").repartition(3).cache()
    monkeypatch.setattr(models, "TARGETS", 100)
    want = models.svr(models.fourier_features(rows, ["a", "b"], 64, 0.3), "y", rounds=5)
    written = []
    monkeypatch.setattr(models, "cut", lambda df, tag: written.append(df.cache()) or written[-1])
    missing = spark.createDataFrame([(None, 1.0, 2.0), (float("nan"), 1.0, 2.0)], rows.schema)
    got = models.kernel_svr(rows.unionByName(missing), ["a", "b"], "y", 64, 0.3, rounds=5)
    assert np.allclose(got[0], want[0], atol=1e-12) and np.isclose(got[1], want[1], atol=1e-12)
    [groups] = [df.collect() for df in written]  # 66 numbers a row before
    assert sum(len(r.ys) for r in groups) == 3001 and max(len(r.ys) for r in groups) <= 100 and all(len(r.x) == 2 for r in groups)
    assert sorted((*r.x, v) for r in groups for v in r.ys if v == v) == sorted(data) and len(groups) < 3 * (3000 // 100 + 13)
    z = models.fourier_features(rows, ["a", "b"], 64, 0.3).select("a", "b", "z").distinct().collect()
    plain = {(r.a, r.b): np.dot(r.z, got[0]) + got[1] for r in z}
    told = models.kernel_predicted(rows.unionByName(missing), ["a", "b"], *got, 0.3).collect()
    assert len(told) == 3003 and sum(r.pred is None for r in told) == 2
    assert all(abs(r.pred - plain[r.a, r.b]) < 1e-12 for r in told if (r.a, r.b) in plain)
    with pytest.raises(ValueError, match="no rows to learn from"):
        models.kernel_svr(missing, ["a", "b"], "y")


def test_a_task_holds_k_scores_a_query_from_its_first_rows_on():
    rng = np.random.default_rng(3)
    asked = {"vec": rng.normal(size=(40, 8))}
    batch = pa.RecordBatch.from_pydict({"id": list(range(500)), "vec": rng.normal(size=(500, 8)).tolist()})
    [(query, place, score)] = similarity._dense_scores("euclidean")(asked, batch, np.full(40, -np.inf), 5)
    assert len(query) == 40 * 5
    far = np.linalg.norm(asked["vec"][:, None] - np.array(batch["vec"].to_pylist())[None], axis=2)
    assert all(set(place[query == q]) == set(np.argsort(far[q])[:5]) for q in range(40))


def test_pairs_of_all_similarities_are_written_nowhere(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(similarity, "shared_folder", lambda _: str(tmp_path))
    sets = spark.createDataFrame([(i, [i % 3, 5 + i % 2]) for i in range(30)], "id long, bits array<int>")
    got = {(r.query_id, r.id) for r in similarity.tanimoto_hits(sets.where("id < 10"), sets, block=3).collect()}
    assert got == {(a, b) for a in range(10) for b in range(30) if a % 3 == b % 3 or a % 2 == b % 2}
    assert not list(tmp_path.glob("nearest-*"))


def test_sets_meet_thousands_of_queries_in_one_pass(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(similarity, "shared_folder", lambda _: str(tmp_path))
    rng = random.Random(6)
    data = [(i, rng.sample(range(-20, 60), rng.randrange(1, 4))) for i in range(3000)]
    sets = spark.createDataFrame(data, "id long, bits array<long>").repartition(3)
    got = {(r.query_id, r.id): r.similarity for r in similarity.tanimoto_hits(sets, sets.where("id < 40"), digits=6).collect()}
    assert [p.name for p in tmp_path.glob("queries-*/_block=*")] == ["_block=0"]  # three before, so all rows were read three times
    common = {(q, i): len(set(x) & set(y)) for q, x in data for i, y in data[:40]}
    want = {(q, i): (n, len(data[q][1]) + len(data[i][1]) - n) for (q, i), n in common.items() if n}
    sql = dict(duckdb.sql("SELECT (c, u), round(c / u, 6) FROM range(1, 4) a(c), range(1, 7) b(u)").fetchall())
    assert got == {k: sql[v] for k, v in want.items()}


def test_elements_are_found_wherever_they_stand_in_the_table():
    rng = np.random.default_rng(2)
    inverse = np.uint64(pow(int(similarity.SPREAD), -1, 2**64))
    near = (np.arange(50, dtype=np.uint64) * inverse).view(np.int64)  # keys 0 to 49: all have the same first bits
    known = np.concatenate([near, rng.integers(-(2**62), 2**62, 500), [-1, 0, 1]])
    asked = similarity._bits_of(pa.table({"id": np.arange(3), "bits": [known[:300].tolist(), known[300:].tolist(), known[::7].tolist()]}))
    bits = np.concatenate([rng.permutation(known), rng.integers(-(2**62), 2**62, 500), (np.arange(40, 90, dtype=np.uint64) * inverse).view(np.int64)])
    place, at = similarity._looked_up(asked, bits)
    assert place.tolist() == np.flatnonzero(np.isin(bits, known)).tolist() and (asked["keys"][at] == similarity._keys(bits[place])).all()
    assert len(similarity._looked_up(asked, bits[:0])[0]) == 0


def test_trees_learn_from_sums_of_their_bootstraps(spark, monkeypatch):
    rng = random.Random(8)
    data = [(float(a), float(b), 3.0 * a + rng.random()) for a, b in ((rng.randrange(6), rng.randrange(4)) for _ in range(3000))]
    frame = spark.createDataFrame([*data, (None, 1.0, 5.0)], "a double, b double, y double").repartition(3)
    want = models.forest(trees=6, seed=2).fit(models.assembled(frame, ["a", "b"])).featureImportances.toArray()

    def refused(**_):
        raise AssertionError("a forest over all rows")

    monkeypatch.setattr(models, "forest", refused)
    got = models.importances(frame, ["a", "b"], "y", 6, 2)
    assert abs(got - want).max() < 0.01 and models.eliminate(frame, ["a", "b"], "y", 1, 6) == ["a"]
    sums = models.bootstrapped(frame, ["a", "b"], "y", 6, 2).toPandas()
    assert len(sums) == 6 * 24 and abs(sums["w"].sum() / 18000 - 1) < 0.03
    assert abs(sum(sums["w"] * sums["m"]) / sums["w"].sum() - sum(r[2] for r in data) / 3000) < 0.2
    with pytest.raises(ValueError, match="no rows"):
        models.importances(frame.limit(0), ["a", "b"], "y", 6, 2)
    monkeypatch.setattr(models, "CELLS", 3)
    with pytest.raises(AssertionError, match="over all rows"):
        models.eliminate(frame, ["a", "b"], "y", 1, 6)
