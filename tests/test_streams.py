"""Streams that stop and go on."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace.operators import search
from millrace.plans import jobs
from millrace.plans.spec import ScoreSpec
from millrace.sources.readers import numbered, read_tokens, row_range
from millrace.streaming import profiles
from millrace.streaming.epochs import EarlyStop, Fold, stopping_stream, write_stops


def test_a_killed_scoring_stream_gives_the_batch_jobs_totals(spark, tmp_path, monkeypatch):
    items = spark.createDataFrame([(str(i), i % 9 - 1) for i in range(60)], "id string, size int")
    for i in range(3):
        items.where(F.col("id").cast("int") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    job = jobs.ScoringJob(ScoreSpec({"double": F.col("size") * 2}, {}, {"double": 1}), ["double"], F.col("size") > 0, [("X1", F.col("size") == 5)])
    counters, calls = jobs.profile.counters, []

    def failing(*a):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed between the tables of a batch")
        return counters(*a)

    monkeypatch.setattr(jobs.profile, "counters", failing)
    stream = lambda: profiles.scoring_stream(profiles.arriving(spark, f"{tmp_path}/in", items.schema, 1), job, f"{tmp_path}/job", f"{tmp_path}/check", "s")
    with pytest.raises(Exception, match="killed"):
        stream().awaitTermination()
    half = {r.counter: r.n for r in jobs.totals(spark, f"{tmp_path}/job")[1].collect()}
    assert half["items"] == 20 == sum(r.n for r in jobs.totals(spark, f"{tmp_path}/job")[0].collect()) + 20 - half["passed"]
    stream().awaitTermination()
    jobs.run_scoring(items, job, f"{tmp_path}/batch", "all")
    for got, want in zip(jobs.totals(spark, f"{tmp_path}/job"), jobs.totals(spark, f"{tmp_path}/batch"), strict=True):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(f"{tmp_path}/job/scored").count() == spark.read.parquet(f"{tmp_path}/batch/scored").count()


def _runs(n, rng):
    return [(run, e, rng.choice([None, rng.random(), 1 / e])) for run in range(n) for e in range(1, rng.randrange(2, 40))]


def test_early_stops_of_a_stream_are_those_of_the_batch_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    rows = _runs(25, rng)
    rng.shuffle(rows)
    schema = "run long, epoch int, loss double"
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    want = {r.run: r.stop_epoch for r in search.stopping_epoch(spark.createDataFrame(rows, schema), 20, 3, 0.05).where("stop_epoch is not null").collect()}
    arriving = lambda: stopping_stream(profiles.arriving(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1), 20, 3, 0.05)
    write_stops(arriving(), f"{tmp_path}/stops", f"{tmp_path}/check").awaitTermination()
    assert want and {r.run: r.stop_epoch for r in spark.read.parquet(f"{tmp_path}/stops").collect()} == want
    # more of a decided run and a new run, after a restart
    more = [(99, e, 1.0) for e in range(1, 8)] + [(min(want), 39, 0.0)]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    write_stops(arriving(), f"{tmp_path}/stops", f"{tmp_path}/check").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/stops").collect()
    assert {r.run: r.stop_epoch for r in rows} == want | {99: 1} and len(rows) == len(want) + 1


class _Store:
    """A handle and its only state, which counts how often it is used."""

    def __init__(self):
        self.value, self.used = None, 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.used += 1
        return self.value

    def update(self, value):
        self.used += 1
        self.value = value


def test_a_run_uses_its_state_twice_a_batch_whatever_its_epochs():
    store, stop = _Store(), EarlyStop(30, 3, 0.5)
    stop.init(store)
    rows = [Row(epoch=e, loss=100.0 - e) for e in range(1, 31)]
    assert list(stop.handleInputRows((7,), iter(rows[15:]), None)) == [] and store.used == 2
    assert list(stop.handleInputRows((7,), iter(rows[:15]), None)) == [Row(run=7, stop_epoch=30)] and store.used == 4
    assert list(stop.handleInputRows((7,), iter(rows), None)) == [] and store.used == 5


def test_fold_against_a_plain_loop():
    rng = random.Random(5)
    for _ in range(300):
        losses, limit, patience, threshold = [rng.random() for _ in range(rng.randrange(1, 15))], rng.randrange(1, 12), rng.randrange(1, 5), rng.choice([0, 0.1, 0.4])
        fold, got = Fold(min(patience, limit)), None
        for e, x in enumerate(losses[:limit], 1):
            got = got if got is not None else fold.add(e, x, limit, patience, threshold)
        due, before, want = min(patience, limit), float("inf"), None
        while want is None and due <= min(len(losses), limit):
            best = min(losses[:due])
            at = losses.index(best) + 1
            want = limit if due == limit else at if before - best <= threshold else None
            due, before = max(min(at + patience, limit), due + 1), best
        assert got == want


def test_line_numbers_follow_the_files_whatever_their_size(spark, tmp_path):
    sizes = {"a.txt": 30, "b.txt": 4000, "c.txt": 1, "d.txt": 900}
    lines = []
    for name, n in sizes.items():
        mine = [f"{name}-{i} rest" for i in range(n)]
        (tmp_path / name).write_text("\n".join(mine) + "\n")
        lines += [x.split(" ")[0] for x in mine]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            got = {r.line_no: r.structure for r in row_range(numbered(read_tokens(spark, str(tmp_path))), 5, 4500).collect()}
            assert got == dict(enumerate(lines[5:4500], 5))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    made = numbered(spark.range(50).repartition(3).select("id"), start=7)
    assert sorted(r.line_no for r in made.collect()) == list(range(7, 57))
