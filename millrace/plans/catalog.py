"""The registered queries of the library's own operators and their SQL, each over whole tables.

Truth and prediction pairs come from lineitem: t is the extended price, p is 2000 times the
quantity, the model is the return flag and the task the line status. Members of an ensemble scale
the quantity differently.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import scalar
from millrace.functions.vectors import share_of_group
from millrace.operators import ensemble, features, metrics, models, profile, rows, search, similarity, splits
from millrace.operators.scoring import BatchModel, with_embedding
from millrace.plans import jobs, packaging
from millrace.plans.spec import ScoreSpec
from millrace.sources.readers import numbered, packaged_training_data, read_column, read_tokens, row_range
from millrace.sources.stores import append_run, cut, merged, shared_folder
from millrace.sources.writers import append_predictions, write_scored
from millrace.streaming import profiles as streams
from millrace.streaming.epochs import stopping_stream, write_stops

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(c):
    return F.round(c, 6)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("task"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("id"),
        F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 2000.0).alias("p"), F.col("l_quantity").alias("q"),
    )


PAIRS = "pairs AS (SELECT l_returnflag AS model, l_linestatus AS task, l_orderkey * 8 + l_linenumber AS id, l_extendedprice AS t, l_quantity * 2000.0::DOUBLE AS p, l_quantity AS q FROM lineitem)"


def _members(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("member", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("pred", F.col("q") * (1900.0 + 50.0 * F.col("member")))


MEMBERS = PAIRS + ", members AS (SELECT *, q * (1900.0::DOUBLE + 50.0::DOUBLE * member) AS pred FROM pairs, (SELECT unnest(range(1, 6)) AS member))"


# ---- scoring and profiles


def _spec() -> ScoreSpec:
    return ScoreSpec(
        {"pfi": scalar.additive_score(F.col("p_size").cast("double"), F.col("log_price")), "log_price": F.log("p_retailprice"), "mpo": scalar.desirability(F.col("log_price"), F.col("pfi") / 5.0)},
        {"mpo": ["pfi", "log_price"], "pfi": ["log_price"]},
        {"mpo": "0.1", "p_size": 1},
    )


@query("""
WITH s AS (SELECT p_size, ln(p_retailprice) AS lp FROM part WHERE p_size IS NOT NULL AND p_retailprice > 0),
m AS (SELECT p_size, -lp * (1.0::DOUBLE / (1.0::DOUBLE + exp((p_size + lp) / 5.0::DOUBLE - 8.0::DOUBLE))) AS mpo FROM s),
h AS (SELECT 'mpo' AS value_name, CAST(floor(mpo / 0.1::DOUBLE) AS BIGINT) AS bin_idx FROM m UNION ALL SELECT 'p_size', CAST(floor(p_size / 1.0::DOUBLE) AS BIGINT) FROM m),
c AS (SELECT value_name, bin_idx, count(*) AS n FROM h GROUP BY ALL),
b AS (SELECT value_name, unnest(range(min(bin_idx), max(bin_idx) + 1)) AS bin_idx FROM c GROUP BY value_name)
SELECT value_name, bin_idx, coalesce(n, 0) AS n, CASE value_name WHEN 'mpo' THEN round(bin_idx * 0.1::DOUBLE, 1) ELSE round(bin_idx * 1.0::DOUBLE, 0) END AS edge
FROM b LEFT JOIN c USING (value_name, bin_idx)
""")
def screening_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum slice: valid parts, a derived score, gap-filled profiles (FIL1, FIL8, FN3, FN4, FN7, AGG1, AGG2, AGG4)."""
    spec = _spec()
    valid, _ = rows.valid_and_rejects(table(spark, sf_dir, "part"), F.col("p_size").isNotNull() & (F.col("p_retailprice") > 0))
    return profile.with_edges(profile.gap_filled(profile.histogram(spec.score(valid, ["mpo"]), spec.profiles)), spec.profiles)


SCORING_JOB = """
WITH j AS (SELECT p_size, p_retailprice, coalesce(p_retailprice > 910, false) AS valid, coalesce(p_size > 40, false) AS d1, coalesce(p_type LIKE '%PROMO%', false) AS x1 FROM part),
s AS (SELECT p_size, ln(p_retailprice) AS lp FROM j WHERE valid AND NOT x1),
m AS (SELECT p_size, -lp * (1.0::DOUBLE / (1.0::DOUBLE + exp((p_size + lp) / 5.0::DOUBLE - 8.0::DOUBLE))) AS mpo FROM s),
h AS (SELECT 'mpo' AS value, CAST(floor(mpo / 0.1::DOUBLE) AS BIGINT) AS bin_idx FROM m UNION ALL SELECT 'p_size', CAST(floor(p_size / 1.0::DOUBLE) AS BIGINT) FROM m)
SELECT value, bin_idx, count(*) AS n FROM h WHERE bin_idx IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'items', NULL, count(*) FROM j
UNION ALL SELECT 'valid', NULL, count(*) FILTER (valid) FROM j
UNION ALL SELECT 'invalid', NULL, count(*) FILTER (NOT valid) FROM j
UNION ALL SELECT 'passed', NULL, count(*) FILTER (valid AND NOT x1) FROM j
"""


def _scoring_job() -> jobs.ScoringJob:
    return jobs.ScoringJob(_spec(), ["mpo"], F.col("p_retailprice") > 910, [("D1", F.col("p_size") > 40), ("X1", F.col("p_type").contains("PROMO"))], "D")


def _job_totals(spark: SparkSession, folder: str) -> DataFrame:
    profiled, counted = jobs.totals(spark, folder)
    return profiled.select(F.col("value_name").alias("value"), "bin_idx", "n").unionByName(counted.select(F.col("counter").alias("value"), F.lit(None).cast("long").alias("bin_idx"), "n"))


@query(SCORING_JOB)
def scoring_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles and counters of a whole scoring job in two runs, the first of them done again."""
    part = table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey").cast("string"))
    small = F.coalesce(F.col("p_size") <= 25, F.lit(True))
    folder = _scratch(spark, "job")
    for run_id, which in (("small", small), ("large", ~small), ("small", small)):
        jobs.run_scoring(part.where(which), _scoring_job(), folder, run_id)
    return _job_totals(spark, folder)


def _price_model(weights, size, price):
    """A made-up model with two outputs."""
    return weights[0] * price + weights[1] * size, abs(weights[1]) * size / price


def _fragile(_, size):
    """A model that raises on a batch with a large part in it."""
    if (size > 45).any():
        raise ValueError("too large")
    return 2 * size


@query("""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_size AS s, p_retailprice AS r FROM part WHERE p_retailprice > 910)
SELECT id, round(0.5::DOUBLE * r - 3.0::DOUBLE * s, 6) AS worth, round(3.0::DOUBLE * s / r, 6) AS doubt, CASE WHEN s <= 45 THEN 2.0::DOUBLE * s END AS twice, round(0.5::DOUBLE * r - 3.0::DOUBLE * s + coalesce(CASE WHEN s <= 45 THEN 2.0::DOUBLE * s END, 0), 6) AS total, true AS timed FROM p""")
def scoring_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scoring job with two models, one of two outputs and one that fails on some rows, and a score from both (MOD12, UDF1, FN2)."""
    made = {"price": BatchModel(["p_size", "p_retailprice"], ["worth", "doubt"], _price_model, [0.5, -3.0]), "fragile": BatchModel(["p_size"], ["twice"], _fragile)}
    spec = ScoreSpec({"total": F.col("worth") + F.coalesce("twice", F.lit(0.0))}, {}, {"worth": 10, "total": 10})
    folder = _scratch(spark, "models")
    parts = table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey").cast("string"))
    jobs.run_scoring(parts, jobs.ScoringJob(spec, ["total"], F.col("p_retailprice") > 910, models=made, timed=True), folder, "all")
    found = spark.read.parquet(f"{folder}/scored")
    return found.select("id", *[six(F.col(c)).alias(c) for c in ("worth", "doubt", "twice", "total")], ((F.col("worth_time") >= 0) & (F.col("twice_time") >= 0)).alias("timed"))


def _layer(weights, size, price):
    """A made-up hidden layer of three units."""
    return np.maximum(np.stack([size, price], 1) @ np.array(weights), 0.0)


@query("""SELECT p_partkey, round(greatest(2.0::DOUBLE * p_size - 0.01::DOUBLE * p_retailprice, 0), 6) AS a, round(greatest(p_size + 0.5::DOUBLE * p_retailprice, 0), 6) AS b, round(greatest(30.0::DOUBLE * p_size - p_retailprice, 0), 6) AS c
FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL""")
def item_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of a model's hidden layer for each part, batches filled up and cut again (SIM5)."""
    parts = table(spark, sf_dir, "part").where("p_size is not null and p_retailprice is not null").select("p_partkey", "p_size", "p_retailprice")
    found = with_embedding(parts, BatchModel(["p_size", "p_retailprice"], ["layer"], _layer, [[2.0, 1.0, 30.0], [-0.01, 0.5, -1.0]]))
    return found.select("p_partkey", *[six(F.col("layer")[i]).alias(n) for i, n in enumerate("abc")])


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, 'a-i' || CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS id, doc_id FROM documents QUALIFY line_no >= 25")
def row_range_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows [25, end) by line number, with text IDs (SRC4, ID1, ID2)."""
    lines = row_range(numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id"), 25)
    return lines.select("line_no", rows.item_id(F.col("line_no")).alias("id"), "doc_id")


@query("SELECT event_id, CASE WHEN value >= 5 AND user_id IS NOT NULL THEN NULL ELSE 'low value' END AS reason FROM events")
def valid_reject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows and rejects (FIL1, SNK3)."""
    good, bad = rows.valid_and_rejects(table(spark, sf_dir, "events"), (F.col("value") >= 5) & F.col("user_id").isNotNull(), "low value")
    return good.select("event_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("event_id", "reason"))


def _rules():
    return [("D1", F.col("n_chars") < 200), ("D2", F.col("text").contains("|")), ("X1", F.col("text").rlike("[0-9]{3}"))]


RULES = "r AS (SELECT *, n_chars < 200 AS d1, contains(text, '|') AS d2, regexp_matches(text, '[0-9]{3}') AS x1 FROM documents)"


@query(f"""WITH {RULES}, w AS (SELECT concat_ws(':', CASE WHEN d1 THEN 'D1' END, CASE WHEN d2 THEN 'D2' END, CASE WHEN x1 THEN 'X1' END) AS warning FROM r)
SELECT 'valid' AS counter, count(*) AS n FROM w UNION ALL SELECT 'partly passed', count(*) FILTER (warning = '' OR starts_with(warning, 'D')) FROM w UNION ALL SELECT 'passed', count(*) FILTER (warning = '') FROM w""")
def rule_cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule cascade with counters (FIL2, FIL3, AGG6)."""
    checked = rows.cascade(table(spark, sf_dir, "documents"), _rules())
    return profile.counters(checked, {"valid": F.lit(True), "partly passed": rows.partly_passed(), "passed": F.col("pass")})


@query("SELECT doc_id, CASE quality + toxic WHEN 2 THEN 'High' WHEN 1 THEN 'Medium' WHEN 0 THEN 'Low' ELSE CAST(quality + toxic AS VARCHAR) END AS label FROM labels")
def class_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal classes as text (FN1)."""
    return table(spark, sf_dir, "labels").select("doc_id", scalar.class_label(F.col("quality") + F.col("toxic")).alias("label"))


@query("SELECT p_partkey, round(-p_size * (1.0::DOUBLE / (1.0::DOUBLE + exp(p_retailprice / 200.0::DOUBLE - 8.0::DOUBLE))), 6) AS score, floor(p_retailprice * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS price FROM part")
def desirability_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Desirability and half-up rounding (FN4, FN5)."""
    return table(spark, sf_dir, "part").select("p_partkey", six(scalar.desirability(F.col("p_size"), F.col("p_retailprice") / 200.0)).alias("score"), scalar.round_half_up(F.col("p_retailprice"), 1).alias("price"))


@query("""SELECT 'a-i' || CAST(doc_id AS VARCHAR) || '.s' || CAST(k - 1 AS VARCHAR) AS id, md5(line) AS variant FROM
(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents)""")
def variants_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text as variants with ordinals (EXP1)."""
    docs = table(spark, sf_dir, "documents").select(rows.item_id(F.col("doc_id")).alias("id"), F.split("text", "\n").alias("v"))
    return rows.expanded(docs, F.col("v")).select("id", F.md5("variant").alias("variant"))


@query("SELECT 'l_extendedprice' AS value_name, CAST(floor(l_extendedprice / 1000.0::DOUBLE) AS BIGINT) AS bin_idx, count(*) AS n FROM lineitem GROUP BY ALL")
def hist_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One histogram (AGG1)."""
    return profile.histogram(table(spark, sf_dir, "lineitem"), {"l_extendedprice": 1000})


@query("""SELECT value_name, bin_idx, count(*) AS n FROM (
SELECT 'l_quantity' AS value_name, CAST(floor(l_quantity / 1.0::DOUBLE) AS BIGINT) AS bin_idx FROM lineitem UNION ALL SELECT 'l_discount', CAST(floor(l_discount / 0.01::DOUBLE) AS BIGINT) FROM lineitem UNION ALL
SELECT 'l_tax', CAST(floor(l_tax / 0.02::DOUBLE) AS BIGINT) FROM lineitem) WHERE bin_idx IS NOT NULL GROUP BY ALL""")
def hist_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several histograms in one pass (AGG2)."""
    return profile.histogram(table(spark, sf_dir, "lineitem"), {"l_quantity": 1, "l_discount": "0.01", "l_tax": "0.02"})


@query("SELECT 'value' AS value_name, CAST(floor(value / 0.1::DOUBLE) AS BIGINT) AS bin_idx, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL")
def hist_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of two runs, merged in a store; a run that is written twice counts once (AGG3, JN8, SNK4, SRC14)."""
    events = table(spark, sf_dir, "events")
    store = f"{shared_folder(spark)}/profile-{uuid.uuid4().hex}"
    even = profile.histogram(events.where("event_id % 2 = 0"), {"value": "0.1"})
    append_run(even, store, "even")
    append_run(profile.histogram(events.where("event_id % 2 != 0 or event_id is null"), {"value": "0.1"}), store, "odd")
    append_run(even, store, "even")
    return merged(spark, store, ["value_name", "bin_idx"])


FLAGS = [("numbers", "[0-9]{3}"), ("table", r"\|"), ("address", "@[a-z]"), ("licence", "[Ll]icen[cs]e"), ("nothing", "qqqqqq")]


@query(f"""WITH f AS (SELECT n_chars, unnest(list_filter([{", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in FLAGS)}], lambda x: x IS NOT NULL)) AS flag FROM documents),
h AS (SELECT 'n_chars' AS value_name, flag, CAST(floor(n_chars / 500.0::DOUBLE) AS BIGINT) AS bin_idx, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT value_name, unnest(range(min(bin_idx), max(bin_idx) + 1)) AS bin_idx FROM h GROUP BY value_name),
k AS (SELECT value_name, bin_idx, flag FROM b, (SELECT unnest([{", ".join(f"'{n}'" for n, _ in FLAGS)}]) AS flag))
SELECT value_name, bin_idx, {", ".join(f"CAST(coalesce(sum(n) FILTER (flag = '{n}'), 0) AS BIGINT) AS {n}" for n, _ in FLAGS)} FROM k LEFT JOIN h USING (value_name, bin_idx, flag) GROUP BY ALL""")
def hist_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms per non-exclusive pattern flag over one bin range, wide (JN6, AGG5, SNK5)."""
    names = [n for n, _ in FLAGS]
    found = profile.histogram_by_flag(table(spark, sf_dir, "documents"), {"n_chars": 500}, profile.pattern_flags("text", FLAGS))
    return profile.pivoted(profile.gap_filled(found, names), names)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def unique_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that repeat (FIL11)."""
    return rows.repeated_keys(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def member_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership by a semi join (FIL4)."""
    ids = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return rows.members(table(spark, sf_dir, "orders"), ids, "o_custkey").select("o_orderkey", "o_orderpriority")


@query("SELECT DISTINCT p_name, regexp_replace(trim(p_name), '[^A-Za-z0-9_]+', '_', 'g') AS name FROM part")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names fit for columns, once each (FN10, SET7)."""
    return table(spark, sf_dir, "part").select("p_name", scalar.clean_name(F.col("p_name")).alias("name")).distinct()


@query("""SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0::DOUBLE AS seconds FROM events""")
def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds since the user's event before (FN11)."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", scalar.seconds_between(before, F.col("ts")).alias("seconds"))


@query("""WITH f AS (SELECT o_custkey, max(o_totalprice) AS f FROM orders GROUP BY ALL) SELECT c_custkey, round(f, 2) AS f FROM customer JOIN f ON o_custkey = c_custkey""")
def features_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed features joined once a key (JN2)."""
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("f"))
    return rows.features_joined(table(spark, sf_dir, "customer").select("c_custkey"), found.unionByName(found), "c_custkey").select("c_custkey", F.round("f", 2).alias("f"))


@query("SELECT doc_id AS id, CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NULL THEN 'truth' END AS side FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def unmatched_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, and labels without a document (MET16)."""
    ids = lambda name: table(spark, sf_dir, name).select(F.col("doc_id").alias("id"))
    return metrics.unmatched(ids("documents"), ids("labels"))


@query("SELECT count(*) AS n_rows, CAST(max(len(embedding)) AS INTEGER) AS n_features, count(DISTINCT label) AS n_classes FROM embeddings")
def dataset_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, features and classes of a training set (AGG20, AGG24)."""
    vectors = table(spark, sf_dir, "embeddings")
    return features.dataset_shape(vectors, "embedding").crossJoin(search.class_counts(vectors, "label"))


@query("""WITH b AS (SELECT l_orderkey AS g, p_partkey AS n, [CAST(p_type = t AS DOUBLE) FOR t IN ['ECONOMY', 'STANDARD', 'PROMO']] AS f, p_type NOT IN ('ECONOMY', 'STANDARD') AS o FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT g AS graph_id, n AS node_id, f[1] AS economy, f[2] AS standard, CAST(o AS DOUBLE) AS other FROM b GROUP BY ALL""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node tables of the order graphs with one-of-k features (FEA11)."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), "p_type")
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph_id"), F.col("l_partkey").alias("node_id")).distinct().join(parts, "node_id")
    found = features.node_table(nodes, {"p_type": LEVELS}, unknown=("p_type",))
    return found.select("graph_id", "node_id", *[F.col("feats")[i].alias(n) for i, n in enumerate(("economy", "standard", "other"))])


# ---- splits

DRAW = "md5(concat_ws(':', '7', CAST(resample AS VARCHAR), CAST(id AS VARCHAR)))"


def _order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))


@query(f"""WITH d AS (SELECT o_orderkey AS id, resample FROM orders, (SELECT unnest(range(0, 3)) AS resample)),
r AS (SELECT *, row_number() OVER (PARTITION BY resample ORDER BY {DRAW}, id) - 1 AS r, count(*) OVER (PARTITION BY resample) AS n FROM d)
SELECT CAST(resample AS INTEGER) AS resample, id, CASE WHEN r < ceil(round(n * 0.2::DOUBLE, 9)) THEN 'test' ELSE 'train' END AS split FROM r
WHERE r < ceil(round(n * 0.2::DOUBLE, 9)) + floor(round(n * 0.7::DOUBLE, 9))""")
def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random resamples (SPL1)."""
    return splits.random_splits(_order_ids(spark, sf_dir), 3, 0.2, 0.7, seed=7)


@query(f"""WITH r AS (SELECT o_orderkey AS id, 0 AS resample, count(*) OVER () AS n FROM orders),
k AS (SELECT id, n, row_number() OVER (ORDER BY {DRAW}, id) - 1 AS r FROM r)
SELECT id, CAST(CASE WHEN r < (n % 7) * (n // 7 + 1) THEN r // (n // 7 + 1) ELSE n % 7 + (r - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold FROM k""")
def split_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled folds of equal size (SPL2)."""
    return splits.kfold(_order_ids(spark, sf_dir), 7, seed=7)


@query(f"""WITH d AS (SELECT o_orderkey AS id, o_orderpriority AS stratum FROM orders), s AS (SELECT stratum, count(*) AS size FROM d GROUP BY ALL), n AS (SELECT CAST(ceil(round(sum(size) * (1 - 0.7::DOUBLE), 9)) AS BIGINT) AS t, CAST(sum(size) AS BIGINT) AS total FROM s),
q AS (SELECT stratum, CAST(floor(CAST(size * t AS DOUBLE) / total) AS BIGINT) AS base, round(CAST(size * t AS DOUBLE) / total - floor(CAST(size * t AS DOUBLE) / total), 9) AS rest, t FROM s, n),
p AS (SELECT stratum, base + CAST(row_number() OVER (ORDER BY rest DESC, stratum) <= t - sum(base) OVER () AS INTEGER) AS quota FROM q),
r AS (SELECT id, stratum, resample, row_number() OVER (PARTITION BY resample, stratum ORDER BY {DRAW}, id) - 1 AS r FROM d, (SELECT unnest(range(0, 2)) AS resample))
SELECT CAST(resample AS INTEGER) AS resample, id, CASE WHEN r < quota THEN 'test' ELSE 'train' END AS split FROM r JOIN p USING (stratum)""")
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified resamples (SPL3)."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    return splits.stratified_splits(ids, "o_orderpriority", 2, 0.7, seed=7)


@query(f"""WITH g AS (SELECT DISTINCT source AS id FROM documents), d AS (SELECT id, resample FROM g, (SELECT unnest(range(0, 4)) AS resample)),
r AS (SELECT *, row_number() OVER (PARTITION BY resample ORDER BY {DRAW}, id) - 1 AS r, count(*) OVER (PARTITION BY resample) AS n FROM d)
SELECT CAST(resample AS INTEGER) AS resample, doc_id AS id, CASE WHEN r < ceil(round(n * (1 - 0.75::DOUBLE), 9)) THEN 'test' ELSE 'train' END AS split FROM r JOIN documents ON source = r.id""")
def split_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sources on one side (SPL4)."""
    return splits.grouped_splits(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), "source", 4, 0.75, seed=7)


@query("""WITH RECURSIVE c AS (SELECT CAST(o_custkey AS VARCHAR) AS g, count(*) AS n FROM orders GROUP BY ALL), g AS (SELECT g, n, row_number() OVER (ORDER BY n DESC, g) AS i FROM c),
w AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load, CAST(0 AS BIGINT) AS fold
  UNION ALL
  SELECT g.i, list_transform(range(1, 6), lambda k: w.load[k] + CASE WHEN k = list_position(w.load, list_min(w.load)) THEN g.n ELSE 0 END), CAST(list_position(w.load, list_min(w.load)) - 1 AS BIGINT) FROM w JOIN g ON g.i = w.i + 1
)
SELECT o_orderkey AS id, CAST(fold AS INTEGER) AS fold FROM orders JOIN g ON g.g = CAST(o_custkey AS VARCHAR) JOIN w ON w.i = g.i""")
def split_grouped_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced folds of whole customers (SPL5): each group, the largest first, goes to the lightest fold."""
    return splits.grouped_kfold(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey"), "o_custkey", 5)


NESTED = f"""d AS (SELECT p_partkey AS id, resample FROM part, (SELECT unnest(range(0, 2)) AS resample)),
r AS (SELECT *, row_number() OVER (PARTITION BY resample ORDER BY {DRAW}, id) - 1 AS r, count(*) OVER (PARTITION BY resample) AS n FROM d),
o AS (SELECT resample, id, CASE WHEN r < ceil(round(n * 0.25::DOUBLE, 9)) THEN 'test' ELSE 'train' END AS split FROM r),
i AS (SELECT resample, id, row_number() OVER (PARTITION BY resample ORDER BY md5(concat_ws(':', '7', 'inner', CAST(resample AS VARCHAR), CAST(id AS VARCHAR))), id) - 1 AS r, count(*) OVER (PARTITION BY resample) AS n FROM o WHERE split = 'train'),
f AS (SELECT resample, id, CASE WHEN r < (n % 3) * (n // 3 + 1) THEN r // (n // 3 + 1) ELSE n % 3 + (r - (n % 3) * (n // 3 + 1)) // (n // 3) END AS fold FROM i),
nested AS (SELECT resample, 'refit' AS cv, id, split FROM o UNION ALL SELECT resample, CAST(cv AS VARCHAR), id, CASE WHEN cv = fold THEN 'val' ELSE 'train' END FROM f, (SELECT unnest(range(0, 3)) AS cv)
UNION ALL SELECT resample, CAST(cv AS VARCHAR), id, 'test' FROM o, (SELECT unnest(range(0, 3)) AS cv) WHERE split = 'test')"""


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.nested_kfold(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), 2, 0.25, 3, seed=7)


@query(f"WITH {NESTED} SELECT CAST(resample AS INTEGER) AS resample, cv, id, split FROM nested")
def split_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resamples with inner folds and a refit column (SPL9, SET4)."""
    return _nested(spark, sf_dir)


INNER = "md5(concat_ws(':', '7', CAST(resample AS VARCHAR), CAST(cv AS VARCHAR), CAST(id AS VARCHAR)))"


@query(f"""WITH {NESTED.split("i AS (SELECT")[0]} t AS (SELECT o.resample, o.id, p_brand AS stratum, cv FROM o JOIN part ON p_partkey = o.id, (SELECT unnest(range(0, 2)) AS cv) WHERE split = 'train'),
s AS (SELECT resample, stratum, count(*) AS size FROM t WHERE cv = 0 GROUP BY ALL), n AS (SELECT resample, CAST(sum(size) AS BIGINT) AS total, CAST(ceil(round(sum(size) * 0.3::DOUBLE, 9)) AS BIGINT) AS wanted FROM s GROUP BY resample),
q AS (SELECT resample, stratum, wanted, CAST(size * wanted AS DOUBLE) / total AS exact FROM s JOIN n USING (resample)),
b AS (SELECT resample, stratum, CAST(floor(exact) AS BIGINT) AS base, wanted, round(exact - floor(exact), 9) AS rest FROM q),
u AS (SELECT resample, stratum, base + CAST(row_number() OVER (PARTITION BY resample ORDER BY rest DESC, stratum) <= wanted - sum(base) OVER (PARTITION BY resample) AS INTEGER) AS quota FROM b),
i AS (SELECT resample, cv, id, stratum, row_number() OVER (PARTITION BY resample, cv, stratum ORDER BY {INNER}, id) - 1 AS r FROM t)
SELECT CAST(resample AS INTEGER) AS resample, 'refit' AS cv, id, split FROM o
UNION ALL SELECT CAST(resample AS INTEGER), CAST(cv AS VARCHAR), id, CASE WHEN r < quota THEN 'val' ELSE 'train' END FROM i JOIN u USING (resample, stratum)
UNION ALL SELECT CAST(resample AS INTEGER), CAST(cv AS VARCHAR), id, 'test' FROM o, (SELECT unnest(range(0, 2)) AS cv) WHERE split = 'test'""")
def split_nested_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resamples with stratified inner splits, drawn for all resamples at once (SPL3, SPL9)."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("stratum"))
    outer = cut(splits.random_splits(part.select("id"), 2, 0.25, None, 7), "outer")
    return splits.nested_drawn(outer, "stratified", 2, 0.3, 7, part)


@query(f"""WITH {NESTED.split("i AS (SELECT")[0]} l AS (SELECT p_partkey AS id, p_size % 2 AS cv, CASE WHEN p_size > 30 THEN 'val' ELSE 'train' END AS split FROM part WHERE p_size IS NOT NULL)
SELECT CAST(resample AS INTEGER) AS resample, 'refit' AS cv, id, split FROM o
UNION ALL SELECT CAST(resample AS INTEGER), CAST(cv AS VARCHAR), id, l.split FROM o JOIN l USING (id) WHERE o.split = 'train'
UNION ALL SELECT CAST(resample AS INTEGER), CAST(cv AS VARCHAR), id, 'test' FROM o, (SELECT unnest(range(0, 2)) AS cv) WHERE split = 'test'""")
def split_nested_predefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resamples whose inner splits come from a table (SPL7, SPL8, SPL9)."""
    part = table(spark, sf_dir, "part")
    outer = cut(splits.random_splits(part.select(F.col("p_partkey").alias("id")), 2, 0.25, None, 7), "outer")
    lists = part.where("p_size is not null").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2).alias("cv"), F.when(F.col("p_size") > 30, "val").otherwise("train").alias("split"))
    return splits.nested_predefined(outer, lists)


@query(f"""WITH {NESTED}, broken AS (SELECT * FROM nested WHERE NOT (resample = 1 AND cv = '0' AND id % 50 = 0) UNION ALL SELECT resample, cv, id, 'test' FROM nested WHERE cv = 'refit' AND resample = 0 AND split = 'train'),
p AS (SELECT resample, cv, id, count(DISTINCT split) AS k FROM broken GROUP BY ALL)
SELECT CAST(resample AS INTEGER) AS resample, cv, count(*) AS n_ids, count(*) FILTER (k > 1) AS n_overlapping FROM p GROUP BY ALL HAVING count(*) <> (SELECT count(*) FROM part) OR count(*) FILTER (k > 1) > 0""")
def split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a split table that was damaged on purpose (FIL12)."""
    good = cut(_nested(spark, sf_dir), "nested")
    twice = good.where("cv = 'refit' and resample = 0 and split = 'train'").withColumn("split", F.lit("test"))
    return splits.split_faults(good.where("not (resample = 1 and cv = '0' and id % 50 = 0)").unionByName(twice), table(spark, sf_dir, "part").count())


# ---- metrics and summaries

REGRESSION = """1 - sum((t - p) ^ 2) / (var_pop(t) * count(*)) AS r2, sqrt(avg((t - p) ^ 2)) AS rmsd, avg((t - p) ^ 2) AS mse, avg(p - t) AS bias, stddev_pop(p - t) AS sdep, avg(abs(p - t)) AS mae,
covar_samp(t, p) / (stddev_samp(t) * stddev_samp(p)) AS pearson, stddev_pop(t) AS y_stddev_pop, stddev_samp(t) AS y_stddev_samp"""


@query(f"WITH {PAIRS}, m AS (SELECT model, task, {REGRESSION} FROM pairs GROUP BY ALL) SELECT model, task, metric, round(value, 4) AS value FROM m UNPIVOT (value FOR metric IN (r2, rmsd, mse, bias, sdep, mae, pearson, y_stddev_pop, y_stddev_samp))")
def metrics_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All regression metrics of every model and task in one aggregation (MET1-MET7, MET14, MET15)."""
    found = metrics.evaluated(_pairs(spark, sf_dir), ["model", "task"], metrics.regression_metrics(F.col("t"), F.col("p")))
    return found.withColumn("value", F.round("value", 4))


@query(f"""WITH {PAIRS}, r AS (SELECT model, task, rank() OVER (PARTITION BY model, task ORDER BY t) + (count(*) OVER (PARTITION BY model, task, t) - 1) / 2 AS a, rank() OVER (PARTITION BY model, task ORDER BY p) + (count(*) OVER (PARTITION BY model, task, p) - 1) / 2 AS b FROM pairs)
SELECT model, task, round(covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b)), 6) AS spearman FROM r GROUP BY ALL""")
def spearman_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman with average ranks (WIN1, MET8)."""
    return metrics.spearman(_pairs(spark, sf_dir), ["model", "task"], "t", "p").withColumn("spearman", six(F.col("spearman")))


@query("""WITH x AS (SELECT p_type, p_partkey AS i, p_size AS a, round(p_retailprice, 0) AS b FROM part),
s AS (SELECT x.p_type, sum(sign(x.a - y.a) * sign(x.b - y.b)) AS s, count(*) FILTER (x.a <> y.a) AS ta, count(*) FILTER (x.b <> y.b) AS tb FROM x JOIN x y ON x.p_type = y.p_type AND x.i < y.i GROUP BY ALL)
SELECT p_type, round(s / sqrt(CAST(ta AS DOUBLE) * tb), 6) AS kendall FROM s""")
def kendall_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau-b without pairs (MET9)."""
    parts = table(spark, sf_dir, "part").select("p_type", "p_size", F.round("p_retailprice", 0).alias("price"))
    return metrics.kendall(parts, ["p_type"], "p_size", "price").withColumn("kendall", six(F.col("kendall")))


@query("""WITH j AS (SELECT source, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS t, CASE WHEN n_chars > 1000 THEN 'good' WHEN n_chars > 100 THEN 'bad' ELSE 'short' END AS p FROM labels JOIN documents USING (doc_id))
, c AS (SELECT DISTINCT t AS class FROM j UNION SELECT DISTINCT p FROM j),
k AS (SELECT source, class, count(*) FILTER (t = class AND p = class) AS tp, count(*) FILTER (t <> class AND p = class) AS fp, count(*) FILTER (t = class AND p <> class) AS fn FROM j, c GROUP BY ALL)
SELECT source, round(CAST(count(*) FILTER (t = p) AS DOUBLE) / count(*), 6) AS accuracy, any_value(recall) AS recall, any_value(precision) AS precision
FROM j JOIN (SELECT source, round(CAST(sum(tp) AS DOUBLE) / sum(tp + fn), 6) AS recall, round(CAST(sum(tp) AS DOUBLE) / sum(tp + fp), 6) AS precision FROM k GROUP BY ALL) USING (source) GROUP BY ALL""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, micro recall and precision (MET10-MET12)."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    said = F.when(F.col("n_chars") > 1000, "good").when(F.col("n_chars") > 100, "bad").otherwise("short")
    found = metrics.classification_metrics(both.select("source", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("t"), said.alias("p")), ["source"], "t", "p")
    return found.select("source", *[six(F.col(c)).alias(c) for c in ("accuracy", "recall", "precision")])


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS top FROM embeddings")
def top_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of the largest score (MET13)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", metrics.top_class(F.col("embedding")).alias("top"))


@query(f"""WITH {PAIRS}, m AS (SELECT model AS resample, task AS dataset, {REGRESSION} FROM pairs GROUP BY ALL), u AS (SELECT dataset, metric, value FROM m UNPIVOT (value FOR metric IN (rmsd, mae, r2)))
SELECT dataset, metric, round(m, 4) AS mean, round(s, 4) AS std, round(e, 4) AS sem, CASE metric WHEN 'rmsd' THEN round(m - 1.69::DOUBLE * e, 4) END AS ci95_lower, CASE metric WHEN 'rmsd' THEN round(m + 1.69::DOUBLE * e, 4) END AS ci95_upper
FROM (SELECT dataset, metric, avg(value) AS m, stddev_samp(value) AS s, stddev_samp(value) / sqrt(count(value)) AS e FROM u GROUP BY dataset, metric)""")
def perf_summary_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation, standard error and bounds over resamples (AGG8, AGG9)."""
    chosen = {k: m for k, m in metrics.regression_metrics(F.col("t"), F.col("p")).items() if k in ("rmsd", "mae", "r2")}
    values = metrics.evaluated(_pairs(spark, sf_dir), ["model", "task"], chosen).select(F.col("task").alias("dataset"), "metric", "value")
    return metrics.summary(values).select("dataset", "metric", *[F.round(c, 4).alias(c) for c in ("mean", "std", "sem", "ci95_lower", "ci95_upper")])


@query(f"""WITH {PAIRS} SELECT model, round(sqrt(avg((p - t) ^ 2)), 4) AS rmsd, round(avg(p - t), 4) AS mean_diff, round(max(abs(p - t)), 4) AS largest_diff, arg_min(id, (-abs(p - t), id)) AS largest_at FROM pairs GROUP BY ALL""")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored against fresh predictions (AGG19, WIN4)."""
    found = metrics.drift(_pairs(spark, sf_dir), ["model"], "t", "p", "id")
    return found.select("model", *[F.round(c, 4).alias(c) for c in ("rmsd", "mean_diff", "largest_diff")], "largest_at")


# ---- ensembles and choice


@query(f"WITH {MEMBERS} SELECT id, round(avg(pred), 4) AS mean, round(stddev_pop(pred), 4) AS spread FROM members GROUP BY ALL")
def ensemble_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble mean and spread (AGG13)."""
    return ensemble.mean_and_spread(_members(spark, sf_dir)).select("id", F.round("mean", 4).alias("mean"), F.round("spread", 4).alias("spread"))


@query(f"""WITH {MEMBERS} SELECT id, round(avg(pred), 4) AS mean, round(sqrt(var_pop(pred) + avg(q * member)), 4) AS total, round(sqrt(avg(q * member)), 4) AS aleatoric, round(sqrt(var_pop(pred)), 4) AS epistemic FROM members GROUP BY ALL""")
def mc_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertainty from repeated draws (AGG14)."""
    draws = _members(spark, sf_dir).withColumn("variance", F.col("q") * F.col("member"))
    return ensemble.draw_uncertainty(draws).select("id", *[F.round(c, 4).alias(c) for c in ("mean", "total", "aleatoric", "epistemic")])


@query(f"""WITH {MEMBERS}, u AS (SELECT id, pred, q * member AS u FROM members)
SELECT id, round(sqrt(var_pop(u) + var_pop(pred)), 4) AS as_published, round(sqrt(avg(u ^ 2) + var_pop(pred)), 4) AS total_variance FROM u GROUP BY ALL""")
def ensemble_total_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total uncertainty of an ensemble, both forms (AGG15)."""
    found = ensemble.total_uncertainty(_members(spark, sf_dir).withColumn("uncertainty", F.col("q") * F.col("member")))
    return found.select("id", *[F.round(c, 4).alias(c) for c in ("as_published", "total_variance")])


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction log: members are resamples, an item is in test where id + resample is a multiple of 3."""
    split = F.when((F.col("id") + F.col("member")) % 3 == 0, "test").otherwise("train")
    return _members(spark, sf_dir).select(F.col("member").alias("resample"), F.lit("refit").alias("cv_fold"), F.lit(0).alias("model_number"), split.alias("data_split"), "task", "id", "pred", "t")


LOG = MEMBERS + ", log AS (SELECT member AS resample, CASE WHEN (id + member) % 3 = 0 THEN 'test' ELSE 'train' END AS data_split, task, id, pred, t FROM members)"


@query(f"WITH {LOG} SELECT task, id, round(avg(pred) FILTER (data_split = 'train'), 4) AS train, round(avg(pred) FILTER (data_split = 'test'), 4) AS test FROM log GROUP BY ALL")
def refit_average_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean predictions by split, wide (AGG17, SET6)."""
    return ensemble.mean_by_split(_log(spark, sf_dir), ["train", "test"]).select("task", "id", F.round("train", 4).alias("train"), F.round("test", 4).alias("test"))


@query(f"WITH {LOG}, a AS (SELECT task, id, avg(pred) AS pred FROM log WHERE data_split = 'test' GROUP BY ALL), w AS (SELECT id FROM a GROUP BY id HAVING count(*) = 1) SELECT task, id, round(pred, 4) AS pred FROM a WHERE id IN (SELECT id FROM w)")
def refit_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble of refits (AGG16, FIL6): a line has one task, so each is whole where it has a mean."""
    log = _log(spark, sf_dir)
    mean = ensemble.refit_average(log)
    return mean.join(rows.complete_items(mean, 1), "id", "left_semi").select("task", "id", F.round("pred", 4).alias("pred"))


@query(f"WITH {LOG}, m AS (SELECT task, data_split, id, avg(pred) AS pred FROM log GROUP BY ALL), y AS (SELECT task, id, avg(t) AS t FROM pairs GROUP BY ALL), a AS (SELECT * FROM m JOIN y USING (task, id)) SELECT task, data_split, round(sqrt(avg((pred - t) ^ 2)), 4) AS rmsd FROM a GROUP BY ALL")
def rmsd_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSD on item means by split (AGG18, JN3)."""
    log = _log(spark, sf_dir)
    truth = _pairs(spark, sf_dir).groupBy("task", "id").agg(F.avg("t").alias("t"))
    return ensemble.rmsd_of_means(log, truth).withColumn("rmsd", F.round("rmsd", 4))


SPACE = {"trees": [10, 50, 100], "depth": [3, 5], "leaf": ["1", "4"], "_order": ["trees", "depth", "leaf"]}
GRID = """trees AS (SELECT unnest(['10', '50', '100']) AS trees, unnest([0, 1, 2]) AS i), depth AS (SELECT unnest(['3', '5']) AS depth, unnest([0, 1]) AS j), leaf AS (SELECT unnest(['1', '4']) AS leaf, unnest([0, 1]) AS k),
grid AS (SELECT CAST(i * 4 + j * 2 + k AS BIGINT) AS model_number, trees, depth, leaf FROM trees, depth, leaf),
work AS (SELECT resample, cv_fold, grid.* FROM (SELECT DISTINCT year(o_orderdate) AS resample, o_orderpriority AS cv_fold FROM orders), grid)"""


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("resample"), F.col("o_orderpriority").alias("cv_fold"))
    return search.work_list(folds, search.grid(spark, SPACE))


@query(f"WITH {GRID} SELECT CAST(resample AS INTEGER) AS resample, cv_fold, model_number, trees, depth, leaf FROM work")
def grid_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fold that orders have with every combination (SPL12, MOD10)."""
    return _work(spark, sf_dir)


@query(f"WITH {GRID} SELECT CAST(resample AS INTEGER) AS resample, cv_fold, model_number, trees, depth, leaf FROM work WHERE NOT (resample % 2 = 0 AND trees <> '50')")
def worklist_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work left on a restart, keys compared as text (JN5, FIL13)."""
    work = _work(spark, sf_dir)
    done = work.where("resample % 2 = 0 and trees != '50'").select(F.col("resample").cast("string").alias("resample"), "cv_fold", "trees", F.col("depth").cast("int").alias("depth"), "leaf")
    return rows.unfinished(work, done, ["resample", "cv_fold", "trees", "depth", "leaf"])


@query(f"""WITH {MEMBERS}, l AS (SELECT member AS model_number, task AS resample, model AS cv_fold, sqrt(avg((pred - t) ^ 2)) AS loss FROM members GROUP BY ALL), m AS (SELECT resample, model_number, avg(loss) AS loss FROM l GROUP BY ALL)
SELECT resample, CAST(model_number AS INTEGER) AS model_number, round(loss, 4) AS loss FROM m QUALIFY row_number() OVER (PARTITION BY resample ORDER BY loss, model_number) = 1""")
def best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best configuration of each resample by mean validation loss (AGG10, WIN3)."""
    log = _members(spark, sf_dir).groupBy(F.col("task").alias("resample"), F.col("model").alias("cv_fold"), F.col("member").alias("model_number")).agg(F.sqrt(F.avg(F.pow(F.col("pred") - F.col("t"), 2))).alias("loss"))
    return search.best_configuration(log).withColumn("loss", F.round("loss", 4))


EPOCHS = "epochs AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS loss FROM events WHERE value IS NOT NULL)"


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").where("value is not null").select(F.col("user_id").alias("run"), F.row_number().over(at).alias("epoch"), F.col("value").alias("loss"))


@query(f"WITH {EPOCHS} SELECT run, CAST(epoch AS INTEGER) AS epoch, min(loss) OVER w AS best_loss, CAST(arg_min(epoch, (loss, epoch)) OVER w AS INTEGER) AS best_epoch FROM epochs WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING)")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest loss so far, users as runs and events as epochs (WIN5)."""
    return search.running_best(_epochs(spark, sf_dir)).select("run", "epoch", "best_loss", "best_epoch")


STOPS = f"""WITH RECURSIVE {EPOCHS}, f AS (
  SELECT DISTINCT run, CAST(0 AS BIGINT) AS epoch, CAST(3 AS BIGINT) AS due, CAST('inf' AS DOUBLE) AS before, CAST('inf' AS DOUBLE) AS best, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS stop FROM epochs
  UNION ALL
  SELECT run, epoch, CASE WHEN checked THEN greatest(least(place + 3, 30), epoch + 1) ELSE due END, CASE WHEN checked THEN best ELSE before END, best, place,
    CASE WHEN checked AND epoch = 30 THEN 30 WHEN checked AND before - best <= 0.5 THEN place ELSE stop END
  FROM (SELECT f.run, e.epoch, f.due, f.before, f.stop, f.stop IS NULL AND e.epoch = f.due AS checked, CASE WHEN e.loss < f.best THEN e.loss ELSE f.best END AS best, CASE WHEN e.loss < f.best THEN e.epoch ELSE f.place END AS place
    FROM f JOIN epochs e ON e.run = f.run AND e.epoch = f.epoch + 1 WHERE e.epoch <= 30)
), stops AS (SELECT run, CAST(max(stop) AS INTEGER) AS stop_epoch FROM f GROUP BY run)"""


@query(f"{STOPS} SELECT run, stop_epoch FROM stops")
def early_stop_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early-stop epoch of each run (WIN6)."""
    return search.stopping_epoch(_epochs(spark, sf_dir), 30, 3, 0.5)


# ---- features, similarity, models

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("WITH s AS (SELECT " + ", ".join(f"CAST(min({c}) = max({c}) AS INTEGER) AS {c}" for c in [*NUMBERS, "one"]) + " FROM (SELECT *, 1 AS one FROM lineitem)) SELECT name FROM (SELECT * FROM s UNPIVOT (same FOR name IN (*))) WHERE same = 1")
def const_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that hold one value (FEA1)."""
    found = features.constant_columns(table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1)), [*NUMBERS, "one"])
    return spark.createDataFrame([(c,) for c in found], "name string")


@query("WITH c AS (SELECT " + ", ".join(f"covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) AS \"{a}|{b}\"" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]) + " FROM lineitem), u AS (SELECT pair, r FROM c UNPIVOT (r FOR pair IN (*))) SELECT split_part(pair, '|', 1) AS a, split_part(pair, '|', 2) AS b, round(r, 6) AS r FROM u")
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of all pairs of columns (AGG7)."""
    return features.correlations(table(spark, sf_dir, "lineitem"), NUMBERS).withColumn("r", six(F.col("r")))


_CORRELATED = ["l_quantity", "l_discount", "q2", "l_tax"]


# the later column of a pair at the cut-off goes if no stronger pair has taken its partner; one pair is that strong here
@query("WITH c AS (SELECT " + ", ".join(f"abs(corr({a}, {b})) AS \"{a}|{b}\"" for i, a in enumerate(_CORRELATED) for b in _CORRELATED[i + 1 :]) + " FROM (SELECT *, l_quantity * 2 AS q2 FROM lineitem)) SELECT split_part(pair, '|', 2) AS removed FROM (SELECT * FROM c UNPIVOT (r FOR pair IN (*))) WHERE r >= 0.95")
def corr_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that go for correlation of 0.95 or more; q2 is twice the quantity (FEA2, WIN7)."""
    li = table(spark, sf_dir, "lineitem").withColumn("q2", F.col("l_quantity") * 2)
    model = features.CorrelationFilter(inputCols=_CORRELATED, cutoff=0.95).fit(li)
    return spark.createDataFrame([(c,) for c in model.getOrDefault(model.removed)], "removed string")


@query("""WITH f AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM lineitem WHERE l_returnflag <> 'R')
SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity, round((l_tax - mt) / st, 6) AS l_tax FROM lineitem, f WHERE l_returnflag = 'R'""")
def scaled_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows scaled by the training rows' moments (FEA3)."""
    li = table(spark, sf_dir, "lineitem")
    fitted = features.moments(li.where("l_returnflag != 'R'"), ["l_quantity", "l_tax"])
    test = features.scaled(li.where("l_returnflag = 'R'"), fitted)
    return test.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), six(F.col("l_quantity")).alias("l_quantity"), six(F.col("l_tax")).alias("l_tax"))


@query("""WITH f AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, round((l_extendedprice - m) / s, 6) AS scaled, round((l_extendedprice - m) / s * s + m, 4) AS y FROM lineitem, f""")
def target_unscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target scaled and put back (FEA4, UDF8)."""
    li = table(spark, sf_dir, "lineitem")
    fitted = features.moments(li, ["l_extendedprice"])
    y = features.unscaled(F.col("l_extendedprice"), *fitted["l_extendedprice"])
    return features.scaled(li, fitted).select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), six(F.col("l_extendedprice")).alias("scaled"), F.round(y, 4).alias("y"))


LEVELS = ["ECONOMY", "STANDARD", "other"]


@query("""SELECT p_partkey, array_to_string([CAST(p_type = 'ECONOMY' AS INTEGER), CAST(p_type = 'STANDARD' AS INTEGER), CAST(p_type NOT IN ('ECONOMY', 'STANDARD') AS INTEGER)], ',') AS marks FROM part""")
def one_hot_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-of-k marks with a last slot for other levels (FN12)."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(scalar.one_of_k(F.col("p_type"), LEVELS, unknown=True), ",").alias("marks"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph_id"), F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst"))


@query("""WITH e AS (SELECT l_orderkey AS graph_id, l_partkey AS node, -l_suppkey AS n FROM lineitem UNION ALL SELECT l_orderkey, -l_suppkey, l_partkey FROM lineitem)
SELECT graph_id, node, array_to_string(list_sort(list(DISTINCT n)), ',') AS neighbours FROM e GROUP BY ALL""")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric adjacency lists of the order graphs (FEA12, WIN9)."""
    return features.adjacency(_edges(spark, sf_dir)).select("graph_id", "node", F.array_join(F.transform("neighbours", lambda v: v.cast("string")), ",").alias("neighbours"))


@query("SELECT l_orderkey AS graph_id, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount, count(*) AS n_edges FROM lineitem GROUP BY ALL")
def master_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node a graph with the mean features, joined to all others (AGG23, FEA13)."""
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").cast("long").alias("node_id"), F.array("l_quantity", "l_discount").alias("feats"))
    master, edges = features.master_nodes(nodes)
    counted = edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    return master.join(counted, "graph_id").select("graph_id", six(F.col("feats")[0]).alias("quantity"), six(F.col("feats")[1]).alias("discount"), "n_edges")


@query("SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, round(l_quantity * sum(l_tax) OVER w / power(count(*) OVER w, 2), 9) AS share FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def group_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's value from its graph's totals (FN14)."""
    found = share_of_group(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_quantity"), F.col("l_tax"), "share")
    return found.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.round("share", 9).alias("share"))


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    # tokens in a step of their own, so that they are made once for all that looks at them
    tokens = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.split(F.lower("text"), " ").alias("tokens"))
    return tokens.select("id", similarity.ngram_hashes(F.col("tokens"), 2).alias("bits"))


BITS = """w AS (SELECT doc_id AS id, string_split(lower(text), ' ') AS w FROM documents), g AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] AS bit FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM w)),
c AS (SELECT id, count(*) AS k FROM g GROUP BY ALL), q AS (SELECT * FROM g WHERE id % 100 = 0),
hits AS (SELECT q.id AS query_id, t.id AS id, count(*) AS c FROM q JOIN g t USING (bit) GROUP BY ALL), sims AS (SELECT query_id, hits.id, c / (a.k + b.k - c) AS similarity FROM hits JOIN c a ON a.id = query_id JOIN c b ON b.id = hits.id)"""


def _hits(spark: SparkSession, sf_dir: str, k: int | None = None, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    bits = _bits(spark, sf_dir)
    return bits.where("id % 100 = 0"), similarity.tanimoto_hits(bits.where("id % 100 = 0"), bits, k=k, digits=digits)


@query(f"WITH {BITS} SELECT query_id, id, round(similarity, 6) AS similarity FROM sims")
def tanimoto_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tanimoto of word pairs: documents whose id is divisible by 100 against all (FEA14, SIM1)."""
    return _hits(spark, sf_dir, digits=6)[1]


@query(f"""WITH {BITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims), t AS (SELECT query_id, sum(similarity) AS s FROM r WHERE rank <= 3 GROUP BY ALL)
SELECT doc_id AS query_id, round(coalesce(s, 0) / 3, 6) AS applicability FROM documents LEFT JOIN t ON doc_id = query_id WHERE doc_id % 100 = 0""")
def applicability_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity to the three nearest documents (SIM4, WIN2)."""
    queries, hits = _hits(spark, sf_dir, 3)
    n = table(spark, sf_dir, "documents").count()
    return similarity.applicability(queries, hits, n).withColumn("applicability", six(F.col("applicability")))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"), F.col("label").cast("double").alias("y"))


VECTORS = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, CAST(label AS DOUBLE) AS y FROM embeddings WHERE embedding IS NOT NULL)"


def _nearest_sql(measure: str) -> str:
    return f"""WITH {VECTORS}, s AS (SELECT q.id AS query_id, t.id, {measure} AS similarity FROM v q, v t WHERE q.id % 100 = 0)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) WHERE rank <= 3"""


def _nearest(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return similarity.dense_nearest(vectors.where("id % 100 = 0"), vectors, 3, metric).select("query_id", "id", "rank", six(F.col("similarity")).alias("similarity"))


@query(_nearest_sql("list_dot_product(q.e, t.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(t.e, t.e))"))
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest by cosine (SIM2)."""
    return _nearest(spark, sf_dir, "cosine")


@query(_nearest_sql("list_dot_product(q.e, t.e) / (list_dot_product(q.e, q.e) + list_dot_product(t.e, t.e) - list_dot_product(q.e, t.e))"))
def cont_tanimoto_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest by continuous Tanimoto (SIM3)."""
    return _nearest(spark, sf_dir, "tanimoto")


@query(f"""WITH {VECTORS}, s AS (SELECT q.id AS query_id, t.id, t.y, list_dot_product(q.e, q.e) + list_dot_product(t.e, t.e) - 2 * list_dot_product(q.e, t.e) AS d FROM v q, v t WHERE q.id % 100 = 0 AND t.id % 100 <> 0)
SELECT query_id, round(avg(y), 6) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM s) WHERE rank <= 5 GROUP BY ALL""")
def knn_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean label of the five nearest vectors (MOD1)."""
    vectors = _vectors(spark, sf_dir)
    return models.knn_regress(vectors.where("id % 100 = 0"), vectors.where("id % 100 != 0"), 5).withColumn("pred", six(F.col("pred")))


@query("""WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) * count(*) AS sxy, var_pop(l_quantity) * count(*) AS sxx, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem)
SELECT round(sxy / (sxx + 10.0::DOUBLE), 3) AS slope, round(my - sxy / (sxx + 10.0::DOUBLE) * mx, 2) AS intercept FROM s""")
def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge regression of the price on the quantity (MOD2)."""
    model = models.ridge(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", 10.0)
    return spark.createDataFrame([(round(float(model.coefficients[0]), 3), round(float(model.intercept), 2))], "slope double, intercept double")


FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), *FEATURES, F.col("l_extendedprice").alias("y"), F.pmod(F.col("l_orderkey"), F.lit(3)).cast("int").alias("fold"))


@query()
def pls_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial least squares coefficients (MOD3)."""
    coefficients, intercept = models.pls(_modelled(spark, sf_dir), FEATURES, "y")
    return spark.createDataFrame([*coefficients.items(), ("intercept", intercept)], "name string, value double")


@query()
def rf_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest regression of all lines (MOD4)."""
    data = models.assembled(_modelled(spark, sf_dir), FEATURES)
    return models.forest(trees=10, depth=4).fit(data).transform(data).select("id", F.col("prediction").alias("pred"))


@query()
def rf_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in the order in which recursive elimination leaves them (FEA5)."""
    data, left = cut(_modelled(spark, sf_dir), "modelled"), list(FEATURES)
    order = []
    while len(left) > 1:
        kept = models.eliminate(data, left, "y", len(left) - 1)
        order += [c for c in left if c not in kept]
        left = kept
    return spark.createDataFrame([(c, i) for i, c in enumerate([*order, *left])], "name string, place int")


@query()
def svr_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel support-vector regression on random Fourier features, approximate (MOD6)."""
    data = _modelled(spark, sf_dir)
    scaled = features.scaled(data, features.moments(data, [*FEATURES, "y"]))
    w, bias = models.kernel_svr(scaled, FEATURES, "y", 64, 0.3)
    return models.kernel_predicted(scaled, FEATURES, w, bias, 0.3).select("id", "pred")


@query()
def svc_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel support-vector classification: prices over the mean (MOD7)."""
    data = _modelled(spark, sf_dir)
    scaled = features.scaled(data, features.moments(data, [*FEATURES, "y"])).withColumn("c", (F.col("y") > 0).cast("double"))
    z = models.fourier_features(scaled, FEATURES, 32, 0.3)
    alike = scaled.groupBy(*FEATURES, "c").agg(F.count("*").alias("times"))
    model = models.svc(cut(models.fourier_features(alike, FEATURES, 32, 0.3).select("z", "c", "times"), "kernel"), "c", weight="times")
    return model.transform(z.withColumn("_z", models.array_to_vector("z"))).select("id", F.col("prediction").cast("int").alias("label"))


@query()
def cv_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid search over given folds: mean validation R2 of each combination (MOD9, MOD8, FEA8)."""
    data = _modelled(spark, sf_dir)
    given = data.select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("cv"), "fold").select(F.col("cv").cast("string").alias("cv"), "id", F.when(F.col("cv") == F.col("fold"), "val").otherwise("train").alias("split"))
    options = [{"ridge__regParam": 0.0}, {"ridge__regParam": 1000.0}]
    best, _, log = models.search(data, given, lambda o: models.pipeline(FEATURES, "ridge", **o), options)
    return spark.createDataFrame([(i, cv, s, options[i] == best) for i, cv, s in log], "model_number int, cv string, r2 double, chosen boolean")


@query(f"""WITH m AS (SELECT o_orderkey AS id, o_totalprice AS x, o_totalprice + o_custkey % 100 * 1000.0::DOUBLE AS y FROM orders WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_custkey IS NOT NULL),
d AS (SELECT * FROM m, (SELECT unnest(range(0, 2)) AS resample)),
r AS (SELECT *, row_number() OVER (PARTITION BY resample ORDER BY {DRAW}, id) - 1 AS r, count(*) OVER (PARTITION BY resample) AS n FROM d),
o AS (SELECT *, CASE WHEN r < ceil(round(n * 0.25::DOUBLE, 9)) THEN 'test' ELSE 'train' END AS dataset FROM r),
w AS (SELECT resample, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM o WHERE dataset = 'train' GROUP BY resample),
e AS (SELECT resample, dataset, y, a * x + b - y AS d FROM o JOIN w USING (resample)),
v AS (SELECT resample, dataset, sqrt(avg(d * d)) AS rmsd, avg(abs(d)) AS mae, 1.0::DOUBLE - sum(d * d) / (var_pop(y) * count(*)) AS r2 FROM e GROUP BY ALL)
SELECT dataset, 'rmsd' AS metric, round(avg(rmsd), 2) AS mean FROM v GROUP BY ALL
UNION ALL SELECT dataset, 'mae', round(avg(mae), 2) FROM v GROUP BY ALL
UNION ALL SELECT dataset, 'r2', round(avg(r2), 6) FROM v GROUP BY ALL""")
def model_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits, search, refit and performance of a whole model-building job; the grid's strong penalty loses (MOD9, MOD10, JN5, AGG8)."""
    settings = {
        "dataset": {"tasks": ["y"], "descriptors": ["o_totalprice"], "id_field": "o_orderkey"},
        "train_test_split": {"split_method": "random", "n_splits": 2, "frac_test": 0.25},
        "train_val_split": {"split_method": "random", "n_splits": 1, "frac_test": 0.25},
        "training": {"model_fn_str": "ridge"},
        "hyperparams": {"regParam": [1e15, 0.0]},
    }
    orders = table(spark, sf_dir, "orders").withColumn("y", F.col("o_totalprice") + F.col("o_custkey") % 100 * 1000.0)
    found = jobs.run_models(orders, settings, f"{shared_folder(spark)}/models-{uuid.uuid4().hex}", seed=7)
    kept = found.where(F.col("metric").isin("rmsd", "mae", "r2"))
    return kept.select("dataset", "metric", F.when(F.col("metric") == "r2", F.round("mean", 6)).otherwise(F.round("mean", 2)).alias("mean"))


@query(f"""WITH m AS (SELECT o_orderkey AS id, o_totalprice AS x, o_totalprice + o_custkey % 100 * 1000.0::DOUBLE AS y FROM orders WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_custkey IS NOT NULL),
d AS (SELECT *, 0 AS resample FROM m), r AS (SELECT *, row_number() OVER (ORDER BY {DRAW}, id) - 1 AS r, count(*) OVER () AS n FROM d),
o AS (SELECT *, CASE WHEN r < ceil(round(n * 0.25::DOUBLE, 9)) THEN 'test' ELSE 'train' END AS dataset FROM r),
w AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM o WHERE dataset = 'train')
SELECT dataset, round(sqrt(avg((a * x + b - y) ^ 2)), 2) AS rmsd FROM o, w GROUP BY dataset""")
def elimination_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model-building job whose pipeline drops a constant column and eliminates weak ones by forest importance before a ridge (FEA5, FEA8, MOD8)."""
    settings = {
        "dataset": {"tasks": ["y"], "descriptors": ["weak", "o_totalprice", "flat", "noise"], "id_field": "o_orderkey"},
        "train_test_split": {"split_method": "random", "n_splits": 1, "frac_test": 0.25},
        "train_val_split": {"split_method": "random", "n_splits": 1, "frac_test": 0.25},
        "training": {"model_fn_str": "ridge_eliminate"},
        "hyperparams": {"eliminate__keep": [1], "regParam": [0.0]},
    }
    orders = table(spark, sf_dir, "orders").where("o_custkey is not null")
    orders = orders.select("o_orderkey", "o_totalprice", F.lit(3.0).alias("flat"), (F.col("o_orderkey") % 11).alias("weak"), (F.col("o_orderkey") * 7 % 13).alias("noise"), (F.col("o_totalprice") + F.col("o_custkey") % 100 * 1000.0).alias("y"))
    found = jobs.run_models(orders, settings, _scratch(spark, "elimination"), seed=7)
    return found.where("metric = 'rmsd'").select("dataset", F.round("mean", 2).alias("rmsd"))


@query(f"""WITH b AS (SELECT o_orderkey AS id, o_totalprice AS x, o_custkey AS c, o_orderstatus AS s FROM orders WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_custkey IS NOT NULL),
m AS (SELECT id, x, s, 'cost' AS task, x + c % 100 * 1000.0::DOUBLE AS y FROM b UNION ALL SELECT id, x, s, 'load', CASE WHEN c % 4 > 0 THEN 2.0::DOUBLE * x - c % 50 * 3000.0::DOUBLE END FROM b),
d AS (SELECT * FROM b, (SELECT unnest(range(0, 2)) AS resample)),
r AS (SELECT *, row_number() OVER (PARTITION BY resample ORDER BY {DRAW}, id) - 1 AS r, count(*) OVER (PARTITION BY resample) AS n FROM d),
o AS (SELECT r.resample, m.task, m.id, m.x, m.y, CASE WHEN r < ceil(round(n * 0.25::DOUBLE, 9)) THEN 'test' ELSE 'train' END AS dataset FROM r JOIN m USING (id)),
w AS (SELECT resample, task, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM o WHERE dataset = 'train' AND y IS NOT NULL GROUP BY ALL),
p AS (SELECT resample, task, id, dataset, y, a * x + b AS pred FROM o JOIN w USING (resample, task) UNION ALL SELECT resample, task, id, 'finished', y, a * x + b FROM m JOIN w USING (task) WHERE s = 'F'),
e AS (SELECT -1 AS resample, task, id, 'ensemble' AS dataset, any_value(y) AS y, avg(pred) AS pred FROM p WHERE dataset = 'test' GROUP BY task, id),
v AS (SELECT resample, task, dataset, sqrt(avg((pred - y) ^ 2)) AS rmsd, avg(abs(pred - y)) AS mae, 1.0::DOUBLE - sum((pred - y) ^ 2) / (var_pop(y) * count(*)) AS r2 FROM (SELECT * FROM p UNION ALL SELECT * FROM e) WHERE y IS NOT NULL GROUP BY ALL)
SELECT task, dataset, 'rmsd' AS metric, round(avg(rmsd), 2) AS mean FROM v GROUP BY ALL
UNION ALL SELECT task, dataset, 'mae', round(avg(mae), 2) FROM v GROUP BY ALL
UNION ALL SELECT task, dataset, 'r2', round(avg(r2), 6) FROM v GROUP BY ALL""")
def model_job_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model-building job with two targets, one of which a quarter of the items lacks, an external set and averaged refits (MET15, AGG16, SRC9, SNK9)."""
    orders = table(spark, sf_dir, "orders").select("*", (F.col("o_totalprice") + F.col("o_custkey") % 100 * 1000.0).alias("cost"), F.when(F.col("o_custkey") % 4 > 0, 2.0 * F.col("o_totalprice") - F.col("o_custkey") % 50 * 3000.0).alias("load"))
    orders = orders.where("o_custkey is not null")
    finished = _scratch(spark, "finished")
    orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("code"), "o_totalprice", "cost", "load").write.parquet(finished)
    settings = {
        "dataset": {"tasks": ["cost", "load"], "descriptors": ["o_totalprice"], "id_field": "o_orderkey"},
        "train_test_split": {"split_method": "random", "n_splits": 2, "frac_test": 0.25},
        "train_val_split": {"split_method": "random", "n_splits": 1, "frac_test": 0.25},
        "training": {"model_fn_str": "ridge", "calculate_ensemble_performance": True, "n_cpus": 4},
        "hyperparams": {"regParam": [1e15, 0.0]},
        "ext_datasets": {"finished": {"dataset_file": finished, "id_field": "code"}},
    }
    found = jobs.run_models(orders, settings, _scratch(spark, "model-targets"), seed=7)
    return found.where(F.col("metric").isin("rmsd", "mae", "r2")).select("task", "dataset", "metric", F.when(F.col("metric") == "r2", F.round("mean", 6)).otherwise(F.round("mean", 2)).alias("mean"))


@query("""WITH m AS (SELECT * FROM orders WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_custkey IS NOT NULL)
SELECT 'training' AS part, count(*) AS n, CAST(round(sum(o_totalprice), 0) AS BIGINT) AS total FROM m UNION ALL SELECT 'check', 2 * CAST(ceil(round(count(*) * 0.25::DOUBLE, 9)) AS BIGINT), 0 FROM m""")
def packaged_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's models packaged and read back: training rows under public names, and how many check rows the package's models reproduce (MOD15, SNK13, SNK14)."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey is not null and o_totalprice is not null and o_custkey is not null")
    orders = orders.select("o_orderkey", "o_totalprice", (F.col("o_totalprice") + F.col("o_custkey") % 100 * 1000.0).alias("y"))
    settings = {
        "dataset": {"tasks": ["y"], "descriptors": ["o_totalprice"], "id_field": "o_orderkey"},
        "train_test_split": {"split_method": "random", "n_splits": 2, "frac_test": 0.25},
        "train_val_split": {"split_method": "random", "n_splits": 1, "frac_test": 0.25},
        "training": {"model_fn_str": "ridge"},
        "hyperparams": {"alpha": [1.0]},
    }
    here = _scratch(spark, "packaged")
    jobs.run_models(orders, settings, f"{here}/job", seed=7)
    packaging.package(orders, f"{here}/job", f"{here}/package", {"o_orderkey": "code", "o_totalprice": "price"})
    packaging.checked_package(spark, f"{here}/package")
    training = packaged_training_data(spark, f"{here}/package/training").agg(F.lit("training").alias("part"), F.count("code").alias("n"), F.round(F.sum("price")).cast("long").alias("total"))
    again = packaging.reproduced(spark, f"{here}/package", orders).where("largest_diff < 1e-6").agg(F.lit("check").alias("part"), F.sum("n").alias("n"), F.lit(0).cast("long").alias("total"))
    return training.unionByName(again)


@query(f"""WITH {PAIRS}, m AS (SELECT unnest(['a', 'b', 'c']) AS member, unnest([0.5::DOUBLE, 0.75::DOUBLE, 1.0::DOUBLE]) AS w), p AS (SELECT id, (q * w + 1.0::DOUBLE) * 100.0::DOUBLE + 7.0::DOUBLE AS pred FROM pairs, m)
SELECT id, round(avg(pred), 4) AS mean, round(stddev_pop(pred), 4) AS spread FROM p GROUP BY ALL""")
def ensemble_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear members over features made once, unscaled, then averaged (MOD13)."""
    members = spark.createDataFrame([(n, [w], 1.0, 7.0, 100.0) for n, w in (("a", 0.5), ("b", 0.75), ("c", 1.0))], "member string, weights array<double>, intercept double, y_mean double, y_sd double")
    found = ensemble.linear_members(_pairs(spark, sf_dir).select("id", F.array("q").alias("x")), members)
    return ensemble.mean_and_spread(found).select("id", F.round("mean", 4).alias("mean"), F.round("spread", 4).alias("spread"))


# ---- streams


def _replay(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = table(spark, sf_dir, name)
    return streams.arriving(spark, f"{sf_dir}/{name}*.parquet", source.schema)


@query("SELECT 'value' AS value_name, CAST(floor(value / 1.0::DOUBLE) AS BIGINT) AS bin_idx, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL")
def stream_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, each batch's profile merged into a store once (STR2, STR3)."""
    here = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    streams.profile_stream(_replay(spark, sf_dir, "events"), {"value": 1}, f"{here}/store", f"{here}/checkpoint", "events").awaitTermination()
    return streams.stored_profile(spark, f"{here}/store")


@query(SCORING_JOB)
def scoring_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring job on parts as they arrive, begun a second time after its end; totals as of the job over all parts (STR1)."""
    here = _scratch(spark, "scoring-stream")
    parts = _replay(spark, sf_dir, "part").withColumn("id", F.col("p_partkey").cast("string"))
    for _ in range(2):
        streams.scoring_stream(parts, _scoring_job(), here, f"{here}/checkpoint", "parts").awaitTermination()
    return _job_totals(spark, here)


@query(f"{STOPS} SELECT run, stop_epoch FROM stops WHERE stop_epoch IS NOT NULL")
def early_stop_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early stops decided while epochs arrive out of order, with state by run (WIN6, UDF7)."""
    here = _scratch(spark, "epochs")
    _epochs(spark, sf_dir).repartition(3, F.xxhash64("run", "epoch")).write.parquet(f"{here}/epochs")
    written = spark.read.parquet(f"{here}/epochs")
    epochs = streams.arriving(spark, f"{here}/epochs", written.schema, -(-len(written.inputFiles()) // 3))  # three batches
    write_stops(stopping_stream(epochs, 30, 3, 0.5), f"{here}/stops", f"{here}/checkpoint").awaitTermination()
    return spark.read.schema("run long, stop_epoch int").parquet(f"{here}/stops")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000000 AS start, CAST(floor(value / 50.0::DOUBLE) AS BIGINT) AS bin_idx, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL")
def stream_windowed_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile for each day of event time, each window written once, when the watermark has passed it (STR4).

    A replay ends, so a row a month after the last event closes the windows; its own window stays open.
    """
    here = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    events.agg(F.max("ts").alias("ts")).where("ts is not null").select((F.col("ts").cast("timestamp") + F.expr("interval 30 days")).alias("ts"), F.lit(0.0).alias("value")).write.parquet(f"{here}/end")
    rows = _replay(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    rows = rows.unionByName(streams.arriving(spark, f"{here}/end", spark.read.parquet(f"{here}/end").schema))
    windows = streams.windowed_histogram(rows, "ts", "value", 50, "1 day", "1 day")
    windows.writeStream.format("parquet").outputMode("append").option("path", f"{here}/windows").option("checkpointLocation", f"{here}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(windows.schema).parquet(f"{here}/windows").select(F.unix_timestamp("start").alias("start"), "bin_idx", "n")


# ---- round trips: written and read again


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_type AS structure FROM part")
def scored_csv_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows written as gzipped ';' CSV and scanned again (SNK1, SRC1)."""
    path = _scratch(spark, "scored")
    write_scored(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string"), F.col("p_type").alias("structure")), path, "csv")
    return read_column(spark, path, "structure", ";", ("p_partkey",)).select("p_partkey", "structure")


@query(f"WITH {PAIRS} SELECT id, CAST(floor(id / 8) AS BIGINT) % 3 AS resample, model AS data_split, p AS prediction FROM pairs UNION ALL SELECT id, 7, 'again', t FROM pairs WHERE task = 'O'")
def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions appended to a log twice, by resample and split (SNK8, SNK9)."""
    path, pairs = _scratch(spark, "log"), _pairs(spark, sf_dir)
    append_predictions(pairs.select("id", (F.floor(F.col("id") / 8) % 3).alias("resample"), F.col("model").alias("data_split"), F.col("p").alias("prediction")), path)
    append_predictions(pairs.where("task = 'O'").select("id", F.lit(7).cast("long").alias("resample"), F.lit("again").alias("data_split"), F.col("t").alias("prediction")), path)
    return spark.read.parquet(path).select("id", F.col("resample").cast("long").alias("resample"), "data_split", "prediction")


@query("SELECT row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS line_no, CAST(o_orderkey AS VARCHAR) AS structure FROM orders WHERE o_orderstatus IS NOT NULL QUALIFY line_no >= 100")
def file_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows [100, end) of token files of unequal size, numbered in the order of the files (SRC2, SRC4, ID1)."""
    path, orders = _scratch(spark, "tokens"), table(spark, sf_dir, "orders").where("o_orderstatus is not null")
    orders.repartition("o_orderstatus").sortWithinPartitions("o_orderstatus", "o_orderkey").select("o_orderstatus", F.col("o_orderkey").cast("string")).write.partitionBy("o_orderstatus").text(path)
    return row_range(numbered(read_tokens(spark, path)), 100).select("line_no", "structure")


@query("SELECT 100000 + l_partkey AS part, l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber FROM lineitem")
def renamed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under the ids of another naming (JN10)."""
    mapping = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") + 100000).alias("part"))
    return rows.renamed_ids(table(spark, sf_dir, "lineitem"), mapping, "l_partkey", "part").select(F.col("l_partkey").alias("part"), "l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"))


@query("SELECT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def common_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in both tables (SET2)."""
    return rows.common_ids(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")))


@query("SELECT 'q' AS value_name, bin_idx FROM (SELECT CAST(floor(l_extendedprice / 100.0::DOUBLE) AS BIGINT) AS bin_idx FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT CAST(floor(l_extendedprice / 100.0::DOUBLE) AS BIGINT) FROM lineitem WHERE l_returnflag = 'A')")
def bins_of_one_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of one profile that another lacks (SET3)."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("q"))
    return profile.bins_lacking(*[profile.histogram(li.where(F.col("l_returnflag") == f), {"q": 100}) for f in "RA"])


@query("SELECT coalesce(a.id, b.id) AS id, a.n AS orders_n, b.balance AS customer_balance FROM (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY ALL) a FULL JOIN (SELECT c_custkey AS id, round(c_acctbal, 2) AS balance FROM customer) b ON a.id = b.id")
def orders_beside_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keyed tables side by side (SET5)."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return rows.side_by_side({"orders": counts, "customer": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round("c_acctbal", 2).alias("balance"))})


# the registered round trips of sources, sinks and run tables
from millrace.plans import catalog_io  # noqa: E402, F401
