"""Registered queries of sources, sinks and run tables, and their SQL: written, read again and compared (SRC, SNK, FIL, AGG, SPL13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalar
from millrace.functions.vectors import mean_of, square_sum
from millrace.operators import metrics, rows, search
from millrace.plans.catalog import GRID, MEMBERS, PAIRS, SPACE, _members, _pairs, _scratch, _work, query, six, table
from millrace.plans.spec import chosen_outputs
from millrace.sources import readers, writers
from millrace.sources.stores import manifest


def _csv(spark: SparkSession, sf_dir: str, path: str, where: str = "true", sep: str = ",") -> str:
    parts = table(spark, sf_dir, "part").where(where).select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("mark"), "p_size", "p_retailprice")
    parts.write.option("header", True).option("sep", sep).csv(path)
    return path


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS structure, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, CAST(p_size AS DOUBLE) AS again, 2.0::DOUBLE AS w FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_brand, NULL, NULL, CAST(p_size AS DOUBLE), NULL FROM part""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training set with targets, an extra column that is a target as well, and weights; then without targets (SRC7, SRC8)."""
    path = _csv(spark, sf_dir, _scratch(spark, "training"))
    both = readers.training_set(spark, path, "code", "mark", ["p_size", "p_retailprice"], ["p_size"], weight=2.0)
    none = readers.training_set(spark, path, "code", "mark", [], ["p_size"])
    told = both.select("id", "structure", F.col("y.p_size").alias("size"), F.col("y.p_retailprice").alias("price"), F.col("x.p_size").alias("again"), "w")
    missing = F.lit(None).cast("double")
    return told.unionByName(none.select("id", "structure", missing.alias("size"), missing.alias("price"), F.col("x.p_size").alias("again"), "w"))


@query("SELECT 'small' AS dataset, CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS DOUBLE) AS size FROM part WHERE p_size <= 10 UNION ALL SELECT 'large', CAST(p_partkey AS VARCHAR), p_retailprice FROM part WHERE p_size > 40")
def external_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two named external sets, of which one takes the main set's settings and one has a target of its own (SRC9)."""
    main = {"id_field": "code", "feature_field": "mark", "tasks": ["p_size"]}
    small, large = (_csv(spark, sf_dir, _scratch(spark, "external"), w) for w in ("p_size <= 10", "p_size > 40"))
    found = readers.external_sets(spark, main, {"small": {"dataset_file": small}})
    other = readers.external_sets(spark, main, {"large": {"dataset_file": large, "tasks": ["p_retailprice"]}})
    return found.select("dataset", "id", F.col("y.p_size").alias("size")).unionByName(other.select("dataset", "id", F.col("y.p_retailprice").alias("size")))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, 'paid' AS first, 'price' AS second, CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS value FROM orders WHERE o_totalprice IS NOT NULL
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'paid', 'by', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey IS NOT NULL UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'state', 'now', o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL""")
def two_header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with two header rows, the upper one going on over empty cells, as long rows (SRC10)."""
    path = _scratch(spark, "two-headers")
    cells = [F.col("o_orderkey"), F.round("o_totalprice").cast("long"), F.col("o_custkey"), F.col("o_orderstatus")]
    lines = table(spark, sf_dir, "orders").select(F.concat_ws(";", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]).alias("value"))
    head = spark.createDataFrame([(";paid;;state\nid;price;by;now",)], "value string")
    head.coalesce(1).unionByName(lines).write.text(path)  # the headers' file is the first
    return readers.two_header_table(spark, path)


@query("SELECT o_orderpriority AS flag, CAST(min(o_orderkey) AS VARCHAR) AS pattern FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL")
def flag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag-definition file read again by place, whatever its columns are called (SRC12)."""
    path = _scratch(spark, "flags")
    table(spark, sf_dir, "orders").where("o_orderpriority is not null").groupBy(F.col("o_orderpriority").alias("name")).agg(F.min("o_orderkey").alias("smarts")).coalesce(1).write.option("header", True).csv(path)
    return readers.flag_table(spark, path)


@query("SELECT o_comment_first AS structure, count(*) AS n FROM (SELECT CAST(o_custkey AS VARCHAR) AS o_comment_first FROM orders WHERE o_custkey IS NOT NULL) GROUP BY ALL")
def gzip_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First tokens of gzipped text files, chosen by their ending and dealt out after reading (SRC2, SRC3)."""
    path = f"{_scratch(spark, 'gzip')}.txt.gz"
    table(spark, sf_dir, "orders").where("o_custkey is not null").select(F.concat_ws(" ", F.col("o_custkey").cast("string"), F.lit("rest of it"))).write.option("compression", "gzip").text(path)
    return readers.read_items(spark, path, spread=4).groupBy("structure").agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS} SELECT CAST(id % 3 AS INTEGER) AS resample, id, CASE WHEN q > 25 THEN 'train' ELSE 'test' END AS split FROM pairs")
def split_table_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split table written by resample and read again (SNK7)."""
    path = _scratch(spark, "split-table")
    writers.write_splits(_pairs(spark, sf_dir).select((F.col("id") % 3).cast("int").alias("resample"), "id", F.when(F.col("q") > 25, "train").otherwise("test").alias("split")), path)
    return spark.read.parquet(path).select("resample", "id", "split")


@query(f"WITH {PAIRS}, u AS (SELECT task AS dataset, model AS metric, round(avg(p - t), 4) AS mean FROM pairs GROUP BY ALL) SELECT dataset, metric, mean FROM u UNION ALL SELECT 'runs', model, CAST(count(*) AS DOUBLE) FROM pairs GROUP BY ALL")
def exported_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average performance as one CSV, and a run log to which each model adds its row (SNK10, SNK11)."""
    pairs, path, log = _pairs(spark, sf_dir), _scratch(spark, "performance"), _scratch(spark, "run-log")
    writers.export_performance(pairs.groupBy(F.col("task").alias("dataset"), F.col("model").alias("metric")).agg(F.round(F.avg(F.col("p") - F.col("t")), 4).alias("mean")), path)
    counted = pairs.groupBy("model").agg(F.count("*").alias("n"))
    for part in (counted.where("model <= 'N'"), counted.where("model > 'N'")):
        writers.append_run_log(part, log)
    again = spark.read.option("header", True).csv(path).select("dataset", "metric", F.col("mean").cast("double").alias("mean"))
    return again.unionByName(spark.read.parquet(log).select(F.lit("runs").alias("dataset"), F.col("model").alias("metric"), F.col("n").cast("double").alias("mean")))


@query("""WITH e AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value FROM events WHERE value IS NOT NULL)
SELECT run, CAST(epoch AS INTEGER) AS epoch, round(max(value) FILTER (epoch % 2 = 1), 6) AS train_loss, round(max(value) FILTER (epoch % 2 = 0), 6) AS val_loss FROM e GROUP BY ALL""")
def epoch_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch statistics with a column for each split and metric, epochs from 1 (SNK12)."""
    from millrace.plans.catalog import _epochs

    long = _epochs(spark, sf_dir).select("run", (F.col("epoch") - 1).alias("epoch"), F.when(F.col("epoch") % 2 == 1, "train").otherwise("val").alias("split"), F.lit("loss").alias("metric"), F.col("loss").alias("value"))
    wide = writers.epoch_table(long, ["train loss", "val loss"])
    return wide.select("run", F.col("Epoch").cast("int").alias("epoch"), six(F.col("train loss")).alias("train_loss"), six(F.col("val loss")).alias("val_loss"))


@query("SELECT p_partkey AS code, p_brand AS mark, hex(encode(p_brand)) AS bits FROM part")
def package_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packaged training data under public names, a binary fingerprint as text and back (SNK13, SRC13)."""
    path = _scratch(spark, "package")
    parts = table(spark, sf_dir, "part").withColumn("print", F.encode("p_brand", "UTF-8"))
    writers.package_training_data(parts, path, {"p_partkey": "code", "p_brand": "mark", "print": "bits"}, "print")
    return readers.packaged_training_data(spark, path, "bits").select("code", "mark", F.hex("bits").alias("bits"))


@query("SELECT o_orderstatus AS name, md5(string_agg(CAST(o_orderkey AS VARCHAR) || chr(10), '' ORDER BY o_orderkey)) AS md5, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + 1) AS BIGINT) AS length FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY ALL")
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of written files, computed where they are read (SNK14)."""
    path, orders = _scratch(spark, "manifest"), table(spark, sf_dir, "orders").where("o_orderstatus is not null")
    orders.repartition("o_orderstatus").sortWithinPartitions("o_orderstatus", "o_orderkey").select("o_orderstatus", F.col("o_orderkey").cast("string")).write.partitionBy("o_orderstatus").text(path)
    return manifest(spark, path, "*.txt").select(F.regexp_extract("path", "o_orderstatus=([^/]*)/", 1).alias("name"), "md5", "length")


@query(f"WITH {GRID}, d AS (SELECT resample, grid.*, row_number() OVER (PARTITION BY resample ORDER BY md5(CAST(7 + resample AS VARCHAR) || ':' || CAST(model_number AS VARCHAR)), model_number) AS r FROM grid, (SELECT unnest(range(0, 3)) AS resample)) SELECT CAST(resample AS INTEGER) AS resample, model_number, trees, depth, leaf FROM d WHERE r <= 5")
def sampled_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five combinations drawn for each resample, the seed shifted by it (SPL13)."""
    grid, out = search.grid(spark, SPACE), None
    for r in range(3):
        one = search.sampled_grid(grid, 5, 7, r).select(F.lit(r).alias("resample"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {GRID}, kept AS (SELECT * FROM work WHERE NOT (resample % 2 = 0 AND model_number = 3 AND cv_fold = (SELECT min(o_orderpriority) FROM orders))), f AS (SELECT resample, cv_fold, count(DISTINCT model_number) AS m FROM kept GROUP BY ALL)
SELECT CAST(resample AS INTEGER) AS resample FROM f GROUP BY resample HAVING min(m) = 12 AND count(*) = (SELECT count(DISTINCT o_orderpriority) FROM orders)""")
def complete_resamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resamples of which every fold has every model (AGG11)."""
    work, orders = _work(spark, sf_dir), table(spark, sf_dir, "orders")
    first, n = orders.agg(F.min("o_orderpriority"), F.count_distinct("o_orderpriority")).first()
    return search.complete_resamples(work.where(~((F.col("resample") % 2 == 0) & (F.col("model_number") == 3) & (F.col("cv_fold") == F.lit(first)))), n, 12)


@query("""WITH e AS (SELECT user_id % 7 AS resample, user_id, count(*) AS epochs FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT CAST(resample AS BIGINT) AS resample, CAST(floor(avg(epochs) + 0.5::DOUBLE) AS INTEGER) AS epochs FROM e GROUP BY ALL""")
def mean_stop_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded mean of the stopping epochs by resample (AGG12)."""
    log = table(spark, sf_dir, "events").where("value is not null").groupBy((F.col("user_id") % 7).cast("long").alias("resample"), "user_id").agg(F.count("*").alias("epochs"))
    return search.mean_epochs(log)


@query(f"WITH {PAIRS} SELECT 'tasks' AS what, CAST(count(DISTINCT task) AS DOUBLE) AS value FROM pairs UNION ALL SELECT 'largest', CAST(max(v) AS DOUBLE) FROM (SELECT max(l_quantity) AS v FROM lineitem UNION ALL SELECT max(p_size) FROM part)")
def task_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tasks, and a maximum over several sets (AGG21, AGG22)."""
    counted = search.class_counts(_pairs(spark, sf_dir), "task").select(F.lit("tasks").alias("what"), F.col("n_classes").cast("double").alias("value"))
    most = search.largest_over([table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("v")), table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("v"))], "v")
    return counted.unionByName(most.select(F.lit("largest").alias("what"), F.col("v").alias("value")))


@query("SELECT p_partkey, try_cast(split_part(p_name, ' ', 1) AS DOUBLE) AS number, try_cast(CAST(p_size AS VARCHAR) || '.50' AS DOUBLE) AS half, CAST(try_cast(CAST(p_size AS VARCHAR) AS DOUBLE) AS VARCHAR) = CAST(CAST(p_size AS DOUBLE) AS VARCHAR) AS same FROM part WHERE p_size IS NOT NULL AND p_name IS NOT NULL")
def typed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text as numbers where it is one, and in one form for comparison (FN8, FN9)."""
    part = table(spark, sf_dir, "part").where("p_size is not null and p_name is not null")
    size = F.col("p_size").cast("string")
    return part.select("p_partkey", scalar.number_column(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("number"), scalar.number_column(F.concat(size, F.lit(".50"))).alias("half"), (scalar.canonical_number(size) == scalar.canonical_number(F.concat(size, F.lit(".0")))).alias("same"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS squares, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS mean FROM embeddings WHERE embedding IS NOT NULL")
def vector_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-wise vector arithmetic (FN13)."""
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", six(square_sum(F.col("embedding"))).alias("squares"), six(mean_of(F.col("embedding"))).alias("mean"))


@query(f"WITH {MEMBERS}, s AS (SELECT id, CASE WHEN (id + member) % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM members WHERE member <= 2) SELECT DISTINCT id FROM s WHERE split <> 'test'")
def rows_to_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that any fold uses otherwise than as test (FIL5)."""
    split = F.when((F.col("id") + F.col("member")) % 3 == 0, "test").otherwise("train")
    return rows.usable_ids(_members(spark, sf_dir, 2).select("id", split.alias("split")))


@query("SELECT p_partkey, p_size * 2 AS twice, p_size + 1 AS more FROM part")
def chosen_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output columns by name: unknown ones are ignored, an empty list is all (FIL7)."""
    registry = {"more": F.col("p_size") + 1, "twice": F.col("p_size") * 2}
    if chosen_outputs([], registry) != ["more", "twice"] or chosen_outputs(None, registry):
        raise ValueError("an empty list is all outputs, None is none")
    return table(spark, sf_dir, "part").select("p_partkey", *[registry[n].alias(n) for n in chosen_outputs(["twice", "other", "more"], registry)])


@query(f"WITH {PAIRS}, m AS (SELECT task, avg(abs(p - t)) AS v FROM pairs GROUP BY ALL) SELECT task, round(v, 3) AS mae FROM m")
def rounded_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric of the caller's, rounded to three places in the aggregation (FN6, UDF3)."""
    found = metrics.evaluated(_pairs(spark, sf_dir), ["task"], {"mae": F.avg(F.abs(F.col("p") - F.col("t")))}, 3)
    return found.select("task", F.col("value").alias("mae"))
