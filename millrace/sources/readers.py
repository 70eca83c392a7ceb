"""Scans of item lists and training sets (SRC1-SRC14)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.ranking import with_row_number
from millrace.sources.stores import cut

#: Files of these endings are token lists; the others delimited tables with a header. A further .gz is transparent.
TOKEN_ENDINGS, TABLE_ENDINGS = (".inchi", ".smi", ".txt"), (".csv", ".tsv")


def read_column(spark: SparkSession, path: str, column: str, sep: str = ";", keep: tuple[str, ...] = ()) -> DataFrame:
    """One named column (and those to keep) of a delimited file with a header, as strings (SRC1)."""
    return spark.read.option("sep", sep).option("header", True).option("enforceSchema", False).csv(path).select(*keep, F.col(column).alias("structure"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The first space-separated token of each line of a file without header (SRC2)."""
    return spark.read.text(path).select(F.split("value", " ")[0].alias("structure"))


def read_items(spark: SparkSession, path: str, column: str = "structure", sep: str = ";", keep: tuple[str, ...] = (), spread: int | None = None) -> DataFrame:
    """Items by the file's ending, gzip or not; another ending is an error (SRC3).

    A gzip file is one task to read; spread deals its rows to so many partitions afterwards.
    """
    name = path.removesuffix(".gz")
    if name.endswith(TOKEN_ENDINGS):
        items = read_tokens(spark, path)
    elif name.endswith(TABLE_ENDINGS):
        items = read_column(spark, path, column, sep, keep)
    else:
        raise ValueError(f"unknown kind of file: {path}")
    return items.repartition(spread) if spread else items


def numbered(items: DataFrame, *order: str, start: int = 0, name: str = "line_no") -> DataFrame:
    """Items with their line number in the given order, counted from start (ID1).

    Without an order the lines of a scan are numbered file by file, in the order of the paths, and inside a
    file by block and line, however Spark deals files and blocks to tasks. Items that come from no
    file are numbered by partition.
    """
    if order:
        return with_row_number(items, list(order), name, start)
    try:
        placed = items.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    except AnalysisException:
        placed = items.select("*", F.lit("").alias("_file"), F.shiftright(F.monotonically_increasing_id(), 33).alias("_block"))
    told = cut(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    # a block is read by one task, line after line; one row a block is put in order
    blocks = told.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    line = F.col("_before") + F.col("_at") - F.col("_first") + start
    return told.join(blocks.withColumn("_before", before), ["_file", "_block"]).select(*items.columns, line.cast("long").alias(name))


def row_range(items: DataFrame, start: int, end: int = -1, name: str = "line_no") -> DataFrame:
    """Rows [start, end) by line number; an end of -1 is open (SRC4)."""
    rows = items.where(F.col(name) >= start)
    return rows if end == -1 else rows.where(F.col(name) < end)


def asserted(items: DataFrame, rule: str, message: str) -> DataFrame:
    """items; a row that breaks the rule fails the job when it is read (SRC6)."""
    return items.where(F.assert_true(F.expr(rule), message).isNull())


def training_set(spark: SparkSession, path: str, id_field: str, feature_field: str, tasks: list[str], extra: list[str] = (), sep: str = ",", weight: float = 1.0) -> DataFrame:
    """id, structure, y (struct of the tasks), x (struct of extra columns), w; a column named twice is read once (SRC7, SRC8).

    Without tasks y and w are null.
    """
    raw = spark.read.option("sep", sep).option("header", True).csv(path)
    number = lambda c: F.col(c).try_cast("double").alias(c)
    unique = lambda names: list(dict.fromkeys(names))
    y = F.struct(*[number(t) for t in unique(tasks)]) if tasks else F.lit(None).cast("struct<none:double>")
    x = F.struct(*[number(c) for c in unique(extra)]) if extra else F.lit(None).cast("struct<none:double>")
    w = F.lit(weight) if tasks else F.lit(None).cast("double")
    return raw.select(F.col(id_field).alias("id"), F.col(feature_field).alias("structure"), y.alias("y"), x.alias("x"), w.alias("w"))


def external_sets(spark: SparkSession, main: dict, sets: dict[str, dict]) -> DataFrame:
    """All named external sets, each with the main set's settings where it gives none, under the column dataset (SRC9)."""
    out = None
    for name in sets.get("_order", [k for k in sets if k != "_order"]):
        own = main | sets[name]
        one = training_set(spark, own["dataset_file"], own["id_field"], own["feature_field"], own["tasks"], own.get("extra_desc", [])).withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no external set is named")
    return out


def two_header_table(spark: SparkSession, path: str, id_name: str = "id", sep: str = ";") -> DataFrame:
    """A table with two header rows as long rows (id, first, second, value) (SRC10).

    The first column holds the id; an empty first header goes on as the one before. Of several files the
    first by path begins with the headers.
    """
    first = spark.read.text(path).agg(F.min("_metadata.file_path")).first()[0]
    lines = spark.read.text(first).limit(2).collect()
    head = [[x.strip() for x in line.value.split(sep)] for line in lines]
    top, under = head[0], head[1]
    for i in range(1, len(top)):
        top[i] = top[i] or top[i - 1]
    names = [id_name] + [f"c{i}" for i in range(1, len(under))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).option("sep", sep).csv(path)
    rows = rows.where(~(F.concat_ws(sep, *[F.coalesce(n, F.lit("")) for n in names]).isin(lines[0].value, lines[1].value)))
    long = rows.unpivot([id_name], names[1:], "column", "value").where("value is not null")
    head_rows = spark.createDataFrame([(f"c{i}", top[i], under[i]) for i in range(1, len(under))], "column string, first string, second string")
    return long.join(F.broadcast(head_rows), "column").select(id_name, "first", "second", "value")


def flag_table(spark: SparkSession, path: str) -> DataFrame:
    """flag and pattern of a definition file with two columns (SRC12)."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col(raw.columns[0]).alias("flag"), F.col(raw.columns[1]).alias("pattern"))


def packaged_training_data(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame:
    """Packaged training data, Parquet or CSV by the ending; a base64 fingerprint column becomes its bytes (SRC13)."""
    rows = spark.read.option("header", True).csv(path) if path.removesuffix(".gz").endswith(".csv") else spark.read.parquet(path)
    return rows.withColumn(fingerprint, F.unbase64(fingerprint)) if fingerprint else rows
