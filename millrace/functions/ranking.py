"""Running sums and row numbers that don't pass through one task.

Rows are range-partitioned by group and order, written, and each partition's running sums get the
totals of the partitions before as an offset. A group of any size is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.stores import cut


#: Numbers that exploded_range() makes from one row at a time.
RANGE_BLOCK = 10_000


def exploded_range(rows: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """A row for each whole number from first to last, in two steps, so that a long range is dealt over tasks."""
    blocks = rows.withColumns({"_first": first.cast("long"), "_last": last.cast("long")})
    blocks = blocks.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_last") - F.col("_first")) / RANGE_BLOCK))))
    start = F.col("_first") + F.col("_block") * RANGE_BLOCK
    dealt = blocks.withColumn("_start", start).repartition("_start")
    return dealt.withColumn(name, F.explode(F.sequence("_start", F.least("_last", F.col("_start") + RANGE_BLOCK - 1)))).drop("_first", "_last", "_block", "_start")


def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on equal keys, where null equals null; the keys stand once."""
    match, renamed = F.lit(True), right
    for i, k in enumerate(on):
        renamed = renamed.withColumnRenamed(k, f"_k{i}")
        match &= left[k].eqNullSafe(F.col(f"_k{i}"))
    return left.join(renamed, match).drop(*[f"_k{i}" for i in range(len(on))])


def running_sum(rows: DataFrame, group: list[str], order: list[str], measure: str, name: str) -> DataFrame:
    """rows with the sum of measure over the rows of the group that stand before, in the order; order has to be unique in a group."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn(name, F.coalesce(F.sum(measure).over(inside), F.lit(0)))
    totals = dealt.groupBy(*group, "_part").agg(F.sum(measure).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if group else Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    match = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        match &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return local.join(offsets, match).select(*rows.columns, (F.col(name) + F.col("_offset")).alias(name))


def with_row_number(rows: DataFrame, order: list[str], name: str = "row", start: int = 0, group: list[str] = ()) -> DataFrame:
    """rows with their number in the order, within the group if given, counted from start."""
    counted = running_sum(rows.withColumn("_one", F.lit(1).cast("long")), list(group), order, "_one", name)
    return counted.drop("_one").withColumn(name, (F.col(name) + start).cast("long"))


def average_rank(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """rows with the rank of value within the group, tied values sharing their mean rank (WIN1).

    Ranks are made on distinct values with counts, so ties of any size are one row.
    """
    distinct = rows.groupBy(*group, value).agg(F.count("*").alias("_n"))
    ranked = running_sum(distinct, group, [value], "_n", "_before").select(*group, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))
    return joined(rows, ranked, [*group, value])
