"""Mergeable histograms and counters, overall and per non-exclusive flag (AGG1-AGG6, AGG25, JN6, JN8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.functions.ranking import exploded_range
from millrace.functions.scalar import bin_edge, bin_index


def histogram(rows: DataFrame, widths: dict[str, str | float], carry: tuple[str, ...] = ()) -> DataFrame:
    """value_name, bin_idx, n (and carry) of several columns in one pass; null and NaN count nowhere (AGG1, AGG2)."""
    missing = [c for c in widths if c not in rows.columns]
    if missing:
        raise ValueError(f"cannot profile {missing}: no such columns")
    binned = rows.select(*carry, *[bin_index(F.col(c), w).alias(c) for c, w in widths.items()])
    long = binned.unpivot(list(carry), list(widths), "value_name", "bin_idx").where("bin_idx is not null")
    return long.groupBy(*carry, "value_name", "bin_idx").agg(F.count("*").alias("n"))


def with_flags(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """A row for each flag that a row has, under the column flag (JN6 long form); null is not set."""
    marks = F.array(*[F.when(c, F.lit(name)) for name, c in flags.items()])
    return rows.withColumn("flag", F.explode(F.array_compact(marks)))


def pattern_flags(text: str, patterns: list[tuple[str, str]]) -> dict[str, Column]:
    """A regular expression for each flag."""
    return {name: F.col(text).rlike(pattern) for name, pattern in patterns}


def matching_patterns(rows: DataFrame, text: str, patterns: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """(key, flag) of every row and pattern that match (JN6). patterns (flag, pattern) are broadcast, most at most."""
    if patterns.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} patterns")
    return rows.select(key, text).join(F.broadcast(patterns), F.expr(f"`{text}` rlike pattern")).select(key, "flag")


def histogram_by_flag(rows: DataFrame, widths: dict[str, str | float], flags: dict[str, Column]) -> DataFrame:
    """value_name, flag, bin_idx, n; a row counts under each of its flags (AGG5)."""
    return histogram(with_flags(rows, flags), widths, ("flag",))


def merge(*profiles: DataFrame, measure: str = "n") -> DataFrame:
    """Sum of profiles or counters; what one lacks counts as 0 there (AGG3, JN8, SET1)."""
    out = profiles[0]
    for p in profiles[1:]:
        out = out.unionByName(p)
    return out.groupBy(*[c for c in out.columns if c != measure]).agg(F.sum(measure).alias(measure))


#: Bins that gaps are filled over, at most.
MAX_BINS = 100_000_000


def gap_filled(profile: DataFrame, flags: list[str] | None = None) -> DataFrame:
    """Every bin from lowest to highest, missing ones with 0 (AGG4).

    With flags, one range for all flags of a value, and zeros for flags without a hit (AGG5). A span
    of more than MAX_BINS bins, as a stray value makes, is an error.
    """
    spans = profile.groupBy("value_name").agg(F.min("bin_idx").alias("lo"), F.max("bin_idx").alias("hi"))
    # compared as doubles: the difference of two longs may not fit into one
    narrow = F.col("hi").cast("double") - F.col("lo").cast("double") < MAX_BINS
    spans = spans.where(F.assert_true(narrow, F.concat(F.lit(f"more than {MAX_BINS} bins: "), "value_name")).isNull())
    bins = exploded_range(spans, F.col("lo"), F.col("hi"), "bin_idx").select("value_name", "bin_idx")
    keys = ["value_name", "bin_idx"]
    if flags is not None:
        bins = bins.withColumn("flag", F.explode(F.array(*[F.lit(f) for f in flags])))
        keys = ["value_name", "flag", "bin_idx"]
    return bins.select(*keys).join(profile, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))


def with_edges(profile: DataFrame, widths: dict[str, str | float]) -> DataFrame:
    """profile with the printed lower edge of each bin (FN7)."""
    edge = F.lit(None).cast("double")
    for name, width in widths.items():
        edge = F.when(F.col("value_name") == name, bin_edge(F.col("bin_idx"), width)).otherwise(edge)
    return profile.withColumn("edge", edge)


def pivoted(profile: DataFrame, flags: list[str]) -> DataFrame:
    """A column for each flag, 0 where it has no row (SNK5)."""
    return profile.groupBy("value_name", "bin_idx").pivot("flag", flags).agg(F.sum("n")).na.fill(0)


def counters(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """counter, n: rows that meet each condition, in one pass; null doesn't meet (AGG6)."""
    one = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()])
    return one.unpivot([], list(rules), "counter", "n")


def observed(rows: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """rows whose action also gives the measures, as a run's summary (AGG25, FN11)."""
    observation = Observation(name)
    return rows.observe(observation, *[m.alias(k) for k, m in measures.items()]), observation


def counters_table(spark: SparkSession, values: dict[str, int]) -> DataFrame:
    """Counters that a driver holds as a table, to merge with stored ones."""
    return spark.createDataFrame(list(values.items()), "counter string, n long")


def bins_lacking(profile: DataFrame, other: DataFrame) -> DataFrame:
    """value_name, bin_idx of the bins of profile that other has no row for (SET3)."""
    keys = ["value_name", "bin_idx"]
    return profile.select(*keys).distinct().join(other.select(*keys), keys, "left_anti")
