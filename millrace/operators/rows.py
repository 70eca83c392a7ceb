"""Validity, rule cascades, membership, IDs and expansion (FIL1-FIL6, FIL11, FIL14, ID2-ID3, EXP1-EXP3)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_and_rejects(rows: DataFrame, valid: Column, reason: str = "invalid") -> tuple[DataFrame, DataFrame]:
    """Rows that meet the rule, and the others with a reason; null doesn't meet (FIL1, SNK3). Either may be empty (FIL14)."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok).withColumn("reason", F.lit(reason))


def cascade(rows: DataFrame, rules: list[tuple[str, Column]], drop: bool = False) -> DataFrame:
    """rows with warning (codes of broken rules, ':'-joined, null if none) and pass (FIL2).

    A rule is broken where its condition is true. drop keeps the passing rows only.
    """
    codes = F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules]))
    out = rows.withColumn("warning", F.when(F.size(codes) > 0, F.array_join(codes, ":"))).withColumn("pass", F.col("warning").isNull())
    return out.where("pass") if drop else out


def partly_passed(prefix: str = "D") -> Column:
    """Passed, or only warned with a code of this prefix (FIL3)."""
    return F.col("pass") | F.coalesce(F.col("warning").startswith(prefix), F.lit(False))


def members(rows: DataFrame, ids: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """Rows whose key is (not) in ids, by a semi or anti join (FIL4)."""
    return rows.join(ids.select(key).distinct(), key, "left_semi" if inside else "left_anti")


def usable_ids(splits: DataFrame, split: str = "test") -> DataFrame:
    """IDs that any fold uses otherwise than as split (FIL5)."""
    return splits.where(F.col("split") != split).select("id").distinct()


def complete_items(predictions: DataFrame, members_expected: int, key: str = "id", value: str = "pred") -> DataFrame:
    """IDs with a value from every member (FIL6)."""
    return predictions.groupBy(key).agg(F.count(value).alias("n")).where(F.col("n") == members_expected).select(key)


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their number; none where the key is unique (FIL11, ID3)."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(rows: DataFrame, *key: str) -> DataFrame:
    """rows; raises if the key repeats (FIL11)."""
    if found := repeated_keys(rows, *key).limit(5).collect():
        raise ValueError(f"keys that repeat: {[tuple(r) for r in found]}")
    return rows


def item_id(line: Column, prefix: str = "a") -> Column:
    """<prefix>-i<line> (ID2)."""
    return F.concat(F.lit(f"{prefix}-i"), line.cast("string"))


def expanded(rows: DataFrame, variants: Column, id_column: str = "id", name: str = "variant") -> DataFrame:
    """A row for each element of variants with id <id>.s<k>, k from 0; an item without variants gives none (EXP1, JN1)."""
    out = rows.select("*", F.posexplode(variants).alias("_k", name))
    return out.withColumn(id_column, F.concat(F.col(id_column), F.lit(".s"), F.col("_k").cast("string"))).drop("_k")


def without_variants(rows: DataFrame, variants: Column) -> DataFrame:
    """Items that expanded() leaves out, for the reject table."""
    return rows.where(F.coalesce(F.size(variants), F.lit(0)) <= 0)


def variants_of(function: Callable[[str], list[str]], known_errors: tuple[type[Exception], ...] = (ValueError,)):
    """A column function that gives a caller's variants of a string, none on a known error (EXP1, EXP3, UDF6, FN2)."""

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[str]:
            try:
                return list(function(x)) if x is not None else []
            except known_errors:
                return []

        return pd.Series([one(x) for x in column], dtype=object)

    return run


def canonical(function: Callable[[str], str], known_errors: tuple[type[Exception], ...] = (ValueError,)):
    """A column function for a caller's canonical form, null on a known error (EXP3, FN2)."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return function(x) if x is not None else None
            except known_errors:
                return None

        return pd.Series([one(x) for x in column], dtype=object)

    return run


def rebalanced(rows: DataFrame, partitions: int, key: str = "id") -> DataFrame:
    """rows dealt anew, after an expansion (EXP2, FEA15)."""
    return rows.repartition(partitions, key)


def in_batches(rows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch_rows: int | None = None) -> DataFrame:
    """function over batches of rows; results must not depend on the batches (SRC5, UDF1)."""
    if batch_rows:
        rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield function(frame)

    return rows.mapInPandas(run, schema)


def features_joined(rows: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that features may hold several times: each key once there, the first by all columns (JN2)."""
    return rows.join(features.dropDuplicates([key]), key)


def renamed_ids(rows: DataFrame, mapping: DataFrame, old: str = "id", new: str = "new_id") -> DataFrame:
    """rows under the ids of another naming (JN10)."""
    return rows.join(mapping.select(old, new), old).drop(old).withColumnRenamed(new, old)


def unfinished(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that isn't done, the keys compared as text (JN5, FIL13)."""
    text = lambda rows: rows.select(*[F.col(k).cast("string").alias(f"_{k}") for k in keys])
    match = F.lit(True)
    for k in keys:
        match &= F.col(k).cast("string").eqNullSafe(F.col(f"_{k}"))
    return work.join(text(done).distinct(), match, "left_anti")


def common_ids(*tables: DataFrame, id: str = "id") -> DataFrame:
    """The ids that all tables have, each once (SET2)."""
    out = tables[0].select(id).distinct()
    for t in tables[1:]:
        out = out.join(t.select(id), id, "left_semi")
    return out


def side_by_side(tables: dict[str, DataFrame], id: str = "id") -> DataFrame:
    """The tables' columns beside each other by a unique id, named <key>_<column>; null where a table lacks the id (SET5)."""
    out = None
    for key, t in tables.items():
        named = t.select(id, *[F.col(c).alias(f"{key}_{c}") for c in t.columns if c != id])
        out = named if out is None else out.join(named, id, "full")
    return out
