"""Scalar column functions (FN1-FN12, FN15)."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def class_label(code: Column, labels: dict[int, str] | None = None) -> Column:
    """2, 1, 0 as High, Medium, Low (or the given labels); other values as their own text (FN1)."""
    labels = labels or {2: "High", 1: "Medium", 0: "Low"}
    out = code.cast("string")
    for k, v in labels.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def additive_score(a: Column, b: Column) -> Column:
    """Sum of a count and a score (FN3)."""
    return a + b


def desirability(potency: Column, penalty: Column, centre: float = 8.0) -> Column:
    """-p / (1 + exp(s - centre)) (FN4, FN15)."""
    return -potency * (F.lit(1.0) / (F.lit(1.0) + F.exp(penalty - F.lit(centre))))


def round_half_up(v: Column, places: int | None) -> Column:
    """Half always goes up, also below zero; None leaves the value (FN5)."""
    if places is None:
        return v
    scale = F.lit(float(10**places))
    return F.floor(v * scale + F.lit(0.5)).cast("double") / scale


def round_half_even(v: Column, places: int = 3) -> Column:
    """Half goes to the even digit (FN6)."""
    return F.bround(v, places)


def decimals(width: str | float) -> int:
    """Number of decimals that a width is written with."""
    return max(0, -Decimal(str(width)).normalize().as_tuple().exponent) if "." in str(width) else 0


def bin_index(value: Column, width: str | float) -> Column:
    """Number of the fixed-width bin: floor(value / width) (AGG1). Null for null and NaN."""
    return F.floor(F.when(~F.isnan(value.cast("double")), value.cast("double")) / F.lit(float(width))).cast("long")


def bin_edge(index: Column, width: str | float) -> Column:
    """Lower edge of a bin, rounded to the width's own decimals (FN7)."""
    return F.round(index * F.lit(float(width)), decimals(width))


def number_of(text: str) -> int | float:
    """A setting's text as int, or as float where it has a point (FN8)."""
    return float(text) if "." in text else int(text)


def number_column(text: Column) -> Column:
    """Text as double where possible, else null (FN8)."""
    return text.try_cast("double")


def typed_value(text: str):
    """A setting's text as bool, int, float or None where it reads as one, else the text (FN9). Nothing is evaluated."""
    named = {"true": True, "false": False, "none": None, "null": None}
    if text.lower() in named:
        return named[text.lower()]
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        return float(text)
    return text


def canonical_number(text: Column) -> Column:
    """Text in one form for comparison: numbers as doubles, other texts as they are (FN9)."""
    return F.coalesce(text.try_cast("double").cast("string"), text)


def clean_name(text: Column) -> Column:
    """Trimmed, each run of other characters than letters, digits and '_' as one '_' (FN10)."""
    return F.regexp_replace(F.trim(text), r"[^A-Za-z0-9_]+", "_")


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with fractions (FN11)."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def one_of_k(value: Column, levels: list, unknown: bool = False) -> Column:
    """0/1 array over levels (FN12). An unknown value is an error, or falls to the last level if unknown is set."""
    chosen = F.when(value.isin(*levels), value).otherwise(F.lit(levels[-1])) if unknown else value
    marks = F.array(*[F.coalesce((chosen == F.lit(x)).cast("int"), F.lit(0)) for x in levels])
    if unknown:
        return marks
    return F.when(F.coalesce(value.isin(*levels), F.lit(False)), marks).otherwise(F.raise_error(F.concat(F.lit("unknown level "), F.coalesce(value.cast("string"), F.lit("null")))).cast("array<int>"))
