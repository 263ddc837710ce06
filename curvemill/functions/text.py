"""Number, duration and axis labels, and shortened names, as column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from curvemill.schema import RELTIME, STEP


@F.pandas_udf(StringType())
def exact_fixed(value: pd.Series, digits: pd.Series) -> pd.Series:
    """Fixed-point text, rounding the exact binary value with ties to even, which the JVM's formatter does not do. For labels."""
    return pd.Series([None if pd.isna(v) else f"{v:.{d}f}" for v, d in zip(value, digits)], dtype=object)


@F.pandas_udf(StringType())
def exact_scientific(value: pd.Series) -> pd.Series:
    """Three decimals and a bare exponent: 1.235e5, 1.000e-4."""

    def one(v: float) -> str:
        mantissa, exponent = f"{v:.3e}".split("e")
        return f"{mantissa}e{int(exponent)}"

    return pd.Series([None if pd.isna(v) else one(v) for v in value], dtype=object)


def number(v: Column) -> Column:
    """Short text of a number: scientific outside [0.001, 100000), one decimal from 100 on, else four without trailing zeros."""
    size = F.abs(v)
    finite = F.when(~F.isnan(v) & (size != float("inf")), v)
    four = F.regexp_replace(F.regexp_replace(exact_fixed(finite, F.lit(4)), "0+$", ""), r"\.$", "")
    return (
        F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
        .when((size != 0) & ((size < 1e-3) | (size >= 1e5)), exact_scientific(finite))
        .when(size >= 100, exact_fixed(finite, F.lit(1)))
        .otherwise(F.when(four.isin("", "-"), "0").otherwise(four))
    )


def duration(seconds: Column) -> Column:
    """Short text of a time span: seconds, minutes and seconds, hours and minutes below 48 hours, else days and hours."""
    s = F.greatest(seconds, F.lit(0.0))
    total = F.floor(s).cast("long")
    minutes, hours = F.floor(total / 60), F.floor(total / 3600)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return (
        F.when(s < 60, F.concat(F.bround(s, 0).cast("long").cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"), two(total % 60), F.lit("s")))
        .when(hours < 48, F.concat(hours.cast("string"), F.lit("h"), two(minutes % 60), F.lit("m")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d"), two(hours % 24), F.lit("h")))
    )


def count(n: Column) -> Column:
    """Short text of a count: digits below 10,000, thousands below a million, else millions with one decimal."""
    return (
        F.when(n >= 1_000_000, F.concat(exact_fixed(n / 1e6, F.lit(1)), F.lit("M")))
        .when(n >= 10_000, F.concat(F.bround(n / 1e3, 0).cast("long").cast("string"), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def x_value(x: Column, mode: str) -> Column:
    """Label of an x value: a count of steps, a time span, or the UTC time of day."""
    if mode == STEP:
        return count(F.greatest(F.round(x), F.lit(0.0)).cast("long"))
    if mode == RELTIME:
        return duration(x)
    second = F.pmod(F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long"), F.lit(86_400))
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(second / 3600)), two(F.floor(second / 60) % 60), two(second % 60))


def elide(label: Column, width: int) -> Column:
    """The label in at most width characters: the middle gives way to an ellipsis, the head keeps the odd character."""
    if width <= 0:
        return F.lit("")
    if width == 1:
        return F.when(F.char_length(label) <= 1, label).otherwise(F.lit("…"))
    head, tail = width // 2, (width - 1) // 2
    cut = F.concat(F.left(label, F.lit(head)), F.lit("…"), F.right(label, F.lit(tail)) if tail else F.lit(""))
    return F.when(F.char_length(label) <= width, label).otherwise(cut)


def labels(counts: list[int]) -> list[str]:
    """The text of ``count`` for a few numbers on the driver."""
    return [f"{n / 1e6:.1f}M" if n >= 1_000_000 else f"{round(n / 1e3)}k" if n >= 10_000 else str(n) for n in counts]


def shortened(label: str, width: int) -> str:
    """What ``elide`` makes of one label."""
    if len(label) <= width or width <= 0:
        return label if width > 0 else ""
    return label[: width // 2] + "…" + (label[-((width - 1) // 2) :] if width > 2 else "") if width > 1 else "…"
