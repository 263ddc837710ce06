"""Even down-sampling: of each series every ``stride``-th point by arrival, the least power of two that keeps at most ``cap``.

The stride follows from a series' length alone, so a cold read and any sequence of appends keep the same points. Where arrival numbers
are at hand (a column ``arrival_index`` stored at ingest) no window is needed at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a file, or units of a table's arrival order, that are numbered together.
CHUNK = 1 << 22


def stride_of(n: Column, cap: int) -> Column:
    """The least power of two s with ceil(n / s) <= cap; 1 if cap is 0."""
    if cap <= 0:
        return F.lit(1).cast("long")
    fits = lambda k: F.ceil(n / F.pow(F.lit(2.0), k)) <= cap
    guess = F.greatest(F.ceil(F.log2(F.greatest(n, F.lit(1)) / F.lit(float(cap)))), F.lit(0)).cast("int")
    down = F.when((guess > 0) & fits(guess - 1), guess - 1).otherwise(guess)
    exact = F.when(fits(down), down).otherwise(down + 1)
    return F.pow(F.lit(2.0), exact).cast("long")


def with_arrival_index(points: DataFrame) -> DataFrame:
    """Adds arrival_index, from 0, to each point of a series.

    A file is numbered in chunks of ``CHUNK`` bytes, and chunks by what came before them, so no task ever sorts a whole series.
    """
    chunked = points.withColumn("chunk", F.floor(F.col("rec_off") / CHUNK))
    key = ["run", "tag", "path", "chunk"]
    before = Window.partitionBy("run", "tag").orderBy("path", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunked.groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("rec_off", "val_idx"))
    return chunked.join(starts, key).withColumn("arrival_index", F.col("start") + inside - 1).drop("chunk", "start")


def thin(points: DataFrame, cap: int) -> DataFrame:
    """The points that stay, with the stride of their series."""
    indexed = points if "arrival_index" in points.columns else with_arrival_index(points)
    strides = points.groupBy("run", "tag").agg(F.count("*").alias("n")).select("run", "tag", stride_of(F.col("n"), cap).alias("stride"))
    return indexed.join(strides, ["run", "tag"]).where(F.pmod(F.col("arrival_index"), F.col("stride")) == 0).drop("arrival_index")


def summary(points: DataFrame, cap: int) -> DataFrame:
    """(total_points, stored_points, max_stride), one row. From the series' lengths; no point is moved."""
    n = points.groupBy("run", "tag").agg(F.count("*").alias("n")).withColumn("stride", stride_of(F.col("n"), cap))
    return n.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_points"),
        F.coalesce(F.sum(F.ceil(F.col("n") / F.col("stride"))), F.lit(0)).cast("long").alias("stored_points"), F.coalesce(F.max("stride"), F.lit(1)).alias("max_stride"),
    )
