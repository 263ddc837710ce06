"""Points from ordinary tables: any DataFrame with a run, a tag, a step, a wall time and a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def as_points(table: DataFrame, run: Column, tag: Column, step: Column, wall: Column, value: Column, arrival: Column | None = None, source: str = "table") -> DataFrame:
    """Points of a table; ``arrival`` orders its rows (by default the step)."""
    order = arrival if arrival is not None else step
    return table.select(
        run.cast("string").alias("run"), tag.cast("string").alias("tag"), step.cast("long").alias("step"), wall.cast("double").alias("wall"), value.cast("double").alias("value"),
        F.lit(source).alias("path"), order.cast("long").alias("rec_off"), F.lit(0).alias("val_idx"),
    )


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def event_points(spark: SparkSession, sf_dir: str, n_runs: int = 4) -> DataFrame:
    """The ``events`` table as points: users by their rest as runs, event types as tags."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    run = F.concat(F.lit("u"), (F.col("user_id") % n_runs).cast("string"))
    return as_points(t, run, F.col("event_type"), F.col("event_id"), seconds(F.col("ts")), F.col("value"), source="events")


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``lineitem`` table as points: steps repeat, and wall times do not follow them."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    run = F.concat_ws("/", "l_returnflag", "l_linestatus")
    arrival = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * (1 << 32) + F.col("l_partkey") * 2048 + F.col("l_suppkey")
    return as_points(t, run, F.lit("price"), F.col("l_orderkey"), seconds(F.col("l_shipdate")), F.col("l_extendedprice"), arrival, source="lineitem")
