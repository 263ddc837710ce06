"""Queries over tables of the size at which limits and chunks begin to count."""

import pytest
from pyspark.sql import functions as F

from curvemill.functions import ticks
from curvemill.plans import catalogue
from curvemill.sources import tables
from curvemill.streaming.table import LiveTable


def events(spark, folder, n, tag="view"):
    t = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), F.when(F.col("id") % 100 == 99, 3).otherwise(0).cast("long").alias("user_id"),
        F.lit(tag).alias("event_type"), (F.col("id") % 64).cast("double").alias("value"), F.lit("{}").alias("props"),
    )
    t.write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["stream_tail", "stream_new_files", "stream_late_points", "stream_dead_files"])
def test_streams_keep_all_points_of_long_series(spark, tmp_path, name):
    n = 105_000  # 103,950 of one series
    found = catalogue.QUERIES[name](spark, events(spark, tmp_path, n))
    assert found.agg(F.count("*"), F.count_distinct("step"), F.sum("step")).first()[:] == (n, n, n * (n - 1) // 2)


def test_a_task_of_a_live_table_sorts_a_bounded_part_of_a_batch(spark, tmp_path):
    n = 1_100_000
    points = tables.event_points(spark, events(spark, tmp_path, n))
    live = LiveTable(spark, str(tmp_path / "live"))
    live.apply(points, 0)
    sizes = [spark.read.parquet(f).count() for f in live.points().inputFiles()]
    assert sum(sizes) == n and len(sizes) >= 3 and max(sizes) <= 1.3 * (1 << 19)


def test_ticks_compute_their_step_once_a_row(spark):
    some = spark.createDataFrame([(0.0, 9.0), (-3.0, 4.5), (2.0, 2.0)], "lo double, hi double").select(ticks.nice_ticks(F.col("lo"), F.col("hi"), 5).alias("t"))
    assert some._jdf.queryExecution().analyzed().toString().lower().count("log10") <= 16
    assert [r["t"] for r in some.collect()] == [[0.0, 2.5, 5.0, 7.5], [-2.0, 0.0, 2.0, 4.0], [2.0]]
