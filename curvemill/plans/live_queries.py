"""Named queries over live tables, whole-series scans and cursors, with their SQL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvemill.operators import catalog, scan, series, summary
from curvemill.plans import catalogue, scratch
from curvemill.plans.registry import COLUMNS, P, P12, POINTS, TAG, WEIGHT, ZOOMED, query, rounded
from curvemill.plans.session import LiveSession
from curvemill.schema import Chart, Options
from curvemill.sources import tables
from curvemill.streaming.table import LiveTable

CAP, BATCHES = 100, 3


@lru_cache(8)
def _filled(spark: SparkSession, sf: str, runs: int, cap: int) -> str:
    """The folder of a live table that took in the events in batches, in order of arrival."""
    points = tables.event_points(spark, sf, runs)
    last = points.agg(F.max("step")).first()[0]
    live = LiveTable(spark, scratch.folder(spark, "live-table"), cap)
    for number in range(BATCHES):
        low, high = last * number // BATCHES, last * (number + 1) // BATCHES
        live.apply(points.where((F.col("step") > low if number else F.lit(True)) & (F.col("step") <= high)), number)
    return live.folder


def _live(spark: SparkSession, sf: str, runs: int = 4, cap: int = CAP) -> LiveTable:
    return LiveTable(spark, _filled(spark, sf, runs, cap), cap)


_KEPT = f"{catalogue.THIN}, kept AS (SELECT * FROM k WHERE i % stride = 0)"


@query(f"WITH {P}, {_KEPT} SELECT run, tag, step, wall, value FROM kept")
def live_thinned(spark, sf):
    """What a table of at most 100 points a series keeps of three batches: as of one read."""
    return _live(spark, sf).points().select(*POINTS)


@query(f"WITH {P}, {_KEPT} SELECT run, tag, any_value(n)::BIGINT AS offered, any_value(stride)::BIGINT AS stride, min(CASE WHEN wall <> 0 THEN wall END) AS least_wall, min(step) FILTER (i % stride = 0) AS first_step, max(step) FILTER (i % stride = 0) AS last_step FROM k GROUP BY run, tag")
def live_series(spark, sf):
    """The series' summaries after three batches."""
    return _live(spark, sf).series().select("run", "tag", "offered", "stride", "least_wall", F.col("first.step").alias("first_step"), F.col("last.step").alias("last_step"))


@query(f"""WITH {P12}, r AS (SELECT run, row_number() OVER (ORDER BY run) <= 8 AS enabled FROM (SELECT DISTINCT run FROM p)), {_KEPT}
SELECT (SELECT count(*) FROM r WHERE enabled)::BIGINT AS runs_on, (SELECT count(*) FROM r)::BIGINT AS runs_total,
 (SELECT count(DISTINCT tag) FROM p JOIN r USING (run) WHERE enabled)::BIGINT AS n_tags, (SELECT count(*) FROM p)::BIGINT AS total_points,
 (SELECT count(*) FROM kept)::BIGINT AS stored_points, (SELECT max(stride) FROM k)::BIGINT AS max_stride""")
def live_header(spark, sf):
    """The header's counts, from summaries alone."""
    live = _live(spark, sf, 12)
    return summary.header(live.series(), catalog.cap_runs(live.runs().select("run"), 8))


@query(f"WITH {P}, {_KEPT}, e AS (SELECT run, arg_min(wall, step) AS f, arg_max(wall, step) AS l FROM kept WHERE tag = '{TAG}' GROUP BY run), w AS (SELECT run, min(CASE WHEN wall <> 0 THEN wall END) AS o FROM p GROUP BY run) SELECT min(f - o) AS xmin, max(l - o) AS xmax FROM e JOIN w USING (run)")
def live_domain(spark, sf):
    """The domain of relative time of one metric, from summaries alone."""
    known = _live(spark, sf).series()
    return summary.domain(known.where(F.col("tag") == TAG), "reltime", summary.first_walls(known))


@query(f"WITH {P}, {_KEPT} SELECT run, tag, count(*)::BIGINT AS n_points FROM kept GROUP BY run, tag ORDER BY n_points DESC, run DESC, tag DESC LIMIT 1")
def live_longest(spark, sf):
    return summary.longest(_live(spark, sf).series())


@query(catalogue.ZOOM_SQL)
def live_zoom(spark, sf):
    """A zoomed chart of a live table: its range comes from summaries and reaches the scan."""
    live = _live(spark, sf, cap=0)
    session = LiveSession(live, Options("live", max_runs=0), live.runs().select("run", F.array("run").alias("path_parts")))
    return rounded(session.curves(Chart(TAG, smoothing=0.0, view=ZOOMED, px_w=COLUMNS)), "y")


@query(f"""WITH {P}, n AS (SELECT *, row_number() OVER (PARTITION BY run, tag ORDER BY step) AS place FROM p)
SELECT a.run, a.tag, a.step, a.place::BIGINT AS place, round(sum((1 - {WEIGHT}::DOUBLE) * pow({WEIGHT}::DOUBLE, a.place - o.place) * o.value) / (1 - pow({WEIGHT}::DOUBLE, any_value(a.place))), 6) AS y
FROM n a JOIN n o ON a.run = o.run AND a.tag = o.tag AND o.place <= a.place AND a.place - o.place < 200 GROUP BY a.run, a.tag, a.step, a.place""")
def ema_every_point(spark, sf):
    """The moving average at every point of whole series, in blocks of 128. (Terms of 200 points ago and more are below 1e-40.)"""
    return rounded(scan.smooth_points(tables.event_points(spark, sf), WEIGHT, 128), "y")


@query(f"""WITH {P}, c AS (SELECT run, '{TAG}' AS tag, step AS cursor_id, step - 0.5::DOUBLE AS at FROM p WHERE tag <> '{TAG}'),
o AS (SELECT run, tag, step, step::DOUBLE AS x, value FROM p)
SELECT c.run, c.cursor_id, o.step, o.value FROM c ASOF LEFT JOIN o ON c.run = o.run AND c.tag = o.tag AND c.at >= o.x""")
def asof_many_cursors(spark, sf):
    """For every event of another kind the last value of one metric before it, in the same run."""
    points = tables.event_points(spark, sf)
    xs = series.with_x(points, "step")
    cursors = points.where(F.col("tag") != TAG).select("run", F.lit(TAG).alias("tag"), F.col("step").alias("cursor_id"), (F.col("step") - 0.5).alias("at"))
    return scan.as_of_many(xs, cursors, scratch.folder(spark, "asof")).select("run", "cursor_id", "step", "value")
