"""Named queries over screen arithmetic and edge cases of event files and streams, each with its equivalent SQL; ``catalogue`` registers them.

Functions of a few numbers are applied to whole grids of arguments.
"""

from __future__ import annotations

from itertools import product

from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import functions as F

from curvemill.functions import ticks
from curvemill.operators import chart, layout, series
from curvemill.plans import catalogue, scratch
from curvemill.plans.registry import COLUMNS, P, POINTS, STORED, TAG, ZOOMED, query
from curvemill.schema import X_MODES, Chart, Options, View
from curvemill.sources import datasource, files, tables, wire
from curvemill.streaming import live

_GRID = "(SELECT w, h, n FROM (SELECT unnest(range(30, 200, 7)) AS w), (SELECT unnest(range(5, 60, 4)) AS h), (SELECT unnest(range(0, 12)) AS n))"


@query(f"""WITH g AS (SELECT w, h, n, greatest(least(w // 40, 3), 1) AS cm, greatest(least(h // 9, 3), 1) AS rm FROM {_GRID}),
m AS (SELECT *, greatest(least(n, cm * rm), 1) AS k FROM g), c AS (SELECT *, unnest(range(1, cm + 1)) AS c FROM m),
f AS (SELECT w, h, n, k, arg_min(c, (c * ((k + c - 1) // c) - k) * 10 - c) AS columns FROM c WHERE (k + c - 1) // c <= rm GROUP BY ALL)
SELECT w, h, n, columns, (k + columns - 1) // columns AS rows, k AS charts FROM f""")
def grid_shapes(spark, sf):
    cases = product(range(30, 200, 7), range(5, 60, 4), range(12))
    return spark.createDataFrame([(w, h, n, *layout.grid_shape(w, h, n)) for w, h, n in cases], "w long, h long, n long, columns long, rows long, charts long")


@query("SELECT t AS total, p AS parts, i, i * (t // p) + least(i, t % p) AS start, t // p + CASE WHEN i < t % p THEN 1 ELSE 0 END AS size FROM (SELECT t, p, unnest(range(0, p)) AS i FROM (SELECT unnest(range(1, 90)) AS t), (SELECT unnest(range(1, 5)) AS p))")
def slot_spans(spark, sf):
    rows = [(t, p, i, start, size) for t, p in product(range(1, 90), range(1, 5)) for i, (start, size) in enumerate(layout.slot_spans(t, p))]
    return spark.createDataFrame(rows, "total long, parts long, i long, start long, size long")


@query("SELECT s AS scroll, k AS selected, v AS visible, CASE WHEN v = 0 THEN 0 WHEN k < s THEN k WHEN k >= s + v THEN k - v + 1 ELSE s END AS first FROM (SELECT unnest(range(0, 12)) AS s), (SELECT unnest(range(0, 20)) AS k), (SELECT unnest(range(0, 7)) AS v)")
def scroll_window(spark, sf):
    rows = [(s, k, v, layout.scroll_for(s, k, v)) for s, k, v in product(range(12), range(20), range(7))]
    return spark.createDataFrame(rows, "scroll long, selected long, visible long, first long")


@query("SELECT w, h, greatest(w - 11, 0) AS plot_w, greatest(h - 2, 0) AS plot_h, 2 * greatest(w - 11, 0) AS px_w, 4 * greatest(h - 2, 0) AS px_h, w >= 40 AND h >= 8 AS fits FROM (SELECT unnest(range(0, 120, 3)) AS w), (SELECT unnest(range(0, 40)) AS h)")
def plot_sizes(spark, sf):
    rows = [(w, h, *layout.plot_size(w, h), layout.fits(w, h)) for w, h in product(range(0, 120, 3), range(40))]
    return spark.createDataFrame(rows, "w long, h long, plot_w long, plot_h long, px_w long, px_h long, fits boolean")


_VIEWS = "v AS (SELECT lo / 20::DOUBLE AS lo, hi / 20::DOUBLE AS hi, CASE WHEN c < 0 THEN NULL ELSE c / 10::DOUBLE END AS cur FROM (SELECT unnest(range(0, 20)) AS lo), (SELECT unnest(range(1, 21)) AS hi), (SELECT unnest(range(-1, 11)) AS c) WHERE lo < hi)"
_CLAMP = "greatest(0::DOUBLE, least({}, 1 - {}))"


def _views():
    return [View(lo / 20, hi / 20, None if c < 0 else c / 10) for lo, hi, c in product(range(20), range(1, 21), range(-1, 11)) if lo < hi]


@query(f"""WITH {_VIEWS}, z AS (SELECT lo, hi, cur, k, greatest(1e-4::DOUBLE, least((hi - lo) * CASE WHEN k THEN 0.7::DOUBLE ELSE 1 / 0.7::DOUBLE END, 1)) AS span FROM v, (SELECT unnest([true, false]) AS k))
SELECT lo, hi, cur AS cursor, k AS inward, round({_CLAMP.format("lo + (hi - lo) * coalesce(cur, 0.5::DOUBLE) - span * coalesce(cur, 0.5::DOUBLE)", "span")}, 6) + 0.0 AS new_lo, round(span, 6) AS span FROM z""")
def zoom_views(spark, sf):
    rows = [(v.lo, v.hi, v.cursor, k, z.lo, z.hi - z.lo) for v in _views() for k in (True, False) for z in (layout.zoom(v, k),)]
    out = spark.createDataFrame(rows, "lo double, hi double, cursor double, inward boolean, new_lo double, span double")
    return out.withColumns({"new_lo": F.round("new_lo", 6) + 0.0, "span": F.round("span", 6)})


@query(f"WITH {_VIEWS}, z AS (SELECT DISTINCT lo, hi, k FROM v, (SELECT unnest([true, false]) AS k)) SELECT lo, hi, k AS to_right, round({_CLAMP.format('lo + CASE WHEN k THEN 0.15::DOUBLE ELSE -0.15::DOUBLE END * (hi - lo)', '(hi - lo)')}, 6) + 0.0 AS new_lo FROM z")
def pan_views(spark, sf):
    rows = [(v.lo, v.hi, k, layout.pan(v, k).lo) for v in _views() if v.cursor is None for k in (True, False)]
    return spark.createDataFrame(rows, "lo double, hi double, to_right boolean, new_lo double").withColumn("new_lo", F.round("new_lo", 6) + 0.0)


@query("SELECT c / 50::DOUBLE AS cursor, k AS to_right, round(greatest(0::DOUBLE, least(1::DOUBLE, c / 50::DOUBLE + CASE WHEN k THEN 0.02::DOUBLE ELSE -0.02::DOUBLE END)), 6) AS moved FROM (SELECT unnest(range(0, 51)) AS c), (SELECT unnest([true, false]) AS k) UNION ALL SELECT NULL, k, 0.5::DOUBLE FROM (SELECT unnest([true, false]) AS k)")
def cursor_moves(spark, sf):
    rows = [(c, k, layout.move_cursor(View(cursor=c), k).cursor) for c in [None, *(i / 50 for i in range(51))] for k in (True, False)]
    return spark.createDataFrame(rows, "cursor double, to_right boolean, moved double").withColumn("moved", F.round("moved", 6))


@query("SELECT w / 100::DOUBLE AS weight, k AS more, greatest(0::DOUBLE, least(0.99::DOUBLE, round(w / 100::DOUBLE + CASE WHEN k THEN 0.05::DOUBLE ELSE -0.05::DOUBLE END, 2))) AS changed FROM (SELECT unnest(range(0, 100)) AS w), (SELECT unnest([true, false]) AS k)")
def smoothing_steps(spark, sf):
    rows = [(w / 100, k, float(layout.smoother(w / 100, k))) for w in range(100) for k in (True, False)]
    return spark.createDataFrame(rows, "weight double, more boolean, changed double")


@query("SELECT unnest(['step', 'reltime', 'wall']) AS mode, unnest(['reltime', 'wall', 'step']) AS next, 0::DOUBLE AS lo, 1::DOUBLE AS hi")
def axis_cycle(spark, sf):
    return spark.createDataFrame([(m, n, v.lo, v.hi) for m in X_MODES for n, v in (layout.next_axis(m),)], "mode string, next string, lo double, hi double")


@query("SELECT k AS decade, pow(10::DOUBLE, k) AS shown FROM (SELECT unnest(range(-3, 4)) AS k)")
def log_ticks(spark, sf):
    """Ticks of a logarithmic axis over six decades stand at whole powers of ten and are labelled by them."""
    wide = spark.range(1).select(F.lit(-3.0).alias("vmin"), F.lit(3.0).alias("vmax"))
    shown = ticks.y_ticks(wide, 28, log_y=True)
    return shown.select(F.col("tick").cast("long").alias("decade"), F.col("label").cast("double").alias("shown"))


@query(f"WITH {P}, xs AS (SELECT run, value FROM p WHERE tag = '{TAG}') SELECT run, tag, 0 AS col, y FROM (SELECT run, '{TAG}' AS tag, round(avg(value), 6) AS y FROM xs GROUP BY run)")
def chart_of_one_column(spark, sf):
    """The narrowest chart: all points of a run in one bucket."""
    return chart.curves(tables.event_points(spark, sf), Chart(TAG, smoothing=0.0, px_w=1)).select("run", "tag", F.col("col").cast("int").alias("col"), F.round("y", 6).alias("y"))


@query(f"""WITH {catalogue.XS}, {catalogue.DOMAIN}, {catalogue.shown(0.25, 0.5)}, {catalogue.buckets_sql(COLUMNS)},
a AS (SELECT run, count(*)::BIGINT AS n_points, count(*) FILTER (x < lo)::BIGINT AS before, count(*) FILTER (x > hi)::BIGINT AS after, count(*) FILTER (NOT value > 0)::BIGINT AS not_positive FROM xs, rng GROUP BY run),
c AS (SELECT run, count(*) FILTER (c >= {COLUMNS})::BIGINT AS beyond, count(DISTINCT c) FILTER (c < {COLUMNS})::BIGINT AS n_columns FROM g3 GROUP BY run)
SELECT a.run, n_points, before, after, not_positive, beyond, n_columns, 0::BIGINT AS without_columns, 0::BIGINT AS without_range FROM a JOIN c USING (run)""")
def chart_guards(spark, sf):
    """How many points of each run the guards of a zoomed chart leave out: before and after its range, beyond the last edge, not positive for a logarithm; and what a chart without columns or range draws."""
    points = tables.event_points(spark, sf).where(F.col("tag") == TAG)
    xs = series.with_x(points, "step")
    placed = xs.crossJoin(F.broadcast(series.view_range(series.domain(xs), ZOOMED)))
    inside = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
    bucket = F.when(inside, chart.bucket_of(F.col("x"), F.col("lo"), F.col("hi"), COLUMNS))
    out = placed.groupBy("run").agg(
        F.count("*").alias("n_points"), F.count_if(F.col("x") < F.col("lo")).alias("before"), F.count_if(F.col("x") > F.col("hi")).alias("after"), F.count_if(~(F.col("value") > 0)).alias("not_positive"),
        F.count_if(inside & bucket.isNull()).alias("beyond"), F.count_distinct(bucket).alias("n_columns"),
    )
    for name, drawn in (("without_columns", chart.bucket_means(placed, 0, F.col("lo"), F.col("hi"))), ("without_range", chart.bucket_means(placed, COLUMNS, F.col("hi"), F.col("lo") - 1))):
        out = out.join(drawn.groupBy("run").agg(F.count("*").alias(name)), "run", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


# ---- event files ----


def _logdir(spark, points) -> str:
    top = scratch.folder(spark, "logdir")
    datasource.write(points, top)
    return top


def _append(top: str, tail: bytes) -> None:
    for f in files.discover(top):
        system, at = FileSystem.from_uri(f.path) if "://" in f.path else (LocalFileSystem(), f.path)
        with system.open_append_stream(at) as out:
            out.write(tail)


def _event(*values: bytes) -> bytes:
    summary = b"".join(wire.put_field(1, wire.BYTES, v) for v in values)
    return wire.frame(wire.put_field(2, wire.VARINT, wire.put_varint(7)) + wire.put_field(5, wire.BYTES, summary))


@query(f"WITH {P} SELECT DISTINCT run, '<invalid-utf8>' AS tag, 7::BIGINT AS step, 1.5::DOUBLE AS value FROM p UNION ALL SELECT DISTINCT run, 'été/損失', 7, 2.5 FROM p")
def tfevents_tag_bytes(spark, sf):
    """Tags that are no UTF-8 have a name of their own; records with pictures, text or nothing give no points."""
    top = _logdir(spark, tables.event_points(spark, sf))
    number = lambda v: wire.put_field(2, wire.FIXED32, v)
    tagged = lambda t, *rest: wire.put_field(1, wire.BYTES, t) + b"".join(rest)
    picture = tagged(b"picture", wire.put_field(4, wire.BYTES, wire.put_field(1, wire.VARINT, wire.put_varint(9))))
    _append(top, _event(tagged(b"\xff\xfe", number(b"\0\0\xc0\x3f"))) + _event(picture) + _event() + wire.frame(wire.put_field(3, wire.BYTES, b"brain.Event:2")) + _event(picture, tagged("été/損失".encode(), number(b"\0\0\x20\x40"))))
    return datasource.read(spark, top).where("tag = '<invalid-utf8>' OR tag LIKE '%損%' OR tag = 'picture'").select("run", "tag", "step", "value").distinct()


@query(f"WITH {P} SELECT run, count(*)::BIGINT + 1 AS records, 1::BIGINT AS wrong FROM p GROUP BY run")
def tfevents_checksums(spark, sf):
    """Checksums that were written are right; one record a run has a wrong one."""
    points = tables.event_points(spark, sf)
    top = scratch.folder(spark, "logdir")
    datasource.write(points.coalesce(1), top, tensor=True)
    good = wire.frame(wire.encode_event("more", 1, 1.0, 1.0))
    done = set()
    for f in files.discover(top):
        if f.run not in done:
            done.add(f.run)
            system, at = FileSystem.from_uri(f.path) if "://" in f.path else (LocalFileSystem(), f.path)
            with system.open_append_stream(at) as out:
                out.write(good[:-1] + bytes([good[-1] ^ 1]))
    return datasource.read(spark, top, "checksums").groupBy("run").agg(F.sum("records").alias("records"), F.sum("wrong").alias("wrong"))


@query(f"WITH {P} SELECT run, step, value::FLOAT::DOUBLE AS value FROM p WHERE tag = '{TAG}' AND run IN ('u1', 'u3')")
def tfevents_pushdown(spark, sf):
    """Filters on run and tag are the source's own."""
    top = _logdir(spark, tables.event_points(spark, sf))
    return datasource.read(spark, top, splitBytes=4096).where((F.col("tag") == TAG) & F.col("run").isin("u1", "u3")).select("run", "step", "value")


# ---- streams ----


def _followed(spark, parts, top: str | None = None, between=None, **source):
    """Parts of the points written and followed one after the other, and all kept; (points table, runs table, folder)."""
    top = top or scratch.folder(spark, "logdir")
    out, state = scratch.folder(spark, "live"), scratch.folder(spark, "state")
    for k, part in enumerate(parts):
        datasource.write(part, top)
        live.follow(spark, Options(top, follow=False, max_points=0), out, state, **source).awaitTermination()
        if between and not k:
            between(top)
    return live.live_points(spark, out), live.known_runs(spark, out), top


@query(STORED)
def stream_new_files(spark, sf):
    """Runs and files that come while the stream goes on."""
    points = tables.event_points(spark, sf)
    return _followed(spark, [points.where("run < 'u2'"), points.where("run >= 'u2'")])[0].select(*POINTS)


@query(STORED)
def stream_late_points(spark, sf):
    """Steps that come after later ones are kept like any other."""
    points = tables.event_points(spark, sf)
    half = points.agg(F.max("step")).first()[0] // 2
    return _followed(spark, [points.where(F.col("step") > half), points.where(F.col("step") <= half)])[0].select(*POINTS)


@query(STORED)
def stream_dead_files(spark, sf):
    """A damaged file is read up to the damage and never again, whatever is appended; other files go on."""
    points = tables.event_points(spark, sf)
    half = points.agg(F.max("step")).first()[0] // 2
    harm = lambda top: _append(top, wire.frame(b"\x0b damaged") + wire.frame(wire.encode_event("never", 1, 1.0, 1.0)))
    dead = scratch.folder(spark, "dead")
    found, _, _ = _followed(spark, [points.where(F.col("step") <= half), points.where(F.col("step") > half)], between=harm, stateDir=dead)
    return found.select(*POINTS)


@query(f"WITH {P} SELECT run, min(wall) FILTER (wall <> 0) AS first_wall, row_number() OVER (ORDER BY run)::INT AS color_slot, true AS enabled FROM p GROUP BY run UNION ALL SELECT 'a', NULL, 0, true")
def live_runs(spark, sf):
    """The runs table of a stream: a run whose file has no points is there, too."""
    top = scratch.folder(spark, "logdir")
    system, at = FileSystem.from_uri(top) if "://" in top else (LocalFileSystem(), top)
    system.create_dir(f"{at}/a")
    with system.open_output_stream(f"{at}/a/events.out.tfevents.0") as out:
        out.write(b"")
    return _followed(spark, [tables.event_points(spark, sf)], top)[1]
