"""Named queries over the metric tables, each with its equivalent SQL.

Points come from ``events`` (users by their rest as runs, event types as tags, ids as steps), arrival order from ids; tag trees from the
URLs of ``pages``; folders of runs from ``documents``. Doubles that both engines sum in orders of their own are rounded.
"""

from __future__ import annotations

from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvemill.functions import text, ticks
from curvemill.operators import catalog, chart, layout, raster, series, thin, tree
from curvemill.plans import scratch
from curvemill.plans.registry import CHART, COLUMNS, ORACLE_SQL, P, P12, POINTS, QUERIES, STORED, TAG, WEIGHT, ZOOMED, query, rounded
from curvemill.schema import Chart, Options, View
from curvemill.sources import datasource, demo, files, tables, wire
from curvemill.streaming import live

XS = f"{P}, xs AS (SELECT *, step::DOUBLE AS x FROM p WHERE tag = '{TAG}')"
DOMAIN = "ends AS (SELECT run, arg_min(x, step) AS f, arg_max(x, step) AS l FROM xs GROUP BY run), dom AS (SELECT min(f) AS xmin, max(l) AS xmax FROM ends)"


def shown(lo: float, hi: float) -> str:
    return f"""rng AS (SELECT xmin, xmax, xmin + greatest(xmax - xmin, 1e-12::DOUBLE) * {lo}::DOUBLE AS lo,
  xmin + greatest(xmax - xmin, 1e-12::DOUBLE) * {hi}::DOUBLE AS hi FROM dom)"""


def buckets_sql(n: int) -> str:
    return f"""inside AS (SELECT run, tag, x, value, lo, hi - lo AS span FROM xs, rng WHERE x >= lo AND x <= hi),
g1 AS (SELECT *, greatest(ceil((x - lo) * {n}::DOUBLE / span) - 1, 0::DOUBLE) AS g FROM inside),
g2 AS (SELECT *, CASE WHEN g > 0 AND x <= lo + span * g / {n}::DOUBLE THEN g - 1 ELSE g END AS d FROM g1),
g3 AS (SELECT *, CASE WHEN x > lo + span * (d + 1) / {n}::DOUBLE THEN d + 1 ELSE d END AS c FROM g2),
b AS (SELECT run, tag, c::INT AS col, avg(value) AS y FROM g3 WHERE c < {n} GROUP BY ALL)"""


EMA = f"""i AS (SELECT *, row_number() OVER (PARTITION BY run, tag ORDER BY col) AS i, count(*) OVER (PARTITION BY run, tag) AS n FROM b),
e AS (SELECT a.run, a.tag, a.col, CASE WHEN any_value(a.n) < 2 THEN any_value(a.y)
  ELSE sum((1 - {WEIGHT}::DOUBLE) * pow({WEIGHT}::DOUBLE, a.i - o.i) * o.y) / (1 - pow({WEIGHT}::DOUBLE, any_value(a.i))) END AS y
  FROM i a JOIN i o ON a.run = o.run AND a.tag = o.tag AND o.i <= a.i GROUP BY a.run, a.tag, a.col)"""
DRAWN = f"WITH {XS}, {DOMAIN}, {shown(0.0, 1.0)}, {buckets_sql(COLUMNS)}, {EMA}"
Y_RANGE = """raw AS (SELECT min(y) AS a, max(y) AS b FROM e WHERE NOT isnan(y)),
yr AS (SELECT a - pad AS vmin, b + pad AS vmax FROM (SELECT a, b, CASE WHEN b - a < 1e-12 THEN CASE WHEN b <> 0 THEN abs(b) * 0.1::DOUBLE ELSE 1 END ELSE (b - a) * 0.05::DOUBLE END AS pad FROM raw))"""
PIXELS = f"{DRAWN}, {Y_RANGE}, px AS (SELECT run, tag, col AS px, (39 - round((y - vmin) / (vmax - vmin) * 39))::BIGINT AS py FROM e, yr)"


def _xs(spark: SparkSession, sf: str, mode: str = "step") -> DataFrame:
    points = tables.event_points(spark, sf)
    return series.with_x(points.where(F.col("tag") == TAG), mode, series.first_walls(points) if mode == "reltime" else None)


def _drawn(spark: SparkSession, sf: str) -> DataFrame:
    return chart.curves(tables.event_points(spark, sf), CHART)


def _runs12(spark: SparkSession, sf: str) -> DataFrame:
    return tables.event_points(spark, sf, 12).select("run").distinct()


def _page_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags from the addresses of pages, without scheme, query and fragment; some hold doubled slashes."""
    url = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return spark.read.parquet(f"{sf}/pages.parquet").where("url is not null").select(url.alias("tag")).distinct()


PAGE_TAGS = "t AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS tag FROM pages WHERE url IS NOT NULL)"
TREE = f"""{PAGE_TAGS},
s AS (SELECT list_filter(string_split(tag, '/'), lambda x: x <> '') AS seg, min(tag) AS tag FROM t GROUP BY 1),
l AS (SELECT seg, tag FROM s WHERE len(seg) > 0),
r AS (SELECT seg, tag, list_slice(seg, 1, k) AS pre FROM (SELECT seg, tag, unnest(range(1, len(seg) + 1)) AS k FROM l)),
nodes AS (SELECT pre AS seg, array_to_string(pre, '/') AS path, max(CASE WHEN len(r.seg) = len(pre) THEN tag END) AS tag, count(*)::BIGINT AS leaves,
  count(DISTINCT r.seg[len(pre) + 1])::BIGINT AS children, min(CASE WHEN len(r.seg) > len(pre) THEN list_slice(r.seg, 1, len(pre) + 1) END) AS only FROM r GROUP BY pre),
kept AS (SELECT n.*, n.children = 0 AS leaf FROM nodes n LEFT JOIN nodes o ON o.seg = n.only AND o.tag IS NOT NULL AND o.children > 0
  WHERE n.tag IS NOT NULL OR n.children <> 1 OR o.seg IS NOT NULL),
up AS (SELECT k.seg, len(u.seg) AS n, u.path FROM kept k JOIN kept u ON len(u.seg) < len(k.seg) AND list_slice(k.seg, 1, len(u.seg)) = u.seg),
ups AS (SELECT seg, count(*)::INT AS depth, max(n) AS skip, arg_max(path, n) AS parent, list(path ORDER BY n) AS above FROM up GROUP BY seg),
comp AS (SELECT k.path, array_to_string(list_slice(k.seg, coalesce(skip, 0) + 1, len(k.seg)), '/') AS label, coalesce(depth, 0)::INT AS depth, leaf, leaves, tag, k.seg, parent, coalesce(above, []) AS above
  FROM kept k LEFT JOIN ups USING (seg))"""


# ---- lists, filters and visibility of runs and tags ----


@query(f"WITH {P} SELECT * FROM p")
def points_events(spark, sf):
    return tables.event_points(spark, sf).select(*POINTS)


@query(f"WITH {P12} SELECT DISTINCT run FROM p")
def run_list(spark, sf):
    return catalog.runs(tables.event_points(spark, sf, 12))


@query(f"WITH {P} SELECT DISTINCT tag FROM p WHERE run IN ('u0', 'u1')")
def tag_list_enabled(spark, sf):
    points = tables.event_points(spark, sf)
    return catalog.tags(points, catalog.cap_runs(points.select("run").distinct(), 2))


@query(f"WITH {P12} SELECT DISTINCT run FROM p WHERE contains(lower(run), lower('U1'))")
def run_filter_substr(spark, sf):
    return catalog.filter_runs(_runs12(spark, sf), "U1")


@query(f"WITH {P} SELECT DISTINCT tag FROM p WHERE contains(lower(tag), lower('IE'))")
def tag_filter_substr(spark, sf):
    return catalog.tags(tables.event_points(spark, sf), part="IE")


@query(f"WITH {P12} SELECT run, row_number() OVER (ORDER BY run) <= 8 AS enabled FROM (SELECT DISTINCT run FROM p)")
def run_cap_default(spark, sf):
    return catalog.cap_runs(_runs12(spark, sf), 8)


@query(f"WITH {P12}, r AS (SELECT run, row_number() OVER (ORDER BY run) <= 8 AS enabled FROM (SELECT DISTINCT run FROM p)) SELECT count(*)::BIGINT AS n_runs, count(*) FILTER (NOT enabled)::BIGINT AS n_hidden, CASE WHEN count(*) FILTER (NOT enabled) > 0 THEN count(*) || ' runs found, ' || count(*) FILTER (enabled) || ' shown' END AS notice FROM r")
def hidden_runs_notice(spark, sf):
    return catalog.hidden_notice(catalog.cap_runs(_runs12(spark, sf), 8))


_STATES = f"{P12}, r AS (SELECT run, row_number() OVER (ORDER BY run) <= 8 AS enabled FROM (SELECT DISTINCT run FROM p))"


@query(f"WITH {_STATES} SELECT run, CASE WHEN contains(run, 'u1') THEN (SELECT bool_or(NOT enabled) FROM r WHERE contains(run, 'u1')) ELSE enabled END AS enabled FROM r")
def toggle_all(spark, sf):
    return catalog.toggle_all(catalog.cap_runs(_runs12(spark, sf), 8), "u1")


@query(f"WITH {_STATES} SELECT run, CASE WHEN run = 'u3' THEN NOT enabled ELSE enabled END AS enabled FROM r")
def toggle_run(spark, sf):
    return catalog.toggle(catalog.cap_runs(_runs12(spark, sf), 8), "u3")


@query(f"WITH {_STATES} SELECT run, run = 'u7' AS enabled FROM r")
def solo_run(spark, sf):
    return catalog.solo(catalog.cap_runs(_runs12(spark, sf), 8), "u7")


@query(f"WITH {_STATES} SELECT run, enabled FROM r UNION ALL SELECT run || 'x', row_number() OVER (ORDER BY run) <= 0 FROM r")
def admit_new_runs(spark, sf):
    known = catalog.cap_runs(_runs12(spark, sf), 8)
    return catalog.admit_runs(known, known.select(F.concat("run", F.lit("x")).alias("run")), 8)


_FOLDERS = "f AS (SELECT DISTINCT s || '/' || l AS run, [s, l, 'events.out.tfevents'] AS parts FROM (SELECT coalesce(source, '-') AS s, coalesce(lang, '-') AS l FROM documents)), m AS (SELECT run, min(parts) AS first FROM f GROUP BY run)"


@query(f"""WITH {_FOLDERS}, s AS (SELECT run, (dense_rank() OVER (ORDER BY first) - 1)::INT AS color_slot FROM m)
SELECT run, color_slot, color_slot % 8 AS hue, least(color_slot // 8, 2)::INT AS dash, ['●', '◆', '▪'][least(color_slot // 8, 2) + 1] AS marker FROM s""")
def run_colors(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.coalesce("source", F.lit("-")).alias("source"), F.coalesce("lang", F.lit("-")).alias("lang"))
    return catalog.colours(docs.select(F.concat_ws("/", "source", "lang").alias("run"), F.array("source", "lang", F.lit("events.out.tfevents")).alias("path_parts")))


@query("WITH c AS (SELECT d AS dash, k AS phase, [1, 6, 2][d + 1] AS onn, [1, 9, 6][d + 1] AS period FROM range(3) a(d), range(40) b(k)) SELECT dash::INT AS dash, phase, period <= 1 OR phase % period < onn AS drawn FROM c")
def dash_cover(spark, sf):
    both = spark.range(3).select(F.col("id").cast("int").alias("dash"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("phase"))
    return both.withColumn("drawn", catalog.dash_covers(F.col("dash"), F.col("phase")))


# ---- axes and ranges ----


@query(f"WITH {P} SELECT run, min(wall) FILTER (wall <> 0) AS first_wall FROM p GROUP BY run")
def first_wall(spark, sf):
    return series.first_walls(tables.event_points(spark, sf))


@query(f"WITH {P}, w AS (SELECT run, min(wall) FILTER (wall <> 0) AS fw FROM p GROUP BY run) SELECT run, tag, step, round(wall - fw, 6) AS x FROM p JOIN w USING (run) WHERE tag = '{TAG}'")
def reltime_axis(spark, sf):
    return rounded(_xs(spark, sf, "reltime").select("run", "tag", "step", "x"), "x")


@query(f"WITH {P} SELECT run, tag, step, wall AS x FROM p WHERE tag = '{TAG}'")
def wall_axis(spark, sf):
    return _xs(spark, sf, "wall").select("run", "tag", "step", "x")


@query(f"WITH {XS}, {DOMAIN} SELECT xmin, xmax FROM dom")
def x_domain(spark, sf):
    return series.domain(_xs(spark, sf))


@query(f"WITH {XS}, {DOMAIN}, {shown(0.25, 0.5)} SELECT xmin, xmax, round(lo, 6) AS lo, round(hi, 6) AS hi FROM rng")
def view_range(spark, sf):
    return rounded(series.view_range(series.domain(_xs(spark, sf)), ZOOMED), "lo", "hi")


@query("""WITH q AS (SELECT l_returnflag || '/' || l_linestatus AS run, l_orderkey AS step, (l_orderkey * 8 + l_linenumber) * 4294967296 + l_partkey * 2048 + l_suppkey AS arrived, epoch_us(l_shipdate) / 1e6::DOUBLE AS x FROM lineitem),
e AS (SELECT run, arg_min(x, arrived) AS f, arg_max(x, arrived) AS l FROM q GROUP BY run) SELECT min(f) AS xmin, max(l) AS xmax FROM e""")
def x_domain_unordered_walls(spark, sf):
    return series.domain(series.with_x(tables.line_points(spark, sf), "wall"))


# ---- buckets, smoothing, axes of values ----


@query(f"WITH {XS}, {DOMAIN}, {shown(0.0, 1.0)}, {buckets_sql(COLUMNS)} SELECT run, tag, col, round(y, 6) AS y FROM b")
def bucket_mean(spark, sf):
    xs = _xs(spark, sf)
    placed = xs.crossJoin(F.broadcast(series.view_range(series.domain(xs), View())))
    return rounded(chart.bucket_means(placed, COLUMNS, F.col("lo"), F.col("hi")), "y")


ZOOM_SQL = f"WITH {XS}, {DOMAIN}, {shown(0.25, 0.5)}, {buckets_sql(COLUMNS)} SELECT run, tag, col, round(y, 6) AS y FROM b"


@query(ZOOM_SQL)
def bucket_zoom(spark, sf):
    xs = _xs(spark, sf)
    placed = xs.crossJoin(F.broadcast(series.view_range(series.domain(xs), ZOOMED)))
    return rounded(chart.bucket_means(placed, COLUMNS, F.col("lo"), F.col("hi")), "y")


@query(f"WITH {P} SELECT run, tag, 30 AS col, round(avg(value), 6) AS y FROM p WHERE step = 77 GROUP BY run, tag")
def bucket_degenerate(spark, sf):
    xs = series.with_x(tables.event_points(spark, sf), "step")
    return rounded(chart.bucket_means(xs, COLUMNS, 77.0, 77.0), "y")


@query(f"{DRAWN} SELECT run, tag, col, round(y, 6) AS y FROM e")
def ema_smooth(spark, sf):
    return rounded(_drawn(spark, sf), "y")


@query(f"WITH {XS}, {DOMAIN}, {shown(0.0, 1.0)}, {buckets_sql(COLUMNS)} SELECT run, tag, col, round(y, 6) AS y FROM b")
def ema_zero_weight(spark, sf):
    return rounded(chart.curves(tables.event_points(spark, sf), Chart(TAG, smoothing=0.0, px_w=COLUMNS)), "y")


@query(f"{DRAWN} SELECT run, tag, col, round(log10(y - 20), 6) AS y FROM e WHERE y - 20 > 0 AND NOT isnan(y)")
def log_y(spark, sf):
    return rounded(chart.log_y(_drawn(spark, sf).withColumn("y", F.col("y") - 20)), "y")


@query(f"{DRAWN}, {Y_RANGE} SELECT round(vmin, 6) AS vmin, round(vmax, 6) AS vmax FROM yr")
def y_range_padded(spark, sf):
    return rounded(chart.y_range(_drawn(spark, sf)), "vmin", "vmax")


@query(f"{PIXELS} SELECT * FROM px")
def to_pixel(spark, sf):
    return chart.pixels(_drawn(spark, sf), CHART.px_h)


_SEGMENTS = f"{PIXELS}, sg AS (SELECT run, tag, coalesce(lag(px) OVER w, px) AS px0, coalesce(lag(py) OVER w, py) AS py0, px AS px1, py AS py1 FROM px WINDOW w AS (PARTITION BY run, tag ORDER BY px))"


@query(f"{_SEGMENTS} SELECT * FROM sg")
def segments(spark, sf):
    return chart.segments(chart.pixels(_drawn(spark, sf), CHART.px_h))


_DOTS = f"""{_SEGMENTS}, le AS (SELECT *, greatest(abs(px1 - px0), abs(py1 - py0)) AS n FROM sg),
bf AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY run ORDER BY px1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM le),
wk AS (SELECT *, unnest(range(0, n + 1)) AS k FROM bf),
dt AS (SELECT run, (px0 + sign(px1 - px0) * ((2 * k * abs(px1 - px0) + n) // greatest(2 * n, 1)))::INT AS px,
  (py0 + sign(py1 - py0) * ((2 * k * abs(py1 - py0) + n) // greatest(2 * n, 1)))::INT AS py, before + k AS phase FROM wk)"""


@query(f"{_DOTS} SELECT * FROM dt")
def line_dots(spark, sf):
    return raster.dots(chart.segments(chart.pixels(_drawn(spark, sf), CHART.px_h)))


@query(f"""{_DOTS}, c AS (SELECT (py // 4)::INT AS row, (px // 2)::INT AS cell, bit_or(CASE WHEN py % 4 < 3 THEN 1 << (py % 4 + 3 * (px % 2)) ELSE 64 << (px % 2) END)::INT AS bits FROM dt
WHERE px BETWEEN 0 AND {COLUMNS - 1} AND py BETWEEN 0 AND 39 GROUP BY ALL) SELECT row, cell, bits, chr(10240 + bits) AS char FROM c""")
def braille_cells(spark, sf):
    dots = raster.dots(chart.segments(chart.pixels(_drawn(spark, sf), CHART.px_h)))
    return raster.cells(dots, COLUMNS, CHART.px_h).drop("color_slot")


@query(f"""{_DOTS}, c AS (SELECT py // 4 AS row, px // 2 AS cell, chr((10240 + bit_or(CASE WHEN py % 4 < 3 THEN 1 << (py % 4 + 3 * (px % 2)) ELSE 64 << (px % 2) END))::INT) AS ch FROM dt GROUP BY ALL),
g AS (SELECT r AS row, k AS cell, coalesce(ch, ' ') AS ch FROM range(10) a(r) CROSS JOIN range({COLUMNS // 2}) b(k) LEFT JOIN c ON c.row = r AND c.cell = k)
SELECT row::INT AS row, string_agg(ch, '' ORDER BY cell) AS line FROM g GROUP BY row""")
def braille_rows(spark, sf):
    dots = raster.dots(chart.segments(chart.pixels(_drawn(spark, sf), CHART.px_h)))
    return raster.text_rows(raster.cells(dots, COLUMNS, CHART.px_h), COLUMNS // 2, CHART.px_h // 4)


# ---- points at a cursor, order, thinning, counts ----


@query(f"""WITH {XS}, {DOMAIN}, {shown(0.0, 1.0)}, cur AS (SELECT lo + (hi - lo) * 29::DOUBLE / 59::DOUBLE AS place FROM rng), rn AS (SELECT DISTINCT run, tag, place FROM xs, cur)
SELECT rn.run, rn.tag, xs.step, xs.value FROM rn ASOF JOIN xs ON rn.run = xs.run AND rn.place >= xs.x""")
def asof_cursor(spark, sf):
    xs = _xs(spark, sf)
    at = series.cursor_x(series.view_range(series.domain(xs), View()), 0.5, COLUMNS).select("cursor_x")
    return series.as_of(xs.crossJoin(F.broadcast(at)), F.col("cursor_x"))


@query(f"WITH {P12} SELECT DISTINCT run FROM p WHERE tag = '{TAG}' ORDER BY run LIMIT 8")
def legend_limit(spark, sf):
    return layout.legend(tables.event_points(spark, sf, 12).where(F.col("tag") == TAG).select("run").distinct())


THIN = """n AS (SELECT *, row_number() OVER (PARTITION BY run, tag ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY run, tag) AS n FROM p),
k AS (SELECT n.*, (SELECT min(1::BIGINT << s) FROM range(40) t(s) WHERE ceil(n / (1::BIGINT << s)::DOUBLE) <= 100) AS stride FROM n)"""


@query(f"WITH {P}, {THIN} SELECT run, tag, step, wall, value, stride FROM k WHERE i % stride = 0")
def thin_even(spark, sf):
    return thin.thin(tables.event_points(spark, sf), 100).select(*POINTS, "stride")


@query(f"WITH {P}, {THIN} SELECT count(*)::BIGINT AS total_points, count(*) FILTER (i % stride = 0)::BIGINT AS stored_points, max(stride)::BIGINT AS max_stride FROM k")
def thin_summary(spark, sf):
    return thin.summary(tables.event_points(spark, sf), 100)


@query(f"WITH {P} SELECT run, tag, count(*)::BIGINT AS n_points FROM p GROUP BY ALL")
def series_lengths(spark, sf):
    return series.lengths(tables.event_points(spark, sf))


@query(f"WITH {P} SELECT run, tag, count(*)::BIGINT AS n_points FROM p GROUP BY ALL ORDER BY n_points DESC, run DESC, tag DESC LIMIT 1")
def longest_series(spark, sf):
    return series.longest(tables.event_points(spark, sf))


@query(f"""WITH {P12}, r AS (SELECT run, row_number() OVER (ORDER BY run) <= 8 AS enabled FROM (SELECT DISTINCT run FROM p)), {THIN}
SELECT (SELECT count(*) FROM r WHERE enabled)::BIGINT AS runs_on, (SELECT count(*) FROM r)::BIGINT AS runs_total,
 (SELECT count(DISTINCT tag) FROM p JOIN r USING (run) WHERE enabled)::BIGINT AS n_tags, (SELECT count(*) FROM p)::BIGINT AS total_points, (SELECT max(stride) FROM k)::BIGINT AS max_stride""")
def header_summary(spark, sf):
    points = tables.event_points(spark, sf, 12)
    return catalog.header(points, catalog.cap_runs(points.select("run").distinct(), 8), 100)


_LINES = "q AS (SELECT l_returnflag || '/' || l_linestatus AS run, 'price' AS tag, l_orderkey AS step, epoch_us(l_shipdate) / 1e6::DOUBLE AS wall, l_extendedprice AS value, (l_orderkey * 8 + l_linenumber) * 4294967296 + l_partkey * 2048 + l_suppkey AS arrived FROM lineitem)"


@query(f"WITH {_LINES} SELECT run, tag, step, wall, value, row_number() OVER (PARTITION BY run, tag ORDER BY step, arrived)::BIGINT AS place FROM q")
def out_of_order_sort(spark, sf):
    return series.sorted_series(series.numbered(tables.line_points(spark, sf))).select(*POINTS, "place")


@query(f"WITH {_LINES}, w AS (SELECT run, tag, wall, lag(wall) OVER (PARTITION BY run, tag ORDER BY arrived) AS before FROM q) SELECT run, tag, count(*) FILTER (wall < before)::BIGINT AS backwards FROM w GROUP BY ALL")
def backward_steps(spark, sf):
    return series.backward_steps(tables.line_points(spark, sf).withColumn("step", F.col("wall").cast("long")))


# ---- the tag tree ----


@query(f"WITH {TREE} SELECT path, tag IS NOT NULL AS is_tag, leaves, children FROM nodes")
def tag_tree(spark, sf):
    return tree.nodes(_page_tags(spark, sf)).select("path", "is_tag", "leaves", "children")


@query(f"WITH {TREE} SELECT path, label, depth, leaf, leaves, tag FROM comp")
def tag_tree_compressed(spark, sf):
    return tree.compressed(_page_tags(spark, sf)).select("path", "label", "depth", "leaf", "leaves", "tag")


@query(f"WITH {TREE} SELECT depth, label, path, leaf, leaves, NOT leaf AND depth = 0 AS expanded, tag FROM comp WHERE depth <= 1")
def tag_tree_visible(spark, sf):
    return tree.visible_rows(_page_tags(spark, sf))


@query(f"WITH {TREE} SELECT depth, label, path, leaf, leaves, NOT leaf AS expanded, tag FROM comp")
def tag_tree_filtered(spark, sf):
    return tree.visible_rows(_page_tags(spark, sf), force_open=True)


@query(f"WITH {TREE} SELECT path, parent FROM comp")
def tag_parents(spark, sf):
    return tree.parent_of(tree.compressed(_page_tags(spark, sf)))


@query(f"""WITH {TREE}, al AS (SELECT tag, list_filter(string_split(tag, '/'), lambda x: x <> '') AS seg FROM t),
be AS (SELECT tag, array_to_string(list_slice(seg, 1, k), '/') AS path, array_to_string(seg, '/') AS own FROM (SELECT tag, seg, unnest(range(1, len(seg) + 1)) AS k FROM al))
SELECT path, coalesce(min(be.tag) FILTER (own = path), min(be.tag)) AS first_tag FROM be WHERE path IN (SELECT path FROM comp) GROUP BY path""")
def first_leaf(spark, sf):
    return tree.first_leaves(_page_tags(spark, sf))


@query(f"WITH {P12}, {TREE}, a AS (SELECT max(length(run)) + 6 AS w FROM p UNION ALL SELECT max(4 + 2 * depth + length(label) + CASE WHEN leaf THEN 0 ELSE 5 END) FROM comp WHERE depth <= 1) SELECT greatest(24, least(max(w), 46))::INT AS width FROM a")
def sidebar_width(spark, sf):
    return layout.sidebar_width(_runs12(spark, sf), tree.visible_rows(_page_tags(spark, sf)), 200)


@query(f"WITH {PAGE_TAGS}, o AS (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS k FROM t) SELECT tag, k - 9 AS slot FROM o WHERE k BETWEEN 9 AND 17")
def grid_page(spark, sf):
    return layout.grid_page(_page_tags(spark, sf), 13, 9)


# ---- labels and ticks ----

_FMT = """CASE WHEN v <> 0 AND (abs(v) < 1e-3 OR abs(v) >= 1e5) THEN regexp_replace(printf('%.3e', v), 'e([+]?)(-?)0*([0-9])', 'e\\2\\3')
 WHEN abs(v) >= 100 THEN printf('%.1f', v) ELSE CASE WHEN rtrim(rtrim(printf('%.4f', v), '0'), '.') IN ('', '-') THEN '0' ELSE rtrim(rtrim(printf('%.4f', v), '0'), '.') END END"""
_DURATION = """CASE WHEN s < 60 THEN printf('%.0f', s) || 's' WHEN floor(s) < 3600 THEN (floor(s)::BIGINT // 60) || 'm' || lpad((floor(s)::BIGINT % 60)::VARCHAR, 2, '0') || 's'
 WHEN floor(s) < 172800 THEN (floor(s)::BIGINT // 3600) || 'h' || lpad((floor(s)::BIGINT // 60 % 60)::VARCHAR, 2, '0') || 'm'
 ELSE (floor(s)::BIGINT // 86400) || 'd' || lpad((floor(s)::BIGINT // 3600 % 24)::VARCHAR, 2, '0') || 'h' END"""
_COUNT = "CASE WHEN n >= 1000000 THEN printf('%.1f', n / 1e6::DOUBLE) || 'M' WHEN n >= 10000 THEN printf('%.0f', n / 1e3::DOUBLE) || 'k' ELSE n::VARCHAR END"


@query(f"WITH v AS (SELECT l_linenumber, l_orderkey, (l_extendedprice - 30000.0::DOUBLE) * pow(10::DOUBLE, l_linenumber * 2 - 10) AS v FROM lineitem) SELECT l_orderkey, l_linenumber, {_FMT} AS label FROM v")
def fmt_num(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    v = (F.col("l_extendedprice") - F.lit(30000.0)) * F.pow(F.lit(10.0), (F.col("l_linenumber") * 2 - 10).cast("double"))
    return t.select("l_orderkey", "l_linenumber", text.number(v).alias("label"))


@query(f"WITH v AS (SELECT event_id, greatest(value * (event_id % 997) * 2 - 50, 0)::DOUBLE AS s FROM events) SELECT event_id, {_DURATION} AS label FROM v")
def fmt_duration(spark, sf):
    t = spark.read.parquet(f"{sf}/events.parquet")
    return t.select("event_id", text.duration((F.col("value") * (F.col("event_id") % 997) * 2 - 50).cast("double")).alias("label"))


@query(f"WITH v AS (SELECT event_id, event_id * event_id // 7 AS n FROM events) SELECT event_id, {_COUNT} AS label FROM v")
def fmt_count(spark, sf):
    t = spark.read.parquet(f"{sf}/events.parquet")
    return t.select("event_id", text.count(F.expr("event_id * event_id div 7")).alias("label"))


@query(f"WITH {P}, v AS (SELECT step, wall, wall - min(wall) OVER () AS s, step AS n FROM p) SELECT step, {_COUNT} AS step_label, {_DURATION} AS span_label, strftime(make_timestamp((wall::BIGINT - CASE WHEN wall::BIGINT > wall THEN 1 ELSE 0 END) * 1000000), '%H:%M:%S') AS wall_label FROM v")
def fmt_x(spark, sf):
    p = tables.event_points(spark, sf)
    first = F.broadcast(p.agg(F.min("wall").alias("first")))
    both = p.crossJoin(first)
    return both.select(
        "step", text.x_value(F.col("step").cast("double"), "step").alias("step_label"), text.x_value(F.col("wall") - F.col("first"), "reltime").alias("span_label"), text.x_value(F.col("wall"), "wall").alias("wall_label"),
    )


def _ticks(source: str, n: int) -> str:
    return f"""m1 AS (SELECT *, (hi - lo) / {n - 1} AS raw FROM {source}), m2 AS (SELECT *, pow(10::DOUBLE, floor(log10(raw))) AS mag FROM m1),
m3 AS (SELECT *, CASE WHEN mag >= raw THEN mag WHEN mag * 2 >= raw THEN mag * 2 WHEN mag * 2.5::DOUBLE >= raw THEN mag * 2.5::DOUBLE WHEN mag * 5 >= raw THEN mag * 5 ELSE mag * 10 END AS st FROM m2),
m4 AS (SELECT *, ceil(lo / st) * st AS f FROM m3), m5 AS (SELECT *, unnest(range(0, greatest(floor((hi + st * 1e-9::DOUBLE - f) / st)::BIGINT, 0) + 1)) AS k FROM m4),
ti AS (SELECT *, CASE WHEN abs(f + k * st) < st * 1e-9::DOUBLE THEN 0 ELSE f + k * st END AS tick FROM m5 WHERE f + k * st <= hi + st * 1e-9::DOUBLE)"""


@query(f"WITH src AS (SELECT p_partkey, p_retailprice - 1000 AS lo, p_retailprice - 1000 + greatest(p_size, 1) AS hi FROM part), {_ticks('src', 5)} SELECT p_partkey, round(tick, 6) AS tick FROM ti")
def nice_ticks(spark, sf):
    t = spark.read.parquet(f"{sf}/part.parquet")
    lo = F.col("p_retailprice") - 1000
    return t.select("p_partkey", F.explode(ticks.nice_ticks(lo, lo + F.greatest("p_size", F.lit(1)), 5)).alias("tick")).withColumn("tick", F.round("tick", 6))


@query(f"""{DRAWN}, {Y_RANGE}, src AS (SELECT vmin AS lo, vmax AS hi FROM yr), {_ticks('src', 3)}, v AS (SELECT *, tick AS v FROM ti)
SELECT round(tick, 6) AS tick, greatest(least((39 - round((tick - lo) / (hi - lo) * 39))::BIGINT // 4, 9), 0)::INT AS row, left({_FMT}, 9) AS label FROM v""")
def y_tick_rows(spark, sf):
    return rounded(ticks.y_ticks(chart.y_range(_drawn(spark, sf)), CHART.px_h // 4), "tick")


@query(f"""WITH {XS}, {DOMAIN}, {shown(0.0, 1.0)}, v AS (SELECT k::INT AS i, lo + (hi - lo) * (k / 3::DOUBLE) AS x, greatest(round(lo + (hi - lo) * (k / 3::DOUBLE)), 0)::BIGINT AS n, k / 3::DOUBLE AS part FROM rng, range(4) t(k)),
l AS (SELECT *, {_COUNT} AS label FROM v)
SELECT i, round(x, 6) AS x, label, greatest(least(floor(part * 69)::INT - CASE WHEN i = 3 THEN length(label) ELSE 0 END, greatest(70 - length(label) - 1, 0)), 0)::INT AS at FROM l""")
def x_labels(spark, sf):
    return rounded(ticks.x_labels(series.view_range(series.domain(_xs(spark, sf)), View()), 70, "step"), "x")


@query(f"WITH {PAGE_TAGS} SELECT tag, CASE WHEN length(tag) <= 20 THEN tag ELSE left(tag, 10) || '…' || right(tag, 9) END AS label FROM t")
def elide(spark, sf):
    return _page_tags(spark, sf).select("tag", text.elide(F.col("tag"), 20).alias("label"))


# ---- event files ----

def _logdir(spark: SparkSession, points: DataFrame, tensor: bool = False) -> str:
    top = scratch.folder(spark, "logdir")
    datasource.write(points, top, tensor)
    return top


def _append(top: str, tail: bytes) -> None:
    """Appends bytes to every event file of a folder."""
    for f in files.discover(top):
        system, at = FileSystem.from_uri(f.path) if "://" in f.path else (LocalFileSystem(), f.path)
        with system.open_append_stream(at) as out:
            out.write(tail)


@query(STORED)
def tfevents_roundtrip(spark, sf):
    return datasource.read(spark, _logdir(spark, tables.event_points(spark, sf))).select(*POINTS)


@query(STORED)
def tfevents_tensors(spark, sf):
    return datasource.read(spark, _logdir(spark, tables.event_points(spark, sf), tensor=True)).select(*POINTS)


@query(STORED)
def tfevents_corrupt(spark, sf):
    top = _logdir(spark, tables.event_points(spark, sf))
    _append(top, wire.frame(b"\x0b damaged") + wire.frame(wire.encode_event("never", 1, 1.0, 1.0)))
    return datasource.read(spark, top).select(*POINTS)


@query(STORED)
def tfevents_partial(spark, sf):
    top = _logdir(spark, tables.event_points(spark, sf))
    _append(top, wire.frame(wire.encode_event("not yet", 1, 1.0, 1.0))[:-7])
    return datasource.read(spark, top).select(*POINTS)


@query(f"WITH {P} SELECT DISTINCT run, 'damaged record' AS error FROM p")
def tfevents_errors(spark, sf):
    top = _logdir(spark, tables.event_points(spark, sf))
    _append(top, wire.frame(b"\x0b damaged"))
    return datasource.read(spark, top, "errors").select("run", "error").distinct()


@query(f"WITH {P} SELECT DISTINCT run FROM p UNION ALL SELECT 'empty'")
def run_without_scalars(spark, sf):
    top = _logdir(spark, tables.event_points(spark, sf))
    system, at = FileSystem.from_uri(top) if "://" in top else (LocalFileSystem(), top)
    system.create_dir(f"{at}/empty")
    with system.open_output_stream(f"{at}/empty/events.out.tfevents.0") as out:
        out.write(b"")
    return catalog.runs(datasource.read(spark, top, "files"))


@query(STORED)
def stream_tail(spark, sf):
    """Points that arrive in two parts, each followed until nothing is new."""
    points = tables.event_points(spark, sf)
    half = points.agg(F.max("step")).first()[0] // 2
    top, out = scratch.folder(spark, "logdir"), scratch.folder(spark, "live")
    state = scratch.folder(spark, "state")
    options = Options(top, follow=False, max_points=0)
    for part in (points.where(F.col("step") <= half), points.where(F.col("step") > half)):
        datasource.write(part, top)
        live.follow(spark, options, out, state).awaitTermination()
    return live.live_points(spark, out).select(*POINTS)


@query("""WITH r AS (SELECT * FROM (VALUES ('baseline', 1.0::DOUBLE), ('high_lr', 2.2::DOUBLE), ('low_lr/warmup', 0.4::DOUBLE)) v(run, lr)),
b AS (SELECT run, lr, k AS step, k::DOUBLE AS i, 2.5::DOUBLE * exp(-3.0::DOUBLE * lr * k / 100) + 0.08::DOUBLE AS loss FROM r, range(2000) t(k)),
c AS (SELECT run, step, 'train/loss' AS tag, loss AS value FROM b UNION ALL SELECT run, step, 'train/accuracy', greatest(0, least(1, 1 - 0.9::DOUBLE * exp(-2.5::DOUBLE * lr * i / 100))) FROM b
 UNION ALL SELECT run, step, 'train/lr', lr * 0.5::DOUBLE * (1 + cos(pi() * least(i / 2000, 1))) FROM b UNION ALL SELECT run, step, 'train/grad_norm', exp(-i / 4000) FROM b
 UNION ALL SELECT run, step, 'val/loss', loss + 0.15::DOUBLE FROM b WHERE step % 25 = 0)
SELECT run, tag, step, round(value, 9) AS value FROM c""")
def demo_curves(spark, sf):
    return rounded(demo.curves(spark, 2000, noise=0).select("run", "tag", "step", "value"), "value", digits=9)


from curvemill.plans import live_queries, screen_queries  # noqa: E402  registers more

__all__ = ["ORACLE_SQL", "QUERIES", "live_queries", "screen_queries"]
