import math
import random

import pytest
from pyspark.sql import functions as F

from curvemill.functions import terminal, text, ticks
from curvemill.operators import catalog, chart, layout, raster, series, thin, tree
from curvemill.schema import POINTS, Chart, Options, View

INF, NAN = float("inf"), float("nan")


def points(spark, rows):
    """(run, tag, step, wall, value) rows in order of arrival."""
    return spark.createDataFrame([(*r, "f", i, 0) for i, r in enumerate(rows)], POINTS)


def column(df, name):
    return [r[name] for r in df.collect()]


def scan(xs, ys, x0, x1, n):
    """Bucket means by walking edges."""
    span, out, at = x1 - x0, [], 0
    inside = [(x, y) for x, y in zip(xs, ys) if x0 <= x <= x1]
    if span <= 0:
        return [(n // 2, sum(y for _, y in inside) / len(inside))] if inside else []
    for c in range(n):
        edge, got = x0 + span * (c + 1) / n, []
        while at < len(inside) and inside[at][0] <= edge:
            got.append(inside[at][1])
            at += 1
        if got:
            out.append((c, sum(got) / len(got)))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_buckets_follow_the_edges(spark, seed):
    r = random.Random(seed)
    scale = r.choice([1, 1e-3, 1e9])
    xs = sorted(r.choice([r.random(), r.randrange(20) / 7]) * scale for _ in range(60))
    ys = [r.random() for _ in xs]
    n = r.randrange(1, 50)
    x0, x1 = sorted(r.sample(xs, 2))
    rows = spark.createDataFrame([("r", "t", x, y) for x, y in zip(xs, ys)], "run string, tag string, x double, value double")
    got = {c: y for c, y in chart.bucket_means(rows, n, x0, x1).select("col", "y").collect()}
    want = dict(scan(xs, ys, x0, x1, n))
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_bucket_guards(spark):
    rows = spark.createDataFrame([("r", "t", 1.0, 2.0), ("r", "t", 1.0, 4.0)], "run string, tag string, x double, value double")
    assert [tuple(r) for r in chart.bucket_means(rows, 9, 1.0, 1.0).select("col", "y").collect()] == [(4, 3.0)]
    assert chart.bucket_means(rows, 0, 0.0, 2.0).count() == 0 == chart.bucket_means(rows, 9, 2.0, 0.0).count()


@pytest.mark.parametrize(("step", "col"), [(5, 0), (1 << 20, 5)])
def test_single_points(spark, step, col):
    got = chart.curves(points(spark, [("r", "t", step, 1.0, 7.0)]), Chart("t", px_w=10)).collect()
    assert [(r["col"], r["y"]) for r in got] == [(col, 7.0)]


def test_smoothing(spark):
    rows = [("r", "t", c, v) for c, v in enumerate([1.0, 3.0, NAN, 2.0])] + [("s", "t", 4, 5.0)] + [("k", "t", 2 * c, 1.0) for c in range(10)]
    df = spark.createDataFrame(rows, "run string, tag string, col int, y double")
    got = {(r["run"], r["col"]): r["y"] for r in chart.smooth(df, 0.9).collect()}
    assert got["r", 0] == pytest.approx(1) and got["r", 1] == pytest.approx((0.09 + 0.3) / 0.19) and math.isnan(got["r", 2]) and math.isnan(got["r", 3])
    assert got["s", 4] == 5.0 and all(abs(got["k", 2 * c] - 1) < 1e-9 for c in range(10))
    assert chart.smooth(df, 0) is df


def test_value_axis(spark):
    def frame(*values):
        return spark.createDataFrame([("r", "t", i, v) for i, v in enumerate(values)], "run string, tag string, col int, y double")

    assert tuple(chart.y_range(frame(0.0, NAN, 10.0)).first()) == (-0.5, 10.5)
    assert tuple(chart.y_range(frame(5.0, 5.0)).first()) == (4.5, 5.5) and tuple(chart.y_range(frame(0.0)).first()) == (-1.0, 1.0)
    assert tuple(chart.y_range(frame(NAN)).first()) == (None, None)
    assert column(chart.log_y(frame(100.0, 0.0, -1.0, NAN)), "y") == [2.0]
    pixel = frame(0.0, NAN, 1.0).select(chart.to_pixel(F.col("y"), F.lit(0.0), F.lit(1.0), 39).alias("p"))
    assert column(pixel, "p") == [39, 39, 0]


def test_axes_and_domain(spark):
    rows = [("a", "t", 2, 10.0, 1.0), ("a", "t", 1, 30.0, 2.0), ("a", "u", 1, 5.0, 0.0), ("a", "u", 2, 0.0, 0.0), ("b", "t", 1, 0.0, 3.0)]
    p = points(spark, rows)
    assert {r["run"]: r["first_wall"] for r in series.first_walls(p).collect()} == {"a": 5.0, "b": None}
    own = series.with_x(p.where("tag = 't'"), "reltime", series.first_walls(p))
    assert sorted((r["run"], r["x"]) for r in own.collect()) == [("a", 5.0), ("a", 25.0), ("b", 0.0)]
    assert tuple(series.domain(series.with_x(p.where("run = 'a' and tag = 't'"), "wall")).first()) == (30.0, 10.0)
    got = series.view_range(spark.createDataFrame([(0.0, 10.0)], "xmin double, xmax double"), View(0.2, 0.7)).first()
    assert (got["lo"], got["hi"]) == (2.0, 7.0)


def test_as_of(spark):
    p = series.with_x(points(spark, [("a", "t", 1, 0.0, 1.0), ("a", "t", 3, 0.0, 2.0), ("a", "t", 3, 0.0, 5.0), ("b", "t", 9, 0.0, 3.0)]), "step")
    assert [tuple(r) for r in series.as_of(p, 4.0).collect()] == [("a", "t", 3, 5.0)]
    assert series.as_of(p, 0.5).count() == 0


def test_order(spark):
    p = points(spark, [("r", "t", 5, 0.0, 0.5), ("r", "t", 1, 0.0, 0.1), ("r", "t", 3, 0.0, 0.3), ("r", "t", 3, 0.0, 0.2)])
    assert column(series.sorted_series(p), "value") == [0.1, 0.3, 0.2, 0.5]
    assert column(series.backward_steps(p), "backwards") == [1]


@pytest.mark.parametrize(("n", "cap"), [(64_000, 1000), (20_000, 500), (10_000, 300), (999, 1000), (1000, 1000), (1001, 1000), (50_000, 0), (1, 1), (5, 1)])
def test_thinning(spark, n, cap):
    p = spark.range(n).selectExpr("'r' run", "'t' tag", "id step", "double(id) wall", "2.0 * id value", "'f' path", "id rec_off", "0 val_idx")
    stride = 1
    while cap and -(-n // stride) > cap:
        stride *= 2
    assert sorted(column(thin.thin(p, cap), "step")) == list(range(0, n, stride))
    assert tuple(thin.summary(p, cap).first()) == (n, -(-n // stride), stride)


def test_thinning_golden_counts(spark):
    lengths = spark.createDataFrame([(80_000,)] * 12 + [(3_200,)] * 3, "n long")
    for cap, stored, most in ((0, 969_600, 1), (10_000, 129_600, 8), (1_000, 9_900, 128)):
        s = lengths.withColumn("s", thin.stride_of(F.col("n"), cap))
        assert tuple(s.agg(F.sum(F.ceil(F.col("n") / F.col("s"))), F.max("s")).first()) == (stored, most)


def test_run_cap_and_toggles(spark):
    runs = spark.createDataFrame([(f"run{i:03}",) for i in range(20)], "run string")
    on = lambda t: sorted(column(t.where("enabled"), "run"))
    capped = catalog.cap_runs(runs, 3)
    assert on(capped) == ["run000", "run001", "run002"] and len(on(catalog.cap_runs(runs, 0))) == 20
    chosen = capped.withColumn("enabled", F.col("enabled") | F.col("run").isin("run004", "run005", "run006", "run007", "run008"))
    late = catalog.admit_runs(chosen, spark.createDataFrame([("run999",)], "run string"), 3)
    assert len(on(late)) == 8 and "run999" not in on(late)
    assert on(catalog.solo(capped, "run009")) == ["run009"] and "run000" not in on(catalog.toggle(capped, "run000"))
    mixed = spark.createDataFrame([("lr_high", True), ("lr_low", False), ("baseline", True)], "run string, enabled boolean")
    assert on(catalog.toggle_all(mixed, "LR_")) == ["baseline", "lr_high", "lr_low"]
    assert on(catalog.toggle_all(catalog.toggle_all(mixed, "lr_"), "lr_")) == ["baseline"]
    assert column(catalog.filter_runs(spark.createDataFrame([("lr_a",), ("lrXa",)], "run string"), "LR_"), "run") == ["lr_a"]
    assert catalog.hidden_notice(capped).first()["notice"] == "20 runs found, 3 shown"


def test_colours(spark):
    files = spark.createDataFrame([("a-x", ["a-x", "f"]), ("a/b", ["a", "b", "f"])] + [(f"r{i:02}", [f"r{i:02}", "f"]) for i in range(20)], "run string, path_parts array<string>")
    got = {r["run"]: (r["color_slot"], r["hue"], r["dash"], r["marker"]) for r in catalog.colours(files).collect()}
    assert got["a/b"][0] == 0 and got["a-x"][0] == 1 and got["r06"] == (8, 0, 1, "◆") and got["r19"] == (21, 5, 2, "▪")
    known = spark.createDataFrame([("mmm", 0), ("zzz", 1)], "run string, color_slot int")
    found = spark.createDataFrame([("aaa", ["aaa", "f"]), ("zzz", ["zzz", "f"])], "run string, path_parts array<string>")
    assert {r["run"]: r["color_slot"] for r in catalog.assign_slots(known, found).collect()} == {"mmm": 0, "zzz": 1, "aaa": 2}
    assert terminal.colour_depth({"COLORTERM": "truecolor"}) == "truecolor" and terminal.colour_depth({"TERM": "xterm-256color"}) == "256" and terminal.colour_depth({}) == "basic"
    for depth in ("truecolor", "256", "basic"):
        assert len({terminal.hue_colour(h, depth) for h in range(8)}) == 8


def rows_of(spark, tags, state=None, force=False):
    df = spark.createDataFrame([(t,) for t in tags], "tag string")
    return [(r["depth"], r["label"], r["leaves"]) for r in tree.visible_rows(df, state, force).collect()]


def test_tree(spark):
    assert rows_of(spark, ["train/loss", "train/accuracy", "val/loss"]) == [(0, "train", 2), (1, "accuracy", 1), (1, "loss", 1), (0, "val/loss", 1)]
    deep = [f"data_profiler/{g}/{m}_loss" for g in ("legal", "swh") for m in ("mean", "std")]
    assert rows_of(spark, deep) == [(0, "data_profiler", 4), (1, "legal", 2), (1, "swh", 2)]
    assert len(rows_of(spark, deep, {"data_profiler/swh": True})) == 5 and rows_of(spark, deep, {"data_profiler": False}) == [(0, "data_profiler", 4)]
    assert rows_of(spark, ["a/b/c/metric", "a/b/c/other", "some/deep/lonely"]) == [(0, "a/b/c", 2), (1, "metric", 1), (1, "other", 1), (0, "some/deep/lonely", 1)]
    assert rows_of(spark, ["loss", "loss/train", "loss/val"]) == [(0, "loss", 3), (1, "train", 1), (1, "val", 1)]
    assert len(rows_of(spark, ["a/b/x", "a/c/y"], {"a": False}, True)) == 3
    assert rows_of(spark, ["a-b/x", "a/x", "", "/"]) == [(0, "a/x", 1), (0, "a-b/x", 1)]


def test_first_leaf_knows_original_tags(spark):
    df = spark.createDataFrame([("p/g1/a",), ("p/g1/b",), ("p/g2/c",), ("loss",), ("loss/x",), ("q//z",)], "tag string")
    got = {r["path"]: r["first_tag"] for r in tree.first_leaves(df).collect()}
    assert got["p/g1"] == "p/g1/a" and got["p/g2/c"] == "p/g2/c" and got["loss"] == "loss" and got["q/z"] == "q//z"


@pytest.mark.parametrize(
    ("v", "want"),
    [(0.0, "0"), (NAN, "nan"), (INF, "inf"), (-INF, "-inf"), (1e-3, "0.001"), (9.9e-4, "9.900e-4"), (1e5, "1.000e5"), (123456.0, "1.235e5"), (99999.0, "99999.0"), (100.0, "100.0"), (12.5, "12.5"), (1.00005, "1.0001"), (234.35, "234.3"), (-0.25, "-0.25"), (1e-300, "1.000e-300")],
)
def test_numbers(spark, v, want):
    assert spark.range(1).select(text.number(F.lit(v)).alias("x")).first()["x"] == want


def test_durations_and_counts(spark):
    spans = {0.0: "0s", -5.0: "0s", 12.5: "12s", 59.7: "60s", 60.0: "1m00s", 3599.9: "59m59s", 3600.0: "1h00m", 172_799.0: "47h59m", 172_800.0: "2d00h"}
    got = spark.createDataFrame([(k,) for k in spans], "s double").select("s", text.duration(F.col("s")).alias("x")).collect()
    assert {r["s"]: r["x"] for r in got} == spans
    counts = {0: "0", 9_999: "9999", 10_000: "10k", 12_500: "12k", 999_999: "1000k", 1_000_000: "1.0M", 1_150_000: "1.1M"}
    got = spark.createDataFrame([(k,) for k in counts], "n long").select("n", text.count(F.col("n")).alias("x")).collect()
    assert {r["n"]: r["x"] for r in got} == counts
    got = spark.createDataFrame([(86_399.9,), (-1.5,), (0.0,)], "x double").select(text.x_value(F.col("x"), "wall").alias("x"))
    assert column(got, "x") == ["23:59:59", "23:59:59", "00:00:00"]


def test_elide(spark):
    got = spark.createDataFrame([("swh_contents_java_0123456789_abc_bd912224",), ("abcdef",)], "s string")
    assert column(got.select(text.elide(F.col("s"), 20).alias("x")), "x") == ["swh_conten…_bd912224", "abcdef"]
    assert column(got.select(text.elide(F.col("s"), 3).alias("x")), "x") == ["s…4", "a…f"]


@pytest.mark.parametrize(("lo", "hi", "n", "want"), [(0.0, 1.0, 5, [0, 0.25, 0.5, 0.75, 1.0]), (-1.0, 1.0, 3, [-1, 0, 1]), (3.0, 3.0, 4, [3]), (0.0, INF, 4, []), (NAN, 1.0, 4, []), (0.0, 1.0, 1, []), (98.0, 103.0, 4, [98, 100, 102])])
def test_ticks(spark, lo, hi, n, want):
    got = spark.range(1).select(ticks.nice_ticks(F.lit(lo), F.lit(hi), n).alias("x")).first()["x"]
    assert got == pytest.approx(want)


def midpoint_line(x0, y0, x1, y1):
    """The dots of a line by the error of each step."""
    dots, dx, dy = [], abs(x1 - x0), abs(y1 - y0)
    sx, sy, e = (1 if x1 > x0 else -1), (1 if y1 > y0 else -1), dx - dy
    while True:
        dots.append((x0, y0))
        if (x0, y0) == (x1, y1):
            return dots
        twice = 2 * e
        if twice >= -dy:
            e, x0 = e - dy, x0 + sx
        if twice <= dx:
            e, y0 = e + dx, y0 + sy


def test_lines(spark):
    ends = [(0, 0, x, y) for x in range(-7, 8) for y in range(-7, 8)]
    df = spark.createDataFrame(ends, "a long, b long, c long, d long")
    got = df.select("*", raster.line_dots(*map(F.col, "abcd")).alias("dots")).collect()
    assert all([tuple(x) for x in r["dots"]] == midpoint_line(*r[:4]) for r in got)


def test_canvas(spark):
    seg = spark.createDataFrame([("r", "t", 0, 0, 0, 0), ("r", "t", 0, 0, 19, 7)], "run string, tag string, px0 long, py0 long, px1 long, py1 long")
    dots = raster.dots(seg)
    assert sorted(column(dots, "phase")) == list(range(21))
    lines = column(raster.text_rows(raster.cells(dots, 20, 8), 10, 2), "line")
    assert all(len(x) == 10 for x in lines) and any("⠀" < c <= "⣿" for x in lines for c in x)
    styles = spark.createDataFrame([("r", 16, 2)], "run string, color_slot int, dash int")
    assert column(raster.dashed(dots, styles).orderBy("phase"), "phase") == [p for p in range(21) if p % 6 < 2]


def test_layout():
    assert [layout.grid_shape(160, 30, n)[:2] for n in (1, 2, 3, 4, 6, 9)] == [(1, 1), (2, 1), (3, 1), (2, 2), (3, 2), (3, 3)]
    assert layout.grid_shape(30, 5, 4) == (1, 1, 1) and layout.slot_spans(10, 3) == [(0, 4), (4, 3), (7, 3)]
    assert [layout.scroll_for(5, s, 4) for s in (3, 6, 9)] == [3, 5, 6] and layout.plot_size(40, 12) == (29, 10, 58, 40)
    v = layout.zoom(View(), True)
    assert (v.lo, v.hi) == pytest.approx((0.15, 0.85)) and layout.zoom(v, False) == View()
    assert layout.pan(v, True).hi == pytest.approx(0.955) and layout.pan(v, False).lo == pytest.approx(0.045)
    assert layout.move_cursor(View(), True).cursor == 0.5 and layout.move_cursor(View(cursor=0.99), True).cursor == 1.0
    assert layout.smoother(0.6, True) == 0.65 and layout.smoother(0.99, True) == 0.99 and layout.next_axis("wall") == ("step", View())


def test_sidebar(spark):
    def width(runs, labels, total):
        r = spark.createDataFrame([(x,) for x in runs], "run string")
        t = spark.createDataFrame([(0, x, True) for x in labels], "depth int, label string, leaf boolean")
        return layout.sidebar_width(r, t, total).first()["width"]

    assert [width(["a"], ["b"], 200), width(["x" * 60], ["b"], 200), width(["a"], ["y" * 60], 80), width(["x" * 60], ["b"], 40)] == [24, 46, 32, 24]


def test_options():
    assert Options("d", refresh=0.01).refresh == 0.2
    for bad in ({"x_mode": "y"}, {"smoothing": 1.5}, {"max_runs": -1}):
        with pytest.raises(ValueError):
            Options("d", **bad)


def test_session_screen(spark, tmp_path):
    from curvemill.plans.session import Session
    from curvemill.sources import demo

    demo.append(str(tmp_path), 0, 60, 60, now=1.7e9)
    lines = Session.open(spark, Options(str(tmp_path))).screen(100, 24)
    assert lines[0] == "runs 3/3  tags 5  points 729" and any("train/loss" in x for x in lines) and any("⠀" < c <= "⣿" for x in lines for c in x)
    what = Chart("train/loss", view=View(cursor=0.5), px_w=50)
    labels = column(Session.open(spark, Options(str(tmp_path))).legend(what), "label")
    assert len(labels) == 3 and labels[0].startswith("baseline  ") and " @ " in labels[0]
