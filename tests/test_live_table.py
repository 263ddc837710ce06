"""The live table: thinning by batches, summaries, merged parts, manifests, and a session over it."""

import os
import random

import pytest
from pyspark.sql import functions as F

from curvemill.operators import catalog, chart, series, summary, thin
from curvemill.plans.session import LiveSession, Session
from curvemill.schema import POINTS, Chart, Options, View
from curvemill.streaming import live, table
from curvemill.streaming.table import LiveTable

COLUMNS = [c.split()[0] for c in POINTS.split(", ")]


def rows(n, run="r", tag="t", start=0):
    return [(run, tag, i * 2 + 1, 100.0 + i, float(i % 17), f"{run}/f", i * 50, 0) for i in range(start, start + n)]


def frame(spark, some):
    return spark.createDataFrame(some, POINTS)


def kept(df):
    return sorted((r["run"], r["tag"], r["rec_off"]) for r in df.collect())


def plain_thinning(n, cap):
    """Offers one point after the other: kept if its number is a multiple of the stride; beyond the cap every other one goes."""
    out, stride = [], 1
    for i in range(n):
        if i % stride == 0:
            out.append(i)
        if cap and len(out) > cap:
            out, stride = out[::2], stride * 2
    return out, stride


def test_batches_of_any_size_keep_what_one_read_keeps(spark, tmp_path):
    cap, total, r = 20, 0, random.Random(1)
    live_table = LiveTable(spark, str(tmp_path / "t"), cap)
    for number, n in enumerate([7, 1, 100, 3, 0, 250, 19, 1]):
        some = rows(n, start=total) + (rows(n // 2, tag="u", start=total // 2) if number % 2 == 0 else [])
        r.shuffle(some)
        live_table.apply(frame(spark, some), number)
        total += n
        want, stride = plain_thinning(total, cap)
        got = [x for x in kept(live_table.points()) if x[1] == "t"]
        assert got == [("r", "t", i * 50) for i in want] and len(got) <= cap
        s = {x["tag"]: x for x in live_table.series().collect()}["t"]
        assert (s["offered"], s["stride"], s["least_wall"]) == (total, stride, 100.0)
        assert (s["first"]["step"], s["last"]["step"], s["last"]["arrival_index"]) == (1, want[-1] * 2 + 1, want[-1])
    again = LiveTable(spark, str(tmp_path / "t"), cap)  # after a restart
    assert not again.apply(frame(spark, rows(5, start=total)), 7) and kept(again.points()) == kept(live_table.points())
    assert kept(thin.thin(frame(spark, rows(total)), cap)) == [x for x in kept(again.points()) if x[1] == "t"]


def test_summaries_equal_the_queries_they_stand_for(spark, tmp_path):
    r, cap = random.Random(3), 32
    every = [(f"run{k}", tag, r.randrange(300), r.choice([0.0, 50.0 + r.random() * 100]), r.random(), f"run{k}/f", i * 40, 0) for k in range(5) for tag in ("a/x", "a/y", "b")[: 1 + k % 3] for i in range(r.randrange(1, 90))]
    live_table = LiveTable(spark, str(tmp_path / "t"), cap)
    by_file = sorted(every, key=lambda x: x[6])
    for number in range(4):
        live_table.apply(frame(spark, [x for x in by_file if x[6] // 40 % 4 == number or number == 3][:0] + [x for x in by_file if x[6] // 40 // 25 == number]), number)
    whole = frame(spark, [x for x in every if x[6] // 40 < 100])
    points, known = live_table.points().select(*COLUMNS), live_table.series()
    assert kept(points) == kept(thin.thin(whole, cap).drop("stride"))
    names = catalog.cap_runs(whole.select("run"), 3)
    one = lambda df: tuple(df.first())
    assert one(summary.header(known, names).drop("stored_points")) == one(catalog.header(whole, names, cap))
    assert summary.header(known, names).first()["stored_points"] == points.count()
    assert [x["tag"] for x in summary.tags(known, names, "A").collect()] == [x["tag"] for x in catalog.tags(whole, names, "A").collect()]
    assert one(summary.longest(known)) == one(series.longest(points))
    assert {tuple(x) for x in summary.first_walls(known).collect()} == {tuple(x) for x in series.first_walls(whole).collect()}
    for mode in ("step", "wall", "reltime"):
        own = points.where("tag = 'a/x'")
        assert one(summary.domain(known.where("tag = 'a/x'"), mode, summary.first_walls(known))) == one(series.domain(series.with_x(own, mode, series.first_walls(whole)))), mode


def test_many_batches_leave_few_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(table, "FAN", 3)
    live_table = LiveTable(spark, str(tmp_path / "t"), 0)
    for number in range(20):
        live_table.apply(frame(spark, rows(4, start=number * 4)), number)
    parts = live_table.manifest()["parts"]
    assert len(parts) <= 2 * 3 and sum(p["points"] for p in parts) == 80 and kept(live_table.points()) == kept(frame(spark, rows(80)))
    folders = [x for x in os.listdir(tmp_path / "t") if x.startswith("part-")]
    assert len(folders) <= len(parts) + table.KEEP * 3 and len(os.listdir(tmp_path / "t" / "manifests")) <= 2 * table.KEEP
    assert not [x for x in os.listdir(tmp_path / "t") if x.startswith(("stage", "counts"))]


def test_a_failed_batch_is_written_again(spark, tmp_path, monkeypatch):
    live_table = LiveTable(spark, str(tmp_path / "t"), 8)
    live_table.apply(frame(spark, rows(10)), 0)
    before = kept(live_table.points())
    with monkeypatch.context() as m:
        m.setattr(LiveTable, "_swap", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            live_table.apply(frame(spark, rows(30, start=10)), 1)
    assert kept(live_table.points()) == before and live_table.manifest()["batch"] == 0
    live_table.apply(frame(spark, rows(30, start=10)), 1)
    assert kept(live_table.points()) == [("r", "t", i * 50) for i in plain_thinning(40, 8)[0]]


def _scanned(df):
    """Rows that the scans of a query read."""
    df.collect()
    plan, out, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan)
    while todo:
        node = todo.pop()
        if "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
        metrics = node.metrics()
        if node.getClass().getSimpleName() == "FileSourceScanExec" and "arrival_index" in str(node.schema().simpleString()):
            out += metrics.apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_a_zoom_reads_its_row_groups(spark, tmp_path):
    live_table = LiveTable(spark, str(tmp_path / "t"), 0, block_bytes=1 << 14)
    n = 60_000
    wide = spark.range(n).selectExpr("'r' AS run", "concat('tag', id % 4) AS tag", "id AS step", "cast(id AS double) AS wall", "rand(1) AS value", "'r/f' AS path", "id * 50 AS rec_off", "0 AS val_idx")
    live_table.apply(wide, 0)
    session = LiveSession(live_table, Options("x"), wide.select("run", F.split("path", "/").alias("path_parts")).distinct())
    what = Chart("tag2", smoothing=0.0, view=View(0.5, 0.52), px_w=50)
    drawn = session.curves(what)
    full = chart.curves(wide, what)
    assert {(x["col"], round(x["y"], 9)) for x in drawn.collect()} == {(x["col"], round(x["y"], 9)) for x in full.collect()}
    read = _scanned(session.curves(what).select("run", "col", "y"))
    assert 300 <= _scanned(live_table.points().where("tag = 'tag2' and step between 30000 and 31200")) <= 6_000 and read <= 6_000


def test_live_sessions_show_what_sessions_over_points_show(spark, tmp_path):
    every = [x for k in range(3) for x in rows(70 + k, run=f"run{k}", tag="loss")] + rows(30, run="run1", tag="val/acc")
    live_table = LiveTable(spark, str(tmp_path / "t"), 40)
    for number in range(3):
        live_table.apply(frame(spark, [x for x in every if x[6] // 50 // 30 == number]), number)
    points = frame(spark, every)
    files = points.select("run", F.split("path", "/").alias("path_parts")).distinct()
    options = Options("x", max_points=40, max_runs=2)
    plain, now = Session(points, options, files), LiveSession(live_table, options, files)
    assert plain.header().first() == now.header().first() and plain.tags().collect() == now.tags().collect()
    for mode in ("step", "reltime", "wall"):
        what = Chart("loss", x_mode=mode, view=View(0.2, 0.9, 0.5), px_w=30)
        both = [sorted((x["run"], x["col"], round(x["y"], 9)) for x in s.curves(what).collect()) for s in (plain, now)]
        assert both[0] == both[1] and both[0] and plain.legend(what).collect() == now.legend(what).collect()
    assert plain.screen(60, 16) == now.screen(60, 16)
    plain.close()
    now.close()


def test_listeners_know_which_files_grew(spark, tmp_path):
    from test_events import put

    log, told = str(tmp_path / "log"), []
    put(f"{log}/a/tfevents", ("x", 1, 1.0, 1.0))
    put(f"{log}/b/tfevents", ("x", 1, 1.0, 1.0))
    changes = live.Changes(lambda number, grown: told.append(sorted(os.path.basename(os.path.dirname(p)) for p in grown)))
    spark.streams.addListener(changes)
    try:
        for more in (False, True, False):
            if more:
                put(f"{log}/b/tfevents", ("x", 2, 2.0, 2.0))
            changes.ended.clear()
            live.follow(spark, Options(log, follow=False), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
            assert changes.ended.wait(60)
    finally:
        spark.streams.removeListener(changes)
    assert told == [["a", "b"], ["b"]] and changes.wake.is_set()
