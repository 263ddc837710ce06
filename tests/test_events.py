import os

import pytest

from curvemill.schema import Options
from curvemill.sources import datasource, demo, files
from curvemill.sources.wire import encode_event, frame
from curvemill.streaming import live


def put(path, *events, tail=b""):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "ab") as f:
        for e in events:
            f.write(frame(encode_event(*e)))
        f.write(tail)


def steps(df):
    return sorted((r["run"], r["tag"], r["step"]) for r in df.collect())


def test_discovery(tmp_path):
    for name in ("events.out.tfevents.1", "x.tfevents.profile-empty", "other"):
        put(tmp_path / "b" / name)
    put(tmp_path / "a" / "c" / "tfevents")
    put(tmp_path / "tfevents.root")
    os.symlink(tmp_path / "a", tmp_path / "z")
    assert [f.run for f in files.discover(str(tmp_path))] == ["a/c", "b", ".", "z/c"]
    assert files.discover(str(tmp_path / "none")) == []


def test_slices_carry_what_is_left(tmp_path):
    path = tmp_path / "r" / "tfevents"
    put(path, *[("a", i, 1.0, float(i)) for i in range(50)])
    got = [row[1] for found in files.read_range(str(path), 0, step=37) for row in found.rows]
    assert got == list(range(50))


@pytest.mark.parametrize("split", [0, 200])
def test_batch_read_keeps_order_of_arrival(spark, tmp_path, split):
    put(tmp_path / "r" / "tfevents.1", *[("a", i, 1.0, i / 2) for i in range(40)])
    put(tmp_path / "r" / "tfevents.2", ("a", 3, 1.0, 9.0), tail=frame(b"\x0b"))
    got = datasource.read(spark, str(tmp_path), splitBytes=split).orderBy("path", "rec_off", "val_idx").collect()
    assert [r["step"] for r in got] == [*range(40), 3]
    bad = datasource.read(spark, str(tmp_path), "errors").collect()
    assert [(r["run"], r["error"]) for r in bad] == [("r", "damaged record")] and bad[0]["path"].endswith("tfevents.2")


@pytest.mark.parametrize("marks", [False, True])
def test_following_a_growing_folder(spark, tmp_path, marks):
    log, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    source = {"stateDir": str(tmp_path / "marks")} if marks else {}
    options = Options(log, follow=False, max_runs=1)

    def go():
        live.follow(spark, options, out, state, **source).awaitTermination()
        return steps(live.live_points(spark, out))

    second = frame(encode_event("a", 2, 3.0, 1.0))
    put(f"{log}/b/tfevents", ("a", 1, 5.0, 1.0), tail=second[:-5])
    assert go() == [("b", "a", 1)]
    assert go() == [("b", "a", 1)]
    with open(f"{log}/b/tfevents", "ab") as f:
        f.write(second[-5:])
    put(f"{log}/a/tfevents", ("x", 7, 0.0, 1.0), tail=frame(b"\x0b"))
    assert go() == [("a", "x", 7), ("b", "a", 1), ("b", "a", 2)]
    put(f"{log}/a/tfevents", ("x", 8, 0.0, 1.0))  # dead: not read any more
    put(f"{log}/b/tfevents", ("a", 0, 9.0, 1.0))  # late
    assert go() == [("a", "x", 7), ("b", "a", 0), ("b", "a", 1), ("b", "a", 2)]
    runs = {r["run"]: (r["first_wall"], r["color_slot"], r["enabled"]) for r in live.known_runs(spark, out).collect()}
    assert runs == {"b": (3.0, 0, True), "a": (None, 1, False)}


def test_writer_round_trip(spark, tmp_path):
    points = demo.curves(spark, 60, noise=0)
    datasource.write(points, str(tmp_path), tensor=True)
    datasource.write(points.where("run = 'baseline'").selectExpr("run", "tag", "step + 60 AS step", "wall", "value"), str(tmp_path))
    got = datasource.read(spark, str(tmp_path))
    assert got.where("step < 60").count() == points.count() and got.where("step >= 60").select("run").distinct().count() == 1
    assert steps(got.where("step < 60")) == steps(points)
    with pytest.raises(Exception, match="append"):
        points.select("run", "tag", "step", "wall", "value").write.format("tfevents").mode("overwrite").save(str(tmp_path))


def test_demo_counts(spark):
    n = {r["tag"]: r["count"] for r in demo.curves(spark, 100).groupBy("tag").count().collect()}
    assert n["train/loss"] == 300 and n["val/loss"] == 12


def test_an_unreadable_range_gives_nothing(tmp_path, monkeypatch):
    path = tmp_path / "r" / "tfevents"
    put(path, *[("a", i, 1.0, float(i)) for i in range(500)])
    part = datasource.Range("r", str(path), ("r", "tfevents"), 0, None)
    read_range = files.read_range
    assert sum(b.num_rows for b in datasource._points(part, datasource.State(0))) == 500

    def breaks(*args, **more):
        yield from list(read_range(args[0], args[1], args[2], step=4096, tags=more.get("tags")))[:2]
        raise OSError("gone")

    monkeypatch.setattr(files, "read_range", breaks)
    state = datasource.State(0)
    assert not list(datasource._points(part, state)) and state.dead and state.why == "gone" and state.at > 0


def test_changes_are_announced_and_files_come_in_parts(spark, tmp_path):
    log, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    for k in range(5):
        put(f"{log}/r{k}/tfevents", ("a", k, 1.0, 1.0))
    put(f"{log}/zz/tfevents")
    options, told = Options(log, follow=False), []
    for seen in (2, 4, 5, 5):
        live.follow(spark, options, out, state, told.append, maxFilesPerTrigger=2).awaitTermination()
        assert len(steps(live.live_points(spark, out))) == seen
    assert len(told) == 3 and {r["run"] for r in live.known_runs(spark, out).collect()} == {"r0", "r1", "r2", "r3", "r4", "zz"}


def test_filters_reach_the_source(spark, tmp_path):
    for run in "abc":
        put(tmp_path / run / "tfevents", *[(tag, i, 1.0, float(i)) for i in range(20) for tag in ("x", "y")])
    reader = datasource._PushingReader(str(tmp_path), "points", 1 << 20)
    left = list(reader.pushFilters([datasource.EqualTo(("run",), "b"), datasource.In(("tag",), ("x", "z")), datasource.EqualTo(("step",), 3)]))
    assert len(left) == 1 and [p.run for p in reader.partitions()] == ["b"]
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [20]
    assert steps(datasource.read(spark, str(tmp_path)).where("run = 'c' and tag in ('y', 'q') and step < 2")) == [("c", "y", 0), ("c", "y", 1)]


def test_checksums(spark, tmp_path):
    put(tmp_path / "r" / "tfevents", *[("a", i, 1.0, 1.0) for i in range(9)], tail=frame(b"abc")[:-1] + b"\0")
    row = datasource.read(spark, str(tmp_path), "checksums").first()
    assert (row["records"], row["wrong"]) == (10, 1)


def test_backward_steps_and_places_in_chunks(spark, monkeypatch):
    from curvemill.operators import series

    monkeypatch.setattr(series, "CHUNK", 8)
    order = [5, 3, 9, 9, 1, 20, 19, 40, 39, 2, 2, 0, 7]
    rows = [("r", "t", s, 1.0, 1.0, "f" if i < 7 else "g", i * 3, 0) for i, s in enumerate(order)]
    df = spark.createDataFrame(rows, "run string, tag string, step long, wall double, value double, path string, rec_off long, val_idx int")
    assert series.backward_steps(df).first()["backwards"] == sum(b < a for a, b in zip(order, order[1:]))
    assert [(r["step"], r["place"]) for r in series.numbered(df).orderBy("place").collect()] == [(s, i + 1) for i, s in enumerate(sorted(order))]
