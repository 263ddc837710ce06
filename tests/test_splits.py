"""Self-synchronising ranges: any cut of a file gives the points of one read, with decoys, wrong checksums and damaged tails; ends of streams are found by tasks."""

import io
import json
import os
import struct

import numpy as np
import pytest

from curvemill.schema import Options
from curvemill.sources import columnar, datasource, files, ledger, splits
from curvemill.sources.wire import BYTES, FIXED64, encode_event, frame, put_field
from curvemill.streaming import live


def event(i):
    return frame(encode_event("loss" if i % 3 else "accuracy/top", i * 700, 1.5 + i, i / 2))


def decoy(i):
    """A record whose payload holds framed records of its own, between other bytes."""
    inner = frame(encode_event("decoy", i, 9.0, 9.0)) * 3
    return frame(put_field(1, FIXED64, struct.pack("<d", 2.0)) + put_field(7, BYTES, b"\x00" * 5 + inner + b"tail"))


def body(n=60):
    return b"".join(decoy(i) if i % 7 == 3 else event(i) for i in range(n))


def read_in_ranges(path, every, length=None):
    """The rows of all ranges one after another, and how many ranges say that they are the last."""
    f = files.EventFile("r", str(path), ("r", "f"), os.path.getsize(path) if length is None else length)
    rows, last = [], 0
    for part in datasource.ranges(f, 0, every, length):
        state = datasource.State(part.start)
        rows += [tuple(r.values()) for b in datasource._points(part, state) for r in b.to_pylist()]
        last += state.last
    return rows, last


def whole(path, limit=None):
    return [("r", t, s, w, v, str(path), o, k) for found in files.read_range(str(path), 0, limit=limit) for t, s, w, v, o, k in found.rows]


TAILS = {
    "clean": b"", "partial header": event(99)[:7], "partial record": event(99)[:-3], "zeros": bytes(200), "after wrong length checksum": (lambda e: e[:8] + b"????" + e[12:])(event(98)) + event(97) + event(96),
    "after wrong payload checksum": event(98)[:-4] + b"????" + event(97), "decoy last": decoy(5), "decoy cut": decoy(5)[:-6],
}


@pytest.fixture(autouse=True)
def little_proof(monkeypatch):
    """So that files of a few thousand bytes have many starts; still more than the frames in a payload."""
    monkeypatch.setattr(splits, "PROOF", 300)


@pytest.mark.parametrize("tail", TAILS)
def test_ranges_of_every_size_give_one_read(tmp_path, tail):
    data = body()
    path = tmp_path / "f"
    path.write_bytes(data + TAILS[tail])
    want = whole(path)
    assert len(want) >= 50
    for every in [*range(1, 12), 17, 33, 64, 100, 333, 1000, 2500, len(data) - 1, len(data), len(data) + 50]:
        got, last = read_in_ranges(path, every)
        assert got == want and last == 1, every


def test_a_start_at_every_offset(tmp_path):
    data = body()
    path = tmp_path / "f"
    path.write_bytes(data)
    starts = columnar.frames(memoryview(data))[0]
    with open(path, "rb") as source:
        for at in range(len(data)):
            want = next((s for s in starts if s >= at), len(data))
            got = splits.start_of(source, at, len(data), len(data))
            assert got == (want if len(data) - want > 450 else got) and (got is None or got == want), at


def test_many_ranges_have_records(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"".join(event(i) for i in range(2000)))
    with open(path, "rb") as source:
        n = os.path.getsize(path)
        found = [splits.bounds(source, low, 1000, n, low == 0) for low in range(0, n, 1000)]
    assert sum(x is not None for x in found) >= len(found) - 1


def test_one_record_larger_than_many_ranges(tmp_path):
    big, header = frame(put_field(1, FIXED64, struct.pack("<d", 2.0)) + put_field(7, BYTES, np.random.default_rng(1).integers(0, 256, 50_000, np.uint8).tobytes())), frame(bytes(70_000))[:12]
    path = tmp_path / "f"
    path.write_bytes(event(1) + big + b"".join(event(i) for i in range(2, 40)) + frame(put_field(7, BYTES, header * 3)) + big + event(9))
    for every in (100, 777, 5000, 20_000, 49_000):
        assert read_in_ranges(path, every) == (whole(path), 1)


def test_random_bytes_hold_no_start():
    data = np.random.default_rng(2).integers(0, 256, 1 << 20, np.uint8).tobytes()
    assert splits.start_of(io.BytesIO(data), 0, len(data), len(data)) is None and splits.start_of(io.BytesIO(b""), 0, 0, 0) is None
    assert splits.headers(event(3) + b"x")[0].tolist() == [0]


def test_planning_opens_no_file(spark, tmp_path, monkeypatch):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "tfevents").write_bytes(body(300))
    monkeypatch.setattr(files, "open_file", lambda path: (_ for _ in ()).throw(AssertionError("opened")))
    parts = datasource._Reader(str(tmp_path), "points", 1000).partitions()
    assert len(parts) == -(-os.path.getsize(tmp_path / "r" / "tfevents") // 1000)
    stream = datasource._StreamReader(str(tmp_path), 1 << 62, 1 << 62, str(tmp_path / "state"), 1000)
    end = stream.latestOffset()
    assert list(json.loads(end["files"]).values()) == [os.path.getsize(tmp_path / "r" / "tfevents")]
    assert len(stream.partitions(stream.initialOffset(), end)) == len(parts)


def test_batch_read_in_ranges(spark, tmp_path):
    (tmp_path / "r").mkdir()
    path = tmp_path / "r" / "tfevents"
    path.write_bytes(body(400))
    got = datasource.read(spark, str(tmp_path), splitBytes=997).orderBy("rec_off", "val_idx").collect()
    assert [tuple(r) for r in got] == whole(path)


def test_limits_cut_at_whole_records(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(body())
    for limit in range(0, 900, 13):
        got, _ = read_in_ranges(path, 50, limit) if limit else ([], 0)
        assert got == (whole(path, limit) if limit else [])


class Follower:
    """A stream reader that is driven by hand: batches, retries and restarts."""

    def __init__(self, top, state, **options):
        self.top, self.state, self.options, self.offset, self.rows = str(top), str(state), {"most": 1 << 62, "split": 300} | options, {"files": "{}"}, []
        self.restart()

    def restart(self):
        self.reader = datasource._StreamReader(self.top, self.options["most"], 1 << 62, self.state, self.options["split"])

    def batch(self, retries=0, commit=True):
        end = self.reader.latestOffset()
        for _ in range(retries + 1):
            rows = [(r["path"], r["rec_off"], r["val_idx"], r["step"]) for p in self.reader.partitions(self.offset, end) for b in self.reader.read(p) for r in b.to_pylist()]
        self.rows += rows
        self.offset = end
        if commit:
            self.reader.commit(end)
        return rows


@pytest.mark.parametrize("most", [1 << 62, 97])
def test_a_file_that_grows_byte_by_byte(tmp_path, most):
    (tmp_path / "log" / "r").mkdir(parents=True)
    path = tmp_path / "log" / "r" / "tfevents"
    data, follower = body(25), Follower(tmp_path / "log", tmp_path / "state", most=most)
    at = 0
    for k, step in enumerate([0, 1, 11, 1, 40, 200, 3, 500, 1, 90, 1000, 4000]):
        path.write_bytes(data[: (at := min(at + step, len(data)))])
        if k % 3 == 1:
            follower.restart()
        follower.batch(retries=k % 2, commit=k % 4 != 0)
    for _ in range(len(data) // 97 + 2):
        follower.batch()
    assert follower.rows == [(r[5], r[6], r[7], r[2]) for r in whole(path)] and at == len(data)
    assert len([n for n in os.listdir(tmp_path / "state") if n.endswith(ledger.END)]) == 1


def test_dead_files_and_lost_ledgers(tmp_path):
    (tmp_path / "log" / "r").mkdir(parents=True)
    path = tmp_path / "log" / "r" / "tfevents"
    path.write_bytes(event(1) + frame(b"\x0b") + event(2))
    follower = Follower(tmp_path / "log", tmp_path / "state", split=1 << 20)
    assert [r[3] for r in follower.batch(retries=1)] == [700]
    path.write_bytes(path.read_bytes() + event(3))
    assert follower.batch() == [] and list(ledger.dead(str(tmp_path / "state"))) == [str(path)]
    with pytest.raises(OSError):
        ledger.place(str(tmp_path / "none"), str(path), 10)


def test_stream_in_ranges_restarts_without_gaps(spark, tmp_path):
    log, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    os.makedirs(f"{log}/r")
    data, options = body(120), Options(log, follow=False)
    for part in (1500, 1507, 3000, len(data) - 2, len(data)):
        with open(f"{log}/r/tfevents", "wb") as f:
            f.write(data[:part])
        live.follow(spark, options, out, state, splitBytes=400).awaitTermination()
    got = live.live_points(spark, out).orderBy("rec_off", "val_idx").collect()
    assert [(r["rec_off"], r["step"]) for r in got] == [(r[6], r[2]) for r in whole(f"{log}/r/tfevents")]
    with pytest.raises(Exception, match="stateDir"):
        spark.readStream.format("tfevents").load(log).writeStream.format("noop").trigger(availableNow=True).start().awaitTermination()


def test_many_ranges_are_widened(monkeypatch):
    monkeypatch.setattr(splits, "PROOF", 1 << 18)
    assert datasource.widened(0, 1 << 40) == 0 and datasource.widened(4096, 1 << 20) == 4096
    assert datasource.widened(4096, 100 << 20) == 102_400 and datasource.widened(4096, 1 << 40) == 1 << 18 and datasource.widened(32 << 20, 1 << 50) == 32 << 20
