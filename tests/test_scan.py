"""Scans over whole series against loops: every block size, weight, NaN and infinities; cursors over skewed series."""

import bisect
import math
import random

import numpy as np
import pytest

from curvemill.operators import scan, series
from curvemill.schema import POINTS


def plain_average(values, weight):
    state, out = 0.0, []
    for i, v in enumerate(values, 1):
        state = state * weight + (1 - weight) * v
        out.append(state / (1 - weight**i))
    return out


@pytest.mark.parametrize("weight", [0.01, 0.3, 0.6, 0.99, 0.9999])
def test_averages_in_blocks(weight):
    r = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000, 5003):
        values = r.normal(size=n) * 10.0 ** r.integers(-6, 6, n)
        want = np.array(plain_average(values, weight)) * (1 - weight ** np.arange(1, n + 1, dtype=float))
        got = scan.averages(values, weight, 0.0)
        assert np.allclose(got, want, rtol=1e-11, atol=1e-14)
        half = n // 3
        assert np.allclose(np.concatenate((got[:half], scan.averages(values[half:], weight, got[half - 1] if half else 0.0))), want, rtol=1e-11, atol=1e-14)
    odd = np.array([1.0, 2.0, math.nan, 3.0])
    assert np.isnan(scan.averages(odd, weight, 0.0)).tolist() == [False, False, True, True]
    assert scan.averages(np.array([1.0, math.inf, 5.0]), weight, 0.0)[1:].tolist() == [math.inf] * 2


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_every_point_of_a_series(spark, block):
    r = random.Random(2)
    values = {("a", "x"): [r.gauss(0, 1) for _ in range(300)], ("a", "y"): [5.0], ("b", "x"): [1.0] * 20 + [math.nan] + [1.0] * 30}
    rows = [(run, tag, i // 2, 1.0, v, "f", i, 0) for (run, tag), vs in values.items() for i, v in enumerate(vs)]
    r.shuffle(rows)
    points = spark.createDataFrame(rows, POINTS)
    for weight in (0.01, 0.6, 0.99):
        got = {}
        for x in scan.smooth_points(points, weight, block).orderBy("place").collect():
            got.setdefault((x["run"], x["tag"]), []).append(x["y"])
        for key, vs in values.items():
            assert np.allclose(got[key], plain_average(vs, weight), rtol=1e-9, equal_nan=True)
    assert sorted(x["y"] for x in scan.smooth_points(points.where("run = 'a' and tag = 'x'"), 0.0).collect()) == sorted(values["a", "x"])
    assert scan.smooth_points(points.limit(0), 0.5).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 9])
def test_many_cursors(spark, tmp_path, parts):
    r = random.Random(3)
    rows = [("hot", "t", r.randrange(400), 0.0, float(i), "f", i, 0) for i in range(900)] + [("cold", "t", 50, 0.0, 1.0, "f", 1, 0), ("cold", "t", 60, 0.0, math.nan, "f", 2, 0)]
    xs = series.with_x(spark.createDataFrame(rows, POINTS), "step")
    marks = [("hot", "t", r.random() * 420 - 10, k) for k in range(500)] + [("cold", "t", float(x), 600 + x) for x in (49, 50, 59, 60, 99)] + [("none", "t", 5.0, 700), ("hot", "t", 50.0, 701), ("hot", "t", 50.0, 701), ("hot", "t", None, 702)]
    cursors = spark.createDataFrame(marks, "run string, tag string, at double, id long")
    got = scan.as_of_many(xs, cursors, str(tmp_path / f"asof{parts}"), parts).collect()
    known = {}
    for run, _, step, _, value, _, at, _ in sorted(rows, key=lambda x: (x[2], x[6])):
        known.setdefault(run, []).append((step, value))
    want = []
    for run, _, at, k in marks:
        own = known.get(run, [])
        i = bisect.bisect_right([s for s, _ in own], at) if at is not None else 0
        want.append((k, own[i - 1] if i else (None, None)))
    key = lambda x: (x[0], str(x[1]))
    assert sorted(((x["id"], (x["step"], x["value"])) for x in got), key=key).__repr__() == sorted(want, key=key).__repr__()
