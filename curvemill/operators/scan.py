"""Scans over whole series in blocks: moving averages of every point, and last values for many cursors. No task holds a series.

A debiased exponential moving average is an affine map of the state before a block to the state after it, s -> w^n s + b. So b of each block is a plain sum, the maps of a
series' blocks are composed in order (one row a block), and every block is then scanned from its own first state. Within a block, rows of ``ROW`` points are multiplied by a triangular
matrix of powers, so nothing is divided by powers that vanish, however small the weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvemill.operators.series import numbered
from curvemill.schema import ARRIVAL

#: Points of a block, and of a row in it.
BLOCK, ROW = 1 << 16, 64
#: A point that is carried on.
CARRIED = "struct<step:bigint,path:string,rec_off:bigint,val_idx:int,value:double>"


def averages(values: np.ndarray, weight: float, start: float) -> np.ndarray:
    """The moving averages s = w s + (1 - w) v of values, from a first state on."""
    bad = np.flatnonzero(~np.isfinite(values))
    stop = int(bad[0]) if len(bad) else len(values)
    clean = values[:stop]
    rows = -(-stop // ROW)
    padded = np.zeros(rows * ROW)
    padded[:stop] = clean
    gap = np.subtract.outer(np.arange(ROW), np.arange(ROW))
    powers = np.where(gap >= 0, weight ** np.maximum(gap, 0).astype(float), 0.0) * (1 - weight)
    own = padded.reshape(rows, ROW) @ powers.T
    fade = weight ** np.arange(1, ROW + 1, dtype=float)
    state = start
    for k in range(rows):
        own[k] += fade * state
        state = own[k, -1]
    out = np.concatenate((own.ravel()[:stop], np.zeros(len(values) - stop)))
    state = out[stop - 1] if stop else start
    for i in range(stop, len(values)):  # NaN and infinities take the plain way
        state = state * weight + (1 - weight) * values[i]
        out[i] = state
    return out


def smooth_points(points: DataFrame, weight: float, block: int = BLOCK) -> DataFrame:
    """(run, tag, step, place, y): the debiased moving average at every point of each series, in order of steps (ties as they arrived).

    A series of one point, and any series at weight 0, stays as it is. NaN goes on to the end of its series.
    """
    placed = numbered(points).select("run", "tag", "step", "place", "value")
    if weight <= 0:
        return placed.withColumnRenamed("value", "y")
    placed = placed.withColumn("block", F.floor((F.col("place") - 1) / block))
    left = (F.col("block") + 1) * block - F.col("place")  # points from here to the end of a full block
    ends = placed.groupBy("run", "tag", "block").agg(F.sum((1 - weight) * F.pow(F.lit(weight), left.cast("double")) * F.col("value")).alias("b"), F.count("*").alias("n"))
    after = weight ** float(block)

    def compose(one: pa.Table) -> pa.Table:
        one = one.sort_by("block")
        state, firsts = 0.0, []
        for b in one["b"].to_numpy():
            firsts.append(state)
            state = state * after + b
        return one.select(["run", "tag", "block"]).append_column("start", pa.array(firsts, pa.float64()))

    starts = ends.groupBy("run", "tag").applyInArrow(compose, "run string, tag string, block long, start double")

    def scan(one: pa.Table) -> pa.Table:
        one = one.sort_by("place")
        place = one["place"].to_numpy().astype(float)
        y = averages(one["value"].to_numpy(), weight, float(one["start"][0].as_py())) / (1 - weight**place)
        return one.select(["run", "tag", "step", "place"]).append_column("y", pa.array(y, pa.float64()))  # NaN stays NaN

    joined = placed.join(starts, ["run", "tag", "block"])
    return joined.groupBy("run", "tag", "block").applyInArrow(scan, "run string, tag string, step long, place long, y double")


def as_of_many(xs: DataFrame, cursors: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """Each row of cursors (run, tag, at, and others) with step and value of its series' last point whose x is not beyond at; null where a series begins later.

    Points (with x) and cursors are put in one order, dealt by ranges of it into ``parts`` and kept in ``folder``, a new shared one. Within a part the last point is carried on; between parts, one row for each series of each
    part is. So a series is as many tasks as it fills, and rows are never paired. Of points with equal x the last by step and arrival counts. NaN is no x.
    """
    own = [c for c in cursors.columns if c not in ("step", "value")]
    point = F.struct("step", *ARRIVAL, "value")
    nothing = F.lit(None).cast(CARRIED)
    held = cursors.select("run", "tag", F.col("at").cast("double").alias("x"), F.lit(1).alias("kind"), nothing.alias("point"), F.struct(*own).alias("cursor"))
    kind = held.schema["cursor"].dataType
    both = xs.where(~F.isnan("x") & F.col("x").isNotNull()).select("run", "tag", F.col("x").cast("double").alias("x"), F.lit(0).alias("kind"), point.cast(CARRIED).alias("point"), F.lit(None).cast(kind).alias("cursor")).unionByName(held)
    order = ["x", "kind", "point"]
    parts = parts or int(xs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartitionByRange(parts, "run", "tag", *order).withColumn("part", F.spark_partition_id())
    dealt.write.parquet(folder)
    dealt = xs.sparkSession.read.schema(dealt.schema).parquet(folder)
    inside = Window.partitionBy("part", "run", "tag").orderBy(*order)
    found = dealt.withColumn("here", F.last("point", ignorenulls=True).over(inside)).where("kind = 1")
    last = dealt.groupBy("run", "tag", "part").agg(F.max_by("point", F.when(F.col("kind") == 0, F.struct("x", "point"))).alias("last"))
    before = Window.partitionBy("run", "tag").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("run", "tag", "part", F.last("last", ignorenulls=True).over(before).alias("carried"))
    joined = found.join(carried, [found[c].eqNullSafe(carried[c]) for c in ("run", "tag", "part")], "left")
    best = F.coalesce("here", "carried")
    return joined.select(*[F.col(f"cursor.{c}").alias(c) for c in own], best["step"].alias("step"), best["value"].alias("value"))
