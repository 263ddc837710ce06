"""Demo curves: three runs of five metrics by closed forms with noise, as points or as event files."""

from __future__ import annotations

import math
import random
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvemill.sources import columnar

#: The demo's runs (name, learning rate, whether values are encoded as tensors), metrics, seconds between steps, and steps between validations.
RUNS = (("baseline", 1.0, False), ("high_lr", 2.2, False), ("low_lr/warmup", 0.4, True))
TAGS = ("train/loss", "train/accuracy", "train/lr", "train/grad_norm", "val/loss")
SPACING, VALIDATE = 0.05, 25
FILE = "events.out.tfevents.demo"


def curves(spark: SparkSession, steps: int = 5000, noise: float = 1.0, seed: int = 1, start_wall: float = 1.7e9) -> DataFrame:
    """Points of the demo runs; without noise they follow the closed forms exactly."""
    runs = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.lit(lr).alias("lr")) for r, lr, _ in RUNS]))
    base = spark.range(steps).select(F.col("id").alias("step"), runs.alias("r")).select("step", "r.run", "r.lr")
    i = F.col("step").cast("double")
    gauss = lambda k, sigma: F.randn(seed + k) * (sigma * noise) if noise else F.lit(0.0)
    base = base.withColumn("loss", 2.5 * F.exp(-3.0 * F.col("lr") * i / 100) + 0.08 + gauss(0, 0.05))
    accuracy = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 0.9 * F.exp(-2.5 * F.col("lr") * i / 100) + gauss(1, 0.01)))
    rate = F.col("lr") * 0.5 * (1 + F.cos(math.pi * F.least(i / max(steps, 1), F.lit(1.0))))
    grad = F.abs(1.0 + gauss(2, 0.4)) * F.exp(-i / 4000)
    pairs = [("train/loss", F.col("loss")), ("train/accuracy", accuracy), ("train/lr", rate), ("train/grad_norm", grad)]
    pairs.append(("val/loss", F.when(F.col("step") % VALIDATE == 0, F.col("loss") + 0.15 + gauss(3, 0.03))))
    cells = F.array(*[F.struct(F.lit(tag).alias("tag"), v.alias("value"), F.lit(k).alias("val_idx")) for k, (tag, v) in enumerate(pairs)])
    rows = base.select("run", "step", F.explode(cells).alias("c")).where("c.value is not null")
    return rows.select("run", "c.tag", "step", (F.lit(start_wall) + F.col("step") * SPACING).alias("wall"), "c.value", F.lit(FILE).alias("path"), F.col("step").alias("rec_off"), "c.val_idx")


def append(logdir: str, start: int, count: int, hint: int, now: float | None = None) -> None:
    """Appends steps to the event file of each demo run; for live demos and tests, in one process."""
    import os

    now = time.time() if now is None else now
    for k, (run, lr, tensor) in enumerate(RUNS):
        r = random.Random(f"{k}/{start}")
        folder = os.path.join(logdir, *run.split("/"))
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, FILE), "ab") as out:
            tags, rows = list(TAGS), []
            for i in range(start, start + count):
                wall = now - (hint - i) * SPACING
                loss = 2.5 * math.exp(-3 * lr * i / 100) + 0.08 + r.gauss(0, 0.05)
                accuracy = min(1.0, max(0.0, 1 - 0.9 * math.exp(-2.5 * lr * i / 100) + r.gauss(0, 0.01)))
                rate, grad = lr * 0.5 * (1 + math.cos(math.pi * min(i / max(hint, 1), 1))), abs(r.gauss(1, 0.4)) * math.exp(-i / 4000)
                rows += [(k, i, wall, v) for k, v in enumerate((loss, accuracy, rate, grad))]
                if i % VALIDATE == 0:
                    rows.append((4, i, wall, loss + 0.15 + r.gauss(0, 0.03)))
                if len(rows) > 100_000 or i == start + count - 1:
                    out.write(columnar.encode(tags, *(np.array(c) for c in zip(*rows)), tensor))
                    rows = []


def generate(logdir: str, steps: int = 5000, live: bool = False, per_second: int = 20) -> None:
    """Writes the demo runs, and with live goes on until interrupted."""
    append(logdir, 0, steps, steps)
    while live:
        time.sleep(1)
        append(logdir, steps, per_second, steps + per_second)
        steps += per_second


__all__ = ["RUNS", "append", "curves", "generate"]
