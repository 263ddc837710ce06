"""Following a growing log directory: points into a bounded table, and the small tables of series and runs kept beside it.

Each micro-batch goes into a ``LiveTable`` as a whole, under its number, so a restart after a failure leaves neither gaps nor doubles. Points that arrive late or out of order are
kept like any other: order is a matter of queries. No watermark drops anything. A run is in the table as soon as one of its files is there, points or not.
``on_change`` is told the number of each batch that changed something; ``Changes`` is a listener that knows from a query's progress which files grew.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from curvemill.schema import POINTS, Options
from curvemill.sources import datasource
from curvemill.streaming.table import LiveTable


def stream(spark: SparkSession, logdir: str, **options) -> DataFrame:
    """The points of a growing folder; ``stateDir``, a shared folder of this stream's own, is needed."""
    datasource.register(spark)
    return spark.readStream.format("tfevents").options(**options).load(logdir)


def known_runs(spark: SparkSession, out: str) -> DataFrame:
    """(run, first_wall, color_slot, enabled) after the latest batch."""
    return LiveTable(spark, out).runs()


def live_points(spark: SparkSession, out: str) -> DataFrame:
    """The points that are kept."""
    return LiveTable(spark, out).points().select(*[c.split()[0] for c in POINTS.split(", ")])


def _sink(out: str, options: Options, on_change: Callable[[int], None] | None = None):
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        listing = datasource.read(spark, options.logdir, "listing")
        if LiveTable(spark, out, options.max_points).apply(batch, number, options.max_runs, listing) and on_change:
            on_change(number)

    return write


def follow(spark: SparkSession, options: Options, out: str, checkpoint: str, on_change: Callable[[int], None] | None = None, **source) -> StreamingQuery:
    """Starts following; with ``follow`` off it reads what is there and ends. Stopping and starting again resumes at the byte where it was."""
    source = {"stateDir": f"{checkpoint.rstrip('/')}-ends", **source}
    sink = _sink(out, options, on_change)
    writer = stream(spark, options.logdir, **source).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{options.refresh} seconds") if options.follow else writer.trigger(availableNow=True)
    return writer.start()


class Changes(StreamingQueryListener):
    """Tells which files each batch of a query read further, from the offsets in its progress. ``told`` is called with the batch and the files, ``wake`` is set; both in the listener's thread."""

    def __init__(self, told: Callable[[int, list[str]], None] | None = None) -> None:
        self.told, self.wake, self.idle, self.ended = told, threading.Event(), 0, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for source in json.loads(event.progress.json)["sources"]:
            lengths = [json.loads(o["files"]) if isinstance(o, dict) else {} for o in (source["startOffset"], source["endOffset"])]
            grown = sorted(path for path, n in lengths[1].items() if n != lengths[0].get(path))
            if grown:
                self.wake.set()
                if self.told:
                    self.told(event.progress.batchId, grown)

    def onQueryIdle(self, event) -> None:
        self.idle += 1

    def onQueryTerminated(self, event) -> None:
        self.ended.set()
