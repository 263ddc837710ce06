"""The table that a stream of points is kept in: bounded, clustered, and changed as a whole.

Each batch appends the points that thinning keeps, under their arrival numbers, and the next state of two small tables: a summary a series and a row a run. Thinning is
stateful: how many points of a series were offered so far gives its next arrival numbers and its stride, the least power of two that keeps at most ``cap`` of them. When a stride
doubles, every other kept point is out of the table at once (its arrival number is no multiple any more), and out of its files when these are merged next. So whatever
the batches, a series has the points that thinning all of it would keep, and never more than ``cap``. Batches are numbered and summed by chunks, never a series in one task.

Points lie in parts, folders of Parquet files sorted by run, tag and step, so a chart reads the row groups of its tag and range of steps and no others. ``FAN`` parts of one size
class are merged into one of the next, so any number of batches leaves a number of parts in proportion to its logarithm, and each point is written that often.

A manifest names the parts and state files that belong together. It is written under another name and renamed, the last thing a batch does: readers see a batch wholly or not at all, one that failed is written again, and one
that was already taken in is passed over. What no manifest of the last ``KEEP`` names is deleted.
"""

from __future__ import annotations

import json
import uuid

from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from curvemill.operators import catalog, summary, thin
from curvemill.schema import POINTS
from curvemill.sources import files

FAN, KEEP = 8, 3
#: Points a file of a part holds, or about: what one task sorts.
FILE_POINTS = 1 << 19
DATA = POINTS + ", arrival_index long"
RUNS = "run string, color_slot int, enabled boolean"
KEYS = ("run", "tag", "step", "arrival_index")


class LiveTable:
    """The points, series and runs of one folder, as of its last manifest or a given one."""

    def __init__(self, spark: SparkSession, folder: str, cap: int = 0, block_bytes: int = 16 << 20) -> None:
        self.spark, self.folder, self.cap, self.block_bytes = spark, folder.rstrip("/"), cap, block_bytes
        self.system, self.at = files.file_system(self.folder.replace("file:///", "/"))

    # ---- manifests ----

    def _manifests(self) -> list[str]:
        found = self.system.get_file_info(FileSelector(f"{self.at}/manifests", allow_not_found=True))
        return sorted(i.base_name for i in found if i.type == FileType.File and i.base_name.startswith("m-"))

    def manifest(self) -> dict:
        """What the table consists of: the last batch, parts (folder, size class, points, whether older strides are among them), and state folders."""
        names = self._manifests()
        if not names:
            return {"batch": -1, "parts": [], "series": None, "runs": None, "thinned": False}
        with self.system.open_input_stream(f"{self.at}/manifests/{names[-1]}") as f:
            return json.loads(f.read())

    def _swap(self, manifest: dict) -> None:
        self.system.create_dir(f"{self.at}/manifests", recursive=True)
        hidden = f"{self.at}/manifests/.{uuid.uuid4().hex}"
        with self.system.open_output_stream(hidden) as f:
            f.write(json.dumps(manifest).encode())
        self.system.move(hidden, f"{self.at}/manifests/m-{manifest['batch']:020d}")

    def _sweep(self) -> None:
        """Deletes manifests but the last ones, and what none of these names."""
        names, used = self._manifests(), set()
        for name in names[-KEEP:]:
            with self.system.open_input_stream(f"{self.at}/manifests/{name}") as f:
                known = json.loads(f.read())
            used |= {p["folder"] for p in known["parts"]} | {known["series"], known["runs"]}
        for name in names[:-KEEP]:
            self.system.delete_file(f"{self.at}/manifests/{name}")
        for info in self.system.get_file_info(FileSelector(self.at, allow_not_found=True)):
            if info.type == FileType.Directory and info.base_name != "manifests" and info.base_name not in used:
                self.system.delete_dir(info.path)

    # ---- reading ----

    def _read(self, folder: str | None, schema: str) -> DataFrame:
        if folder is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{folder}")

    def series(self, manifest: dict | None = None) -> DataFrame:
        return self._read((manifest or self.manifest())["series"], summary.SERIES)

    def runs(self, manifest: dict | None = None) -> DataFrame:
        """(run, first_wall, color_slot, enabled)"""
        known = manifest or self.manifest()
        walls = summary.first_walls(self.series(known))
        return self._read(known["runs"], RUNS).join(walls, "run", "left").select("run", "first_wall", "color_slot", "enabled")

    def points(self, manifest: dict | None = None, strides: DataFrame | None = None) -> DataFrame:
        """The kept points with their arrival_index. Conditions on run, tag and step reach the scan."""
        known = manifest or self.manifest()
        if not known["parts"]:
            return self.spark.createDataFrame([], DATA)
        rows = self.spark.read.schema(DATA).parquet(*[f"{self.folder}/{p['folder']}" for p in known["parts"]])
        if strides is None and not known["thinned"]:
            return rows
        strides = strides if strides is not None else self.series(known)
        return rows.join(strides.select("run", "tag", "stride"), ["run", "tag"]).where(F.pmod("arrival_index", "stride") == 0).select(*rows.columns)

    # ---- writing ----

    def _write(self, df: DataFrame, folder: str, points: int) -> None:
        """Sorted files of about ``FILE_POINTS`` points each. What comes before is left to tasks of its own (``coalesce`` would put it into the one that writes)."""
        parts = -(-points // FILE_POINTS)
        dealt = df.repartitionByRange(parts, *KEYS) if parts > 1 else df.repartition(1)
        sorted_ = dealt.sortWithinPartitions(*KEYS)
        sorted_.write.mode("overwrite").option("parquet.block.size", self.block_bytes).parquet(f"{self.folder}/{folder}")

    def apply(self, batch: DataFrame, number: int, max_runs: int = 0, listing: DataFrame | None = None) -> bool:
        """Takes in a batch of points under its number; listing has runs that may have no points. Whether anything changed."""
        known = self.manifest()
        if number <= known["batch"]:
            return False
        stage = f"{self.folder}/stage-{number}"
        batch.select(*[c.split()[0] for c in POINTS.split(", ")]).write.mode("overwrite").parquet(stage)
        raw = self.spark.read.schema(POINTS).parquet(stage)
        counts = f"{self.folder}/counts-{number}"
        summary.counted(self.series(known), summary.offered(raw), self.cap).write.mode("overwrite").parquet(counts)
        counts = self.spark.read.parquet(counts)
        facts = counts.agg(F.sum(F.col("offered") - F.col("before")).alias("n"), F.max("stride").alias("most"), F.bool_or("grown").alias("grown")).first()
        next_ = {**known, "batch": number, "parts": list(known["parts"])}
        found = raw.select("run", F.split("path", "/").alias("path_parts")).groupBy("run").agg(F.min("path_parts").alias("path_parts"))
        if listing is not None:
            listing = listing.select("run", "path_parts")
            found = listing.unionByName(found.join(listing, "run", "left_anti"))
        found, old = found.persist(), self._read(known["runs"], RUNS)
        try:
            if not found.join(old, "run", "left_anti").isEmpty():
                slots = catalog.assign_slots(old.select("run", "color_slot"), found)
                runs = slots.join(catalog.admit_runs(old.select("run", "enabled"), found.select("run"), max_runs), "run")
                next_["runs"] = f"runs-{number}"
                runs.select("run", "color_slot", "enabled").repartition(1).write.mode("overwrite").parquet(f"{self.folder}/{next_['runs']}")
        finally:
            found.unpersist()
        if facts["n"]:
            self._append(raw, counts, facts, number, known, next_)
        changed = bool(facts["n"]) or next_["runs"] != known["runs"]
        if changed:
            self._swap(next_)
        self._sweep()
        return changed

    def _append(self, raw: DataFrame, counts: DataFrame, facts: Row, number: int, known: dict, next_: dict) -> None:
        indexed = thin.with_arrival_index(raw).join(counts.select("run", "tag", "before", "stride"), ["run", "tag"])
        indexed = indexed.withColumn("arrival_index", F.col("arrival_index") + F.col("before")).where(F.pmod("arrival_index", "stride") == 0)
        part = {"folder": f"part-{number}-0", "class": 0, "points": facts["n"]}
        self._write(indexed.select(*[c.split()[0] for c in DATA.split(", ")]), part["folder"], facts["n"])
        next_["parts"].append(part)
        next_["thinned"] = facts["most"] > 1
        ends = summary.ends(self._read(part["folder"], DATA)).withColumnRenamed("first", "new_first").withColumnRenamed("last", "new_last")
        merged = counts.join(ends, ["run", "tag"], "left").withColumn("first", F.least("first", "new_first")).withColumn("last", F.greatest("last", "new_last"))
        if facts["grown"]:  # of a series whose stride grew the last point may be out
            grown = counts.where("grown").select("run", "tag", "stride")
            again = summary.ends(self.points(next_, grown)).withColumnRenamed("first", "all_first").withColumnRenamed("last", "all_last")
            merged = merged.join(again, ["run", "tag"], "left").withColumn("first", F.coalesce("all_first", "first")).withColumn("last", F.coalesce("all_last", "last"))
        next_["series"] = f"series-{number}"
        merged.select("run", "tag", "offered", "stride", "least_wall", "first", "last").repartition(1).write.mode("overwrite").parquet(f"{self.folder}/{next_['series']}")
        self._merge(number, next_)

    def _merge(self, number: int, manifest: dict) -> None:
        """Merges parts while any size class has ``FAN`` of them."""
        level = 0
        while len(own := [p for p in manifest["parts"] if p["class"] == level]) >= FAN:
            rows = self.points({**manifest, "parts": own})
            part = {"folder": f"part-{number}-{level + 1}", "class": level + 1, "points": sum(p["points"] for p in own)}
            self._write(rows, part["folder"], part["points"])
            manifest["parts"] = [p for p in manifest["parts"] if p["class"] != level] + [part]
            level += 1
