"""The Spark data source ``tfevents``: batch and streaming reads of event files, and writes.

    spark.dataSource.register(EventFiles)
    spark.read.format("tfevents").load(logdir)                              # points
    spark.read.format("tfevents").option("view", "listing").load(logdir)    # files, without opening one
    spark.read.format("tfevents").option("view", "files").load(logdir)      # how far each can be read
    spark.read.format("tfevents").option("view", "errors").load(logdir)     # damaged and unreadable files
    spark.read.format("tfevents").option("view", "checksums").load(logdir)  # records with wrong checksums
    spark.readStream.format("tfevents").load(logdir)
    points.write.format("tfevents").mode("append").save(logdir)

Planning opens no file: a partition is a range of about ``splitBytes`` of a file, and its task finds where its records begin and end (``splits``); a damaged record ends its own
range only. With the option ``pushdown``, which needs ``spark.sql.python.filterPushdown.enabled`` (``read`` sees to both), equality and IN filters on run and tag are taken over: files of other
runs are not opened, and points of other tags never become rows.

Streaming: the offset is a map from file to its length, as listed. Tasks read up to the last whole record, and the one that reaches it notes the place in a ledger in ``stateDir`` (a folder that driver and executors
share), under the file and the length it was read at; the next batch goes on from there, so a record that is still being written waits, and a batch that is run again starts and ends where it did. ``maxBytesPerTrigger`` bounds what a micro-batch takes of each file, ``maxFilesPerTrigger`` how
many files it takes from. A damaged record is found while reading: the task leaves a mark in ``stateDir`` and the file is never read again.

A range that cannot be read to its end gives no points, in batches as in streams.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from curvemill.schema import CHECKSUMS, ERRORS, FILES, LISTING, POINTS
from curvemill.sources import files, ledger, splits
from curvemill.sources.columnar import Columns, encode

NAMES = ("run", "tag", "step", "wall", "value", "path", "rec_off", "val_idx")
SPLIT_BYTES = 32 << 20
#: Small files of the ledger that are read or deleted at the same time.
WALKERS = 16


#: Ranges of one read, beyond which they are widened up to what a task reads to prove a start.
MANY = 1024


@dataclass
class Range(InputPartition):
    """Records of a file from start to stop. Where ``every`` is set, start is the place of a range of so many bytes, and the task finds the records; length is the file's, as listed."""

    run: str
    path: str
    parts: tuple
    start: int
    stop: int | None
    length: int = 0
    every: int = 0
    exact: bool = True
    limit: int | None = None


def ranges(f: files.EventFile, low: int, every: int, limit: int | None = None) -> list[Range]:
    """Ranges of a file from the start of a record on, the file as long as listed or cut at limit."""
    length = f.length if limit is None else limit
    if not every or length - low <= every:
        return [Range(f.run, f.path, f.parts, low, None, length, limit=limit)]
    return [Range(f.run, f.path, f.parts, at, None, length, every, at == low, limit) for at in range(low, length, every)]


def widened(every: int, total: int) -> int:
    """The bytes of a range where so many are read in all: each task reads ``splits.PROOF`` to find its start, so many ranges of less would read everything again and again."""
    return every and max(every, min(splits.PROOF, -(-total // MANY)))


@dataclass
class State:
    """How far whole records of a range reach, whether no later range of the file has any, and whether the file is dead, and why."""

    at: int
    dead: bool = False
    why: str | None = None
    last: bool = True


def _batch(part: Range, found: Columns) -> pa.RecordBatch:
    n = len(found.step)
    same = lambda text: pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([text])).cast(pa.string())
    tag = pa.DictionaryArray.from_arrays(pa.array(found.tag), pa.array(found.tags, pa.string())).cast(pa.string())
    columns = [same(part.run), tag, pa.array(found.step), pa.array(found.wall), pa.array(found.value), same(part.path), pa.array(found.rec_off), pa.array(found.val_idx)]
    return pa.RecordBatch.from_arrays(columns, names=list(NAMES))


def _points(part: Range, state: State, tags: frozenset | None = None) -> Iterator[pa.RecordBatch]:
    """The points of a range, once all of it could be read; its state goes along."""
    held: list[Columns] = []
    start, stop = part.start, part.stop
    try:
        if part.every:
            with files.open_file(part.path) as source:
                own = splits.bounds(source, part.start, part.every, part.length, part.exact)
            state.last = own is not None and own[1] is None
            if own is None:
                return
            start, stop = own
            state.at = start
        for found in files.read_range(part.path, start, stop, tags=tags, limit=part.limit):
            state.at += found.consumed
            if len(found.step):
                held.append(found)
            if found.corrupt:
                state.dead, state.why = True, "damaged record"
    except OSError as e:
        state.dead, state.why = True, str(e)
        return
    for found in held:
        yield _batch(part, found)


def _state(part: Range) -> State:
    state = State(part.start)
    for _ in _points(part, state, frozenset()):
        pass
    return state


class _Reader(DataSourceReader):
    def __init__(self, path: str, view: str, split: int) -> None:
        self.path, self.view, self.split = path, view, split
        self.only: dict[str, frozenset] = {}

    def partitions(self) -> list[Range]:
        found = [f for f in files.discover(self.path) if "run" not in self.only or f.run in self.only["run"]]
        every = widened(self.split, sum(f.length for f in found)) if self.view == "points" else 0
        return [r for f in found for r in ranges(f, 0, every)]

    def read(self, part: Range) -> Iterator:
        if self.view == "points":
            yield from _points(part, State(part.start), self.only.get("tag"))
        elif self.view == "checksums":
            yield (part.run, part.path, *files.checksums(part.path))
        elif self.view == "listing":
            yield (part.run, part.path, list(part.parts), part.length)
        else:
            state = _state(part)
            if self.view == "files":
                yield (part.run, part.path, list(part.parts), part.length, state.at, state.dead, state.why)
            elif state.dead:
                yield (part.run, part.path, state.at, state.why)


class _PushingReader(_Reader):
    """Takes over filters; Spark refuses such a reader while its setting for this is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if self.view == "points" and name in ("run", "tag"):
                values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.only[name] = self.only.get(name, values) & values
            else:
                yield f


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, most: int, most_files: int, state: str, split: int) -> None:
        self.path, self.most, self.most_files, self.state, self.split = path, most, most_files, state, split
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        """The files' lengths as listed; no file is opened but the marks of dead ones."""
        ends, dead, moved = ledger.ends(self.state), ledger.dead(self.state), 0
        for f in files.discover(self.path):
            at = self.known.setdefault(f.path, ends.get(ledger.name_of(f.path), 0))  # a file without a whole record is a run, too
            if at < f.length and f.path not in dead and moved < self.most_files:  # a file that shrank waits at its old offset
                self.known[f.path], moved = min(f.length, at + self.most), moved + 1
        return {"files": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.known = {**after, **self.known}
        dead = ledger.dead(self.state)
        grown = [f for f in files.discover(self.path) if after.get(f.path, 0) > before.get(f.path, 0) and dead.get(f.path, 1 << 62) > before.get(f.path, 0)]
        with ThreadPoolExecutor(WALKERS) as readers:
            places = list(readers.map(lambda f: ledger.place(self.state, f.path, before.get(f.path, 0)), grown))
        every = widened(self.split, sum(after[f.path] - at for f, at in zip(grown, places)))
        return [r for f, at in zip(grown, places) for r in ranges(f, at, every, after[f.path])]

    def read(self, part: Range) -> Iterator:
        state = State(part.start)
        yield from _points(part, state)
        if state.dead:
            ledger.bury(self.state, part.path, part.length, state.at, part.run, state.why)
        if state.last:
            ledger.note(self.state, part.path, part.length, state.at)

    def commit(self, end: dict) -> None:
        """Forgets the places before those that the next batch starts from."""
        ledger.forget(self.state, json.loads(end["files"]), WALKERS)


@dataclass
class Written(WriterCommitMessage):
    moves: list


class _Writer(DataSourceArrowWriter):
    """Each task writes one file a run under a name that readers do not take for an event file; the commit gives them their names."""

    def __init__(self, path: str, tensor: bool, stem: str) -> None:
        self.path, self.tensor, self.stem = path, tensor, stem

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, top = files.file_system(self.path)
        context = TaskContext.get()
        task = f"{context.partitionId():06d}"
        moves, sinks = [], {}
        for batch in batches:
            runs = batch.column("run").dictionary_encode()
            tags = batch.column("tag").dictionary_encode()
            names = tags.dictionary.to_pylist()
            tag, (step, wall, value) = tags.indices.to_numpy(), (batch.column(c).to_numpy() for c in ("step", "wall", "value"))
            for k, run in enumerate(runs.dictionary.to_pylist()):
                if run not in sinks:
                    folder = top if run == "." else f"{top}/{run}"
                    system.create_dir(folder, recursive=True)
                    hidden = f"{folder}/.{self.stem}-{task}-{context.taskAttemptId()}.tmp"
                    moves.append((hidden, f"{folder}/events.out.tfevents.{self.stem}-{task}"))
                    sinks[run] = system.open_output_stream(hidden)
                own = np.flatnonzero(runs.indices.to_numpy() == k)
                sinks[run].write(encode(names, tag[own], step[own], wall[own], value[own], self.tensor))
        for sink in sinks.values():
            sink.close()
        return Written(moves)

    def commit(self, messages: list) -> None:
        system, _ = files.file_system(self.path)
        for message in messages:
            for hidden, name in message.moves if message else ():
                system.move(hidden, name)

    def abort(self, messages: list) -> None:
        system, _ = files.file_system(self.path)
        for message in messages:
            for hidden, _ in message.moves if message else ():
                system.delete_file(hidden)


class EventFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tfevents"

    def _path(self) -> str:
        if "path" not in self.options:
            raise ValueError("tfevents needs the path of a log directory")
        return self.options["path"]

    def schema(self) -> str:
        return {"points": POINTS, "errors": ERRORS, "files": FILES, "listing": LISTING, "checksums": CHECKSUMS}[self.options.get("view", "points")]

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = _PushingReader if str(self.options.get("pushdown", "false")).lower() == "true" else _Reader
        return kind(self._path(), self.options.get("view", "points"), int(self.options.get("splitBytes", SPLIT_BYTES)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        most = int(self.options.get("maxBytesPerTrigger", 1 << 62)), int(self.options.get("maxFilesPerTrigger", 1 << 62))
        if "stateDir" not in self.options:
            raise ValueError("a stream of tfevents needs stateDir, a folder that driver and executors share")
        return _StreamReader(self._path(), *most, self.options["stateDir"], int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("event files are only ever appended to; use mode append")
        import uuid

        return _Writer(self._path(), str(self.options.get("tensor", "false")).lower() == "true", self.options.get("stem", uuid.uuid4().hex[:12]))


def register(spark) -> None:
    spark.dataSource.register(EventFiles)


def read(spark, path: str, view: str = "points", **options):
    """The points, files or errors of a log directory."""
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tfevents").options(view=view, pushdown="true", **options).load(path)


def write(points, path: str, tensor: bool = False) -> None:
    """Appends points (run, tag, step, wall, value) as event files: ranges of runs and steps, each in order."""
    register(points.sparkSession)
    keys = ["run", "step", *[c for c in ("path", "rec_off", "val_idx") if c in points.columns]]
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = points.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged.select("run", "tag", "step", "wall", "value").write.format("tfevents").option("tensor", str(tensor).lower()).mode("append").save(path)
