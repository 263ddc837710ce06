"""What the corpus operators share: tables, the shared scratch folder and word patterns."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local Spark gets a temporary one; a cluster has none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="curvemill-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


_RECORD: ContextVar[list[str] | None] = ContextVar("scratch paths", default=None)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The scratch paths that this thread makes within the block, in order."""
    paths: list[str] = []
    token = _RECORD.set(paths)
    try:
        yield paths
    finally:
        _RECORD.reset(token)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/curvemill/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    if (paths := _RECORD.get()) is not None:
        paths.append(path)
    return path


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch paths that no unread DataFrame needs any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Whole texts that Spark hands to Python at once: by its own 10,000, a batch takes tens of MB in each of an executor's tasks and again in their Python workers.
TEXTS = 2000
#: Bytes of them at which a batch is closed, so that long texts come in shorter batches.
TEXT_BYTES = 1 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_short_lock = threading.Lock()
#: By session: how many threads have batches of texts in it now, and the settings before.
_short: dict[str, tuple[int, tuple[str, str | None]]] = {}


@contextmanager
def batches_of_texts(spark: SparkSession) -> Iterator[None]:
    """Within the block, Spark hands at most ``TEXTS`` rows and, unless the session says otherwise, ``TEXT_BYTES`` to Python at once; then the session has its own settings again."""
    session = spark._jsparkSession.sessionUUID()
    with _short_lock:
        inside, own = _short.get(session) or (0, (spark.conf.get(_ROWS), spark.conf.get(_BYTES, None)))
        _short[session] = inside + 1, own
        if not inside and not 0 < int(own[0]) <= TEXTS:
            spark.conf.set(_ROWS, str(TEXTS))
        if not inside and own[1] is None:
            spark.conf.set(_BYTES, str(TEXT_BYTES))
    try:
        yield
    finally:
        with _short_lock:
            inside, own = _short.pop(session)
            if inside > 1:
                _short[session] = inside - 1, own
            else:
                spark.conf.set(_ROWS, own[0])
                if own[1] is None:
                    spark.conf.unset(_BYTES)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_texts(df: DataFrame, label: str) -> DataFrame:
    """``stored`` for what Python makes of whole texts."""
    with batches_of_texts(df.sparkSession):
        return stored(df, label)


#: What a broadcast table may take in memory, by ``memory_bytes``.
BROADCAST_BYTES = 64 << 20
#: Bytes of a row of a hashed table besides its values; how much larger texts are in memory than in files.
ROW_BYTES, INFLATION = 40, 4


def memory_bytes(table: DataFrame) -> int:
    """A bound of what a stored table takes as a hashed relation: its rows times their fixed width, and its files unpacked."""
    return table.count() * (ROW_BYTES + 8 * len(table.columns)) + INFLATION * file_bytes(table)


def fits_memory(table: DataFrame) -> bool:
    """Whether a stored table may be broadcast; rows are counted only if the files alone do not exceed the bound."""
    return INFLATION * file_bytes(table) <= BROADCAST_BYTES and memory_bytes(table) <= BROADCAST_BYTES


def small(table: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it is small enough in memory; else it is joined as Spark sees fit."""
    return F.broadcast(table) if fits_memory(table) else table


#: Bytes of input files that one task of an exchange with a fixed number of partitions gets.
TASK_BYTES = 128 << 20


def file_bytes(df: DataFrame) -> int:
    """Bytes of what a DataFrame reads, as Spark estimates them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def tasks_for(df: DataFrame) -> int:
    """Partitions for an exchange of all rows: those of the session, or more where the input is large (and its size is known)."""
    size = file_bytes(df)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES) if size < 1 << 60 else 1)


def as_uri(path: str) -> str:
    """The path as a URI that pyarrow's file systems take; Hadoop writes file:/x for file:///x."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[5:]
    return path if "://" in path else f"file://{path}"
