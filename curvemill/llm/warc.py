"""WARC archives: an index first, then coalesced byte-range reads of the records that are asked for.

Writing: each record is one gzip member, so it can be read alone. Of records with equal payloads (by SHA-1 and
length, from ``min_revisit`` bytes on) that with the smallest page id is a response; the others are revisits, which refer to
it and carry no payload. A task appends its records to files of ``FILE_BYTES`` or so in the shared folder, and returns
an index row (file, offset, length, URL, digest, page) for each; the index is stored before anything is read. Files are
named by task attempt, and only the index names them, so what a lost executor left is never read.

Reading: index rows, whichever are selected, go in order of file and offset to tasks; ranges less
than ``GAP`` bytes apart are read as one, up to ``READ_BYTES``. The payload of a response that is read back is measured and hashed again; a revisit is held against the response it refers to.

Hot payloads: the first page of each digest is found by an aggregation that is combined before the exchange. It is joined back by digest
and adaptive execution splits large partitions; no task gathers a group.

Defined cases: a null html is an empty payload; a null URL is written as an empty one; a null page id is largest, and if all ids of a payload are
null all are responses; rows that repeat the smallest page id of their payload are all responses; an empty table writes no file and an empty index. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvemill.llm.shared import TASK_BYTES, as_uri, scratch_path, stored, tasks_for

FILE_BYTES = 256 << 20
GAP, READ_BYTES = 64 << 10, 8 << 20
INDEX = "file string, offset long, length long, url string, payload_digest string, page_id long"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def first_pages(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """(page_id, url, html, first): first is the smallest page id with the same payload, null if the row is to be a response."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    keyed = rows.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html"))
    smallest = keyed.where(F.col("size") >= min_revisit).groupBy("sha", "size").agg(F.min("page_id").alias("smallest"), F.count("*").alias("n"))
    smallest = smallest.where("n > 1").drop("n")
    joined = keyed.join(smallest, ["sha", "size"], "left")
    response = F.col("smallest").isNull() | F.coalesce(F.col("page_id") == F.col("smallest"), F.lit(False))
    return joined.select("page_id", "url", "html", F.when(~response, F.col("smallest")).alias("first"))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"urn:curvemill:page:{'' if page_id is None else page_id}"


def encode_record(page_id: int | None, url: str, payload: bytes, first: int | None) -> tuple[bytes, str]:
    """One gzip member with the record, and the payload's digest."""
    digest = sha1_base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if first is None else http
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{record_name(page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if first is not None:
        lines += [f"WARC-Refers-To: <{record_name(first)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush(), digest


class Damaged(ValueError):
    """A record whose payload is not what its header says."""


def decode_record(member: bytes) -> tuple[int | None, str, bytes, int, str, str, int | None]:
    """The fields of RECORD, from one gzip member: of a response its payload's measured length and digest, which must be those of the header; of a revisit those of the header."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b": ")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
    page = lambda name: int(x) if (x := name.strip("<>").rpartition(":")[2]) else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload), sha1_base32(payload)) != (size, digest):
        raise Damaged(fields["WARC-Record-ID"])
    return page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload, size, digest, kind, page(fields["WARC-Refers-To"]) if kind == "revisit" else None


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        context, out, number, offset = TaskContext.get(), None, 0, 0
        name = ""
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, html, first in zip(*(batch.column(c) for c in ("page_id", "url", "html", "first"))):
                if out is None or offset >= FILE_BYTES:
                    if out:
                        out.close()
                    name, offset = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}-{number}.warc.gz", 0
                    out, number = files.open_output_stream(f"{path}/{name}", compression=None), number + 1
                member, digest = encode_record(page_id.as_py(), url.as_py(), html.as_py().encode(), first.as_py())
                out.write(member)
                rows.append((name, offset, len(member), url.as_py(), digest, page_id.as_py()))
                offset += len(member)
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = ["file", "offset", "length", "url", "payload_digest", "page_id"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        if out:
            out.close()

    return write


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html); returns the stored index."""
    return stored(first_pages(pages, min_revisit).mapInArrow(_writer(folder), INDEX), "warc-index")


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """Sorted (offset, length) ranges -> (i, j, offset, length): ranges i..j-1 lie in one read."""
    i = 0
    while i < len(ranges):
        start, stop, j = ranges[i][0], ranges[i][0] + ranges[i][1], i + 1
        while j < len(ranges) and ranges[j][0] - stop <= gap and ranges[j][0] + ranges[j][1] - start <= most:
            stop, j = max(stop, ranges[j][0] + ranges[j][1]), j + 1
        yield i, j, start, stop - start
        i = j


def _reader(folder: str, payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = FileSystem.from_uri(folder)
        name, source = None, None
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            where = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            i = 0
            while i < len(where):
                j = i
                while j < len(where) and where[j][0] == where[i][0]:
                    j += 1
                if where[i][0] != name:
                    if source:
                        source.close()
                    name, source = where[i][0], files.open_input_file(f"{path}/{where[i][0]}")
                ranges = [(o, n) for _, o, n in where[i:j]]
                for a, b, start, size in coalesce_ranges(ranges):
                    block = source.read_at(size, start)
                    rows = [decode_record(block[o - start : o - start + n]) for o, n in ranges[a:b]]
                    columns = [list(c) for c in zip(*rows)]
                    if not payload:
                        columns[2] = [None] * len(rows)
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
                i = j
        if source:
            source.close()

    return read


def read_records(selected: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records that the rows of ``selected``, part of an index, point to."""
    bytes_ = selected.agg(F.sum("length")).first()[0] or 0
    parts = max(tasks_for(selected), -(-bytes_ // TASK_BYTES))
    ordered = selected.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_reader(folder, payload), RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Records (stored) with the length and digest of revisits taken from the response they refer to, which must be the same as their own header says."""
    revisits = records.where("record_type = 'revisit'")
    # One row a response that is referred to, known by its page and digest: pages that share an id may hold different payloads. Many revisits of one
    # are a large partition of the other side, which adaptive execution can split.
    first = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("first"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("bytes"))
    joined = revisits.join(first, (revisits["refers_to"] == first["first"]) & (revisits["payload_digest"] == first["digest"]), "left")
    same = F.col("payload_bytes") == F.col("bytes")
    checked = lambda c: F.when(same, F.col(c)).otherwise(F.raise_error(F.concat(F.lit("revisit without its response: "), F.coalesce(F.col("page_id").cast("string"), F.lit("?")))))
    found = {"payload_bytes": checked("bytes").cast("long"), "payload_digest": checked("digest").cast("string")}
    return records.where("record_type = 'response'").unionByName(joined.select(*[found.get(c, F.col(c)).alias(c) for c in records.columns]))


def archive_round_trip(spark: SparkSession, pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Writes archives of pages into a new folder of the shared one, reads every record back, measures payloads and follows revisits to their responses."""
    folder = as_uri(scratch_path(spark, "warc"))
    return resolved(stored(read_records(write_archives(pages, folder, min_revisit), folder, payload=False), "warc-records"))


#: DuckDB has no base 32: the 40 hex digits are read as 32 groups of 5 bits.
WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
f AS (SELECT hex, payload_bytes, min(page_id) AS first FROM d GROUP BY ALL)
SELECT d.page_id, d.payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(d.hex, 1 + (5 * k) // 4, 2)
         )::BIGINT >> (3 - (5 * k) % 4)) & 31)::INT, 1) FOR k IN range(32)], '') AS payload_digest,
       CASE WHEN d.page_id = f.first OR f.first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id <> f.first OR (d.page_id IS NULL AND f.first IS NOT NULL) THEN f.first END AS refers_to
FROM d JOIN f USING (hex, payload_bytes)
"""
