"""Token ids in Arrow files of equal-length sequences, readable in place.

``write_tokens`` encodes every text, appends an end id and lays the ids of all documents, in ascending
order of their ids, end to end in Arrow IPC files. A file holds record batches of two fixed-size-list
columns: ``tokens`` (``length`` ids; 16-bit if the vocabulary allows, else 32-bit) and ``mask`` (as many booleans, false in the padding of a
file's last sequence). Batches are not compressed, so a memory-mapped file gives any sequence without a copy.
An index table (file number, document, first id, number of ids) is written beside them as Parquet.

Ranges of document ids form the files: one range exchange of the texts, as many ranges as their bytes ask for, a sort within each range, and
encoding as the rows stream by; a file is closed at ``FILE_IDS`` ids or so. File names carry the task attempt, and only the index names files, so what a lost
executor left half-written is never read.

Encoding equals the tokenizers library's own on whole texts, but each distinct piece of text is encoded
once per worker: byte-level BPE never merges across pre-tokens, so pre-token bounds are found for whole
batches with numpy, a pre-token of up to 16 bytes is known by these bytes mixed into one number (a longer one by a digest; unequal ones of equal
length up to 8 bytes never collide, others with a chance of 2^-64 a pair), and only unseen ones go to the library. Texts with characters outside ASCII and the Latin
letters up to U+024F, control characters, or the text of a special token go to the library whole, as do all texts if the tokenizer file
has a normalizer or any other pre-tokenizer than the byte-level one. The width of ids follows from the file's vocabulary.

Defined cases: a null text is empty (one end id); null document ids come first; repeated rows are written
each on its own, equal ids in order of their texts' hashes; an empty table gives no file and an empty index; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvemill.llm.shared import as_uri, scratch_path, stored_texts, tasks_for
from curvemill.llm.textbuf import FORGET, Texts, mix64, pieces, tidy

LENGTH = 2048
#: Sequences in a record batch.
BATCH = 256
#: Distinct pre-tokens a worker remembers before it starts anew, and how many ids they may have on average.
REMEMBERED, MOST_IDS = 800_000, 8
#: Bytes of texts that are encoded together; unseen pre-tokens that go to the library together; ids after which a file is closed.
ENCODED_BYTES, LEARNED, FILE_IDS = 1 << 20, 4096, 1 << 28
INDEX = "file string, doc_id long, first long, n_tokens long"

LETTER, DIGIT, SPACE, OTHER, STRANGE = range(5)


@lru_cache(1)
def byte_classes() -> np.ndarray:
    kind = np.full(256, STRANGE, np.uint8)
    kind[33:127] = OTHER
    kind[48:58] = DIGIT
    kind[65:91] = kind[97:123] = LETTER
    kind[[9, 10, 13, 32]] = SPACE
    kind[0x80:0xC0] = LETTER  # second bytes of Latin letters
    kind[0xC3:0xCA] = LETTER
    return kind


_STRANGE_BYTE = byte_classes() == STRANGE


def pre_tokens(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of plain texts; first marks the first byte of each text, and has one item more than data."""
    kind = byte_classes()[data]
    starts = first[:-1].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    last_space = (kind == SPACE) & ~first[1:]
    last_space[:-1] &= kind[1:] != SPACE
    if len(data):
        last_space[-1] = False
    at = np.flatnonzero(last_space)
    starts[at] = True
    starts[at[data[at] == 32] + 1] = False
    quotes = np.flatnonzero(data == 39)
    if len(quotes):
        before = kind[np.maximum(quotes - 1, 0)]
        loose = first[quotes] | (before <= DIGIT) | ((before == SPACE) & (data[quotes - 1] != 32))
        for i in quotes[loose]:
            room = i + 1
            while room < min(i + 4, len(data)) and not first[room] and kind[room] == LETTER:
                room += 1
            tail = bytes(data[i + 1 : room])
            size = 1 if tail[:1] in (b"s", b"t", b"m", b"d") else 2 if tail[:2] in (b"re", b"ve", b"ll") else 0
            if size:
                starts[i + 1] = False
                if i + 1 + size < len(data):
                    starts[i + 1 + size] = True
    return np.flatnonzero(starts)


def byte_level(path: str) -> bool:
    """Whether a tokenizer file cuts texts as ``pre_tokens`` does, and has no normalizer."""
    with open(path, encoding="utf-8") as file:
        known = json.load(file)
    cut = known.get("pre_tokenizer") or {}
    return not known.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a tokenizer file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0) + 1


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def pre_token_keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each pre-token, from its bytes: eight are read at a time, wherever they begin."""
    room = np.concatenate((data, np.zeros(16, np.uint8)))
    eight = np.ndarray(len(data) + 9, "<u8", room, strides=(1,))
    low = eight[starts] & _LOW_BYTES[np.minimum(sizes, 8)]
    high = eight[starts + np.minimum(sizes, 8)] & _LOW_BYTES[np.clip(sizes - 8, 0, 8)]
    keys = mix64(low + mix64(high ^ (sizes.astype(np.uint64) << np.uint64(56))))
    for i in np.flatnonzero(sizes > 16).tolist():
        word = data[starts[i] : starts[i] + sizes[i]].tobytes()
        keys[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest())
    return keys


class Encoder:
    """Encodes batches of texts; remembers the ids of the pre-tokens it has met."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.cuts = byte_level(path)
        self.forget()

    def forget(self) -> None:
        """keys: of the known pre-tokens, in ascending order, and place: the number of each; at and size: where its ids are."""
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.at, self.size = np.zeros(0, np.uint16), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def tokens_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, one after another, and how many each has."""
        found = [e.ids for i in range(0, len(words), LEARNED) for e in self.library.encode_batch_fast(words[i : i + LEARNED], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def whole(self, text: str) -> np.ndarray:
        """The ids of a text that is not plain."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def cut(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the pre-tokens of plain texts; first as for ``pre_tokens``."""
        starts = pre_tokens(data, first)
        return starts, np.diff(starts, append=len(data))

    def learn(self, keys: np.ndarray, words: list[str]) -> np.ndarray:
        """The places of pre-tokens that are not known yet."""
        ids, sizes = self.tokens_of(words)
        new = np.arange(len(self.at), len(self.at) + len(words), dtype=np.int32)
        if self.ids.dtype == np.uint16 and ids.max(initial=0) < 1 << 16:
            ids = ids.astype(np.uint16)
        starts = len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes
        self.at = np.concatenate((self.at, starts.astype(np.int32 if len(self.ids) + len(ids) < 1 << 31 else np.int64)))
        self.ids = np.concatenate((self.ids, ids))
        self.size = np.concatenate((self.size, sizes))
        order = np.argsort(keys)
        where = np.searchsorted(self.keys, keys[order])
        self.keys, self.place = np.insert(self.keys, where, keys[order]), np.insert(self.place, where, new[order])
        return new

    def plain(self, texts: Texts) -> np.ndarray:
        """Whether each text has nothing but ASCII and Latin letters, and no special token."""
        data = texts.data
        bad = np.zeros(texts.n, bool)
        if not self.cuts:
            return bad
        owner = lambda at: np.searchsorted(texts.offsets, at, side="right") - 1
        bad[owner(np.flatnonzero(_STRANGE_BYTE[data]))] = True
        latin = np.flatnonzero(data[:-1] == 0xC3)  # among them the signs for times and divide
        bad[owner(latin[(data[latin + 1] | 0x20) == 0xB7])] = True
        whole = data.tobytes()
        for token in self.special:
            i = whole.find(token)
            while i >= 0:
                bad[owner(i)] = True
                i = whole.find(token, i + 1)
        return ~bad

    def prepared(self, column: pa.Array) -> tuple[Texts, np.ndarray]:
        """The texts as they are cut, and which of them are plain."""
        texts = Texts(column)
        return texts, self.plain(texts)

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, each text closed by end; and the number of ids of each text."""
        texts, plain = self.prepared(column)
        if len(self.keys) > REMEMBERED or len(self.ids) > MOST_IDS * REMEMBERED:
            self.forget()
        odd = {i: self.whole(column[i].as_py() or "") for i in np.flatnonzero(~plain).tolist()}
        if len(odd) == texts.n:
            places = np.zeros(0, np.int64)
            first = np.zeros(texts.n + 1, np.int64)
        else:
            places, first = self._places(texts, plain)
        # places: where the ids of each pre-token of the plain texts are; first: the first pre-token of each text
        sizes = self.size[places]
        stop = np.concatenate(([0], np.cumsum(sizes)))
        count = np.diff(stop[first])
        for i, ids in odd.items():
            count[i] = len(ids)
        count += 1
        last = np.cumsum(count)
        ids = self.ids[np.repeat(self.at[places] - stop[:-1], sizes) + np.arange(stop[-1])].astype(np.uint32)
        if not odd:
            return np.insert(ids, stop[first[1:]], np.uint32(end)), count
        out = np.full(int(last[-1]), end, np.uint32)
        target = np.ones(len(out), bool)
        target[last - 1] = False
        for i, own in odd.items():
            out[last[i] - count[i] : last[i] - 1] = own
            target[last[i] - count[i] : last[i]] = False
        out[target] = ids
        return out, count

    def _places(self, texts: Texts, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = np.zeros(len(texts.data) + 1, bool)
        mark[texts.offsets] = True
        starts, sizes = self.cut(texts.data, mark)
        first = np.searchsorted(starts, texts.offsets)
        if not plain.all():
            keep = np.repeat(plain, np.diff(first))
            starts, sizes = starts[keep], sizes[keep]
            first = np.concatenate(([0], np.cumsum(np.where(plain, np.diff(first), 0))))
        codes, keys = pd.factorize(pre_token_keys(texts.data, starts, sizes))
        places = np.full(len(keys), -1, np.int32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            places = np.where(self.keys[at] == keys, self.place[at], places)
        new = np.flatnonzero(places < 0)
        if len(new):
            one = np.empty(len(keys), np.int64)
            one[codes] = np.arange(len(codes))
            raw, one = texts.data.tobytes(), one[new]
            places[new] = self.learn(keys[new], [raw[i:j].decode() for i, j in zip(starts[one].tolist(), (starts[one] + sizes[one]).tolist())])
        return places[codes], first


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process: its memory of pre-tokens outlives a task, until a task of another step comes."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each thread of the library keeps memory of its own
    return Encoder(path)


FORGET.append(encoder.cache_clear)


class SequenceWriter:
    """Lays ids end to end in fixed-size-list batches of one Arrow file."""

    def __init__(self, folder: str, number: int, length: int, wide: bool) -> None:
        context = TaskContext.get()
        name = f"tokens-{context.partitionId():07d}-{number:05d}-{context.taskAttemptId()}.arrow"
        files, path = FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        self.name, self.length, self.kind = name, length, np.uint32 if wide else np.uint16
        self.schema = sequence_schema(length, wide)
        self.sink = files.open_output_stream(f"{path}/{name}")
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.rest: list[np.ndarray] = []
        self.waiting = self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids.astype(self.kind))
        self.waiting += len(ids)
        self.written += len(ids)
        if self.waiting >= self.length * BATCH:
            self.flush(False)

    def flush(self, close: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, self.kind)
        step = self.length * BATCH
        whole = len(ids) // step * step
        for i in range(0, whole, step):
            self.batch(ids[i : i + step], step)
        if close and whole < len(ids):
            last = ids[whole:]
            room = -(-len(last) // self.length) * self.length
            self.batch(np.concatenate((last, np.zeros(room - len(last), self.kind))), len(last))
        self.rest, self.waiting = [ids[whole:]], len(ids) - whole

    def batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, mask), self.schema)]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        self.flush(True)
        self.writer.close()
        self.sink.close()


def sequence_schema(length: int, wide: bool) -> pa.Schema:
    kind = pa.uint32() if wide else pa.uint16()
    item = lambda t: pa.list_(pa.field("item", t, nullable=False), length)
    return pa.schema([pa.field("tokens", item(kind), nullable=False), pa.field("mask", item(pa.bool_()), nullable=False)])


class SequenceReader:
    """Random access to the ids of one file: maps it where the file system allows, else reads the batches asked for."""

    def __init__(self, folder: str, name: str) -> None:
        files, path = FileSystem.from_uri(folder)
        if files.type_name == "local":
            self.source = pa.memory_map(f"{path}/{name}")
        else:
            self.source = files.open_input_file(f"{path}/{name}")
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("tokens").type.list_size
        self.held = (-1, None)

    def batch(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            self.held = (k, self.reader.get_batch(k).column(0).flatten().to_numpy())
        return self.held[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and mask of sequence k of the file."""
        b = self.reader.get_batch(k // BATCH).slice(k % BATCH, 1)
        return b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False)

    def ids(self, first: int, n: int) -> Iterator[np.ndarray]:
        """The ids first .. first + n - 1 in parts, each within one batch."""
        step = self.length * BATCH
        while n > 0:
            k, at = divmod(first, step)
            part = self.batch(k)[at : at + n]
            yield part
            first, n = first + len(part), n - len(part)

    def close(self) -> None:
        self.held = (-1, None)
        self.source.close()


def _writer(folder: str, tokenizer: str, end: int, length: int, wide: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, number = None, 0
        for batch in batches:
            for part in pieces(batch, "text", ENCODED_BYTES):
                if out and out.written >= FILE_IDS:
                    out.close()
                    out, number = None, number + 1
                out = out or SequenceWriter(folder, number, length, wide)
                ids, count = encoder(tokenizer).encode(part.column("text"), end)
                first = out.written + np.cumsum(count) - count
                out.add(ids)
                yield pa.record_batch([pa.array([out.name] * part.num_rows), part.column("doc_id"), pa.array(first), pa.array(count)], names=["file", "doc_id", "first", "n_tokens"])
        if out:
            out.close()

    return write


def write_tokens(docs: DataFrame, tokenizer: str, end: int, folder: str, *, length: int = LENGTH) -> DataFrame:
    """Writes the token files of docs (doc_id, text) to folder and returns their index, stored as Parquet."""
    wide = max(vocabulary_size(tokenizer), end + 1) > 1 << 16
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = (F.col("doc_id"), F.xxhash64("text"))
    ranged = ranged.repartitionByRange(tasks_for(docs), *order)
    index = ranged.sortWithinPartitions(*order).mapInArrow(tidy(_writer(folder, tokenizer, end, length, wide), remembers=True), INDEX)
    return stored_texts(index, "token-index")


def _crc(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: SequenceReader | None = None
        name = None
        for batch in batches:
            sums = []
            for file, first, n in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), batch.column("n_tokens").to_pylist()):
                if file != name:
                    if held:
                        held.close()
                    held, name = SequenceReader(folder, file), file
                value = 0
                for part in held.ids(first, n):
                    value = zlib.crc32(part.astype("<u4").tobytes(), value)
                sums.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*batch.schema.names, "ids_crc32"])
        if held:
            held.close()

    return read


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its file; start counts the ids of all documents before it."""
    # One row a file: as many as the write had tasks.
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("total").over(before), F.lit(0))).select("file", "before")
    read = index.mapInArrow(tidy(_crc(folder)), INDEX + ", ids_crc32 long")
    joined = read.join(F.broadcast(totals), "file")
    return joined.select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def tokenize(spark: SparkSession, docs: DataFrame, tokenizer: str, end: int = 2, **options) -> DataFrame:
    """Writes docs to a new folder of the shared one, and reads the files back."""
    folder = as_uri(scratch_path(spark, "tokens"))
    return read_back(write_tokens(docs, tokenizer, end, folder, **options), folder)
