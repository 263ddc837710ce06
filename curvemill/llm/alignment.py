"""Alignment of two tokenizers' tokens of the same texts, and which tokens of one stand for which of the other corpus-wide.

The tokens of a text by A and by B are cut into groups at the byte offsets where tokens of both end. B's tokens form a static index of intervals, sorted by their starts and ends;
for each A token two bisections find the first and the last B token that it overlaps, and a gap between A tokens that the last of these does not span is a group boundary. All texts of
a batch lie in one index, each in its own bytes, so a batch takes two bisections of arrays.

Each pair of tokens of one group is a link. Links are kept as distinct id pairs of a document with their multiplicities, computed from the distinct ids of a group, so a long
group costs its distinct ids, not the square of its length. Documents with their pairs are stored once; counting pairs adds up partial counts before the exchange, and so does
finding the highest count of each A id, a table of at most A's vocabulary. Looking counts up again is a join with the most frequent pairs, a broadcast of at most ``HEAD`` rows, summed
by document on the spot; only pairs beyond those are exchanged. Both ways give the same sums.

Both tokenizers are remembered by pieces of text that no token crosses: byte-level pre-tokens for A; for B, blanks and what follows up to the next blank, if no piece of its vocabulary has
a blank after another character (else whole texts). A's special tokens in a text are plain text.

Defined cases: null and empty texts, and texts whose bytes either tokenizer does not give back, have no tokens, zeros and an empty digest; each row is a document of its own, repeated or not;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm.shared import small, stored
from curvemill.llm.textbuf import Texts, pieces, tidy
from curvemill.llm.tokens import Encoder, vocabulary_size
from curvemill.llm.transducer import byte_letters

ALIGNED_BYTES = 1 << 19
#: Links of a group that are counted one by one; of more, by distinct ids.
LONG_GROUP = 256
#: Id pairs that are broadcast for looking up counts.
HEAD = 1 << 19
DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class _Side(Encoder):
    """An encoder that knows the bytes of its tokens, and which pieces of text they give back."""

    def token_bytes(self) -> list[bytes]:
        raise NotImplementedError

    def forget(self) -> None:
        super().forget()
        if not hasattr(self, "lengths"):
            spelled = self.token_bytes()
            self.spelled = np.array(spelled, object)
            self.lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))

    def tokens_with_end(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the texts in a row, and how many each has."""
        ids, count = self.encode(column, 0)
        return np.delete(ids, np.cumsum(count) - 1), count - 1


class ByteSide(_Side):
    """A byte-level tokenizer file; its special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.library.encode_special_tokens = True
        self.special = []

    def token_bytes(self) -> list[bytes]:
        letters = {c: b for b, c in enumerate(byte_letters())}
        known = self.library.get_vocab(with_added_tokens=True)
        out = [b""] * (max(known.values(), default=-1) + 1)
        for text, i in known.items():
            out[i] = bytes(map(letters.__getitem__, text)) if set(text) <= letters.keys() else text.encode()
        return out


class PieceSide(_Side):
    """A sentencepiece model, which puts a blank before each text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.special = []
        blank = "▁"
        names = [self.library.id_to_piece(i) for i in range(len(self.library))]
        self.cuts = not any(blank in n.lstrip(blank) for n in names)
        self.forget()

    def token_bytes(self) -> list[bytes]:
        sp = self.library
        return [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(len(sp))]

    def plain(self, texts: Texts) -> np.ndarray:
        return np.full(texts.n, self.cuts)

    def tokens_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode([w[1:] for w in words], num_threads=1)
        for i, w in enumerate(words):
            if w == " ":  # the library puts no blank before an empty text
                found[i] = [self.library.piece_to_id("▁")]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum())), sizes

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text[1:]) if text else [], np.uint32)

    def cut(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blank = data == 32
        starts = first[:-1] | blank
        starts[1:] &= first[1:-1] | ~(blank[1:] & blank[:-1])
        at = np.flatnonzero(starts)
        return at, np.diff(at, append=len(data))


@lru_cache(2)
def sides(a: str, b: str) -> tuple[ByteSide, PieceSide]:
    """Both encoders of a worker process."""
    return ByteSide(a), PieceSide(b)


def group_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens of the same bytes, by the ends of A's and B's: the places of the A and of the B token that close each group."""
    if not len(a_ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b_starts = np.concatenate(([0], b_ends[:-1]))
    last = np.searchsorted(b_starts, a_ends, side="left") - 1  # the last B token that begins before the A token's end
    over = b_ends[last] == a_ends  # it does not span the gap after the A token
    return np.flatnonzero(over), last[over]


def links(a: np.ndarray, b: np.ndarray, a_close: np.ndarray, b_close: np.ndarray, doc: np.ndarray, b_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, multiplicity) of all groups, distinct, in ascending order; doc has the document of each group. A pair is A's id times ``b_ids`` plus B's."""
    a_size, b_size = np.diff(a_close, prepend=-1), np.diff(b_close, prepend=-1)
    product = a_size * b_size
    some = product <= LONG_GROUP
    a_from, b_from = a_close - a_size + 1, b_close - b_size + 1
    n = product[some]
    group = np.repeat(np.flatnonzero(some), n)
    k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    parts = [(doc[group], a[a_from[group] + k // b_size[group]].astype(np.int64) * b_ids + b[b_from[group] + k % b_size[group]], np.ones(len(group), np.int64))]
    for g in np.flatnonzero(~some).tolist():
        x, nx = np.unique(a[a_from[g] : a_close[g] + 1], return_counts=True)
        y, ny = np.unique(b[b_from[g] : b_close[g] + 1], return_counts=True)
        pairs = (x.astype(np.int64)[:, None] * b_ids + y).ravel()
        parts.append((np.full(len(pairs), doc[g]), pairs, np.outer(nx, ny).ravel()))
    where, pair, times = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((pair, where))
    where, pair, times = where[order], pair[order], times[order]
    new = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (pair[1:] != pair[:-1])))[: len(where)])
    return where[new], pair[new], np.add.reduceat(times, new) if len(new) else times


@lru_cache(8)
def _labels(n: int, end: str) -> np.ndarray:
    """Decimal numbers below n with a closing sign each."""
    return np.array([f"{i}{end}" for i in range(n)], object)


def digests(a: np.ndarray, b: np.ndarray, a_close: np.ndarray, b_close: np.ndarray, a_ids: int, b_ids: int) -> list[str]:
    """What each group is written as, with a semicolon after it: A's ids, a bar, B's ids."""
    out = np.empty(len(a) + len(b), object)
    a_group = np.searchsorted(a_close, np.arange(len(a)))
    b_group = np.searchsorted(b_close, np.arange(len(b)))
    a_before = np.concatenate(([0], b_close + 1))[a_group]  # B tokens written before each A token
    b_before = (a_close + 1)[b_group]
    words = _labels(a_ids, ",")[a]
    words[a_close] = _labels(a_ids, "|")[a[a_close]]
    out[np.arange(len(a)) + a_before] = words
    words = _labels(b_ids, ",")[b]
    words[b_close] = _labels(b_ids, ";")[b[b_close]]
    out[np.arange(len(b)) + b_before] = words
    return out.tolist()


def align(column: pa.Array, a_side: ByteSide, b_side: PieceSide) -> tuple[list[np.ndarray], list[str]]:
    """For each text n_a, n_b, n_groups and n_links, where its pairs are in the following pairs and multiplicities; and its digest."""
    spaced = pc.if_else(pc.greater(pc.fill_null(pc.binary_length(column), 0), 0), pc.binary_join_element_wise(" ", column, ""), "")
    texts = Texts(spaced)
    sizes = np.diff(texts.offsets)
    found = []
    good = sizes > 0
    for side in (a_side, b_side):
        ids, count = side.tokens_with_end(spaced)
        lengths = side.lengths[ids]
        ends = np.cumsum(lengths)
        last = np.concatenate(([0], np.cumsum(count)))
        total = np.concatenate(([0], ends))[last]
        same = np.diff(total) == sizes
        found.append([ids, count, lengths, last])
        good &= same
    raw = texts.data.tobytes()
    for i in np.flatnonzero(good).tolist():
        text = raw[texts.offsets[i] : texts.offsets[i + 1]]
        good[i] = all(b"".join(side.spelled[f[0][f[3][i] : f[3][i + 1]]].tolist()) == text for side, f in zip((a_side, b_side), found))
    ids, counts, ends = [], [], []
    for f in found:
        keep = np.repeat(good, f[1])
        ids.append(f[0][keep])
        counts.append(np.where(good, f[1], 0))
        ends.append(np.cumsum(f[2][keep]))
    a_close, b_close = group_ends(*ends)
    owner = np.repeat(np.arange(len(good)), counts[0])[a_close]  # of each group
    n_groups = np.bincount(owner, minlength=len(good))
    each = np.diff(a_close, prepend=-1) * np.diff(b_close, prepend=-1)
    n_links = np.zeros(len(good), np.int64)
    np.add.at(n_links, owner, each)
    where, pair, times = links(*ids, a_close, b_close, owner, len(b_side.lengths))
    first = np.searchsorted(where, np.arange(len(good) + 1))
    words = digests(*ids, a_close, b_close, len(a_side.lengths), len(b_side.lengths))
    at = np.concatenate(([0], np.cumsum(counts[0] + counts[1]))).tolist()
    sums = [hashlib.sha256("".join(words[low:high])[:-1].encode()).hexdigest() if high > low else "" for low, high in zip(at, at[1:])]
    return [counts[0], counts[1], n_groups, n_links, first, pair, times], sums


def pair_type(a: str, b: str) -> str:
    """The type of the numbers of pairs."""
    return "int" if vocabulary_size(a) * piece_count(b) < 1 << 31 else "long"


def piece_count(path: str) -> int:
    import sentencepiece

    return len(sentencepiece.SentencePieceProcessor(model_file=path))


def _aligned(a: str, b: str, kind: str):
    wide = {"int": pa.int32(), "long": pa.int64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", ALIGNED_BYTES):
                (n_a, n_b, n_groups, n_links, first, pair, times), sums = align(part.column("text"), *sides(a, b))
                at = pa.array(first, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in ((pair, wide), (times, pa.int64()))]
                numbers = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *numbers, pa.array(sums, pa.string()), *lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return run


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of docs (doc_id, text): pairs are numbers of distinct linked ids, times how often each is linked."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = pair_type(a, b)
    return own.mapInArrow(tidy(_aligned(a, b, kind)), f"doc_id long, {DIGEST}, pairs array<{kind}>, times array<long>")


def pair_counts(documents: DataFrame, b_ids: int) -> DataFrame:
    """(pair, n, best): how many documents have each pair, and whether no pair with the same A id is in more; stored."""
    counts = stored(documents.select(F.explode_outer("pairs").alias("pair")).where("pair is not null").groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a_id = F.floor(F.col("pair") / b_ids)
    most = small(stored(counts.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("most")), "most-linked"))  # at most a row for each id of A
    return stored(counts.withColumn("a_id", a_id).join(most, "a_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def head_of(counts: DataFrame, most: int = HEAD) -> int:
    """The least count such that at most ``most`` pairs have it or more."""
    sizes = counts.groupBy(F.least(F.floor(F.log2("n") * 16), F.lit(1023)).cast("int").alias("size")).count().orderBy(F.desc("size")).collect()
    total, low = 0, 1 << 62
    for row in sizes:  # at most 1,024 sizes
        total += row["count"]
        if total > most:
            break
        low = row["size"]
    return low


def align_corpus(docs: DataFrame, a: str, b: str, head: int = HEAD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs (doc_id, text); a is a byte-level tokenizer file, b a sentencepiece model."""
    documents = stored(aligned(docs, a, b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(documents, piece_count(b))
    low = head_of(counts, head)
    size = F.least(F.floor(F.log2("n") * 16), F.lit(1023))
    often, seldom = counts.where(size >= low), counts.where(size < low)
    linked = documents.select("row", F.explode_outer(F.arrays_zip("pairs", "times")).alias("link")).select("row", "link.pairs", "link.times").toDF("row", "pair", "times").where("pair is not null")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    found = [linked.join(F.broadcast(often), "pair").groupBy("row").agg(*sums)]
    if not seldom.isEmpty():
        rest = linked.join(F.broadcast(often.select("pair")), "pair", "left_anti")
        found.append(rest.join(seldom, "pair").groupBy("row").agg(*sums))
    total = found[0]
    for more in found[1:]:
        total = total.unionByName(more).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    joined = documents.drop("pairs", "times").join(total, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
