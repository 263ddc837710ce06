"""Scoring texts with a class-based bigram model after Brown et al.

Words are put into classes by exchange clustering; a token's probability is P(class | class before) times P(word | class).
Tokens are words (runs without ASCII white space, A-Z lower-cased) and one end token a document; before the first
token stands an end. Counts come from all documents but those held out.

Every word of the training documents gets its class by the exchange criterion, the likelihood of class bigrams:

1. the ``CORE`` most frequent words are exchanged one by one on the driver until nothing moves (their bigram counts have a fixed size);
2. ``SWEEPS`` distributed sweeps try the ``SWEPT`` most frequent words in every class. Spark counts for each word which classes stand before and
   after it; with these counts and the class bigrams less the word's own, the gain of every move is known, and all words of a sweep move at once;
3. all other words, however many, are tried in every class against the classes as they are by then. Their classes and counts are a table
   that grows with the vocabulary and stays distributed.

Texts are cut into words twice (to count them, and to number them); what follows reads token numbers, four bytes a token, and hashes of rare
words. The ``HEAD`` most frequent words or fewer, with their counts and classes, come to the driver and to tasks; a document's other words are sent, with
the classes of their neighbours, to where their class and count are, and from there back by document, where pairs of two rare words are put together.

Smoothing: transitions (n(c, d) + A p(d)) / (n(c) + A), p additive over classes; each class keeps half a count for
words it has not seen: emissions are (n + 0.5) / (N_class + 0.5 (V_class + 1)). An unknown word is a class of its own that stands for this remainder of all classes, so the probabilities of all
words and of one unknown word sum to one after any class. Pairs of two words that are not swept are counted by what their classes hold of them on either side.

Defined cases: a null text has the end token only; a null document id is hashed as an empty text; rows are scored one by one, repeated or not; without training documents every
token is unknown and base_score uses N = V = 0; an empty table gives no rows; words of equal count are ranked by hash. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvemill.llm.shared import stored
from curvemill.llm.textbuf import WORD_BYTE, Texts, byte_values, pieces, tidy

HEAD, SWEPT, CORE, CLASSES = 1 << 17, 1 << 14, 767, 64
SWEEPS, SMOOTH = 2, 2.0
#: Distinct words a task holds before it hands on what it has counted.
HELD = 1_000_000
_VALUES = byte_values(True, WORD_BYTE)
END = np.uint64(zlib.crc32(b"<end>"))
#: Neighbours are told apart by class; the last number is for words that have none yet.
NONE = CLASSES
SIDE = CLASSES + 1


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 1


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token of every text, ends included; and the first token of each text (n + 1)."""
    starts, ends, first = texts.runs(WORD_BYTE)
    firsts = first + np.arange(texts.n + 1)
    hashes = np.full(int(firsts[-1]), END, np.uint64)
    is_word = np.ones(len(hashes), bool)
    is_word[firsts[1:] - 1] = False
    hashes[is_word] = texts.hashes(starts, ends, _VALUES)
    return hashes, firsts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pd.Series] = []
    size = 0
    add_up = lambda: pd.concat(held).groupby(level=0, sort=False).sum()
    out = lambda s: pa.record_batch([pa.array(s.index.to_numpy().view(np.int64)), pa.array(s.to_numpy())], names=["word", "n"])
    for batch in batches:
        for part in pieces(batch, "text"):
            codes, unique = pd.factorize(tokens(Texts(part.column("text")))[0])
            held.append(pd.Series(np.bincount(codes, minlength=len(unique)), unique))
            size += len(unique)
            if size > HELD:
                held = [add_up()]
                size = len(held[0])
                if size > HELD // 2:
                    yield out(held[0])
                    held, size = [], 0
    if held:
        yield out(add_up())


def count_words(training: DataFrame) -> DataFrame:
    """(word, n): hash and count of every distinct token of the texts."""
    return training.select("text").mapInArrow(tidy(_count_words), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Head:
    """The frequent words in order of their counts: a word's place is its rank. The place after the last is the end's."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, ends: int = 0) -> None:
        rank = np.lexsort((words, -counts))
        self.words, self.counts, self.ends = words[rank], counts[rank], ends
        self.order = np.argsort(self.words)
        self.ascending = self.words[self.order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each token, or -1."""
        codes, unique = pd.factorize(hashes)
        place = np.full(len(unique), -1, np.int32)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.ascending, unique), len(self.words) - 1)
            place = np.where(self.ascending[at] == unique, self.order[at], -1).astype(np.int32)
        place[unique == END] = len(self.words)
        return place[codes]


def frequent(counted: DataFrame, most: int) -> Head:
    """The words with the greatest counts, ``most`` at most. Of words that tie at the end, those with small hashes are taken."""
    end = int(END)
    words = counted.where(F.col("word") != end)
    ranks = words.groupBy("n").agg(F.count("*").alias("kinds")).withColumn("so_far", F.sum("kinds").over(Window.orderBy(F.desc("n"))))
    within = ranks.where(F.col("so_far") <= most).agg(F.min("n"), F.max("so_far")).first()
    tie = ranks.where(F.col("so_far") > most).orderBy(F.desc("n")).first()
    take = F.col("n") >= within[0] if within[0] is not None else F.lit(False)
    if tie is not None:  # hashes are spread evenly; a little less than what fits
        share = 0.9 * (most - (within[1] or 0)) / tie["kinds"]
        take = take | ((F.col("n") == tie["n"]) & (F.col("word") < int((share - 0.5) * 2**64)))
    top = words.where(take).toPandas()
    ends = counted.where(F.col("word") == end).agg(F.sum("n")).first()[0] or 0
    return Head(top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), ends)


def _encode(head):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                hashes, firsts = tokens(Texts(part.column("text")))
                places = head.value.find(hashes)
                rare = places < 0
                cuts = np.concatenate(([0], np.cumsum(rare)))[firsts]
                blobs = lambda data, at: pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
                own = [blobs(np.ascontiguousarray(places), firsts * 4), blobs(np.ascontiguousarray(hashes[rare]), cuts * 8)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "held_out")), *own], names=["row", "doc_id", "held_out", "places", "rare"])

    return encode


class Encoded:
    """A batch of encoded texts: places, hashes of the rare words in their order, and the first token of each text."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        places, at = self._blobs(batch.column("places"), np.int32)
        self.rare, _ = self._blobs(batch.column("rare"), np.uint64)
        self.places, self.firsts = places, at

    @staticmethod
    def _blobs(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
        column = column.cast(pa.large_binary())
        _, at, data = column.buffers()
        at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
        item = np.dtype(kind).itemsize
        return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if data is not None and at[-1] > at[0] else np.zeros(0, kind), (at - at[0]) // item

    def neighbours(self, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each token, the value of the one before (of a first token: end) and of the one after (of a last token: end)."""
        before, after = np.empty_like(values), np.empty_like(values)
        before[1:], after[:-1] = values[:-1], values[1:]
        before[self.firsts[:-1]], after[self.firsts[1:] - 1] = end, end
        return before, after


#: Bytes of encoded texts that are worked on together.
CODED_BYTES = 4 << 20


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Encoded]]:
    for batch in batches:
        for part in pieces(batch, "places", CODED_BYTES):
            yield part, Encoded(part)


def _flat(total: np.ndarray, width: int, first: int = 0) -> Iterator[pa.RecordBatch]:
    """The counts that are not zero, as (a, b, n): row, column and count."""
    seen = np.flatnonzero(total)
    for i in range(0, len(seen), 200_000):
        some = seen[i : i + 200_000]
        yield pa.record_batch([pa.array(some // width + first), pa.array((some % width).astype(np.int32)), pa.array(total[some].astype(np.int64))], names=["a", "b", "n"])


COUNTS = "a long, b int, n long"


def _count_pairs(core: int, end: int):
    """Bigrams of the most frequent words and ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((core + 1) ** 2, np.int64)
        for _, texts in _encoded(batches):
            symbol = np.where(texts.places == end, core, texts.places)
            before, _ = texts.neighbours(symbol, core)
            both = (symbol >= 0) & (symbol <= core) & (before >= 0) & (before <= core)
            total += np.bincount(before[both].astype(np.int64) * (core + 1) + symbol[both], minlength=len(total))
        yield from _flat(total, core + 1)

    return count


def _count_contexts(classes, swept: int):
    """For each swept word, the classes before it (columns 0 to CLASSES) and after it; row -1: bigrams of classes, at before * CLASSES + class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = classes.value
        total, pair = np.zeros(swept * 2 * SIDE, np.int32), np.zeros(SIDE * SIDE, np.int64)
        for _, texts in _encoded(batches):
            cls = np.where(texts.places >= 0, of[texts.places], NONE)
            before, after = texts.neighbours(cls, CLASSES - 1)
            pair += np.bincount(before * SIDE + cls, minlength=len(pair))
            mine = (texts.places >= 0) & (texts.places < swept)
            at = texts.places[mine].astype(np.int64) * (2 * SIDE)
            total += np.bincount(np.concatenate((at + before[mine], at + SIDE + after[mine])), minlength=len(total)).astype(np.int32)
        yield from _flat(total, 2 * SIDE)
        pair = pair.reshape(SIDE, SIDE)[:CLASSES, :CLASSES].ravel()
        yield from _flat(pair, len(pair), -1)

    return count


def _count_rare_contexts(head, classes, swept: int):
    """The same for all other words, rows being their hashes; swept words give only bigrams of classes, as (before, class, n) with -1 - before as column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pair = classes.value, np.zeros(SIDE * SIDE, np.int64)
        for _, texts in _encoded(batches):
            cls = np.where(texts.places >= 0, of[texts.places], NONE)
            before, after = texts.neighbours(cls, CLASSES - 1)
            pair += np.bincount(before * SIDE + cls, minlength=len(pair))
            other = cls == NONE
            word = np.zeros(len(cls), np.uint64)
            known = other & (texts.places >= 0)
            word[known] = head.value.words[texts.places[known]]
            word[texts.places < 0] = texts.rare
            word, before, after = word[other], before[other], after[other]
            codes, unique = pd.factorize(word)
            keys, n = np.unique(np.concatenate((codes * (2 * SIDE) + before, codes * (2 * SIDE) + SIDE + after)), return_counts=True)
            if len(keys):
                yield pa.record_batch([pa.array(unique.view(np.int64)[keys // (2 * SIDE)]), pa.array((keys % (2 * SIDE)).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])
        pair = pair.reshape(SIDE, SIDE)[:CLASSES, :CLASSES]
        one, other = np.nonzero(pair)
        yield pa.record_batch([pa.array(one), pa.array((-1 - other).astype(np.int32)), pa.array(pair[one, other])], names=["a", "b", "n"])

    return count


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Exchange clustering of symbols by their bigram counts; returns the class of each.

    The last symbol (the end) keeps a class of its own. Frequent symbols start in classes of their own in
    turn. Each round tries every symbol, most frequent first, in every class and keeps the best; it stops when nothing moves.
    """
    n = len(counts)
    mass = counts.sum(0) + counts.sum(1)
    order = [int(i) for i in np.argsort(-mass, kind="stable") if i != n - 1]
    own = np.zeros(n, np.int64)
    own[order] = np.arange(len(order)) % (classes - 1)
    own[n - 1] = classes - 1
    member = np.zeros((n, classes))
    member[np.arange(n), own] = 1
    table = member.T @ counts @ member
    right, left = counts @ member, counts.T @ member  # to and from each class, by symbol
    least = 1e-9 + 1e-12 * float(_xlogx(mass.sum()))  # a gain above what rounding can feign, so every move raises the likelihood and this ends
    moved = 1
    while moved:
        moved = 0
        for w in order:
            if mass[w] == 0:
                continue
            old, loop = own[w], counts[w, w]
            r, lf = right[w].copy(), left[w].copy()
            r[old] -= loop
            lf[old] -= loop
            table[old] -= r
            table[:, old] -= lf
            table[old, old] -= loop
            rows, columns = table.sum(1) + lf, table.sum(0) + r  # what others give w and get from w counts wherever w goes
            # gain in sum of f log f of each class when w joins it: its row, its column, and the cell where they cross
            base = _xlogx(table)
            grown = _xlogx(table + r[None, :]) - base
            grown_left = _xlogx(table + lf[:, None]) - base
            cross = _xlogx(np.diag(table) + r + lf + loop) - np.diag(base)
            gain = grown.sum(1) - np.diag(grown) + grown_left.sum(0) - np.diag(grown_left) + cross
            gain -= _xlogx(rows + r.sum() + loop) - _xlogx(rows) + _xlogx(columns + lf.sum() + loop) - _xlogx(columns)
            gain[classes - 1] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + least:
                new = int(old)
            table[new] += r
            table[:, new] += lf
            table[new, new] += loop
            if new != old:
                moved += 1
                own[w] = new
                right[:, old] -= counts[:, w]
                right[:, new] += counts[:, w]
                left[:, old] -= counts[w]
                left[:, new] += counts[w]
    return own


def best_moves(left: np.ndarray, right: np.ndarray, old: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The best class of each word by its counts of classes before (left) and after (right); table has the class bigrams.

    Words that have a class (old is not NONE) are taken out of the table first. No word joins the end's class, the last.
    """
    out = np.empty(len(left), np.int64)
    for i in range(0, len(left), 128):
        lf, r, was = left[i : i + 128].astype(float), right[i : i + 128].astype(float), old[i : i + 128]
        own = np.repeat(table[None].astype(float), len(lf), 0)
        has = np.flatnonzero(was != NONE)
        own[has, :, was[has]] -= lf[has]
        own[has, was[has], :] -= r[has]
        own = np.maximum(own, 0)
        base = _xlogx(own)
        gain = (_xlogx(own + lf[:, :, None]) - base).sum(1) + (_xlogx(own + r[:, None, :]) - base).sum(2)
        rows, columns = own.sum(2), own.sum(1)
        gain -= _xlogx(rows + r.sum(1)[:, None]) - _xlogx(rows) + _xlogx(columns + lf.sum(1)[:, None]) - _xlogx(columns)
        both, cross = np.diagonal(own, axis1=1, axis2=2), lf + r  # the cell where a class's row and column meet
        gain += _xlogx(both + cross) - _xlogx(both + lf) - _xlogx(both + r) + _xlogx(both)
        gain[:, CLASSES - 1] = -np.inf
        out[i : i + 128] = gain.argmax(1)
    return out


def likely_classes(left: np.ndarray, right: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class in which a word's tokens are likeliest, if the classes stay as they are."""
    smooth = table + 0.1
    into, out_of = np.log(smooth / smooth.sum(0, keepdims=True)), np.log(smooth / smooth.sum(1, keepdims=True))
    # before: P(class | before) / (tokens of the class); after: P(after | class)
    gain = left @ into + right @ out_of.T
    gain[:, CLASSES - 1] = -np.inf
    return gain.argmax(1)


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Counts of classes before and after the words of a batch of (a, list of (b, n)); the last column of each is for neighbours without a class."""
    lists = batch.column("each")
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    at = owner * (2 * SIDE) + flat.field("b").to_numpy()
    counts = np.bincount(at, flat.field("n").to_numpy(), len(lists) * 2 * SIDE).reshape(-1, 2, SIDE)
    return counts[:, 0], counts[:, 1]


def _listed(counts: DataFrame) -> DataFrame:
    """(a, b, n) with n summed before any exchange -> (a, each): one row a word, with at most 2 (CLASSES + 1) counts."""
    return counts.groupBy("a", "b").agg(F.sum("n").alias("n")).groupBy("a").agg(F.collect_list(F.struct("b", "n")).alias("each"))


def _sweep(classes, table: np.ndarray):
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = _matrix(batch)
                place = batch.column("a").to_numpy()
                new = best_moves(left[:, :CLASSES], right[:, :CLASSES], classes.value[place], table)
                yield pa.record_batch([batch.column("a"), pa.array(new)], names=["place", "class"])

    return sweep


def _settle(table: np.ndarray):
    """(word, class, n) of all other words; and as (class, key, n) with a null word what they add to the class bigrams."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = np.zeros((CLASSES, 2 * SIDE))
        names = ["word", "class", "key", "n"]
        for batch in batches:
            if batch.num_rows:
                left, right = _matrix(batch)
                new = likely_classes(left[:, :CLASSES], right[:, :CLASSES], table)
                np.add.at(more, new, np.concatenate((left, right), 1))
                yield pa.record_batch([batch.column("a"), pa.array(new), pa.nulls(len(new), pa.int64()), pa.array(left.sum(1).astype(np.int64))], names=names)
        one, key = np.nonzero(more)
        yield pa.record_batch([pa.nulls(len(one), pa.int64()), pa.array(one), pa.array(key), pa.array(more[one, key].astype(np.int64))], names=names)

    return settle


class ClassModel:
    """Transitions between classes (the last is that of unknown words), the mass of each class, and the class of each place of the head."""

    def __init__(self, head: Head, classes: np.ndarray, transitions: np.ndarray, tokens_of: np.ndarray, kinds_of: np.ndarray, n: int, v: int) -> None:
        self.head, self.classes, self.n, self.v = head, classes, n, v
        room = tokens_of + 0.5 * (kinds_of + 1)
        prior = room / room.sum()
        known = (transitions + SMOOTH * prior[None, :]) / (transitions.sum(1, keepdims=True) + SMOOTH)
        unseen = 0.5 / room  # what each class leaves to words it has not seen
        whose = prior * unseen / (prior * unseen).sum()
        out = np.concatenate((known, whose[None, :] @ known))
        self.log_transition = np.log10(np.concatenate((out, (out @ unseen)[:, None]), 1))
        self.log_mass = np.append(np.log10(room), 0.0)
        self.log_count = np.log10(np.append(head.counts, head.ends) + 0.5)

    def emission(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of P(word | class) for words with these training counts; of an unknown word it is in the transition."""
        return np.where(classes == NONE, 0.0, np.log10(counts + 0.5) - self.log_mass[classes])


def train(coded: DataFrame, counted: DataFrame, head: Head, swept: int = SWEPT, core: int = CORE) -> tuple[ClassModel, DataFrame]:
    """The model, and (word, class, n) of all words beyond the swept ones; coded has the training texts, counted the words' counts."""
    spark = coded.sparkSession
    share = spark.sparkContext.broadcast
    end = len(head.words)
    core, swept = min(core, end), min(swept, end)
    found = coded.mapInArrow(_count_pairs(core, end), COUNTS).groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((core + 1, core + 1))
    counts[found.column("a").to_numpy(), found.column("b").to_numpy()] = found.column("n").to_numpy()
    classes = np.full(end + 1, NONE)
    own = exchange(counts)
    classes[:core], classes[end] = own[:core], CLASSES - 1
    for _ in range(SWEEPS):
        now = share(classes)
        context = stored(coded.mapInArrow(tidy(_count_contexts(now, swept)), COUNTS).groupBy("a", "b").agg(F.sum("n").alias("n")), "contexts")
        table = np.zeros(CLASSES * CLASSES)
        for row in context.where("a = -1").select("b", "n").collect():  # at most CLASSES squared
            table[row["b"]] = row["n"]
        moved = _listed(context.where("a >= 0")).mapInArrow(_sweep(now, table.reshape(CLASSES, CLASSES)), "place long, class long").toArrow()
        classes = classes.copy()
        classes[moved.column("place").to_numpy()] = moved.column("class").to_numpy()
    now = share(classes)
    context = stored(coded.mapInArrow(tidy(_count_rare_contexts(share(head), now, swept)), COUNTS).groupBy("a", "b").agg(F.sum("n").alias("n")), "rare-contexts")
    table = np.zeros((CLASSES, CLASSES))
    for row in context.where("b < 0").collect():
        table[row["a"], -1 - row["b"]] = row["n"]
    settled = stored(_listed(context.where("b >= 0")).mapInArrow(_settle(table), "word long, class long, key long, n long"), "word-classes")
    others = settled.where("word is not null").select("word", "class", "n")
    # what the other words add: bigrams with swept words, and with one another by what each class has of them
    more = np.zeros((CLASSES, 2 * SIDE))
    for row in settled.where("word is null").groupBy("class", "key").agg(F.sum("n").alias("n")).collect():
        more[row["class"], row["key"]] = row["n"]
    table += more[:, :CLASSES].T + more[:, SIDE : SIDE + CLASSES]
    table += np.outer(more[:, SIDE + NONE], more[:, NONE]) / max(more[:, NONE].sum(), 1)
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in others.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        mass[row["class"]], kinds[row["class"]] = row["n"], row["kinds"]
    own = classes[:swept]
    mass += np.bincount(own, head.counts[:swept], CLASSES)
    kinds += np.bincount(own, minlength=CLASSES)
    mass[CLASSES - 1], kinds[CLASSES - 1] = head.ends, int(head.ends > 0)
    names = spark.createDataFrame(pa.table({"word": head.words[swept:].view(np.int64), "place": np.arange(swept, end)}), "word long, place long")
    rest = others.join(F.broadcast(names), "word").select("place", "class").toArrow()  # at most HEAD rows
    classes[rest.column("place").to_numpy()] = rest.column("class").to_numpy()
    totals = counted.agg(F.sum("n"), F.count("*")).first()
    return ClassModel(head, classes, table, mass, kinds, totals[0] or 0, totals[1]), others


_SCORED = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "word", "pos", "before", "after"]
_KINDS = ["long", "{doc_id}", "boolean", "long", "long", "double", "double", "long", "long", "int", "int"]


def _score(model):
    """A row a document with what it gives by itself, and one for each rare word with the classes around it (NONE: rare, too)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ClassModel = model.value
        kinds = [pa.int64(), None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        for part, texts in _encoded(batches):
            n = part.num_rows
            common = texts.places >= 0
            cls = np.where(common, m.classes[texts.places], NONE)
            before, after = texts.neighbours(cls, CLASSES - 1)
            owner = np.repeat(np.arange(n), np.diff(texts.firsts))
            both = common & (before != NONE)
            add = lambda at, x: np.bincount(owner[at], x, n)
            counted = np.append(m.head.counts, m.head.ends)[texts.places[common]]
            total = add(both, m.log_transition[before[both], cls[both]]) + add(common, m.emission(counted, cls[common]))
            known = np.bincount(owner[common], counted > 0, n).astype(np.int64)
            kinds[1] = part.schema.field("doc_id").type
            whole = [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(np.diff(texts.firsts)), pa.array(known), pa.array(add(common, m.log_count[texts.places[common]])), pa.array(total)]
            yield pa.RecordBatch.from_arrays([*whole, *(pa.nulls(n, t) for t in kinds[7:])], names=_SCORED)
            rare = np.flatnonzero(~common)
            if len(rare):
                own = [pa.array(texts.rare.view(np.int64)), pa.array(rare - texts.firsts[owner[rare]]), pa.array(before[rare].astype(np.int32)), pa.array(after[rare].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(owner[rare])), *(pa.nulls(len(rare), t) for t in kinds[1:7]), *own], names=_SCORED)

    return score


def _score_rare(model):
    """Rows of rare words in order of document and place -> (row, known, base, score): sums of what each document has of them in a batch."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ClassModel = model.value
        last = (-1, -1, NONE)
        for batch in batches:
            if not batch.num_rows:
                continue
            row, pos, before, after, cls, n = (batch.column(c).to_numpy() for c in ("row", "pos", "before", "after", "class", "n"))
            # the class before: a frequent word's, or that of the rare word in the row before
            previous = np.concatenate(([last[2]], cls[:-1]))
            joined = (np.concatenate(([last[0]], row[:-1])) == row) & (np.concatenate(([last[1]], pos[:-1])) == pos - 1)
            before = np.where(joined, previous, before)
            last = (row[-1], pos[-1], cls[-1])
            total = m.log_transition[before, cls] + m.emission(n, cls)
            # a frequent word after a rare one was left to it; the class of another rare word is that word's own affair
            total += np.where(after != NONE, m.log_transition[cls, np.minimum(after, CLASSES - 1)], 0.0)
            codes, rows = pd.factorize(row)
            sums = [np.bincount(codes, x, len(rows)) for x in (n > 0, np.log10(n + 0.5), total)]
            yield pa.record_batch([pa.array(rows), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["row", "known", "base", "score"])

    return score


def fitted(docs: DataFrame, head: int = HEAD, swept: int = SWEPT, core: int = CORE) -> tuple[DataFrame, ClassModel, DataFrame]:
    """The encoded texts of docs (doc_id, text), the model of those not held out, and (word, class, n) of all words beyond the swept ones."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    counted = stored(count_words(slim.where(~F.col("held_out"))), "word-counts")
    top = frequent(counted, head)
    # the row number follows from the scan alone and is written down once
    numbered = slim.withColumn("row", F.monotonically_increasing_id())
    schema = f"row long, doc_id {dict(slim.dtypes)['doc_id']}, held_out boolean, places binary, rare binary"
    coded = stored(numbered.mapInArrow(tidy(_encode(docs.sparkSession.sparkContext.broadcast(top))), schema), "coded")
    return coded, *train(coded.where(~F.col("held_out")).select("places", "rare"), counted, top, swept, core)


def score_documents(docs: DataFrame, head: int = HEAD, swept: int = SWEPT, core: int = CORE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text)."""
    coded, model, others = fitted(docs, head, swept, core)
    kind = dict(coded.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = stored(coded.mapInArrow(tidy(_score(shared)), ", ".join(f"{n} {k}" for n, k in zip(_SCORED, _KINDS)).format(doc_id=kind)), "scores")
    rare = scored.where(F.col("word").isNotNull()).select("row", "word", "pos", "before", "after").join(others, "word", "left")
    rare = rare.select("row", "pos", "before", "after", F.coalesce("class", F.lit(NONE)).alias("class"), F.coalesce("n", F.lit(0)).alias("n"))
    by_row = rare.repartition("row").sortWithinPartitions("row", "pos").mapInArrow(_score_rare(shared), "row long, known long, base double, score double")
    sums = by_row.groupBy("row").agg(*[F.sum(c).alias(f"rare_{c}") for c in ("known", "base", "score")])
    whole = scored.where(F.col("word").isNull()).join(sums, "row", "left")
    plus = lambda c: F.col(c) + F.coalesce(f"rare_{c}", F.lit(0))
    return whole.select(
        "doc_id", "held_out", "n_tokens", plus("known").cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (plus("base") - F.col("n_tokens") * float(np.log10(model.n + 0.5 * (model.v + 1)))).alias("base_score"), plus("score").alias("score"),
    )
