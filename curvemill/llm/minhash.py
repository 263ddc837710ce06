"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

A text is its multiset of shingles (five words in a row, A-Z lower-cased; a shorter text is one shingle). Each distinct
shingle is a Poisson process whose rate is its weight, one plus the logarithm of its number of occurrences; its points fall into ``BANDS * ROWS`` registers, and
the shingle of the first point in a register is the signature's entry there, so two entries agree with
the probability Jaccard of the weighted shingles. Points of one shingle come in order of time, and it is given up as soon as it is
later than every register's first point. A batch of texts advances together, one point a shingle at a time.

Exact copies (equal texts) are put together first and stand as one document. Signatures are cut into bands, and a
pair is a candidate if it shares a bucket (an equal band). Verification is by the Jaccard of the shingle sets, at least ``THRESHOLD``, on
32-bit fingerprints of shingles (two texts of 550 words have a false match with probability 7e-5).

First every member of a bucket is compared with the bucket's leader, which of its members is the one that meets most texts in its buckets; so a large group of near copies has few leaders, and
a text few of them, whatever the number of buckets that it shares. Members that hang together with their leader over a few of these links are
settled and need no comparison with one another. The others are compared with all members: where they are at most ``BLOCK``, settled members are dealt into blocks of
that size, and the others with each block are a group of bounded size, in which pairs are first screened by the sizes of their shingle sets, which loses none, taken only in the
first bucket they share, and verified unless both are already in one component of the group. The members of more crowded buckets, which share a band but not the text, are joined by their
rarest fingerprints instead (``crowd_links``), which finds every pair of the threshold without comparing all. So no candidate pair between components is left out.

At ROWS = 5 and BANDS = 25 a pair of probability Jaccard 0.8 shares a bucket with probability 0.99995, one of 0.63 (equal sets, 30% of whose shingles
one text repeats 40 times) with 0.93.

Defined cases: a text without words (null, empty) has no shingles, is near nothing, and copies of it are one class; what is compared are texts, so documents that
share an id but not the text are in classes of their own, and rows without an id take part like others; repeated rows are in one class; an empty table gives no
rows. Class ids are the smallest document id of the class, null if no document of it has one. Other columns are ignored by ``classes`` and kept by ``distinct_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill.llm.graph import components
from curvemill.llm.shared import small, stored, stored_texts, tasks_for
from curvemill.llm.textbuf import WORD_BYTE, Texts, byte_values, mix64, pieces, tidy, windows

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
#: Members of a bucket in a block: what one group compares is a block with itself or with one other.
BLOCK = 256
_VALUES = byte_values(True, WORD_BYTE)


def shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts, and the text of each; by text in ascending order."""
    starts, ends, first = texts.runs(WORD_BYTE)
    words = texts.hashes(starts, ends, _VALUES)
    found, at = windows(words, first, SHINGLE)
    owner = np.repeat(np.arange(texts.n), np.diff(first))
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    if not len(short):
        return found, owner[at]
    place = np.arange(len(words)) - np.repeat(first[:-1], size)
    spread = mix64(words + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)))
    whole = mix64(total[first[short + 1]] - total[first[short]])
    hashes, owners = np.concatenate((found, whole)), np.concatenate((owner[at], short))
    order = np.argsort(owners, kind="stable")
    return hashes[order], owners[order]


def weighted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, text) with their weight: 1 + ln(occurrences), so a line that is repeated all over does not stand for the text."""
    codes, keys = pd.factorize(hashes ^ mix64(owner.astype(np.uint64) + np.uint64(1)))
    one = np.zeros(len(keys), np.int64)
    one[codes] = np.arange(len(codes))
    return hashes[one], owner[one], 1 + np.log(np.bincount(codes, minlength=len(keys)))


def signatures(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash signatures (n x registers) of n weighted sets; a set without elements has zeros."""
    first = np.full(n * registers, np.inf)
    entry = np.zeros(n * registers, np.uint64)
    latest = np.full(n, np.inf)
    time = np.zeros(len(element))
    step = 0
    while len(element):
        step += 1
        noise = mix64(element + np.uint64(step * 0xA0761D6478BD642F % (1 << 64)))
        time = time - np.log(((noise >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight
        alive = time < latest[owner]
        element, owner, weight, time, noise = element[alive], owner[alive], weight[alive], time[alive], noise[alive]
        at = owner * registers + (mix64(noise ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        entry[at[won]] = element[won]
        latest = first.reshape(n, registers).max(1)
        alive = time < latest[owner]
        element, owner, weight, time = element[alive], owner[alive], weight[alive], time[alive]
    return entry.reshape(n, registers)


def bands(signature: np.ndarray) -> np.ndarray:
    """Band hashes (n x BANDS); bands of different places never agree but by chance."""
    out = np.zeros((len(signature), BANDS), np.uint64)
    for r in range(ROWS):
        out = mix64(out + signature[:, r::ROWS])
    return mix64(out ^ np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            hashes, owner = shingles(Texts(part.column("text")))
            found = bands(signatures(*weighted(hashes, owner), part.num_rows)).view(np.int64)
            has = np.bincount(owner, minlength=part.num_rows) > 0
            offsets = np.concatenate(([0], np.cumsum(has * BANDS)))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found[has].ravel()))
            yield pa.record_batch([part.column("doc_id"), part.column("key"), lists], names=["doc_id", "key", "bands"])


def text_key(text: Column) -> Column:
    """What stands for an exact text; null and empty texts are one."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, bands) of docs (doc_id, text): key stands for the exact text; no bands without words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    return slim.mapInArrow(tidy(_sketch), "doc_id long, key binary, bands array<long>")


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            n = part.num_rows
            hashes, owner, weight = weighted(*shingles(Texts(part.column("text"))))
            signature = signatures(hashes, owner, weight, n).astype(np.uint16)
            order = np.lexsort((hashes.astype(np.uint32), owner))
            prints, cut = hashes.astype(np.uint32)[order], np.searchsorted(owner[order], np.arange(n + 1))
            sets = [np.unique(prints[cut[i] : cut[i + 1]]).tobytes() for i in range(n)]
            yield pa.record_batch([part.column("doc_id"), pa.array([x.tobytes() for x in signature], pa.binary()), pa.array(sets, pa.binary())], names=["node", "signature", "prints"])


def profiles(texts: DataFrame) -> DataFrame:
    """(node, signature, prints) of texts (doc_id, text): the 16-bit ends of the registers, and the sorted 32-bit fingerprints of the shingles."""
    return texts.mapInArrow(tidy(_profile), "node long, signature binary, prints binary")


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets of fingerprints have at least that Jaccard."""
    if not len(a) or not len(b) or min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return both >= threshold * (len(a) + len(b) - both)


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (batch.column(c) for c in ("prints", "lead_prints"))
            keep = [alike(*(np.frombuffer(x[i].as_buffer(), np.uint32) for x in (one, other)), threshold) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def verified(pairs: DataFrame, known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of pairs (a, b) of nodes those whose shingle sets have at least that Jaccard; known has their profiles."""
    prints = known.select("node", "prints")
    second = pairs.join(prints.withColumnRenamed("node", "b"), "b")
    both = second.join(prints.select(F.col("node").alias("a"), F.col("prints").alias("lead_prints")), "a")
    return both.select("a", "b", "prints", "lead_prints").mapInArrow(_verify(threshold), "a long, b long")


def near_labels(links: DataFrame, hops: int = 3) -> DataFrame:
    """(node, label): the smallest node within so many links of each. Equal labels mean one component; different ones need not mean two."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label"))
    for _ in range(hops - 1):
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        label = near.join(label, "node").select("node", F.least("near", "label").alias("label"))
    return small(stored(label, "labels"))


class _Forest:
    """Components of the nodes of one group."""

    def __init__(self, labels: list[int]) -> None:
        first: dict[int, int] = {}
        self.up = [first.setdefault(label, i) for i, label in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, k: int) -> None:
        self.up[self.root(i)] = self.root(k)


def group_links(band: int, low: int, high: int, rows: dict[str, list], threshold: float) -> list[tuple[int, int]]:
    """Links that join components within one group: of one block with itself, or between two blocks of a bucket.

    A pair counts in the first bucket its two signatures share, and if the sizes of its sets allow the threshold; it is verified
    unless both are in one component by then.
    """
    block, n = np.array(rows["block"]), len(rows["node"])
    signature = np.frombuffer(b"".join(rows["signature"]), np.uint16).reshape(n, -1)
    forest, out = _Forest(rows["label"]), []
    labels = np.array(rows["label"])
    prints = [np.frombuffer(x, np.uint32) for x in rows["prints"]]
    sizes = np.array([len(x) for x in prints])
    for i in range(n - 1):
        others = np.arange(i + 1, n)
        others = others[labels[others] != labels[i]]
        if low != high:
            others = others[block[others] != block[i]]
        others = others[np.minimum(sizes[others], sizes[i]) >= threshold * np.maximum(sizes[others], sizes[i])]
        if not len(others):
            continue
        same = signature[others] == signature[i]
        first = same.reshape(len(others), BANDS, ROWS).all(2).argmax(1)
        for k in others[first == band].tolist():
            if forest.root(i) != forest.root(k) and alike(prints[i], prints[k], threshold):
                forest.join(i, k)
                out.append((rows["node"][i], rows["node"][k]))
    return out


def _compare(threshold: float):
    names = ("bucket", "low", "high", "band", "block", "label", "node", "signature", "prints")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, None

        def close() -> Iterator[pa.RecordBatch]:
            found = group_links(key[3], key[1], key[2], rows, threshold) if key else []
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

        for batch in batches:  # rows come by group; a group may go on in the next batch
            columns = [batch.column(c).to_pylist() for c in names]
            for row in zip(*columns):
                if row[:4] != key:
                    yield from close()
                    key, rows = row[:4], {c: [] for c in names[4:]}
                for c, v in zip(names[4:], row[4:]):
                    rows[c].append(v)
        yield from close()

    return compare


def near_links(members: DataFrame, texts: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) verified links between the members of buckets; members is a stored table (bucket, band, node), texts (node, key, least) tells where each node's text is."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(members.join(small(stored(sizes, "sizes")), "bucket"), "met")
    mates = small(stored(met.groupBy("node").agg(F.sum("n").alias("mates")), "mates"))
    order = F.struct((-F.col("mates")).alias("order"), F.xxhash64("node").alias("hash"), F.col("node").alias("node"))  # who meets most is the nearest to all, and leads in many buckets at once
    crowds = small(stored(met.join(mates, "node").groupBy("bucket").agg(F.min(order).alias("lead")).select("bucket", F.col("lead.node").alias("a")), "leaders"))
    crowded = stored(met.select("bucket", "band", "node").join(crowds, "bucket"), "members")
    needed = stored(texts.join(crowded.select("node").distinct(), "node", "left_semi"), "needed")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    mine = F.col("doc_id").eqNullSafe(F.col("least")) & (text_key(F.col("text")) == F.col("key"))
    own = slim.join(small(needed), mine).groupBy(F.col("node").alias("doc_id")).agg(F.min("text").alias("text"))
    known = stored_texts(profiles(own), "profiles")

    pairs = crowded.where("node <> a").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    links = stored_texts(verified(stored(pairs, "pairs"), known, threshold), "links")

    labels = near_labels(links)
    named = crowded.join(labels, "node", "left").select("bucket", "band", "node", "a", F.coalesce("label", "node").alias("label"))
    lead = labels.select(F.col("node").alias("a"), F.col("label").alias("lead_label"))
    named = stored(named.join(lead, "a", "left").select("bucket", "band", "node", "label", (F.col("label") == F.coalesce("lead_label", "a")).alias("settled")), "members")
    sizes = named.groupBy("bucket").agg(F.count_if("settled").alias("n_settled"), F.count_if(~F.col("settled")).alias("n_other")).where("n_other > 0")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = stored(sizes, "bucket-sizes")
    crowds = sizes.where(F.col("n_other") > BLOCK).select("bucket")
    sizes = sizes.where(F.col("n_other") <= BLOCK)
    sizes = small(stored(sizes.select("bucket", blocks("n_settled").alias("s"), blocks("n_other").alias("o")), "buckets"))
    mine = F.when(F.col("settled"), F.pmod(F.xxhash64("node"), F.col("s"))).otherwise(F.col("s") + F.pmod(F.xxhash64("node"), F.col("o"))).cast("int")
    meets = F.sequence(F.when(F.col("settled"), F.col("s")).otherwise(F.lit(0)), F.col("s") + F.col("o") - 1)  # settled blocks need not meet
    dealt = named.join(sizes, "bucket").select("bucket", "band", "node", "label", mine.alias("block"), F.explode(meets).alias("other"))
    keys = ["bucket", "low", "high"]
    dealt = dealt.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "band", "block", "label", "node")
    full = dealt.join(known, "node").repartition(tasks_for(known), *keys).sortWithinPartitions(*keys)
    links = stored_texts(links.union(full.mapInArrow(tidy(_compare(threshold)), "a long, b long")), "links")
    if crowds.isEmpty():
        return links
    crowd = named.join(small(stored(crowds, "crowds")), "bucket").select("node").distinct().join(near_labels(links), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    return links.union(stored_texts(crowd_links(crowd, known, threshold), "links"))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("prints")
        sizes = np.fromiter((len(x.as_buffer()) // 4 for x in prints), np.int64, len(prints))
        tokens = np.frombuffer(b"".join(x.as_py() for x in prints), np.int32)
        node, group = (batch.column(c).to_numpy() for c in ("node", "group"))
        yield pa.record_batch([pa.array(np.repeat(node, sizes)), pa.array(np.repeat(group, sizes)), pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(tokens)], names=["node", "group", "n", "token"])


def crowd_links(crowd: DataFrame, known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) verified links between the nodes of crowd (node, label) with different labels: a prefix-filtered join, exact for any pair of them.

    Fingerprints are put in order of rarity; two sets of that Jaccard have one in common among the first of each, and not so far on that the rest could not make up the overlap.
    """
    owned = crowd.withColumnRenamed("label", "group").join(known.select("node", "prints"), "node")
    tokens = stored_texts(owned.mapInArrow(tidy(_tokens), "node long, group long, n int, token int"), "crowd-tokens")
    counts = tokens.groupBy("token").agg(F.count("*").alias("often"))
    ordered = tokens.join(counts.where("often > 1"), "token", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    ordered = ordered.groupBy("node", "group", "n").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("tokens"))
    t = F.lit(threshold)
    prefix = F.slice("tokens", 1, (F.col("n") - F.ceil(t * F.col("n")) + 1).cast("int"))
    placed = ordered.select("node", "group", "n", F.posexplode(prefix).alias("at", "token")).where("token.often > 1")
    placed = stored(placed.select("node", "group", "n", "at", F.col("token.token").alias("token")), "crowd-prefixes")
    x, y = placed.alias("x"), placed.alias("y")
    rest = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))  # the token itself and all that follow it
    fits = (F.least("x.n", "y.n") >= t * F.greatest("x.n", "y.n")) & (rest >= F.ceil(t / (1 + t) * (F.col("x.n") + F.col("y.n")) - 1e-9))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.group") != F.col("y.group")) & fits)
    return verified(stored(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "crowd-pairs"), known, threshold)


def texts_of(found: DataFrame) -> DataFrame:
    """(key, node, least, bands): each distinct text of sketches under a number of its own, with the smallest id of its documents; stored."""
    texts = found.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    return stored(texts.withColumn("node", F.monotonically_increasing_id()), "texts")


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every row, and (key, node, component, class_id) of every text."""
    found = stored_texts(sketches(docs), "sketches")
    texts = texts_of(found)
    members = stored(texts.select(F.posexplode("bands").alias("band", "bucket"), "node").distinct(), "members")
    links = near_links(members, texts.select("node", "key", "least"), docs, threshold)
    labels = small(stored(components(links), "labels"))
    named = stored(texts.select("key", "node", "least").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    first = small(stored(named.groupBy("component").agg(F.min("least").alias("class_id"), F.count("*").alias("n")).where("n > 1"), "classes"))
    joined = named.join(first, "component", "left").select("key", "node", "component", F.coalesce("class_id", "least").alias("class_id"))
    return found.select("doc_id", "key"), joined


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) for every row of docs (doc_id, text)."""
    rows, texts = _classes(docs, threshold)
    return rows.join(small(stored(texts.select("key", "class_id"), "text-classes")), "key").select("doc_id", "class_id")


def distinct_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class: that with the smallest id, and of texts that share this id in one class, that with the smallest digest. Rows without an id all stay."""
    rows, texts = _classes(docs, threshold)
    named = stored(rows.join(small(stored(texts.select("key", "component"), "text-classes")), "key"), "class-rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")
    first = small(stored(named.groupBy("component").agg(best).select("component", "best.doc_id", "best.key"), "first-rows"))
    mine = F.col("n.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("n.key") == F.col("f.key"))
    counted = named.groupBy("component", "doc_id", "key").count()
    judged = counted.alias("n").join(first.alias("f"), F.col("n.component") == F.col("f.component"))
    judged = judged.where("n.doc_id is not null")
    extra = small(stored(judged.where(~mine).select("n.doc_id", "n.key"), "extra"))
    twice = small(stored(judged.where(mine & (F.col("count") > 1)).select("n.doc_id", "n.key"), "repeated"))
    own = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    id_col, key_col = F.col(own["doc_id"]).cast("long"), text_key(F.col(own["text"]))
    same = id_col.eqNullSafe(F.col("doc_id")) & (key_col == F.col("key"))
    kept = plain.join(extra, same, "left_anti")
    if not twice.isEmpty():
        again = kept.join(twice, same, "left_semi").dropDuplicates([own["doc_id"], own["text"]])
        kept = kept.join(twice, same, "left_anti").unionByName(again)
    return kept.select(*[F.col(a).alias(c) for c, a in own.items()])
