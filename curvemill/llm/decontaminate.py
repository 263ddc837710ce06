"""Benchmark decontamination as a prefix-filtered set join; built-in functions only.

An item's text is cut into windows of 10 consecutive words (a shorter item is one window), and a document word is hit
if it lies inside an occurrence of any window. A window is contained in a document only if all its shingles (single words)
are, so with shingles in order of rarity its prefix for full overlap is one shingle: the rarest.
Rarity is the count over all documents, then the word itself. Only document words that are some window's prefix
are joined; of these candidates the position of the prefix in the window gives the start, bounds drop starts that do not leave
room for the window, and the words from there on are compared with the window's.

A text is cut into words by one ``translate`` (A-Z to a-z, separators to blanks) and one ``split``, once in each of three scans: for the rarity of the
items' words, for the occurrences, and for the number of words. Document words meet the prefixes one by one. If the windows' stored table is small,
it is broadcast and a candidate is compared with its text on the spot; else words are exchanged with no more of their text than the window can reach on both sides, with
the same result. Only places where a window occurs go on.

Defined cases: a null text has no words; an item without words has no window; an item without an id marks words but is not
counted among the items; of repeated items each id counts once; rows with equal id and text get the same row each; a null document id
is a value like any other; without items nothing is hit. Columns of the input pass through, whatever their names, unless they have the name of an added one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill.llm.shared import LOWER, UPPER, fits_memory, small, stored

SIZE = 10
ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
#: What stands between words: all of ASCII but digits and letters.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    plain = F.translate(F.coalesce(text, F.lit("")), SEPARATORS + UPPER, " " * len(SEPARATORS) + LOWER)
    return F.array_remove(F.split(plain, " "), "")


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(window, items): each distinct window as an array of words, with the distinct ids of its items as strings."""
    own = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = own.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window"))
    return cut.groupBy("window").agg(F.collect_set("item").alias("items"))


def prefixes(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """(token, at, window, items): each window with its rarest word and where in the window that stands, from 0; texts has the column text."""
    vocabulary = stored(windows.select(F.explode("window").alias("token")).distinct(), "window-words")
    # explode_outer: for explode, Spark would test the array for emptiness first, and so cut every text twice
    tokens = texts.select(F.explode_outer(words(F.col("text"))).alias("token"))
    if fits_memory(vocabulary):
        counts = tokens.join(F.broadcast(vocabulary), "token").groupBy("token").count()
    else:  # counted before the exchange
        counts = tokens.groupBy("token").count().join(vocabulary, "token")
    rarity = vocabulary.join(counts, "token", "left").select("token", F.coalesce("count", F.lit(0)).alias("n"))
    placed = windows.select("window", "items", F.posexplode("window").alias("at", "token")).join(rarity, "token")
    rarest = placed.groupBy("window").agg(F.min(F.struct("n", "token", "at")).alias("rarest"), F.first("items").alias("items"))
    return rarest.select(F.col("rarest.token").alias("token"), F.col("rarest.at").alias("at"), "window", "items")


def occurrences(docs: DataFrame, prefix: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, digest, start, size, items): every place in docs (doc_id, text) where a window occurs."""
    cut = docs.select("doc_id", F.xxhash64("text").alias("digest"), words(F.col("text")).alias("w"))
    placed = cut.select("doc_id", "digest", "w", F.posexplode_outer("w").alias("pos", "token"))
    if fits_memory(prefix):
        near, low, prefix = F.col("w"), F.lit(0), F.broadcast(prefix)
    else:
        low = F.greatest(F.col("pos") - size + 1, F.lit(0))
        near = F.slice("w", low + 1, 2 * size - 1)
    placed = placed.select("doc_id", "digest", "pos", "token", F.size("w").alias("n"), low.alias("low"), near.alias("near"))
    start, length = F.col("pos") - F.col("at"), F.size("window")
    candidates = placed.join(prefix, "token").where((start >= 0) & (start + length <= F.col("n")))
    found = candidates.where(F.slice("near", start - F.col("low") + 1, length) == F.col("window"))
    return found.select("doc_id", "digest", start.alias("start"), length.alias("size"), "items")


def _found(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    windows = stored(item_windows(items, size), "windows")
    return occurrences(docs, stored(prefixes(docs, windows), "prefixes"), size)


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Column]:
    """docs under names that clash with none of ours, the name of each column, and whether a row is that of doc_id and digest."""
    own = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    same = F.col(own["doc_id"]).eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.col(own["text"]).cast("string")) == F.col("digest"))
    return rows, own, same


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256 and contaminated to every row of docs (doc_id, text); items has item_id and text."""
    found = _found(docs.select("doc_id", F.col("text").cast("string").alias("text")), items, size)
    spots = found.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "size")).alias("spots"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("ids"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("spots", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))))
    hits = small(stored(spots.select("doc_id", "digest", hit.cast("long").alias("hit"), "ids"), "hits"))
    rows, own, same = _renamed(docs)
    kept = [c for c in docs.columns if c not in ADDED]
    counted = rows.withColumn("n", F.size(words(F.col(own["text"]).cast("string"))).cast("long")).join(hits, same, "left")
    ids = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    return counted.select(
        *[F.col(own[c]).alias(c) for c in kept], F.col("n").alias("n_words"), F.coalesce("hit", F.lit(0)).alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids), ","), 256).alias("items_sha256"), F.col("hit").isNotNull().alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents in which no window of any item occurs, with their columns, whatever their names."""
    found = _found(docs.select("doc_id", F.col("text").cast("string").alias("text")), items, size)
    dirty = small(stored(found.select("doc_id", "digest").distinct(), "contaminated"))
    rows, own, same = _renamed(docs)
    return rows.join(dirty, same, "left_anti").select(*[F.col(a).alias(c) for c, a in own.items()])


_DISTINCT_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: DuckDB SQL for op6: all document windows of the sizes that occur, joined with the items' windows.
DECONTAMINATE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_DISTINCT_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_DISTINCT_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id::VARCHAR AS item, list_slice(w, k, k + 9) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT len(win) AS n FROM i),
v AS (SELECT r, k, n, list_slice(w, k, k + n - 1) AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, s WHERE len(w) >= n)),
h AS (SELECT r, k, n, item FROM v JOIN i USING (win)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
