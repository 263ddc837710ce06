"""Spelling variants of the words of a corpus: a symmetric-delete join, forms, and the roots that forms lead to.

Words are counted before anything is exchanged. Each distinct word emits the number of itself and those of its distinct single deletions; two words
that differ by one inserted, deleted or replaced code point always have one of these numbers in common, so an equi-join on it finds all candidates, and
an exact edit distance decides. The numbers are sums of mixed code points times powers of an odd number, so all deletions of a word cost its length, not its square, and
equal numbers of unequal strings only add candidates. Rows that are exchanged hold two numbers; words are joined to candidates by their own unique number.
The partners of a word are bounded by its length times the alphabet, whatever the corpus.

A word's form is its most frequent near word (ties: the smallest in code-point order) if that is ``RATIO`` times as frequent as the word. Forms grow by that factor
from step to step, so chains are short and have no cycles; roots are found by joining the forms with themselves, twice as far each time.

Words: maximal runs of ASCII letters and U+00C0 to U+00FF, A-Z lower-cased, counted over all texts. To tell rare misspellings from words, occurrences are perturbed
in the same way at each run: where ``SPOILED`` divides the CRC of ``<doc_id>:<run>``, one code point is dropped.

Defined cases: a null text has no words, a null id is an empty one; each repeated row counts; very long runs are words like any other;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm.shared import LOWER, UPPER, stored
from curvemill.llm.textbuf import BASE, Texts, mix64, pieces, powers

#: Least code points and occurrences of a word; how much more frequent a form is; one in so many runs of a document is spoiled.
LEAST_LENGTH, LEAST_COUNT, RATIO, SPOILED = 7, 2, 10, 31
KEYED_BYTES = 1 << 20
#: What undoes one power of the base, modulo 2^64.
_INVERSE = np.uint64(pow(BASE, -1, 1 << 64))


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, spoiled: int = SPOILED) -> DataFrame:
    """(word, n): the words of docs (doc_id, text) and how often each occurs."""
    runs = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(f"[a-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0))
    # explode_outer: for explode, Spark would test the array for emptiness first, and so search every text twice
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode_outer(runs).alias("run")).where(F.col("run").isNotNull())
    code = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = F.pmod(code, F.length("run")).cast("int")
    spoilt = F.concat(F.left("run", at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.pmod(code, F.lit(spoiled)) == 0, spoilt).otherwise(F.col("run"))
    return found.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def deletion_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words and of their distinct single deletions, and the place in the column of the word of each."""
    texts = Texts(column)
    codes = np.frombuffer(texts.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    first = np.concatenate(([0], np.cumsum((texts.data & 0xC0) != 0x80)))[texts.offsets]
    sizes = np.diff(first)
    owner = np.repeat(np.arange(texts.n), sizes)
    at = np.arange(len(codes)) - first[owner]
    values = (mix64(codes.astype(np.uint64)) | np.uint64(1)) * powers(int(sizes.max(initial=0)))[at]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    low, high = sums[first[:-1]], sums[first[1:]]
    keep = np.flatnonzero((at == 0) | (codes != np.roll(codes, 1)))  # of equal neighbours, deleting the first is enough
    mine = owner[keep]
    without = sums[keep] - low[mine] + (high[mine] - sums[keep + 1]) * _INVERSE
    key = lambda number, size: mix64(number ^ size.astype(np.uint64) * np.uint64(BASE)).view(np.int64)
    return np.concatenate((key(high - low, sizes), key(without, sizes[mine] - 1))), np.concatenate((np.arange(texts.n), mine))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "word", KEYED_BYTES):
            keys, places = deletion_keys(part.column("word"))
            yield pa.record_batch([pa.array(keys), part.column("id").take(pa.array(places))], names=["key", "id"])


def near_pairs(known: DataFrame) -> DataFrame:
    """(a, b): the numbers of all words of known (id, word) that differ by one code point, each pair once; known is a stored table."""
    keyed = known.select("id", "word").mapInArrow(_keyed, "key long, id long")
    other = keyed.select("key", F.col("id").alias("b"))
    pairs = keyed.withColumnRenamed("id", "a").join(other, "key").where("a < b").select("a", "b").distinct()
    word = lambda side: known.select(F.col("id").alias(side), F.col("word").alias(f"{side}_word"))
    both = pairs.join(word("a"), "a").join(word("b"), "b")
    return both.where(F.levenshtein("a_word", "b_word", 1) == 1).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): where the forms (id, form) lead to in the end."""
    state = stored(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        further = state.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = stored(state.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        state = moved.select("id", "root")
        if moved.where("moved").isEmpty():
            return state


def variants(docs: DataFrame, *, ratio: int = RATIO, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of docs (doc_id, text); ``options`` as for ``words``."""
    known = stored(words(docs, **options).withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = stored(near_pairs(known), "near-words")
    links = pairs.union(pairs.select("b", "a")).toDF("id", "other")
    other = known.select(F.col("id").alias("other"), F.col("word").alias("o_word"), F.col("n").alias("o_n"))
    best = F.min(F.struct((-F.col("o_n")).alias("less"), "o_word", "other"))
    near = links.join(other, "other").groupBy("id").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    pick = lambda c: F.when(fits, c)
    judged = known.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        pick(F.col("best.o_word")).alias("form"), pick(-F.col("best.less")).alias("form_n"), pick(F.col("best.other")).alias("form_id"),
    )
    judged = stored(judged, "judged-words")
    ends = roots(judged.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    names = known.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    named = ends.join(names, "root").select("id", "root_word")
    return judged.join(named, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


_RUNS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')"

#: DuckDB SQL for op13. The table of the CRC follows from its polynomial; near words share a deletion at one place, or one is a deletion of the other.
VARIANTS_SQL = f"""
WITH RECURSIVE bits AS (SELECT i AS k, 0 AS step, i::UBIGINT AS v FROM range(256) t(i)
  UNION ALL SELECT k, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM bits WHERE step < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY k) AS t FROM bits WHERE step = 8),
hexes AS MATERIALIZED (SELECT map(list(printf('%02X', i)), list(i::UBIGINT)) AS m FROM range(256) t(i)),
runs AS (SELECT doc, run, count(*) AS c FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest({_RUNS}) AS run FROM documents) WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
coded AS (SELECT run, c, xor(4294967295::UBIGINT, list_reduce(list_transform(regexp_extract_all(hex(encode(doc || ':' || run)), '..'), lambda x: m[x]),
  lambda s, b: xor(s >> 8, t[((xor(s, b) & 255) + 1)::BIGINT]), 4294967295::UBIGINT)) AS h FROM runs, crc, hexes),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % {SPOILED} = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, c FROM coded)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
gone AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT x.word AS a, y.word AS b FROM gone x JOIN gone y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT g.word, w.word FROM gone g JOIN words w ON g.rest = w.word UNION SELECT w.word, g.word FROM gone g JOIN words w ON g.rest = w.word),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY w.n DESC, encode(b)) AS form, max(w.n) AS form_n FROM pairs JOIN words w ON w.word = b GROUP BY a),
judged AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= {RATIO} * n THEN form END AS form, CASE WHEN form_n >= {RATIO} * n THEN form_n END::BIGINT AS form_n
  FROM words LEFT JOIN best ON a = word),
chase AS (SELECT word, word AS root, form AS next FROM judged UNION ALL SELECT c.word, j.word, j.form FROM chase c JOIN judged j ON j.word = c.next)
SELECT j.word, j.form, c.root, j.n, j.n_near, j.form_n FROM judged j JOIN chase c ON c.word = j.word AND c.next IS NULL
"""
