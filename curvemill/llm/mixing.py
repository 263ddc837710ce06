"""Mixing sources to target weights by capped water-filling; built-in functions only.

Each source gets a share of the word budget in proportion to its weight, but never more than
``max_epochs`` times its own words; what a clamped source cannot use goes to the others by weight until
no source is above its limit. In order of limit over weight, source k is clamped exactly if the level
that remains for sources k, k+1, ... reaches its limit, so the fixed point of that loop is found
with two running sums over one row per source.

A source's target is met by whole repetitions of every document and by a seeded part of one more:
documents in the order of a seeded hash of their ids (then of size, then of a hash of the text), up to the one that crosses the target, which is taken if that
comes nearer. The crossing point is found by sums of ever finer parts of that order (``LEVELS``): of hash buckets, of the smaller buckets within the one that
crosses, and so on to the equal rows, so no task ever sorts a source, one id or all rows without one, and each document decides alone against one row per source.
Of equal rows at the crossing point, as many are taken as come nearest; they are numbered in chunks.

Defined cases: a null text has size 0; null sources form one source, last in order; a source without
words has target 0; repeated rows are rows of their own; a null id hashes as an empty
text; an empty table gives an empty mix. Other columns pass through; those named like an added column
are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvemill.llm.shared import small, stored, word_count

#: Up to so many sources (about 20 MB) the plan is broadcast; with more it is joined by shuffle.
BROADCAST_SOURCES = 100_000
#: The order of documents, from coarse to fine: 4,096 buckets of the seeded hash, as many within each, ids, sizes, and texts by 4,096 buckets of their hashes.
LEVELS = {"coarse": "substring(key, 1, 3)", "fine": "substring(key, 1, 6)", "key": "key", "size": "size", "text_part": "shiftright(text_hash, 52)", "text_hash": "text_hash"}
#: Rows that one task may sort: where no more of a source are left, all finer parts are looked at together.
SORTED = 1 << 16
#: Rows that are numbered together.
CHUNK_BITS = 20
ADDED = ("size", "source_size", "target", "repeats", "taken")


def _key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def water_fill(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size) -> the same with weight, limit and target, one row a source.

    Weights are dealt to the sources in order of their names by code point, null last, and repeat.
    """
    everything = Window.partitionBy()
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.select(
        "source", "source_size", F.get(dealt, F.pmod(F.col("n") - 1, F.lit(len(weights)))).alias("weight"),
        (F.lit(float(max_epochs)) * F.col("source_size")).alias("limit"),
        (F.lit(float(share)) * F.sum("source_size").over(everything)).alias("budget"), "n",
    )
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "n")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    left = F.greatest(F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)), F.lit(0.0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(onward)).withColumn("k", F.row_number().over(by_ratio))
    open_ = F.col("level") < F.col("limit") / F.col("weight")
    first = F.min(F.when(open_, F.struct("k", "level"))).over(everything)
    return levels.withColumn("first", first).select(
        "source", "source_size", "weight", "limit",
        F.when(F.col("first").isNull() | (F.col("k") < F.col("first.k")), F.col("limit")).otherwise(F.col("weight") * F.col("first.level")).alias("target"),
    )


def _crossings(digest: DataFrame, parts: DataFrame) -> DataFrame:
    """(source, key, size, text_hash, n, copies): the equal rows in which each source's part (a column of parts) is reached, how many they are, and how many of them come nearest to it."""
    rows = digest.selectExpr("source AS d_source", "size AS d_words", *[f"{e} AS d_{name}" for name, e in LEVELS.items()])
    at, chosen, left = parts.select("source", "part", F.lit(0).cast("long").alias("before")), [], list(LEVELS)
    few = False
    while left:
        step = left if few else left[:1]
        same = F.col("d_source").eqNullSafe(F.col("source"))
        for c in chosen:
            same &= F.col(f"d_{c}") == F.col(c)
        sums = rows.join(small(at), same).groupBy("source", "part", "before", *chosen, *[F.col(f"d_{c}").alias(c) for c in step])
        sums = sums.agg(F.sum("d_words").alias("words"), F.count("*").alias("n"))
        running = Window.partitionBy("source").orderBy(*step).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(running), F.lit(0)))
        chosen, left = chosen + step, left[len(step) :]
        crossed = (F.col("part") > F.col("before")) & (F.col("part") <= F.col("before") + F.col("words"))
        at = stored(sums.where(crossed).select("source", "part", "before", *chosen, "n"), "mix-crossing")
        few = (at.agg(F.max("n")).first()[0] or 0) <= SORTED
    nearest = F.floor((F.col("part") - F.col("before") - F.col("size") / 2) / F.col("size")) + 1
    return at.select("source", "key", "size", "text_hash", "n", F.greatest(F.least(nearest, "n"), F.lit(0)).cast("long").alias("copies"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds place, from 1, to equal rows of each source, numbered in chunks."""
    fixed = stored(rows.withColumn("_at", F.monotonically_increasing_id()), "mix-equal").withColumn("_chunk", F.shiftright("_at", CHUNK_BITS))
    before = Window.partitionBy("_source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = fixed.groupBy("_source", "_chunk").count()
    starts = counts.select(F.col("_source").alias("_s"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_source", "_chunk").orderBy("_at"))
    joined = fixed.withColumn("_inside", inside).join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c")))
    return joined.withColumn("place", F.col("_start") + F.col("_inside")).drop("_at", "_chunk", "_s", "_c", "_start", "_inside")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2, seed: int = 17, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Adds size, source_size, target, repeats and taken (words taken, repeats counted) to every row of docs."""
    digest = stored(docs.select(
        F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
        _key(F.col(id_col), seed).alias("key"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
    ), "mix-digest")
    targets = water_fill(digest.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = stored(targets.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")

    t, c = targets.alias("t"), _crossings(digest, targets).alias("c")
    last = F.when(F.col("c.key").isNotNull(), F.struct("c.key", "c.size", "c.text_hash")).alias("last")
    plan = stored(t.join(c, F.col("t.source").eqNullSafe(F.col("c.source")), "left").select("t.source", "source_size", "target", "whole", "part", last, "n", "copies"), "mix-plan")
    split = not plan.where("copies > 0 and copies < n").isEmpty()
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)

    own = {x: f"_{i}" for i, x in enumerate(docs.columns)}  # no column of docs can clash with those of the plan
    rows = docs.select(*[F.col(f"`{x}`").alias(a) for x, a in own.items()])
    text = F.col(own[text_col]).cast("string")
    mine = F.struct(_key(F.col(own[id_col]), seed).alias("key"), word_count(F.col(own[text_col])).alias("size"), F.xxhash64(text).alias("text_hash"))
    p = plan.withColumnRenamed("source", "_source")
    joined = rows.withColumn("mine", mine).join(p, F.col(own[source_col]).cast("string").eqNullSafe(F.col("_source")), "left")
    equal = F.coalesce(F.col("mine") == F.col("last"), F.lit(False))
    before = F.coalesce(F.col("mine") < F.col("last"), F.lit(False))
    if split:
        parted = F.coalesce(equal & (F.col("copies") > 0) & (F.col("copies") < F.col("n")), F.lit(False))
        some = _numbered(joined.where(parted))
        joined = joined.where(~parted).withColumn("more", before | equal & (F.col("copies") == F.col("n")))
        joined = joined.unionByName(some.withColumn("more", F.col("place") <= F.col("copies")).drop("place"))
    else:
        joined = joined.withColumn("more", before | equal & (F.col("copies") == F.col("n")))
    repeats = (F.col("whole") + F.coalesce(F.col("more") & (F.col("part") > 0), F.lit(False)).cast("int")).cast("int")
    kept = [x for x in docs.columns if x not in ADDED]
    return joined.select(
        *[F.col(own[x]).alias(x) for x in kept], F.col("mine.size").alias("size"), "source_size", "target", repeats.alias("repeats"), (repeats * F.col("mine.size")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs, whatever their names."""
    own = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    taken = mix(plain, id_col=own[id_col], source_col=own[source_col], text_col=own[text_col], **options)
    copies = taken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("repeats"))))
    return copies.select(*[F.col(a).alias(c) for c, a in own.items()])


#: DuckDB SQL for the query op2: the same buckets are not needed there, a running sum by key gives the same cut.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT source, source_size, n, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(n - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS lim,
             1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY lim / weight, n) AS k,
             greatest(budget - coalesce(sum(lim) OVER (ORDER BY lim / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE), 0.0::DOUBLE)
               / sum(weight) OVER (ORDER BY lim / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT min(k) AS k, arg_min(level, k) AS level FROM l WHERE level < lim / weight),
t AS (SELECT l.source, l.source_size, CASE WHEN f.k IS NULL OR l.k < f.k THEN lim ELSE weight * f.level END AS target FROM l, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS part,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN part > 0 AND so_far + size / 2.0::DOUBLE <= part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
