"""URL filters: rules by host and path, and a logistic regression on hashed character n-grams.

A rule is ``host/path``: it fits its host and all subdomains if the URL's path begins with the rule's
path; the longest fitting rule decides. Where none fits, a logistic regression over hashed n-grams (3 to 5
bytes) of host and path gives the verdict; host and path have name spaces of their own, and the host is
framed so that labels at its ends are n-grams too.

The model is trained on the driver from a labelled URL table. ``labelled_sample`` takes ``SAMPLE`` rows of it at most,
those with the smallest hashes, which is a documented bound and the same on every run. Scoring is by whole
Arrow batches: n-gram hashes of all URLs of a batch at once, no Python loop over rows.

Defined cases: a null URL and one without ``://`` have an empty host and path and are judged like any other; an empty host fits no
rule; of rules of equal length the first by code point wins; repeated rows are judged alike; without labelled
rows, or with one class only, the model gives that class (allow if there is none). Columns of the input that are not asked for are ignored, as are those
with the name of an added one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill.llm.shared import lower_ascii
from curvemill.llm.textbuf import Texts, byte_values, mix64

#: (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SAMPLE = 6000
SIZES = (3, 4, 5)
BUCKETS = 1 << 16
STEPS, RATE, PENALTY = 120, 0.5, 1e-4
ADDED = ("host", "path", "rule", "verdict", "block_probability")
_VALUES = byte_values(False, np.ones(256, bool))


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, parts, k), F.lit(""))
    return lower_ascii(part(1)), part(2)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does. A chain of literals: for short lists of rules."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def ngram_buckets(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all rows, and the row of each."""
    buckets, rows = [], []
    for space, column in enumerate((host, path)):
        texts = Texts(column)
        ends = texts.offsets[1:] + 2 * np.arange(1, texts.n + 1)
        starts = np.concatenate(([0], ends[:-1]))
        # a byte in front of each text and one behind it
        framed = np.full(len(texts.data) + 2 * texts.n, 1, np.uint8)
        framed[np.arange(len(texts.data)) + 1 + 2 * np.repeat(np.arange(texts.n), np.diff(texts.offsets))] = texts.data
        owner = np.repeat(np.arange(texts.n), ends - starts)
        value = _VALUES[framed]
        last = np.repeat(ends, ends - starts)
        for size in SIZES:
            n = max(len(framed) - size + 1, 0)
            total = np.full(n, (space << 8) + size, np.uint64)
            for k in range(size):
                total = total * np.uint64(0xD1342543DE82EF95) + value[k : k + n]
            inside = np.arange(n) + size <= last[:n]
            buckets.append((mix64(total[inside]) % np.uint64(BUCKETS)).astype(np.int64))
            rows.append(owner[:n][inside])
    return np.concatenate(buckets), np.concatenate(rows)


class UrlModel:
    """Logistic regression over n-gram buckets; counts are scaled by the square root of a URL's number of n-grams."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def score(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        """The probability that a URL is to be blocked."""
        buckets, rows = ngram_buckets(host, path)
        n = len(host)
        total = np.bincount(rows, self.weights[buckets], n)
        size = np.maximum(np.bincount(rows, minlength=n), 1)
        return 1 / (1 + np.exp(-(self.bias + total / np.sqrt(size))))

    @classmethod
    def train(cls, host: pa.Array, path: pa.Array, block: np.ndarray) -> UrlModel:
        block = np.asarray(block, float)
        if len(block) == 0 or block.min() == block.max():
            return cls(np.zeros(BUCKETS), 30.0 if len(block) and block[0] else -30.0)
        buckets, rows = ngram_buckets(host, path)
        n = len(block)
        scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
        weights, bias = np.zeros(BUCKETS), 0.0
        square, bias_square = np.full(BUCKETS, 1e-8), 1e-8
        for _ in range(STEPS):  # AdaGrad on the whole sample: no order of rows, the same on every run
            p = 1 / (1 + np.exp(-(bias + scale * np.bincount(rows, weights[buckets], n))))
            error = (p - block) / n
            slope = np.bincount(buckets, (error * scale)[rows], BUCKETS) + PENALTY / n * weights
            square += slope**2
            weights -= RATE * slope / np.sqrt(square)
            bias_square += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(bias_square)
        return cls(weights, bias)


def train(labelled: DataFrame) -> UrlModel:
    """Trains from a small table (host, path, block)."""
    rows = labelled.select("host", "path", "block").toPandas()
    return UrlModel.train(pa.array(rows["host"], pa.string()), pa.array(rows["path"], pa.string()), rows["block"].to_numpy())


def labelled_sample(urls: DataFrame, rules: Sequence[tuple[str, str]] = RULES, most: int = SAMPLE) -> DataFrame:
    """A labelled table from the URLs that rules decide: (host, path, block), ``most`` different rows at most, by smallest hash."""
    host, path = host_and_path(F.col("url"))
    judged = urls.select(host.alias("host"), path.alias("path")).withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    judged = judged.where(F.col("found").isNotNull()).select("host", "path", (F.col("found.verdict") == "block").alias("block")).distinct()
    order = F.xxhash64("host", "path")
    n = judged.count()
    if n > 2 * most:  # far beyond the bound, only rows below a hash that about 1.5 times as many fall under are sorted
        judged = judged.where(order < int((1.5 * most / n - 0.5) * 2**64))
    return judged.orderBy(order, "host", "path").limit(most)


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.value.score(batch.column("host"), batch.column("path"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "block_probability"])

    return score


def judge(urls: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str]] = RULES, keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` of urls (url) with host, path, rule, verdict and block_probability of every row."""
    keep = [c for c in dict.fromkeys(keep) if c not in ADDED]
    host, path = host_and_path(F.col("url"))
    own = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)]
    parsed = urls.select(*own, host.alias("host"), path.alias("path"))
    schema = ", ".join(f"{n} {t}" for n, t in parsed.dtypes) + ", block_probability double"
    scored = parsed.mapInArrow(_scorer(urls.sparkSession.sparkContext.broadcast(model)), schema)
    found = longest_rule(F.col("host"), F.col("path"), rules)
    scored = scored.withColumn("found", found)
    learned = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return scored.select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), learned).alias("verdict"), "block_probability",
    )
