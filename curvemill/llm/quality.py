"""Quality rules: repetition and symbol counts, and perplexity bands of a Kneser-Ney model.

Base rules, over whole texts: words are runs without ASCII white space; a document fails if it has fewer
than 10 words, or if more than a fifth of them lie in 5-word windows that occur twice or more in it.

The method: a modified Kneser-Ney model of order 4 for each language over UTF-16 code units (whole code points, one or two units each), upper case
folded to lower case where that is one unit. Documents fall into two halves by a hash of their text, and each is scored by the model of the other half,
so junk does not vouch for itself and exact copies do not for one another. Spark counts the n-grams of both halves; counts, continuation counts,
back-off weights and probabilities of all orders are tables that grow with the corpus and stay distributed. The ``HEAD`` most frequent n-grams or fewer come
to the tasks with their log probabilities; a document's other n-grams are sent to where theirs are, so every n-gram counts with its own. A document's
log perplexity per word must lie in the band of its language and half: from the median
less ``BELOW`` to the median plus ``ABOVE`` spreads (between quartiles, of all its documents), wider for short
texts, whose perplexity varies more. Perplexity is taken per word since decoration repeated after words is cheap per symbol.

Defined cases: a null text has no words and fails; a null language is a language of its own; a document without
words has no perplexity, and only the base rules judge it; if a language's other half is empty, all symbols are alike to it; repeated rows are judged each on its own; an empty
table gives no rows. Columns of the input with the names of added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvemill.llm.shared import small, stored, stored_texts
from curvemill.llm.textbuf import CODE_POINT, WORD_BYTE, Texts, byte_values, pieces, tidy, windows

ORDER, BITS = 4, 16
SYMBOLS = 1 << BITS
MIN_WORDS, WINDOW, REPEATED_PERCENT = 10, 5, 20
#: The band below and above the median, in spreads of log perplexity; the number of words at which its variance has doubled.
BELOW, ABOVE, SHORT = 3.0, 4.0, 80
#: N-grams a task holds before it adds up what it has.
HELD = 1_000_000
#: Bytes of texts that are taken as symbols together; each takes some 100 bytes meanwhile.
SYMBOL_BYTES = 1 << 18
#: N-grams a task gives to Spark at once.
GIVEN = 1 << 16
#: N-grams that may come to every task; the others are looked up by an exchange.
HEAD = 1 << 20

SYMBOL_MARKS = np.isin(np.arange(256), list(b"#*$%&|<>"))
NOT_NEWLINE = np.arange(256) != 10
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*FEATURES, "base_failed", "kept", "log_ppl", "low", "high")
#: Cells of the grid on which medians and quartiles are taken, per unit of log perplexity.
GRID = 1024


def _folded() -> np.ndarray:
    """The symbol of each UTF-16 code unit: its lower case; 0 is kept for what precedes a text."""
    fold = np.arange(SYMBOLS)
    for c in range(1, SYMBOLS):
        low = chr(c).lower()
        if len(low) == 1 and ord(low) < SYMBOLS:
            fold[c] = ord(low)
    fold[0] = SYMBOLS - 1  # no character
    return fold


FOLD = _folded()


def symbols(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, and where each text's begin (n + 1)."""
    at = np.flatnonzero(CODE_POINT[texts.data])
    data = np.concatenate((texts.data, np.zeros(3, np.uint8)))
    b, c, d, e = (data[at + k].astype(np.int64) & (0x3F if k else 0xFF) for k in range(4))
    code = np.select([b < 0x80, b < 0xE0, b < 0xF0], [b, (b & 0x1F) << 6 | c, (b & 0xF) << 12 | c << 6 | d], (b & 7) << 18 | c << 12 | d << 6 | e)
    wide = code >= SYMBOLS
    place = np.concatenate(([0], np.cumsum(1 + wide)))
    units = np.empty(place[-1], np.int64)
    units[place[:-1]] = np.where(wide, 0xD800 + ((code - SYMBOLS) >> 10 & 0x3FF), code)
    units[place[:-1][wide] + 1] = 0xDC00 + (code[wide] & 0x3FF)
    return FOLD[units], place[np.searchsorted(at, texts.offsets)]


def _ngrams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    symbol, first = symbols(texts)
    code = symbol.copy()
    place = np.arange(len(symbol)) - np.repeat(first[:-1], np.diff(first))
    for k in range(1, ORDER):
        code[k:] |= np.where(place[k:] >= k, symbol[:-k], 0) << (BITS * k)
    return code, first


def ngrams(texts: Texts) -> np.ndarray:
    """The n-gram that ends at each symbol, as one number; before a text stand zeros."""
    return _ngrams(texts)[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}

    def add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

    held = 0
    for batch in batches:
        for part in pieces(batch, "text", SYMBOL_BYTES):
            for lang, rows in _by_language(part):
                codes, keys = pd.factorize(ngrams(Texts(rows.column("text"))))
                seen.setdefault(lang, []).append((keys, np.bincount(codes, minlength=len(keys))))
                held += len(keys)
            if held > HELD:
                seen = {lang: [add_up(parts)] for lang, parts in seen.items()}
                held = 0
    for lang, parts in seen.items():
        keys, n = add_up(parts)
        for i in range(0, len(keys), GIVEN):
            some = keys[i : i + GIVEN]
            yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(n[i : i + GIVEN])], names=["lang", "ngram", "n"])


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str | None, pa.RecordBatch]]:
    langs = batch.column("lang").dictionary_encode()
    codes = langs.indices.fill_null(len(langs.dictionary)).to_numpy()
    order = np.argsort(codes, kind="stable")
    cuts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    for low, high in zip(cuts, [*cuts[1:], len(order)]):
        code = codes[order[low]]
        yield langs.dictionary[int(code)].as_py() if code < len(langs.dictionary) else None, batch.take(pa.array(order[low:high]))


def _grouped(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns of docs, and as lang_half the half of the documents (0 or 1) and the language, never null."""
    group = F.concat(F.pmod(F.xxhash64("text"), F.lit(2)).cast("string"), F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")))
    return docs.select(*[F.col(f"`{c}`") for c in keep], group.alias("lang_half"))


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, ngram, n0, n1): counts in both halves of the documents; lang has a sign before it that tells null from a name."""
    counted = _grouped(docs, ["text"]).select(F.col("lang_half").alias("lang"), "text").mapInArrow(tidy(_count), "lang string, ngram long, n long")
    half = [F.sum(F.when(F.col("lang").startswith(h), F.col("n")).otherwise(0)).alias(f"n{h}") for h in "01"]
    return counted.groupBy(F.substring("lang", 2, 1 << 30).alias("lang"), "ngram").agg(*half)


def discounts(n: list[int]) -> list[float]:
    """What counts of 1, 2 and more lose, by how many n-grams have counts of 1 to 4."""
    if n[0] == 0 or n[1] == 0:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 0.5]
    return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(raw)]


class KneserNey:
    """Modified Kneser-Ney of counts in memory, to check ``train`` against; for each order, keys in ascending order with what belongs to them."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys = keys.astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.int64)
        levels = [(keys, counts)]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: how many different symbols precede
            keys, counts = np.unique(levels[-1][0] & np.uint64((1 << (BITS * k)) - 1), return_counts=True)
            levels.append((keys, counts))
        self.prob: list[tuple[np.ndarray, np.ndarray]] = []
        self.backoff: list[tuple[np.ndarray, np.ndarray]] = []
        for keys, counts in reversed(levels):
            context, at = np.unique(keys >> np.uint64(BITS), return_inverse=True)
            total = np.bincount(at, counts)
            by = [np.bincount(at[counts == c], minlength=len(context)) for c in (1, 2)]
            by.append(np.bincount(at[counts >= 3], minlength=len(context)))
            d = discounts([int((counts == c).sum()) for c in (1, 2, 3, 4)])
            weight = sum(x * y for x, y in zip(d, by)) / total
            own = (counts - np.take(d, np.minimum(counts, 3) - 1)) / total[at]
            self.backoff.append((context, weight))
            lower = self._lower(keys, len(self.prob))
            self.prob.append((keys, own + weight[at] * lower))

    def _lower(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Probability of each key's last symbol by the model of the given order; order 0 is uniform."""
        if order == 0:
            return np.full(len(keys), 1 / SYMBOLS)
        keys = keys & np.uint64((1 << (BITS * order)) - 1)
        known, prob = self.prob[order - 1]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        out = prob[at]
        miss = np.flatnonzero(known[at] != keys)
        if len(miss):
            context, weight = self.backoff[order - 1]
            lost = keys[miss] >> np.uint64(BITS)
            at = np.minimum(np.searchsorted(context, lost), len(context) - 1)
            out[miss] = np.where(context[at] == lost, weight[at], 1.0) * self._lower(keys[miss], order - 1)
        return out

    def probabilities(self, ngram: np.ndarray) -> np.ndarray:
        return self._lower(ngram.astype(np.int64).view(np.uint64), ORDER)


def _suffix(order: int) -> Column:
    return F.col("ngram").bitwiseAND(F.lit((1 << (BITS * order)) - 1))


def _discounted(level: DataFrame) -> DataFrame:
    """An order's counts with the discounts of its languages, a row each: d{half}{1 to 3}."""
    tally = [F.count_if(F.col(f"n{h}") == c).alias(f"c{h}{c}") for h in "01" for c in (1, 2, 3, 4)]
    rows = [(r["lang"], *(d for h in "01" for d in discounts([r[f"c{h}{c}"] for c in (1, 2, 3, 4)]))) for r in level.groupBy("lang").agg(*tally).collect()]
    schema = pa.schema([("lang", pa.string()), *((f"d{h}{c}", pa.float64()) for h in "01" for c in (1, 2, 3))])
    # of a list of rows Spark would make an RDD that Python workers of their own read
    few = pa.table([list(c) for c in zip(*rows)] or [[] for _ in schema], schema=schema)
    return level.join(F.broadcast(level.sparkSession.createDataFrame(few)), "lang")


def train(docs: DataFrame) -> DataFrame:
    """(lang, ngram, n, log0, log1): every n-gram of all documents, its count, and its log probability by the models of both halves."""
    levels = [stored_texts(count_ngrams(docs), "ngrams")]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many different symbols precede
        below = levels[-1].groupBy("lang", _suffix(k).alias("ngram")).agg(*[F.count_if(F.col(f"n{h}") > 0).alias(f"n{h}") for h in "01"])
        levels.append(stored(below, "ngrams"))
    lower = None
    for order, level in enumerate(reversed(levels), 1):
        context = Window.partitionBy("lang", F.shiftrightunsigned("ngram", BITS))
        shares = []
        for h in "01":
            n = F.col(f"n{h}")
            lost = F.when(n == 0, 0.0).when(n == 1, F.col(f"d{h}1")).when(n == 2, F.col(f"d{h}2")).otherwise(F.col(f"d{h}3"))
            total = F.sum(n).over(context)
            shares += [F.when(total > 0, (n - lost) / total).otherwise(0.0).alias(f"own{h}"), F.when(total > 0, F.sum(lost).over(context) / total).otherwise(1.0).alias(f"weight{h}")]
        shared = _discounted(level).select("lang", "ngram", "n0", "n1", *shares)
        if lower is None:
            shared = shared.withColumns({f"lower{h}": F.lit(1 / SYMBOLS) for h in "01"})
        else:
            below = lower.select("lang", F.col("ngram").alias("suffix"), F.col("p0").alias("lower0"), F.col("p1").alias("lower1"))
            shared = shared.withColumn("suffix", _suffix(order - 1)).join(below, ["lang", "suffix"])
        p = [(F.col(f"own{h}") + F.col(f"weight{h}") * F.col(f"lower{h}")).alias(f"p{h}") for h in "01"]
        lower = stored(shared.select("lang", "ngram", (F.col("n0") + F.col("n1")).alias("n"), *p), "model")
    return stored(lower.select("lang", "ngram", "n", F.log("p0").alias("log0"), F.log("p1").alias("log1")), "model")


class Head:
    """Log probabilities of the frequent n-grams, by language: keys in ascending order, and what the models of both halves give."""

    def __init__(self, table: pa.Table) -> None:
        own = table.to_pandas()
        self.of: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for lang, rows in own.groupby("lang"):
            rows = rows.sort_values("ngram")
            self.of[lang] = (rows["ngram"].to_numpy(), rows["log0"].to_numpy(), rows["log1"].to_numpy())

    def find(self, group: str, keys: np.ndarray) -> np.ndarray:
        """The log probabilities of the n-grams of a half and language by the other half's model; NaN for those that are not here."""
        if group[1:] not in self.of:
            return np.full(len(keys), np.nan)
        known, *logs = self.of[group[1:]]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, logs[1 - int(group[0])][at], np.nan)


def frequent(model: DataFrame) -> DataFrame:
    """The n-grams of a model that at most HEAD reach the count of; n-grams of equal count are in or out together."""
    ranks = model.groupBy("n").agg(F.count("*").alias("kinds")).withColumn("so_far", F.sum("kinds").over(Window.orderBy(F.desc("n"))))
    least = ranks.where(F.col("so_far") <= HEAD).agg(F.min("n")).first()[0]
    return model.where(F.col("n") >= least if least is not None else F.lit(False)).select("lang", "ngram", "log0", "log1")


def text_features(texts: Texts) -> dict[str, np.ndarray]:
    """The base features of each text."""
    starts, ends, first = texts.runs(WORD_BYTE)
    words = texts.hashes(starts, ends, _WORD_VALUES)
    n = np.diff(first)
    line_starts, line_ends, line_first = texts.runs(NOT_NEWLINE)
    lines = texts.hashes(line_starts, line_ends, _LINE_VALUES)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    owner = np.repeat(np.arange(texts.n), np.diff(line_first))[worded]
    repeated = pd.DataFrame({"text": owner, "line": lines[worded]}).duplicated().to_numpy()
    window, at = windows(words, first, WINDOW)
    owner_of_word = np.repeat(np.arange(texts.n), n)
    codes, keys = pd.factorize(window ^ (owner_of_word[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    twice = at[np.bincount(codes, minlength=len(keys))[codes] > 1] if len(at) else at
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    return {
        "n_words": n,
        "word_chars": texts.per_text(WORD_BYTE & CODE_POINT),
        "n_symbols": texts.per_text(SYMBOL_MARKS),
        "n_dup_lines": np.bincount(owner[repeated], minlength=texts.n),
        "n_repeat_words": np.bincount(owner_of_word[covered], minlength=texts.n),
    }


_WORD_VALUES = byte_values(False, WORD_BYTE)
_LINE_VALUES = byte_values(False, NOT_NEWLINE)


_RARE = {"row": pa.int64(), "ngram": pa.int64(), "times": pa.int64()}


def _score(head, columns: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", SYMBOL_BYTES):
                n = part.num_rows
                found = text_features(Texts(part.column("text")))
                logs, groups = np.zeros(n), np.array(part.column("lang_half").to_pylist(), object)
                rare: list[pd.DataFrame] = []
                for group in dict.fromkeys(groups.tolist()):
                    at = np.flatnonzero(groups == group)
                    code, first = _ngrams(Texts(part.column("text").take(pa.array(at))))
                    codes, keys = pd.factorize(code)
                    each = head.value.find(group, keys)
                    owner = np.repeat(at, np.diff(first))
                    lost = np.isnan(each)[codes]
                    logs -= np.bincount(owner[~lost], each[codes[~lost]], n)
                    if lost.any():
                        rare.append(pd.DataFrame({"at": owner[lost], "ngram": code[lost]}).groupby(["at", "ngram"], sort=False).size().reset_index(name="times"))
                names = [*columns, *FEATURES, "log_sum", "lang_half", *_RARE]
                whole = [*(part.column(c) for c in columns), *(pa.array(found[k].astype(np.int64)) for k in FEATURES), pa.array(logs), part.column("lang_half"), part.column("row")]
                yield pa.RecordBatch.from_arrays([*whole, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
                for some in rare:
                    who = pa.array(some["at"].to_numpy())
                    blank = [pa.nulls(len(some), x.type) for x in whole[:-2]]
                    more = [part.column("lang_half").take(who), part.column("row").take(who), pa.array(some["ngram"].to_numpy()), pa.array(some["times"].to_numpy())]
                    yield pa.RecordBatch.from_arrays([*blank, *more], names=names)

    return score


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs with the base features, log perplexity per word, and lang_half."""
    model = train(docs)
    head = docs.sparkSession.sparkContext.broadcast(Head(frequent(model).toArrow()))
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    own = {c: f"own_{i}" for i, c in enumerate(dict.fromkeys(keep))}
    schema = "".join(f"{own[c]} {fields[c]}, " for c in own) + "".join(f"{c} long, " for c in FEATURES) + "log_sum double, lang_half string, row long, ngram long, times long"
    # the row number follows from the scan alone, so a task that runs again gives its rows the same numbers
    slim = _grouped(docs.select("text", "lang", *[F.col(f"`{c}`").alias(a) for c, a in own.items()]), ["text", *own.values()]).withColumn("row", F.monotonically_increasing_id())
    found = stored_texts(slim.mapInArrow(tidy(_score(head, list(own.values()))), schema), "quality")
    rare = found.where("ngram is not null").select("row", "ngram", "times", F.substring("lang_half", 2, 1 << 30).alias("lang"), F.col("lang_half").startswith("0").alias("first"))
    logs = rare.join(model, ["lang", "ngram"]).groupBy("row").agg(F.sum(F.col("times") * F.when(F.col("first"), F.col("log1")).otherwise(F.col("log0"))).alias("rare_sum"))
    whole = found.where("ngram is null").join(small(stored(logs, "rare")), "row", "left")
    log_ppl = F.when(F.col("n_words") > 0, (F.col("log_sum") - F.coalesce("rare_sum", F.lit(0.0))) / F.col("n_words"))
    return whole.select(*[F.col(a).alias(c) for c, a in own.items()], *FEATURES, log_ppl.alias("log_ppl"), "lang_half")


def bands(light: DataFrame) -> DataFrame:
    """(lang_half, middle, spread): median of log perplexity and distance of the quartiles, from counts on a fixed grid: the same however rows are dealt."""
    each = light.where(F.col("log_ppl").isNotNull()).groupBy("lang_half", F.floor(F.col("log_ppl") * GRID).alias("cell")).count()
    whole = Window.partitionBy("lang_half")
    ranked = each.withColumn("so_far", F.sum("count").over(whole.orderBy("cell"))).withColumn("total", F.sum("count").over(whole))
    quartile = lambda q: F.min(F.when(F.col("so_far") >= q * F.col("total"), F.col("cell"))) / GRID
    return ranked.groupBy("lang_half").agg(quartile(0.5).alias("middle"), (quartile(0.75) - quartile(0.25)).alias("spread"))


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs, the base features, base_failed, log_ppl, its band and kept. docs has text and lang."""
    own = {c: f"kept_{i}" for i, c in enumerate(dict.fromkeys(keep)) if c not in ADDED}
    light = features(docs.select("text", "lang", *[F.col(f"`{c}`").alias(a) for c, a in own.items()]), list(own.values()))
    spread = F.greatest(F.col("spread"), F.lit(0.05)) * F.sqrt(1 + SHORT / F.greatest(F.col("n_words"), F.lit(1)))
    # two rows a language
    joined = light.join(F.broadcast(bands(light)), "lang_half", "left").withColumn("low", F.col("middle") - BELOW * spread).withColumn("high", F.col("middle") + ABOVE * spread)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    joined = joined.withColumn("base_failed", failed).withColumn("kept", ~failed & inside)
    return joined.select(*[F.col(a).alias(c) for c, a in own.items()], *FEATURES, "base_failed", "kept", "log_ppl", "low", "high")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns, whatever their names."""
    own = {c: c if c in ("text", "lang") else f"_{i}" for i, c in enumerate(docs.columns)}
    judged = judge(docs.select(*[F.col(f"`{c}`").alias(alias) for c, alias in own.items()]), list(own.values()))
    return judged.where("kept").select(*[F.col(alias).alias(c) for c, alias in own.items()])
