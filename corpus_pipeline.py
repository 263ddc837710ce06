"""The corpus pipeline over ``documents``: quality rules, near-duplicates, leaks, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored as Parquet and read again as the next stage's
docs. All but the last return the columns of documents:

1. quality: documents that the quality rules reject go;
2. dedup: of each class of near-duplicates the document with the smallest id stays;
3. decontaminate: documents in which any window of a benchmark item occurs go;
4. mix: sources are mixed to their target weights; a document taken twice is there twice;
5. tokens: token files are written and read back, one row a document with its place and checksum.

ORACLE_SQL is None: perplexity bands, signatures and token ids are not SQL; tests/llm holds the stages against brute force.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curvemill.llm import decontaminate, minhash, mixing, quality, shared, tokens
from curvemill.llm.queries import byte_bpe
from curvemill.llm.shared import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.distinct_documents(docs)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.tokenize(spark, docs.select("doc_id", "text"), byte_bpe())


#: Scratch tables of the last stage of each pipeline, by thread and input.
_left: dict[tuple[int, str], list[str]] = {}


def _staged(work: Callable, first: bool) -> Callable:
    """A stage that first discards the scratch tables of the one before it over the same input, whose result is stored by then."""

    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        mine = threading.get_ident(), sf_dir
        before = _left.pop(mine, [])
        if not first:
            shared.discard(spark, before)
        with shared.recorded() as made:
            out = work(spark, docs, sf_dir)
        _left[mine] = made
        return out

    return stage


STAGES = [
    ("quality", _staged(keep_good, True)),
    ("dedup", _staged(keep_distinct, False)),
    ("decontaminate", _staged(keep_unleaked, False)),
    ("mix", _staged(mix_sources, False)),
    ("tokens", _staged(write_token_files, False)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
