"""What an executor's Python workers and batches hold while the stages of the pipeline run one after another."""

import os

import pyarrow as pa
import pytest

from curvemill.llm import quality, queries, shared, textbuf, tokens

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_long_texts_come_in_batches_of_few(spark):
    def count(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    texts = spark.range(0, 60, 1, 1).selectExpr("repeat('x', if(id = 30, 3000000, 200000)) AS text")
    own = spark.conf.get(BYTES)
    sizes = [r["n"] for r in shared.stored_texts(texts.mapInArrow(count, "n long"), "sizes").collect()]
    assert sum(sizes) == 60 and (max(sizes) - 1) * 200_000 < shared.TEXT_BYTES  # one batch of 60 before
    assert spark.conf.get(BYTES) == own and spark.conf.get(BYTES, None) is None


def test_a_bound_of_the_session_stays(spark):
    spark.conf.set(BYTES, "3m")
    try:
        with shared.batches_of_texts(spark):
            assert spark.conf.get(BYTES) == "3m"
        assert spark.conf.get(BYTES) == "3m"
    finally:
        spark.conf.unset(BYTES)


def test_other_steps_drop_the_encoder_and_its_own_keep_it():
    def work(batches):
        yield from batches

    path = queries.byte_bpe()
    held = tokens.encoder(path)
    held.encode(pa.array(["some words to remember"]), 2)
    list(textbuf.tidy(work, remembers=True)(iter([])))
    assert tokens.encoder(path) is held and len(held.keys)
    list(textbuf.tidy(work)(iter([])))
    assert tokens.encoder.cache_info().currsize == 0  # it stayed for good before


def test_the_library_starts_no_threads_in_a_task(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    tokens.encoder.cache_clear()
    tokens.encoder(queries.byte_bpe())
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


@pytest.mark.parametrize("n", [0, 40])
def test_discounts_need_no_python_workers(spark, n):
    rows = [("=en" if i % 2 else "-", i, i % 5, i % 4) for i in range(n)]
    level = spark.createDataFrame(pa.table([list(c) for c in zip(*rows)] or [[]] * 4, schema=pa.schema([("lang", pa.string()), *((c, pa.int64()) for c in ("ngram", "n0", "n1"))])))
    joined = quality._discounted(level)
    assert "ExistingRDD" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.columns == ["lang", "ngram", "n0", "n1", "d01", "d02", "d03", "d11", "d12", "d13"]
    found = {r["lang"]: r for r in joined.collect()}
    assert joined.count() == n and set(found) == {lang for lang, *_ in rows}
    for lang, r in found.items():
        for h in "01":
            counts = [x[2 + int(h)] for x in rows if x[0] == lang]
            assert [r[f"d{h}{c}"] for c in (1, 2, 3)] == quality.discounts([counts.count(c) for c in (1, 2, 3, 4)])
