"""How much of texts and n-grams is in memory at once where Spark and Python meet."""

import numpy as np
import pyarrow as pa
import pytest

from curvemill.llm import quality, shared

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_python_gets_texts_in_short_batches(spark):
    def count(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    own = spark.conf.get(ROWS)
    sizes = spark.range(0, 9000, 1, 1).mapInArrow(count, "n long")
    short = [r["n"] for r in shared.stored_texts(sizes, "sizes").collect()]
    assert max(short) <= shared.TEXTS < 9000 and sum(short) == 9000
    assert spark.conf.get(ROWS) == own
    assert max(r["n"] for r in shared.stored(sizes, "sizes").collect()) > shared.TEXTS


def test_short_batches_within_others_and_after_a_failure(spark):
    own = spark.conf.get(ROWS)
    with pytest.raises(ValueError):
        with shared.batches_of_texts(spark):
            with shared.batches_of_texts(spark):
                assert int(spark.conf.get(ROWS)) == shared.TEXTS
            assert int(spark.conf.get(ROWS)) == shared.TEXTS
            raise ValueError
    assert spark.conf.get(ROWS) == own
    spark.conf.set(ROWS, "10")
    try:
        with shared.batches_of_texts(spark):
            assert spark.conf.get(ROWS) == "10"
        assert spark.conf.get(ROWS) == "10"
    finally:
        spark.conf.set(ROWS, own)


def test_counted_ngrams_leave_a_task_in_parts():
    letters = np.random.default_rng(3).integers(0x4E00, 0x9FFF, 200_000)
    texts = ["".join(map(chr, letters[i : i + 100])) for i in range(0, len(letters), 100)]
    batch = pa.record_batch([pa.array(["0=zh"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    parts = list(quality._count(iter([batch])))
    assert len(parts) > 1 and max(p.num_rows for p in parts) <= quality.GIVEN  # one batch before
    assert sum(sum(p.column("n").to_pylist()) for p in parts) == len(letters)
    keys = np.concatenate([p.column("ngram").to_numpy() for p in parts])
    assert len(np.unique(keys)) == len(keys)
