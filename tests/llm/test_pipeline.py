"""The pipeline against a plain version of its stages over a small corpus."""

import random
import zlib

import numpy as np
from test_small_operators import DOCS, brute_classes, brute_hits

import corpus_pipeline
from curvemill.llm import mixing, quality, queries, tokens


def corpus(r):
    word = lambda: "".join(r.choice(["th", "an", "er", "in", "ou"]) for _ in range(r.randrange(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(i, line(14)) for i in range(4)]
    rows = [(i, line(r.randrange(20, 120))) for i in range(50)]
    rows += [(100 + i, rows[i][1]) for i in range(8)]  # exact copies
    rows += [(200 + i, rows[10 + i][1] + " tail") for i in range(8)]  # near copies
    rows += [(300 + i, f"{line(30)} {items[i][1]} {line(30)}") for i in range(4)]  # leaks
    rows += [(400, None), (401, ""), (402, "too short"), (403, "again and again and again " * 20)]
    return [(i, t, "en", r.choice(["a", "b", "c"]), len(t or "")) for i, t in rows], items


def test_pipeline(spark, tmp_path):
    rows, items = corpus(random.Random(11))
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    good = {x["doc_id"] for x in quality.judge(docs, ["doc_id"]).where("kept").collect()}
    assert not good & {400, 401, 402, 403} and len(good) > 60
    near = brute_classes([(i, t) for i, t, *_ in rows if i in good])
    distinct = {i for i, c in near.items() if i == c}
    clean = [x for x in rows if x[0] in distinct and not brute_hits(x[1], items)[4]]
    assert not {x[0] for x in clean} & {300, 301, 302, 303}
    taken = mixing.mix(spark.createDataFrame(clean, DOCS)).select("doc_id", "text", "repeats").collect()
    mixed = sorted((x["doc_id"], x["text"]) for x in taken for _ in range(x["repeats"]))

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "dedup", "decontaminate", "mix", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    library, start = tokens.encoder(queries.byte_bpe()).library, 0
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda x: x["start"])
    assert [x["doc_id"] for x in got] == [i for i, _ in mixed]
    for x, (_, text) in zip(got, mixed):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_odd_tables(spark, tmp_path):
    """Rows without id or text, columns that clash with the stages' own, and an empty table."""
    r = random.Random(3)
    rows, items = corpus(r)
    rows = [*rows[:30], *[(None, t, lang, source, n) for _, t, lang, source, n in rows[30:36]], (700, rows[0][1], None, None, None), (701, None, None, None, None)]
    clash = ["hit", "digest", "node", "count", "lang_half", "row", "size", "bucket", "key", "_0"]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *[f"'x{c}' AS {c}" for c in clash])
    for name, some in (("odd", docs), ("empty", docs.limit(0))):
        top = tmp_path / name
        some.write.parquet(str(top / "documents.parquet"))
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(top / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(top)).collect()
        assert bool(got) == (name == "odd") and all(x["n_tokens"] > 0 for x in got)
        if name == "odd":
            assert sum(x["doc_id"] is None for x in got) >= 1 and {x["doc_id"] for x in got} <= {x[0] for x in rows} and 701 not in {x["doc_id"] for x in got}
            kept = corpus_pipeline.STAGES[1][1](spark, some, str(top))
            assert kept.columns == docs.columns and all(kept.where(f"`{c}` <> 'x{c}'").isEmpty() for c in clash)
