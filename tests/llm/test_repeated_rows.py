"""Repeated ids and rows: archives whose pages share an id, and mixes whose crossing point lies within equal rows."""

import random

import duckdb
import pytest
from test_small_operators import docs

from curvemill.llm import mixing, queries, warc


def both(spark, folder, query, table, rows):
    """The rows of a query and of its SQL over one small table."""
    rows.write.mode("overwrite").parquet(str(folder / f"{table}.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    sql = db.sql(queries.ORACLE_SQL[query])
    got = queries.QUERIES[query](spark, str(folder)).select(*sql.columns)
    return sorted(map(tuple, got.collect()), key=str), sorted(sql.fetchall(), key=str)


def test_pages_that_share_an_id(spark, tmp_path):
    rows = [(5, "u", "aaaa"), (5, "u", "bb"), (7, "u", "aaaa"), (8, "u", "bb"), (7, "v", "aaaa"), (5, "w", "aaaa"), (None, "x", "bb"), (9, None, None), (9, "y", ""), (10, "z", "")]
    got, want = both(spark, tmp_path, "op3_warc_archive", "pages", spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got == want
    digest = lambda x: warc.sha1_base32(x.encode())
    assert got.count((7, 4, digest("aaaa"), "revisit", 5)) == 2 and (8, 2, digest("bb"), "revisit", 5) in got and got.count((5, 4, digest("aaaa"), "response", None)) == 2


@pytest.mark.parametrize("sorted_rows", [mixing.SORTED, 0])
def test_mix_of_repeated_rows(spark, tmp_path, monkeypatch, sorted_rows):
    monkeypatch.setattr(mixing, "SORTED", sorted_rows)  # 0: every level of the order is a step of its own
    r = random.Random(1)
    rows = [(i, "w " * r.randrange(0, 40), r.choice("abc")) for i in range(200)] + [(7, "x y z", "a")] * 300
    rows += [(None, "q " * k, "b") for k in (3, 3, 3, 9, 9)] * 30 + [(None, "u v " * k, None) for k in (3, 3, 3, 9, 9)] * 4 + [(8, None, "a"), (8, "", "a")]
    got, want = both(spark, tmp_path, "op2_source_mix", "documents", docs(spark, rows))
    assert got == want


def test_targets_are_met_within_equal_rows(spark):
    rows = [(s * 1000 + i, "w " * 100, "abc"[s]) for s in (0, 2) for i in range(100)] + [(5, "w " * 10, "b")] * 1000
    rows += [(None, "v " * 10 + str(i), None) for i in range(500)]
    taken = mixing.mix(docs(spark, rows), weights=(5, 4, 1, 3)).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for x in taken:
        assert abs(x["sum(taken)"] - x["max(target)"]) <= (10 if x["source"] in ("b", None) else 100)
    assert {x["source"]: x["max(target)"] for x in taken}["b"] % 10_000 != 0


def test_equal_rows_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_BITS", 3)
    rows = [(i, "w " * 100, "a") for i in range(10)] + [(5, "w w", "b")] * 500
    mixed = mixing.mixed_documents(docs(spark, rows).repartition(5), weights=(5, 2)).groupBy("source").count().collect()
    assert {x["source"]: x["count"] for x in mixed} == {"a": 20, "b": 500}
    mixed = mixing.mix(docs(spark, rows).repartition(5), weights=(5, 1), share=0.73).where("source = 'b'").groupBy("taken").count().collect()
    assert {x["taken"]: x["count"] for x in mixed} == {0: 378, 2: 122}
