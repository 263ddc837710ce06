"""Spelling variants against brute force over all pairs of words, and against the SQL of the query."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_small_operators import ODD, docs

from curvemill.llm import queries, spelling

LETTERS = "abcdeéÿ"


def one_apart(a, b):
    """Whether a and b differ by one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, **options):
    low = {"least_length": 7, "least_count": 2, "ratio": 10, "spoiled": 31} | options
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % low["spoiled"] else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= low["least_length"] and c >= low["least_count"]}
    near = {w: [v for v in n if one_apart(v, w)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= low["ratio"] * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items()}


def corpus(r):
    """Rows of words that are often one or two edits from each other, at very different counts."""
    base = ["".join(r.choice(LETTERS) for _ in range(r.randrange(7, 10))) for _ in range(12)]
    rows = []
    for i in range(70):
        out = []
        for _ in range(60):
            w = base[min(int(r.expovariate(0.5)), 11)]
            while r.random() < 0.25:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice(LETTERS) + w[k:], w[:k] + r.choice(LETTERS) + w[k + 1 :], w.upper()])
            out.append(w)
        rows.append((i, r.choice([" ", "\n", ", ", "1", "×"]).join(out)))
    return rows


def result(df):
    return [tuple(x) for x in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize("seed", range(2))
def test_variants(spark, seed):
    rows = corpus(random.Random(seed))
    rows += [rows[0], *ODD, (None, "abcdefgh abcdefgh ×bcdefgh"), (900, "x" * 3000 + " " + "x" * 2999 + "y " + "x" * 3000 + " " + "x" * 2999 + "y")]
    want = brute(rows)
    got = result(spelling.variants(docs(spark, rows)))
    assert len(got) == len(set(got)) and set(got) == want
    assert any(form for _, form, *_ in want)


def test_chains(spark):
    # counts grow tenfold from word to word, and two forms tie in their counts
    words = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "kkkkkkk": 2, "kkkkkkm": 30, "kkkkkkl": 30, "zzzzzzz": 19, "zzzzzzy": 2, "zzzzzz": 500, "singleéé": 1}
    rows = [(1, " ".join(w for w, c in words.items() for _ in range(c)))]
    got = {x[0]: x for x in result(spelling.variants(docs(spark, rows), spoiled=1 << 40))}
    assert got["aaaaaaa"][1:3] == ("aaaaaab", "aaaabbb") and got["aaaabbb"][1:3] == (None, "aaaabbb")
    assert got["kkkkkkk"] == ("kkkkkkk", "kkkkkkl", "kkkkkkl", 2, 2, 30)
    assert got["zzzzzzy"] == ("zzzzzzy", None, "zzzzzzy", 2, 1, None) and "zzzzzz" not in got and len(got) == 9
    assert set(got.values()) == brute(rows, spoiled=1 << 40)


def test_deletions():
    words = ["aab", "", "é", "abab", "aaaa"]
    keys, places = spelling.deletion_keys(pa.array(words))
    number = {}
    for w, k in zip(words, keys):
        number[w] = k
    assert sorted(places.tolist()) == [0] * 3 + [1] + [2] * 2 + [3] * 5 + [4] * 2
    for w in words:
        gone = sorted({w[:i] + w[i + 1 :] for i in range(len(w))})
        own = spelling.deletion_keys(pa.array(gone, pa.string()))[0][: len(gone)]
        at = np.flatnonzero(places == words.index(w))
        assert sorted(keys[at[1:]].tolist()) == sorted(own.tolist()) and keys[at[0]] == number[w]


def test_empty_and_clashing(spark):
    assert result(spelling.variants(docs(spark, []))) == []
    assert result(spelling.variants(docs(spark, [(1, None), (2, ""), (3, "short words")]))) == []
    rows = [(1, "variant variant variant"), (2, "variant")]
    clash = spark.createDataFrame([(i, t, 5, "x", 1.0, None) for i, t in rows], "doc_id long, text string, n int, word string, id double, form string")
    assert set(result(spelling.variants(clash))) == brute(rows)


def test_query_and_sql(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t or "")) for i, t, *_ in [*corpus(random.Random(5)), *ODD]]
    docs(spark, [r[:2] for r in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    got = result(queries.QUERIES["op13_spelling_variants"](spark, str(tmp_path)))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = db.sql(queries.ORACLE_SQL["op13_spelling_variants"])
    assert sql.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(got, key=str) == sorted(sql.fetchall(), key=str) and set(got) == brute(rows)
