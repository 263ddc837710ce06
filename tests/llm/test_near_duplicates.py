"""Near-duplicates: crowded buckets, shared ids and planted copies."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_small_operators import brute_classes, docs

from curvemill.llm import minhash, queries


def text(r, n, vocabulary=5000):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_one_crowded_bucket(spark):
    """Many unrelated texts in one bucket, with pairs, chains and copies of a passage among them: every link between components is found."""
    r = random.Random(1)
    passage = text(r, 20)
    rows = [(i, " ".join(text(r, 30))) for i in range(1500)]
    rows += [(5000 + i, " ".join(passage + text(r, 12))) for i in range(300)]  # alike, but under the threshold
    for k in range(60):
        w = rows[k * 7][1].split()
        rows.append((2000 + k, " ".join([*w, "tail"])))
        rows.append((3000 + k, " ".join([*w, "tail", "tail2"])))  # near the second, and the first too or not
    df = docs(spark, rows)
    texts = minhash.texts_of(minhash.sketches(df))
    node = {x["least"]: x["node"] for x in texts.collect()}
    members = texts.select(F.lit(1).cast("long").alias("bucket"), F.lit(0).alias("band"), "node")
    links = minhash.near_links(members, texts.select("node", "key", "least"), df)
    found = {x["node"]: x["component"] for x in minhash.components(links).collect()}
    got = Counter(frozenset(i for i, n in node.items() if found.get(n, n) == c) for c in {found.get(n, n) for n in node.values()})
    classes = brute_classes(rows)
    want = Counter(frozenset(i for i, x in classes.items() if x == c) for c in set(classes.values()))
    assert got == want and sum(len(c) > 1 for c in want) == 60


def test_shared_ids(spark):
    """Texts that share an id are documents of their own: no clean one is lost."""
    a, b, c = ("first text of this id is here now", "quite another text that has nothing in common", "a third one of its own about something else")
    rows = [(1, a), (1, b), (2, b), (3, c), (3, c), (4, a + " x y z"), (None, a), (None, "only here and without an id at all"), (1, None), (9, "")]
    df = docs(spark, rows)
    got = Counter((x["doc_id"], x["text"]) for x in minhash.distinct_documents(df).collect())
    assert got == Counter([(1, a), (1, b), (3, c), (4, a + " x y z"), (None, a), (None, "only here and without an id at all"), (1, None)])
    named = Counter((x["doc_id"], x["class_id"]) for x in minhash.classes(df).collect())
    assert named == Counter([(1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 4), (None, 1), (None, None), (1, 1), (9, 1)])


def planted(r, n=250):
    """Texts and near copies of them with few or more words changed; (rows, pairs of ids with their Jaccard)."""
    rows, pairs = [], []
    for i in range(n):
        w = text(r, r.randrange(40, 300))
        v = list(w)
        for _ in range(r.randrange(1, max(2, len(w) // 45))):
            v[r.randrange(len(v))] = f"n{r.randrange(10**6)}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        pairs.append((2 * i, 2 * i + 1, jaccard(rows[-2][1], rows[-1][1])))
    return rows, pairs


def test_recall_on_planted_copies(spark, tmp_path):
    """Hundreds of near copies: all of Jaccard 0.8 or more are found, none below; the figures of the README."""
    rows, pairs = planted(random.Random(6))
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x["class_id"] for x in queries.QUERIES["op5_near_duplicates"](spark, str(tmp_path)).collect()}
    near = [p for p in pairs if p[2] >= 0.8]
    found = [p for p in near if got[p[0]] == got[p[1]]]
    far = [p for p in pairs if p[2] < 0.8 and got[p[0]] == got[p[1]]]
    print(f"planted {len(pairs)}, of 0.8 or more {len(near)}, of 0.9 or more {sum(p[2] >= 0.9 for p in near)}, found {len(found)}, found below {len(far)}")
    assert len(near) > 130 and len(found) == len(near) and not far
