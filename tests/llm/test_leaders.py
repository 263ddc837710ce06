"""A group of near copies has few leaders, whatever the number of buckets its texts share."""

from curvemill.llm import minhash


def test_near_copies_are_compared_with_few_leaders(spark, monkeypatch):
    n, base = 150, [f"w{i}" for i in range(400)]
    texts = [" ".join(f"x{k}" if i == k * 2 else w for i, w in enumerate(base)) for k in range(n)]
    counts, keep = {}, minhash.stored

    def counted(df, label):
        out = keep(df, label)
        counts.setdefault(label, out.count())
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    found = minhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["class_id"] for r in found} == {0} and counts["pairs"] <= 4 * n
