"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curvemill.llm import brown, decontaminate, licenses, minhash, mixing, pii, quality, queries, shared, tokens, urls, warc
from curvemill.llm.graph import components
from curvemill.llm.shared import as_uri, scratch_path
from curvemill.llm.textbuf import WORD_BYTE, Texts, byte_values, mix64, pieces, windows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


def docs(spark, rows):
    """(id, text[, source]) rows with the columns of documents."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCS)


ODD = [(1, None, None), (2, "", "b"), (3, " \n\t ", "b"), (4, LONG, "a"), (5, "same words here in this line again", "a"), (5, "same words here in this line again", "a"), (None, "no id but text", None), (7, "é ß ñ — 日本", "b")]


def test_text_buffer():
    texts = [None, "", "One  two\tTHREE", " é\u00a0x ", "a", "one two three"]
    t = Texts(pa.array(texts).slice(0, 6))
    starts, ends, first = t.runs(WORD_BYTE)
    raw = t.data.tobytes()
    want = [(x or "").encode().split() for x in texts]
    assert [raw[s:e] for s, e in zip(starts, ends)] == sum(want, []) and np.diff(first).tolist() == [len(w) for w in want]
    h = t.hashes(starts, ends, byte_values(True, WORD_BYTE))
    assert h[:3].tolist() == h[-3:].tolist() and len(set(h.tolist())) == 5
    w, at = windows(h, first, 3)
    assert at.tolist() == [0, 5] and w[0] == w[1]
    batch = pa.record_batch([pa.array(["x" * 10, "y" * 100, "", None, "z"])], names=["text"])
    assert [p.num_rows for p in pieces(batch, "text", 12)] == [1, 1, 3]
    assert len(windows(h[:0], np.zeros(1, np.int64), 3)[0]) == 0


# ---- URL filters ----


def test_url_rules(spark):
    rows = [
        (1, "http://A.example.NET/en/x?q#f"), (2, "https://example.net/de"), (3, "http://x.example.com/de/1"), (4, "http://badexample.com/de/1"), (5, "http://a.org/fr/"), (6, None), (7, "no scheme/net/"),
        (8, "http://net"), (9, "http://net/"), (10, "x://Y?z"), (11, "http://a.net\n/q"), (12, "http://e.com://net/"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(df, urls.train(urls.labelled_sample(df)), keep=["page_id", "url"]).collect()}
    assert [got[i]["rule"] for i in range(1, 13)] == ["example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None, None, "net/", None, None, None]
    assert (got[1]["host"], got[1]["path"]) == ("a.example.net", "/en/x") and (got[10]["host"], got[10]["path"]) == ("y", "") and (got[6]["host"], got[7]["host"]) == ("", "")
    assert got[1]["verdict"] == "allow" and got[2]["verdict"] == "block" and {r["verdict"] for r in got.values()} <= {"allow", "block"}
    empty = df.limit(0)
    assert urls.judge(empty, urls.train(urls.labelled_sample(empty))).count() == 0


def test_url_model_on_held_out_urls():
    r = random.Random(1)
    make = lambda bad: (f"{'casino' if bad else 'library'}{r.randrange(999)}.example", f"/{r.choice(['win', 'spin']) if bad else r.choice(['books', 'maps'])}/{r.randrange(9999)}")
    rows = [(*make(i % 2), i % 2) for i in range(400)]
    part = lambda rs, k: pa.array([x[k] for x in rs])
    model = urls.UrlModel.train(part(rows[:200], 0), part(rows[:200], 1), np.array([x[2] for x in rows[:200]]))
    p = model.score(part(rows[200:], 0), part(rows[200:], 1))
    assert ((p > 0.5) == np.array([x[2] for x in rows[200:]])).mean() > 0.97


def test_url_ngrams_by_hand():
    buckets, rows = urls.ngram_buckets(pa.array(["ab", "", "ab"]), pa.array(["", "/x", ""]))
    count = lambda n: sum(max(n + 2 - k + 1, 0) for k in urls.SIZES)
    assert np.bincount(rows).tolist() == [count(2) + count(0), count(0) + count(2), count(2) + count(0)]
    assert sorted(buckets[rows == 0]) == sorted(buckets[rows == 2]) != sorted(buckets[rows == 1])


# ---- mixing ----


def fill(sizes, weights, share):
    """Targets by clamping and resharing until nothing is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= 2 * sizes[s]}
        if not over:
            target.update({s: left * w[s] / total for s in open_})
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left, open_ = left - sum(target[s] for s in over), open_ - over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    r = random.Random(seed)
    rows = [(i, "x " * r.randrange(1, 60), r.choice(["a", "b", "c", "d", None]) if r.random() < 0.6 else "hot") for i in range(400)]
    out = mixing.mix(docs(spark, rows)).collect()
    sizes = {}
    for x in out:
        assert x["size"] == len(x["text"].split()) and 0 <= x["taken"] <= 2 * x["size"]
        sizes[x["source"]] = sizes.get(x["source"], 0) + x["size"]
    want = fill(sizes, (5, 2, 1), 1.5)
    for s in sizes:
        mine = [x for x in out if x["source"] == s]
        assert mine[0]["target"] == pytest.approx(want[s]) and mine[0]["source_size"] == sizes[s]
        assert abs(sum(x["taken"] for x in mine) - want[s]) <= 30
    again = {x["doc_id"]: x["taken"] for x in mixing.mix(docs(spark, rows)).repartition(7).collect()}
    assert again == {x["doc_id"]: x["taken"] for x in out}


def test_mix_odd_rows(spark):
    out = mixing.mix(docs(spark, ODD)).collect()
    assert len(out) == len(ODD) and all(x["target"] == 0 or x["source"] for x in out if x["size"] == 0 and x["source_size"] == 0)
    both = [x["taken"] for x in out if x["doc_id"] == 5]
    assert both[0] == both[1]
    assert mixing.mix(docs(spark, []).limit(0)).count() == 0
    clash = docs(spark, ODD).selectExpr("*", "'keep' AS size", "'me' AS target")
    mixed = mixing.mixed_documents(clash)
    assert mixed.columns == clash.columns and {tuple(r) for r in mixed.select("size", "target").collect()} == {("keep", "me")}


# ---- WARC ----


def test_warc_round_trip(spark):
    rows = [(3, "http://a", "same"), (1, "http://b", "same"), (2, None, None), (4, "u\r\nx: y", ""), (5, "http://c", "ü" * 50_000), (None, "http://d", "same"), (None, "http://e", "lonely"), (6, "http://f", "a\r\n\r\nb")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "1 AS first")
    folder = as_uri(scratch_path(spark, "warc"))
    index = warc.write_archives(pages, folder)
    got = {(r["page_id"], r["payload_digest"]): r for r in warc.read_records(index, folder).collect()}
    digest = lambda x: warc.sha1_base32((x or "").encode())
    assert len(got) == len(rows)
    for page, _, html in rows:
        r, same = got[page, digest(html)], (html or "").encode()
        first = {"same": 1, "": 2}.get(html or "", page)
        kind = "response" if page == first else "revisit"
        assert (r["record_type"], r["payload_bytes"], r["refers_to"]) == (kind, len(same), None if kind == "response" else first)
        assert r["payload"] == (same if kind == "response" else b"")
    some = warc.read_records(index.where("page_id in (1, 5)"), folder).collect()
    assert sorted(r["page_id"] for r in some) == [1, 5]
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_ranges_are_read_together():
    got = list(warc.coalesce_ranges([(0, 10), (10, 5), (40, 5), (200, 5), (205, 100)], gap=30, most=100))
    assert got == [(0, 3, 0, 45), (3, 4, 200, 5), (4, 5, 205, 100)]


def test_damaged_records_are_noticed(spark):
    member, _ = warc.encode_record(1, "http://a/", b"payload", None)
    assert warc.decode_record(member)[2:5] == (b"payload", 7, warc.sha1_base32(b"payload"))
    import zlib as z

    raw = z.decompress(member, 31).replace(b"payload\r\n\r\n", b"paYload\r\n\r\n")
    packer = z.compressobj(1, z.DEFLATED, 31)
    with pytest.raises(warc.Damaged):
        warc.decode_record(packer.compress(raw) + packer.flush())
    rows = [(1, "u", None, 7, "D", "response", None), (2, "u", None, 7, "D", "revisit", 1), (3, "u", None, 7, "D", "revisit", 9)]
    records = spark.createDataFrame(rows, warc.RECORD)
    assert sorted((x["page_id"], x["payload_bytes"]) for x in warc.resolved(records.where("page_id < 3")).collect()) == [(1, 7), (2, 7)]
    with pytest.raises(Exception, match="revisit without its response"):
        warc.resolved(records).collect()


# ---- class-based model ----


def test_exchange_finds_classes():
    r = np.random.default_rng(0)
    counts = np.zeros((13, 13))
    last = 12
    for _ in range(20_000):  # words 0-5 and 6-11 alternate
        w = r.integers(6) + (6 if last < 6 else 0)
        counts[last, w] += 1
        last = w
    own = brown.exchange(counts, classes=3)
    assert len({*own[:6]}) == 1 and len({*own[6:12]}) == 1 and own[0] != own[6] and own[12] == 2


def test_scores(spark):
    r = random.Random(2)
    a, b = ([f"{k}{i}" for i in range(30)] for k in "ab")
    rows = [(i, " ".join(x for _ in range(r.randrange(40)) for x in (r.choice(a), r.choice(b)))) for i in range(200)]
    df = docs(spark, [*rows, *ODD[:4], (None, "A0 B0")])
    got = {x["doc_id"]: x for x in brown.score_documents(df).collect()}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    every = {r["doc_id"]: [*(r["text"] or "").lower().encode().split(), None] for r in df.dropDuplicates(["doc_id"]).collect()}
    count = Counter(t for x in df.collect() if not held(x["doc_id"]) for t in [*(x["text"] or "").lower().encode().split(), None])
    n, v = sum(count.values()), len(count)
    for i, x in got.items():
        if i in (1, 2, 3, 4):
            continue  # two rows have these ids
        want = sum(log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in every[i])
        assert x["base_score"] == pytest.approx(want) and x["held_out"] == held(i) and x["n_tokens"] == len(every[i]) and x["train_tokens"] == n
        assert x["n_known"] == sum(count[t] > 0 for t in every[i])
    out = [x for x in got.values() if x["held_out"]]
    assert sum(x["score"] for x in out) > sum(x["base_score"] for x in out)
    assert brown.score_documents(df.limit(0)).count() == 0


def test_scores_by_hand(spark):
    """Every token of every text by its own class and the classes around it, with few words at each of the three stages of clustering."""
    r = random.Random(12)
    rows = [(i, " ".join(f"{'ab'[k % 2]}{int(r.paretovariate(0.7)) % 90}" for k in range(r.randrange(60)))) for i in range(150)] + [*ODD[:4], (None, "a1 b2 never seen")]
    df = docs(spark, rows)
    coded, m, others = brown.fitted(df, head=40, swept=20, core=8)
    assert coded.count() == len(rows)
    # all classes together: what follows a class sums to one, and so do the words of a class and what it leaves to unknown ones
    assert np.allclose((10 ** m.log_transition[:, : brown.CLASSES]).sum(1), 1)
    known = {int(w): (int(c), int(n)) for w, c, n in zip(m.head.words.view(np.int64), m.classes, m.head.counts)}
    known |= {x["word"]: (x["class"], x["n"]) for x in others.collect()}
    known[int(brown.END)] = (brown.CLASSES - 1, m.head.ends)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    hashes = {i: brown.tokens(Texts(pa.array([t], pa.string())))[0].view(np.int64).tolist() for i, t in enumerate(x[1] for x in rows)}
    counts = Counter(h for i, (d, *_) in enumerate(rows) if not held(d) for h in hashes[i])
    assert {h: n for h, (_, n) in known.items()} == dict(counts)
    for c in range(brown.CLASSES):
        own = [n for k, n in known.values() if k == c]
        assert sum(n + 0.5 for n in own) + 0.5 == pytest.approx(10 ** m.log_mass[c])
    want = []
    for i, (d, *_) in enumerate(rows):
        before, score = brown.CLASSES - 1, 0.0
        for h in hashes[i]:
            c, n = known.get(h, (brown.NONE, 0))
            score += m.log_transition[before, c] + (log10(n + 0.5) - m.log_mass[c] if c != brown.NONE else 0)
            before = c
        want.append((str(d), len(hashes[i]), score))
    got = brown.score_documents(df.selectExpr("*", "1 AS row", "2 AS places", "3 AS word"), head=40, swept=20, core=8).collect()
    for x, (d, n, score) in zip(sorted((str(x["doc_id"]), x["n_tokens"], x["score"]) for x in got), sorted(want), strict=True):
        assert x[:2] == (d, n) and x[2] == pytest.approx(score, abs=1e-6 * n)


def test_moves_are_those_of_plain_likelihood():
    r = np.random.default_rng(5)
    table = r.integers(0, 60, (brown.CLASSES, brown.CLASSES)).astype(float)
    left, right = r.integers(0, 9, (2, 3, brown.CLASSES)).astype(float)
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    got = brown.best_moves(left, right, np.full(3, brown.NONE), table)
    for k in range(3):
        likelihood = []
        for c in range(brown.CLASSES - 1):
            t = table.copy()
            t[:, c] += left[k]
            t[c] += right[k]
            likelihood.append(f(t) - f(t.sum(0)) - f(t.sum(1)))
        assert got[k] == np.argmax(likelihood)


def test_more_ties_than_the_head_holds(spark):
    df = docs(spark, [(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(20)])
    out = brown.score_documents(df, head=100, swept=50, core=10).collect()
    assert len(out) == 20 and all(np.isfinite(x["score"]) for x in out) and len({x["train_tokens"] for x in out}) == 1


# ---- near-duplicates ----


def brute_classes(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    text = dict(rows)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if text[a] == text[b] or both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def test_near_duplicates(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(330):
        w = list(base)
        for _ in range(r.choice([1, 3, 5, 8])):
            w[r.randrange(120)] = f"m{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(400 + i, " ".join(f"x{r.randrange(10**6)}" for _ in range(40))) for i in range(20)]
    rows += [(500, "one two"), (501, "ONE two"), (502, "one two three"), (503, rows[340][1]), (504, None), (505, ""), (506, LONG), (507, LONG + " tail")]
    got = {x["doc_id"]: x["class_id"] for x in minhash.classes(docs(spark, rows)).collect()}
    want = brute_classes([x for x in rows if x[0] < 506])
    assert {i: got[i] for i in want} == {**want, 505: 504} and got[507] == 506
    kept = sorted(x["doc_id"] for x in minhash.distinct_documents(docs(spark, rows)).collect())
    assert kept == sorted({*got.values()})


def test_near_duplicates_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (6, "A B c d e f")]
    df = docs(spark, rows).selectExpr("*", "1 AS class_id", "2 AS key")
    got = sorted((str(x["doc_id"]), str(x["class_id"])) for x in minhash.classes(df).collect())
    assert got == [("5", "5"), ("5", "5"), ("6", "5"), ("None", "5"), ("None", "None")]
    kept = minhash.distinct_documents(df)
    assert kept.columns == df.columns and sorted(str(x["doc_id"]) for x in kept.collect()) == ["5", "None", "None"]
    assert minhash.classes(df.limit(0)).count() == 0 == minhash.distinct_documents(df.limit(0)).count()


def test_pairs_with_repetition_are_verified_where_they_share_a_bucket():
    shared = found = low = 0
    for seed in range(60):
        r = np.random.default_rng(seed)
        element = mix64(r.integers(0, 2**62, 200).astype(np.uint64))
        weight = np.where(np.arange(200) < 60, 1 + np.log(40), 1.0)  # one text repeats 30% of its shingles 40 times
        pair = [minhash.signatures(element, np.zeros(200, np.int64), w, 1) for w in (np.ones(200), weight)]
        same = np.flatnonzero((minhash.bands(pair[0]) == minhash.bands(pair[1]))[0])
        prints = np.unique(element.astype(np.uint32)).tobytes()
        if len(same):
            shared += 1
            low += (pair[0] == pair[1]).mean() < 0.66
            rows = {"block": [0, 0], "label": [1, 2], "node": [1, 2], "signature": [x.astype(np.uint16).tobytes() for x in pair], "prints": [prints] * 2}
            found += any(minhash.group_links(int(b), 0, 0, rows, 0.8) for b in same)
    assert found == shared >= 45 and low > 10


def test_signatures_estimate_probability_jaccard():
    r = np.random.default_rng(4)
    shared, own = r.integers(1, 2**63, 300).astype(np.uint64), r.integers(1, 2**63, (2, 100)).astype(np.uint64)
    w = np.ones(400)
    w[:50] = 4.0
    element = np.concatenate([shared, own[0], shared, own[1]])
    s = minhash.signatures(element, np.repeat([0, 1], 400), np.tile(w, 2), 2, 4000)
    want = sum(min(1.0, 1.0) * x / (w.sum() + 100) for x in w[:300])
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_components(spark):
    links = [(1, 2), (3, 2), (3, 4), (9, 8), (8, 9), (7, 7), *[(100, 100 + i) for i in range(1, 50)], *[(i, i + 1) for i in range(200, 230)]]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[2] == got[3] == got[4] == 1 and got[9] == 8 and got[149] == 100 and got[230] == 200 and 7 not in got


# ---- decontamination ----


def brute_hits(doc, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    d, hit, ids = low(doc), set(), set()
    for i, t in items:
        w = low(t)
        for k in range(max(len(w) - size, 0) + 1 if w else 0):
            win = w[k : k + size]
            for p in range(len(d) - len(win) + 1):
                if d[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    if i is not None:
                        ids.add(str(i))
    return len(d), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("broadcast", [True, False])
def test_leaks(spark, monkeypatch, broadcast):
    r = random.Random(5)
    some = lambda n: " ".join(r.choice("the of and to in is it on".split()) if r.random() < 0.5 else f"t{r.randrange(60)}" for _ in range(n))
    items = [(i, some(r.choice([1, 3, 9, 10, 14, 30]))) for i in range(25)] + [(3, None), (None, "null item words"), (77, "..."), (78, "same words"), (79, "same words")]
    rows = []
    for i in range(60):
        put = r.choice([t for _, t in items if t])
        rows.append((i, f"{some(40)}, {put.upper()}! {some(30)}" if i % 2 else some(60)))
    rows += [(90, None), (91, ""), (92, "NULL item—words same\nwords"), (93, "x"), (93, "x"), (None, "same words"), (94, "t1 the and " * 66_000 + "same words " + "of " * 2000)]
    if not broadcast:
        monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    items_df = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(docs(spark, rows).selectExpr("*", "'n' AS n_hit", "'w' AS w"), items_df).collect()
    assert len(out) == len(rows)
    for x in out:
        if x["doc_id"] == 94:
            assert x["n_words"] == 200_002 and x["n_hit"] >= 2 and x["contaminated"]
            continue
        assert (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) == brute_hits(x["text"], items)
    clean = decontaminate.clean_documents(docs(spark, rows), items_df)
    assert sorted(str(x["doc_id"]) for x in clean.collect()) == sorted(str(x["doc_id"]) for x in out if not x["contaminated"])
    assert decontaminate.decontaminate(docs(spark, rows), items_df.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs(spark, []).limit(0), items_df).count() == 0


# ---- personal data ----

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_base_spans_equal_the_patterns():
    r = random.Random(6)
    bits = ["a@b.c", "@", "..", "x", " ", "1", "22", "333", ".", "-", "+1", "(", ")", "4111 1111 1111 1111", "4111111111111111", "10.0.0.1", "é", "@@", "a.b-c", "\n"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(12)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_base_spans_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 50_000, "a@" * 50_000, "1 " * 100_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train(docs(spark, []).limit(0))


def test_tagger_finds_what_patterns_miss(tagger):
    needed, right, wrong = Counter(), Counter(), 0
    for text, spans in pii.made_lines(600, seed=99):
        base = pii.base_spans(text)
        gold = [s for s in spans if not any(s[1] < e and b < s[2] for _, b, e in base)]
        added = pii.added_spans(text, base, tagger)
        assert not any(s[1] < e and b < s[2] for s in added for _, b, e in base)
        needed.update(k for k, _, _ in gold)
        right.update(k for k, _, _ in set(gold) & set(added))
        wrong += len(set(added) - set(spans))
    assert right.total() >= 0.8 * needed.total() and right.total() >= 0.95 * (right.total() + wrong)
    assert all(right[k] > 0.4 * needed[k] for k in pii.TAGGED)


def test_added_spans_do_not_depend_on_windows(tagger):
    key = "d2095ee747b5508359b0a644b60d684db3153e93d2095ee747b5508359b0a644"
    for pad in range(0, 200, 7):  # wherever windows begin, and the span is as long as their own part
        text = "so it is and " * 12 + "x" * pad + f' token = "{key}" today' + "and that is it" * 12
        assert [text[s:e] for _, s, e in pii.added_spans(text, [], tagger)] == [key]
    assert not pii.added_spans("a clean text with no numbers at all", [], tagger) and not pii.added_spans("", [], tagger)


def test_personal_data(spark, tagger):
    rows = [
        (1, None), (2, ""), (3, "x " * 30_000 + "call +1 (168) 555-5254 or mail a.b@c.example"), (4, "é 10.0.0.1"), (4, "é 10.0.0.1"), (None, "mail a@b.org"),
        (5, "mail jane.doe at mail dot example dot org today"), (6, 'so token = "d2095ee747b5508359b0a644b60d684db3153e93" it is'),
    ]
    df = docs(spark, rows).selectExpr("*", "1 AS spans", "2 AS n_email", "3 AS flagged")
    out = sorted(pii.find_personal_data(df, tagger).collect(), key=lambda x: (x["doc_id"] is None, x["doc_id"]))
    for x, (i, text) in zip(out, sorted(rows, key=lambda r: (r[0] is None, r[0]))):
        base = plain_spans(text or "")
        assert x["doc_id"] == i and x["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest() and {*pii.joined(base).split(",")} <= {*x["spans"].split(","), ""}
        assert [x[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
    by = {x["doc_id"]: x for x in out}
    assert by[5]["n_added"] == 1 and by[5]["spans"].startswith("email:") and by[5]["spans"].endswith(":41") and by[6]["n_secrets"] == 1 and by[6]["flagged"] and not by[2]["flagged"]
    assert pii.find_personal_data(docs(spark, []).limit(0), tagger).count() == 0


def test_tagger_gradients():
    ids, tags = (np.array(x) for x in zip(*[pii.tag_line(*line) for line in pii.made_lines(3)]))
    t = pii.Tagger()
    g, _ = t.gradients(ids, tags)
    for k, grad in g.items():
        at, e = np.unravel_index(np.abs(grad).argmax(), grad.shape), np.float32(1e-2)
        t.p[k][at] += e
        high = t.gradients(ids, tags)[1]
        t.p[k][at] -= 2 * e
        low = t.gradients(ids, tags)[1]
        t.p[k][at] += e
        assert (high - low) / (2 * e) == pytest.approx(grad[at], rel=0.02)


# ---- token files ----


def test_encoder_equals_the_library():
    encoder = tokens.Encoder(queries.byte_bpe())
    r = random.Random(7)
    bits = [*"abcst'rvelmd  \n\n\t.,!?0123é ñß×÷—\x01AB", "'s", "'re", "'ll", " '", "<|endoftext|>", "日本"]
    texts = ["".join(r.choice(bits[: 30 if i % 3 else None]) for _ in range(r.randrange(40))) for i in range(1500)] + ["", None, "  ", "'s", LONG]
    ids, sizes = encoder.encode(pa.array(texts), 2)
    at = np.concatenate(([0], np.cumsum(sizes)))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == [*encoder.library.encode(t or "", add_special_tokens=False).ids, 2]


def test_token_files(spark):
    rows = [(9, "last one"), (3, "first text"), (4, None), (5, LONG), (5, LONG), (6, ""), (None, "no id")]
    folder = as_uri(scratch_path(spark, "tokens"))
    index = tokens.write_tokens(docs(spark, rows), queries.byte_bpe(), 2, folder, length=64)
    got = tokens.read_back(index, folder).collect()
    library, start = tokens.encoder(queries.byte_bpe()).library, 0
    for x, (i, text) in zip(sorted(got, key=lambda x: x["start"]), sorted(rows, key=lambda r: (r[0] is not None, r[0]))):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (x["doc_id"], x["start"], x["n_tokens"], x["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    name = index.first()["file"]
    reader = tokens.SequenceReader(folder, name)
    ids, mask = reader.sequence(0)
    assert len(ids) == len(mask) == 64 and ids.dtype == np.uint16 and not ids.flags.owndata
    reader.close()
    assert tokens.tokenize(spark, docs(spark, []).limit(0), queries.byte_bpe()).count() == 0


# ---- quality ----


def plain_features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    hit = {k + j for k, w in enumerate(wins) if wins.count(w) > 1 for j in range(5)} if len(wins) < 2000 else None
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, None if hit is None else len(hit)


def test_quality_features(spark):
    r = random.Random(8)
    some = ["a b c d e", "é ü #", "x|y", "", " ", "a b c d e f", "same line"]
    rows = [(i, "\n".join(r.choice(some) for _ in range(r.randrange(9)))) for i in range(60)] + [(100, None), (101, ""), (102, "\n \n"), (103, LONG), (104, "a b c d e a b c d e a b c d e")]
    out = quality.judge(docs(spark, rows).selectExpr("*", "1 AS kept"), ["doc_id", "text", "kept"]).collect()
    assert len(out) == len(rows)
    for x in out:
        want = plain_features(x["text"])
        got = (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"])
        assert got[:4] == want[:4] and want[4] in (None, got[4])
        assert x["base_failed"] == (got[0] < 10 or 100 * got[4] > 20 * got[0]) and not (x["base_failed"] and x["kept"])
    assert quality.judge(docs(spark, []).limit(0), ["doc_id"]).count() == 0
    clash = docs(spark, rows).selectExpr("*", "'x' AS kept", "'y' AS n_words")
    kept = quality.kept_documents(clash)
    assert kept.columns == clash.columns and kept.where("kept <> 'x' or n_words <> 'y'").count() == 0


def test_kneser_ney():
    texts = Texts(pa.array(["abracadabra abacus", "cab scab", None, "a"]))
    keys, counts = np.unique(quality.ngrams(texts), return_counts=True)
    m = quality.KneserNey(keys, counts)
    for context in [0, *(keys >> quality.BITS)[:20].tolist(), 12345]:
        assert m.probabilities((context << quality.BITS) + np.arange(quality.SYMBOLS)).sum() == pytest.approx(1)
    # one context by hand: interpolated with the lower order
    assert all(len(k) == len(p) and (np.diff(k) > 0).all() for k, p in m.prob)


def test_symbols_are_whole_code_points():
    got, first = quality.symbols(Texts(pa.array(["aZ", None, "éЖ日😀", "\x00"])))
    assert got.tolist() == [97, 122, ord("é"), ord("ж"), ord("日"), 0xD83D, 0xDE00, 0xFFFF] and first.tolist() == [0, 2, 2, 7, 8]


def test_models_of_halves(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["das", "Haus", "日本", "в", "лес", "😀"]) for _ in range(12))) for i in range(30)]
    df = docs(spark, rows)
    model = quality.train(df).collect()
    half = {x["doc_id"]: int(x["lang_half"][0]) for x in quality._grouped(df, ["doc_id"]).collect()}
    plain = []
    for h in (0, 1):
        keys, counts = np.unique(quality.ngrams(Texts(pa.array([t for i, t in rows if half[i] == h]))), return_counts=True)
        plain.append(quality.KneserNey(keys, counts))
        every = np.array([x["ngram"] for x in model])
        assert np.allclose([x[f"log{h}"] for x in model], np.log(plain[h].probabilities(every)))
    want = {i: -np.log(plain[1 - half[i]].probabilities(quality.ngrams(Texts(pa.array([t]))))).sum() / 12 for i, t in rows}
    for head in (quality.HEAD, 20, 0):  # with all, some and no n-grams in the head
        monkeypatch.setattr(quality, "HEAD", head)
        assert {x["doc_id"]: pytest.approx(x["log_ppl"]) for x in quality.judge(df, ["doc_id"]).collect()} == want


def test_junk_in_any_letters_is_rejected(spark):
    r = random.Random(11)
    stems = ["".join(r.choice(["ba", "le", "tin", "so", "mer", "ka", "on", "dri"]) for _ in range(r.randrange(1, 4))) for _ in range(300)]
    cyrillic = ["".join(r.choice(["ба", "ле", "тин", "со", "мер", "ка"]) for _ in range(r.randrange(1, 4))) for _ in range(300)]
    good = [(i, " ".join(r.choice(cyrillic if i % 4 == 0 else stems) for _ in range(r.randrange(40, 200)))) for i in range(400)]
    salad = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randrange(3, 9))) for _ in range(n))
    kinds = ["BCDFGHJKLMNPQRSTVWXZ", "bcdfghjklmnpqrstvwxz", "бвгджзклмнпрстфхцчшщ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", [chr(c) for c in range(0x4E00, 0x5E00)]]
    bad = [(1000 + i, salad(kinds[i % 5], r.randrange(12, 120))) for i in range(40)]
    kept = {x["doc_id"] for x in quality.judge(docs(spark, good + bad), ["doc_id"]).where("kept").select("doc_id").collect()}
    assert not kept & {i for i, _ in bad} and len(kept) >= 380


# ---- licenses ----


def test_license_scan(spark):
    filler = " ".join(f"word{i % 50}" for i in range(3000))
    rows = [
        (1, filler + "\nLicensed under the Apache License, Version 2.0.\n" + filler), (2, "Released under the MIT License."), (3, "RELEASED under   the\nMIT license. Released under the MIT License."),
        (4, "Licensed under CC BY-NC 4.0."), (5, "Licensed under CC BY 4.0"), (6, None), (7, ""), (8, filler), (9, "the license is released. MIT is a school under water"), (10, "This work is licensed under the GNU General Public License, version 3."), (10, "x"),
        (11, "Licensed under the Apache software License, Version 2.0"), (12, LONG),
    ]
    got = {(x["doc_id"], x["license"]) for x in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got == {(1, "apache-2.0"), (2, "mit"), (3, "mit"), (4, "cc-by-nc-4.0"), (5, "cc-by-4.0"), (6, None), (7, None), (8, None), (9, None), (10, "gpl-3.0"), (10, None), (11, "apache-2.0"), (12, None)}
    assert licenses.scan_licenses(docs(spark, []).limit(0)).count() == 0


def test_doubled_notices():
    scanner = licenses.Scanner(licenses.NOTICES)
    filler = [" ".join(f"{c}{i}" for i in range(40)) for c in "ab"]
    for name, line in [("mit", "Released under the MIT License."), ("apache-2.0", "Licensed under the Apache License, Version 2.0"), ("apache-2.0", "Licensed under the Apache software License, Version 2.0")]:
        for times in (1, 2, 3):
            words = licenses.notice_words("\n".join([filler[0], *[line] * times, filler[1]]))
            best = scanner.best(words)
            assert best[0] == name and best[1] == 1 and best[4] - best[3] == len(licenses.notice_words(line))


def test_what_tells_licenses_apart():
    scanner = licenses.Scanner(licenses.NOTICES)
    lines = {
        "Released under the BSD License": "bsd", "Released under the GPL License": "gpl", "Released under the ISC License": "isc", "it was released under the label license": None, "Licensed under CC BY 3.0": "cc-by-3.0",
        "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa-4.0", "licensed under the GNU Lesser General Public License, version 2.1": "lgpl-2.1", "licensed under the GNU Lesser General Public License, version 3": "lgpl-3.0",
        "licensed under the GNU Affero General Public License, version 3": "agpl-3.0", "licensed under the GNU General Public License, version 2": "gpl-2.0", "SPDX-License-Identifier: MPL-2.0": "mpl-2.0",
        "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: MIT-0": "mit-0", "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007": "gpl-3.0", "Licensed under the Apache License, Version 1.1": "apache-1.1",
    }
    for line, want in lines.items():
        best = scanner.best(licenses.notice_words(f"some words before it. {line}. and some after"))
        assert (best and best[0]) == want, (line, best)


def test_all_licenses_of_a_text(spark):
    filler = " ".join(f"word{i % 50}" for i in range(400))
    text = "\n".join(["Released under the MIT License.", filler, "Licensed under the Apache License, Version 2.0", filler, "Released under the MIT License.", "Licensed under CC BY 4.0"])
    one, other = licenses.scan_licenses(docs(spark, [(1, text), (2, filler)])).orderBy("doc_id").collect()
    assert [(x["license"], x["first_word"], x["end_word"]) for x in one["matches"]] == [("mit", 0, 5), ("apache-2.0", 405, 413), ("mit", 813, 818), ("cc-by-4.0", 818, 824)]
    assert (one["license"], one["first_word"], one["end_word"]) == ("apache-2.0", 405, 413) and other["license"] is None and other["matches"] == []


def test_patience():
    assert licenses.increasing([(0, 3), (1, 1), (2, 2), (3, 5), (4, 4)]) in ([(1, 1), (2, 2), (3, 5)], [(1, 1), (2, 2), (4, 4)])
    r = random.Random(9)
    for _ in range(300):
        a, b = ([r.randrange(8) for _ in range(r.randrange(12))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[k] for i, k in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(licenses.align([1, 2, 9, 3, 4], [1, 2, 3, 4])) == 4


# ---- columns with names of the operators' own ----

CLASHES = (
    "hit", "ids", "own_digest", "hit_id", "hit_digest", "digest", "n", "w", "middle", "spread", "band_lang", "lang_half", "host", "path", "rule", "verdict", "class_id", "key", "node", "size", "target", "row", "word",
    "places", "kept", "low", "high", "file", "first", "repeats", "_0", "_1", "own_0", "kept_0", "found", "bucket", "label", "spans", "count",
)


def test_clashing_columns(spark):
    base = docs(spark, [*ODD, *[(10 + i, f"some words of text number {i} go here and then go on a bit " * 3) for i in range(6)]])
    df = base.selectExpr("*", *[f"'x{c}' AS {c}" for c in CLASHES])
    items = spark.createDataFrame([(1, "text number 3 go here and then go on a bit some words")], "item_id long, text string")
    rows = df.count()
    for out in (decontaminate.decontaminate(df, items), mixing.mix(df), quality.judge(df, df.columns)):
        plain = [c for c in passed_through(out) if c in CLASHES]
        assert len(set(out.columns)) == len(out.columns) and out.count() == rows and all(out.where(f"`{c}` <> 'x{c}'").isEmpty() for c in plain)
    for out in (decontaminate.clean_documents(df, items), quality.kept_documents(df), minhash.distinct_documents(df), mixing.mixed_documents(df)):
        assert out.columns == df.columns and all(out.where(f"`{c}` <> 'x{c}'").isEmpty() for c in CLASHES[:6])
    for out in (minhash.classes(df), brown.score_documents(df), licenses.scan_licenses(df)):
        assert out.count() == rows
    judged = urls.judge(df.withColumn("url", F.lit("http://a.net/x")), urls.train(urls.labelled_sample(base.withColumn("url", F.lit("http://a.net/x")))), keep=["doc_id", *CLASHES])
    assert len(set(judged.columns)) == len(judged.columns) and judged.count() == rows and judged.first()["host"] == "a.net"


def passed_through(out):
    added = {*decontaminate.ADDED, *mixing.ADDED, *quality.ADDED}
    return [c for c in out.columns if c not in added]


# ---- licenses: patience against a plain version ----


def plain_patience(a, b):
    """Patience alignment as it is told: common ends, words unique in both, longest increasing subsequence by trying all (of equals the one whose ends come last), gaps in turn."""
    out, lo, hi = [], 0, 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        out.append((lo, lo))
        lo += 1
    while hi < min(len(a), len(b)) - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
        out.append((len(a) - hi, len(b) - hi))
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    unique = [(i, y.index(w)) for i, w in enumerate(x) if x.count(w) == 1 and y.count(w) == 1]
    best = [[] for _ in unique]
    for k, (i, j) in enumerate(unique):
        best[k] = max((best[m] for m in reversed(range(k)) if unique[m][1] < j), key=len, default=[]) + [(i, j)]
    anchors = max(reversed(best), key=len, default=[])
    if anchors:
        edges = [(-1, -1), *anchors, (len(x), len(y))]
        out += [(lo + i, lo + j) for i, j in anchors]
        for (i, j), (k, m) in zip(edges, edges[1:]):
            out += [(lo + i + 1 + p, lo + j + 1 + q) for p, q in plain_patience(x[i + 1 : k], y[j + 1 : m])]
    return sorted(out)


def test_patience_equals_a_plain_version():
    r = random.Random(21)
    for _ in range(400):
        words = range(r.choice([3, 8, 30]))
        a, b = ([r.choice(words) for _ in range(r.randrange(14))] for _ in range(2))
        if r.random() < 0.5:
            b = [w for w in a if r.random() < 0.8]
        got, want = licenses.align(a, b), plain_patience(a, b)
        assert got == want and all(a[i] == b[j] for i, j in got)


def test_license_lines_of_all_kinds():
    scanner = licenses.Scanner(licenses.NOTICES)
    text = " ".join(f"w{i}" for i in range(40))
    of = lambda line: (m := scanner.best(licenses.notice_words(f"{text}\n{line}\n{text}"))) and m[0]
    lines = {
        "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa-4.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
        "licensed under the GNU General Public License, version 1": None, "Released under the MIT License.\nReleased under the MIT License.": "mit", "it was released under the label license": None,
    }
    assert {k: of(k) for k in lines} == lines


# ---- URLs: rows one by one ----


def test_urls_are_scored_alike_in_any_batch(spark):
    r = random.Random(8)
    word = lambda kind: "".join(r.choice(kind) for _ in range(r.randrange(4, 9)))
    make = lambda bad: (f"{word('xzqkw' if bad else 'aeiorst')}.com", f"/{word('xzqkw' if bad else 'aeiorst')}/{r.randrange(99)}")
    rows = [(*make(k % 2), k % 2) for k in range(600)]
    columns = lambda some: (pa.array([h for h, *_ in some], pa.string()), pa.array([p for _, p, _ in some], pa.string()))
    model = urls.UrlModel.train(*columns(rows[:400]), np.array([b for *_, b in rows[:400]]))
    p = model.score(*columns(rows))
    assert ((p[400:] >= 0.5) == np.array([b for *_, b in rows[400:]])).mean() > 0.97
    odd = [("", "", 0), ("a", "", 0), ("", "/" + "x" * 100_000, 0), ("é.fr", "/ß", 0), *rows[:5], *rows[:5]]
    whole = model.score(*columns(odd))
    assert np.allclose(whole, [float(model.score(*columns([x]))[0]) for x in odd]) and np.allclose(whole[-10:-5], whole[-5:])
    # a weight moves exactly the n-grams of its bucket
    buckets, owner = urls.ngram_buckets(*columns(odd[:2]))
    assert len(buckets) == len(owner) and set(owner.tolist()) <= {0, 1} and (owner == 1).sum() == 1  # framed, "a" has one n-gram of three bytes
