"""Aligned tokens against brute force: groups by walking both token lists, links one by one, counts over the whole corpus."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from test_small_operators import LONG, ODD, docs
from test_transducer import random_texts
from tokenizers import Tokenizer

from curvemill.llm import alignment, queries
from curvemill.llm.transducer import byte_letters

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(queries.tokenizer(queries.TOKENIZER))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer(queries.PIECES))


def brute_groups(text, a, b):
    """[(A ids, B ids)] of a text, by the libraries alone; none if the bytes differ."""
    if not text:
        return []
    letters = {c: i for i, c in enumerate(byte_letters())}
    whole = (" " + text).encode()
    found = []
    for ids, spell in (
        (a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in a.id_to_token(i))),
        (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
    ):
        parts = [spell(i) for i in ids]
        if b"".join(parts) != whole:
            return []
        found.append((ids, np.cumsum([len(p) for p in parts]).tolist()))
    (a_ids, a_ends), (b_ids, b_ends) = found
    common, out, i, j = sorted(set(a_ends) & set(b_ends)), [], 0, 0
    for end in common:
        x, y = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
        out.append((a_ids[i:x], b_ids[j:y]))
        i, j = x, y
    return out


def brute(rows, libraries):
    groups = [brute_groups(t, *libraries) for _, t in rows]
    linked = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for c in linked for p in c)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), g, c in zip(rows, groups, linked):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        best = sum(n for p, n in c.items() if count[p] == most[p[0]])
        digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), best, sum(n * count[p] for p, n in c.items()), digest))
    return out


def corpus(r):
    rows = [(i, t) for i, t in enumerate(random_texts(r, 150))]
    rows += [(200 + i, " ".join(r.choice(["tion", "antidisestablishment", "naïve", "ab" * r.randrange(1, 30), "12345", "   ", "x\n\ny"]) for _ in range(r.randrange(1, 30)))) for i in range(60)]
    rows += [(300, "▁"), (301, "a▁b"), (302, " "), (303, "   lead and trail   "), (304, "<s>plain</s> <0x41> <unk>"), (305, "ab" * 3000), (306, "🙂" * 40), (307, "\x00"), (307, "same id"), (307, "same id")]
    return rows + [r[:2] for r in ODD]


def result(df):
    assert set(COLUMNS) <= set(df.columns)
    return sorted((tuple(x) for x in df.select(*COLUMNS).collect()), key=str)


def test_aligned_texts(libraries):
    r = random.Random(1)
    both = alignment.sides(queries.tokenizer(queries.TOKENIZER), queries.tokenizer(queries.PIECES))
    texts = [t for _, t in corpus(r)]
    (n_a, n_b, n_groups, n_links, first, pair, times), sums = alignment.align(pa.array(texts, pa.string()), *both)
    for k, t in enumerate(texts):
        g = brute_groups(t, *libraries)
        links = Counter(x * len(libraries[1]) + y for a, b in g for x in a for y in b)
        assert (n_a[k], n_b[k], n_groups[k], n_links[k]) == (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links.values())), t
        own = slice(first[k], first[k + 1])
        assert dict(zip(pair[own].tolist(), times[own].tolist())) == links and (sums[k] == "") == (not g)


def test_stabbing():
    a, b = np.array([2, 3, 7, 9, 10]), np.array([1, 3, 4, 9, 10])
    assert [x.tolist() for x in alignment.group_ends(a, b)] == [[1, 3, 4], [1, 3, 4]]
    assert [len(x) for x in alignment.group_ends(a[:0], b[:0])] == [0, 0]


def test_long_groups():
    """Groups beyond the limit are counted by their distinct ids: as one by one."""
    r = np.random.default_rng(2)
    a, b = r.integers(0, 5, 60), r.integers(0, 4, 90)
    want = Counter((int(x), int(y)) for x in a[:40] for y in b[:70]) + Counter((int(x), int(y)) for x in a[40:] for y in b[70:])
    where, pair, times = alignment.links(a, b, np.array([39, 59]), np.array([69, 89]), np.array([3, 3]), 100)
    assert set(where.tolist()) == {3} and {divmod(int(p), 100): int(n) for p, n in zip(pair, times)} == want


@pytest.mark.parametrize("head", [alignment.HEAD, 40, 0])
def test_corpus(spark, libraries, head):
    rows = corpus(random.Random(2))
    both = queries.tokenizer(queries.TOKENIZER), queries.tokenizer(queries.PIECES)
    assert result(alignment.align_corpus(docs(spark, rows), *both, head)) == sorted(brute(rows, libraries), key=str)


def test_query_and_defined_cases(spark, libraries, tmp_path):
    rows = [(1, LONG[:3000]), (2, None), (2, ""), (None, "no id"), (5, "repeated"), (5, "repeated"), (6, "a▁b")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op12_token_alignment"](spark, str(tmp_path))
    want = brute(rows, libraries)
    assert result(got) == sorted(want, key=str) and got.columns == COLUMNS
    assert [w[1:] for w in want if w[0] in (2, 6)] == [(0, 0, 0, 0, 0, 0, "")] * 3
    both = queries.tokenizer(queries.TOKENIZER), queries.tokenizer(queries.PIECES)
    assert result(alignment.align_corpus(docs(spark, []), *both)) == []
    clash = spark.createDataFrame([(1, "a b", 9, "x", [1])], "doc_id long, text string, n_a int, row string, pairs array<int>")
    assert result(alignment.align_corpus(clash, *both)) == brute([(1, "a b")], libraries)
