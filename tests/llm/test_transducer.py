"""The transducer against the tokenizers library, its lookahead against all texts over small merge lists, and decoding against the library."""

import hashlib
import itertools
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from test_small_operators import LONG, ODD, docs
from tokenizers import Tokenizer

from curvemill.llm import queries, transducer
from curvemill.llm.transducer import Decoder, Merges, Transducer, WordEncoder, byte_letters

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer_file(folder, merges, end=""):
    """A tokenizer file of bytes and the given merges."""
    vocabulary = {c: i for i, c in enumerate([c + e for e in dict.fromkeys(["", end]) for c in byte_letters()])}
    for a, b in merges:
        vocabulary.setdefault(a + b, len(vocabulary))
    path = folder / "tokenizer.json"
    path.write_text(json.dumps({"model": {"type": "BPE", "end_of_word_suffix": end or None, "vocab": vocabulary, "merges": merges}, "decoder": {"type": "ByteLevel"}}))
    return str(path)


def random_merges(r, letters="abc", n=14):
    """Merges that each make a new token of known ones, in random order."""
    known, out = list(letters), []
    while len(out) < n:
        a, b = r.choice(known), r.choice(known)
        if a + b not in known and len(a + b) <= 6:
            known.append(a + b)
            out.append((a, b))
    return out


def plain_bpe(text, merges):
    """One merge at a time: the pair of least rank, the leftmost of equals."""
    rank, out = {m: i for i, m in enumerate(merges)}, list(text)
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(out, out[1:])) if p in rank]
        if not found:
            return out
        _, i = min(found)
        out[i : i + 2] = [out[i] + out[i + 1]]


@pytest.mark.parametrize("seed", range(40))
def test_reach_holds_for_all_texts(tmp_path, seed):
    r = random.Random(seed)
    merges = random_merges(r, n=r.randrange(3, 22))
    known = Merges(tokenizer_file(tmp_path, merges))
    reach = int(known.chains().max())
    bounds = {}
    texts = ["".join(t) for n in range(1, 9) for t in itertools.product("abc", repeat=n)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    found, owner = known.join(known.inner[data], np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k, t in enumerate(texts):
        bounds[t] = np.concatenate(([0], np.cumsum(known.length[found[at[k] : at[k + 1]]]))).tolist()
    for t in r.sample(texts, 200):
        lengths = np.diff(bounds[t]).tolist()
        assert lengths == [len(x) for x in plain_bpe(t, merges)]
    for t in texts:
        mine = set(bounds[t])
        for n in range(1, len(t)):
            before = bounds[t[:n]]
            undone = [i for i, b in enumerate(reversed(before)) if b not in mine]
            assert not undone or undone[-1] < reach, (merges, t, n, reach)


def test_streams_equal_whole_texts(tmp_path):
    for seed in range(6):
        r = random.Random(seed)
        merges = random_merges(r, n=18)
        path = tokenizer_file(tmp_path, merges)
        t = Transducer(path)
        text = "".join(r.choice("abc") for _ in range(3000)) + "ab" * 800 + "a" * 1501 + "abcabc" * 300
        want = [len(x) for x in plain_bpe(text[:900], merges)]
        assert t.merges.length[np.concatenate(list(t.stream([text[:900].encode()])))].tolist() == want
        one, _ = t.tokens([text.encode()])
        for size in (1, 7, 100, 5000):
            got = np.concatenate(list(t.stream(text[i : i + size].encode() for i in range(0, len(text), size))))
            assert np.array_equal(got, one)
        whole, _ = t.merges.join(t.merges.inner[np.frombuffer(text.encode(), np.uint8)], np.zeros(len(text), np.int64))
        assert np.array_equal(whole, one)


def test_memory_is_constant():
    t = Transducer(queries.tokenizer(WORDS))
    held = []
    join = t.merges.join
    t.merges.join = lambda symbols, owner: (held.append(len(symbols)), join(symbols, owner))[1]
    tail = list(t.stream("anatomiedesgeistes"[i % 18].encode() for i in range(20_000)))
    assert max(held) <= t.window and len(tail) > 3 and sum(t.merges.length[np.concatenate(tail)]) == 20_000


def random_texts(r, n):
    parts = ["Hello", " world", "'s", "'RE", "'ll", " don't", "''s", "'", "''", "é", "ÀÉÜß", "Œuvre", "İ", "Σίσυφος", "ﬁ", "é", "日本", " 42", "007", "\n\n", "\t", "  ", "\x00", "\x0b", " ", " ",
             "!?", "...", "—", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|end", "¬", "×", "ÿŸ", "ƀ", "ǅ", "a" * 50, "the quick brown", "'sabc", "x'tve've", "</w>", "🙂", "👩‍🚀", "�", "Ａ"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("name", [WORDS])
def test_equal_to_the_library(name):
    r = random.Random(3)
    path = queries.tokenizer(name)
    library, mine, back = Tokenizer.from_file(path), WordEncoder(path), Decoder(path)
    long = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40_000)), "ab" * 20_000, "a" * 30_000, LONG[:50_000], "thisisalongwordwithoutanyspaces" * 900]
    texts = [None, "", *random_texts(r, 1500), *(x.upper() for x in random_texts(r, 300)), *long]
    for low in range(0, len(texts), 700):
        some = texts[low : low + 700]
        ids, count = mine.all_ids(pa.array(some, pa.string()))
        at = np.concatenate(([0], np.cumsum(count)))
        for k, (t, e) in enumerate(zip(some, library.encode_batch([t or "" for t in some], add_special_tokens=False))):
            own = ids[at[k] : at[k + 1]]
            assert own.tolist() == e.ids, t
            assert back.feed(own) + back.close() == library.decode(e.ids, skip_special_tokens=False)


def test_decoding_step_by_step():
    r = random.Random(4)
    for name in (WORDS, BYTES):
        path = queries.tokenizer(name)
        library, back = Tokenizer.from_file(path), Decoder(path)
        for _ in range(200):
            ids = np.array([r.randrange(50_257 if name == BYTES else 49_408) for _ in range(r.randrange(0, 40))], np.int64)
            want = library.decode(ids.tolist(), skip_special_tokens=False)
            cut = sorted(r.randrange(len(ids) + 1) for _ in range(3))
            got = "".join(back.feed(x) for x in np.split(ids, cut)) + back.close()
            assert got == want and back.feed(ids) + back.close() == want


def test_files_that_do_not_fit(tmp_path):
    with pytest.raises(ValueError):
        Merges(tokenizer_file(tmp_path, [("a", "b"), ("c", "ab"), ("ca", "b"), ("c", "a")]))
    with pytest.raises(ValueError):
        Merges(tokenizer_file(tmp_path, [("ab", "c"), ("a", "b")]))


def test_query(spark, tmp_path):
    rows = [*ODD, (50, "Wörter und <|endoftext|> mehr"), (51, "'s 'S don't"), (51, "'s 'S don't"), (52, "z" * 9000)]
    rows = [(r[0], r[1]) for r in rows]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    library = Tokenizer.from_file(queries.tokenizer(WORDS))
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = queries.QUERIES["op11_bpe_transducer"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    encoded = transducer.encode(docs(spark, rows), queries.tokenizer(WORDS), ids=True)
    texts = {(r["doc_id"], r["text"]) for r in transducer.decode(encoded, queries.tokenizer(WORDS)).collect()}
    assert texts == {(i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in rows}
    assert transducer.encode(docs(spark, []), queries.tokenizer(WORDS)).collect() == []
    clash = spark.createDataFrame([("k", "a b", 3, "x")], "doc_id string, text string, n_tokens int, ids string")
    assert [r["n_tokens"] for r in transducer.encode(clash, queries.tokenizer(WORDS)).collect()] == [2]
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [tuple(r) for r in transducer.decode(null, queries.tokenizer(WORDS)).collect()] == [(1, "")]
