"""Spans are found wherever they are plausible: against decoding every window."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from curvemill.llm import pii


class Fixed:
    """Tags every character but line breaks and semicolons as inside one kind."""

    def __init__(self, kind):
        self.tag = 2 + 2 * pii.TAGGED.index(kind)
        self.cuts = pii.symbols("\n;")

    def decode(self, ids):
        return np.where(np.isin(ids, [*self.cuts, pii.PAD]), 0, self.tag), np.zeros((*ids.shape, pii.TAGS), np.float32)

    def posterior(self, e, tags):
        return np.ones(tags.shape)


def test_addresses_spelled_with_at_and_a_dot_are_looked_at():
    text = "nothing here\n; jane at example.org ; " + "x " * 200
    assert ("email", 15, 34) in pii.added_spans(text, [], Fixed("email"))
    assert pii.added_spans("look at this\nand. that", [], Fixed("email")) == []
    assert pii.added_spans("jane AT example-dotcom", [], Fixed("email")) == [("email", 0, 22)]


def test_spans_go_on_beyond_the_windows_of_their_triggers():
    for before, after in ((900, 0), (0, 900), (700, 901), (63, 64), (64, 128)):
        text = "; " + "q" * before + "7" + "q" * after + "; no more"
        span = ("secret", 2, before + after + 3)
        if before + after >= 15:
            assert pii.added_spans(text, [], Fixed("secret")) == [span]


def test_a_trained_tagger_finds_what_decoding_every_window_finds(monkeypatch):
    tagger = pii.Tagger().fit(*(np.array(c) for c in zip(*(pii.tag_line(*x) for x in pii.made_lines(300)))), steps=60)
    lines = [x for x, _ in pii.made_lines(400, seed=9)]
    texts = ["\n".join(lines[i : i + 8]) for i in range(0, 400, 8)]
    some = [pii.added_spans(t, pii.base_spans(t), tagger) for t in texts]
    monkeypatch.setattr(pii, "triggers", lambda text, ids: np.arange(len(ids)))
    assert some == [pii.added_spans(t, pii.base_spans(t), tagger) for t in texts] and any(some)


class Counted(Fixed):
    """Counts its calls, too."""

    calls = 0

    def decode(self, ids):
        self.calls += 1
        return super().decode(ids)


def test_windows_of_many_texts_are_decoded_together():
    texts = [f"; key{k:04d}{'q' * (k % 150)} ; x" for k in range(500)]
    tagger = Counted("secret")
    batch = pa.record_batch([pa.array(range(500)), pa.array(texts)], names=["doc_id", "text"])
    rows = [r for out in pii._find(SimpleNamespace(value=tagger))(iter([batch])) for r in out.to_pylist()]
    assert tagger.calls < 60  # a call for each text before
    assert [r["doc_id"] for r in rows] == list(range(500))
    alone = [pii.added_spans(t, [], Fixed("secret")) for t in texts]
    assert [r["secrets"] for r in rows] == [pii.joined(x) for x in alone] and any(alone)


def test_texts_decoded_together_do_not_see_one_another(monkeypatch):
    tagger = pii.Tagger().fit(*(np.array(c) for c in zip(*(pii.tag_line(*x) for x in pii.made_lines(300)))), steps=60)
    lines = [x for x, _ in pii.made_lines(400, seed=9)]
    texts = ["", "7", "no", *("\n".join(lines[i : i + i % 9]) for i in range(0, 400, 8)), "q" * 63 + "7", "7" * 64, "7" * 65]
    known = [(t, pii.base_spans(t)) for t in texts]
    alone = [pii.added_spans(t, b, tagger) for t, b in known]
    assert list(pii.all_added_spans(known, tagger)) == alone and any(alone)
    monkeypatch.setattr(pii, "LAID", 700)
    assert list(pii.all_added_spans(known, tagger)) == alone
