"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

Base spans, leftmost and non-overlapping for each kind, by linear-time scans: email, ip, card (Luhn), phone. The method adds spans
of the same kinds that the patterns miss: phones without a country code, addresses spelled out or spaced ("jane at example dot org"), cards and
ip numbers with other separators. It also finds secrets (keys and tokens), which have columns of their own.

The tagger is trained in numpy on labelled windows: a bounded sample of the corpus (``SAMPLE`` windows around digits and @, those with the
smallest hashes, labelled by the base spans) and generated lines with labelled spans in forms the patterns do not
have, beside numbers that are no personal data. Training is seeded and gives the same model on every run.

Whole texts are tagged in overlapping windows of ``WINDOW`` characters, every ``STEP``. A plausible span holds a digit, an @, or the word at in a line with a dot (``triggers``), so windows with one of
these outside base spans are decoded, those of many texts together, and from there on those next to a tagged edge, as far as tags go on. That gives what decoding all windows would: what is left out has no tags that could be part of a plausible span. Each window is decoded by Viterbi. Of overlapping windows, each character has the tag of the one in
whose middle it lies, so it has seen at least (WINDOW - STEP) / 2 characters on both sides; the tags of a whole text together are read as spans, which may
so be longer than any window. A span is added if the posterior of its tags is ``CONFIDENT`` on average, if it is plausible (number of digits, Luhn sum, parts), and if it overlaps
no base span; of overlapping ones the surest goes first.

Defined cases: a null text is empty and has no spans; repeated rows are judged alike; an empty table gives no rows and trains on the generated
lines only. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm.textbuf import Texts, pieces

KINDS = ("email", "ip", "card", "phone")
#: What the tagger tells apart: it finds secrets too.
TAGGED = (*KINDS, "secret")
TAGS = 1 + 2 * len(TAGGED)  # outside, then begin and inside of each kind
WINDOW, STEP = 128, 64
EMBED, HIDDEN = 16, 32
#: Training: windows of the corpus, generated lines, length of both, steps, windows a step, and rate.
SAMPLE, MADE, LINE, STEPS, BATCH, RATE = 600, 6000, 64, 420, 64, 0.025
CONFIDENT = 0.7
#: Windows that are decoded at once; characters of texts, padding included, whose windows are gathered for it.
TOGETHER, LAID = 64, 1 << 20

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TRIGGER = np.isin(np.arange(256), list(b"0123456789@"))
_AT_BYTES = re.compile(rb"(?<![A-Za-z])[aA][tT](?![A-Za-z])")
_AT = re.compile(r"(?<![A-Za-z])[aA][tT](?![A-Za-z])")
_DOT = re.compile(r"\.|[dD][oO][tT]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = 2 * d if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All base spans by kind, then start."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:  # every @ follows at most one run of local characters
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group()) if m.end() - m.start() <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _alphabet() -> np.ndarray:
    """The symbol of each code point up to 127: letters without case, one for digits, each sign its own."""
    symbol = np.zeros(128, np.int64)
    symbol[48:58] = 1
    symbol[97:123] = symbol[65:91] = np.arange(2, 28)
    for k, c in enumerate(".@_%+-()[]{} \n:/,=\"'#<>"):
        symbol[ord(c)] = 28 + k
    return symbol


_SYMBOL = _alphabet()
SYMBOLS = int(_SYMBOL.max()) + 3  # two more: beyond ASCII, and outside the text
PAD = SYMBOLS - 1


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _SYMBOL[np.minimum(codes, 127)], SYMBOLS - 2)


class Tagger:
    """The network: embedding, an LSTM in each direction, a linear layer and CRF transitions."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        new = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": new(SYMBOLS, EMBED) * 2, "out": new(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": new(EMBED, 4 * HIDDEN), f"h{d}": new(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
        # a begin or inside tag of a kind may only be followed by the inside tag of the same kind
        self.allowed = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(TAGGED)):
            inside = 2 + 2 * k
            self.allowed[:, inside] = -1e4
            self.allowed[[inside - 1, inside], inside] = 0

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, tuple]:
        b, t, _ = x.shape
        n = HIDDEN
        half = np.repeat(np.array([0.5, 1], np.float32), [3 * n, n])  # sigmoid(x) is 0.5 * (1 + tanh(0.5 * x)), so one tanh does for all gates
        pre = np.ascontiguousarray(((x @ self.p[f"x{d}"] + self.p[f"b{d}"]) * half).swapaxes(0, 1))
        move = self.p[f"h{d}"] * half
        h = c = np.zeros((b, n), np.float32)
        hs, cs, gates = np.empty((t, b, n), np.float32), np.empty((t, b, n), np.float32), np.empty((t, b, 4 * n), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = np.matmul(h, move, out=gates[i])
            z += pre[i]
            np.tanh(z, out=z)
            z[:, : 3 * n] += 1
            z[:, : 3 * n] *= 0.5
            cs[i] = c = z[:, n : 2 * n] * c + z[:, :n] * z[:, 3 * n :]
            hs[i] = h = z[:, 2 * n : 3 * n] * np.tanh(c)
        return hs, (hs, cs, gates)

    def _run_back(self, d_hs: np.ndarray, kept: tuple, d: str) -> tuple[np.ndarray, np.ndarray]:
        """Slopes of what went into each gate, and the state before each step."""
        hs, cs, gates = kept
        t, b, n = hs.shape
        none = np.zeros((1, b, n), np.float32)
        before = np.concatenate((none, hs[:-1]) if d == "f" else (hs[1:], none))
        c_before = np.concatenate((none, cs[:-1]) if d == "f" else (cs[1:], none))
        tc = np.tanh(cs)
        i_, f_, o_, g_ = (gates[:, :, k * n : (k + 1) * n] for k in range(4))
        # slopes but for those of the cell and the state
        to_cell, per_i, per_f, per_g, per_o = o_ * (1 - tc * tc), g_ * i_ * (1 - i_), c_before * f_ * (1 - f_), i_ * (1 - g_ * g_), tc * o_ * (1 - o_)
        dz = np.empty_like(gates)
        next_h = next_c = none[0]
        back = np.ascontiguousarray(self.p[f"h{d}"].T)
        for i in range(t - 1, -1, -1) if d == "f" else range(t):
            d_h = d_hs[i] + next_h
            d_c = next_c + d_h * to_cell[i]
            dz[i, :, :n], dz[i, :, n : 2 * n], dz[i, :, 2 * n : 3 * n], dz[i, :, 3 * n :] = d_c * per_i[i], d_c * per_f[i], d_h * per_o[i], d_c * per_g[i]
            next_h, next_c = dz[i] @ back, d_c * f_[i]
        return dz, before

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.p["embed"][ids]
        f, kf = self._run(x, "f")
        b, kb = self._run(x, "b")
        h = np.concatenate((f, b), 2)
        return np.ascontiguousarray((h @ self.p["out"] + self.p["bias"]).swapaxes(0, 1)), (x, h, kf, kb)

    def _forward_backward(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors of the tags (b, t, k), posterior counts of the moves (k, k), those of the first tags, and log normalizers (b); each step is scaled to one."""
        b, t, k = e.shape
        top = e.max(2)
        likely = np.exp(e - top[:, :, None]).swapaxes(0, 1)
        move, start = np.exp(self.p["move"] + self.allowed), np.exp(self.p["start"] + self.allowed[0])
        alpha, rest, scale = np.empty_like(likely), np.empty_like(likely), np.empty((t, b, 1), np.float32)
        for i in range(t):
            now = (alpha[i - 1] @ move if i else start) * likely[i]
            scale[i] = now.sum(1, keepdims=True)
            alpha[i] = now / scale[i]
        beta = np.ones((b, k), np.float32)
        tag = np.empty_like(alpha)
        for i in range(t - 1, -1, -1):
            tag[i] = alpha[i] * beta
            rest[i] = likely[i] * beta / scale[i]
            beta = rest[i] @ move.T
        pair = (alpha[:-1].reshape(-1, k).T @ rest[1:].reshape(-1, k)) * move
        return tag.swapaxes(0, 1), pair, tag[0], np.log(scale[:, :, 0]).sum(0) + top.sum(1)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[dict, float]:
        e, (x, h, kf, kb) = self.emissions(ids)
        marginal, pair, first, z = self._forward_backward(e)
        move = self.p["move"] + self.allowed
        b, t = ids.shape
        gold = np.zeros(e.shape, np.float32)
        gold[np.arange(b)[:, None], np.arange(t)[None], tags] = 1
        seen = np.bincount((tags[:, :-1] * TAGS + tags[:, 1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        score = (e * gold).sum() + (move * seen).sum() + (self.p["start"] * gold[:, 0]).sum()
        scale = np.float32(1 / b)
        de = ((marginal - gold) * scale).swapaxes(0, 1).reshape(-1, TAGS)  # by step, as the states are
        g = {"move": (pair - seen) * scale, "start": (first - gold[:, 0]).sum(0) * scale, "out": h.reshape(-1, 2 * HIDDEN).T @ de, "bias": de.sum(0)}
        dh = (de @ self.p["out"].T).reshape(t, b, 2 * HIDDEN)
        steps = np.ascontiguousarray(x.swapaxes(0, 1)).reshape(-1, EMBED)
        dx = np.zeros_like(steps)
        for d, kept, part in (("f", kf, dh[:, :, :HIDDEN]), ("b", kb, dh[:, :, HIDDEN:])):
            dz, before = self._run_back(part, kept, d)
            dz = dz.reshape(-1, 4 * HIDDEN)
            g |= {f"x{d}": steps.T @ dz, f"h{d}": before.reshape(-1, HIDDEN).T @ dz, f"b{d}": dz.sum(0)}
            dx += dz @ self.p[f"x{d}"].T
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], ids.T.ravel(), dx)
        return g, float((z.sum() - score) / b)

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = 11) -> Tagger:
        """Adam over seeded batches; the rate grows over the first tenth of the steps and then falls to nothing."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            some = rng.integers(0, len(ids), BATCH)
            g, _ = self.gradients(ids[some], tags[some])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            rate = RATE * min(10 * step / steps, (1 + np.cos(np.pi * step / steps)) / 2)
            for k in self.p:
                grad = g[k] * np.float32(min(1, 5 / (norm + 1e-9)))
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.99 * s[k] + 0.01 * grad * grad
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of each window, and the emissions they follow from."""
        e, _ = self.emissions(ids)
        move = self.p["move"] + self.allowed
        b, t, _ = e.shape
        best, back = self.p["start"] + self.allowed[0] + e[:, 0], np.zeros((b, t, TAGS), np.int8)
        for i in range(1, t):
            step = best.T[:, :, None] + move[:, None]
            back[:, i] = step.argmax(0)
            best = step.max(0) + e[:, i]
        tags = np.empty((b, t), np.int64)
        tags[:, -1] = best.argmax(1)
        for i in range(t - 1, 0, -1):
            tags[:, i - 1] = back[np.arange(b), i, tags[:, i]]
        return tags, e

    def posterior(self, e: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """The probability of each tag, given the window."""
        return np.take_along_axis(self._forward_backward(e)[0], tags[:, :, None], 2)[:, :, 0]


def tag_line(text: str, spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of a window of text, padded or cut to LINE."""
    ids, tags = np.full(LINE, PAD), np.zeros(LINE, np.int64)
    own = symbols(text)[:LINE]
    ids[: len(own)] = own
    for kind, start, end in spans:
        tags[start:end] = 2 + 2 * TAGGED.index(kind)
        if start < LINE:
            tags[start] -= 1
    return ids, tags


def _with_luhn(digits: str) -> str:
    """Digits whose last is changed so that they pass Luhn."""
    return next(d for k in "0123456789" if luhn(d := digits[:-1] + k))


def made_lines(n: int = MADE, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Generated lines with labelled spans: forms of all kinds, and numbers and words that are none of them."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwzéäñß") for _ in range(r.randrange(1, 10)))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randrange(2, 9)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    mixed = lambda k, of: "".join(r.choice(of) for _ in range(k))
    hexa, base62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def one(kind: str) -> str:
        if kind == "email":
            user = r.choice([name(), f"{name()}.{name()}", f"{name()}{num(2)}", f"{name()}.{num(2)}", f"{name()}_{name()}"])
            hosts = [r.choice(["", "", "mail", name()]) + r.choice(["", num(1)]), name(), r.choice(["com", "org", "net", "example", "de", "fr", "io"])]
            hosts = [h for h in hosts if h]
            at, dot = r.choice([("@", "."), ("@", "."), (" @ ", "."), ("@", " . "), ("(@)", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), ("{at}", "{dot}")])
            return user + at + dot.join(hosts)
        if kind == "ip":
            return r.choice([".", ".", ".", " . ", "[.]", ". "]).join(str(r.randrange(256)) for _ in range(4))
        if kind == "card":
            digits = _with_luhn(num(r.choice([16, 16, 16, 15, 13])))
            sep = r.choice(["-", " ", "", ".", "/", "_", "  ", " - "])
            cut = [4, 6, 5] if len(digits) == 15 else [4] * 4
            parts, at = [], 0
            for k in cut:
                parts.append(digits[at : at + k])
                at += k
            return sep.join(x for x in parts if x)
        if kind == "secret":
            return r.choice([mixed(r.choice([32, 40, 40, 64]), hexa), mixed(40, hexa), "AKIA" + mixed(16, base62[:26] + "0123456789"), "sk_live_" + mixed(24, base62), "ghp_" + mixed(36, base62), mixed(40, base62)])
        a, b, c = num(3), num(3), num(4)
        return r.choice([
            f"+{num(1)} {a} {b} {c}", f"+{num(1)} ({a}) {b}-{c}", f"+{num(2)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(1)}-{a}-{b}-{c}", f"00{num(2)} {a} {b} {c}",
            f"0{num(3)} {num(6)}", f"0{num(3)}/{num(7)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"{a} {b} {c}",
        ])

    def none() -> str:
        return r.choice([
            num(r.randrange(1, 7)), f"{r.randrange(9)}.{r.randrange(99)}", f"20{num(2)}-0{r.randrange(1, 9)}-1{r.randrange(9)}", f"1{r.randrange(9)}.0{r.randrange(1, 9)}.20{num(2)}", f"v{r.randrange(9)}.{r.randrange(9)}.{r.randrange(9)}",
            f"{r.randrange(24)}:{num(2)}:{num(2)}", f"{num(3)},{num(3)},{num(3)}", f"${num(3)},{num(3)}", f"@{name()}", f"{num(1)}/{num(2)}", f"version {r.randrange(9)}.0.", num(r.randrange(20, 30)), f"{name()}{num(2)}",
            f"no. {num(5)}-{num(3)}", f"{num(4)}-{num(4)}", f"{name()} dot {name()}", f"at the dot {name()}", f"{num(3)} {num(3)}", f"{num(2)}, {num(2)}, {num(2)} and {num(2)}", f"{r.randrange(9)}.{r.randrange(9)}.{r.randrange(9)}", f"pp. {num(3)}-{num(3)}",
        ])

    harder = (*TAGGED, "phone", "phone", "card", "email")  # what takes more lines to learn
    lines = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randrange(0, 5))), []
        for _ in range(r.choice([1, 1, 2])):
            text += r.choice([" ", "\n", " "]) if text else ""
            if r.random() < 0.6:
                kind = r.choice(harder)
                piece, lead, tail = one(kind), "", ""
                if kind == "secret":
                    quote = r.choice(['"', '"', "'", ""])
                    lead, tail = r.choice(["token", "key", "secret", "api_key", "password"]) + r.choice([" = ", "=", ": "]) + quote, quote
                elif r.random() < 0.2:
                    lead = r.choice([f"{name()}: ", "tel. ", "(", "<", '"'])
                text += lead
                spans.append((kind, len(text), len(text) + len(piece)))
                text += piece + tail
            else:
                text += none()
            text += r.choice(["", "", ".", ",", "!!", "***", ")"]) + " " + " ".join(word() for _ in range(r.randrange(0, 5)))
        if r.random() < 0.15:
            text = text.upper() if len(text.upper()) == len(text) else text
        cut = min([r.randrange(0, 12), *(s for _, s, _ in spans)])
        lines.append((text[cut:], [(k, s - cut, e - cut) for k, s, e in spans]))
    return lines


def plausible(kind: str, text: str) -> bool:
    digits = re.sub("[^0-9]", "", text)
    if "\n" in text:
        return False
    if kind == "email":
        low = text.lower()
        return ("@" in text or re.search("[^a-z]at[^a-z]", low) is not None) and ("." in text or "dot" in low)
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return len(text) >= 16 and bool(digits) and re.search(r"\s", text) is None


def triggers(text: str, ids: np.ndarray) -> np.ndarray:
    """Places one of which lies in every plausible span: digits, @, and the word at in lines with a dot, in sign or letters."""
    places, line = [np.flatnonzero((ids == 1) | (ids == _SYMBOL[ord("@")]))], 0
    if _AT.search(text):
        for part in text.split("\n"):
            if _DOT.search(part):
                places.append(np.array([line + m.start() for m in _AT.finditer(part)], np.int64))
            line += len(part) + 1
    return np.concatenate(places).astype(np.int64)


def added_spans(text: str, base: list[Span], tagger: Tagger) -> list[Span]:
    """The spans that the tagger adds to the base spans of a whole text, secrets among them."""
    return next(all_added_spans([(text, base)], tagger))


def all_added_spans(texts: Iterable[tuple[str, list[Span]]], tagger: Tagger) -> Iterator[list[Span]]:
    """``added_spans`` of each of many texts with their base spans; their windows are decoded together, up to ``LAID`` characters or so at a time."""
    held: list[tuple[str, list[Span], np.ndarray, np.ndarray]] = []
    size = 0
    for text, base in texts:
        ids = symbols(text)
        free = np.ones(len(ids), bool)
        for _, start, end in base:
            free[start:end] = False
        found = triggers(text, ids)
        held.append((text, ids, free, found[free[found]]))  # added spans overlap no base span
        size += len(ids) + 2 * STEP
        if size >= LAID:
            yield from _added_together(held, tagger)
            held, size = [], 0
    yield from _added_together(held, tagger)


def _added_together(texts: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]], tagger: Tagger) -> list[list[Span]]:
    """The added spans of texts, given as text, symbols, what is free of base spans, and triggers."""
    some = [k for k, (_, _, _, found) in enumerate(texts) if len(found)]
    out: list[list[Span]] = [[] for _ in texts]
    if not some:
        return out
    # texts are laid out one after another in steps, with at least one step of padding behind each: no window sees two.
    # window k has characters k * STEP - margin on; the middle STEP of them are its own
    margin = (WINDOW - STEP) // 2
    steps = np.array([-(-len(texts[k][1]) // STEP) + 1 for k in some])
    first = np.concatenate(([0], np.cumsum(steps)))
    padded = np.full(int(first[-1]) * STEP + WINDOW, PAD)
    free = np.zeros(int(first[-1]) * STEP, bool)
    owner = np.repeat(np.arange(len(some)), steps)
    owner[first[1:] - 1] = -1
    for i, k in enumerate(some):
        _, ids, own, _ = texts[k]
        at = int(first[i]) * STEP
        padded[margin + at : margin + at + len(ids)] = ids
        free[at : at + len(ids)] = own
    tags, sure = np.zeros(len(free), np.int64), np.zeros(len(free))
    done = np.zeros(len(owner), bool)
    grid, reach = np.concatenate([first[i] + np.unique(texts[k][3] // STEP) for i, k in enumerate(some)]), 1
    while len(grid):
        done[grid] = True
        for i in range(0, len(grid), TOGETHER):
            part = grid[i : i + TOGETHER]
            # always as many windows: products of other shapes are rounded otherwise
            ids = np.full((TOGETHER, WINDOW), PAD)
            ids[: len(part)] = padded[part[:, None] * STEP + np.arange(WINDOW)]
            found, e = tagger.decode(ids)
            own = found[: len(part), margin : margin + STEP]
            place = part[:, None] * STEP + np.arange(STEP)
            tags[place] = own
            if ((own > 0) & free[place]).any():  # posteriors of what is in a base span are of no use
                sure[place] = tagger.posterior(e, found)[: len(part), margin : margin + STEP]
        start, last = grid * STEP, grid * STEP + STEP - 1
        left = grid[(tags[start] > 0) & (tags[start] % 2 == 0) & free[start]]  # a begin tag needs nothing before it
        right = grid[(tags[last] > 0) & free[last]]
        left, right = left[(left > 0) & ~done[left - 1]], right[~done[right + 1]]  # behind a text's last window there is one of padding
        further = np.arange(1, reach + 1)
        grid, by = np.concatenate(((left[:, None] - further).ravel(), (right[:, None] + further).ravel())), np.repeat(np.concatenate((owner[left], owner[right])), reach)
        inside = (grid >= 0) & (grid < len(done))
        grid, by = grid[inside], by[inside]
        grid = np.unique(grid[(owner[grid] == by) & ~done[grid]])
        reach *= 2
    tags = np.where(free, tags, 0)
    tagged = np.concatenate(([0], np.cumsum(tags > 0)))
    for i, k in enumerate(some):
        text, ids, own, _ = texts[k]
        at = int(first[i]) * STEP
        if tagged[at + len(ids)] > tagged[at]:
            out[k] = _read_spans(text, tags[at : at + len(ids)], sure[at : at + len(ids)], own)
    return out


def _read_spans(text: str, tags: np.ndarray, sure: np.ndarray, free: np.ndarray) -> list[Span]:
    """The spans that the tags of a whole text give: plausible ones, the surest first."""
    kind = (tags + 1) // 2
    begins = np.flatnonzero((tags > 0) & ((tags % 2 == 1) | (np.concatenate(([0], kind[:-1])) != kind)))
    stops = np.flatnonzero((tags > 0) & (np.concatenate((kind[1:], [0])) != kind) | (np.concatenate((tags[1:] % 2 == 1, [False])) & (tags > 0))) + 1
    out, taken = [], ~free
    each = []
    for a, b in zip(begins.tolist(), stops.tolist()):
        name, p = TAGGED[kind[a] - 1], float(sure[a:b].mean())
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        if text[a : a + 1] == "(" and ")" not in text[a:b]:  # a bracket that the span does not close
            a += 1
        elif a and text[a - 1] == "(" and ")" in text[a:b] and "(" not in text[a:b] and free[a - 1]:  # or that it closes alone
            a -= 1
        each.append((name, a, b, p))
    for name, start, end, p in sorted(each, key=lambda x: (-x[3], x[1], x[2])):
        if start < end and p >= CONFIDENT and not taken[start:end].any() and plausible(name, text[start:end]):
            taken[start:end] = True
            out.append((name, start, end))
    return out


def joined(spans: list[Span]) -> str:
    rank = {k: i for i, k in enumerate(TAGGED)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (rank[x[0]], x[1], x[2])))


def _sample_windows(most: int):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                has = Texts(part.column("text")).per_text(TRIGGER) > 0
                for i in np.flatnonzero(has).tolist():
                    text = part.column("text")[i].as_py()
                    spans = base_spans(text)
                    for at in sorted({max(0, m.start() // LINE * LINE - LINE // 2) for m in re.finditer("[0-9@]", text)}):
                        cut = text[at : at + LINE]
                        if any(s < at < e or s < at + LINE < e for _, s, e in spans):
                            continue  # a span cut in two teaches nothing
                        label = joined([(k, s - at, e - at) for k, s, e in spans if s >= at and e <= at + LINE])
                        order = int.from_bytes(hashlib.blake2b(cut.encode(), digest_size=7).digest())
                        rows.append((order, cut, label))
                rows = sorted(set(rows))[:most]
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["hash", "line", "spans"])

    return sample


def labelled_windows(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(line, spans): at most so many windows of the texts with a digit or @, those with the smallest hashes, labelled by the base spans."""
    found = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(_sample_windows(most), "hash long, line string, spans string")
    return found.distinct().orderBy("hash", "line", "spans").limit(most).select("line", "spans")


def train(docs: DataFrame) -> Tagger:
    lines = made_lines()
    for row in labelled_windows(docs).toLocalIterator():
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in row["spans"].split(",") if x)]
        lines.append((row["line"], spans))
    tagged = [tag_line(text, spans) for text, spans in lines]
    return Tagger().fit(np.array([x for x, _ in tagged]), np.array([y for _, y in tagged]))


#: What find_personal_data adds to doc_id.
FOUND = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, secrets string, n_secrets long, flagged boolean"


def _find(tagger):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(c.split()[0] for c in FOUND.split(", "))]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = [(0, 0, 0, 0, nothing, "", 0, "", 0, False)] * part.num_rows
                texts = Texts(part.column("text"))
                has = texts.per_text(TRIGGER) > 0
                for m in _AT_BYTES.finditer(texts.data.tobytes()):
                    has[np.searchsorted(texts.offsets, m.start(), side="right") - 1] = True
                at = np.flatnonzero(has).tolist()
                known = [(text, base_spans(text)) for text in part.column("text").take(pa.array(at, pa.int64())).to_pylist()]
                for i, (_, base), every in zip(at, known, all_added_spans(known, tagger.value)):
                    more, secret = [x for x in every if x[0] in KINDS], [x for x in every if x[0] not in KINDS]
                    counts = [sum(s[0] == k for s in base) for k in KINDS]
                    digest = hashlib.sha256(joined(base).encode()).hexdigest()
                    rows[i] = (*counts, digest, joined(base + more), len(more), joined(secret), len(secret), bool(base or every))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(zip(*rows), kinds))], names=names)

    return find


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, the number of base spans of each kind, the base spans' digest, all spans, how many the tagger added, secrets, and whether there is anything."""
    slim = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tagger = docs.sparkSession.sparkContext.broadcast(tagger or train(slim))
    return slim.mapInArrow(_find(tagger), f"doc_id {dict(slim.dtypes)['doc_id']}, {FOUND}")
