"""Byte-pair encoding as a left-to-right transducer with bounded lookahead, and decoding as a byte-to-text state machine.

A merge list decides a text's tokens by repeatedly joining the pair of least rank. Read from the left, most of them are certain long before the end is
seen: text to come can undo a boundary only if some merge crosses it, and a merge can cross a boundary only after one of a lesser rank has crossed
the next boundary to its right, for up to then both sides evolve as they would without that text. So the merges that cross ever earlier boundaries have ever greater ranks,
and the longest chain of merges that can follow each other that way bounds how many of the last tokens may still change: the reach. ``Merges.chains`` computes it
from the merge list alone. Let (x, y) cross the end of a token t before (x', y') crosses its start. Then x is on the right edge of t's tree and was not consumed within t by the rank of (x, y). If y'
ends within t, it stands at the start of the tokens of some prefix of t without x, at a rank where t, whole, would have another token there; else y' begins with t and was made by way of (x, y).

``Transducer.stream`` holds a window of ``reach`` + 1 longest tokens: whenever it is full, its tokens are found, all but the last ``reach`` are certain and are given out, and
the window goes on from there. Nothing that lies before the window is needed, so memory is constant however long a text without spaces is. A pre-token that fits the window is
certain when its end is read. Windows of many pre-tokens go through the merges together, as numpy arrays: in each round every one applies its pair of least rank.

``Decoder`` takes ids as they come and gives out text: bytes that do not complete a character are held (three at most), and a byte sequence that cannot be one becomes
U+FFFD, by the longest well-formed beginning. Where a tokenizer file names no decoder, its text is the tokens' own strings with blanks between them.

Texts are cut by the tokenizer file's rules: special tokens in raw text, composed form, lower case, white space, and the split pattern. Plain texts (ASCII and the Latin
letters up to U+017F but the dotted capital I) are cut as whole batches with numpy; others by the library's own normalizer and pre-tokenizer. Distinct
pre-tokens are remembered by a worker, up to ``tokens.REMEMBERED``.

Defined cases: a null text is empty and has no tokens; repeated rows each have their row; ids and other columns of the input pass by unread.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm.textbuf import Texts, pieces, tidy
from curvemill.llm.tokens import DIGIT, SPACE, Encoder, byte_classes

ENCODED_BYTES = 1 << 20
_NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """The merge list of a tokenizer file, as numbers."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        model = known["model"]
        end = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-pair encoding is known here")
        vocabulary = model["vocab"]
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int32)
        self.final = np.array([vocabulary[c + end] for c in letters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        left, right = (np.array([vocabulary[p[k]] for p in pairs], np.int64) for k in (0, 1))
        rank = {int(t): r for r, t in enumerate(made)}
        if len(rank) != len(made) or any(rank.get(int(t), -1) >= r for side in (left, right) for r, t in enumerate(side)):
            raise ValueError("each token must be made by one merge, after the merges of its parts")
        self.size = max(vocabulary.values()) + 1
        self.left, self.right, self.made = left, right, made
        keys = left * self.size + right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.length = np.zeros(self.size, np.int64)  # bytes of each token
        self.length[self.inner] = self.length[self.final] = 1
        for a, b, t in zip(left.tolist(), right.tolist(), made.tolist()):
            self.length[t] = self.length[a] + self.length[b]
        self.longest = int(self.length.max())
        self.rank = rank
        self.parts = {t: (a, b) for a, b, t in zip(left.tolist(), right.tolist(), made.tolist())}
        self.spelled = {int(t): (int(t),) for t in (*self.inner, *self.final)}  # each token as the letters that it is made of
        for t, (a, b) in self.parts.items():
            self.spelled[t] = self.spelled[a] + self.spelled[b]
        self.token = {s: t for t, s in self.spelled.items()}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``_NONE`` where no merge joins it."""
        keys = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], _NONE).astype(np.int32)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The nodes on the left (0) or right (1) edge of a token's tree, from the token down, each with the rank of the merge that consumes it."""
        out, consumed = [(token, _NONE)], _NONE
        while token in self.parts:
            consumed, token = self.rank[token], self.parts[token][side]
            out.append((token, consumed))
        return out

    def _openings(self) -> dict[int, np.ndarray]:
        """By token y: rows (x, p, low, high) that tell when y can stand at the start of what is left of a token t, and could not if t were whole.

        x is on the right edge of t and taken away by what follows before the merge of rank p of t would have consumed it; y then stands there from rank low to rank high.
        """
        spelled, token = self.spelled, self.token
        heads = sorted({s[:k] for s in spelled.values() for k in range(1, len(s))})
        letters = np.fromiter((c for s in heads for c in s), np.int64)
        found, owner = self.join(letters, np.repeat(np.arange(len(heads)), [len(s) for s in heads]))
        first = dict(zip(heads, found[np.searchsorted(owner, np.arange(len(heads)))].tolist()))
        left = {t: self._edge(t, 0) for t in token.values()}
        rows: dict[int, set] = {}
        for t, s in spelled.items():
            whole = dict(left[t])
            for x, p in self._edge(t, 1)[1:]:
                for k in range(1, len(s) - len(spelled[x]) + 1):
                    for y, high in left[first[s[:k]]]:
                        if high < p:
                            break
                        low = max(p, whole.get(y, 0))
                        if low <= high:
                            rows.setdefault(y, set()).add((x, p, low, high))
        return {y: np.array(sorted(r), np.int64) for y, r in rows.items()}

    def chains(self) -> np.ndarray:
        """For each merge, the longest chain that it can end: 1, or one more than that of a merge which may cross the next boundary before it does."""
        openings = self._openings()
        table = np.concatenate([*openings.values(), np.zeros((0, 4), np.int64)])
        of, at = {}, 0
        for y, own in openings.items():
            of[y] = slice(at, at + len(own))
            at += len(own)
        value = np.zeros(len(table), np.int32)  # the longest chain that takes x away before rank p
        due = np.argsort(table[:, 1], kind="stable")
        ready, when, what = 0, table[due, 1].tolist(), table[due, 0].tolist()
        right = {t: dict(self._edge(t, 1)) for t in self.token.values()}
        out = np.zeros(len(self.made), np.int32)
        best: dict[int, int] = {}  # the longest chain of a merge whose left part is this token
        for r, (x, y) in enumerate(zip(self.left.tolist(), self.right.tolist())):
            while ready < len(when) and when[ready] <= r:
                value[due[ready]] = best.get(what[ready], 0)
                ready += 1
            longest, todo = 0, [(y, 0)]
            if y in of:
                _, _, low, high = table[of[y]].T
                longest = int(np.max(value[of[y]], where=(low <= r) & (r <= high), initial=0))
            while todo:  # merges by which y was made, across the end of a token that y begins with
                node, start = todo.pop()
                if node in self.parts:
                    a, b = self.parts[node]
                    before = self.token.get(self.spelled[y][: start + len(self.spelled[a])])
                    if before is not None and self.rank[node] <= right[before].get(a, -1):
                        longest = max(longest, int(out[self.rank[node]]))
                    todo += [(a, start), (b, start + len(self.spelled[a]))]
            out[r] = longest + 1
            best[x] = max(best.get(x, 0), longest + 1)
        return out

    def join(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of many sequences at once, and the sequence of each token; owner numbers the sequences in ascending order."""
        if not len(symbols):
            return symbols.astype(np.int32), owner
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbols), _NONE, np.int32)
        rank[:-1] = np.where(owner[1:] == owner[:-1], self.ranks(symbols[:-1], symbols[1:]), _NONE)
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(first, append=len(symbols))
            least = np.minimum.reduceat(rank, first)
            if (least == _NONE).any():
                over = np.repeat(least == _NONE, sizes)
                done.append((symbols[over], owner[over]))
                symbols, owner, rank = symbols[~over], owner[~over], rank[~over]
                sizes, least = sizes[least != _NONE], least[least != _NONE]
                if not len(symbols):
                    break
            hit = rank == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            close = np.flatnonzero(np.diff(at) == 1)
            if len(close):  # of equal letters in a row, the first two are joined, then the next two
                run = np.cumsum(np.concatenate(([True], np.diff(at) != 1)))
                place = np.arange(len(at)) - np.searchsorted(run, run)
                at = at[place % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            now = at - np.arange(len(at))
            again = np.unique(np.concatenate((now, now - 1)))
            again = again[again >= 0]
            rank[again] = _NONE
            again = again[again + 1 < len(symbols)]
            again = again[owner[again] == owner[again + 1]]
            rank[again] = self.ranks(symbols[again], symbols[again + 1])
        symbols, owner = (np.concatenate(c) for c in zip(*done))
        order = np.argsort(owner, kind="stable")
        return symbols[order], owner[order]


class Transducer:
    """Tokens of pre-tokens, given out as soon as they are certain."""

    def __init__(self, path: str, reach: int | None = None) -> None:
        self.merges = Merges(path)
        self.reach = reach or int(self.merges.chains().max(initial=0))
        self.window = (self.reach + 1) * self.merges.longest

    def stream(self, chunks: Iterable[bytes]) -> Iterator[np.ndarray]:
        """The tokens of one pre-token that comes in chunks; never more than a window and a chunk is held."""
        held = np.zeros(0, np.uint8)
        for chunk in chunks:
            data = np.frombuffer(chunk, np.uint8)
            for i in range(0, len(data), self.window):
                held = np.concatenate((held, data[i : i + self.window]))
                while len(held) > self.window:  # the last byte stays: it may end the pre-token
                    found, _ = self.merges.join(self.merges.inner[held[: self.window]], np.zeros(self.window, np.int64))
                    certain = found[: -self.reach]
                    yield certain
                    held = held[int(self.merges.length[certain].sum()) :]
        if len(held):
            symbols = self.merges.inner[held]
            symbols[-1] = self.merges.final[held[-1]]
            yield self.merges.join(symbols, np.zeros(len(held), np.int64))[0]

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of many pre-tokens, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        short = sizes <= self.window
        data = np.frombuffer(b"".join(w for w, s in zip(words, short) if s), np.uint8)
        symbols, own = self.merges.inner[data], sizes[short]
        last = np.cumsum(own)[own > 0] - 1
        symbols[last] = self.merges.final[data[last]]
        ids, owner = self.merges.join(symbols, np.repeat(np.flatnonzero(short), own))
        count = np.bincount(owner, minlength=len(words))
        if short.all():
            return ids, count
        parts = np.split(ids, np.cumsum(count)[:-1])
        for i in np.flatnonzero(~short).tolist():
            parts[i] = np.concatenate(list(self.stream([words[i]])))
            count[i] = len(parts[i])
        return np.concatenate(parts), count


@lru_cache(4)
def reach_of(path: str) -> int:
    """The sufficient lookahead of a tokenizer file, in tokens."""
    return int(Merges(path).chains().max(initial=0))


class WordEncoder(Encoder):
    """Encodes batches of texts by a transducer; remembers the tokens of the pre-tokens it has met."""

    def __init__(self, path: str, reach: int | None = None) -> None:
        self.transducer = Transducer(path, reach)
        self.letters = {c: b for b, c in enumerate(byte_letters())}
        super().__init__(path)
        self.numbers = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.numbers, key=len, reverse=True)))) if self.numbers else None
        with open(path, encoding="utf-8") as file:
            self.cuts = cuts_words(json.load(file))

    def tokens_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, count = self.transducer.tokens([w.encode() for w in words])
        return ids.astype(np.uint32), count.astype(np.int32)

    def plain(self, texts: Texts) -> np.ndarray:
        good = super().plain(texts)
        data = texts.data
        far = (data >= 0xC6) & (data < 0xCA)  # Latin letters beyond U+017F, whose small letters may lie elsewhere
        dotted = np.flatnonzero(data[:-1] == 0xC4)
        far[dotted[data[dotted + 1] == 0xB0]] = True
        good[np.searchsorted(texts.offsets, np.flatnonzero(far), side="right") - 1] = False
        return good

    def cut(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return word_pieces(data, first)

    def whole(self, text: str) -> np.ndarray:
        """The tokens of a text that is not plain, piece by piece."""
        out, at = [], 0
        for mark in [*(self.marks.finditer(text) if self.marks else ()), None]:
            part = text[at : mark.start() if mark else None]
            if part:
                if self.library.normalizer:
                    part = self.library.normalizer.normalize_str(part)
                cut = [bytes(map(self.letters.__getitem__, s)) for s, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
                out.append(self.transducer.tokens(cut)[0].astype(np.uint32))
            if mark:
                out.append(np.array([self.numbers[mark.group()]], np.uint32))
                at = mark.end()
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def prepared(self, column: pa.Array) -> tuple[Texts, np.ndarray]:
        plain = self.plain(Texts(column))
        return Texts(pc.if_else(pa.array(plain), pc.utf8_lower(column), column)), plain

    def all_ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each text."""
        ids, count = self.encode(column, 0)
        return np.delete(ids, np.cumsum(count) - 1), count - 1


def cuts_words(known: dict) -> bool:
    """Whether a tokenizer file cuts texts as ``word_pieces`` does: composed form, white space, lower case; letters, single digits, the rest."""
    split = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    norm = [n["type"] for n in (known.get("normalizer") or {}).get("normalizers", ())]
    cut = (known.get("pre_tokenizer") or {}).get("pretokenizers", ())
    return norm == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in cut] == ["Split", "ByteLevel"] and cut[0]["pattern"] == {"Regex": split} and bool(cut[0]["invert"]) and not cut[1]["use_regex"]


def word_pieces(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the pre-tokens of plain lower-case texts; first marks the first byte of each text, and has one item more than data."""
    kind = byte_classes()[data]
    starts = first[:-1] | (kind == DIGIT)
    starts[1:] |= kind[1:] != kind[:-1]
    quote = np.flatnonzero((data == 39) & starts)
    if len(quote):  # a quote that stands alone and an ending after it are one piece
        room = np.concatenate((data, np.zeros(3, np.uint8)))
        inside = lambda k: ~first[np.minimum(quote + k, len(data))]
        one, two = room[quote + 1], room[quote + 2]
        short = inside(1) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = inside(1) & inside(2) & ~short & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        starts[quote[short | long] + 1] = False
        after = np.concatenate((quote[short] + 2, quote[long] + 3))
        starts[after[after < len(data)]] = True
    at = np.flatnonzero(starts)
    sizes = np.diff(at, append=len(data))
    real = kind[at] != SPACE
    return at[real], sizes[real]


class Decoder:
    """Ids to text, as they come."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            kind = (json.load(file).get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"no state machine for the decoder {kind}")
        known = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
        self.bytewise = kind == "ByteLevel"
        letters = {c: b for b, c in enumerate(byte_letters())}
        self.token = np.empty(max(known.values(), default=-1) + 1, object)
        self.token[:] = b"" if self.bytewise else None
        for text, i in known.items():
            self.token[i] = (bytes(map(letters.__getitem__, text)) if set(text) <= letters.keys() else text.encode()) if self.bytewise else text
        self.reset()

    def reset(self) -> None:
        """Before the first id of a text."""
        self.begun = False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        """The text that is certain after these ids."""
        if self.bytewise:
            return self.machine.decode(b"".join(self.token[ids].tolist()))
        found = [t for t in self.token[ids].tolist() if t is not None]
        text = " ".join(found)
        if found and self.begun:
            text = " " + text
        self.begun |= bool(found)
        return text

    def close(self) -> str:
        """What an end here makes of the bytes that are held."""
        rest = self.machine.decode(b"", True)
        self.reset()
        return rest


@lru_cache(2)
def word_encoder(path: str, reach: int) -> WordEncoder:
    """One encoder a worker process."""
    return WordEncoder(path, reach)


@lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


#: Ids that are decoded and hashed together.
DECODED = 1 << 16


def _rows(path: str, reach: int, ids_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(path)
        for batch in batches:
            for part in pieces(batch, "text", ENCODED_BYTES):
                ids, count = word_encoder(path, reach).all_ids(part.column("text"))
                last = np.cumsum(count)
                raw = ids.astype("<u4")
                sums, texts = [], []
                for low, high in zip((last - count).tolist(), last.tolist()):
                    sums.append(hashlib.sha256(raw[low:high]).hexdigest())
                    text = hashlib.sha256()
                    for i in range(low, high, DECODED):
                        text.update(back.feed(ids[i : min(i + DECODED, high)]).encode())
                    text.update(back.close().encode())
                    texts.append(text.hexdigest())
                columns = [part.column("doc_id"), pa.array(count, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())]
                if ids_too:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], last)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return run


def encode(docs: DataFrame, path: str, *, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of docs (doc_id, text): encoded and decoded again."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return own.mapInArrow(tidy(_rows(path, reach_of(path), ids)), schema)


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(path)
        for batch in batches:
            out = []
            for row in batch.column("ids"):
                ids = np.array(row.values if row.is_valid else [], np.int64)
                out.append("".join(back.feed(ids[i : i + DECODED]) for i in range(0, len(ids), DECODED)) + back.close())
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of encoded (doc_id, ids); null ids are no ids."""
    own = encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    return own.mapInArrow(tidy(_texts(path)), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string")
