"""License scans by patience alignment of texts with license notices.

Words are runs of letters and digits (and anything beyond ASCII), A-Z lower-cased. A text's region and a notice are aligned
by patience: words that occur once in both are anchors, the longest increasing subsequence of their places stays, and the gaps between
anchors are aligned the same way, after common words at both ends of a gap. The share of a notice's words that are
matched is its coverage. Besides coverage, the phrases that tell a notice from others (the license's name and version) must be matched
whole. Regions are the surroundings, ``REACH`` notices wide, of each occurrence of that phrase, or word of a notice without phrases, which is rarest
in the text, so words scattered over a long text do not add up. A region that holds a notice twice may have no unique words; so the nearest words on both sides
of the occurrence, half a notice more than it needs there, are also aligned by a longest common subsequence, which has no need of them.

Most texts need no alignment: to cover the share ``COVERAGE`` of a notice, a text must have all but so many of its distinct words. This bound, which loses
nothing, is tested for all texts of an Arrow batch at once.

All notices that match are given with their spans, none of which overlap: the one with most matched words goes first, then greater coverage, then
the smaller name, then the shorter span, then the earlier one, and what overlaps it is left out. The first of them is the document's license. After a match, further identifiers of an
expression (``MIT OR Apache-2.0``, ``GPL-2.0-or-later WITH Classpath-exception-2.0 AND BSD-3-Clause``) are matches of their own.

Defined cases: a null or empty text has no license and no matches; matches come in the order of the text; repeated rows are judged alike; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm.textbuf import Texts, byte_values, pieces

COVERAGE = 0.8
REACH = 2

#: Public license notices, title lines of whole texts and SPDX lines, as templates of each license. What stands
#: in brackets tells the license from others: it must be matched whole and in one piece.
_CC = [(kind, version) for kind in ("by", "by-nc", "by-nd", "by-sa", "by-nc-nd", "by-nc-sa") for version in ("2.0", "2.5", "3.0", "4.0")]
_GNU = "licensed under the [GNU {}], [version {}]", "[GNU {} Version {}]", "[GNU {}] as published by the Free Software Foundation; either [version {}]"
_gnu = lambda name, version: tuple(x.format(name, version) for x in _GNU)
NOTICES: dict[str, tuple[str, ...]] = {
    "0bsd": ("[Zero-Clause BSD]", "[BSD Zero Clause License]"),
    "agpl-3.0": _gnu("Affero General Public License", "3"),
    "apache-1.1": ("Licensed under the [Apache] License, Version [1.1]", "The [Apache Software License, Version 1.1]"),
    "apache-2.0": ("Licensed under the [Apache] License, Version [2.0]", "[Apache License Version 2.0]"),
    "artistic-2.0": ("Released under the [Artistic License 2.0]", "[The Artistic License 2.0]"),
    "bsd": (
        "[Redistribution and use in source and binary forms], with or without modification, are permitted provided that the following conditions are met",
        "Released under the [BSD License]",
    ),
    "bsd-2-clause": ("Released under the [BSD 2-Clause License]", "[BSD 2-Clause License Copyright]"),
    "bsd-3-clause": ("Released under the [BSD 3-Clause License]", "[BSD 3-Clause License Copyright]"),
    "bsl-1.0": ("Distributed under the [Boost Software License], [Version 1.0]", "[Boost Software License - Version 1.0]", "Released under the [Boost Software] License"),
    "cc0-1.0": ("Licensed under [CC0 1.0]", "[CC0 1.0 Universal]"),
    **{f"cc-{kind}-{version}": (f"Licensed under [CC {kind} {version}]",) for kind, version in _CC},
    "epl-1.0": ("This program and the accompanying materials are made available under the terms of the [Eclipse Public License v1.0]", "[Eclipse Public License - v 1.0]"),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the [Eclipse Public License 2.0]",
        "This program and the accompanying materials are made available under the terms of the [Eclipse Public License v2.0]", "[Eclipse Public License - v 2.0]",
    ),
    "gpl": ("Released under the [GPL License]",),
    "gpl-2.0": _gnu("General Public License", "2"),
    "gpl-3.0": _gnu("General Public License", "3"),
    "isc": ("Permission to [use, copy, modify, and/or distribute] this software for any purpose [with or without fee] is hereby granted", "Released under the [ISC License]", "[ISC License Copyright]"),
    "lgpl-2.0": _gnu("Library General Public License", "2"),
    "lgpl-2.1": _gnu("Lesser General Public License", "2.1"),
    "lgpl-3.0": _gnu("Lesser General Public License", "3"),
    "mit": ("Released under the [MIT License]", "[MIT License Copyright]"),
    "mit-text": ("Permission is hereby granted, [free of charge, to any person obtaining a copy] of this software and associated documentation files",),
    "mpl-1.1": ("subject to the [Mozilla Public License] [Version 1.1]", "[Mozilla Public License Version 1.1]"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the [Mozilla Public License], v. [2.0]", "[Mozilla Public License Version 2.0]"),
    "unlicense": ("This is [free and unencumbered software] released into the [public domain]",),
    "zlib": ("This software is [provided as-is, without any express or implied warranty]. In no event will the authors be held liable for any damages arising from the use of this software", "Released under the [zlib License]"),
}
#: Further licenses that are known by their SPDX identifiers, and what identifiers are called besides.
_MORE = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CDDL-1.0", "CECILL-2.1", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2",
    "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "MS-RL", "NCSA", "OFL-1.1", "OSL-3.0", "PostgreSQL", "Python-2.0", "UPL-1.0", "Unlicense", "WTFPL", "Zlib",
)
_CALLED = {
    "apache-2.0": ("Apache 2.0", "Apache License 2.0", "Apache License Version 2.0", "Apache Software License"), "bsd": ("BSD License",), "gpl-2.0": ("GPLv2", "GPL v2"), "gpl-3.0": ("GPLv3", "GPL v3"), "agpl-3.0": ("AGPLv3", "AGPL v3"),
    "isc": ("ISC License",), "lgpl-2.1": ("LGPLv2.1", "LGPL v2.1"), "lgpl-3.0": ("LGPLv3", "LGPL v3"), "mit": ("MIT License",), "mpl-2.0": ("MPL 2.0", "Mozilla Public License 2.0"), "unlicense": ("The Unlicense",),
}
_IDS = {**{i.lower(): (i,) for i in _MORE}, **{f"cc-{kind}-{version}": (f"CC-{kind}-{version}",) for kind, version in _CC}}
#: What stands before an identifier, and before an identifier or another name.
_LEADS, _PROSE = ("SPDX-License-Identifier:", "license:", "licence:"), ("licensed under", "licensed under the", "License :: OSI Approved ::")
_KINDS = {"by": "Attribution", "nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
for _name, _ids in _IDS.items():
    NOTICES[_name] = (*NOTICES.get(_name, ()), *(f"[{lead} {i}]" for lead in _LEADS for i in _ids))
for _name, _others in {n: (*_IDS.get(n, ()), *_CALLED.get(n, ())) for n in (*_IDS, *_CALLED)}.items():
    NOTICES[_name] = (*NOTICES.get(_name, ()), *(f"[{lead} {i}]" for lead in _PROSE for i in _others))
for _kind, _version in _CC:
    NOTICES[f"cc-{_kind}-{_version}"] += (f"[Creative Commons {'-'.join(_KINDS[k] for k in _kind.split('-'))} {_version}]",)

_CODES = np.arange(256)
NOTICE_BYTE = (_CODES >= 128) | ((_CODES >= 48) & (_CODES < 58)) | ((_CODES >= 65) & (_CODES < 91)) | ((_CODES >= 97) & (_CODES < 123))
_VALUES = byte_values(True, NOTICE_BYTE)


def notice_words(text: str) -> list[int]:
    """Hashes of the words of a text."""
    texts = Texts(pa.array([text]))
    starts, ends, _ = texts.runs(NOTICE_BYTE)
    return texts.hashes(starts, ends, _VALUES).tolist()


def template(text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """The words of a template, and the start and end of each phrase in brackets."""
    words: list[int] = []
    keys = []
    for k, part in enumerate(text.replace("]", "[").split("[")):
        own = notice_words(part)
        if k % 2 and own:
            keys.append((len(words), len(words) + len(own)))
        words += own
    return words, keys


def increasing(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by their first parts, whose second parts increase."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            at.append(k)
        else:
            tops[pile], at[pile] = y, k
    out = []
    k = at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: Sequence[int], notice: Sequence[int]) -> list[tuple[int, int]]:
    """Matched (place in text, place in notice) pairs by patience, in ascending order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(notice))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == notice[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == notice[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(notice[c:d])
        place = {w: i for i, w in enumerate(notice[c:d], c) if there[w] == 1 and here[w] == 1}
        anchors = increasing([(i, place[w]) for i, w in enumerate(text[a:b], a) if w in place])
        if not anchors:
            continue
        out.extend(anchors)
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo.extend((x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:]))
    return sorted(out)


def nearest(text: Sequence[int], notice: Sequence[int]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs, with the earliest places in the text."""
    n, m = len(text), len(notice)
    most = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = most[i], most[i + 1]
        for k in range(m - 1, -1, -1):
            row[k] = below[k + 1] + 1 if text[i] == notice[k] else max(below[k], row[k + 1])
    out = []
    i = k = 0
    while i < n and k < m:
        if text[i] == notice[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        elif most[i][k + 1] >= most[i + 1][k]:
            k += 1
        else:
            i += 1
    return out


def around(words: Sequence[int], p: int, notice: Sequence[int], q: int, k: int = 1) -> list[tuple[int, int]]:
    """Matched pairs near the place p of a text, where k words of the notice from its word q on stand."""
    slack = len(notice) // 2 + 1
    left = nearest(words[max(0, p - q - slack) : p][::-1], notice[:q][::-1])
    right = nearest(words[p + k : p + len(notice) - q + slack], notice[q + k :])
    return [(p - 1 - i, q - 1 - j) for i, j in left[::-1]] + [(p + i, q + i) for i in range(k)] + [(p + k + i, q + k + j) for i, j in right]


class Expression:
    """Reads on after an identifier: ``OR`` and ``AND`` with further ones, ``-only``, ``-or-later`` and ``+``, and exceptions after ``WITH``."""

    def __init__(self) -> None:
        named = {n: (*_IDS.get(n, ()), *_CALLED.get(n, ())) for n in (*_IDS, *_CALLED)}
        self.ids = {tuple(notice_words(i)): name for name, ids in named.items() for i in ids}
        self.longest = max(map(len, self.ids))
        self.word = {w: notice_words(w)[0] for w in ("or", "and", "with", "only", "later", "exception")}
        self.digits = {notice_words(str(d))[0] for d in range(10)}

    def after(self, words: Sequence[int], at: int) -> Iterator[tuple[str, int, int]]:
        """(license, first word, end) of each further identifier."""
        is_ = lambda i, name: i < len(words) and words[i] == self.word[name]
        while at < len(words):
            if is_(at, "only"):
                at += 1
            elif is_(at, "or") and is_(at + 1, "later"):
                at += 2
            elif is_(at, "with"):
                end = next((i for i in range(at + 1, min(at + 6, len(words))) if is_(i, "exception")), None)
                if end is None:
                    return
                at = end + 1
                while at < len(words) and words[at] in self.digits:
                    at += 1
            elif is_(at, "or") or is_(at, "and"):
                end = next((e for e in range(at + 1 + self.longest, at + 1, -1) if tuple(words[at + 1 : e]) in self.ids), None)
                if end is None:
                    return
                yield self.ids[tuple(words[at + 1 : end])], at + 1, end
                at = end
            else:
                return


class Scanner:
    def __init__(self, notices: dict[str, str | tuple[str, ...]], coverage: float = COVERAGE) -> None:
        each = [(n, *template(t)) for n in sorted(notices) for t in ([notices[n]] if isinstance(notices[n], str) else notices[n])]
        self.names, self.words, self.keys = (list(c) for c in zip(*each))
        self.coverage, self.expression = coverage, Expression()
        self.vocabulary = np.unique(np.array([w for ws in self.words for w in ws], np.uint64))
        self.member = np.array([np.isin(self.vocabulary, np.array(ws, np.uint64)) for ws in self.words]).T
        # distinct words that a text must have
        self.least = np.array([max(1, int(np.ceil(len(set(ws)) - (1 - coverage) * len(ws) - 1e-9))) for ws in self.words])
        needed = [[w for a, b in keys for w in ws[a:b]] for ws, keys in zip(self.words, self.keys)]
        self.needed = np.array([np.isin(self.vocabulary, np.array(ws, np.uint64)) for ws in needed]).T

    def matches(self, words: list[int], among: Sequence[int] | None = None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, first word, end) of all notices in a text of these word hashes, best first; spans do not overlap."""
        found = set()
        places: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            places.setdefault(w, []).append(i)
        for t in range(len(self.names)) if among is None else among:
            name, notice, keys = self.names[t], self.words[t], self.keys[t]
            need = self.coverage * len(notice) - 1e-9
            if sum(w in places for w in notice) < need:
                continue
            for pairs in self._tries(words, places, notice, keys, need):
                at = {k: i for i, k in pairs}
                if len(pairs) < need or not all(k in at and at[k] == at[a] + k - a for a, b in keys for k in range(a, b)):
                    continue
                found.add((name, len(pairs) / len(notice), len(pairs), pairs[0][0], pairs[-1][0] + 1))
        out, taken = [], bytearray(len(words))
        for match in sorted(found, key=lambda m: (-m[2], -m[1], m[0], m[4] - m[3], m[3])):
            low, high = match[3:]
            if not any(taken[low:high]):
                taken[low:high] = b"\1" * (high - low)
                out.append(match)
        for match in list(out):
            for name, low, high in self.expression.after(words, match[4]):
                if not any(taken[low:high]):
                    taken[low:high] = b"\1" * (high - low)
                    out.append((name, 1.0, high - low, low, high))
        return out

    def best(self, words: list[int]) -> tuple[str, float, int, int, int] | None:
        """The first of the matches."""
        return next(iter(self.matches(words)), None)

    def _tries(self, words: list[int], places: dict[int, list[int]], notice: list[int], keys: list[tuple[int, int]], need: float) -> Iterator[list[tuple[int, int]]]:
        """Alignments of a notice with the surroundings of all places that may be in a match."""
        if keys:  # the phrase that stands in the fewest places is in every match
            starts = [[p for p in places.get(notice[a], ()) if words[p : p + b - a] == notice[a:b]] for a, b in keys]
            k = min(range(len(keys)), key=lambda i: len(starts[i]))
            centers = [(p, keys[k][0], keys[k][1] - keys[k][0]) for p in starts[k]]
        else:  # a match may lack some words: the rarest of one more than it can lack is in every match
            present = [w for w in dict.fromkeys(notice) if w in places]
            by_rarity = sorted(present, key=lambda w: len(places[w]))
            lack = int(len(notice) - need) - (len(set(notice)) - len(present))
            centers = [(p, q, 1) for p in sorted({p for w in by_rarity[: max(lack, 0) + 1] for p in places[w]}) for q, w in enumerate(notice) if w == words[p]]
        for p, q, k in centers:
            yield around(words, p, notice, q, k)
            low, high = max(0, p - REACH * len(notice)), p + REACH * len(notice) + 1
            left, right = align(words[low:p], notice[:q]), align(words[p + k : high], notice[q + k :])
            yield [(low + i, j) for i, j in left] + [(p + i, q + i) for i in range(k)] + [(p + k + i, q + k + j) for i, j in right]

    def scan(self, column: pa.Array) -> list[list[tuple[str, float, int, int, int]]]:
        texts = Texts(column)
        starts, ends, first = texts.runs(NOTICE_BYTE)
        hashes = texts.hashes(starts, ends, _VALUES)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        hit = np.flatnonzero(self.vocabulary[at] == hashes)
        has = np.zeros((texts.n, len(self.vocabulary)), bool)
        has[np.searchsorted(first, hit, side="right") - 1, at[hit]] = True
        own = has.astype(np.float32)  # counts stay far below 2^24
        may = (own @ self.member.astype(np.float32) >= self.least) & (own @ self.needed.astype(np.float32) >= self.needed.sum(0))
        out: list = [[] for _ in range(texts.n)]
        for i in np.flatnonzero(may.any(1)).tolist():
            out[i] = self.matches(hashes[first[i] : first[i + 1]].tolist(), np.flatnonzero(may[i]).tolist())
        return out


def _scan(notices: dict[str, str | tuple[str, ...]], coverage: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, coverage)
        names = ["license", "coverage", "matched", "first_word", "end_word"]
        kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        match = pa.list_(pa.struct(list(zip(names, kinds))))
        for batch in batches:
            for part in pieces(batch, "text"):
                found = scanner.scan(part.column("text"))
                rows = [m[0] if m else (None, 0.0, 0, None, None) for m in found]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
                every = pa.array([[dict(zip(names, x)) for x in sorted(m, key=lambda x: x[3])] for m in found], match)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, every], names=["doc_id", *names, "matches"])

    return scan


def scan_licenses(docs: DataFrame, notices: dict[str, str | tuple[str, ...]] = NOTICES, coverage: float = COVERAGE) -> DataFrame:
    """All license notices (matches) of every row of docs (doc_id, text), and the best of them; license is null and coverage 0 where none is covered."""
    slim = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    match = "license string, coverage double, matched long, first_word long, end_word long"
    return slim.mapInArrow(_scan(notices, coverage), f"doc_id {kind}, {match}, matches array<struct<{match.replace(' ', ':').replace(',:', ', ')}>>")
