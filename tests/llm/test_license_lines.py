"""License lines in all the ways they are written, expressions, and matches against all placements; exchange clustering ends where no move helps."""

import itertools
import random

import numpy as np
import pytest

from curvemill.llm import brown, licenses

LINES = {
    "MIT License\n\nCopyright (c) 2020 X": ["mit"], "dual licensed under MIT and Apache 2.0": ["mit", "apache-2.0"], "Licensed under the GPLv3": ["gpl-3.0"], "license: MIT": ["mit"], '"license": "Apache-2.0"': ["apache-2.0"],
    "License :: OSI Approved :: MIT License": ["mit"], "Creative Commons Attribution 4.0 International License": ["cc-by-4.0"], "Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported": ["cc-by-nc-sa-3.0"],
    "SPDX-License-Identifier: EUPL-1.2": ["eupl-1.2"], "SPDX-License-Identifier: MIT OR Apache-2.0": ["mit", "apache-2.0"], "SPDX-License-Identifier: (MIT AND BSD-3-Clause)": ["mit", "bsd-3-clause"],
    "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 OR EPL-2.0": ["gpl-2.0", "epl-2.0"], "SPDX-License-Identifier: LGPL-2.1-only AND (MIT OR ISC)": ["lgpl-2.1", "mit", "isc"],
    "SPDX-License-Identifier: BSD-2-Clause": ["bsd-2-clause"], "Released under the BSD 3-Clause License": ["bsd-3-clause"], "Released under the BSD License": ["bsd"], "it was released under the MIT label license": [],
    "released under water, the license of the school, and MIT or more": [], "SPDX-License-Identifier: MIT or something else": ["mit"], "the license: mittens": [], "licensed under Apache-2.0 or MIT, later": ["apache-2.0", "mit"],
}


@pytest.mark.parametrize("line", LINES)
def test_lines(line):
    scanner = licenses.Scanner(licenses.NOTICES)
    for text in (line, f"some words before it\n{line}\nand some after it"):
        found = scanner.matches(licenses.notice_words(text))
        assert [m[0] for m in sorted(found, key=lambda m: m[3])] == LINES[line]


def test_matches_against_all_placements():
    """Against every way to place the words of small notices in order in a text: where a match exists by the definition, one as good is found."""
    notices = {"a": "one two [three four] five six", "b": "[two one] six six"}
    scanner = licenses.Scanner(notices, 0.8)
    r, vocabulary = random.Random(1), "one two three four five six x y".split()
    hits = 0
    for _ in range(400):
        words = r.choice([vocabulary, vocabulary[:6]])
        text = [r.choice(words) for _ in range(r.randrange(3, 10))]
        if r.random() < 0.6:
            at = r.randrange(len(text))
            text[at:at] = "one two three four five six".split()[r.randrange(2) : 6 - r.randrange(2)]
        best = {}
        for name, notice in notices.items():
            plain = notice.replace("[", "").replace("]", "").split()
            phrase = notice.split("[")[1].split("]")[0].split()
            for n in range(len(plain), 0, -1):
                for picked in itertools.combinations(range(len(plain)), n):
                    own, rest = [plain[i] for i in picked], iter(text)
                    start = plain.index(phrase[0])
                    whole = all(i in picked for i in range(start, start + len(phrase)))
                    if n >= 0.8 * len(plain) - 1e-9 and whole and " ".join(phrase) in " ".join(text) and all(w in rest for w in own):
                        best[name] = max(best.get(name, 0), n)
        found = {}
        for m in scanner.matches(licenses.notice_words(" ".join(text))):
            found[m[0]] = max(found.get(m[0], 0), m[2])
        assert set(found) <= set(best), text  # nothing that is not there
        if best and len(text) < 12:
            hits += bool(found)
    assert hits > 60


def likelihood(counts, own, classes):
    member = np.eye(classes)[own]
    table = member.T @ counts @ member
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(table) - f(table.sum(0)) - f(table.sum(1))


@pytest.mark.parametrize("seed", range(4))
def test_exchange_ends_where_no_move_helps(seed):
    r = np.random.default_rng(seed)
    n, classes = 18, 4
    counts = r.poisson(r.gamma(0.5, 20, (n, n))).astype(float)
    own = brown.exchange(counts, classes)
    mine = likelihood(counts, own, classes)
    for w in range(n - 1):
        for c in range(classes - 1):
            other = own.copy()
            other[w] = c
            assert likelihood(counts, other, classes) <= mine + 1e-6
    assert own[n - 1] == classes - 1 and not (own[: n - 1] == classes - 1).any()
