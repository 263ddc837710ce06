"""Where records begin in any part of an event file, without reading what stands before it.

A record starts with its length (8 bytes) and the masked checksum of these bytes, so a task that is given a range of bytes tests every offset whose length is possible
and whose checksum is right. A single such offset proves little, as payloads may hold framed records; but records follow each other without a gap, so an offset counts only if the
headers from it on are linked without a break for ``PROOF`` bytes. Of random bytes an offset passes one test with a chance of 2^-32, and each further record by another such
chance; frames copied into a payload are taken for records only where more than ``PROOF`` bytes of them stand back to back.

Every range of a file follows the same rule, so neighbours agree without talking to each other: a range owns the records from its own first start to the first start that any
later range finds. Starts that the rule does not trust (after a wrong checksum of a length, which reading itself does not look at, or near the end of a file) cost no record, as the range
before then simply reads on.
"""

from __future__ import annotations

from typing import BinaryIO

import numpy as np

from curvemill.sources.columnar import masked_crcs
from curvemill.sources.wire import HEADER, MOST, TRAILER

#: Bytes of unbroken records, from header to header, that prove a start; starts are looked for in windows of as many bytes, with some more for records on the edge.
PROOF, SLACK = 1 << 18, 1 << 10


def headers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in data where a header with the right checksum begins, and the offset after the record of each."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) - HEADER + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.lib.stride_tricks.as_strided(raw, (n, HEADER), (1, 1))
    high = (raw[4 : n + 4] | raw[5 : n + 5] | raw[6 : n + 6] | raw[7 : n + 7]) == 0  # lengths below 2^32
    at = np.flatnonzero(high)
    rows = words[at]
    size = rows[:, :4].copy().view("<u4").ravel().astype(np.int64)
    good = (size <= MOST) & (masked_crcs(rows[:, :8]) == rows[:, 8:12].copy().view("<u4").ravel())
    return at[good], at[good] + size[good] + HEADER + TRAILER


def _header_at(source: BinaryIO, at: int) -> bool:
    source.seek(at)
    return len(headers(source.read(HEADER))[0]) > 0


def start_of(source: BinaryIO, low: int, high: int, length: int) -> int | None:
    """The first trusted record start in [low, high) of a file that is length bytes long; None if there is none."""
    for window in range(low, high, PROOF):
        source.seek(window)
        data = source.read(min(2 * PROOF + SLACK, length - window))
        at, after = headers(data)
        if not len(at):
            continue
        place = np.minimum(np.searchsorted(at, after), len(at) - 1)
        linked, place = (at[place] == after).tolist(), place.tolist()
        last = list(range(len(linked)))  # of each header, the last one of its unbroken chain
        for i in range(len(linked) - 1, -1, -1):
            if linked[i]:
                last[i] = last[place[i]]
        beyond: dict[int, bool] = {}  # whether a header stands where a chain leaves the window
        for i, o in enumerate(at.tolist()):
            if o >= min(PROOF, high - window):
                break
            if at[last[i]] - o >= PROOF:
                return window + o
            leaves = int(after[last[i]])
            if leaves - o >= PROOF and leaves > len(data) - HEADER and window + leaves + HEADER <= length:
                if leaves not in beyond:
                    beyond[leaves] = _header_at(source, window + leaves)
                if beyond[leaves]:
                    return window + o
    return None


def bounds(source: BinaryIO, low: int, every: int, length: int, exact: bool) -> tuple[int, int | None] | None:
    """What the range of ``every`` bytes from low on owns: its first record's start (low itself if that is exact) and that of the next range with one, None at the last; None if it owns nothing."""
    high = min(low + every, length)
    first = low if exact else start_of(source, low, high, length)
    if first is None:
        return None
    while high < length:
        following = start_of(source, high, min(high + every, length), length)
        if following is not None:
            return first, following
        high = min(high + every, length)
    return first, None
