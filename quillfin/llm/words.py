"""Words of whole Arrow batches as numpy spans, and their XXH64 hashes.

A word is a run of ``[^\\x20\\x09-\\x0D]``. Everything works on UTF-8 bytes of many texts at once, so no
Python object is made per word. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 2 << 20

# Fixed values of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def rows_in_steps(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each; at least one row per range."""
    _, offsets = utf8(texts)
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), len(texts))
        yield begin, end
        begin = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each text begins and ends in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    a = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2] if len(a) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass(frozen=True)
class Words:
    """Words of some texts: each is ``data[start:end]``, followed by one space; text ``i`` owns the
    words ``first[i]`` to ``first[i + 1]``. Consecutive words of a text are one slice of ``data``.
    ``at`` is where each word begins in the bytes that ``utf8`` gives."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def runs(self, k: int, whole_if_shorter: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of ``k`` words inside one text: first word, number of words, and runs per text (as offsets).

        With ``whole_if_shorter`` a text of 1 to ``k - 1`` words gives its whole sequence as one run.
        """
        n = self.counts
        per_text = np.maximum(n - k + 1, 0)
        if whole_if_shorter:
            per_text = np.where((n > 0) & (n < k), 1, per_text)
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        text = np.repeat(np.arange(len(n)), per_text)
        begin = np.arange(bounds[-1]) - bounds[text] + self.first[text]
        return begin, np.minimum(n[text], k), bounds

    def hashes(self, begin: np.ndarray, count: np.ndarray, seed: int = 0) -> np.ndarray:
        """XXH64 of each run of words, joined by one space."""
        if not len(begin):
            return np.zeros(0, np.uint64)
        at = self.start[begin]
        return xxh64(self.data, at, self.end[begin + count - 1] - at, seed)


def words(texts: pa.Array, lower: bool = False) -> Words:
    """The words of each text; ``lower`` maps A-Z to a-z first."""
    raw, offsets = utf8(texts)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return Words(raw, none, none, np.zeros(len(offsets), np.int64), none)
    solid = ~SPACE[raw]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    opens[edges] = solid[edges]
    number = np.cumsum(opens)
    at = np.flatnonzero(opens)
    inside = np.flatnonzero(solid)
    data = np.full(len(inside) + len(at), 0x20, np.uint8)
    data[np.arange(len(inside)) + number[inside] - 1] = raw[inside]
    if lower:
        data += ((data >= 65) & (data <= 90)).view(np.uint8) << np.uint8(5)
    # Bytes inside words before each word, plus one space for each word before it.
    before = np.searchsorted(inside, at)
    start = before + np.arange(len(at))
    end = np.append(start[1:], len(data)) - 1 if len(at) else start
    return Words(data, start, end, np.searchsorted(at, offsets), at)


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotated(acc + lane * P2, 31) * P1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * P2
    x = (x ^ (x >> np.uint64(29))) * P3
    return x ^ (x >> np.uint64(32))


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 0, block: int = 1 << 15) -> np.ndarray:
    """XXH64 of every slice ``data[start:start + length]``."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,)).copy()
    out = np.empty(len(start), np.uint64)
    for at in range(0, len(start), block):
        part = slice(at, at + block)
        out[part] = _xxh64(eights, padded, start[part].astype(np.int64), length[part].astype(np.int64), np.uint64(seed))
    return out


def _xxh64(eights: np.ndarray, data: np.ndarray, at: np.ndarray, length: np.ndarray, seed: np.uint64) -> np.ndarray:
    at = at.copy()
    h = np.full(len(at), seed + P5 if int(seed) + int(P5) < 1 << 64 else np.uint64((int(seed) + int(P5)) % (1 << 64)))
    stop = at + length
    long = np.flatnonzero(length >= 32)
    if len(long):
        h[long] = _stripes(eights, at, stop, long, int(seed))
    h += length.astype(np.uint64)
    todo = np.flatnonzero(stop - at >= 8)
    while len(todo):
        x = h[todo] ^ _round(np.zeros(1, np.uint64), eights[at[todo]])
        h[todo] = _rotated(x, 27) * P1 + P4
        at[todo] += 8
        todo = todo[stop[todo] - at[todo] >= 8]
    todo = np.flatnonzero(stop - at >= 4)
    if len(todo):
        x = h[todo] ^ ((eights[at[todo]] & np.uint64(0xFFFFFFFF)) * P1)
        h[todo] = _rotated(x, 23) * P2 + P3
        at[todo] += 4
    todo = np.flatnonzero(stop > at)
    while len(todo):
        x = h[todo] ^ (data[at[todo]].astype(np.uint64) * P5)
        h[todo] = _rotated(x, 11) * P1
        at[todo] += 1
        todo = todo[stop[todo] > at[todo]]
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def _stripes(eights: np.ndarray, at: np.ndarray, stop: np.ndarray, rows: np.ndarray, seed: int) -> np.ndarray:
    """The four lanes of inputs of 32 bytes or more, merged; moves ``at`` behind the stripes."""
    wrap = 1 << 64
    starts = [(seed + int(P1) + int(P2)) % wrap, (seed + int(P2)) % wrap, seed, (seed - int(P1)) % wrap]
    lanes = [np.full(len(rows), s, np.uint64) for s in starts]
    live = np.arange(len(rows))
    while len(live):
        here = at[rows[live]]
        for i, lane in enumerate(lanes):
            lane[live] = _round(lane[live], eights[here + 8 * i])
        at[rows[live]] += 32
        live = live[stop[rows[live]] - at[rows[live]] >= 32]
    h = _rotated(lanes[0], 1) + _rotated(lanes[1], 7) + _rotated(lanes[2], 12) + _rotated(lanes[3], 18)
    for lane in lanes:
        h = (h ^ _round(np.zeros(1, np.uint64), lane)) * P1 + P4
    return h


def chained(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive values of ``h`` (``len(h) - k + 1`` of them), by doubling."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, width = None, 0
    power, size = h, 1
    while True:
        if k & size:
            if out is None:
                out, width = power, size
            else:
                n = len(h) - width - size + 1
                out = mixed(out[:n] * P1 + power[width : width + n])
                width += size
        if size * 2 > k:
            return out[: len(h) - k + 1]
        n = len(power) - size
        power = mixed(power[:n] * P1 + power[size:])
        size *= 2
