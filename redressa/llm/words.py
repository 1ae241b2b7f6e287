"""Words of many texts at once, as byte ranges and 64-bit hashes; runs inside tasks on Arrow columns."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Temporary arrays of eight bytes per text byte are made for this many bytes at a time.
SEGMENT = 1 << 18
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

WHITE = np.zeros(256, bool)
WHITE[9:14] = WHITE[32] = True
#: For words of letters: everything below 128 but a-z separates; texts are lower case by then.
NOT_LETTER = np.arange(256) < 128
NOT_LETTER[97:123] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    """``first[d]:first[d + 1]`` are the words of text ``d``; ``starts`` and ``ends`` point into ``data``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def stop(self) -> np.ndarray:
        """For each word, the end of its text in words."""
        return np.repeat(self.first[1:], self.counts)


@lru_cache(maxsize=8)
def _powers(base: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    def table(x: int) -> np.ndarray:
        out = np.full(length, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return table(base), table(pow(base, -1, 1 << 64))


def powers(base: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``length`` powers of an odd number and of its inverse, modulo 2**64."""
    return _powers(base, 1 << max(16, int(length - 1).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    return (np.zeros(0, np.uint8) if held is None else np.frombuffer(held, np.uint8)), offsets


def _cuts(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> list[int]:
    """Ends of segments at the start of a text or after white space, so that no word is split."""
    cuts, at, end = [int(offsets[0])], int(offsets[0]), int(offsets[-1])
    while at < end:
        aim = min(at + SEGMENT, end)
        if aim < end:
            text = int(offsets[np.searchsorted(offsets, aim, "right") - 1])
            white = np.flatnonzero(gap[data[at:aim]][::-1][: 1 << 16])
            found = max(text, aim - int(white[0]) if len(white) else at)
            if found <= at:  # one word longer than a segment
                ahead = np.flatnonzero(gap[data[aim:end]])
                found = min(int(offsets[np.searchsorted(offsets, aim, "right")]), aim + int(ahead[0]) + 1 if len(ahead) else end)
            aim = found
        cuts.append(aim)
        at = aim
    return cuts


def words_of(column: pa.Array, lower: bool = False, base: int = BASE_A, gap: np.ndarray = WHITE) -> Words:
    """Runs of bytes that are no gap (space and 9 to 13), with a hash of each; ``lower`` folds A-Z only."""
    data, offsets = text_bytes(column)
    if lower and len(data):
        own = slice(int(offsets[0]), int(offsets[-1]))  # a slice of a column shares the bytes of the whole
        folded = np.empty_like(data)
        folded[own] = LOWER[data[own]]
        data = folded
    starts, ends, hashes = [], [], []
    cuts = _cuts(data, offsets, gap)
    for lo, hi in zip(cuts, cuts[1:]):
        part = data[lo:hi]
        white = gap[part]
        edge = white.copy()  # no word goes on into this byte from the one before
        inner = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        edge[inner] = True
        edge[0] = True
        begin = ~white
        begin[1:] &= white[:-1] | edge[1:]
        last = ~white
        last[:-1] &= edge[1:]
        s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
        power, inverse = powers(base, hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * inverse[s]))
        starts.append(s + lo)
        ends.append(e + lo)
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    starts = joined(starts, np.int64)
    return Words(data, starts, joined(ends, np.int64), np.searchsorted(starts, offsets), joined(hashes, np.uint64))


def rolling(hashes: np.ndarray, size: int, base: int = BASE_A) -> np.ndarray:
    """Hash of ``size`` hashes in a row, from each place that has so many; the caller drops those across texts."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    out = np.empty(len(hashes) - size + 1, np.uint64)
    for lo in range(0, len(out), SEGMENT):
        part = hashes[lo : lo + SEGMENT + size - 1]
        power, inverse = powers(base, len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=total[1:])
        n = len(part) - size + 1
        out[lo : lo + n] = mix((total[size:] - total[:-size]) * inverse[:n])
    return out


def row_groups(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20):
    """Slices of a batch with about ``limit`` bytes of text; a longer text is a slice of its own."""
    lengths = np.diff(text_bytes(batch.column(column))[1])
    at, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += int(n)
    if at < len(lengths):
        yield batch.slice(at)
