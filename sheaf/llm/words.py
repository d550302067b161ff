"""Whole texts of an Arrow batch as numpy arrays: bytes, words, word hashes.

Texts are handled side by side in one byte buffer, in slices of a few MB, so
memory is bounded by the slice or by one document where that is longer.
Working on bytes is exact here: in UTF-8 no byte of a longer character is
below 0x80, and every class of word characters used treats characters from
0x80 on alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20

#: Bytes that are not blanks: anything but 0x20 and 0x09 to 0x0D.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits and every byte of a longer character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        out = np.empty(max(n, SLICE + 64), np.uint64)
        out[0] = 1
        done = 1
        while done < len(out):
            step = min(done, len(out) - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        _powers[base] = known = out
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (data[k] + 1) * base**k for i <= k < j, modulo 2**64."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.multiply(data.astype(np.uint64) + np.uint64(1), powers(_BASE, len(data)), out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches, wherever they lie; the length counts too."""
    shifted = (sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts]
    return mixed(shifted + mixed((ends - starts).astype(np.uint64)))


@dataclass
class Texts:
    """Some texts side by side: text i is ``data[at[i]:at[i + 1]]``."""

    first: int
    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def words(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every word: a longest run of ``kind`` bytes in a text."""
        inside = kind[self.data]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[self.at[:-1][self.at[:-1] < len(inside)]] = False
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        last = self.at[1:][self.at[1:] > 0] - 1
        after[last] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(self.at, starts, "right") - 1


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[Texts]:
    """The column's texts in slices of at most ``limit`` bytes or one text; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield Texts(i, data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def runs_in(owner: np.ndarray, n: int) -> np.ndarray:
    """Where n words of one text begin. ``owner``: each word's text."""
    if len(owner) < n:
        return np.empty(0, np.int64)
    return np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])


def run_hashes(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each start on, order counting."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + hashes[starts + k]
    return mixed(out)
