"""Periodic runs of words, found by internal pattern matching.

The words of a slice of documents are numbered and all stretches of 1, 2, 4, ...
words get exact names by doubling, which also gives the suffix array. Of each
length L = 2**k from ``BLOCK`` on, the blocks at multiples of L are patterns. The
suffixes that begin with a block lie side by side in the suffix array; a wavelet
tree over the array answers range successor queries: the first, second and last
occurrence of the block in a neighbouring window of L places. Occurrences so near
to each other form one arithmetic progression, and a progression gives the
candidate periods. Each is then extended to both sides by the names.

Why nothing is missed: let a run have smallest period q and length >=
max(3 * BLOCK, 3 * q). For q < 2 * BLOCK let L be BLOCK, else the power of two
with L <= q < 2 * L. Among any 2 * L - 1 places is a multiple of L, so a block lies
in the run with its copy q places on, in the first or the second window behind it.
Three or more occurrences make a progression of step p, all in one stretch of
period p, as is the block. If the block's stretch and the copy's are the same
one, q is p; else they are shifts of each other by q in the run, which has both
of their starts or both of their ends inside.

Work is N log N for N words of a slice, or of one document that is longer,
whatever the words are: a block gives at most eight candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sheaf.llm.words import NOT_BLANK, Texts, slices

#: Length of the shortest blocks; a run has at least three times as many words.
BLOCK = 8
#: A run holds its period at least so often.
TIMES = 3

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


class Names:
    """Exact names of all stretches of 2**k words, and the suffix array."""

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        """``words``: a number for each word; ``owner``: its document. Stretches never leave a document."""
        n = len(words)
        key = owner.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(key, kind="stable")
        ends = np.searchsorted(owner, owner, "right")
        #: levels[k][i]: how many suffixes come before all those with the 2**k words from i on; -1 beyond the end
        self.levels: list[np.ndarray] = []
        name = np.full(n + 1, -1, np.int64)
        sorted_key = key[order]
        first = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1])) if n else np.empty(0, np.int64)
        sizes = np.diff(np.append(first, n))
        name[order] = np.repeat(first, sizes)
        active = np.flatnonzero(np.repeat(sizes > 1, sizes))
        self.levels.append(name)
        step = 1
        while len(active):
            at = order[active]
            behind = at + step
            inside = behind < ends[at]
            key = name[at] * (n + 1) + np.where(inside, name[np.minimum(behind, n)] + 1, 0)
            turn = np.argsort(key, kind="stable")
            at, key = at[turn], key[turn]
            order[active] = at
            new = np.append(True, key[1:] != key[:-1])
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(key)))
            name = name.copy()
            name[at] = np.repeat(active[first], sizes)
            active = active[np.repeat(sizes > 1, sizes)]
            self.levels.append(name)
            step *= 2
        self.suffixes = order

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x and from y on are the same (x < y)."""
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            out += (self.levels[k][x + out] == self.levels[k][y + out]).astype(np.int64) << k
        return out

    def back(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words before x and before y are the same (x < y)."""
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = x - out - (1 << k), y - out - (1 << k)
            same = (a >= 0) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])
            out += same.astype(np.int64) << k
        return out

    def stretch(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the longest stretch around ``at`` and ``at + period`` whose words ``period`` apart are equal."""
        return at - self.back(at, at + period), at + period + self.ahead(at, at + period)


class WaveletTree:
    """Numbers below their count, in wavelet matrix form: counts and order statistics of any interval."""

    def __init__(self, values: np.ndarray):
        self.count = len(values)
        self.bits = max(1, self.count.bit_length())
        self.zeros: list[np.ndarray] = []
        for b in range(self.bits - 1, -1, -1):
            is_zero = ((values >> b) & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(is_zero, dtype=np.int32)]).astype(np.int32))
            values = np.concatenate([values[is_zero], values[~is_zero]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the values at ``low`` to ``high`` (exclusive) are less than ``bound``."""
        out = np.zeros(len(low), np.int64)
        bound = np.minimum(bound, self.count)
        for zeros, b in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            low0, high0 = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            one = ((bound >> b) & 1) == 1
            out += np.where(one, high0 - low0, 0)
            low, high = np.where(one, zeros[-1] + low - low0, low0), np.where(one, zeros[-1] + high - high0, high0)
        return out

    def smallest(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value with ``rank`` smaller ones among those at ``low`` to ``high`` (exclusive)."""
        out = np.zeros(len(low), np.int64)
        for zeros, b in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            low0, high0 = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            one = rank >= high0 - low0
            out += one.astype(np.int64) << b
            rank = np.where(one, rank - (high0 - low0), rank)
            low, high = np.where(one, zeros[-1] + low - low0, low0), np.where(one, zeros[-1] + high - high0, high0)
        return out


def _progressions(names: Names, tree: WaveletTree, blocks, low, high, begin, end):
    """First, second (or -1) and last occurrence from ``begin`` up to ``end`` (exclusive); blocks without one are left out."""
    before, upto = tree.below(low, high, begin), tree.below(low, high, end)
    some = upto > before
    blocks, low, high, before, upto = (x[some] for x in (blocks, low, high, before, upto))
    first = tree.smallest(low, high, before)
    many = upto - before
    second = np.full(len(first), -1, np.int64)
    more = many > 1
    second[more] = tree.smallest(low[more], high[more], before[more] + 1)
    return blocks, first, second, first + (many - 1) * np.where(more, second - first, 0), many


def find_runs(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run, ordered by start and period.

    ``words``: a number for each word, in order; ``owner``: the document it is of,
    ascending. A run is a longest stretch of one document's words that are equal
    ``period`` apart, at least ``TIMES * period`` and ``TIMES * BLOCK`` words long.
    """
    names = Names(words, owner)
    n = len(words)
    found_at, found_period = [], []
    tree = None
    for k in range(BLOCK.bit_length() - 1, len(names.levels)):
        length = 1 << k
        name = names.levels[k]
        blocks = np.arange(0, n, length)
        sizes = np.bincount(name[:n], minlength=n)
        blocks = blocks[sizes[name[blocks]] > 1]
        if not len(blocks):
            continue
        tree = tree or WaveletTree(names.suffixes)
        low = name[blocks]
        high = low + sizes[low]
        windows = [(blocks + length, blocks + 2 * length)]
        if length == BLOCK:
            windows.append((blocks + 1, blocks + length))
        for begin, end in windows:
            at, first, second, last, many = _progressions(names, tree, blocks, low, high, begin, end)
            candidates = [(at, first - at), (at, last - at)]
            row = np.flatnonzero(many > 2)
            block, there, step = at[row], first[row], (second - first)[row]
            here_from, here_to = names.stretch(block, step)
            there_from, there_to = names.stretch(there, step)
            candidates += [(block, there_from - here_from), (block, there_to - here_to), (block, step)]
            for place, period in candidates:
                good = period > 0
                found_at.append(place[good])
                found_period.append(period[good])
    if not found_at:
        return (np.empty(0, np.int64),) * 3
    pairs = np.unique(np.stack([np.concatenate(found_at), np.concatenate(found_period)]), axis=1)
    at, period = pairs[0], pairs[1]
    inside = at + period < n
    at, period = at[inside], period[inside]
    start, end = names.stretch(at, period)
    run = end - start >= np.maximum(TIMES * period, TIMES * BLOCK)
    start, end, period = start[run], end[run], period[run]
    # the same stretch has its multiples as periods too
    order = np.lexsort([period, end, start])
    start, end, period = start[order], end[order], period[order]
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort([period, start])
    return start[order], end[order], period[order]


def numbered(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number (equal for equal words), text, start and length of every word, and the bytes of all words in a row."""
    starts, ends, owner = texts.words(NOT_BLANK)
    held = texts.data[NOT_BLANK[texts.data]]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(held)])
    codes = pc.dictionary_encode(words).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, owner, bounds[:-1], ends - starts, held


def _joined(kept: np.ndarray, owner: np.ndarray, starts: np.ndarray, lengths: np.ndarray, held: np.ndarray, n: int) -> pa.Array:
    """Each text's kept words, joined by one space."""
    owner, starts, lengths = owner[kept], starts[kept], lengths[kept]
    first = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
    spaces = np.cumsum(~first)
    before = np.concatenate([[0], np.cumsum(lengths)])
    source = np.arange(before[-1]) + np.repeat(starts - before[:-1], lengths)
    out = np.full(before[-1] + (spaces[-1] if len(spaces) else 0), 0x20, np.uint8)
    out[np.arange(before[-1]) + np.repeat(spaces, lengths)] = held[source]
    sizes = np.bincount(owner, lengths, n).astype(np.int64) + np.maximum(np.bincount(owner, minlength=n) - 1, 0)
    at = np.concatenate([[0], np.cumsum(sizes)])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(at), pa.py_buffer(out)).cast(pa.string())


def examine(texts: Texts) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of every text: number of words, runs, and the text without the repetitions."""
    codes, owner, starts, lengths, held = numbered(texts)
    n = len(texts)
    n_words = np.bincount(owner, minlength=n)
    before = np.concatenate([[0], np.cumsum(n_words)])
    start, end, period = find_runs(codes, owner)
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
    whose = owner[start]
    fields = [pa.array(x, pa.int64()) for x in (start - before[whose], end - start, period)]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=n))]).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, RUN.names))
    return n_words, runs, _joined(kept, owner, starts, lengths, held, n)


def collapse_runs(docs: DataFrame, prefix: str = "", text: str = "text") -> DataFrame:
    """``docs`` with the periodic runs of every whole text; names of added columns are led by ``prefix``.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D, numbered from 0.
    n_words; runs: start, length and period of each run, by start, then period;
    collapsed: the words joined by one space, without those that a run contains
    after its first period.

    A null or empty text has no words, no runs and an empty ``collapsed``.
    Repeated rows are judged each; a run never crosses rows. Other columns come
    through; equal names are an error: pass a prefix. A worker holds a slice of
    1 MB or one longer text, at about 300 bytes a word.
    """
    added = [
        T.StructField(prefix + "n_words", T.LongType()),
        T.StructField(prefix + "runs", T.ArrayType(RUN)),
        T.StructField(prefix + "collapsed", T.StringType()),
    ]
    clash = {f.name for f in added} & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist already, choose a prefix: {sorted(clash)}")
    where = docs.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(where)):
                n_words, runs, collapsed = examine(part)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(part.first, len(part)).columns, pa.array(n_words, pa.int64()), runs, collapsed],
                    names=[*batch.schema.names, *[f.name for f in added]],
                )

    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, *added]))
