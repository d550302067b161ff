"""Benchmark decontamination with suffix arrays over the training texts.

Each task sorts the word suffixes of its documents, a shard of a few MB at a
time, and binary-searches every benchmark suffix in it. A window of the
benchmark that occurs gives the places it occurs at; windows that follow each
other on both sides join to the longest verbatim matches.

The benchmark is written to the shared folder in blocks of bounded size, which
the tasks read one at a time; all documents are held against all blocks. Neither
the driver nor a task holds more than one block, so the benchmark may be larger
than the memory of either. A benchmark of one block is read once a task, a larger
one once for each slice of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.files import opened
from sheaf.llm.store import new_path
from sheaf.llm.words import ALNUM, LOWER, Texts, prefix_sums, slices, stretch_hashes

#: Bytes of benchmark text that a task holds at once, about.
BLOCK = 16 << 20

MATCH = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("item_word", T.IntegerType()),
        T.StructField("doc_word", T.IntegerType()),
        T.StructField("n_words", T.IntegerType()),
    ]
)


@dataclass
class Block:
    """Some benchmark items: their words, and their windows by place."""

    ids: list[str]
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    window: np.ndarray  # first word of each window
    length: np.ndarray  # words in it
    item: np.ndarray  # its item
    place: np.ndarray  # its place in the item


def _words(texts: Texts):
    data = LOWER[texts.data]
    starts, ends, owner = texts.words(ALNUM)
    return data, starts, ends, owner, stretch_hashes(prefix_sums(data), starts, ends)


def block_of(items: pa.Table, n: int) -> Block:
    texts = next(slices(items.column("text").cast(pa.large_string()).combine_chunks(), 1 << 62))
    data, starts, ends, owner, hashes = _words(texts)
    counts = np.bincount(owner, minlength=len(items))
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    windows = np.where(counts == 0, 0, np.maximum(1, counts - n + 1))
    item = np.repeat(np.arange(len(items)), windows)
    place = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
    return Block(
        items.column("item_id").to_pylist(),
        data,
        starts,
        ends,
        hashes,
        first[item] + place,
        np.minimum(counts, n)[item],
        item,
        place,
    )


def write_blocks(benchmark: DataFrame) -> list[str]:
    """Write the benchmark in blocks of about ``BLOCK`` bytes, a file each, and name the files. The driver sees no text."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").alias("text")
    ).where("length(text) > 0")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not size:
        return []
    parts = -(-size // BLOCK)
    path = new_path(benchmark.sparkSession, "benchmark")
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    dealt.repartition(parts, "block").write.partitionBy("block").parquet(path)
    return sorted(benchmark.sparkSession.read.parquet(path).inputFiles())


def read_block(file: str, n: int) -> Block:
    with opened(file) as data:
        items = pq.read_table(data, columns=["item_id", "text"])
    return block_of(items.sort_by([("item_id", "ascending"), ("text", "ascending")]), n)


def held_blocks(files: list[str], n: int) -> Callable[[], Iterator[Block]]:
    """All blocks, one in memory at a time; the last one read stays for the next round, which begins with it."""
    held: list[tuple[str, Block]] = []

    def blocks() -> Iterator[Block]:
        first = held[0][0] if held else None
        for file in sorted(files, key=lambda f: f != first):
            if not held or held[0][0] != file:
                held.clear()
                held.append((file, read_block(file, n)))
            yield held[0][1]

    return blocks


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by at least ``depth`` ids from there on.

    Doubling: pairs first, then each round sorts by twice as many ids, but only
    the positions that still tie. ``rank`` is where a position's group begins.
    """
    n = len(ids)
    key = ids.astype(np.int64) * (int(ids.max(initial=0)) + 2)
    key[:-1] += ids[1:] + 1
    order = np.argsort(key)
    tied, rank, width = np.arange(n), np.zeros(n, np.int64), 2
    part, key = order, key[order]
    while True:
        begins = np.ones(len(part), bool)
        begins[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(begins)
        rank[part] = np.repeat(tied[first], np.diff(np.append(first, len(part))))
        ends = np.ones(len(part), bool)
        ends[:-1] = begins[1:]
        tied = tied[~(begins & ends)]
        if width >= depth or not len(tied):
            return order
        part = order[tied]
        ahead = part + width
        key = rank[part] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        sorting = np.argsort(key)
        part, key = part[sorting], key[sorting]
        order[tied] = part
        width *= 2


def _bound(ids, order, depth, low, high, value, right):
    """Per query: the first place in [low, high) whose id at ``depth`` is not below (or, right: above) value."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) >> 1
        at = ids[np.minimum(order[np.minimum(middle, len(order) - 1)] + depth, len(ids) - 1)]
        less = (at <= value) if right else (at < value)
        low = np.where(open_ & less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)


def find(ids: np.ndarray, order: np.ndarray, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """The interval of ``order`` whose suffixes begin with each query ``words[start:start + length]``."""
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
    for depth in range(int(lengths.max(initial=0))):
        live = np.flatnonzero((high > low) & (lengths > depth))
        if not len(live):
            break
        value = words[starts[live] + depth]
        here = _bound(ids, order, depth, low[live], high[live], value, False)
        end = _bound(ids, order, depth, here, high[live], value, True)
        low[live], high[live] = here, end
    return low, high


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the intervals, with the number of the interval."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which], which


def _same_words(data, starts, ends, one, block: Block, other) -> np.ndarray:
    """Whether the words are the same bytes, not only the same hash."""
    pairs, back = np.unique(np.stack([one, other]), axis=1, return_inverse=True)
    a, b = starts[pairs[0]], block.starts[pairs[1]]
    length = ends[pairs[0]] - a
    same = length == block.ends[pairs[1]] - b
    length = np.where(same, length, 0)
    step, which = _spread(np.zeros_like(length), length)
    differ = data[a[which] + step] != block.data[b[which] + step]
    same[which[differ]] = False
    return same[back.ravel()]


def matches_in(texts: Texts, blocks, n: int) -> list[tuple]:
    """Per text: words, hit words, items (as indices into all ids), longest matches."""
    data, starts, ends, owner, hashes = _words(texts)
    counts = np.bincount(owner, minlength=len(texts))
    found: list[tuple] = []
    vocabulary, inverse = np.unique(hashes, return_inverse=True)
    # one 0 after each text: no query holds it, so no match leaves a text
    ids = np.zeros(len(hashes) + len(texts), np.int64)
    word_at = np.arange(len(hashes)) + owner
    ids[word_at] = inverse + 1
    text_at = np.concatenate([[0], np.cumsum(counts + 1)])
    order = suffix_array(ids, n) if len(hashes) else np.empty(0, np.int64)
    edge = np.zeros(len(ids) + 1, np.int64)
    for block in blocks:
        if not len(hashes) or not len(block.window):
            continue
        place = np.minimum(np.searchsorted(vocabulary, block.hashes), len(vocabulary) - 1)
        words = np.where(vocabulary[place] == block.hashes, place + 1, -1)
        low, high = find(ids, order, words, block.window, block.length)
        member, which = _spread(low, np.maximum(low, high))
        if not len(member):
            continue
        at = order[member]
        text = np.searchsorted(text_at, at, "right") - 1
        step, hit = _spread(np.zeros(len(which), np.int64), block.length[which])
        good = _same_words(data, starts, ends, at[hit] - text[hit] + step, block, block.window[which][hit] + step)
        whole = np.ones(len(which), bool)
        whole[hit[~good]] = False
        at, text, which = at[whole], text[whole], which[whole]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + block.length[which], -1)
        found.append((block, text, at - text_at[text], which))
    covered = np.cumsum(edge)[:-1] > 0
    hits = np.concatenate([[0], np.cumsum(covered)])
    out = [[int(counts[t]), int(hits[text_at[t + 1]] - hits[text_at[t]]), [], []] for t in range(len(texts))]
    for block, text, doc_word, which in found:
        item, place = block.item[which], block.place[which]
        for t, i in np.unique(np.stack([text, item]), axis=1).T.tolist():
            out[t][2].append(block.ids[i])
        # windows one word on in both texts belong to one longer match
        order = np.lexsort((place, doc_word - place, item, text))
        text, item, place, doc_word, size = (x[order] for x in (text, item, place, doc_word, block.length[which]))
        new = np.ones(len(order), bool)
        new[1:] = (
            (text[1:] != text[:-1])
            | (item[1:] != item[:-1])
            | (doc_word[1:] - place[1:] != doc_word[:-1] - place[:-1])
            | (place[1:] != place[:-1] + 1)
        )
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(order)) - 1
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            length = int(place[e] - place[b] + size[e])
            out[text[b]][3].append((block.ids[item[b]], int(place[b]), int(doc_word[b]), length))
    return out


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, prefix: str = "") -> DataFrame:
    """``docs`` with what of the benchmark their ``text`` holds.

    Words are runs of ASCII letters and digits and of characters from 0x80 on,
    A-Z in lower case. A window is ``n`` words of an item that follow each other,
    or the item if it has fewer. Added columns, names led by ``prefix``: n_words,
    n_hit (words inside an occurrence of a window), n_items, items_sha256 (of the
    item ids, sorted as strings, comma-joined) and matches (longest verbatim
    matches with their places).

    A null or empty text has no words; an item without words has no windows;
    repeated items all count; a null item id is written ``null``. Other columns
    come through whatever their names, but names equal to an added column are an
    error: pass a prefix.
    """
    added = [
        T.StructField(prefix + "n_words", T.LongType()),
        T.StructField(prefix + "n_hit", T.LongType()),
        T.StructField(prefix + "n_items", T.LongType()),
        T.StructField(prefix + "items_sha256", T.StringType()),
        T.StructField(prefix + "matches", T.ArrayType(MATCH)),
    ]
    clash = {f.name for f in added} & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist already, choose a prefix: {sorted(clash)}")
    files = write_blocks(benchmark)
    where = docs.columns.index("text")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    match = pa.list_(
        pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())])
    )

    def search(batches):
        blocks = held_blocks(files, n)
        for batch in batches:
            rows: list[tuple] = []
            for texts in slices(batch.column(where)):
                rows += matches_in(texts, blocks(), n)
            columns = [
                pa.array([r[0] for r in rows], kinds[0]),
                pa.array([r[1] for r in rows], kinds[1]),
                pa.array([len(r[2]) for r in rows], kinds[2]),
                pa.array([_digest(r[2]) for r in rows], kinds[3]),
                pa.array(
                    [[dict(zip(("item_id", "item_word", "doc_word", "n_words"), m, strict=True)) for m in sorted(r[3])] for r in rows],
                    match,
                ),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], names=[*batch.schema.names, *[f.name for f in added]]
            )

    return docs.mapInArrow(search, T.StructType([*docs.schema.fields, *added]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` without those that hold a window of the benchmark; the columns stay as they are."""
    mark = "_leak_"
    found = find_contamination(docs, benchmark, n, mark)
    return found.where(F.col(mark + "n_hit") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
