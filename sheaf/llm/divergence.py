"""How far sources differ in their words: all pairs of a language's sources, and each source's own terms.

A source's counts of the kept terms are a column as long as the vocabulary.
Terms with equal counts in all sources are one row with a multiplicity; rows are
reordered so that equal counts lie side by side, each column is run-length
encoded, and a pair of columns is compared run by run: the runs' boundaries are
intersected, and the difference within a piece is multiplied by its length. The
vocabulary of a language is dealt into slices of bounded size by the hash of the
counts; the slices' sums are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.store import stored
from sheaf.llm.words import LOWER, slices

#: Bytes of terms: ASCII letters and every byte of a longer character.
TERM = np.zeros(256, bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Counts (of one source and one row of the vocabulary) in a slice.
SLICE_COUNTS = 200_000
#: Sources whose pairs one task forms.
BLOCK_SOURCES = 256
#: Columns, the fullest, by which the rows of a slice are ordered. The order moves run lengths, never results.
ORDER_BY = 16

SCALE, ADDED = 1_000_000_000, 5


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); nulls are empty strings."""
    texts = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = (batch.column(k).dictionary_encode() for k in (0, 1))
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            for part in slices(batch.column(2), 4 << 20):
                starts, ends, owner = part.words(TERM)
                bounds = np.concatenate([[0], np.cumsum(ends - starts)])
                held = LOWER[part.data[TERM[part.data]]]
                words = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(held)]
                ).dictionary_encode()
                n = max(len(words.dictionary), 1)
                # first the terms of each document, then those of each group
                of_document, times = np.unique(owner * n + words.indices.to_numpy(), return_counts=True)
                of_group, at = np.unique(group[part.first + of_document // n] * n + of_document % n, return_inverse=True)
                lang, source = np.divmod(of_group // n, len(sources.dictionary))
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.dictionary.take(pa.array(lang)),
                        sources.dictionary.take(pa.array(source)),
                        words.dictionary.take(pa.array(of_group % n)).cast(pa.large_string()).cast(pa.string()),
                        pa.array(np.bincount(at, times, len(of_group)).astype(np.int64)),
                        pa.array(np.bincount(at, minlength=len(of_group)).astype(np.int64)),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

    counted = texts.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)), exact."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + ADDED).cast("decimal(19,0)")
    return F.expr("1L") + F.call_function("div", above, (total + ADDED * terms).cast("decimal(19,0)"))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The same for an array of counts, by long division; exact while 1000 * (total + ADDED * terms) fits 63 bits."""
    below = total + ADDED * terms
    out, rest = np.divmod(counts + ADDED, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


def _columns(table: pa.Table, sources: pa.Array, totals: np.ndarray, terms: int) -> tuple[list, int]:
    """Every source's column as starts of runs and their shares, and the number of terms in all."""
    held = table.column("held").combine_chunks()
    bounds = held.offsets.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(held)), np.diff(bounds))
    entries = held.flatten()
    column = pc.index_in(entries.field("source"), sources).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = entries.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
    fullest = np.argsort(-np.bincount(column, minlength=len(sources)), kind="stable")[:ORDER_BY]
    keys = np.zeros((len(fullest), len(held)), np.int64)
    for k, c in enumerate(fullest):
        keys[k, row[column == c]] = counts[column == c]
    order = np.lexsort(keys[::-1]) if len(held) else np.empty(0, np.int64)
    place = np.empty(len(held), np.int64)
    place[order] = np.arange(len(held))
    many = table.column("terms").to_numpy().astype(np.int64)[order]
    before = np.concatenate([[0], np.cumsum(many)])  # places of the vocabulary
    by = np.lexsort([place[row], column])
    at, counts, column = place[row][by], counts[by], column[by]
    cuts = np.searchsorted(column, np.arange(len(sources) + 1))
    out = []
    for c in range(len(sources)):
        own, n = at[cuts[c] : cuts[c + 1]], counts[cuts[c] : cuts[c + 1]]
        # a zero run may begin behind each count; a count of the same place takes its turn
        starts, values = np.concatenate([[0], own + 1, own]), np.concatenate([np.zeros(len(own) + 1, np.int64), n])
        turn = np.lexsort([np.arange(len(starts)), starts])
        starts, values = starts[turn], values[turn]
        last = np.append(starts[1:] != starts[:-1], True) & (starts < len(held))
        starts, values = starts[last], values[last]
        new = np.append(True, values[1:] != values[:-1])[: len(values)]
        out.append((before[starts[new]], shares(values[new], int(totals[c]), terms)))
    return out, int(before[-1])


def _compare(one: tuple, other: tuple, length: int) -> int:
    """Sum of the differences over the whole vocabulary, a piece between run boundaries at a time."""
    pieces = np.union1d(one[0], other[0])
    f = np.abs(
        one[1][np.searchsorted(one[0], pieces, "right") - 1] - other[1][np.searchsorted(other[0], pieces, "right") - 1]
    )
    return int((f * np.diff(np.append(pieces, length))).sum())


def _pairs(rows: pa.Table, groups: pa.Table) -> pa.Table:
    """The sums of one slice for the pairs whose first source is in one block."""
    groups = groups.sort_by("source")
    sources = groups.column("source").combine_chunks()
    lang, block = groups.column("lang")[0], groups.column("block")[0].as_py()
    totals, terms = groups.column("total").to_numpy(), groups.column("terms")[0].as_py()
    columns, length = _columns(rows, sources, totals, terms) if len(rows) else ([], 0)
    left, right, value = [], [], []
    for g in range(block * BLOCK_SOURCES, min((block + 1) * BLOCK_SOURCES, len(sources))):
        left.append(np.full(len(sources) - g - 1, g))
        right.append(np.arange(g + 1, len(sources)))
        value += [_compare(columns[g], columns[h], length) if length else 0 for h in range(g + 1, len(sources))]
    left, right = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (left, right))
    return pa.table(
        {
            "lang": pa.array([lang.as_py()] * len(left), pa.string()),
            "left": sources.take(pa.array(left)),
            "right": sources.take(pa.array(right)),
            "value": pa.array(value, pa.int64()),
        }
    )


def audit_sources(docs: DataFrame, documents: int = 30, top: int = 50) -> DataFrame:
    """Pairs of sources and the terms that stand out in each.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased.
    A language keeps the V terms that at least ``documents`` of its rows hold. A
    source of it with N occurrences of kept terms gives a term with ``count`` of
    them p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)); so does the language.

    lang, source, part, item, value, rank. Part ``pair``: item is each other source
    of the language, value the sum over all kept terms of the absolute difference
    of their p. Part ``term``: item is a kept term of the source whose p is above
    the language's, value the difference; the ``top`` largest only. Ranks go by
    value descending, then item.

    Null text, lang and source count as ''. Sources without terms take part with
    counts of 0; a language without kept terms has pairs of value 0. Repeated rows
    count each. Other columns are not read. Without rows the result is empty. Rows
    of the result grow with the square of a language's sources, as asked for.
    """
    counts = count_terms(docs)
    kept = stored(
        counts.groupBy("lang", "term")
        .agg(
            F.sum("docs").alias("docs"),
            F.sum("n").alias("total"),
            F.array_sort(F.collect_list(F.struct("source", "n"))).alias("held"),
        )
        .where(F.col("docs") >= documents)
        .drop("docs"),
        "terms",
    )
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    each = kept.select("lang", "term", "total", F.inline("held"))
    languages = (
        named.distinct()
        .groupBy("lang")
        .agg(F.count("*").alias("sources"))
        .join(
            kept.groupBy("lang").agg(
                F.count("*").alias("terms"), F.sum("total").alias("all"), F.sum(F.size("held")).alias("counts")
            ),
            "lang",
            "left",
        )
        .fillna(0)
    )
    groups = stored(
        named.distinct()
        .join(each.groupBy("lang", "source").agg(F.sum("n").alias("of_source")), ["lang", "source"], "left")
        .join(languages, "lang")
        .select("lang", "source", F.coalesce("of_source", F.lit(0)).alias("of_source"), "sources", "terms", "all", "counts"),
        "groups",
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    whole = groups.select("lang", "source", "of_source", "terms", "all")
    p, q = share(F.col("n"), F.col("of_source"), F.col("terms")), share(F.col("total"), F.col("all"), F.col("terms"))
    outstanding = (
        each.join(whole, ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), (p - q).alias("value"))
        .where("value > 0")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
    )

    n_slices = F.greatest(F.lit(1), F.ceil(F.col("counts") / SLICE_COUNTS)).cast("int")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("sources") / BLOCK_SOURCES)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = (
        kept.groupBy("lang", "held")
        .agg(F.count("*").alias("terms"))
        .join(groups.groupBy("lang").agg(F.max("counts").alias("counts"), F.max("sources").alias("sources")), "lang")
        .select("lang", "held", "terms", F.pmod(F.xxhash64("held"), n_slices).cast("int").alias("slice"), "sources")
        .select("lang", "held", "terms", "slice", numbers(n_blocks).alias("block"))
    )
    members = groups.select(
        "lang", "source", F.col("of_source").alias("total"), "terms", "sources", numbers(n_slices).alias("slice")
    ).select("lang", "source", "total", "terms", "slice", numbers(n_blocks).alias("block"))
    keys = ("lang", "slice", "block")
    sums = (
        rows.groupBy(*keys)
        .cogroup(members.groupBy(*keys))
        .applyInArrow(_pairs, "lang string, left string, right string, value long")
        .groupBy("lang", "left", "right")
        .agg(F.sum("value").alias("value"))
    )
    both = sums.select(
        "lang",
        F.inline(
            F.array(
                F.struct(F.col("left").alias("source"), F.col("right").alias("item")),
                F.struct(F.col("right").alias("source"), F.col("left").alias("item")),
            )
        ),
        "value",
    )
    ranked = both.withColumn("rank", F.row_number().over(order))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return (
        ranked.withColumn("part", F.lit("pair"))
        .select(*columns)
        .unionByName(outstanding.withColumn("part", F.lit("term")).select(*columns))
    )
