"""Jaccard self-join of documents as sets of word n-grams, exact, and its components.

Jaccard distance is a metric: a pivot cuts documents into the cells of its
nearest pivots, and two documents within distance r of each other are both in
the cell of one of them if a document also enters every cell whose pivot is at
most 2 r farther than its nearest. Over a whole corpus this alone fails:
unrelated documents are at distance 1 from every pivot and would enter all cells.
The first regions therefore come from the pigeonhole principle. The n-grams are
dealt into more classes than two linked sets may differ in, so some class is the
same in both; documents that agree in a class belong to one region. Inside a
region, where distances differ, pivots, cells and windows do the join, again
and again until regions are small.

Equal sets are one document in all of this.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sheaf.llm.graph import components
from sheaf.llm.store import stored
from sheaf.llm.words import LOWER, NOT_BLANK, Texts, mixed, prefix_sums, run_hashes, runs_in, slices, stretch_hashes

#: n-grams of one region that a single task joins; larger regions are cut by pivots first.
REGION = 4_000_000
#: Documents that are compared directly.
LEAF = 256
PIVOTS = 4
#: Times that a region is cut over the cluster; what is still larger is joined by pairs of blocks.
CUTS = 4
#: Cells of a cut may hold so many times the region; above it, pairs of blocks take their place.
OVERLAP = 1.5
#: Buckets of the histogram that bounds how far two sets can agree.
BUCKETS = 1024
SALTS = 16
#: Documents sampled for common grams, and the most of these that are broadcast (8 bytes each).
SAMPLE, COMMON = 20_000, 500_000


@dataclass(frozen=True)
class Rule:
    """``n`` words a gram; sets link when 100 * intersection >= percent * union."""

    n: int
    percent: int

    def linked(self, common, size, other):
        return 100 * common >= self.percent * (size + other - common)

    def differ(self, size: int) -> int:
        """How many grams a set linked to one of ``size`` can differ in, if not smaller."""
        return (100 - self.percent) * size // self.percent

    @property
    def radius(self) -> float:
        return 1 - self.percent / 100


def gram_sets(texts: Texts, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of every text; a text of fewer words is one gram, without words none."""
    data = LOWER[texts.data]
    starts, ends, owner = texts.words(NOT_BLANK)
    hashes = stretch_hashes(prefix_sums(data), starts, ends)
    at = runs_in(owner, n)
    grams, gram_owner = run_hashes(hashes, at, n), owner[at] if len(at) else at
    words = np.searchsorted(owner, np.arange(len(texts) + 1))
    bounds = np.searchsorted(gram_owner, np.arange(len(texts) + 1))
    out = []
    for t in range(len(texts)):
        count = words[t + 1] - words[t]
        if count >= n or not count:
            out.append(np.unique(grams[bounds[t] : bounds[t + 1]]))
        else:
            short = run_hashes(hashes, words[t : t + 1], int(count))
            out.append(mixed(short + np.uint64(count)))
    return out


#: A word, as a Java regular expression.
A_WORD = r"[^\x20\x09-\x0D]"


def set_hash(grams: np.ndarray) -> np.uint64:
    return mixed(mixed(grams).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(grams)))[0]


def level_edges(size: int) -> list[int]:
    """Where levels begin: 1, 2, 3, 4, 6, 8, 12, 16, ..., two per doubling, up to one beyond ``size``."""
    edges = [1, 2]
    while edges[-1] <= size:
        edges += [3 * edges[-1] // 2, 2 * edges[-1]]
    return edges


def class_hashes(grams: np.ndarray, rule: Rule, common: np.ndarray) -> np.ndarray:
    """What the set shares at least one of with every set it links to, but for equal ones.

    Sizes fall into levels; a pair meets at the smaller set's level, so a set also
    serves the levels below in which a linked set can lie. A level has more
    classes than a pair of it can differ in, so one is the same in both.

    A class of few grams is alike in unrelated sets, and the larger the corpus,
    the more of them it ties together. So a set hands in its strongest classes
    only, those with the most grams, of which any outside ``common`` counts twice:
    one class more than it can differ in, and those as strong as the last. Of two
    linked sets take the one that asks for more strength: one of its classes is the
    same in the other, which hands it in too, since it asks for no more. So nothing
    is lost; empty classes are the last.
    """
    size, out = len(grams), []
    edges = level_edges(size)
    level = int(np.searchsorted(edges, size, "right")) - 1
    spread = mixed(grams ^ np.uint64(0x5851F42D4C957F2D))
    weight = np.full(size, 2)
    if len(common):
        weight -= common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams
    for k in range(level, -1, -1):
        largest = edges[k + 1] - 1
        if k < level and 100 * largest < rule.percent * size:
            break
        differ = rule.differ(largest)
        if not differ:
            continue
        classes = differ + 2 + differ // 2
        of = (spread % np.uint64(classes)).astype(np.int64)
        sums = np.zeros(classes, np.uint64)
        order = np.argsort(of)
        ranked = of[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        sums[ranked[first]] = np.add.reduceat(mixed(spread[order]), first)
        strength = np.bincount(of, weights=weight, minlength=classes)
        last = classes - 1 - min(differ, rule.differ(size))
        names = np.flatnonzero(strength >= np.partition(strength, last)[last])
        out.append(mixed(sums[names] + mixed(names.astype(np.uint64) + np.uint64(k << 40))))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_h1, _h2``, 128 bits of the text: with doc_id they name a row up to rows equal in both."""
    return docs.withColumns({"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit("second"), "text")})


def with_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """``docs`` with ``n_shingles`` and ``set``, the set's hash, null for the empty set."""
    where = docs.columns.index("text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(where)):
                sets = gram_sets(part, rule.n)
                sizes = np.array([len(s) for s in sets])
                hashes = np.array([set_hash(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(part.first, len(part)).columns,
                        pa.array(sizes, pa.int64()),
                        pa.array(hashes, mask=sizes == 0),
                    ],
                    names=[*batch.schema.names, "n_shingles", "set"],
                )

    added = [T.StructField("n_shingles", T.LongType()), T.StructField("set", T.LongType())]
    return docs.mapInArrow(measure, T.StructType([*docs.schema.fields, *added]))


def common_grams(docs: DataFrame, rule: Rule, most: int = SAMPLE) -> np.ndarray:
    """Grams that two different sets of a bounded sample of documents share, sorted.

    Which grams are in it changes the work, not the result.
    """
    sample = docs.select("doc_id").orderBy(F.xxhash64("doc_id")).limit(most).select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("text").dropDuplicates()

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                sets = gram_sets(part, rule.n)
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(sets))], names=["gram"])

    counts = texts.mapInArrow(grams, "gram long").groupBy("gram").count().where("count > 1")
    # at most COMMON numbers come to the driver
    rows = counts.orderBy(F.desc("count"), "gram").limit(COMMON).select("gram").toPandas()
    return np.sort(rows["gram"].to_numpy(np.int64).view(np.uint64))


def candidate_edges(docs: DataFrame, rule: Rule) -> DataFrame:
    """Edges between sets that agree in a class, each to the smallest set of the class.

    A task hands in each set once, so copies cost nothing further on.
    """

    shared = docs.sparkSession.sparkContext.broadcast(common_grams(docs, rule))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch.column("text")):
                keys, owners = [], []
                for grams in gram_sets(part, rule.n):
                    if not len(grams):
                        continue
                    own = set_hash(grams)
                    if int(own) in seen:
                        continue
                    seen.add(int(own))
                    found = class_hashes(grams, rule, shared.value)
                    keys.append(found)
                    owners.append(np.full(len(found), own))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [_signed(np.concatenate(keys)), _signed(np.concatenate(owners))], names=["class", "set"]
                    )

    rows = docs.select("text").mapInArrow(emit, "class long, set long")
    smallest = F.min("set").over(Window.partitionBy("class"))
    return rows.withColumn("_least", smallest).where("set <> _least").select(F.col("set").alias("a"), F.col("_least").alias("b")).distinct()


class Region:
    """The sets of one region, and which are known to be connected."""

    def __init__(self, names: np.ndarray, sets: list[np.ndarray], rule: Rule):
        self.names, self.sets, self.rule = names, sets, rule
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        self.ends = np.cumsum(self.sizes)
        self.parent = np.arange(len(sets))
        self.edges: list[tuple[int, int]] = []
        self.bars = np.zeros((len(sets), BUCKETS), np.uint16)
        for row, grams in zip(self.bars, sets, strict=True):
            row[:] = np.minimum(np.bincount((grams % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), 65535)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def roots(self, rows: np.ndarray) -> np.ndarray:
        while (self.parent[self.parent] != self.parent).any():
            self.parent = self.parent[self.parent]
        return self.parent[rows]

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((x, y))

    def common(self, x: int, rows: np.ndarray) -> np.ndarray:
        """Size of the intersection of x with each of ``rows``."""
        sizes = self.sizes[rows]
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        grams = self.flat[np.repeat(self.ends[rows] - sizes, sizes) + step]
        own = self.sets[x]
        place = np.minimum(np.searchsorted(own, grams), len(own) - 1)
        hits = np.concatenate([[0], np.cumsum(own[place] == grams)])
        ends = np.cumsum(sizes)
        return hits[ends] - hits[ends - sizes]

    def compare(self, x: int, rows: np.ndarray) -> np.ndarray:
        """Distances from x; links are noted."""
        common = self.common(x, rows)
        for y in rows[self.rule.linked(common, self.sizes[x], self.sizes[rows])].tolist():
            self.join(x, y)
        return 1 - common / (self.sizes[x] + self.sizes[rows] - common)

    def solve(self, rows: np.ndarray) -> None:
        """Find enough links among ``rows`` to have their components right."""
        if len(np.unique(self.roots(rows))) < 2:
            return
        if len(rows) <= LEAF:
            self.direct(rows)
            return
        pivots, rest = rows[:: -(-len(rows) // PIVOTS)], rows
        far = np.stack([self.compare(p, rest) for p in pivots])
        keep = ~np.isin(rest, pivots)  # a pivot has met all: it is done
        rest, far = rest[keep], far[:, keep]
        nearest = far.min(axis=0)
        cells = []
        for own in far:
            inside = np.flatnonzero(own <= nearest + 2 * self.rule.radius + 1e-9)
            cells.append(self.needed(rest[inside], own[inside]))
        if sum(len(c) for c in cells) > 1.5 * len(rest):
            # the windows overlap too much here: one cell, with the window of one pivot at a time
            own = far[int(np.argmax(far.std(axis=1)))]
            self.direct(self.needed(rest, own))
            return
        for cell in cells:
            self.solve(cell)

    def needed(self, rows: np.ndarray, far: np.ndarray) -> np.ndarray:
        """``rows`` without those of the largest component that no other row can link to, by their distance from the pivot."""
        if not len(rows):
            return rows
        roots = self.roots(rows)
        names, counts = np.unique(roots, return_counts=True)
        main = roots == names[counts.argmax()]
        if main.all():
            return rows[:0]
        others = np.sort(far[~main])
        place = np.searchsorted(others, far)
        gap = np.minimum(
            np.abs(far - others[np.minimum(place, len(others) - 1)]), np.abs(far - others[np.maximum(place - 1, 0)])
        )
        return rows[~main | (gap <= self.rule.radius + 1e-9)]

    def direct(self, rows: np.ndarray) -> None:
        """Compare all of ``rows`` that may link and are not connected yet."""
        rows = rows[np.argsort(self.sizes[rows], kind="stable")]
        sizes = self.sizes[rows]
        bars = self.bars[rows].astype(np.int32)
        for i in range(len(rows) - 1):
            last = int(np.searchsorted(sizes, 100 * sizes[i] // self.rule.percent, "right"))
            others = np.arange(i + 1, last)
            if not len(others):
                continue
            others = others[self.roots(rows[others]) != self.root(rows[i])]
            # sets differ in no less than their histograms do
            differ = np.abs(bars[others] - bars[i]).sum(axis=1)
            most = (sizes[i] + sizes[others] - differ) // 2
            others = others[self.rule.linked(most, sizes[i], sizes[others])]
            if len(others):
                self.compare(rows[i], rows[others])


REGION_ROW = "region string, set long, grams binary"


def member_sets(docs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """``region, set, grams`` of ``members`` (_rep: doc_id and hashes of a text, set, region), from that text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                here = batch.slice(part.first, len(part))
                wanted, regions = here.column("set").to_pylist(), here.column("region").to_pylist()
                rows = [
                    (region, want, grams.tobytes())
                    for region, want, grams in zip(regions, wanted, gram_sets(part, rule.n), strict=True)
                    if len(grams) and int(set_hash(grams).view(np.int64)) == want
                ]
                columns = list(zip(*rows, strict=True)) or [[], [], []]
                kinds = (pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["region", "set", "grams"]
                )

    rep = members.select("region", "set", F.col("_rep.doc_id").alias("_id"), F.col("_rep._h1").alias("_r1"), F.col("_rep._h2").alias("_r2"))
    joined = named(docs.select("doc_id", "text")).join(
        rep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h1") == F.col("_r1")) & (F.col("_h2") == F.col("_r2"))
    )
    return joined.select("region", "set", "text").mapInArrow(read, REGION_ROW).dropDuplicates(["region", "set"])


def join_regions(rows: DataFrame, rule: Rule) -> DataFrame:
    """Links inside each region, enough of them to connect what is connected."""

    def solve(group: pa.Table) -> pa.Table:
        names = group.column("set").to_numpy()
        region = Region(names, [np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()], rule)
        region.solve(np.argsort(names))
        pairs = np.array(region.edges, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(names[pairs[:, 0]]), "b": pa.array(names[pairs[:, 1]])})

    return rows.groupBy("region").applyInArrow(solve, "a long, b long")


def cut_regions(rows: DataFrame, rule: Rule, cut: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cut regions by pivots over the cluster: links to the pivots, the rows of the cells, and those of pairs of blocks.

    A region that is one component after its pivots' links is done and left out.
    One whose cells overlap too much, or that is still here at the last cut, goes
    into pairs of blocks, which are not cut again.
    """
    dealt = F.pmod(F.xxhash64(F.lit(cut), F.col("set")), F.lit(PIVOTS))
    pivots = rows.groupBy("region", dealt.alias("_k")).agg(
        F.min_by(F.struct("set", "grams"), F.xxhash64(F.lit(-cut), F.col("set"))).alias("_pivot")
    )
    pivots = pivots.groupBy("region").agg(F.sort_array(F.collect_list("_pivot")).alias("pivots"))
    salted = pivots.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = rows.withColumn("_salt", F.pmod(F.xxhash64("set"), F.lit(SALTS)).cast("int")).join(salted, ["region", "_salt"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = np.frombuffer(row["grams"], np.uint64)
                far, links = [], []
                for pivot in row["pivots"]:
                    other = np.frombuffer(pivot["grams"], np.uint64)
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    far.append(1 - common / (len(own) + len(other) - common))
                    if rule.linked(common, len(own), len(other)):
                        links.append(pivot["set"])
                near = min(far) + 2 * rule.radius + 1e-9
                done = any(p["set"] == row["set"] for p in row["pivots"])
                cells = [] if done else [f"{row['region']}.{k}" for k, d in enumerate(far) if d <= near]
                out.append((row["region"], row["set"], row["grams"], links, cells, far[0]))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["region", "set", "grams", "links", "cells", "far"],
            )

    schema = "region string, set long, grams binary, links array<long>, cells array<string>, far double"
    compared = stored(met.select("region", "set", "grams", "pivots").mapInArrow(compare, schema))
    edges = compared.select(F.col("set").alias("a"), F.explode("links").alias("b")).where("a <> b")
    open_regions = _open(compared)
    # a pivot is in no cell: it has met all
    opened = compared.join(open_regions, "region", "left_semi").where(F.size("cells") > 0)
    weight = F.octet_length("grams") / 8
    shape = opened.groupBy("region").agg(F.sum(weight).alias("_all"), F.sum(weight * F.size("cells")).alias("_sent"))
    crowded = stored(shape.where((F.col("_sent") > OVERLAP * F.col("_all")) | F.lit(cut == CUTS)).select("region"))
    cells = opened.join(F.broadcast(crowded), "region", "left_anti").select(
        F.explode("cells").alias("region"), "set", "grams"
    )
    return edges, cells, block_pairs(opened.join(F.broadcast(crowded), "region", "left_semi"), rule)


def block_pairs(rows: DataFrame, rule: Rule) -> DataFrame:
    """``region, set, grams`` of pairs of blocks of ``rows`` (region, set, grams, far): linked rows meet in one of them.

    The distance from a pivot, ``far``, differs by no more than the radius between
    linked rows, so bands of that width link with themselves and the next. A band
    is dealt into blocks of about a third of ``REGION``, and every two blocks of
    a band or of neighbouring bands are a region. Nothing is left out; a row is sent
    to as many regions as there are blocks in reach.
    """
    banded = rows.withColumn("_band", F.floor(F.col("far") / (rule.radius + 1e-9)).cast("int"))
    blocks = banded.groupBy("region", "_band").agg(
        F.ceil(F.sum(F.octet_length("grams") / 8) / (REGION / 3)).cast("int").alias("_n")
    )
    # one row a region that was too large, with a few bands
    counts = blocks.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("_band", "_n"))).alias("_counts"))
    band, region, k = F.col("_band"), F.col("region"), F.col("_k")

    def numbers(of: Column) -> Column:
        n = F.coalesce(F.try_element_at("_counts", of), F.lit(0))
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    own = numbers(band)
    dealt = banded.join(F.broadcast(counts), "region").withColumn(
        "_k", F.pmod(F.xxhash64(F.lit("block"), F.col("set")), F.size(own)).cast("int")
    )
    pairs = F.concat(
        F.transform(
            # a pair of blocks holds the links inside each
            F.filter(own, lambda other: (other != k) | (F.size(own) == 1)),
            lambda other: F.concat_ws("-", region, band, F.least(k, other), F.greatest(k, other)),
        ),
        F.transform(numbers(band + 1), lambda other: F.concat_ws("/", region, band, k, other)),
        F.transform(numbers(band - 1), lambda other: F.concat_ws("/", region, band - 1, other, k)),
    )
    return dealt.select(F.explode(pairs).alias("region"), "set", "grams")


def _open(compared: DataFrame) -> DataFrame:
    """Regions that the links to their pivots leave in pieces.

    The links of a row are one of at most 2**PIVOTS sets of pivots, so a region's
    distinct ones are few; they are merged while they overlap.
    """
    kinds = compared.groupBy("region").agg(
        F.collect_set(F.sort_array("links")).alias("_kinds"), F.min(F.size("links")).alias("_least")
    )
    union = F.aggregate(
        F.expr("sequence(1, size(_kinds))"),
        F.element_at("_kinds", 1),
        lambda held, _: F.array_distinct(
            F.flatten(
                F.concat(F.array(held), F.filter("_kinds", lambda kind: F.arrays_overlap(kind, held)))
            )
        ),
    )
    every = F.size(F.array_distinct(F.flatten("_kinds")))
    return kinds.where((F.col("_least") == 0) | (F.size(union) < every)).select("region")


def link_components(docs: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, n_shingles, set, component_id`` for every row of ``docs`` (doc_id, text).

    A-Z are lower-cased, words are runs of bytes other than 0x20 and 0x09 to
    0x0D, a document's set holds its distinct grams of ``rule.n`` words; with fewer
    words the whole sequence is one gram; a null text or one without words has the
    empty set, which links with nothing. component_id is the smallest doc_id
    reachable by links; null ids count only where there is no other. Rows that
    repeat a doc_id each have their line. Grams are 64-bit hashes of their words.
    """
    return named_components(docs, rule).drop("_h1", "_h2")


def named_components(docs: DataFrame, rule: Rule) -> DataFrame:
    """The same, with the names of the rows' texts."""
    docs = docs.select("doc_id", "text")
    sets = stored(with_sets(named(docs), rule).drop("text"), "sets")
    known = sets.where("set IS NOT NULL")
    classes = known.groupBy("set").agg(
        F.min("doc_id").alias("_id"),
        F.min(F.struct("doc_id", "_h1", "_h2")).alias("_rep"),
        F.first("n_shingles").alias("_size"),
        F.count("*").alias("_n"),
    )
    regions = components(candidate_edges(docs, rule)).select(
        F.col("node").alias("set"), F.col("root").cast("string").alias("region")
    )
    members = stored(classes.join(regions, "set").select("set", "region", "_rep", "_size"))
    weights = members.groupBy("region").agg(F.sum("_size").alias("_weight"))
    rows = member_sets(docs, members.drop("_size"), rule)
    large = stored(weights.where(F.col("_weight") > REGION).select("region"))
    found = []
    if not large.isEmpty():
        rows = stored(rows)
        big, rows = rows.join(large, "region", "left_semi"), rows.join(large, "region", "left_anti")
        for cut in range(1, CUTS + 1):
            edges, cells, pairs = cut_regions(big, rule, cut)
            found.append(stored(edges))
            cells = stored(cells)
            rows = rows.unionByName(stored(pairs))
            weigh = cells.groupBy("region").agg(F.sum(F.octet_length("grams") / 8).alias("_weight"))
            large = stored(weigh.where(F.col("_weight") > REGION).select("region"))
            rows = rows.unionByName(cells.join(large, "region", "left_anti"))
            big = cells.join(large, "region", "left_semi")
            if large.isEmpty():
                break
    links = join_regions(rows, rule)
    for more in found:
        links = links.unionByName(more)
    roots = components(links)
    joined = classes.join(roots, classes["set"] == roots["node"], "left").withColumn("_root", F.coalesce("root", "set"))
    # only sets that share their component with another row need an answer
    smallest = joined.groupBy("_root").agg(F.min("_id").alias("_component"), F.sum("_n").alias("_rows"))
    answer = (
        joined.select("set", "_root")
        .join(smallest.where("_rows > 1"), "_root")
        .select(
            F.col("set").alias("_set"), "_component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
        )
    )
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    return sets.join(answer, (sets["set"] == answer["_set"]) & (salt == answer["_salt"]), "left").select(
        "doc_id", "n_shingles", "set", F.coalesce("_component", "doc_id").alias("component_id"), "_h1", "_h2"
    )


def keep_one(docs: DataFrame, rule: Rule) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; the columns stay as they are.

    Of rows that repeat a doc_id and its set one stays; documents with the empty
    set all stay. Rows with the smallest doc_id of a component but different sets
    stay both, as do rows without a doc_id if none of their component has one.
    """
    names = docs.columns
    own = [f"_own{k}" for k in range(len(names))]
    # names of their own keep added columns apart from any that docs has
    plain = docs.toDF(*own).withColumnsRenamed({own[names.index(c)]: c for c in ("doc_id", "text")})
    linked = named_components(plain, rule).where(F.col("set").isNotNull())
    kept = linked.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "set")
    # rows of one doc_id and set may differ in blanks: the text of the smallest hashes
    # nulls in a struct are equal: the join is by the columns that rows are made one by, and whole rows move once
    key = F.struct("doc_id").alias("_key")
    kept = kept.agg(F.min(F.struct("_h1", "_h2")).alias("_text")).select(key, "_text._h1", "_text._h2")
    worded = F.coalesce(F.col("text").rlike(A_WORD), F.lit(False))
    names_of = ["_key", "_h1", "_h2"]
    one = named(plain.where(worded)).select("*", key).dropDuplicates(names_of).join(kept, names_of, "left_semi")
    order = [c if c in ("doc_id", "text") else own[k] for k, c in enumerate(names)]
    return one.select(*order).unionAll(plain.where(~worded).select(*order)).toDF(*names)
