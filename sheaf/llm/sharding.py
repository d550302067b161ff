"""Placing keys in a tree of regions, racks and shards by weighted hash draws.

At every level a key draws an exponential variate for each child, seeded by
the key and the child's label and divided by the child's weight; the smallest
draw wins. Raising the weight of one child can only make that child win more
often, so keys move only into subtrees whose weight grew and out of subtrees
whose weight shrank. A shard added as a branch of its own (``with_branch``)
therefore takes keys into itself and moves no key between the old shards.

Everything is an expression over the key; placing shuffles nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one numbering group holds on average.
GROUP_ROWS = 16_384


@dataclass(frozen=True)
class Leaf:
    """One shard: its place in the tree, its number and its weight."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def grid(regions: int, racks: int, shards: int) -> list[Leaf]:
    """``regions`` of ``racks`` of ``shards`` equal shards, numbered from 0."""
    return [
        Leaf(f"region{r}", f"rack{k}", (r * racks + k) * shards + s)
        for r in range(regions)
        for k in range(racks)
        for s in range(shards)
    ]


def with_branch(leaves: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard in a region and a rack of its own."""
    number = max(leaf.shard for leaf in leaves) + 1
    return [*leaves, Leaf(f"branch{number}", "rack0", number, weight)]


def _draw(key: Column, label: Column, weight: Column) -> Column:
    # 53 bits strictly between 0 and 1, so the logarithm is finite
    unit = (F.shiftrightunsigned(F.xxhash64(label, key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(unit) / weight


def _tree(leaves: Sequence[Leaf]) -> Column:
    live = [leaf for leaf in leaves if leaf.weight > 0]
    if not live:
        raise ValueError("a tree needs a shard with a weight above zero")
    if len({leaf.shard for leaf in leaves}) < len(leaves):
        raise ValueError("shard numbers must differ")
    regions: dict[str, dict[str, list[Leaf]]] = defaultdict(lambda: defaultdict(list))
    for leaf in live:
        regions[leaf.region][leaf.rack].append(leaf)

    def node(label: str, weight: float, name: str, kids: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(float(weight)).alias("weight"), kids.alias(name))

    def shards(region: str, rack: str) -> Column:
        return F.array(
            *[
                node(f"{region}/{rack}/{x.shard}", x.weight, "shard", F.lit(int(x.shard)))
                for x in regions[region][rack]
            ]
        )

    def racks(region: str) -> Column:
        return F.array(
            *[
                node(f"{region}/{rack}", sum(x.weight for x in below), "kids", shards(region, rack))
                for rack, below in regions[region].items()
            ]
        )

    return F.array(
        *[
            node(region, sum(x.weight for below in held.values() for x in below), "kids", racks(region))
            for region, held in regions.items()
        ]
    )


def shard_of(key: Column, leaves: Sequence[Leaf]) -> Column:
    """The shard of ``key``. A null key is one key like any other."""

    def pick(children: Column) -> Column:
        drawn = F.transform(
            children, lambda child: F.struct(_draw(key, child["label"], child["weight"]).alias("draw"), child.alias("of"))
        )
        return F.array_min(drawn)["of"]

    return pick(pick(pick(_tree(leaves))["kids"])["kids"])["shard"]


def with_slots(df: DataFrame, shard: str, order: Sequence[str], rows: int, slot: str = "slot") -> DataFrame:
    """``df`` with gapless numbers from 0 inside every shard.

    A shard can hold any share of the rows, so none is numbered in one task:
    rows fall into hash groups of about ``GROUP_ROWS`` rows, groups are
    numbered by themselves and shifted by the sizes of the groups before them.
    Rows alike in all columns are one row with a count until their numbers are
    known, and the hash is over all ``order`` columns, so neither copies of one row
    nor one id with many texts meet in one group. ``rows`` only sets the number of
    groups. ``order`` and ``shard`` should tell rows apart; then reruns agree.
    """
    groups = 1
    while groups * GROUP_ROWS < rows:
        groups *= 2
    alike = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    dealt = alike.withColumn("_group", F.pmod(F.xxhash64(F.lit("slot"), *order), F.lit(groups)).cast("int"))
    sizes = dealt.groupBy(F.col(shard).alias("_s"), F.col("_group").alias("_g")).agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy("_s").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_s", "_g", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_place", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    first = (F.col("_start") + F.col("_place")).cast("long")
    return placed.join(starts, (F.col(shard) == F.col("_s")) & (F.col("_group") == F.col("_g"))).select(
        *df.columns, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias(slot)
    )


def place_documents(docs: DataFrame, leaves: Sequence[Leaf], grown: Sequence[Leaf]) -> DataFrame:
    """Shard, slot and shard after growth of every row of ``docs``.

    Reads ``doc_id`` and ``text`` only; other columns, whatever their names, are
    left out. A null text has no bytes: size 1, checksum 0. Rows with the same
    ``doc_id`` share a shard and have slots of their own. An empty table gives
    an empty result.
    """
    data = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), leaves).alias("shard"),
        shard_of(F.col("doc_id"), grown).alias("grown_shard"),
    )
    numbered = with_slots(placed, "shard", ["doc_id", "text_crc32", "size"], docs.count())
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
