"""1-based document numbers within an output, and sums over the documents before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import written

# a row's place in its partition is in the lower bits of the id that Spark gives it
_PLACE_BITS = 33


def place_rows(df: DataFrame, group: str, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` written in order, with the range of keys a row is in (``_range``) and its place there (``_place``).

    The rows move once: they are range-partitioned by (group, order), which spreads
    a large group over many tasks, sorted within the ranges and written down with
    their places, so whatever is computed from these agrees also after a task is
    run again.
    """
    keys = [group, *order]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    placed = written(ranged.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "placed")
    return placed.select(
        *df.columns,
        F.shiftright("_at", _PLACE_BITS).cast("int").alias("_range"),
        F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("_place"),
    )


def range_starts(placed: DataFrame, group: str, sizes: Column | None = None) -> DataFrame:
    """One row for each group and range: where the group begins there, and its rows (and sizes) in the ranges before.

    A group has consecutive ranges, so these are at most as many as groups and ranges.
    """
    totals = [F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows")]
    if sizes is not None:
        totals.append(F.sum(sizes).alias("_size"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)

    def earlier(name: str) -> Column:
        return F.coalesce(F.sum(name).over(before), F.lit(0)).cast("bigint")

    out = placed.groupBy(group, "_range").agg(*totals).withColumn("_rows_before", earlier("_rows"))
    if sizes is not None:
        out = out.withColumn("_size_before", earlier("_size")).drop("_size")
    return out.drop("_rows").withColumnsRenamed({group: "_group", "_range": "_of"})


def with_starts(placed: DataFrame, group: str, starts: DataFrame) -> DataFrame:
    """``placed`` with the columns of ``starts``. Spark broadcasts these where they are small."""
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of"))
    return placed.join(starts, same).drop("_group", "_of")


def index_of() -> Column:
    """A row's number in its group, from 1, out of its place and its range's start."""
    return (F.col("_rows_before") + F.col("_place") - F.col("_first") + 1).cast("bigint")


def number_documents(
    df: DataFrame, group: str = "output", order: Sequence[str] = ("path",), partitions: int | None = None
) -> DataFrame:
    """Add ``index`` for outputs of any size.

    A window over the output would put a large output into one task. Instead a
    row's number is its place in a sorted range of keys plus the rows of its output
    in the ranges before, so rows are shuffled once. A null output is one of its
    own. Pass keys only and join the text back on the path.
    """
    placed = place_rows(df, group, order, partitions)
    numbered = with_starts(placed, group, range_starts(placed, group))
    return numbered.select(*df.columns, index_of().alias("index"))
