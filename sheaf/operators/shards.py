"""Bundles of any size: numbered documents in shards, in order, none gathered in one task.

An output is cut where a document begins at or beyond the next multiple of the
shard size. Its shards, read one after the other, are the bundle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.operators.bundles import LAYOUTS, encode_documents, fragment
from sheaf.operators.numbering import index_of, place_rows, range_starts, with_starts


def _placed(df: DataFrame, fmt: str, source: Column | None, content: str, order: Sequence[str]) -> DataFrame:
    encoded = encode_documents(df, fmt, F.col("path") if source is None else source, content, order)
    sized = encoded.withColumn("_texts", (F.octet_length("source") + F.octet_length("body")).cast("bigint"))
    return place_rows(sized, "output", [c for c in encoded.columns if c.startswith("_o")])


def _offsets(placed: DataFrame, fmt: str, shard_bytes: int) -> DataFrame:
    """Index, offset, bytes and shard of every row, without its texts.

    Offsets are exclusive prefix sums: the bytes before in a range of keys, plus those
    of the output's ranges before.
    """
    lay = LAYOUTS[fmt]
    narrow = placed.drop("source", "body")
    numbered = with_starts(narrow, "output", range_starts(narrow, "output")).withColumn("index", index_of())
    digits = F.length(F.col("index").cast("string"))
    numbered = numbered.withColumn("bytes", (F.col("_texts") + lay.fixed() + digits).cast("bigint"))
    step = F.col("bytes") + len(lay.between)
    starts = range_starts(numbered, "output", step).select("_group", "_of", "_size_before")
    inside = Window.partitionBy("output", "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(step).over(inside), F.lit(0))
    summed = with_starts(numbered.withColumn("_before", before), "output", starts)
    offset = (F.lit(len(lay.head)) + F.col("_size_before") + F.col("_before")).cast("bigint")
    return summed.withColumn("offset", offset).withColumn("shard", F.expr(f"CAST(offset DIV {shard_bytes} AS INT)"))


def shard_documents(
    df: DataFrame,
    fmt: str,
    shard_bytes: int,
    source: Column | None = None,
    content: str = "content",
    order: Sequence[str] = ("path",),
) -> DataFrame:
    """``output``, the ``order`` columns, ``index``, ``offset``, ``bytes`` and ``shard`` of every document.

    ``offset`` is where the rendered document begins in its output's bundle,
    ``bytes`` its length; it is in the shard ``offset DIV shard_bytes``. Null and
    empty texts are rendered empty, a null output is the output ''.
    """
    if shard_bytes < 1:
        raise ValueError("shard_bytes must be at least 1")
    found = _offsets(_placed(df, fmt, source, content, order), fmt, shard_bytes)
    names = [F.col(f"_o{i}").alias(c) for i, c in enumerate(order)]
    return found.select("output", *names, "index", "offset", "bytes", "shard")


def write_shards(
    df: DataFrame,
    folder: str,
    fmt: str,
    shard_bytes: int,
    source: Column | None = None,
    content: str = "content",
    order: Sequence[str] = ("path",),
) -> DataFrame:
    """Write bundles of any size as text below ``folder/output=<name>/shard=<number>/``, a file a shard.

    Returns ``output, shard, first_index, documents, bytes``. A task holds a shard's
    rows in turn, not together. The shards' files one after the other are the
    bundle; an XML bundle ends with one line feed more. Texts move twice: into ranges
    of keys, which are written down, and from there to their shard's task.
    """
    if shard_bytes < 1:
        raise ValueError("shard_bytes must be at least 1")
    lay = LAYOUTS[fmt]
    placed = _placed(df, fmt, source, content, order)
    found = _offsets(placed, fmt, shard_bytes)
    shards = found.groupBy("output", "shard").agg(
        F.min("index").alias("first_index"), F.count(F.lit(1)).alias("documents"), F.sum("bytes").alias("bytes")
    )
    # per output and range: the places from which on each of its shards runs; a few numbers a shard
    cuts = (
        found.groupBy("output", "_range", "shard")
        .agg(F.min("_place").alias("_from"))
        .groupBy("output", "_range")
        .agg(F.sort_array(F.collect_list(F.struct("_from", "shard"))).alias("_cuts"))
        .withColumnsRenamed({"output": "_output", "_range": "_in"})
    )
    counts = found.groupBy("output").agg(F.count(F.lit(1)).alias("_documents"))
    cuts = cuts.join(counts, F.col("_output") == F.col("output")).drop("output")
    rows = with_starts(placed, "output", range_starts(placed, "output")).withColumn("index", index_of())
    rows = rows.join(cuts, (F.col("output") == F.col("_output")) & (F.col("_range") == F.col("_in")))
    reached = F.filter("_cuts", lambda cut: cut["_from"] <= F.col("_place"))
    shard = F.element_at(reached, -1)["shard"]

    text = fragment(F.col("index"), F.col("source"), F.col("body"), fmt)
    first, last = F.col("index") == 1, F.col("index") == F.col("_documents")
    # the sink ends each row with a line feed: one there is left out of the row's text
    leads, ends = lay.before_index.startswith("\n"), lay.after_content.endswith("\n")
    core = F.expr("substring(_text, 2)") if leads else F.expr("left(_text, length(_text) - 1)") if ends else F.col("_text")
    head = lay.head if not leads else lay.head + "\n"
    line = F.concat(
        F.when(first, F.lit(head)).otherwise(F.lit("")),
        core,
        F.when(last, F.lit(lay.tail.removesuffix("\n"))).otherwise(F.lit(lay.between.removesuffix("\n"))),
    )
    out = rows.select(F.coalesce("output", F.lit("")).alias("output"), shard.alias("shard"), "index", text.alias("_text"), "_documents")
    out = out.repartition("output", "shard").sortWithinPartitions("output", "shard", "index")
    out.select("output", "shard", line.alias("value")).write.mode("overwrite").partitionBy("output", "shard").text(folder)
    return shards
