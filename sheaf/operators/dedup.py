"""Duplicate removal as partial aggregates.

One group may hold a large share of all rows, so no window is used: ``min`` of
a struct combines on the map side, each task sends at most one row per key,
and the smallest row wins whatever the order of arrival. The struct holds keys
only; whole rows move at most once, to meet the keys that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _smallest(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in order]
    row = F.struct(*order, *rest)
    best = df.groupBy(key.alias("_key")).agg(F.min(row).alias("_row"))
    return best.select(*[F.col("_row")[c].alias(c) for c in df.columns])


def distinct_paths(df: DataFrame) -> DataFrame:
    """One row per path, however many roots reach it."""
    cheap = [c for c in ("path", "raw_size", "size") if c in df.columns]
    return _smallest(df, F.col("path"), cheap)


def distinct_identity(df: DataFrame, identity: Column, is_link: Column | None = None) -> DataFrame:
    """One row per underlying item: a real file before a link, then the smallest path.

    ``identity`` is a resolved path, or a hash of the content to go further.
    Rows without an identity stand for themselves; of rows that repeat a path one stays.
    """
    link = is_link if is_link is not None else F.lit(False)
    key = F.coalesce(identity, F.concat(F.lit("path:"), F.col("path")))
    keys = df.select(key.alias("_key"), F.struct(link.alias("link"), F.col("path").alias("path")).alias("_row"))
    best = keys.groupBy("_key").agg(F.min("_row").alias("_row"))
    stays = best.select(F.col("_row.path").alias("path"), F.col("_row.link").alias("_link")).distinct()
    # the path of a kept row can come with another identity as well: the link tells a kept row apart from it
    kept = df.withColumn("_link", link).join(stays, ["path", "_link"], "left_semi")
    # rows that repeat a path are next to each other after the join: no further shuffle
    return kept.dropDuplicates(["path", "_link"]).select(df.columns)


def content_identity(content: str = "content") -> Column:
    """Identity of equal texts."""
    return F.sha2(F.col(content), 256)
