"""Any table with a path-like key and a text column as a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.languages import detect_language
from sheaf.functions.paths import base_name, extension
from sheaf.schema import CORPUS


def to_corpus(df: DataFrame, path: Column, content: Column, error: Column | None = None, keep=()) -> DataFrame:
    """Canonical corpus columns from a table, in one projection that prunes unused ones.

    ``keep`` names extra columns to carry along.
    """
    base = df.select(
        path.alias("path"),
        content.cast("string").alias("content"),
        (error if error is not None else F.lit(None)).cast("string").alias("error"),
        *keep,
    )
    size = F.octet_length("content").cast("bigint")
    return base.select(
        "path",
        base_name(F.col("path")).alias("name"),
        extension(F.col("path")).alias("extension"),
        detect_language(F.col("path")).alias("language"),
        "content",
        size.alias("raw_size"),
        size.alias("size"),
        "error",
        *keep,
    )


def spread(table: DataFrame, key: str) -> DataFrame:
    """Rows of a plain scan over at least as many tasks as there are cores.

    A file with a single row group is read by one task, which would then do all
    text work. Only such scans are shuffled, by a deterministic key; a scan
    with enough tasks, as any large input has, is returned as it is.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores, key)


def refresh_size(df: DataFrame) -> DataFrame:
    """``size`` follows the current content; ``raw_size`` keeps what was read."""
    return df.withColumn("size", F.octet_length("content").cast("bigint"))


CORPUS_COLUMNS = CORPUS.fieldNames()
