"""Raw files: written by Spark's own committer, read by byte ranges.

Spark has no sink for raw bytes, but the text sink writes a string column's
bytes as they are and ends each row with a line separator. A format whose
records all end in one known byte can use that byte as the separator and hand
over its records without it; nothing else is added to the files. Tasks may be
lost and run again: the committer keeps one attempt of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_records(df: DataFrame, column: str, path: str, last: str = "\x00") -> None:
    """Write the binary ``column``, whose records lack their last byte ``last``."""
    df.select(F.col(column).cast("string").alias("value")).write.text(path, lineSep=last)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, part, piece``: a folder's files, in the order they were written. No content is read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    name = F.regexp_extract("path", "part-([0-9]+)[^/]*$", 1).cast("int")
    piece = F.regexp_extract("path", "-c([0-9]+)[^/]*$", 1).cast("int")
    return files.where("length > 0").select("path", "length", name.alias("part"), F.coalesce(piece, F.lit(0)).alias("piece"))


def opened(path: str) -> pa.NativeFile:
    store, inside = pafs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


class Window:
    """Bytes of one file, read ahead in steps; memory is one step or one request."""

    def __init__(self, path: str, step: int = 4 << 20):
        self.file, self.step = opened(path), step
        self.at, self.held = 0, b""
        self.size = self.file.size()

    def read(self, start: int, n: int) -> bytes:
        if start < self.at or start + n > self.at + len(self.held):
            self.at, self.held = start, self.file.read_at(min(max(n, self.step), max(0, self.size - start)), start)
        return self.held[start - self.at : start - self.at + n]

    def close(self) -> None:
        self.file.close()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()
