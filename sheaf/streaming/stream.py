"""The row-wise stages on a stream; every micro-batch becomes its own set of bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sheaf.operators.bundles import write_bundles
from sheaf.operators.select import select_paths
from sheaf.options import PackOptions
from sheaf.plans.pack import prepare, render
from sheaf.schema import BINARY_FILE
from sheaf.sources.files import files_to_corpus


def stream_files(spark: SparkSession, root: str) -> DataFrame:
    """New files below ``root`` as a streaming corpus."""
    raw = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").load(root)
    )
    return files_to_corpus(raw)


def prepare_stream(corpus: DataFrame, options: PackOptions) -> DataFrame:
    """Selection, size limit, cleaning and assignment: no state, no shuffle."""
    if options.distinct_content:
        raise ValueError("equal texts of different batches cannot be dropped: that needs all of them")
    return prepare(select_paths(corpus, options.include, options.exclude, options.roots, options.anchor), options)


def pack_stream(corpus: DataFrame, options: PackOptions, folder: str, progress: str) -> StreamingQuery:
    """Write the bundles of each micro-batch below ``folder/batch=<id>``.

    A batch that is tried again overwrites its own folder, so each batch counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_bundles(render(batch, options), f"{folder}/batch={batch_id}")

    return (
        prepare_stream(corpus, options)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
