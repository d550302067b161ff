"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sheaf.session import checkpoint_dir

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset (tests), one for this application."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return checkpoint_dir(spark).rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = checkpoint_dir(spark).rstrip("/")
    return _OWN[app]


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a query as soon as it ends, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, kind: str = "table") -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back: lineage ends here, and its shuffle files go."""
    spark = df.sparkSession
    path, before = new_path(spark, kind), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
