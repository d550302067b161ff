"""What a run takes, what it leaves out and why; needs no content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.sizes import format_size

INCLUDED, IGNORED, FAILED = "INCLUDED", "IGNORED", "ERROR"


def manifest(df: DataFrame, max_file_size: int) -> DataFrame:
    """One row per candidate: ``INCLUDED``, ``IGNORED`` for its size, or ``ERROR``.

    Returned on its own this is the dry run; only metadata columns are read.
    """
    limit = F.lit(max_file_size).cast("bigint")
    status = (
        F.when(F.col("error").isNotNull(), FAILED).when(F.col("raw_size") > limit, IGNORED).otherwise(INCLUDED)
    )
    reason = (
        F.when(F.col("status") == FAILED, F.col("error"))
        .when(
            F.col("status") == IGNORED,
            F.concat(
                F.lit("size "), format_size(F.col("raw_size")), F.lit(" exceeds limit of "), format_size(limit)
            ),
        )
        .otherwise(F.lit(""))
    )
    return df.select("path", "raw_size", limit.alias("size_limit"), status.alias("status"), "error").select(
        "path", "raw_size", "size_limit", "status", reason.alias("reason")
    )


def budget(listing: DataFrame, max_output_size: int) -> DataFrame:
    """Counts and total size of a manifest in one row, and whether the run may go on."""
    taken = F.col("status") == INCLUDED
    totals = listing.agg(
        F.count_if(taken).alias("included"),
        F.count_if(F.col("status") == IGNORED).alias("ignored"),
        F.count_if(F.col("status") == FAILED).alias("failed"),
        F.coalesce(F.sum(F.when(taken, F.col("raw_size"))), F.lit(0)).cast("bigint").alias("total_size"),
    )
    limit = F.lit(max_output_size).cast("bigint")
    problem = (
        F.when(F.col("included") == 0, F.lit("no valid files found matching patterns"))
        .when(
            F.col("total_size") > limit,
            F.concat(
                F.lit("total size of valid files ("),
                format_size(F.col("total_size")),
                F.lit(") exceeds maximum output size ("),
                format_size(limit),
                F.lit(")"),
            ),
        )
        .otherwise(F.lit(""))
    )
    return totals.select("*", limit.alias("size_limit"), problem.alias("problem"))


def require_budget(listing: DataFrame, max_output_size: int) -> None:
    """Raise ``ValueError`` when nothing is left or the total is too large."""
    row = budget(listing, max_output_size).first()
    if row["problem"]:
        raise ValueError(row["problem"])


def first_error(df: DataFrame) -> DataFrame:
    """Number of failed rows and the error of the smallest failed path; rows go on regardless."""
    failed = F.col("error").isNotNull()
    return df.agg(
        F.count_if(failed).alias("failed"),
        F.min(F.when(failed, F.col("path"))).alias("first_path"),
        F.min_by("error", F.when(failed, F.col("path"))).alias("first_error"),
    )
