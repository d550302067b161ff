"""Columns that later filters must not be pushed below."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """``keep`` plus ``columns``, each computed exactly once per row.

    A filter on a projected column is pushed below the projection with the
    expression copied into it. For an expression that rewrites whole texts this
    doubles the work, and through several projections the copies multiply. A
    generator of one row ends that: filters on its output stay above it.
    """
    one_row = F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()])))
    return df.select(*keep, one_row)
