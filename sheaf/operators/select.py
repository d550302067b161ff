"""Row filters: path globs, size limit, empty texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.globs import glob_filter
from sheaf.functions.paths import clean_path, let, relative_path, resolve_text


def below_roots(path: Column, roots) -> Column:
    """Path relative to the first root that contains it; null below none of them."""
    def first_inside(whole: Column) -> Column:
        return F.coalesce(*[F.nullif(relative_path(whole, root), whole) for root in roots])

    return let(clean_path(path), first_inside) if roots else path


def located(df: DataFrame, roots=(), anchor: str = "relative", path: str = "path") -> tuple[DataFrame, Column]:
    """Rows below one of the roots, and the path that patterns are matched with."""
    column = F.col(path)
    named = [] if any(r in ("", ".") for r in roots) else list(roots)
    if named:
        inside = below_roots(column, named)
        itself = clean_path(column).isin([resolve_text(r) for r in named])
        df = df.where(inside.isNotNull() | itself)
        if anchor == "relative":
            column = F.coalesce(inside, column)
    return df, column


def select_paths(
    df: DataFrame, include: str = "", exclude: str = "", roots=(), anchor: str = "relative", path: str = "path"
) -> DataFrame:
    """Rows below one of the roots whose path passes the include and exclude globs.

    Without roots, or with the root ``.``, every row is below. A root that is a
    row's own path holds that row.
    Patterns with a slash are matched below the root by default, so ``build/**``
    finds ``<root>/build``; ``anchor="absolute"`` matches the stored path.
    """
    df, column = located(df, roots, anchor, path)
    return df.where(glob_filter(column, include, exclude))


def within_size(df: DataFrame, limit: int, size: str = "raw_size") -> DataFrame:
    """Rows not larger than ``limit`` bytes; a row at the limit stays."""
    return df.where(F.col(size) <= F.lit(limit))


def drop_empty(df: DataFrame, content: str = "content") -> DataFrame:
    """Rows with at least one byte of content."""
    return df.where(F.octet_length(content) > 0)
