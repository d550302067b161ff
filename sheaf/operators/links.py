"""Identity through links: which row each row stands for at the end of its chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import written

BROKEN, CYCLE = "link target is missing", "link never reaches a file"


def resolve_links(files: DataFrame, path: str = "path", target: str = "target") -> DataFrame:
    """``files`` with ``identity`` (the path at the end of the chain) and ``link_error``.

    A row whose ``target`` is null is a file and its own identity. Of other rows the
    chain of targets is followed by pointer doubling: each round every link that is
    still open jumps to where its target points, so a chain of n links takes about
    log2(n) rounds, each written down. A chain that ends at a path without a row has
    no identity and the error ``BROKEN``; one that has not ended after as many
    doublings as there could be links runs in a circle: ``CYCLE``. The path of every
    row should be its own; of rows that repeat a path the first by target counts,
    files first. Null paths have no identity and no error.
    """
    rows = files.where(F.col(path).isNotNull()).groupBy(F.col(path).alias("_from"))
    # files first: null targets sort before others
    known = rows.agg(F.min(F.struct(F.col(target).alias("to"))).alias("_least")).select("_from", F.col("_least.to").alias("_to"))
    known = written(known, "links")
    ends = known.where(F.col("_to").isNull()).select(F.col("_from").alias("_place"))
    links = known.where(F.col("_to").isNotNull())
    done: list[DataFrame] = []
    jumps = links
    left = links.count()
    rounds = max(1, left).bit_length() + 1
    open_links = links
    for _ in range(rounds):
        if not left:
            break
        # where the place reached is no link any more, the chain has ended
        onward = jumps.select(F.col("_from").alias("_at"), F.col("_to").alias("_next"))
        moved = written(open_links.join(onward, F.col("_to") == F.col("_at"), "left").select("_from", "_to", "_next"), "jumps")
        done.append(moved.where(F.col("_next").isNull()).select("_from", "_to"))
        open_links = moved.where(F.col("_next").isNotNull()).select("_from", F.col("_next").alias("_to"))
        # all links double; those at their end stay there
        jumps = open_links.unionAll(_all(done))
        left = open_links.count()
    ended = _all(done) if done else links
    found = ended.join(ends, F.col("_to") == F.col("_place"), "left").select(
        "_from",
        F.col("_place").alias("_identity"),
        F.when(F.col("_place").isNull(), F.lit(BROKEN)).alias("_error"),
    )
    found = found.unionAll(
        open_links.select("_from", F.lit(None).cast("string").alias("_identity"), F.lit(CYCLE).alias("_error")) if left else found.limit(0)
    )
    joined = files.join(found, F.col(path) == F.col("_from"), "left")
    is_file = F.col(target).isNull()
    return joined.select(
        *[F.col(f"`{c}`") for c in files.columns],
        F.when(is_file, F.col(path)).otherwise(F.col("_identity")).alias("identity"),
        F.when(~is_file, F.col("_error")).alias("link_error"),
    )


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionAll(table)
    return out


def distinct_files(files: DataFrame, path: str = "path", target: str = "target") -> DataFrame:
    """One row of each identity: the file itself where it has a row, else the link with the smallest path.

    Rows with an error stay, with their error: they are for the manifest to report.
    """
    resolved = resolve_links(files, path, target)
    fine = resolved.where(F.col("link_error").isNull() & F.col("identity").isNotNull())
    chosen = fine.groupBy("identity").agg(
        F.min(F.struct(F.col(target).isNotNull().alias("is_link"), F.col(path).alias("path"))).alias("_row")
    )
    chosen = chosen.select(F.col("_row.path").alias("_kept")).distinct()
    one = fine.join(chosen, F.col(path) == F.col("_kept"), "left_semi").dropDuplicates([path])
    return one.unionByName(resolved.where(F.col("link_error").isNotNull()))


def kept_paths(chosen: DataFrame, known: DataFrame, path: str = "path", target: str = "target") -> DataFrame:
    """``(path, link_error)`` of the rows of ``chosen`` that stay, when each identity stays once.

    Links are followed through ``known``, which may hold files and links that were
    not chosen: a link to such a file stands for it. Only paths are joined. Links
    with an error stay, with their error. Null paths go.
    """
    each = known.where(F.col(path).isNotNull()).groupBy(F.col(path).alias("path"))
    one = each.agg(F.min(F.struct(F.col(target).alias("to"))).alias("least")).select("path", F.col("least.to").alias("target"))
    resolved = resolve_links(one).select("path", "identity", "link_error", F.col("target").isNotNull().alias("is_link"))
    mine = resolved.join(chosen.select(F.col(path).alias("path")).distinct(), "path", "left_semi")
    best = mine.where(F.col("link_error").isNull()).groupBy("identity").agg(F.min(F.struct("is_link", "path")).alias("row"))
    stays = best.select(F.col("row.path").alias("path"), F.lit(None).cast("string").alias("link_error"))
    return stays.unionByName(mine.where(F.col("link_error").isNotNull()).select("path", "link_error"))
