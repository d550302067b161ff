"""The complete job: select, drop duplicates, check, clean, assign, render."""

from __future__ import annotations

from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.paths import display_path
from sheaf.functions.sizes import parse_size
from sheaf.operators.assign import assign_outputs, output_paths
from sheaf.operators.bundles import render_bundles
from sheaf.operators.clean import clean
from sheaf.operators.dedup import content_identity, distinct_identity, distinct_paths
from sheaf.operators.links import kept_paths
from sheaf.operators.manifest import manifest, require_budget
from sheaf.operators.select import drop_empty, select_paths, within_size
from sheaf.options import PackOptions, output_format
from sheaf.session import materialize, written
from sheaf.sources.files import read_files
from sheaf.sources.tables import refresh_size


class Packed(NamedTuple):
    """What a run made, and every candidate with what became of it."""

    bundles: DataFrame
    manifest: DataFrame


def candidates(corpus: DataFrame, options: PackOptions, most: int | None = None) -> DataFrame:
    """Rows the globs select, one per path; with ``most``, of those not larger.

    The size is checked before duplicates are dropped, so it reaches the scan. Of
    rows with one path the smallest is the one that counts either way.

    With ``link_target`` a file and the links to it are one candidate, the file
    where it is selected, else the smallest link. Links are followed over the whole
    corpus, selected or not, and before any size is checked; a link that reaches no
    file is a candidate with an error.
    """
    chosen = select_paths(corpus, options.include, options.exclude, options.roots, options.anchor)
    if options.link_target is not None:
        stays = kept_paths(chosen, corpus, "path", options.link_target)
        stays = stays.select(F.col("path").alias("_kept"), F.col("link_error").alias("_link_error"))
        chosen = chosen.join(stays, F.col("path") == F.col("_kept")).withColumn("error", F.coalesce("error", "_link_error"))
        chosen = chosen.drop("_kept", "_link_error")
    if most is not None:
        chosen = within_size(chosen, most)
    return chosen if options.unique_paths else distinct_paths(chosen)


def dry_run(corpus: DataFrame, options: PackOptions) -> DataFrame:
    """The manifest only: what would be packed. No content is read from a file scan.

    The content goes before duplicates are dropped: inside the row that
    operator keeps, no later pruning would reach it.
    """
    return manifest(candidates(corpus.drop("content"), options), parse_size(options.max_file_size))


def prepare(corpus: DataFrame, options: PackOptions) -> DataFrame:
    """Row-wise stages up to the cleaned, non-empty, assigned documents."""
    rows = within_size(corpus, parse_size(options.max_file_size)).where(F.col("error").isNull())
    if options.distinct_content:
        rows = distinct_identity(rows, content_identity())
    if options.clean is not None:
        rows = clean(rows, options.clean)
    rows = refresh_size(drop_empty(rows))
    outputs = output_paths(options.roots, options.work_dir, options.output_path)
    return assign_outputs(rows, outputs)


def pack(corpus: DataFrame, options: PackOptions) -> DataFrame:
    """Bundles of a corpus, one row per output.

    With ``enforce_budget`` the total of the accepted sizes is checked first,
    over metadata only, and a run above it stops with ``ValueError``. A cleaned
    corpus is written once to the checkpoint folder because both the size check
    and the rendering read it.
    """
    if options.enforce_budget:
        require_budget(dry_run(corpus, options), parse_size(options.max_output_size))
    rows = prepare(candidates(corpus, options, parse_size(options.max_file_size)), options)
    if options.clean is not None:
        rows = materialize(rows)
    outputs = output_paths(options.roots, options.work_dir, options.output_path)
    wanted = corpus.sparkSession.createDataFrame([(o,) for o in dict.fromkeys(outputs)], "output string")
    return render(rows, options, wanted)


def pack_reported(corpus: DataFrame, options: PackOptions) -> Packed:
    """``pack`` with its manifest: rows with an error are left out of the bundles and reported there.

    The manifest is written down before the bundles are made, so both tell of the
    same run. ``manifest.budget`` counts its rows by status.
    """
    listing = written(dry_run(corpus, options), "manifest")
    if options.enforce_budget:
        require_budget(listing, parse_size(options.max_output_size))
    return Packed(pack(corpus, replace(options, enforce_budget=False)), listing)


def pack_files(spark: SparkSession, options: PackOptions) -> Packed:
    """Bundles of the files below the roots; files that could not be read are rows of the manifest.

    Files above ``max_file_size`` are listed and not opened.
    """
    corpus = read_files(spark, options.roots, parse_size(options.max_file_size))
    return pack_reported(corpus, replace(options, unique_paths=True))


def render(rows: DataFrame, options: PackOptions, outputs: DataFrame | None = None) -> DataFrame:
    """Bundles of prepared rows under the paths a reader should see."""
    path = F.col("path")
    return render_bundles(
        rows,
        output_format(options.output_path),
        parse_size(options.max_output_size),
        source=display_path(path, options.work_dir) if options.work_dir else path,
        outputs=outputs,
    )
