"""Which output each row goes to: the one sharing the most leading path segments.

An output shares *n* segments with a path exactly when the path's first *n*
segments are also the output's. So the best output owns the longest prefix of
the path that is a prefix of any output, and the choice is a lookup of
prefixes (a few outputs) or of the neighbour in sort order (a table of them),
not a comparison with every output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.paths import let, resolve_text, segments, strip_extension
from sheaf.operators.numbering import place_rows
from sheaf.options import output_format
from sheaf.session import written

# an output list up to this many prefixes becomes a literal in the plan; longer ones are joined
MAX_LITERAL = 2000


def _strip(path: str) -> str:
    head, slash, name = path.rpartition("/")
    return head + slash + (name.rsplit(".", 1)[0] if "." in name else name)


def _parts(path: str) -> list[str]:
    return [p for p in resolve_text(path).split("/") if p]


def output_paths(roots: Sequence[str], work_dir: str = "", output_path: str | None = None) -> list[str]:
    """One output per root, named after it; a given output path replaces them all."""
    fmt = output_format(output_path)

    def below(name: str) -> str:
        return name if name.startswith("/") or not work_dir else work_dir.rstrip("/") + "/" + name

    if output_path:
        return [resolve_text(below(output_path))]
    names = []
    for root in roots:
        source = (work_dir or ".") if root == "." else root.rstrip("/")
        names.append(resolve_text(below(f"{source.rsplit('/', 1)[-1]}.{fmt}")))
    return names


def unmatched_output(outputs: Sequence[str]) -> str:
    """Where rows go that share no segment with any output; keeps the run's format."""
    first = outputs[0]
    suffix = first[len(_strip(first)) :] or ".xml"
    return f"{_strip(first)}_unmatched{suffix}"


def _prefix_owner(outputs: Sequence[str]) -> dict[str, str]:
    owner: dict[str, str] = {}
    for output in outputs:
        parts = _parts(_strip(output))
        for n in range(1, len(parts) + 1):
            owner.setdefault("/".join(parts[:n]), output)
    return owner


def assign_outputs(df: DataFrame, outputs: Sequence[str], path: str = "path") -> DataFrame:
    """Add ``output``. A single output takes everything, ties go to the earlier output.

    A list that fits a literal needs neither join nor shuffle. A longer one
    goes through :func:`assign_to_table`.
    """
    if len(outputs) == 1:
        return df.withColumn("output", F.lit(outputs[0]))
    owner = _prefix_owner(outputs)
    if len(owner) > MAX_LITERAL:
        rows = [(name, i) for i, name in enumerate(outputs)]
        table = df.sparkSession.createDataFrame(rows, "output string, ordinal bigint")
        chosen = assign_to_table(df.select(path).distinct(), table, path).withColumnRenamed(path, "_path")
        # a null path matches no prefix and stays, as it does with the literal
        joined = df.join(chosen, F.col(path).eqNullSafe(F.col("_path")), "left").drop("_path")
        return joined.withColumn("output", F.coalesce("output", F.lit(unmatched_output(outputs))))
    lookup = F.create_map(*[F.lit(x) for pair in owner.items() for x in pair])
    deepest = max(key.count("/") for key in owner) + 1

    def longest(parts: Column) -> Column:
        found = [
            F.when(F.size(parts) >= n, F.try_element_at(lookup, F.array_join(F.slice(parts, 1, n), "/")))
            for n in range(deepest, 0, -1)
        ]
        return F.coalesce(*found, F.lit(unmatched_output(outputs)))

    return df.withColumn("output", let(segments(strip_extension(F.col(path))), longest))


def _owned_prefixes(outputs: DataFrame) -> DataFrame:
    """``parts, owners``: each prefix of any output, with who owns it and each of its own prefixes, shortest first."""

    def prefixes(df: DataFrame, parts: str, *keep: str) -> DataFrame:
        depth = F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n")
        return df.where(F.size(parts) > 0).select(*keep, parts, depth).select(*keep, "n", F.slice(parts, 1, F.col("n")).alias("prefix"))

    named = outputs.select("output", "ordinal", segments(strip_extension(F.col("output"))).alias("parts"))
    owners = prefixes(named, "parts", "output", "ordinal").groupBy("prefix").agg(F.min(F.struct("ordinal", "output")).alias("owner"))
    owners = written(owners.select("prefix", F.col("owner.output").alias("owner")), "owners")
    # as many rows in a group as the prefix has segments
    steps = prefixes(owners.select(F.col("prefix").alias("parts")), "parts", "parts").join(owners, "prefix")
    chain = F.transform(F.array_sort(F.collect_list(F.struct("n", "owner"))), lambda step: step["owner"])
    return steps.groupBy("parts").agg(chain.alias("owners"))


def _shared(one: Column, other: Column) -> Column:
    """How many leading segments two paths share."""
    differ = F.transform(F.arrays_zip(one.alias("a"), other.alias("b")), lambda pair: ~pair["a"].eqNullSafe(pair["b"]))
    first = F.array_position(differ, True)
    return F.when(first > 0, first - 1).otherwise(F.size(one)).cast("int")


def assign_to_table(df: DataFrame, outputs: DataFrame, path: str = "path", partitions: int | None = None) -> DataFrame:
    """``(path, output)``, one row a path, for outputs that are themselves a table ``(output, ordinal)``.

    A join with the neighbour in sort order. With a prefix also all of its own
    prefixes are in the sorted table, so the row just before a path shares as many
    segments with it as any does, and it carries the owners of all its prefixes.
    Paths and prefixes are sorted together in ranges; the last prefix of a range is
    carried into the ranges behind it. A path is one row whatever its depth, and no
    key meets in one task however many paths share a folder. Null is no shared
    segment; a null path and one without segments share none.
    """
    paths = df.select(path).distinct().select(F.col(path).alias("_path"), segments(strip_extension(F.col(path))).alias("parts"))
    prefixes = _owned_prefixes(outputs).select("parts", "owners", F.lit(0).alias("_kind"))
    both = paths.withColumn("_kind", F.lit(1)).unionByName(prefixes, allowMissingColumns=True)
    placed = place_rows(both, "parts", ["_kind"], partitions)

    held = F.when(F.col("_kind") == 0, F.struct("parts", "owners"))
    # a row a range: as many as the ranges that were asked for, however large the tables
    lasts = placed.groupBy("_range").agg(F.max_by(held, F.when(F.col("_kind") == 0, F.col("_place"))).alias("_last"))
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(F.col("_range").alias("_of"), F.last("_last", ignorenulls=True).over(ranges).alias("_carried"))

    inside = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = placed.withColumn("_here", F.last(held, ignorenulls=True).over(inside)).where(F.col("_kind") == 1)
    near = before.join(carried, F.col("_range") == F.col("_of"), "left").select(
        "_path", "parts", F.coalesce("_here", "_carried").alias("_near")
    )
    shared = F.least(_shared(F.col("parts"), F.col("_near.parts")), F.size("_near.parts"))
    return near.select(F.col("_path").alias(path), F.when(shared > 0, F.get("_near.owners", shared - 1)).alias("output"))
