"""Globs that are a table: however many there are, a path meets only those that can match it.

Every pattern is filed under one key, all the literal text that each path it
matches must have at fixed places: the folders it starts in, and how its file name
begins and ends, or the whole name. The kind of a key says how many folders and
characters that are. A path looks up one key for each kind there is among the
patterns, and the pattern's regular expression, the same as for a list of
patterns, decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.globs import expand_patterns, glob_regex
from sheaf.functions.paths import base_name, let
from sheaf.operators.select import located
from sheaf.session import written

#: How many leading folders, and characters of a name's beginning and end, make a key; a few numbers bound the kinds.
FOLDERS = (0, 1, 2, 4)
LENGTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24)
#: In the place of a length: the whole name.
WHOLE = -1
KINDS = [f"{n},{head},{tail}" for n in FOLDERS for head in LENGTHS for tail in LENGTHS] + [f"{n},{WHOLE},0" for n in FOLDERS]

_TOKENS = re.compile(r"\[[!^]?(?:\\.|[^\\\]])+\]|\*+|\?|\{\}|\\.|.", re.S)


def _literals(segment: str) -> tuple[str, str, bool]:
    """The literal beginning and end of a segment, and whether there is nothing else."""
    runs = [""]
    for token in _TOKENS.findall(segment):
        if token == "{}":
            continue
        if token[0] in "*?" or (token[0] == "[" and len(token) > 1):
            runs.append("")
        else:
            runs[-1] += token[-1]
    return runs[0], runs[-1], len(runs) == 1


def _most(sizes: Sequence[int], length: int) -> int:
    return max(n for n in sizes if n <= length)


def pattern_key(pattern: str) -> str:
    """The key of one brace-free glob, its kind before the colon."""
    *folders, name = pattern.split("/")
    head, tail, whole = _literals(name)
    leading: list[str] = []
    for folder in folders:
        literal, _, plain = _literals(folder)
        if not plain:
            break
        leading.append(literal)
    n = _most(FOLDERS, len(leading))
    inside = "/".join(leading[:n])
    if whole:
        return f"{n},{WHOLE},0:{inside}/{head}/"
    first, last = _most(LENGTHS, len(head)), _most(LENGTHS, len(tail))
    return f"{n},{first},{last}:{inside}/{head[:first]}/{tail[len(tail) - last :]}"


def _path_keys(path: Column, kinds: Sequence[str] = KINDS) -> Column:
    """The keys of these kinds that a path has."""
    sizes = [[int(n) for n in kind.split(",")] for kind in kinds]
    shapes = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("folders"), F.lit(head).alias("head"), F.lit(tail).alias("tail"))
            for kind, (n, head, tail) in zip(kinds, sizes, strict=True)
        ]
    )

    def keys(of: Column) -> Column:
        name, parts, length = of["name"], of["parts"], of["length"]

        def key(shape: Column) -> Column:
            n, head, tail = shape["folders"], shape["head"], shape["tail"]
            inside = F.array_join(F.slice(parts, F.lit(1), n), "/")
            first = F.when(head == WHOLE, name).otherwise(F.substring(name, F.lit(1), head))
            whole = F.concat(shape["kind"], F.lit(":"), inside, F.lit("/"), first, F.lit("/"), F.substring(name, -tail, tail))
            # wildcards stand between beginning and end, so the two don't overlap
            return F.when((F.size(parts) >= n) & (length >= head + tail), whole)

        return F.array_compact(F.transform(shapes, key))

    name = base_name(path)
    parts = F.split(path, "/", -1)
    return let(F.struct(name.alias("name"), parts.alias("parts"), F.char_length(name).alias("length")), keys)


def pattern_index(patterns: DataFrame) -> DataFrame:
    """``key, on_name, refuse, regex, error`` of a table ``pattern string, exclude boolean``.

    A row is a list like the one a run takes: commas, braces and ``!`` mean the
    same. A null ``exclude`` is false, a null or empty pattern is none. A row that
    a list would be refused for is one row with the reason in ``error``.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, exclude in zip(batch["pattern"], batch["exclude"], strict=True):
                try:
                    for form in expand_patterns(text):
                        no = not exclude and form.startswith("!")
                        bare = form[1:] if no else form
                        rows.append((pattern_key(bare), "/" not in bare, bool(exclude or no), glob_regex(bare), None))
                except (ValueError, IndexError) as bad:
                    rows.append((None, None, bool(exclude), None, str(bad)))
            yield pd.DataFrame(rows, columns=["key", "on_name", "refuse", "regex", "error"], dtype=object)

    asked = patterns.select(F.coalesce("pattern", F.lit("")).alias("pattern"), F.coalesce("exclude", F.lit(False)).alias("exclude"))
    # a fixed number of tasks: small rows that take long would be gathered in one
    cores = patterns.sparkSession.sparkContext.defaultParallelism
    dealt = asked.repartition(cores, "pattern", "exclude").distinct()
    parsed = dealt.mapInPandas(parse, "key string, on_name boolean, refuse boolean, regex string, error string")
    return parsed.distinct()


def select_by_table(df: DataFrame, patterns: DataFrame, roots=(), anchor: str = "relative", path: str = "path") -> DataFrame:
    """Rows of ``df`` whose path passes a table of globs, as with ``select_paths`` and the same globs in a list.

    The patterns' index is written down first, so Spark knows its size and sends it
    to all tasks only where it is small; else both sides are shuffled by the key and
    a key of very many paths is split. The kinds of keys, at most all ``KINDS``, come to
    the driver. Only paths are joined, once each; the rows themselves move once to meet
    the paths that stay. A null path passes only where there is no pattern. A pattern
    that does not parse raises ``ValueError``.
    """
    df, column = located(df, roots, anchor, path)
    index = written(pattern_index(patterns), "patterns")
    told = index.agg(
        F.min("error").alias("error"),
        F.count_if(~F.col("refuse")).alias("include"),
        F.count_if("refuse").alias("exclude"),
        F.collect_set(F.substring_index("key", ":", 1)).alias("kinds"),
    ).first()
    if told["error"]:
        raise ValueError(told["error"])
    if not told["include"] and not told["exclude"]:
        return df
    asked = df.select(column.alias("_glob_path")).where(F.col("_glob_path").isNotNull()).distinct()
    place = F.col("_glob_path")
    met = asked.select("_glob_path", F.explode(_path_keys(place, sorted(told["kinds"]))).alias("key")).join(index, "key")
    text = F.when(F.col("on_name"), base_name(place)).otherwise(place)
    hit = met.where(F.regexp_like(text, F.concat(F.lit("(?s)^(?:"), F.col("regex"), F.lit(")\\z"))))
    found = hit.groupBy("_glob_path").agg(F.bool_or("refuse").alias("_out"), F.bool_or(~F.col("refuse")).alias("_in"))
    same = column == F.col("_glob_path")
    if told["include"]:
        return df.join(found.where("_in AND NOT _out").select("_glob_path"), same, "left_semi")
    return df.where(column.isNotNull()).join(found.where("_out").select("_glob_path"), same, "left_anti")
