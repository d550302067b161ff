"""Path arithmetic as column expressions. Every function is Column -> Column."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it.

    Nested ``when`` chains that repeat their input grow exponentially in the
    plan; binding the input keeps them small.
    """
    return F.element_at(F.transform(F.array(value), lambda bound: body(bound)), 1)


def base_name(path: Column) -> Column:
    """Text after the last slash."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the file name, case kept; empty without a dot."""
    name = base_name(path)
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(F.lit(""))


def strip_extension(path: Column) -> Column:
    """The path without the last dot of its file name and what follows it."""
    return F.regexp_replace(path, r"\.[^./]*+\z", "")


def _resolve(path: Column) -> Column:
    rooted = F.startswith(path, F.lit("/"))

    def step(done: Column, part: Column) -> Column:
        back = F.size(done) > 0
        last_is_up = back & (F.try_element_at(done, F.lit(-1)) == F.lit(".."))
        return (
            F.when((part == "") | (part == "."), done)
            .when((part == "..") & back & ~last_is_up, F.slice(done, F.lit(1), F.size(done) - 1))
            .when((part == "..") & rooted, done)
            .otherwise(F.array_append(done, part))
        )

    start = F.array().cast("array<string>")
    joined = F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def _clean(path: Column) -> Column:
    return F.when(path.rlike(r"(?:^|/)\.{0,2}(?:/|$)") & (path != "/"), _resolve(path)).otherwise(path)


def clean_path(path: Column) -> Column:
    """Resolve ``.``, ``..`` and doubled slashes; an empty relative path becomes ``.``.

    Most paths need nothing, so the segment fold only runs where a cheap test
    finds an empty or dot segment.
    """
    return let(path, _clean)


def relative_path(path: Column, base: str) -> Column:
    """Path below ``base`` without a leading slash; paths elsewhere are kept whole.

    Only whole segments count as a prefix: ``/a/b`` does not contain ``/a/bc``.
    """
    root = resolve_text(base)
    if root == ".":
        return clean_path(path)
    prefix = root if root == "/" else root + "/"

    def below(cleaned: Column) -> Column:
        return (
            F.when(cleaned == root, F.lit(""))
            .when(F.startswith(cleaned, F.lit(prefix)), F.substring(cleaned, F.lit(len(prefix) + 1), F.length(cleaned)))
            .otherwise(cleaned)
        )

    return let(clean_path(path), below)


def display_path(path: Column, work_dir: str) -> Column:
    """The path shown in a bundle: last folder of ``work_dir`` plus what lies below it.

    Backslashes become slashes and a drive letter is dropped. Only whole
    segments of the work folder are replaced.
    """
    folder = resolve_text(_plain(work_dir).lstrip("/"))
    last = folder.rsplit("/", 1)[-1]
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:.:)?+/?+", "")

    def below(inner: Column) -> Column:
        return (
            F.when(inner == folder, F.lit(""))
            .when(
                F.startswith(inner, F.lit(folder + "/")),
                F.substring(inner, F.lit(len(folder) + 2), F.length(inner)),
            )
            .otherwise(inner)
        )

    def shown(rest: Column) -> Column:
        if last in (".", ""):
            return F.when(rest == "", F.lit(".")).otherwise(rest)
        return F.when(rest.isin("", "."), F.lit(last)).otherwise(clean_path(F.concat(F.lit(last + "/"), rest)))

    return let(let(clean_path(plain), below), shown)


def segments(path: Column) -> Column:
    """Path segments of the resolved path; the empty one before a leading slash is left out."""
    return F.filter(F.split(clean_path(path), "/"), lambda part: part != "")


def common_segments(left: Column, right: Column) -> Column:
    """How many leading segments two segment arrays share."""

    def count(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        same = F.filter(
            F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))),
            lambda n: F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n),
        )
        return F.when(F.least(F.size(a), F.size(b)) <= 0, F.lit(0)).otherwise(F.size(same))

    return let(F.struct(left.alias("a"), right.alias("b")), count)


def _plain(text: str) -> str:
    text = text.replace("\\", "/")
    return text[2:] if text[1:2] == ":" else text


def resolve_text(text: str) -> str:
    """Driver-side form of :func:`clean_path` for arguments."""
    resolved = posixpath.normpath(text) if text else "."
    return "/" + resolved.lstrip("/") if resolved.startswith("/") else resolved
