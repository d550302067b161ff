"""Glob lists to anchored regular expressions, built once on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.paths import base_name

# fixed values: limits and forbidden pieces of a pattern list
MAX_LENGTH = 1000
BANNED = ("/**/../", "**/.*/**", "***")

_PIECES = re.compile(r"\\.?|[{},]|[^\\{},]+", re.S)


def check_patterns(patterns: str) -> None:
    """Raise ``ValueError`` for a pattern list no plan should be built from."""

    def refuse(reason: str) -> None:
        raise ValueError(f"pattern list {patterns!r}: {reason}")

    if "\0" in patterns:
        refuse("it holds a null byte")
    if len(patterns.encode()) > MAX_LENGTH:
        refuse(f"it is longer than {MAX_LENGTH} bytes")
    for piece in BANNED:
        if piece in patterns:
            refuse(f"{piece!r} is not allowed")
    bare = re.sub(r"\\.", "", patterns, flags=re.S)
    for opener, closer, word in (("{", "}", "brace"), ("[", "]", "bracket")):
        open_count = 0
        for char in bare:
            open_count += (char == opener) - (char == closer)
            if open_count < 0:
                refuse(f"a {word} closes that was not opened")
        if open_count:
            refuse(f"a {word} stays open")
    if re.search(r"(?:^|[^\\])(?:\\\\)*\\$", patterns):
        refuse("it does not parse")
    if re.search(r"\[[!^]?\]", bare):
        refuse("it does not parse")


def _top_level(text: str) -> list[str]:
    """Pieces of ``text`` between commas that no brace encloses, blanks at the ends kept."""
    parts, depth = [""], 0
    for piece in _PIECES.findall(text):
        if piece == "," and depth == 0:
            parts.append("")
            continue
        depth += (piece == "{") - (piece == "}")
        parts[-1] += piece
    return parts


def split_patterns(patterns: str) -> list[str]:
    """Split a list on its top-level commas. A list that starts with an escape stays whole."""
    if patterns.startswith("\\"):
        return [patterns]
    return [part.strip() for part in _top_level(patterns) if part]


def _options(inner: str) -> list[str]:
    options = [part.strip() for part in _top_level(inner)]
    return options[:-1] if not _top_level(inner)[-1] else options


def expand_braces(pattern: str) -> list[str]:
    """All patterns a brace pattern stands for, nested groups included."""
    if pattern.startswith("\\"):
        return [pattern]
    depth, start, offset = 0, 0, 0
    for piece in _PIECES.findall(pattern):
        if piece == "{":
            start = offset if depth == 0 else start
            depth += 1
        elif piece == "}" and depth:
            depth -= 1
            options = _options(pattern[start + 1 : offset]) if depth == 0 else []
            if options:
                head, tail = pattern[:start], pattern[offset + 1 :]
                whole = [head + option + tail for option in options]
                return [
                    form
                    for text in whole
                    for form in (expand_braces(text) if "{" in text and "\\{" not in text else [text])
                ]
        offset += len(piece)
    return [pattern]


def expand_patterns(patterns: str) -> list[str]:
    """Check, split and expand one pattern list."""
    if not patterns:
        return []
    check_patterns(patterns)
    return [form for part in split_patterns(patterns) for form in expand_braces(part)]


def _segment_regex(segment: str) -> str:
    out, rest = [], segment
    while rest:
        group = re.match(r"\[([!^]?)((?:\\.|[^\\\]])+)\]", rest, re.S)
        if group:
            inner = re.sub(r"(?<!\\)([\[&^])", r"\\\1", group.group(2))
            out.append("(?!/)[" + ("^" if group.group(1) else "") + inner + "]")
            rest = rest[group.end() :]
            continue
        stars = re.match(r"\*+", rest)
        if stars:
            out.append("[^/]*")
            rest = rest[stars.end() :]
            continue
        if rest.startswith("{}"):
            rest = rest[2:]
            continue
        if rest[0] == "\\":
            rest = rest[1:]
            out.append(re.escape(rest[0]))
        else:
            out.append("[^/]" if rest[0] == "?" else re.escape(rest[0]))
        rest = rest[1:]
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """Regular expression of one brace-free glob; ``**`` as a whole segment spans folders."""
    whole = pattern.split("/")
    # repeated ** segments mean one
    parts = [p for i, p in enumerate(whole) if p != "**" or i == 0 or whole[i - 1] != "**"]
    out = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            if last:
                out = (out[:-1] + "(?:/.*)?") if out.endswith("/") else out + ".*"
            else:
                out += "(?:.*/)?"
        else:
            out += _segment_regex(part) + ("" if last else "/")
    return out


def _any_match(patterns: list[str], path: Column, name: Column) -> Column | None:
    tests = []
    for column, chosen in (
        (name, [p for p in patterns if "/" not in p]),
        (path, [p for p in patterns if "/" in p]),
    ):
        if chosen:
            tests.append(column.rlike("(?s)^(?:" + "|".join(glob_regex(p) for p in dict.fromkeys(chosen)) + ")\\z"))
    if not tests:
        return None
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def glob_filter(path: Column, include: str, exclude: str = "") -> Column:
    """Keep a path no exclude matches and, if includes are given, some include matches.

    A pattern without a slash tests the file name, one with a slash the whole
    path. ``!pattern`` in the include list excludes.
    """
    wanted = expand_patterns(include)
    refused = expand_patterns(exclude) + [p[1:] for p in wanted if p.startswith("!")]
    wanted = [p for p in wanted if not p.startswith("!")]
    name = base_name(path)
    out, keep = _any_match(refused, path, name), _any_match(wanted, path, name)
    if out is None and keep is None:
        return F.lit(True)
    if out is None:
        return keep
    return ~out if keep is None else ~out & keep
