"""Line-end trimming and blank lines, as two regular expressions over the whole text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: characters that make a line blank besides the line feed
BLANKS = r"[\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TRAILING = r"(?<![ \t])[ \t]++(?=\n|\z)"


def trim_lines(text: Column) -> Column:
    """Drop spaces and tabs before every line end and at the end of the text."""
    return F.regexp_replace(text, TRAILING, "")


def drop_blank_lines(text: Column) -> Column:
    """Trim every line and leave out the blank ones; one line end closes the text."""
    led = F.concat(F.lit("\n"), text)
    kept = F.regexp_replace(led, rf"\n{BLANKS}*+(?=\n|\z)|{TRAILING}", "")
    return F.concat(F.substring(kept, F.lit(2), F.length(kept)), F.lit("\n"))


def collapse_blank_lines(text: Column) -> Column:
    """Trim every line and keep the first blank line of each run, then add a line end."""
    led = F.concat(F.lit("\n"), trim_lines(text))
    kept = F.regexp_replace(led, rf"(\n{BLANKS}*+)(?:\n{BLANKS}*+(?=\n|\z))++", "$1")
    return F.concat(F.substring(kept, F.lit(2), F.length(kept)), F.lit("\n"))


def optimize_whitespace(text: Column, remove_empty_lines: bool) -> Column:
    return drop_blank_lines(text) if remove_empty_lines else collapse_blank_lines(text)
