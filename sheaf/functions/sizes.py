"""Human-readable sizes to bytes and back."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: unit letter -> power of 1024
UNITS = {"": 0, "K": 1, "M": 2, "G": 3, "T": 4}
SHOWN_UNITS = "KMGTPE"


def parse_size(text: str) -> int:
    """Bytes meant by an argument such as ``10MB``."""
    squeezed = text.replace(" ", "").upper()
    if not squeezed:
        raise ValueError("a size is needed")
    if not squeezed.endswith("B"):
        raise ValueError(f"size {text!r} needs a unit: B, KB, MB, GB or TB")
    found = re.fullmatch(r"([+-]?[0-9]+)([KMGT]?)B", squeezed)
    if not found:
        raise ValueError(f"size {text!r} is no whole number")
    number = int(found.group(1))
    if number <= 0:
        raise ValueError(f"size {text!r} is not above zero")
    return number * 1024 ** UNITS[found.group(2)]


def parse_size_column(text: Column) -> Column:
    """Column form of :func:`parse_size`; null where the text is not a size."""
    squeezed = F.upper(F.replace(text, F.lit(" "), F.lit("")))
    number = F.regexp_extract(squeezed, "^([+]?[0-9]+)[KMGT]?B$", 1).try_cast("bigint")
    unit = F.regexp_extract(squeezed, "^[+]?[0-9]+([KMGT]?)B$", 1)
    scale = F.lit(1)
    for letter, power in UNITS.items():
        scale = F.when(unit == letter, F.lit(1024**power)).otherwise(scale)
    return F.when(number > 0, F.try_multiply(number, scale.cast("bigint")))


def format_size(size: Column) -> Column:
    """``512 B`` below 1024, else one decimal with the largest fitting unit.

    Sizes over a power of 1024 are exact binary fractions, so rounding ties to
    even before printing gives what C-style formatting prints.
    """
    text = F.concat(size.cast("string"), F.lit(" B"))
    for power, letter in enumerate(SHOWN_UNITS, start=1):
        shown = F.format_string("%.1f", F.bround(size.cast("double") / F.lit(float(1024**power)), 1))
        text = F.when(size >= F.lit(1024**power), F.concat(shown, F.lit(f" {letter}B"))).otherwise(text)
    return text
