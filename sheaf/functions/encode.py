"""Scalar encodings used inside bundles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: escapes in the order they are applied
XML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")]
SHORT_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
RARE_SHORT = [("\b", "\\b"), ("\f", "\\f")]
HTML_SAFE = "<>&\u2028\u2029"
YAML_ODD = "\u2028\u2029\ufeff\ufffe\uffff"


def _chain(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_xml(text: Column) -> Column:
    """``& < > ' "`` as entities, ampersand first."""
    return _chain(text, XML_ESCAPES)


def _rare(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The same as a chain, folded over a literal list: one small expression for a seldom taken branch."""
    table = F.array(*[F.struct(F.lit(old).alias("old"), F.lit(new).alias("new")) for old, new in pairs])
    return F.aggregate(table, text, lambda done, pair: F.replace(done, pair["old"], pair["new"]))


def _unicode(chars) -> list[tuple[str, str]]:
    return [(c, f"\\u{ord(c):04x}") for c in chars]


def _controls() -> list[tuple[str, str]]:
    plain = {"\n", "\r", "\t", "\b", "\f"}
    return RARE_SHORT + _unicode(chr(n) for n in range(0x20) if chr(n) not in plain)


def json_string(text: Column) -> Column:
    """A quoted JSON string that is also safe inside HTML; bytes that are not UTF-8 become ``\\ufffd``.

    Control characters other than line ends and tabs are rare: their chain of
    replacements sits behind one regex test.
    """
    common = _chain(F.make_valid_utf8(text), SHORT_ESCAPES + _unicode(HTML_SAFE))
    # a replacement character that stood in the text itself stays
    common = F.when(F.is_valid_utf8(text), common).otherwise(F.replace(common, F.lit("\ufffd"), F.lit("\\ufffd")))
    rare = F.when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), _rare(common, _controls())).otherwise(common)
    return F.concat(F.lit('"'), rare, F.lit('"'))


def yaml_string(text: Column) -> Column:
    """A double-quoted YAML scalar. Characters YAML calls non-printable are escaped, other bytes replaced."""
    odd = [chr(0x7F)] + [chr(n) for n in range(0x80, 0xA0)] + list(YAML_ODD)
    common = _chain(F.make_valid_utf8(text), SHORT_ESCAPES)
    rare = F.when(
        text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\u2028\u2029\ufeff\ufffe\uffff]"),
        _rare(common, _controls() + _unicode(odd)),
    ).otherwise(common)
    return F.concat(F.lit('"'), rare, F.lit('"'))
