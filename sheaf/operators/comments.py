"""Comment removal: one literal regular expression per language, no UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.lexing import KEPT, LEXICONS, comment_regex
from sheaf.operators.settle import settle


def strip_comments(text: Column, language: Column, preserve_docs: bool = True) -> Column:
    """Text without the comments of its language; unknown languages pass through.

    Each language is its own branch with a literal pattern that is compiled
    once. Texts without a comment marker skip the regular expression. A
    language whose only comments are documentation keeps all of them when
    ``preserve_docs`` is set.
    """
    out = None
    for name, lex in LEXICONS.items():
        present = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in lex.markers])
        stripped = F.regexp_replace(text, comment_regex(name, preserve_docs), KEPT)
        branch = F.when(present, stripped).otherwise(text)
        if preserve_docs and set(lex.comments) <= set(lex.docs):
            branch = text
        out = F.when(language == name, branch) if out is None else out.when(language == name, branch)
    return out.otherwise(text)


def remove_comments(
    df: DataFrame, preserve_docs: bool = True, content: str = "content", language: str = "language"
) -> DataFrame:
    """Row-wise comment removal. Bytes that are not UTF-8 are left alone."""
    text = F.col(content)
    kept = F.when(F.is_valid_utf8(text), strip_comments(text, F.col(language), preserve_docs)).otherwise(text)
    return settle(df, {content: kept}, [c for c in df.columns if c != content])
