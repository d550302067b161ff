"""The whole cleaning step as columns: accessors, logging, imports, comments, whitespace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import rules as R
from sheaf.functions.languages import LANGUAGES
from sheaf.operators import spans as S
from sheaf.operators.comments import strip_comments
from sheaf.operators.settle import settle
from sheaf.operators.whitespace import optimize_whitespace
from sheaf.options import CleanOptions

STATUS = "clean_status"


def clean(
    df: DataFrame, options: CleanOptions | None = None, content: str = "content", language: str = "language"
) -> DataFrame:
    """Clean every row's text in place and say how it went in ``clean_status``.

    ``cleaned``; ``unchanged`` for languages without rules; ``failed`` for texts
    that are empty, not UTF-8 or have unpaired brackets. Only cleaned rows change. All spans are found on the original text and the
    outermost wins, so removing one never shifts another.
    """
    options = options or CleanOptions()
    lang, text = F.col(language), F.col(content)
    known = ", ".join(f"'{name}'" for name in LANGUAGES)
    usable = f"({language} IN ({known}) AND octet_length({content}) > 0 AND is_valid_utf8({content}))"
    # a text holding marker characters outside strings and comments is not code
    legible = f"{S.is_balanced('_mask', language)} AND NOT {S.matches('_mask', f'[{S.ANY_MARKER}]')}"
    out = df.selectExpr("*", f"IF({usable}, {S.mask_text(content, language)}, NULL) AS _mask")
    out = out.selectExpr("*", f"coalesce({usable} AND (_mask IS NULL OR ({legible})), false) AS _fine")

    statements: dict[str, list[str]] = {name: [] for name in R.RULES}
    for name, rule in R.RULES.items():
        logging = R.logging_pattern(name, options.logging_prefixes.get(name, ()))
        if options.remove_logging and logging:
            statements[name].append(logging)
        if options.remove_imports and rule.imports:
            statements[name].append(rule.imports)
    rest = [c for c in df.columns if c != content]
    if options.remove_accessors or any(statements.values()):
        marked = S.mark_text("_mask", language, options.remove_accessors, statements)
        out = out.selectExpr(*df.columns, "_fine", f"IF(_fine, {marked}, NULL) AS _marked")
        shrunk = S.shrink_text("_marked", language, options.remove_accessors)
        out = out.selectExpr(*df.columns, "_fine", f"IF({S.has_start('_marked')}, {shrunk}, NULL) AS _shrunk")
        wrapped = S.wrap_spans("_shrunk", language, options.remove_accessors, statements)
        out = out.selectExpr(*df.columns, "_fine", f"{wrapped} AS _wrapped")
        cut = f"IF({S.has_span('_wrapped')}, {S.drop_spans(content, language, '_wrapped')}, {content})"
        out = out.selectExpr(*rest, "_fine", f"{cut} AS {content}")

    calls = {name: R.inline_pattern(name, options.logging_prefixes.get(name, ())) for name in R.INLINE}
    if options.remove_logging:
        # calls that share their line with other code, in what is left
        found = f"_fine AND {S.has_inline(content, language, calls)}"
        out = out.selectExpr("*", f"IF({found}, {S.mask_text(content, language)}, NULL) AS _mask")
        out = out.selectExpr(*out.columns[:-1], f"{S.tag_brackets('_mask')} AS _tagged")
        out = out.selectExpr(*out.columns[:-1], f"{S.wrap_inline('_tagged', language, calls)} AS _inline")
        cut = f"IF({S.has_span('_inline')}, {S.drop_inline(content, language, '_inline', calls)}, {content})"
        out = out.selectExpr(*rest, "_fine", f"{cut} AS {content}")

    done = text
    if options.remove_imports:
        done = F.when(lang == "html", F.regexp_replace(done, _whole_line(R.HTML_IMPORTS), "")).otherwise(done)
    if options.remove_comments:
        done = strip_comments(done, lang, options.preserve_doc_comments)
    if options.optimize_whitespace:
        done = optimize_whitespace(done, options.remove_empty_lines)
    status = (
        F.when(F.col("_fine"), F.lit("cleaned"))
        .when(lang.isin(*LANGUAGES), F.lit("failed"))
        .otherwise(F.lit("unchanged"))
    )
    result = {content: F.when(F.col("_fine"), done).otherwise(text), STATUS: status}
    return settle(out, result, [c for c in df.columns if c not in result])


def _whole_line(pattern: str) -> str:
    return rf"(?d)(?m:^)[ \t]*+{pattern}[ \t\r]*+(?m:$)|{pattern}"
