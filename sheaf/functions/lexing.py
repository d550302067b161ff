"""What strings and comments look like in each language, as regular expressions.

All loops are possessive or lazy over a single character class: on long
literals the backtracking forms overflow the JVM stack. A scan from left to
right with strings and comments as alternatives is a lexer: a comment marker
inside a string is consumed by the string.
"""

from __future__ import annotations

from dataclasses import dataclass

ANY = r"(?s:.)"
DOUBLE = rf'"[^"\\\n]*+(?:\\{ANY}[^"\\\n]*+)*+"'
SINGLE = rf"'[^'\\\n]*+(?:\\{ANY}[^'\\\n]*+)*+'"
DOUBLE_LINES = rf'"[^"\\]*+(?:\\{ANY}[^"\\]*+)*+"'
SINGLE_LINES = rf"'[^'\\]*+(?:\\{ANY}[^'\\]*+)*+'"
TRIPLE = rf'"""[^"\\]*+(?:(?:\\{ANY}|"(?!""))[^"\\]*+)*+"""'
TRIPLE_SINGLE = rf"'''[^'\\]*+(?:(?:\\{ANY}|'(?!''))[^'\\]*+)*+'''"
TRIPLE_RAW = r'"""(?s:.*?)"""'
LINE = r"//[^\n]*+"
HASH = r"#[^\n]*+"
BLOCK = r"/\*(?s:.*?)\*/"
DOC_BLOCK = r"/\*\*/|/\*\*(?s:.*?)\*/"
DOC_SLASH = r"///[^\n]*+"
# fixed value: a line comment that opens like this is documentation in any language
DOC_WORD = r"// Doc [^\n]*+"


# comments inside comments that are read as such; a text with more is left alone (``leftover``)
NESTED = 24


def _nested_block(depth: int) -> str:
    inner = r"\*(?!/)|/(?!\*)" + (f"|{_nested_block(depth - 1)}" if depth else "")
    return rf"/\*[^*/]*+(?:(?:{inner})[^*/]*+)*+\*/"


def _interpolated(opener: str, closer: str, start: str) -> str:
    """A one-line string whose interpolations may hold strings and one bracket level."""
    part = rf'[^{opener}{closer}"\n]++|"[^"\n]*+"|\{opener}[^{opener}{closer}"\n]*+\{closer}'
    hole = rf"{start}\{opener}(?:{part})*+\{closer}"
    return rf'"[^"\\$\n]*+(?:(?:{hole}|\\{ANY}|\$)[^"\\$\n]*+)*+"'


_TEMPLATE_PART = r"[^{}`]++|`[^`]*+`|\{(?:[^{}`]++|`[^`]*+`)*+\}"
TEMPLATE = rf"`[^`\\$]*+(?:(?:\\{ANY}|\$\{{(?:{_TEMPLATE_PART})*+\}}|\$)[^`\\$]*+)*+`"
# a slash after an operator, an opening bracket or one of these words begins a literal, else it divides
_BEFORE_REGEX = (
    r"(?:(?<=[(,=:\[!&|?{};\n][ \t]{0,64})"
    r"|(?<=\b(?:return|typeof|case|in|of|delete|void|throw|do|else|yield|await)[ \t]{0,64}))"
)
REGEX_LITERAL = _BEFORE_REGEX + r"/(?![/*])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/"
# a letter after the percent sign tells a literal from a remainder
RUBY_PERCENT = (
    rf"(?<![\w)\]}}])%[qQwWiIrxs](?:\[[^\]\\]*+(?:\\{ANY}[^\]\\]*+)*+\]|\([^)\\]*+(?:\\{ANY}[^)\\]*+)*+\)"
    rf"|\{{[^}}\\]*+(?:\\{ANY}[^}}\\]*+)*+\}}|<[^>\\]*+(?:\\{ANY}[^>\\]*+)*+>"
    rf"|\|[^|\\]*+(?:\\{ANY}[^|\\]*+)*+\||![^!\\]*+(?:\\{ANY}[^!\\]*+)*+!)"
)
HEREDOC = r"""<<[~-]?+["'`]?+(?<tag>[A-Z_]\w*+)["'`]?+[^\n]*+\n(?s:.*?)(?m:^)[ \t]*+\k<tag>(?m:$)"""
PHP_HEREDOC = r"""<<<[ \t]*+["']?+(?<tag>\w++)["']?+\n(?s:.*?)\n[ \t]*+\k<tag>\b"""


@dataclass(frozen=True)
class Lexicon:
    """Token patterns of one language."""

    strings: tuple[str, ...]
    comments: tuple[str, ...]
    docs: tuple[str, ...] = ()
    # characters that can open a token; everything else is skipped in runs
    openers: str = r"""\"'/"""
    # what a text may begin with, at any character
    head: str = ""
    # substrings without which a text holds no comment
    markers: tuple[str, ...] = ("//", "/*")
    balanced: str = "()[]{}"


_C_DOCS = (DOC_SLASH, DOC_WORD)
_BLOCK_DOCS = (DOC_BLOCK, DOC_WORD)
_JS = Lexicon((DOUBLE, SINGLE, TEMPLATE, REGEX_LITERAL), (LINE, BLOCK), _BLOCK_DOCS, r"""\"'`/""")

LEXICONS: dict[str, Lexicon] = {
    "go": Lexicon((DOUBLE, "`[^`]*+`", SINGLE), (LINE, BLOCK), _C_DOCS, r"""\"'`/"""),
    "java": Lexicon((TRIPLE, DOUBLE, SINGLE), (LINE, BLOCK), _BLOCK_DOCS),
    "python": Lexicon((TRIPLE, TRIPLE_SINGLE, DOUBLE, SINGLE), (HASH,), (), r"""\"'#""", markers=("#",)),
    "javascript": _JS,
    "typescript": _JS,
    "html": Lexicon(
        (
            r"(?i:<script\b[^>]*+>(?s:.*?)</script\s*+>)",
            r"(?i:<style\b[^>]*+>(?s:.*?)</style\s*+>)",
        ),
        (r"<!--(?s:.*?)-->",),
        (r"<!--(?s:.*?)-->",),
        "<",
        markers=("<!--",),
        balanced="",
    ),
    "css": Lexicon((DOUBLE, SINGLE, r"""url\([^)"']*+\)"""), (BLOCK,), (BLOCK,), r"""\"'/u""", markers=("/*",)),
    "cpp": Lexicon(
        (r'R"(?<tag>[^()\\\s]{0,16})\((?s:.*?)\)\k<tag>"', DOUBLE, rf"(?<![0-9]){SINGLE}"),
        (LINE, BLOCK),
        _C_DOCS,
        r"""\"'/R""",
    ),
    "csharp": Lexicon(
        (r'(?:\$@|@\$|@)"[^"]*+(?:""[^"]*+)*+"', TRIPLE_RAW, DOUBLE, SINGLE),
        (LINE, BLOCK),
        _C_DOCS,
        r"""\"'/@$""",
    ),
    "php": Lexicon(
        (
            r"\?>(?s:.*?)(?:<\?(?:php|=)?+|\z)",
            PHP_HEREDOC,
            DOUBLE_LINES,
            SINGLE_LINES,
        ),
        (r"//(?:(?!\?>)[^\n])*+", r"#(?!\[)(?:(?!\?>)[^\n])*+", BLOCK),
        _BLOCK_DOCS,
        r"""\"'/#<?""",
        head=r"\A(?s:.*?)<\?(?:php|=)?+",
        markers=("//", "/*", "#"),
    ),
    "ruby": Lexicon(
        (HEREDOC, DOUBLE_LINES, SINGLE_LINES, "`[^`]*+`", RUBY_PERCENT),
        (r"(?m:^)=begin\b(?s:.*?)(?m:^)=end\b[^\n]*+", r"(?<![?$\\])#(?!\{)[^\n]*+"),
        (r"(?<![?$\\])#(?!\{)[^\n]*+",),
        r"""\"'`#<=%""",
        markers=("#", "=begin"),
    ),
    "bash": Lexicon(
        (rf"\\{ANY}", HEREDOC, DOUBLE_LINES, "'[^']*+'"),
        (r"(?<![^\s;&|()])#[^\n]*+",),
        (r"(?<![^\s;&|()])#[^\n]*+",),
        r"""\\"'#<""",
        markers=("#",),
        balanced="",
    ),
    "swift": Lexicon(
        (r'#"(?s:.*?)"#', TRIPLE, _interpolated("(", ")", r"\\")),
        (LINE, _nested_block(NESTED)),
        _C_DOCS,
        r"""\"/#""",
    ),
    "kotlin": Lexicon(
        (TRIPLE_RAW, _interpolated("{", "}", r"\$"), SINGLE),
        (LINE, _nested_block(NESTED)),
        _BLOCK_DOCS,
    ),
    "sql": Lexicon(
        ("'[^']*+(?:''[^']*+)*+'", '"[^"]*+"', r"\$(?<tag>\w*+)\$(?s:.*?)\$\k<tag>\$"),
        (r"--[^\n]*+", BLOCK),
        (r"--[^\n]*+",),
        r"""\"'/$\-""",
        markers=("--", "/*"),
    ),
}

# fixed flags: only \n ends a line
FLAGS = "(?d)"
QUOTES = "\"'`"


def any_of(patterns) -> str:
    return "(?:" + "|".join(patterns) + ")"


def _token_start(lex: Lexicon) -> str:
    """Cheap first test: most characters cannot open a token."""
    return f"(?=[{lex.openers}])"


# what a match of ``comment_regex`` is replaced by
KEPT = "${head}${kept}${doc}"


def comment_regex(language: str, preserve_docs: bool) -> str:
    """Kept strings and docs are captured, comments are not.

    A comment alone on its lines goes with its indentation, the line end stays.
    """
    lex = LEXICONS[language]
    docs = any_of(lex.docs) if preserve_docs and lex.docs else "(?!)"
    comment = any_of(lex.comments)
    whole = rf"(?:{comment}[ \t\r]*+)++(?m:$)"
    at_token = rf"(?<kept>{'|'.join([*lex.strings, docs])})|(?m:^){whole}|{comment}"
    indented = rf"(?<doc>(?m:^)[ \t]++{docs})|(?m:^)[ \t]++{whole}"
    return rf"{FLAGS}(?<head>{lex.head or '(?!)'})|{_token_start(lex)}(?:{at_token})|{indented}"


# what a match of ``mask_regex`` is replaced by: the quote of a string twice, nothing for a comment
MASKED = "${quote}${word}${quote}"


def mask_regex(language: str, word: str = "(?!)") -> str:
    """Strings and comments. ``word`` may name first words of a double-quoted string to keep."""
    lex = LEXICONS[language]
    strings = any_of(lex.strings) if lex.strings else "(?!)"
    strings = strings.replace(DOUBLE_LINES, rf'"(?<word>{word})?+' + DOUBLE_LINES[1:])
    if "(?<word>" not in strings:
        strings = f"(?:(?<word>(?!))|{strings})"
    head = f"{lex.head}|" if lex.head else ""
    quoted = f"(?:(?=(?<quote>[{QUOTES}]))|){strings}"
    return f"{FLAGS}{head}{_token_start(lex)}(?:{quoted}|{any_of(lex.comments)})"


def logical_line_regex(language: str) -> str:
    """One line with its line end; line ends inside strings and comments do not count."""
    lex = LEXICONS[language]
    token = any_of(lex.strings + lex.comments)
    plain = rf"[^{lex.openers}\n]*+"
    head = f"(?:{lex.head})?+" if lex.head else ""
    return rf"{FLAGS}{head}{plain}(?:(?:{token}|[^\n]){plain})*+\n?+"


#: Characters at which a text is cut into pieces, in code; Python's headers end with a colon.
CUTS = {"python": r"\n()\[\]{};:"}
ANY_CUT = r"\n()\[\]{};"


def cuts(language: str) -> str:
    return CUTS.get(language, ANY_CUT)


def piece_regex(language: str) -> str:
    """A piece of a text up to and with the next cut; cuts inside strings and comments do not count."""
    lex = LEXICONS[language]
    token = any_of(lex.strings + lex.comments)
    plain = rf"[^{lex.openers}{cuts(language)}]*+"
    head = f"(?:{lex.head})?+" if lex.head else ""
    return rf"{FLAGS}{head}{plain}(?:(?:{token}|[^{cuts(language)}]){plain})*+[{cuts(language)}]?+"
