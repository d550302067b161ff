"""Which lines open a logging call, an accessor or an import, per language.

Patterns are tested at the line starts of *masked* text: strings are emptied
and comments are gone. A new language is one more entry here and in ``lexing``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# what the text of a span must contain to count
RETURN, ASSIGN, ACCESSOR = "return", "assign", "accessor"

LINE_START = r"^[ \t]*+"
# a line that ends like this goes on in the next one
GOES_ON = r"(?:[,.+*/|&=<\\-]|->)[ \t\r]*+(?=\n|\z)"


@dataclass(frozen=True)
class Accessor:
    """Header of a getter or setter and what its text must contain."""

    header: str
    needs: str | None = None
    # only counts right below a property line
    attached: bool = False


@dataclass(frozen=True)
class Rules:
    logging: str | None = None
    imports: str | None = None
    accessors: tuple[Accessor, ...] = ()
    # lines directly above an accessor that belong to it
    lead: str | None = None
    # a line an attached accessor must follow
    property: str | None = None
    # statements end with a semicolon, not with the line
    semicolons: bool = False
    # an accessor may end without a closing brace
    expression_bodies: bool = False
    # "brackets", "keywords" (def ... end), "indent", or "lines" (a match is the whole line)
    blocks: str = "brackets"


ANNOTATION = r"^[ \t]*@\w[\w.]*(?:\(.*\))?[ \t\r]*$"
_JAVA_WORDS = "public|protected|private|static|final|synchronized|abstract|native|default|strictfp"
_JAVA_HEAD = (
    rf"{LINE_START}(?:(?:{_JAVA_WORDS}|@\w[\w.]*+(?:\([^)\n]*+\))?+)[ \t]++)*+(?:<[^>()\n]*+>[ \t]*+)?+"
    r"(?!(?:return|throw|new|else|assert|yield|case|package|import)\b)"
)
_JAVA_TYPE = r"[\w.]++(?:<[^(){};=\n]*>)?+(?:\[\]|\.\.\.)*+[ \t]++"
_CPP_HEAD = rf"{LINE_START}(?:(?:virtual|static|inline|constexpr|explicit|friend|\[\[\w++\]\])[ \t]++)*+"
_CS_WORDS = (
    "public|private|protected|internal|static|virtual|override|abstract|sealed|new|readonly|required|unsafe|extern"
)
_CS_NOT_TYPE = (
    r"(?!(?:class|struct|interface|enum|namespace|record|return|using|else|try|finally|do|throw|goto|yield|await"
    r"|event|delegate|case|new)\b)"
)
_CS_HEAD = rf"{LINE_START}(?:(?:{_CS_WORDS})[ \t]++)*+{_CS_NOT_TYPE}"
_CS_TYPE = r"\w[\w.]*+(?:<[^{}()=;\n]*>)?+[\[\],?]*+[ \t]++"
_SWIFT_HEAD = rf"{LINE_START}(?:(?!(?:func|var)\b)@?\w++(?:\([^)\n]*+\))?+[ \t]++)*+"
_KT_WORDS = (
    "private|protected|internal|public|open|override|abstract|final|inline|lateinit|const|suspend|operator|external"
)
_KT_HEAD = rf"{LINE_START}(?:(?:{_KT_WORDS}|@\w[\w.]*+(?:\([^)\n]*+\))?+)[ \t]++)*+"
# receivers in front of a call, any number: a loop over one class of characters needs no stack
_OWNER = r"(?:[\w.]*\.)?"

_JS = Rules(
    logging=rf"{LINE_START}(?:console|logger)\.\w",
    imports=rf"{LINE_START}import\b(?![ \t]*[(.])",
    accessors=(Accessor(rf"{LINE_START}(?:get|set)[ \t]+[\w$#\[\]\"]+[ \t]*\("),),
)

RULES: dict[str, Rules] = {
    "go": Rules(
        logging=rf"{LINE_START}(?:{_OWNER}(?:log|logger)\.\w|{_OWNER}Debug\(|{_OWNER}\w++\.Print\w*+\()",
        imports=rf"{LINE_START}import[ \t(\"]",
        accessors=(Accessor(r"^func[ \t]+(?i:get|set)\w*[ \t]*[(\[]"),),
    ),
    "java": Rules(
        logging=rf"{LINE_START}(?:{_OWNER}(?:log|logger|Logger)\.\w|System\.(?:out|err)\.\w)",
        imports=rf"{LINE_START}import[ \t]",
        accessors=(
            Accessor(rf"{_JAVA_HEAD}{_JAVA_TYPE}(?i:get|is)\w*[ \t]*\(", RETURN),
            Accessor(rf"{_JAVA_HEAD}void[ \t]+(?i:set)\w*[ \t]*\("),
        ),
        lead=ANNOTATION,
        semicolons=True,
    ),
    "python": Rules(
        logging=rf"{LINE_START}(?:print[ ]?\(|logging\.\w|logger\.\w)",
        imports=rf"{LINE_START}(?:import[ \t]|from[ \t]+[\w.]+[ \t]+import\b)",
        accessors=(Accessor(rf"{LINE_START}(?:async[ \t]+)?def[ \t]+[gs]et_"),),
        lead=rf"{LINE_START}@\w",
        blocks="indent",
    ),
    "javascript": _JS,
    "typescript": Rules(
        logging=_JS.logging,
        imports=_JS.imports,
        accessors=(
            Accessor(rf"{LINE_START}(?:get|set)[ \t]+[\w$#\[\]\"]+[ \t]*\("),
        ),
        lead=ANNOTATION,
    ),
    "css": Rules(imports=rf"{LINE_START}@import\b", semicolons=True),
    "cpp": Rules(
        logging=(
            rf"{LINE_START}(?:std::)?(?:(?:cout|cerr|clog)[ \t]*<<|f?printf[ \t]*\(|log[ \t]*\("
            r"|(?:log|logger)(?:\.|->|::)\w)"
        ),
        imports=rf"{LINE_START}(?:#[ \t]*include\b|using[ \t])",
        accessors=(
            Accessor(
                rf"{_CPP_HEAD}(?!(?:return|throw|new|delete|else|case|goto)\b)(?![^(\n]*\bvoid\b)"
                r"\w[\w:<>,&* \t]*[ \t&*](?:\w++::)*+(?:get|Get|is|Is)\w*+[ \t]*+\([ \t]*+\)"
            ),
            Accessor(rf"{_CPP_HEAD}void[ \t]+(?:\w+::)*[sS]et\w*[ \t]*\([^,()\n]+\)"),
        ),
        semicolons=True,
    ),
    "csharp": Rules(
        logging=rf"{LINE_START}{_OWNER}(?:Console|Debug|Logger|Trace)\.\w",
        imports=rf"{LINE_START}(?:global[ \t]+)?using[ \t]+(?!var\b)[^(\n]*;",
        accessors=(
            Accessor(rf"{_CS_HEAD}{_CS_TYPE}Get\w*(?:<[^>\n]*>)?[ \t]*\(", RETURN),
            Accessor(rf"{_CS_HEAD}{_CS_TYPE}Set\w*(?:<[^>\n]*>)?[ \t]*\(", ASSIGN),
            Accessor(rf"{_CS_HEAD}{_CS_TYPE}{_CS_NOT_TYPE}\w+[ \t]*(?:\{{.*)?[ \t\r]*$", ACCESSOR),
        ),
        lead=r"^[ \t]*\[\w.*\][ \t\r]*$",
        semicolons=True,
    ),
    "php": Rules(
        logging=rf"{LINE_START}(?:error_log|print_r|var_dump)[ \t]*\(",
        imports=rf"{LINE_START}(?:use[ \t]+[\w\\]|(?:require|include)(?:_once)?\b)",
        accessors=(Accessor(rf"{LINE_START}(?:(?:final|abstract)[ \t]+)*public function [gs]et"),),
        lead=r"^[ \t]*#\[.*\][ \t\r]*$",
        semicolons=True,
    ),
    "ruby": Rules(
        logging=rf"{LINE_START}(?:(?:puts|print|p)[ ](?!=[^=~\n])|{_OWNER}logger\.\w)",
        imports=rf"{LINE_START}(?:require|require_relative|include)[ \t(]",
        accessors=(
            Accessor(rf"{LINE_START}def[ \t]+[gs]et_"),
            Accessor(rf"{LINE_START}(?:(?:private|protected|public)[ \t]+)?attr_(?:reader|writer|accessor)\b"),
        ),
        blocks="keywords",
        expression_bodies=True,
    ),
    "bash": Rules(
        logging=(
            rf'{LINE_START}(?:(?:[\w./]*/)?logger\b|(?:echo|printf)[ \t]+"Debug|\w[^;&|\n]*[ \t]+1?>&2[ \t\r]*$)'
            r"(?=(?:[^;|&\n]|>&)*$)"
        ),
        imports=rf"{LINE_START}(?:source|\.)[ \t]+\S[^;|&\n]*$",
        blocks="lines",
    ),
    "swift": Rules(
        logging=rf"{LINE_START}(?:(?:print|debugPrint|NSLog)\(|{_OWNER}logger\.\w)",
        imports=rf"{LINE_START}(?:@\w+[ \t]+)?import[ \t]",
        accessors=(
            Accessor(rf"{_SWIFT_HEAD}func[ \t]+get\w*", RETURN),
            Accessor(rf"{_SWIFT_HEAD}func[ \t]+set\w*", ASSIGN),
            Accessor(rf"{_SWIFT_HEAD}var[ \t]+\w+[^={{}}\n]*\{{", ACCESSOR),
        ),
        lead=ANNOTATION,
    ),
    "kotlin": Rules(
        logging=(
            rf"{LINE_START}(?:(?i:(?:System\.out\.)?print(?:ln)?\()|{_OWNER}(?:Logger|logger|log)\.\w)"
        ),
        imports=rf"{LINE_START}import[ \t]",
        accessors=(
            Accessor(rf"{_KT_HEAD}fun[ \t]+(?:<[^>\n]*>[ \t]*)?(?:\w+\.)?(?i:get|set)\w*[ \t]*\("),
            Accessor(rf"{_KT_HEAD}(?:val|var)[ \t][^=(\n]*[ \t](?:get|set)[ \t]*\("),
            Accessor(
                rf"{_KT_HEAD}(?:get[ \t]*(?:\([ \t]*\)[ \t]*[:={{]|$)|set[ \t]*(?:\([^()\n]*\)[ \t]*[={{]|$))",
                attached=True,
            ),
        ),
        lead=ANNOTATION,
        property=rf"{_KT_HEAD}(?:val|var)[ \t]",
        expression_bodies=True,
    ),
    "sql": Rules(imports=r"(?i:^[ \t]*(?:create[ \t]+extension|use)\b)", semicolons=True),
}

# HTML imports are elements, not statements
HTML_IMPORTS = r"(?i:<link\b[^>]*+>|<script\b[^>]*+>(?s:.*?)</script\s*+>)"

# parts of Ruby lines that open a block, and the word that closes one
RUBY_OPENS = (
    r"(?:^[ \t]*(?:while|until|for)\b.*"
    r"|^[ \t]*def\b(?![ \t]+[\w.]+[?!]?(?:\([^)\n]*\))?[ \t]*=[ \t])"
    r"|^[ \t]*(?:class|module|if|unless|case|begin)\b"
    r"|=[ \t]*(?:if|unless|case|begin)\b"
    r"|\bdo\b(?:[ \t]*\|[^|\n]*\|)?[ \t\r]*$)"
)
RUBY_CLOSES = r"(?<![.:\w@$])end\b(?![:?!=\w])"


def logging_pattern(language: str, prefixes=()) -> str | None:
    """Built-in logging rule of a language, widened by the caller's own prefixes."""
    rule = RULES.get(language, Rules()).logging
    own = [LINE_START + re.escape(prefix) for prefix in prefixes]
    parts = ([rule] if rule else []) + own
    return "|".join(parts) if parts else None


# languages whose logging calls are also looked for inside a line
INLINE = tuple(name for name, rule in RULES.items() if rule.logging and rule.blocks in ("brackets", "indent"))
# of these, those in which a line never is a header's body without a brace or deeper indentation of its own
BRACED = ("go", "swift")
# what a one-line body stands behind: the header's word, before its brackets, and Python's headers
CONTROL = r"\b(?:if|for|while|foreach)\b[ \t]*+"
PYTHON_HEADER = r"^[ \t]*+(?:if|elif|else|for|while|try|except|finally|with|async)\b"


def inline_pattern(language: str, prefixes=()) -> str | None:
    """The logging rule without the line start."""
    pattern = logging_pattern(language, prefixes)
    return pattern.replace(LINE_START, "") if pattern and language in INLINE else None
