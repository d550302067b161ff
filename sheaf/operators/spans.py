"""Multi-line removals (logging calls, accessors, imports) inside one row.

Every row carries its whole text, so a span never has to leave its row: there
is no shuffle and no explode. The work is a short chain of regular expressions
over whole texts:

1. *mask*: strings are emptied and comments dropped, so brackets left are code;
2. *mark*: a marker character goes in front of each line that opens something;
3. *shrink*: all but brackets, line ends and markers becomes one character per run;
4. *tag*: each bracket is followed by its depth, the same for both of a pair;
5. *wrap*: each span is enclosed in two more markers; a pair ends where its depth comes back;
6. *cut*: lines inside a wrapped span are left out of the original text.

Only texts with a marker go past step 2, only texts with a span past step 5. No
step has a limit on depth, on the lines above an accessor or on a line's length.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import count

from sheaf.functions import rules as R
from sheaf.functions.lexing import LEXICONS, MASKED, cuts, logical_line_regex, mask_regex, piece_regex

# marker characters, from a private block of Unicode that code does not use
(STATEMENT, LINE, PLAIN, RETURNS, ASSIGNS, ACCESSES, ATTACHED, LEAD, PROPERTY) = map(chr, range(0xE000, 0xE009))
(HAS_RETURN, HAS_ACCESSOR, GOES_ON, OPEN, CLOSE, INSIDE, HOLD) = map(chr, range(0xE009, 0xE010))
# in front of the first of the lines above an accessor
RUN = chr(0xE010)
ANY_MARKER = "\ue000-\ue010"
STARTS = "\ue000-\ue006"

# brackets that are folded one by one into a string before the strings are joined
CHUNK = 128


def quote(text: str) -> str:
    """A SQL string literal; the dollar is spelled out because SQL text is searched for variables."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def sub(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {quote(pattern)}, {quote(by)})"


def matches(text: str, pattern: str) -> str:
    return f"({text} RLIKE {quote(pattern)})"


def by_language(language: str, branches: Mapping[str, str]) -> str:
    """``CASE language`` over the given branches; null for every other language."""
    arms = " ".join(f"WHEN '{name}' THEN {value}" for name, value in branches.items())
    return f"CASE {language} {arms} END"


def mask_text(text: str, language: str) -> str:
    """The text with comments gone and strings emptied, line structure of the code kept."""
    # the logging rule of bash looks at the first word of a string
    words = {"bash": "Debug"}
    masked = {name: sub(text, mask_regex(name, words.get(name, "(?!)")), MASKED) for name in R.RULES}
    return by_language(language, masked)


def _flat(levels: int) -> str:
    """Balanced brackets nested at most ``levels`` deep, kinds told apart."""
    inner = "(?!)"
    for _ in range(levels):
        inner = "|".join(rf"\{o}(?:{inner})*+\{c}" for o, c in ("()", "[]", "{}"))
    return inner


def _paired(brackets: str) -> str:
    """Whether a text of brackets only pairs up, kind by kind, however deep.

    Pairs of up to three levels are left out three times; ordinary code is done
    then. What is left is merged two neighbours at a time: a stretch is known by
    the closing brackets it needs from the left (``c``) and those it waits for on
    the right (``o``, innermost first), and neighbours cancel where these agree.
    """
    left = brackets
    for _ in range(3):
        left = sub(left, _flat(3), "")
    wait = "translate(x, '([{', ')]}')"
    leaf = f"IF(x IN ('(', '[', '{{'), named_struct('c', '', 'o', {wait}), named_struct('c', x, 'o', ''))"
    k = "least(length(l.o), length(r.c))"
    none = "named_struct('c', '', 'o', '')"
    # a stretch that can't be paired needs a bracket that there is none of
    merge = f"""IF(left(l.o, {k}) = left(r.c, {k}),
        named_struct('c', concat(l.c, substring(r.c, {k} + 1)), 'o', concat(r.o, substring(l.o, {k} + 1))),
        named_struct('c', '!', 'o', '!'))"""
    pair = f"transform(array(struct(a[2 * i] AS l, coalesce(get(a, 2 * i + 1), {none}) AS r)), p -> {merge})[0]"
    pair = pair.replace("l.", "p.l.").replace("r.", "p.r.")
    halved = f"transform(sequence(0, (size(a) - 1) div 2), i -> {pair})"
    tree = f"""aggregate(sequence(0, length(bin(length(rest)))),
        transform(filter(split(rest, ''), x -> x <> ''), x -> {leaf}),
        (a, _) -> IF(size(a) < 2, a, {halved}),
        a -> a[0].c = '' AND a[0].o = '')"""
    # bound once: the text is used several times
    return f"transform(array({left}), rest -> rest = '' OR {tree})[0]"


def is_balanced(masked: str, language: str) -> str:
    """Whether every bracket of the masked text has a partner of its kind in the right place, and no comment is left in part."""
    paired = _paired(sub(masked, r"[^()\[\]{}]++", ""))
    loose = ", ".join(quote(name) for name, lex in LEXICONS.items() if not lex.balanced)
    nested = f"{language} IN ('swift', 'kotlin') AND (instr({masked}, '/*') > 0 OR instr({masked}, '*/') > 0)"
    return f"({language} IN ({loose}) OR ({paired} AND NOT ({nested})))"


def tag_brackets(text: str) -> str:
    """The text with each bracket's depth and a comma behind it; the brackets of a pair have the same.

    A chunk of brackets is folded into one string and the depth handed on, so the
    work stays in proportion to the text.
    """
    ends = "right(x, 1)"
    fold = f"""aggregate(chunk, named_struct('d', a.d, 's', ''), (b, x) -> CASE
        WHEN {ends} IN ('(', '[', '{{') THEN named_struct('d', b.d + 1, 's', concat(b.s, x, b.d + 1, ','))
        WHEN {ends} IN (')', ']', '}}') THEN named_struct('d', b.d - 1, 's', concat(b.s, x, b.d, ','))
        ELSE named_struct('d', b.d, 's', concat(b.s, x)) END)"""
    chunks = f"transform(sequence(0, (size(t) - 1) div {CHUNK}), k -> slice(t, k * {CHUNK} + 1, {CHUNK}))"
    step = f"transform(array({fold}), f -> named_struct('d', f.d, 's', concat(a.s, array(f.s))))[0]"
    whole = f"aggregate({chunks}, named_struct('d', 0, 's', cast(array() AS array<string>)), (a, chunk) -> {step}, a -> array_join(a.s, ''))"
    pieces = f"split({text}, {quote(r'(?<=[()\[\]{}])')}, -1)"
    return f"transform(array({pieces}), t -> {whole})[0]"


def untag_brackets(text: str) -> str:
    return sub(text, r"([()\[\]{}])-?\d++,", "$1")


_number = count()


def _pair(opens: str = r"(\[{", closes: str = r")\]}") -> str:
    """A bracket of tagged text up to its partner: the next closing one of the same depth."""
    depth = f"d{next(_number)}"
    return rf"[{opens}](?<{depth}>-?\d++,)(?:[^)\]}}]++|[)\]}}](?!\k<{depth}>))*+[{closes}]\k<{depth}>"


END = r"(?=\n|\z)"


# bodies over shrunken text: up to a closing brace or semicolon at a line end, or to the end of the line;
# none runs into the next start at its own depth, so a text full of unfinished starts is read once
def _block_body() -> str:
    curly = lambda: _pair(r"{", r"}")
    return (
        rf"(?:[^()\[\]{{}};{STARTS}]++|{_pair(r'(\[', r')\]')}|{curly()}(?![;,]*+(?:\n|\z))|;(?!\n|\z))*+"
        rf"(?:{curly()}[;,]*+|;){END}"
    )


def _line_body() -> str:
    return rf"(?:[^()\[\]{{}}\n{GOES_ON}]++|{_pair()}|{GOES_ON}\n?+)*+{END}"


def _semicolon_statement() -> str:
    return rf"{STATEMENT}(?:[^()\[\]{{}};{STARTS}]++|{_pair()})*+;{END}"


def _line_statement() -> str:
    return rf"{STATEMENT}(?:[^()\[\]{{}};\n{GOES_ON}]++|{_pair()}|{GOES_ON}\n?+)*+;?+{END}"


# a run of lines above an accessor is only looked at from its first line on
LEADS = rf"(?:{RUN}(?:{LEAD}[^\n]*+\n++)++)?+"

NEEDS = {None: PLAIN, R.RETURN: RETURNS, R.ASSIGN: ASSIGNS, R.ACCESSOR: ACCESSES}
ACCESSOR_WORD = rf"(?:^[{ANY_MARKER}]*|[{{;}}])[ \t]*(?:[a-z]+[ \t]+)?(?:get|set|init)\b"


def _indented_accessors(masked: str) -> str:
    """Masked text with Python accessors wrapped: decorators, header, and every deeper line below."""

    def line() -> str:
        return rf"(?:[^()\[\]{{}}\n]++|{_pair()})*+"

    def decorator(indent: str) -> str:
        return rf"@{line()}\n(?:[ \t\r]*+\n)*+\k<{indent}>"

    def deeper(indent: str) -> str:
        return rf"{line()}(?:\n(?:[ \t\r]*+\n)*+\k<{indent}>[ \t]++(?=[^ \t\r\n]){line()})*+"

    define = r"(?:async[ \t]+)?def"
    is_property = rf"(?=(?:(?!@property\b){decorator('own')})*+@property\b)"
    decorated = (
        rf"{RUN}(?<own>[ \t]*+)(?:{is_property}(?:{decorator('own')})++{define}\b"
        rf"|(?:{decorator('own')})++{define}[ \t]+[gs]et_){deeper('own')}"
    )
    bare = rf"(?<bare>[ \t]*+){define}[ \t]+[gs]et_{deeper('bare')}"
    runs = sub(tag_brackets(masked), rf"(?dm)^(?<ind>[ \t]*+)(?:{decorator('ind')})++", f"{RUN}$0")
    wrapped = sub(runs, f"(?dm)^(?:{decorated}|{bare})", f"{OPEN}$0{CLOSE}")
    wrapped = f"replace({untag_brackets(wrapped)}, '{RUN}', '')"
    return f"IF({matches(masked, r'@property\b|def[ \t]+[gs]et_')}, {wrapped}, {masked})"


# a statement below one of these is its whole body: an empty statement has to stay in its place
BODY_OF = rf"(?d)(?:\)|\b(?:else|do))[ \t\r]*+\n(?={STATEMENT})"
# where lines need no semicolon the line above must be seen to be a header
BODY_OF_HEADER = (
    r"(?dm)(?:^[ \t]*+(?:\}[ \t]*+)?+(?:else[ \t]++)?+(?:if|for|while)\b(?:[^\n)]++|\)(?![ \t\r]*+\n))*+\)"
    rf"|\b(?:else|do))[ \t\r]*+\n(?={STATEMENT})"
)
HEADERS = {"java": BODY_OF, "cpp": BODY_OF, "csharp": BODY_OF, "php": BODY_OF}
HEADERS |= dict.fromkeys(("javascript", "typescript", "kotlin"), BODY_OF_HEADER)


def _mark(text: str, marker: str, patterns: list[str]) -> str:
    """Put ``marker`` in front of every line one of the patterns opens."""
    return sub(text, f"(?dm)^(?=(?:{'|'.join(patterns)}))", marker) if patterns else text


def mark_text(masked: str, language: str, accessors: bool, statements: Mapping[str, list[str]]) -> str:
    """Masked text with markers. ``statements`` gives the patterns of whole statements per language."""
    branches = {}
    for name, rule in R.RULES.items():
        text = masked
        if accessors and rule.accessors:
            if rule.blocks == "indent":
                text = _indented_accessors(text)
            else:
                for need in dict.fromkeys(a.needs for a in rule.accessors):
                    headers = [a.header for a in rule.accessors if a.needs == need and not a.attached]
                    text = _mark(text, NEEDS[need], headers)
                text = _mark(text, ATTACHED, [a.header for a in rule.accessors if a.attached])
                text = _mark(text, PROPERTY, [rule.property] if rule.property else [])
                text = _mark(text, LEAD, [rule.lead] if rule.lead else [])
        starts = statements.get(name, [])
        whole = [p for p in starts if rule.blocks == "lines" or "#[" in p]
        text = _mark(text, LINE, whole)
        plain = [p for p in starts if p not in whole]
        text = _mark(text, STATEMENT, plain)
        if plain and name in HEADERS:
            text = sub(text, HEADERS[name], f"$0{HOLD}")
        if text != masked:
            branches[name] = text
    return by_language(language, branches)


def has_start(marked: str) -> str:
    return matches(marked, f"[{STARTS}{OPEN}]")


def _shrink(text: str, name: str, accessors: bool) -> str:
    """Brackets, line ends, semicolons and markers; one character for each run of other code."""
    rule = R.RULES[name]
    needs = {a.needs for a in rule.accessors} if accessors else set()
    if R.RETURN in needs:
        text = sub(text, r"\breturn\b", HAS_RETURN)
    if R.ACCESSOR in needs:
        text = sub(text, f"(?dm){ACCESSOR_WORD}", f"$0{HAS_ACCESSOR}")
    if rule.blocks == "keywords":
        opens = R.RUBY_OPENS.replace("^", f"^[{ANY_MARKER}]*")
        text = sub(sub(text, f"(?dm){opens}", "$0{"), R.RUBY_CLOSES, "}")
    if not rule.semicolons or rule.expression_bodies:
        text = sub(text, f"(?d){R.GOES_ON}", f"$0{GOES_ON}")
    equals = "=" if R.ASSIGN in needs else ""
    code = rf"[^\n()\[\]{{}};{equals}{ANY_MARKER} \t\r]"
    text = sub(text, rf"[ \t\r]++|({code}){code}*+", "$1")
    return sub(text, rf"(?:{LEAD}[^\n]*+\n++)++", f"{RUN}$0") if accessors and rule.lead else text


def shrink_text(marked: str, language: str, accessors: bool) -> str:
    """Marked text reduced to what spans depend on, brackets tagged."""
    return tag_brackets(by_language(language, {name: _shrink(marked, name, accessors) for name in R.RULES}))


def _wrap(text: str, name: str, accessors: bool, statements: bool) -> str:
    rule = R.RULES[name]
    if accessors and rule.accessors and rule.blocks != "indent":
        body = _line_body if rule.expression_bodies else _block_body
        kinds = "".join(NEEDS[need] for need in dict.fromkeys(a.needs for a in rule.accessors))
        span = rf"{LEADS}[{kinds}]{body()}"
        if rule.property:
            span += rf"|{LEADS}{PROPERTY}[^\n]*+\n++{ATTACHED}{body()}(?:\n++{ATTACHED}{body()})*+"
        text = sub(text, span, f"{OPEN}$0{CLOSE}")
        for need, token in ((R.RETURN, HAS_RETURN), (R.ASSIGN, "="), (R.ACCESSOR, HAS_ACCESSOR)):
            if any(a.needs == need for a in rule.accessors):
                text = sub(text, rf"{OPEN}({LEADS}{NEEDS[need]}[^{token}{CLOSE}]*+){CLOSE}", "$1")
    if statements:
        span = rf"{_semicolon_statement() if rule.semicolons else _line_statement()}|{LINE}[^\n]*+"
        text = sub(text, rf"({OPEN}[^{CLOSE}]*+{CLOSE})|({span})", f"$1{OPEN}$2{CLOSE}")
        text = f"replace({text}, '{OPEN}{CLOSE}', '')"
    return text


def wrap_spans(shrunk: str, language: str, accessors: bool, statements: Mapping[str, list[str]]) -> str:
    """Shrunken text in which every line of a span carries a marker.

    The first line of a span holds ``OPEN``, the following ones start with ``INSIDE``.
    """
    branches = {}
    for name in R.RULES:
        wrapped = _wrap(shrunk, name, accessors, bool(statements.get(name)))
        branches[name] = sub(wrapped, rf"(?:{OPEN}|(?!\A)\G)[^\n{CLOSE}]*+\n", f"$0{INSIDE}")
    return by_language(language, branches)


def has_span(wrapped: str) -> str:
    return f"(instr({wrapped}, '{OPEN}') > 0)"


def drop_spans(text: str, language: str, wrapped: str) -> str:
    """The text without the spans; each leaves the line end it had."""
    lines = by_language(
        language, {name: f"regexp_extract_all({text}, {quote(logical_line_regex(name))}, 0)" for name in R.RULES}
    )
    return f"""
    array_join(zip_with({lines}, split({wrapped}, '\\n', -1), (line, flag) -> CASE
        WHEN flag IS NULL THEN line
        WHEN instr(flag, '{HOLD}') > 0 AND instr(flag, '{OPEN}') > 0 THEN
          concat(regexp_extract(line, '^[ \\t]*', 0), ';', IF(instr(flag, '{CLOSE}') > 0 AND endswith(line, '\\n'), '\\n', ''))
        WHEN instr(flag, '{CLOSE}') > 0 THEN IF(endswith(line, '\\n'), '\\n', '')
        WHEN startswith(flag, '{INSIDE}') OR instr(flag, '{OPEN}') > 0 THEN ''
        ELSE line END), '')"""


def has_inline(text: str, language: str, calls: Mapping[str, str]) -> str:
    """Cheap first test: something like a call behind other code of its line."""
    tests = {
        # blank lines are passed once: behind a line's start only blanks of that line count
        name: matches(text, rf"(?dm)(?:[;{{}}):]|\A|\belse)[ \t\r\n]*+(?:{call})" + rf"|^[ \t]*+(?:{call})" * (name in R.BRACED))
        for name, call in calls.items()
    }
    return f"coalesce({by_language(language, tests)}, false)" if tests else "false"


def wrap_inline(tagged: str, language: str, calls: Mapping[str, str]) -> str:
    """Tagged masked text in which calls that share their line with other code are enclosed in markers, without tags.

    A call stands behind a brace or semicolon, or begins the text, or a line where
    bodies always have braces. It ends with its semicolon, or before a closing
    brace or the end of its line; its brackets may hold anything. Behind the
    brackets of a header, ``else`` or a colon it is the whole body and is marked with
    ``HOLD``: something empty has to stay. Every piece inside starts with a marker.
    """
    behind = r"(?<=;|[{}]-?[0-9]{1,9},)[ \t\r\n]*+|\A[ \t\r\n]*+"
    blank = r"[ \t]*+"
    branches = {}
    for name, call in calls.items():
        cut = cuts(name)

        def body(after: str, call: str = call, name: str = name) -> str:
            if R.RULES[name].semicolons:
                return rf"(?=(?:{call}))(?:[^()\[\]{{}};]++|{_pair()})*+;{after}"
            part = lambda: rf"[^()\[\]{{}};\n]*+{_pair(r'(\[', r')\]')}"
            chain = rf"{part()}(?:[.?!:]{part()})*+"
            return rf"(?=(?:{call})){chain}(?:{blank};{after}|(?=[ \t\r]*+(?:}}|\n|\z)))"

        if name == "python":
            header = rf"{R.PYTHON_HEADER}(?:[^()\[\]{{}}:;\n]++|{_pair()})*+:{blank}"
            after = r"(?=[ \t\r]*+(?:\n|\z))"
        else:
            header, after = rf"(?:{R.CONTROL}{_pair('(', ')')}|\belse(?![\w$])){blank}", ""
        text = sub(tagged, rf"(?dm)(?<head>{header})(?<call>{body('')}){after}", f"${{head}}{HOLD}{OPEN}${{call}}{CLOSE}")
        # the semicolons in the head of a loop end no statement
        loop = rf"(?<loop>\bfor\b{blank}{_pair('(', ')')})"
        start = f"{behind}|^{blank}" if name in R.BRACED else behind
        text = sub(text, rf"(?dm){loop}|(?<blank>{start})(?<call>{body(blank)})", f"${{loop}}${{blank}}{OPEN}${{call}}{CLOSE}")
        text = f"replace({text}, '{OPEN}{CLOSE}', '')"
        text = untag_brackets(text)
        branches[name] = sub(text, rf"(?:{OPEN}|(?!\A)\G)[^{cut}{CLOSE}]*+[{cut}](?!{CLOSE})", f"$0{INSIDE}")
    return by_language(language, branches)


def drop_inline(text: str, language: str, wrapped: str, names: Iterable[str]) -> str:
    """The text without the calls, piece by piece; strings and comments lie inside pieces."""

    def pieces(of: str, pattern: str) -> str:
        return f"regexp_extract_all({of}, {quote(pattern)}, 0)"

    own = by_language(language, {name: pieces(text, piece_regex(name)) for name in names})
    flags = by_language(language, {name: pieces(wrapped, rf"(?d)[^{cuts(name)}]*+[{cuts(name)}]?+") for name in names})
    empty = f"IF({language} = 'python', 'pass', ';')"
    return f"""
    array_join(zip_with({own}, {flags}, (piece, flag) -> CASE
        WHEN flag IS NULL OR piece IS NULL THEN coalesce(piece, '')
        WHEN instr(flag, '{HOLD}') > 0 THEN concat(regexp_extract(piece, '^(?:[ \\t]*else)?[ \\t]*', 0), {empty})
        WHEN instr(flag, '{OPEN}') > 0 THEN regexp_extract(piece, '^[ \\t\\r\\n]*', 0)
        WHEN instr(flag, '{CLOSE}') > 0 AND startswith(flag, '{INSIDE}') THEN regexp_replace(piece, '^[ \\t]+', '')
        WHEN startswith(flag, '{INSIDE}') THEN ''
        ELSE piece END), '')"""
