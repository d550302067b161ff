"""Secret scans: patterns, and tokens that pass for random under a battery of tests.

Everything is an expression over the row: pattern matches get their places from
the pieces between them, tokens are tested with array functions. The decision
which tokens pass is corpus-wide: p-values of all tokens are counted by length
class and size, and the Benjamini-Hochberg rule on these counts says from which
p-value on a token is told apart from random text. What it does not tell apart
is reported.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.llm.store import stored
from sheaf.operators.settle import settle

#: The base patterns (fixed values) and the shortest text that counts.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
# a run that is too short is no match of these, and no match can begin inside it
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: Tokens that are tested. "=" is padding at their end or stands between a name and its value.
PADDING = "(?:=++(?![A-Za-z0-9+/_-]))?"
TOKEN = "[A-Za-z0-9+/_-]{20,}" + PADDING
#: Symbols of the two base64 alphabets; a token may hold both, and is then tested by its parts.
STANDARD, URL_SAFE = "[+/]", "[_-]"
PARTS = ("[A-Za-z0-9_-]{20,}" + PADDING, "[A-Za-z0-9+/]{20,}" + PADDING)
#: Encodings by the smallest alphabet that holds the token, its symbols in the order of their values.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base32lower", "^[a-z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36", "^[0-9a-z]+=*$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "^[0-9A-Z]+=*$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", "^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Bins of -log10(p) per unit, and how many units are told apart.
FINE, UNITS = 100, 16

_SPAN = "array<struct<start: int, end: int>>"


def _none() -> Column:
    return F.from_json(F.lit("[]"), _SPAN)


def match_spans(text: Column, pattern: str, group: int = 0, least: int = 0, texts: bool = False) -> Column:
    """Places (code points, end exclusive) of all matches whose ``group`` has ``least`` characters.

    With ``texts`` the matches come along as ``t``: to cut them out by place would walk the text for each.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    before = F.split(text, pattern, -1)
    # the piece before a match, the match, and what must be long enough of it
    rows = F.transform(
        F.arrays_zip(F.slice(before, 1, F.size(whole)).alias("b"), whole.alias("w"), values.alias("v")),
        lambda r: F.struct(
            F.length(r["b"]).alias("b"), F.length(r["w"]).alias("w"), F.length(r["v"]).alias("v"), r["w"].alias("t")
        ),
    )
    fields = ("start", "end", "t") if texts else ("start", "end")

    def placed(r: Column) -> Column:
        ends = _running(F.transform(r, lambda x: x["b"] + x["w"]), lambda x, y: x + y)
        spans = F.zip_with(
            r,
            ends,
            lambda x, e: F.struct((e - x["w"]).alias("start"), e.alias("end"), x["t"].alias("t"), (x["v"] >= least).alias("ok")),
        )
        return F.transform(F.filter(spans, lambda x: x["ok"]), lambda x: F.struct(*[x[f].alias(f) for f in fields]))

    return _let(rows, placed)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, combine) -> Column:
    """Running total of an array under ``combine``, by doubling: n log n steps for n values.

    Adding to an array one element at a time would copy it each time.
    """
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda step: step < F.size(values))

    def widen(held: Column, step: Column) -> Column:
        return F.transform(held, lambda x, i: F.when(i >= step, combine(x, F.get(held, i - step))).otherwise(x))

    return F.aggregate(steps, values, widen)


def _tail(z: Column) -> Column:
    """Probability of a normal variate beyond |z| on both sides (rational approximation, error below 2e-7)."""
    terms = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

    def tail(x: Column) -> Column:
        def by(t: Column) -> Column:
            poly = F.lit(0.0)
            for c in reversed(terms):
                poly = (poly + F.lit(c)) * t
            return F.least(F.lit(1.0), F.greatest(F.lit(0.0), poly * F.exp(-x * x)))

        return _let(F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x), by)

    return _let(F.abs(z) / F.lit(math.sqrt(2)), tail)


def _uniform(token: Column, n: Column, symbols: Column) -> Column:
    """Chi-squared test that all symbols are alike frequent, as a one-sided p-value (cube-root transform)."""
    # at most as many passes as the alphabet has symbols
    count = lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("long")
    squares = F.aggregate(
        F.array_distinct(F.split(token, "")), F.lit(0).cast("long"), lambda sum_, c: sum_ + count(c) * count(c)
    )
    chi = symbols * squares / n - n
    free = symbols - 1
    spread = F.lit(2.0) / (F.lit(9.0) * free)
    z = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (F.lit(1.0) - spread)) / F.sqrt(spread)
    return _let(z, lambda z: F.when(z > 0, _tail(z) / 2).otherwise(F.lit(1.0) - _tail(z) / 2))


def _runs(values: Column, n: Column, symbols: Column) -> Column:
    """Runs test of symbols from the upper and the lower half of the alphabet."""

    def tested(ups: Column, changes: Column) -> Column:
        mean = F.lit(2.0) * ups * (n - ups) / n + 1
        variance = (mean - 1) * (mean - 2) / (n - 1)
        return F.when(variance > 0, _tail((changes + F.lit(1.0) - mean) / F.sqrt(variance))).otherwise(F.lit(0.0))

    def counted(high: Column) -> Column:
        changes = F.size(F.filter(F.zip_with(F.slice(high, 2, 1 << 30), high, lambda a, b: a != b), lambda c: c))
        ups = F.size(F.filter(high, lambda h: h)).cast("double")
        return _let(ups, lambda u: _let(changes, lambda c: tested(u, c)))

    return _let(F.transform(values, lambda v: v >= symbols / 2), counted)


def _serial(values: Column, n: Column, symbols: Column) -> Column:
    """Correlation of neighbouring symbol values against that of independent uniform ones."""
    centre = (symbols - 1) / 2
    pairs = F.zip_with(F.slice(values, 2, 1 << 30), values, lambda a, b: (a - centre) * (b - centre))
    # the last symbol has no right neighbour
    total = F.aggregate(F.filter(pairs, lambda p: p.isNotNull()), F.lit(0.0), lambda sum_, p: sum_ + p)
    variance = (symbols * symbols - 1) / 12
    return _tail(total / (variance * F.sqrt(n - 1)))


def tested_tokens(text: Column) -> Column:
    """Tokens of ``text`` with place, encoding, length class and p-value of being random.

    Letters of one case alone, and digits alone, are words and numbers, not codes.
    The three tests share a token, so their smallest p-value counts three times.
    A token with symbols of both base64 alphabets is tested by its parts of either.
    """
    encoding = lambda t: F.coalesce(
        *[F.when(t.rlike(pattern), F.lit(name)) for name, pattern, _ in ENCODINGS], F.lit("")
    )
    alphabet = lambda name: F.element_at(
        F.create_map(*[x for n, _, symbols in ENCODINGS for x in (F.lit(n), F.lit(symbols))]), name
    )

    def parts_of(token: Column) -> Column:
        found = F.concat(*[match_spans(token["t"], part, texts=True) for part in PARTS])
        moved = F.transform(
            found,
            lambda s: F.struct(
                (s["start"] + token["start"]).alias("start"), (s["end"] + token["start"]).alias("end"), s["t"].alias("t")
            ),
        )
        # a part of plain letters and digits is one of both kinds
        return _once(moved)

    cut = F.flatten(
        F.transform(
            match_spans(text, TOKEN, texts=True),
            lambda s: F.when(s["t"].rlike(STANDARD) & s["t"].rlike(URL_SAFE), parts_of(s)).otherwise(F.array(s)),
        )
    )
    mixed = F.filter(
        cut, lambda s: s["t"].rlike("[0-9]") & s["t"].rlike("[A-Za-z]") | s["t"].rlike("[A-Z]") & s["t"].rlike("[a-z]")
    )
    known = F.transform(
        mixed,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.rtrim(s["t"], F.lit("=")).alias("t"),
            encoding(s["t"]).alias("encoding"),
        ),
    )
    known = F.filter(known, lambda s: (s["encoding"] != "") & (F.length(s["t"]) >= 20))
    valued = F.transform(
        known,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["t"].alias("t"),
            s["encoding"].alias("encoding"),
            F.length(s["t"]).cast("double").alias("n"),
            F.length(alphabet(s["encoding"])).cast("double").alias("k"),
            F.transform(
                F.split(s["t"], ""), lambda c: _place(alphabet(s["encoding"]), c)
            ).alias("v"),
        ),
    )
    return F.transform(
        valued,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["encoding"].alias("encoding"),
            F.floor(F.log2(s["n"])).cast("int").alias("length_class"),
            F.least(
                F.lit(1.0),
                F.lit(3.0) * F.least(_uniform(s["t"], s["n"], s["k"]), _runs(s["v"], s["n"], s["k"]), _serial(s["v"], s["n"], s["k"])),
            ).alias("p"),
        ),
    )


def _once(spans: Column) -> Column:
    """Distinct spans, sorted; a search per span would take time with their square."""
    other = lambda s, last: (s["start"] != last["start"]) | (s["end"] != last["end"])
    return _let(
        F.array_sort(spans), lambda a: F.filter(a, lambda s, i: (i == 0) | other(s, F.get(a, i - 1)))
    )


def _place(symbols: Column, symbol: Column) -> Column:
    return (F.call_function("instr", symbols, symbol) - 1).cast("double")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, assign, access, hex, tokens``: places of the base patterns and the tested tokens of whole texts.

    Cheap tests come first: most texts have no key word, no prefix and no long token.
    """
    text = F.col("_text")
    lower = F.lower(text)
    worded = lower.contains("passw") | lower.contains("secret") | lower.contains("token") | lower.contains("api")
    marked = settle(
        docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text")),
        {"_worded": worded, "_key": text.contains("AKIA"), "_long": text.rlike(TOKEN)},
        ["doc_id", "_text"],
    )
    kinds = {
        "assign": F.when(F.col("_worded"), match_spans(text, ASSIGN, 1, ASSIGN_LEAST)).otherwise(_none()),
        "access": F.when(F.col("_key"), match_spans(text, ACCESS)).otherwise(_none()),
        "hex": F.when(F.col("_long"), match_spans(text, HEX)).otherwise(_none()),
        "tokens": F.when(F.col("_long"), tested_tokens(text)),
    }
    return settle(marked, kinds, ["doc_id"])


def discovery_limits(scanned: DataFrame, rate: float) -> DataFrame:
    """``length_class, limit``: tokens with a p-value up to the limit are told apart from random text.

    Of the tokens told apart, no more than ``rate`` are random ones, in each length
    class by itself: long tokens are told apart far more easily, and would decide
    for short ones. p-values are counted in bins, so the table has a fixed size.
    """
    tokens = scanned.select(F.inline(F.coalesce("tokens", F.filter("tokens", lambda _: F.lit(False)))))
    bin_ = F.least(F.lit(UNITS * FINE), F.floor(-F.log10(F.greatest("p", F.lit(1e-300))) * FINE)).cast("int")
    counts = tokens.groupBy("length_class", bin_.alias("bin")).agg(F.count("*").alias("n"))
    # the largest p-value that falls into the bin
    edge = F.pow(F.lit(10.0), -F.col("bin") / F.lit(float(FINE)))
    up_to = Window.partitionBy("length_class").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.sum("n").over(up_to)).withColumn(
        "_all", F.sum("n").over(Window.partitionBy("length_class"))
    )
    kept = ranked.where(edge <= F.lit(rate) * F.col("_upto") / F.col("_all"))
    return kept.groupBy("length_class").agg(F.max(edge).alias("limit"))


def _tagged(spans: Column, k: int) -> Column:
    """Spans that sort by start and then kind."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(k).alias("no"), s["end"].alias("end"), F.lit(KINDS[k]).alias("kind")
        ),
    )


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def _united(spans: Column) -> Column:
    """Spans that overlap become one."""

    def merged(a: Column, reach: Column) -> Column:
        # a span begins a new one where no span before reaches beyond its start
        places = F.transform(a, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(reach, i - 1)), i))
        firsts = F.filter(places, lambda i: i.isNotNull())
        return _let(
            firsts,
            lambda f: F.transform(
                f,
                lambda i, k: F.struct(
                    F.get(a, i)["start"].alias("start"),
                    F.get(reach, F.coalesce(F.get(f, k + 1), F.size(a)) - 1).alias("end"),
                ),
            ),
        )

    furthest = lambda a: _let(F.transform(a, lambda s: s["end"]), lambda e: _running(e, F.greatest))
    return _let(F.array_sort(_plain(spans)), lambda a: _let(furthest(a), lambda reach: merged(a, reach)))


def _apart(spans: Column, from_: Column) -> Column:
    """Those of ``spans`` that overlap none of ``from_``: one sort and two running totals."""
    tag = lambda s, own: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("own"))
    all_ = F.array_sort(F.concat(F.transform(spans, lambda s: tag(s, True)), F.transform(from_, lambda s: tag(s, False))))
    # how far the others before reach, and where the next of the others begins
    reach = lambda a: _let(F.transform(a, lambda s: F.when(s["own"], F.lit(-1)).otherwise(s["end"])), lambda e: _running(e, F.greatest))
    next_ = lambda a: F.reverse(
        _let(
            F.reverse(F.transform(a, lambda s: F.when(s["own"], F.lit((1 << 31) - 1)).otherwise(s["start"]))),
            lambda e: _running(e, F.least),
        )
    )
    free = lambda a, r, n: F.filter(
        a, lambda s, i: s["own"] & (F.get(r, i) <= s["start"]) & (F.get(n, i) >= s["end"])
    )
    return _plain(_let(all_, lambda a: _let(reach(a), lambda r: _let(next_(a), lambda n: free(a, r, n)))))


def find_secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random`` of whole texts.

    Base kinds are matched leftmost without overlaps, each by itself. ``spans``
    adds ``random``: tokens of 20 characters or more that the battery can't tell
    from random text and that no base span covers; parts of a token that overlap
    are one span. Spans are kind:start:end in code
    points, end exclusive, by start and then kind, comma-joined; base_sha256 is
    that of the base spans alone.

    A null or empty text has no spans (the hash is that of the empty string).
    Repeated rows each have their line; other columns are left out; an empty table
    gives an empty result.
    """
    scanned = stored(scan(docs), "scanned")
    # at most one row per length class
    limits = {r["length_class"]: r["limit"] for r in discovery_limits(scanned, rate).collect()}
    pairs = [x for k, v in sorted(limits.items()) for x in (F.lit(k), F.lit(v))]
    limit = lambda t: (
        F.coalesce(F.element_at(F.create_map(*pairs), t["length_class"]), F.lit(0.0)) if pairs else F.lit(0.0)
    )
    base = F.concat(*[_tagged(F.col(kind), k) for k, kind in enumerate(KINDS[:3])])
    kept = scanned.withColumn("_base", base)
    random = F.filter("tokens", lambda t: t["p"] > limit(t))
    random = F.when(F.size(random) > 0, _tagged(_united(_apart(_plain(random), _plain(F.col("_base")))), 3))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return kept.withColumn("_random", F.coalesce(random, F.filter("_base", lambda _: F.lit(False)))).select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(joined(F.col("_base")), 256).alias("base_sha256"),
        joined(F.concat(F.col("_base"), F.col("_random"))).alias("spans"),
        F.size("_random").cast("long").alias("n_random"),
    )
