"""Pattern lists, by rules: each property is generated, results come from definitions in this file."""

import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.functions.globs import BANNED, MAX_LENGTH, check_patterns, expand_patterns, glob_filter, glob_regex, split_patterns
from sheaf.operators.select import select_paths

PLAIN = st.text("abz.*?/", min_size=1, max_size=5).filter(lambda s: not any(b in s for b in BANNED) and "//" not in s)
# an opening brace that is escaped ends the expansion of its pattern, see below
ESCAPED = st.sampled_from(["\\,", "\\}", "\\*"])
#: Lists of parts: a text, or a tuple of options, each a list of parts again.
PARTS = st.recursive(
    st.lists(PLAIN | ESCAPED, min_size=1, max_size=3),
    lambda inner: st.lists(PLAIN | st.lists(inner, min_size=2, max_size=3).map(tuple), min_size=1, max_size=3),
    max_leaves=8,
)


def written(parts):
    return "".join(p if isinstance(p, str) else "{" + ",".join(written(o) for o in p) + "}" for p in parts)


def meant(parts):
    """All choices of options, the first brace varying slowest."""
    choices = [[p] if isinstance(p, str) else [t for option in p for t in meant(option)] for p in parts]
    return ["".join(c) for c in itertools.product(*choices)]


@settings(max_examples=200, deadline=None)
@given(PARTS)
def test_braces_stand_for_every_choice(parts):
    text = written(parts)
    # a list that starts with an escape stays whole, so those begin with a letter here
    assert expand_patterns("q" + text) == ["q" + t for t in meant(parts)]


def test_forms_with_an_escaped_opening_brace_are_not_expanded_further():
    for k in range(3):
        later = "{" + ",".join("uvw"[: k + 1]) + "}"
        assert expand_patterns("q{z,\\{}" + later) == [f"qz{x}" for x in "uvw"[: k + 1]] + ["q\\{" + later]


def test_an_empty_option_counts_unless_it_is_the_last():
    for before, after in itertools.product(["", "k"], ["", "-v"]):
        assert expand_patterns(f"{before}u{{,w}}{after}") == [f"{before}u{after}", f"{before}uw{after}"]
        assert expand_patterns(f"{before}u{{w,}}{after}") == [f"{before}uw{after}"]
        assert expand_patterns(f"{before}u{{}}{after}") == [f"{before}u{{}}{after}"]


@settings(max_examples=200, deadline=None)
@given(st.lists(PARTS, max_size=4), st.lists(st.sampled_from(["", " ", "  "]), min_size=5, max_size=5))
def test_lists_fall_apart_at_commas_outside_braces(items, blanks):
    texts = ["q" + written(i) for i in items]
    joined = ",".join(blank + t + blank for t, blank in zip(texts, blanks, strict=False))
    assert split_patterns(joined) == texts
    assert split_patterns("," + joined + ",,") == texts
    whole = "\\," + ",".join(texts)
    assert split_patterns(whole) == [whole]


@settings(max_examples=150, deadline=None)
@given(PARTS, st.integers(0, 40))
def test_one_bracket_too_many_is_refused(parts, at):
    text = "q" + written(parts) + "w"
    check_patterns(text)
    # between two characters, but not behind an escape
    places = [k for k in range(1, len(text)) if not re.search(r"(?:^|[^\\])(?:\\\\)*\\$", text[:k])]
    k = places[at % len(places)]
    for extra in ("{", "}", "[", "]"):
        with pytest.raises(ValueError, match="brace" if extra in "{}" else "bracket"):
            check_patterns(text[:k] + extra + text[k:])


def test_other_refusals():
    check_patterns("é" * (MAX_LENGTH // 2))
    refused = ["é" * (MAX_LENGTH // 2) + "e", "u\0v", "u\\", "u\\\\\\"]
    refused += [f"u{banned}v" for banned in BANNED]
    for text in refused:
        with pytest.raises(ValueError):
            check_patterns(text)
    check_patterns("u\\\\")


def _brute(pattern, path):
    """Match by definition, one character or segment at a time."""

    def seg(p, s):
        if not p:
            return not s
        if p[0] == "*":
            return any(seg(p[1:], s[i:]) for i in range(len(s) + 1))
        if p[0] == "[":
            end = p.index("]")
            members, negated = p[1:end].lstrip("!^"), p[1] in "!^"
            return bool(s) and ((s[0] in members) != negated) and seg(p[end + 1 :], s[1:])
        if p[0] == "\\":
            return bool(s) and p[1] == s[0] and seg(p[2:], s[1:])
        return bool(s) and (p[0] == "?" or p[0] == s[0]) and seg(p[1:], s[1:])

    def parts(ps, ss):
        if not ps:
            return not ss
        if ps[0] == "**":
            return any(parts(ps[1:], ss[i:]) for i in range(len(ss) + 1))
        return bool(ss) and seg(ps[0], ss[0]) and parts(ps[1:], ss[1:])

    return parts(pattern.split("/"), path.split("/"))


def _hit(patterns, path):
    return any(_brute(p, path if "/" in p else path.split("/")[-1]) for p in patterns)


def _random_lists(rng):
    segments = ["*", "?", "a", "b*", "*a", "[ab]?", "[!a]*", "[^b]", "\\*", "**", "a.b", "*.b"]
    return ["/".join(rng.choice(segments) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 3))]


def _random_paths(rng, n):
    names = ["a", "b", "ab", "ba", "*", "a.b", "axb", "bb.b", ".a"]
    return sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(n)})


def test_filters_against_brute_force(spark):
    rng = random.Random(11)
    paths = _random_paths(rng, 150)
    cases = []
    while len(cases) < 40:
        include, exclude = _random_lists(rng), _random_lists(rng)
        # "*" beside "**" in a segment is a form of its own, and a list that starts with an escape is not split
        if any(p.startswith("\\") for p in include[:1] + exclude[:1]):
            continue
        cases.append((include, exclude))
    df = spark.createDataFrame([(p,) for p in paths], "v string")
    columns = [glob_filter(F.col("v"), ",".join(i), ",".join(e)).alias(f"c{k}") for k, (i, e) in enumerate(cases)]
    for row in df.select("v", *columns).collect():
        for k, (include, exclude) in enumerate(cases):
            want = not _hit(exclude, row.v) and (not include or _hit(include, row.v))
            assert row[f"c{k}"] == want, (include, exclude, row.v)


def test_an_exclamation_mark_moves_a_pattern_to_the_other_side(spark):
    rng = random.Random(12)
    paths = _random_paths(rng, 80)
    df = spark.createDataFrame([(p,) for p in paths], "v string")
    for negative in ("a/**", "*.b", "**/b*"):
        got = df.where(glob_filter(F.col("v"), f"*,!{negative}", "")).collect()
        assert sorted(r.v for r in got) == [p for p in paths if not _hit([negative], p)]


def test_patterns_start_at_the_root_or_at_the_stored_path(spark):
    rng = random.Random(13)
    paths = _random_paths(rng, 60)
    df = spark.createDataFrame([(f"/top/in/{p}",) for p in paths], "path string")
    for include, exclude in (("**/a", ""), ("*", "a/**"), ("a/*,b/*", "**/*.b"), ("**.b", "")):
        got = select_paths(df, include, exclude, roots=["/top/in"]).collect()
        # within a segment two stars are one
        own = [p if p != "**.b" else "*.b" for p in include.split(",")]
        want = [p for p in paths if _hit(own, p) and not (exclude and _hit([exclude], p))]
        assert sorted(r.path.removeprefix("/top/in/") for r in got) == want
        if exclude == "a/**":
            assert select_paths(df, include, exclude, roots=["/top/in"], anchor="absolute").count() == len(paths)


PIECE = st.text("ab*?", min_size=1, max_size=3).filter(lambda s: "**" not in s)


@settings(max_examples=300, deadline=None)
@given(
    st.lists(PIECE | st.just("**"), min_size=2, max_size=4),
    st.lists(st.text("ab", min_size=1, max_size=3), min_size=1, max_size=4),
)
def test_regex_against_brute_force(pattern, path):
    text = "/".join(path)
    regex = glob_regex("/".join(pattern)).replace("\\z", "\\Z")
    assert bool(re.fullmatch(regex, text, re.S)) == _brute("/".join(pattern), text)
