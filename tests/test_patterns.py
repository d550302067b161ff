"""A table of globs against the same globs as one list, and each key against what its pattern matches."""

import itertools
import random
import re
from collections import Counter

import pytest

from sheaf.functions.globs import expand_patterns, glob_regex
from sheaf.functions.paths import base_name
from sheaf.operators import patterns as P
from sheaf.operators.select import select_paths

GLOBS = [
    "*.go", "main.?s", "[ab]*.t[!x]t", "src/**", "/abs/**", "**", "**/x/*.go", "src/*/deep/long_name*.c", "long_name_*",
    "lon*", "lo?g*", "*", "*.tar.gz", "*.", "a\\*b", "a{}b", "{x,y}/z*", "src/**/a.go", "**/**/b", "no/such/**", "é*.go", "x/",
]
PATHS = [
    "/".join(p)
    for n in (1, 2, 3)
    for p in itertools.product(["src", "x", "y", "a.go", "long_name_1.c", "zed.tar.gz"], repeat=n)
] + ["", "/", "x/", "/abs/q", "main.rs", "a*b", "ab", "q.", "é1.go", "src", "src/p/deep/long_name9.c", "b", "k/b", "at.tzt", "l\no.go"]


def test_a_path_has_the_key_of_every_pattern_that_matches_it(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    keys = {r.path: set(r["keys"]) for r in df.select("path", P._path_keys(df.path).alias("keys")).collect()}
    names = {r.path: r.name for r in df.select("path", base_name(df.path).alias("name")).collect()}
    met = 0
    for glob in [form for g in GLOBS for form in expand_patterns(g)]:
        test = re.compile("(?s:" + glob_regex(glob) + r")\Z")
        for path in PATHS:
            if test.match(path if "/" in glob else names[path]):
                met += 1
                assert P.pattern_key(glob) in keys[path], (glob, path)
    assert met > 500


@pytest.mark.parametrize("roots", [(), ("src",)])
def test_table_against_list(spark, roots):
    rng = random.Random(5)
    df = spark.createDataFrame([(p, i) for i, p in enumerate([*PATHS, None, "src/a.go"])], "path string, regex int")
    for _ in range(4):
        wanted, refused = rng.sample(GLOBS, rng.randrange(0, 5)), rng.sample(GLOBS[:4] + GLOBS[6:], rng.randrange(0, 3))
        no = rng.choice([[], ["!y/*"]])
        rows = [(g, rng.choice([False, None])) for g in wanted + no] + [(g, True) for g in refused] + [(None, None), ("", True)]
        table = spark.createDataFrame(rows, "pattern string, exclude boolean")
        got = P.select_by_table(df, table, roots)
        expected = select_paths(df, ",".join(wanted + no), ",".join(refused), roots)
        assert got.columns == df.columns
        assert sorted(r.regex for r in got.collect()) == sorted(r.regex for r in expected.collect()), rows


def test_fifty_thousand_patterns(spark):
    table = spark.range(50_000).selectExpr(
        "CASE id % 3 WHEN 0 THEN concat('f', id, '.go') WHEN 1 THEN concat('d', id, '/**/x*') ELSE concat('**/part-', id, '*.py') END"
        " AS pattern", "false AS exclude"
    )
    df = spark.range(20_000).selectExpr("concat('d', id, '/s/', CASE id % 2 WHEN 0 THEN 'x1' ELSE 'y' END, '.go') AS path")
    got = P.select_by_table(df, table)
    assert {r.path for r in got.collect()} == {f"d{i}/s/x1.go" for i in range(20_000) if i % 3 == 1 and i % 2 == 0}


def test_a_pattern_that_does_not_parse_is_named(spark):
    table = spark.createDataFrame([("*.go", False), ("a{b", False)], "pattern string, exclude boolean")
    with pytest.raises(ValueError, match="brace"):
        P.select_by_table(spark.createDataFrame([("a.go",)], "path string"), table)


def test_patterns_that_differ_in_beginning_or_end_share_no_key(spark):
    """Of thousands of patterns with one extension a path meets a few, not all."""
    globs = [
        form
        for k in range(1, 4001)
        for form in ([f"*{k}.txt"], [f"src1/*/{k}?.txt"], [f"*/{x}/{k}[0-4]*.txt" for x in ("en", "fr")], [f"d{k}/**/test_*_{k}.txt"])[k % 4]
    ]
    filed = Counter(P.pattern_key(glob) for glob in globs)
    paths = [f"src{i % 3}/en/{i}.txt" for i in range(1000)]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    keys = {r.path: r["keys"] for r in df.select("path", P._path_keys(df.path).alias("keys")).collect()}
    assert max(sum(filed[key] for key in keys[p]) for p in paths) <= 20


def test_random_globs_have_keys_of_the_paths_they_match(spark):
    rng = random.Random(7)
    pieces = ["a", "ab", "é", "1", ".", "long" * 8, "*", "?", "[ab]", "{}", "\\*", "/", "/", "**/", "/**"]
    globs, paths = set(), set()
    while len(globs) < 3000:
        glob = "".join(rng.choices(pieces, k=rng.randrange(1, 7)))
        if not re.search(r"\*\*\*", glob):
            globs.add(glob)
    for glob in globs:
        fill = re.sub(r"\*+|\?|\[ab\]", lambda m: rng.choice(["", "a", "b", "ab"]), glob.replace("\\*", "\0"))
        paths.add(fill.replace("{}", "").replace("\0", "*"))
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    keys = {r.path: set(r["keys"]) for r in df.select("path", P._path_keys(df.path).alias("keys")).collect()}
    met = 0
    for glob in globs:
        test = re.compile("(?s:" + glob_regex(glob) + r")\Z")
        for path in paths:
            if test.match(path if "/" in glob else path.rpartition("/")[2]):
                met += 1
                assert P.pattern_key(glob) in keys[path], (glob, path)
    assert met > 3000
