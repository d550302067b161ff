"""Identity through links against following every chain."""

import random

from pyspark.sql import functions as F

from sheaf.operators import links
from sheaf.options import PackOptions
from sheaf.plans.pack import pack_reported
from sheaf.sources.tables import to_corpus


def follow(target, path):
    seen, at = set(), path
    while at in target and target[at] is not None and at not in seen:
        seen.add(at)
        at = target[at]
    if at in seen:
        return None, links.CYCLE
    return (at, None) if at in target else (None, links.BROKEN)


def test_chains_cycles_and_a_hot_target(spark):
    rng = random.Random(2)
    target = {f"f{i}": None for i in range(20)}
    target |= {f"c{i}": f"c{i - 1}" if i else "f3" for i in range(70)}  # a long chain
    target |= {f"r{i}": f"r{(i + 1) % 9}" for i in range(9)} | {"self": "self", "into": "r4", "dead": "gone", "far": "dead"}
    target |= {f"h{i}": "f0" for i in range(60)}
    target |= {f"x{i}": rng.choice([f"x{rng.randrange(40)}", f"f{rng.randrange(25)}"]) for i in range(40)}
    rows = [*target.items(), (None, "f1"), (None, None)]
    df = spark.createDataFrame(rows, "path string, target string").selectExpr("*", "'own' AS _from_here")
    got = links.resolve_links(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.path is None:
            assert (r.identity, r.link_error) == (None, None)
        else:
            assert (r.identity, r.link_error) == follow(target, r.path), r
    one = links.distinct_files(df).collect()
    fine = {p: follow(target, p)[0] for p in target if not follow(target, p)[1]}
    assert sorted(r.path for r in one if not r.link_error) == sorted(set(fine.values()))
    assert {r.path for r in one if r.link_error} == {p for p in target if follow(target, p)[1]}


def test_without_links_or_rows(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("a", None)], "path string, target string")
    assert sorted((r.path, r.identity) for r in links.distinct_files(df).collect()) == [("a", "a"), ("b", "b")]
    assert links.resolve_links(df.where("1 = 0")).count() == 0


def test_pack_takes_each_file_once_and_reports_links_that_reach_none(spark):
    rows = [
        ("src/a.go", None, "package a\n"), ("src/b.go", "src/a.go", "package a\n"), ("src/c.go", "src/b.go", "package a\n"),
        ("src/m.go", "lib/only.txt", "package x\n"), ("src/n.go", "src/m.go", "package x\n"), ("lib/only.txt", None, "package x\n"),
        ("src/dead.go", "gone", ""), ("src/r.go", "src/s.go", ""), ("src/s.go", "src/r.go", ""), ("src/a.go", None, "package a\n"),
    ]
    df = spark.createDataFrame(rows, "p string, target string, t string")
    corpus = to_corpus(df, F.col("p"), F.col("t"), keep=("target",))
    options = PackOptions(include="*.go", roots=("src",), link_target="target")
    packed = pack_reported(corpus, options)
    told = {r.path: (r.status, r.reason) for r in packed.manifest.collect()}
    # a.go for itself and its two links; m.go for a file that no pattern selects, and for n.go
    assert told == {
        "src/a.go": ("INCLUDED", ""), "src/m.go": ("INCLUDED", ""), "src/dead.go": ("ERROR", links.BROKEN),
        "src/r.go": ("ERROR", links.CYCLE), "src/s.go": ("ERROR", links.CYCLE),
    }
    bundle = packed.bundles.collect()
    assert [r.documents for r in bundle] == [2]
