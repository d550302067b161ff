"""Assignment to a table of outputs against comparing every path with every output."""

import random

import pytest

from sheaf.operators import assign


def best(path, outputs):
    """The output that shares the most leading segments; ties go to the smaller (ordinal, output)."""
    if path is None:
        return None
    parts = assign._parts(assign._strip(path))

    def shared(output):
        n = 0
        for one, other in zip(parts, assign._parts(assign._strip(output))):
            if one != other:
                break
            n += 1
        return n

    most = max((shared(o) for o, _ in outputs), default=0)
    return min((i, o) for o, i in outputs if shared(o) == most)[1] if most else None


def names(rng, n, letters="abc"):
    return ["/".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(n)]


def run(spark, paths, outputs, partitions=None):
    df = spark.createDataFrame([(p, "own") for p in paths], "path string, _kind string")
    table = spark.createDataFrame(outputs, "output string, ordinal bigint")
    rows = assign.assign_to_table(df, table, partitions=partitions).collect()
    assert len(rows) == len({r.path for r in rows})
    return {r.path: r.output for r in rows}


@pytest.mark.parametrize("seed, partitions", [(1, 1), (2, 3), (3, 40), (4, None)])
def test_against_every_output(spark, seed, partitions):
    rng = random.Random(seed)
    # sparse outputs leave whole ranges without one; names that sort around the slash, and ordinals that tie
    outputs = [(o + rng.choice(["", ".xml", "-x", " y"]), rng.randrange(20)) for o in names(rng, [3, 10, 40, 120][seed - 1])]
    paths = [p + rng.choice(["", ".go", "-x/f", " y/f", "!", "/"]) for p in names(rng, 400, "abcd")]
    paths += [None, None, "", "/", "a/" * 40 + "deep", "é/ü", paths[0]]
    assert run(spark, paths, outputs, partitions) == {p: best(p, outputs) for p in paths}


def test_empty_sides(spark):
    assert run(spark, ["a/b", None], []) == {"a/b": None, None: None}
    assert run(spark, [], [("a.xml", 0)]) == {}


def test_many_outputs_of_one_folder(spark):
    count = 100_000
    table = spark.range(count).selectExpr("concat('r/all/o', id, '.xml') AS output", "id AS ordinal")
    # two thirds of the paths are next to one output, the others have one each or share only the folder
    paths = spark.range(60_000).selectExpr(
        "CASE WHEN id % 3 < 2 THEN concat('r/all/o7/', id) WHEN id % 2 = 0 THEN concat('r/all/o', id, '/x')"
        " ELSE concat('r/all/q', id) END AS path"
    )
    got = assign.assign_to_table(paths, table)
    wrong = got.where(
        "output <> CASE WHEN path LIKE '%/x' THEN concat(substring_index(path, '/', 3), '.xml')"
        " WHEN path LIKE 'r/all/o7/%' THEN 'r/all/o7.xml' ELSE 'r/all/o0.xml' END OR output IS NULL"
    )
    assert got.count() == 60_000 and wrong.count() == 0


def test_rows_are_not_multiplied_by_depth(spark):
    paths = spark.createDataFrame([("a/b/c/d/e/f",)], "path string")
    plan = assign.assign_to_table(paths, spark.createDataFrame([("a/b.xml", 0)], "output string, ordinal bigint"))
    assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()
