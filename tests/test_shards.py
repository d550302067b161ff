"""Bundles in shards against whole bundles, numbers against sorting."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from sheaf.operators import bundles, numbering, shards


def corpus(spark):
    rows = [("a", f"p{i:03}", f"<text> {i}\n" * (i % 7), i) for i in range(60)]
    rows += [("b", "only", "x" * 5000, 1), ("c", "é", "ü & é\n\n", 2), ("c", "f", None, 3), ("d", "g", "", 4)]
    rows += [("e", "same", "one", 5), ("e", "same", "one", 6), (None, "h", "no output", 7)]
    return spark.createDataFrame(rows, "output string, path string, content string, n int")


@pytest.mark.parametrize("fmt", ["xml", "json", "yaml"])
@pytest.mark.parametrize("size", [1, 700, 10**9])
def test_shards_in_turn_are_the_bundle(spark, tmp_path, fmt, size):
    df = corpus(spark).where("output IS NOT NULL").repartition(5, "n")
    folder = str(tmp_path / fmt)
    manifest = shards.write_shards(df, folder, fmt, size).collect()
    whole = {r.output: r for r in bundles.render_bundles(df, fmt, 10**9).collect()}
    assert {r.output for r in manifest} == set(whole)
    for output, bundle in whole.items():
        own = sorted((r for r in manifest if r.output == output), key=lambda r: r["shard"])
        text = b""
        for r in own:
            [file] = glob.glob(os.path.join(folder, f"output={output}", f"shard={r['shard']}", "part-*"))
            with open(file, "rb") as held:
                text += held.read()
        assert text.decode() == bundle.bundle + ("\n" if fmt == "xml" else "")
        assert sum(r.documents for r in own) == bundle.documents
        assert [r.first_index for r in own] == [1 + sum(x.documents for x in own[:k]) for k in range(len(own))]


@pytest.mark.parametrize("fmt", ["xml", "json", "yaml"])
def test_offsets_point_at_the_documents(spark, fmt):
    df = corpus(spark)
    whole = {r.output: r.bundle.encode() for r in bundles.render_bundles(df, fmt, 10**9).collect()}
    got = shards.shard_documents(df, fmt, 1000).collect()
    assert len(got) == df.count()
    lay = bundles.LAYOUTS[fmt]
    for r in got:
        part = whole[r.output][r.offset : r.offset + r.bytes].decode()
        assert part.startswith(f"{lay.before_index}{r['index']}{lay.before_source}") and part.endswith(lay.after_content)
        assert r["shard"] == r.offset // 1000
    assert shards.shard_documents(df.where("1 = 0"), fmt, 1000).count() == 0
    with pytest.raises(ValueError):
        shards.shard_documents(df, fmt, 0)


def test_an_output_over_many_ranges(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 > 0, (F.col("id") % 9).cast("string")).alias("output"),
        F.concat(F.lit("p"), F.xxhash64("id").cast("string")).alias("path"),
        F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("content"),
    )
    rows = df.collect()
    want, at = {}, {}
    for output in {r.output for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r.output == output), key=lambda r: r.path)):
            want[output, r.path] = k + 1
    got = numbering.number_documents(df.select("output", "path"), partitions=23)
    assert {(r.output, r.path): r["index"] for r in got.collect()} == want
    found = shards.shard_documents(df, "yaml", 5000).orderBy("output", "index").collect()
    for r in found:
        assert r.offset == at.get(r.output, len("documents:\n"))
        at[r.output] = r.offset + r.bytes


def test_rows_are_shuffled_once(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("output"), F.col("id").cast("string").alias("path"))
    plan = numbering.number_documents(df)._jdf.queryExecution().executedPlan().toString()
    # rows come in order from storage; what is shuffled beside them are a few numbers a range
    assert "FileScan" in plan and "Exchange" not in plan.split("FileScan", 1)[0]
