"""What was listed against what could be read, and a run that reports it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from checks import registry
from sheaf import PackOptions
from sheaf.operators.manifest import FAILED, IGNORED, INCLUDED
from sheaf.plans.pack import pack_files, pack_reported
from sheaf.sources import files
from sheaf.sources.files import CHANGED, NOT_READ, TOO_LONG, list_files, read_files
from sheaf.sources.tables import CORPUS_COLUMNS


def break_checksum(path):
    """A checksum file beside ``path`` that its bytes don't meet: reading it is an I/O error, also for root."""
    path.with_name(f".{path.name}.crc").write_bytes(b"crc\x00" + (512).to_bytes(4, "big") + b"\x01\x02\x03\x04")


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "src"
    (root / "sub").mkdir(parents=True)
    (root / "good.go").write_text("package a\n")
    (root / "sub" / "é b.go").write_text("package b\n// é\n")
    (root / "bad.go").write_text("package bad\n")
    break_checksum(root / "bad.go")
    (root / "long.go").write_text("package long\n" + "x" * 5000)
    return root


def outcome(df):
    return {r.path.rsplit("/", 1)[-1]: (r.content, r.raw_size, r.error) for r in df.collect()}


def test_broken_files_are_rows(spark, folder):
    out = read_files(spark, [str(folder)])
    assert out.columns == CORPUS_COLUMNS
    got = outcome(out)
    assert got == {
        "good.go": ("package a\n", 10, None),
        "é b.go": ("package b\n// é\n", 16, None),
        "bad.go": (None, 12, NOT_READ),
        "long.go": ("package long\n" + "x" * 5000, 5013, None),
    }
    assert out.count() == list_files(spark, [str(folder), f"{folder}/sub"]).count() == 4


def test_files_above_a_length(spark, folder):
    unwanted = outcome(read_files(spark, [str(folder)], max_length=100))
    assert unwanted["long.go"] == (None, 5013, None) and unwanted["bad.go"][2] == NOT_READ
    key = "spark.sql.sources.binaryFile.maxLength"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 1000)
        assert outcome(read_files(spark, [str(folder)]))["long.go"] == (None, 5013, TOO_LONG)
        assert outcome(read_files(spark, [str(folder)], max_length=10_000))["long.go"] == (None, 5013, TOO_LONG)
        assert outcome(read_files(spark, [str(folder)], max_length=500))["long.go"] == (None, 5013, None)
    finally:
        spark.conf.set(key, before)


def test_content_of_another_length(spark, folder, monkeypatch):
    """A file that grows between listing and reading, made by a scan that reports one byte less."""
    raw = files._raw
    shorter = F.when(F.col("path").endswith("/good.go"), F.col("length") - 1).otherwise(F.col("length"))
    monkeypatch.setattr(files, "_raw", lambda *args: raw(*args).withColumn("length", shorter))
    got = outcome(read_files(spark, [str(folder)]))
    assert got["good.go"] == (None, 9, CHANGED) and got["é b.go"][2] is None


def test_file_that_vanishes(spark, folder, monkeypatch):
    """Gone after the listing was written down."""
    listed = files.list_files

    def listing(*args):
        out = listed(*args)
        rows = spark.createDataFrame(out.collect(), out.schema)
        (folder / "good.go").unlink()
        return rows

    monkeypatch.setattr(files, "list_files", listing)
    got = outcome(read_files(spark, [str(folder)]))
    assert got["good.go"] == (None, 10, NOT_READ) and len(got) == 4


def test_only_errors_and_nothing(spark, tmp_path):
    (tmp_path / "bad.go").write_text("x\n")
    break_checksum(tmp_path / "bad.go")
    assert outcome(read_files(spark, [str(tmp_path)])) == {"bad.go": (None, 2, NOT_READ)}
    with pytest.raises(ValueError, match="no valid files"):
        pack_files(spark, PackOptions(include="*.go", roots=(str(tmp_path),)))
    empty = tmp_path / "empty"
    empty.mkdir()
    assert read_files(spark, [str(empty)]).count() == 0


def test_pack_reports_errors(spark, folder):
    options = PackOptions(include="*.go", roots=(str(folder),), work_dir=str(folder), max_file_size="1KB", output_path="all.xml")
    packed = pack_files(spark, options)
    status = {r.path.rsplit("/", 1)[-1]: (r.status, r.reason) for r in packed.manifest.collect()}
    assert {k: v[0] for k, v in status.items()} == {
        "good.go": INCLUDED, "é b.go": INCLUDED, "bad.go": FAILED, "long.go": IGNORED,
    }
    assert status["bad.go"][1] == NOT_READ
    [bundle] = packed.bundles.collect()
    assert bundle.documents == 2 and "package a" in bundle.bundle and "package bad" not in bundle.bundle


def test_reported_table(spark):
    """Errors of a table's own rows are reported too, and leave the others alone."""
    df = spark.createDataFrame([("a.go", "package a\n", None), ("b.go", None, "no such row")], "path string, content string, error string")
    from sheaf.sources.tables import to_corpus

    corpus = to_corpus(df, F.col("path"), F.col("content"), error=F.col("error"))
    packed = pack_reported(corpus, PackOptions(include="*.go", output_path="all.json"))
    assert {(r.path, r.status, r.reason) for r in packed.manifest.collect()} == {
        ("a.go", INCLUDED, ""), ("b.go", FAILED, "no such row"),
    }
    assert [r.documents for r in packed.bundles.collect()] == [1]


@pytest.mark.parametrize("name", ["scan_files", "read_files"])
def test_queries_equal_sql(spark, name):
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.01")
    want = duckdb.sql(registry.ORACLES[name]).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
