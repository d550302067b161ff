"""The stages one after the other, each against its brute-force version on what the one before kept."""

import importlib
import sys

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from sheaf.llm import quality
from sheaf.llm.queries import MIX_SQL
from test_llm_documents import leaks, linked, nulls_last
from test_llm_tokens import brute as encoded

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark):
    """Documents before each stage and after the last."""
    from sheaf.llm.store import stored

    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = stored(stage(spark, docs, SMALL))
    return [*out, docs]


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_the_columns(kept):
    assert all(df.columns == COLUMNS for df in kept[:-1])
    assert kept[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality_stage(spark, kept):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    judged = quality.score_documents(kept[0].select("doc_id", "text"), quality.fit_quality(kept[0], labels))
    assert sorted(rows(kept[1])) == sorted((r.doc_id, r.text) for r in judged.collect() if r.kept)
    clean = {r.doc_id for r in labels.collect() if r.quality == 1} & {r.doc_id for r in judged.where("NOT base_failed").collect()}
    assert len(clean & {d for d, _ in rows(kept[1])}) >= 0.97 * len(clean)


def test_near_duplicates_stage(kept):
    before = rows(kept[1])
    want = [r for r, (d, n, c) in zip(before, linked(before, 5, 80), strict=True) if d == c or not n]
    assert sorted(rows(kept[2])) == sorted(want) and len(want) < len(before)


def test_decontamination_stage(spark, kept):
    before = rows(kept[2])
    items = [(str(i), t) for i, t in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = [r for r, leak in zip(before, leaks(before, items, 10), strict=True) if not leak[1]]
    assert sorted(rows(kept[3])) == sorted(want) and len(want) < len(before)


def test_mixing_stage(kept):
    documents = pd.DataFrame(kept[3].select("doc_id", "text", "source").collect(), columns=["doc_id", "text", "source"])
    duck = duckdb.connect()
    duck.register("documents", documents)
    taken = {d: (t, s) for d, s, _, _, t in duck.sql(MIX_SQL).fetchall()}
    got = pd.Series([d for d, _ in rows(kept[4])]).value_counts().to_dict()
    assert all(got.get(d, 0) * s == t for d, (t, s) in taken.items())


def test_token_stage_and_run(spark, kept):
    want = encoded(rows(kept[4]))
    assert sorted(map(tuple, kept[5].collect()), key=lambda r: r[1]) == want
    assert nulls_last(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == nulls_last(want)


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_entry_point_without_the_folders(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("sheaf.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("sheaf.llm", "sheaf.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries() and not any(n.startswith("op1_") or n == "pipeline" for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
