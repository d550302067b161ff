"""Compression classifier: sizes again by hand, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from sheaf.llm import compression
from sheaf.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def judged(spark):
    got = QUERIES["op13_compression_quality"](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    return got.join(labels, "doc_id", "left").collect()


def test_query_on_documents_it_has_not_learned_from(spark, judged):
    assert len(judged) >= spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in judged:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 < r.score < 1 and r.predicted == (r.score >= 0.7)
    held = [r for r in judged if r.held_out and r.quality is not None]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert np.mean([r.predicted for r in held if r.quality]) > 0.97
    # calibrated: in each band of scores the share of good ones is near the mean score
    for low, high in ((0, 0.5), (0.5, 0.95), (0.95, 1)):
        band = [r for r in held if low <= r.score < high]
        if len(band) >= 30:
            assert abs(np.mean([r.score for r in band]) - np.mean([r.quality for r in band])) < 0.15


def test_scores_by_hand_and_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = compression.fit_classifier(docs, labels)
    assert model == compression.fit_classifier(docs, labels.unionAll(labels))
    rows = [(None, None), (1, ""), (2, "a"), (2, "a"), (3, "good words " * 200_000), (4, "é\x00" * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionAll(docs.limit(50))
    df = df.selectExpr("*", "'own' AS score", "1 AS lang")
    with pytest.raises(ValueError):
        compression.score_texts(df, model)
    got = compression.score_texts(df, model, prefix="z_").collect()
    assert len(got) == 56
    own = {}
    for name in ("good", "bad"):
        held = zstandard.ZstdCompressionDict(getattr(model, name))
        held.precompute_compress(level=1)
        own[name] = zstandard.ZstdCompressor(1, held, write_content_size=False, write_checksum=False, write_dict_id=False)
    for r in got:
        text = (r.text or "").encode()
        size = {k: sum(len(c.compress(text[i : i + 512])) for i in range(0, len(text), 512)) for k, c in own.items()}
        want = np.interp((size["bad"] - size["good"]) / max(len(text), 1), model.x, model.score)
        assert r.z_score == pytest.approx(want) and r.z_predicted == (r.z_score >= 0.7) and r.score == "own"
    assert compression.score_texts(df.where("1 = 0"), model, prefix="z_").count() == 0


def test_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(40)] + [(None, None)], "doc_id long, text string")
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    got = compression.score_texts(docs, compression.fit_classifier(docs, none)).collect()
    assert {r.score for r in got} == {0.5}
    ones = docs.select("doc_id", F.lit(1).alias("quality"))
    got = compression.score_texts(docs, compression.fit_classifier(docs, ones)).collect()
    assert all(r.score > 0.9 and r.predicted for r in got)


def test_isotonic():
    x, score = compression.isotonic(np.array([1, 2, 2, 3, 4, 5.0]), np.array([0, 1, 0, 0, 1, 1.0]))
    assert list(score) == sorted(score) and 0 < score[0] and score[-1] < 1 and list(x) == sorted(x)
    assert compression.isotonic(np.array([]), np.array([])) == ((0.0,), (0.5,))
