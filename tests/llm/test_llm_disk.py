"""What steps leave on the executors' disks, and how many unrelated documents they bring together."""

import time

import numpy as np
from pyspark.sql import functions as F

from sheaf.llm import jaccard, repeats
from sheaf.llm.store import CLEANUP, stored


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def left_since(spark, before):
    """Shuffle files since ``before``; Spark deletes them in the background."""
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    return left


def test_stored_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    table = stored(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    assert not left_since(spark, before)
    assert table.count() == 10 and spark.conf.get(CLEANUP, None) == setting


def test_repeats_move_texts_after_stretches_are_gone(spark, monkeypatch):
    left = []

    def watched(df, kind):
        before = shuffle_files(spark)
        out = stored(df, kind)
        left.append((kind, left_since(spark, before)))
        return out

    monkeypatch.setattr(repeats, "stored", watched)
    text = " ".join(f"word{k}" for k in range(60))
    df = spark.createDataFrame([(i, f"{text} and {i}") for i in range(20)], "doc_id long, text string").repartition(3)
    assert repeats.remove_repeats(df).where("n_removed > 0").count() == 19
    assert left == [("flags", set()), ("cuts", set())]


def test_one_gram_in_common_ties_no_sets():
    rng, rule, none = np.random.default_rng(4), jaccard.Rule(5, 80), np.empty(0, np.uint64)
    for _ in range(3000):
        gram = rng.integers(0, 1 << 62, 1).astype(np.uint64)
        sets = [np.unique(np.append(gram, rng.integers(0, 1 << 62, 299).astype(np.uint64))) for _ in range(2)]
        one, other = (jaccard.class_hashes(s, rule, none) for s in sets)
        assert not np.intersect1d(one, other).size


def test_sets_of_common_grams_are_not_tied_by_empty_classes():
    rng, rule = np.random.default_rng(5), jaccard.Rule(5, 80)
    sets = [np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64)) for _ in range(20)]
    common = np.unique(np.concatenate(sets))
    classes = np.concatenate([jaccard.class_hashes(s, rule, common) for s in sets])
    assert len(np.unique(classes)) == len(classes)
