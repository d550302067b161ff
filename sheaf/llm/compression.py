"""Quality by compression: which of two zstandard dictionaries makes a text smaller.

One dictionary is built from good, one from bad labelled text. A text is cut into
blocks that are compressed apart, so the dictionaries matter in all of it. The
difference of the two sizes over the text's length becomes a probability by
isotonic regression on labelled documents that neither dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes compressed at once.
BLOCK = 512
#: Bytes of a dictionary, and the level of compression.
DICTIONARY, LEVEL = 1 << 16, 1
#: Labelled documents of each class for its dictionary, and blocks of each, spread over its text.
DOCUMENTS, BLOCKS = 2_000, 8
#: Labelled documents for the calibration.
CALIBRATED = 10_000


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def build_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; where they are too few to train one, their own bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


class Sizes:
    """Compressed sizes under one dictionary."""

    def __init__(self, dictionary: bytes):
        import zstandard

        held = zstandard.ZstdCompressionDict(dictionary)
        held.precompute_compress(level=LEVEL)
        self._compressor = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def of(self, parts: list[bytes]) -> int:
        compress = self._compressor.compress
        return sum(len(compress(part)) for part in parts)


@dataclass(frozen=True)
class Classifier:
    """Dictionaries of good and bad text, and the points between which the score runs straight."""

    good: bytes
    bad: bytes
    x: tuple[float, ...]
    score: tuple[float, ...]

    def differences(self, texts: Iterator[bytes]) -> np.ndarray:
        """Bytes the good dictionary saves over the bad one, per byte of text; 0 for an empty text."""
        if not self.good or not self.bad:
            return np.zeros(sum(1 for _ in texts))
        good, bad = Sizes(self.good), Sizes(self.bad)
        out = []
        for text in texts:
            parts = blocks(text)
            out.append((bad.of(parts) - good.of(parts)) / max(len(text), 1))
        return np.array(out, float)

    def scores(self, differences: np.ndarray) -> np.ndarray:
        return np.interp(differences, self.x, self.score)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Rising probabilities of y = 1 by pooling neighbours that fall; never quite 0 or 1.

    Without rows the probability is 1/2 everywhere.
    """
    order = np.argsort(x, kind="stable")
    at, first = np.unique(x[order], return_index=True)
    pools: list[list[float]] = []  # ones, rows, sum of x
    for value, ones, rows in zip(at, np.add.reduceat(y[order], first) if len(at) else (), np.diff(np.append(first, len(x))), strict=True):
        pools.append([float(ones), float(rows), float(value * rows)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    if not pools:
        return (0.0,), (0.5,)
    return tuple(p[2] / p[1] for p in pools), tuple(np.maximum.accumulate([(p[0] + 0.5) / (p[1] + 1) for p in pools]))


def _texts(column: pa.Array) -> Iterator[bytes]:
    for text in column.cast(pa.large_binary()):
        yield text.as_py() or b""


def fit_classifier(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Classifier:
    """A classifier of ``label`` (0 or 1), fitted on a bounded sample of labelled documents.

    The labelled documents are parted by a hash of doc_id. Of one part, the
    ``DOCUMENTS`` with the smallest hashes of each class give ``BLOCKS`` blocks each,
    spread over the text, to their dictionary; of the other, ``CALIBRATED`` give the
    calibration. So the driver holds at most 16 MB of text and reruns agree. Labels
    without a doc_id or a value don't count; of several labels for a document the
    lowest does, of several texts one. With labels of one class only, the score
    is that class's share for every text.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("_labelled"))
        .agg(F.min(label).cast("int").alias("_label"))
        .withColumn("_turn", F.xxhash64("_labelled"))
    )
    chosen = lambda part, most: part.orderBy("_turn", "_labelled").limit(most).select("_labelled", "_label")
    to_build, to_calibrate = (known.where(F.pmod("_turn", F.lit(2)) == k) for k in (0, 1))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def labelled(sample: DataFrame) -> DataFrame:
        # at most a few thousand rows of two numbers
        return texts.join(F.broadcast(sample), F.col("doc_id") == F.col("_labelled")).select("doc_id", "_label", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for text in _texts(batch.column("text")):
                own = blocks(text)
                parts.append([own[k] for k in np.unique(np.linspace(0, len(own) - 1, BLOCKS).astype(int))] if own else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_label"), pa.array(parts, pa.list_(pa.binary()))],
                names=["doc_id", "label", "parts"],
            )

    both = chosen(to_build.where("_label = 0"), DOCUMENTS).unionAll(chosen(to_build.where("_label = 1"), DOCUMENTS))
    built = labelled(both).mapInArrow(cut, "doc_id long, label int, parts array<binary>")
    rows = built.groupBy("doc_id", "label").agg(F.min("parts").alias("parts")).orderBy("doc_id").collect()
    samples = [[bytes(part) for r in rows if r.label == k for part in r.parts] for k in (0, 1)]
    bad, good = (build_dictionary(s) if s else b"" for s in samples)
    plain = Classifier(good, bad, (0.0,), (0.5,))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = plain.differences(_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_label"), pa.array(x)], names=["doc_id", "label", "x"]
            )

    measured = labelled(chosen(to_calibrate, CALIBRATED)).mapInArrow(measure, "doc_id long, label int, x double")
    points = measured.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("p")).orderBy("doc_id").collect()
    x, y = (np.array([r.p[k] for r in points], float) for k in (0, 1))
    return Classifier(good, bad, *isotonic(x, y))


def score_texts(docs: DataFrame, classifier: Classifier, threshold: float = 0.7, prefix: str = "") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1 by the whole text, and ``predicted``: 1 from ``threshold`` on.

    Names of the added columns are led by ``prefix``. A null or empty text has a
    difference of 0 and the score that belongs to it. Repeated rows are scored each,
    alike. Other columns come through, none but ``text`` is read; equal names are an
    error: pass a prefix.
    """
    added = [T.StructField(prefix + "score", T.DoubleType()), T.StructField(prefix + "predicted", T.IntegerType())]
    clash = {f.name for f in added} & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist already, choose a prefix: {sorted(clash)}")
    where = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = classifier.scores(classifier.differences(_texts(batch.column(where))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=[*batch.schema.names, *[f.name for f in added]],
            )

    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, *added]))
