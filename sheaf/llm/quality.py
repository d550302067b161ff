"""Quality rules: boosted trees over statistics of whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm import boosting
from sheaf.llm.words import NOT_BLANK, Texts, mixed, prefix_sums, run_hashes, runs_in, slices, stretch_hashes

#: Labelled documents the model is fitted on, at most.
LABELLED = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct", "n_stutter", "n_bare")

#: Features of the model and whether the score may only fall (-1) or rise (1) with them.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_lines": -1,
    "repeat_words": -1,
    "upper": 0,
    "digits": 0,
    "marks_per_word": 0,
    "distinct": 0,
    "stutter": -1,
    "bare": -1,
    "line_words": 0,
}


def _class(members: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in members]] = True
    return out


SYMBOLS = _class("#*$%&|<>")
UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTERS = UPPER | _class("abcdefghijklmnopqrstuvwxyz")
DIGITS = _class("0123456789")
MARKS = _class("!\"'(),-./:;=?@[\\]^_`{}~+")
#: First bytes of characters: all but UTF-8 continuation bytes.
FIRST = (np.arange(256) & 0xC0) != 0x80


def statistics(texts: Texts) -> dict[str, np.ndarray]:
    """Counts of every text; see ``score_documents`` for what they mean."""
    data, at, n = texts.data, texts.at, len(texts)
    starts, ends, owner = texts.words(NOT_BLANK)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[at[1:]] - sums[at[:-1]]

    def per_word_text(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner[flags], minlength=n)

    sums = prefix_sums(data)
    hashes = stretch_hashes(sums, starts, ends)
    own = mixed(hashes + mixed(owner.astype(np.uint64)))
    distinct = np.unique(own, return_index=True)[1]

    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.sort(np.concatenate([at[:-1], breaks + 1]))
    line_owner = np.sort(np.concatenate([np.arange(n), np.searchsorted(at, breaks, "right") - 1]))
    line_ends = np.append(line_starts[1:] - 1, len(data))
    last = np.append(line_owner[1:] != line_owner[:-1], True)[: len(line_owner)]
    line_ends[last] = at[line_owner[last] + 1]
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_owner = line_owner[worded]
    lines = stretch_hashes(sums, line_starts[worded], line_ends[worded])
    different = np.unique(mixed(lines + mixed(line_owner.astype(np.uint64))), return_index=True)[1]
    n_lines = np.bincount(line_owner, minlength=n)

    windows = runs_in(owner, 3)
    _, inverse, counts = np.unique(run_hashes(own, windows, 3), return_inverse=True, return_counts=True)
    again = windows[counts[inverse] > 1]
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + 3, -1)
    letter = np.concatenate([[0], np.cumsum(LETTERS[data] | (data >= 0x80) | DIGITS[data])])
    stutter = np.zeros(len(starts), bool)
    stutter[1:] = own[1:] == own[:-1]
    return {
        "n_words": np.bincount(owner, minlength=n),
        "word_chars": per_text(FIRST[data] & NOT_BLANK[data]),
        "n_symbols": per_text(SYMBOLS[data]),
        "n_dup_lines": n_lines - np.bincount(line_owner[different], minlength=n),
        "n_repeat_words": per_word_text(np.cumsum(edge)[:-1] > 0),
        "n_lines": n_lines,
        "n_upper": per_text(UPPER[data]),
        "n_letters": per_text(LETTERS[data]),
        "n_digits": per_text(DIGITS[data]),
        "n_marks": per_text(MARKS[data]),
        "n_distinct": np.bincount(owner[distinct], minlength=n),
        "n_stutter": per_word_text(stutter),
        "n_bare": per_word_text(letter[ends] == letter[starts]),
    }


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One row per text, columns as in ``FEATURES``."""
    words, lines = np.maximum(counts["n_words"], 1), np.maximum(counts["n_lines"], 1)
    columns = [
        np.log1p(counts["n_words"]),
        counts["word_chars"] / words,
        counts["n_symbols"] / words,
        counts["n_dup_lines"] / lines,
        counts["n_repeat_words"] / words,
        counts["n_upper"] / np.maximum(counts["n_letters"], 1),
        counts["n_digits"] / np.maximum(counts["word_chars"], 1),
        counts["n_marks"] / words,
        counts["n_distinct"] / words,
        counts["n_stutter"] / words,
        counts["n_bare"] / words,
        counts["n_words"] / lines,
    ]
    return np.stack(columns, axis=1).astype(float)


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> boosting.Trees:
    """Trees for the probability that ``quality`` is 1, fitted on at most ``most`` labelled documents.

    They are those with the smallest hash of doc_id, so reruns agree and their
    number, not the corpus, bounds what the driver holds. Labels without a doc_id
    or quality don't count; of several labels for a document the lowest does, of
    several texts one. Without labels, or with one class of them, every document
    passes.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").alias("_labelled"))
        .agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("_labelled"), "_labelled")
        .limit(most)
    )
    # at most ``most`` rows of two numbers
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled"))
    names = list(FEATURES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(statistics(part)) for part in slices(batch.column("text"))]
            x = np.concatenate(rows) if rows else np.empty((0, len(names)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), *[pa.array(x[:, k]) for k in range(len(names))]],
                names=["doc_id", "quality", *names],
            )

    schema = "doc_id long, quality int, " + ", ".join(f"{c} double" for c in names)
    narrow = texts.select(F.col("doc_id").cast("long"), "text", F.col("_quality").cast("int").alias("quality"))
    measured = narrow.mapInArrow(measure, schema).groupBy("doc_id").agg(F.min(F.struct("quality", *names)).alias("row"))
    rows = np.array([tuple(r["row"]) for r in measured.orderBy("doc_id").collect()], float).reshape(-1, len(names) + 1)
    return boosting.fit(rows[:, 1:], rows[:, 0], list(FEATURES.values()))


def score_documents(docs: DataFrame, trees: boosting.Trees, prefix: str = "", threshold: float = 0.5) -> DataFrame:
    """``docs`` with counts and verdict; names of added columns are led by ``prefix``.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D. n_words; word_chars:
    code points in words; n_symbols: characters of ``#*$%&|<>``; n_dup_lines: lines
    (split at line feeds) with a word that equal an earlier line; n_repeat_words:
    words in windows of 3 words found twice or more in the text. base_failed:
    fewer than 50 words, or more than half of them repeated. score: the model's
    probability. kept: false where base_failed, else score >= threshold.

    A null text counts as empty: no words, base_failed. Repeated rows are judged
    each. Other columns come through; equal names are an error: pass a prefix.
    """
    added = [T.StructField(prefix + c, T.LongType()) for c in COUNTS]
    added += [
        T.StructField(prefix + "base_failed", T.BooleanType()),
        T.StructField(prefix + "score", T.DoubleType()),
        T.StructField(prefix + "kept", T.BooleanType()),
    ]
    clash = {f.name for f in added} & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist already, choose a prefix: {sorted(clash)}")
    where = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(where)):
                counts = statistics(part)
                score = 1 / (1 + np.exp(-trees.margin(features(counts))))
                words, repeated = counts["n_words"], counts["n_repeat_words"]
                failed = (words < 50) | (100 * repeated > 50 * words)
                columns = [pa.array(counts[c], pa.int64()) for c in COUNTS]
                columns += [pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(part.first, len(part)).columns, *columns],
                    names=[*batch.schema.names, *[f.name for f in added]],
                )

    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, *added]))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` that the rules keep; the columns stay as they are."""
    mark = "_quality_"
    judged = score_documents(docs, fit_quality(docs, labels), mark)
    return judged.where(F.col(mark + "kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
