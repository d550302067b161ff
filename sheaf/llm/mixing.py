"""Mixing sources to target weights by repeating documents.

Word counts are summed per source, targets follow from weights and a limit on
repetition, and ``target / size`` is the source's repetition rate. A document
is taken ``floor(rate)`` times and once more if its draw is below the rate's
fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.llm.store import stored

WORD = "[^\\x20\\x09-\\x0D]+"

#: Documents of one source and size class that share one run of draws.
RUN = 1024
SALTS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_sizes(keys: DataFrame) -> DataFrame:
    """``source, source_size, place``: place counts sources by code point, null last.

    Sources are not assumed few: they are ranged over tasks, numbered inside
    their range and shifted by the ranges before. The table is written once,
    since it is read several times.
    """
    words = F.sum(F.col("size") * F.col("rows")).alias("source_size")
    sums = keys.groupBy("source").agg(words)
    ranged = stored(
        sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id())
    )
    # one row per range: as many as there are tasks
    held = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())
    return (
        ranged.withColumn("_place", F.row_number().over(inside) - 1)
        .join(starts, "_range")
        .select("source", "source_size", (F.col("_start") + F.col("_place")).alias("place"))
    )


def with_targets(sources: DataFrame, weight: Column, share: float, repeats: float) -> DataFrame:
    """``sources`` with ``target``: weighted parts of ``share`` of all words, none above ``repeats`` times its size.

    What a full source can't take goes to the others by weight, until none is
    above its limit: all open sources have ``weight * level``. The level is found
    from below; each round sums the table once and brings back two numbers.
    """
    sources = stored(sources.withColumn("_weight", weight.cast("double")))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    limit = F.col("source_size") * F.lit(float(repeats))
    level, full_before = 0.0, -1
    while total:
        full = limit <= F.col("_weight") * F.lit(level)
        row = sources.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if row["n"] == full_before or not row["open"]:
            break
        level, full_before = (share * total - row["full"]) / row["open"], row["n"]
    return sources.withColumn("target", F.least(limit, F.col("_weight") * F.lit(level)).cast("double")).drop("_weight")


def _bits(*parts: Column) -> Column:
    """52 bits of the md5 of ``parts`` as a number; other engines compute the same."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def with_copies(keys: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """``keys`` (doc_id, source, size, rows) with ``source_size, target, copies``.

    The draw of a document is uniform and comes from hashes of the seed and its
    ``doc_id``, so the extra copy has the fraction's probability. Draws are
    spread: documents of one source and one class of size (a power of two) are
    dealt into runs of about ``RUN``, ordered by hash, and the k-th of n draws
    from [k/n, (k+1)/n). Independent draws would miss the target of a small source
    with a few long documents by a lot more.

    One source may hold most rows: runs have about ``RUN`` documents whatever
    the source, and the table of classes is joined on a salted key.
    """
    kept = keys.withColumn("_class", F.length(F.bin(F.col("size")))).withColumn("_hash", _bits(F.lit(seed), F.col("doc_id")))
    classes = kept.groupBy("source", "_class").agg(F.count("*").alias("_n"))
    classes = (
        classes.join(targets.withColumnRenamed("source", "_s"), classes["source"].eqNullSafe(F.col("_s")))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        .select("_s", F.col("_class").alias("_c"), "_n", "_salt", "source_size", "target")
    )
    joined = kept.join(
        classes,
        kept["source"].eqNullSafe(F.col("_s"))
        & (F.col("_class") == F.col("_c"))
        & (F.col("_hash") % SALTS == F.col("_salt")),
    ).withColumn("_run", F.col("_hash") % F.ceil(F.col("_n") / F.lit(RUN)))
    run = Window.partitionBy("source", "_class", "_run")
    place = F.row_number().over(run.orderBy("_hash", "doc_id", "size")) - 1
    inside = _bits(F.lit("place"), F.lit(seed), F.col("doc_id")) / F.lit(float(1 << 52))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        joined.withColumn("_draw", (place + inside) / F.count("*").over(run))
        .withColumn("_rate", rate)
        .withColumn(
            "copies",
            (F.floor("_rate") + F.when(F.col("_draw") < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)).cast("int"),
        )
        .select("doc_id", "source", "size", "rows", "source_size", "target", "copies")
    )


def document_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, rows``, written once. Rows alike in the first three count as repeats of one document."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return stored(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "keys")


def plan_mix(docs: DataFrame, weight: Column, share: float = 1.5, repeats: float = 2.0, seed: int = 7) -> DataFrame:
    """How often each document is taken: ``doc_id, source, size, rows, source_size, target, copies``.

    ``weight`` is an expression over ``source`` and ``place`` (the source's number
    by code point, null last); ``share`` is the size of the mix against all
    words, ``repeats`` the limit per source. A null text and a text without words
    have size 0; a null source is a source of its own; a source without words
    has target 0. An empty table gives an empty plan. Repeated rows are taken
    alike.
    """
    keys = document_keys(docs)
    targets = with_targets(source_sizes(keys), weight, share, repeats)
    return with_copies(keys, targets.select("source", "source_size", "target"), seed)


def mix(docs: DataFrame, weight: Column, share: float = 1.5, repeats: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``plan_mix`` says, all its columns kept."""
    plan = plan_mix(docs, weight, share, repeats, seed).where("copies > 0")
    plan = plan.select(
        F.col("doc_id").alias("_mix_id"),
        F.col("source").alias("_mix_source"),
        F.col("size").alias("_mix_size"),
        F.col("copies").alias("_mix_copies"),
    )
    taken = docs.withColumn("_mix_words", word_count(F.col("text"))).join(
        plan,
        F.col("doc_id").eqNullSafe(F.col("_mix_id"))
        & F.col("source").eqNullSafe(F.col("_mix_source"))
        & (F.col("_mix_words") == F.col("_mix_size")),
    )
    repeated = taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
    return repeated.select(*[F.col(f"`{name}`") for name in docs.columns])
