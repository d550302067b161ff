"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import (
    compression,
    decontamination,
    divergence,
    jaccard,
    licenses,
    mixing,
    periods,
    quality,
    repeats,
    secrets,
    sharding,
    tokens,
    warc,
)
from sheaf.llm.store import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Weights of the sources in order, repeating.
CYCLE = (5.0, 2.0, 1.0)


def cycle_weight():
    return F.element_at(F.array(*[F.lit(w) for w in CYCLE]), (F.col("place") % len(CYCLE) + 1).cast("int"))


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents
), keys AS (
  SELECT doc_id, source, size, count(*) AS n_rows FROM sized GROUP BY ALL
), sources AS (
  SELECT source, sum(size * n_rows)::BIGINT AS source_size,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place
  FROM keys GROUP BY source
), weighted AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
         CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sources
), ordered AS (
  -- sources in the order in which they fill up
  SELECT *, sum(most) OVER o - most AS full_before, sum(weight) OVER () - (sum(weight) OVER o - weight) AS open_weight,
         1.5::DOUBLE * sum(source_size) OVER () AS wanted
  FROM weighted WINDOW o AS (ORDER BY most / weight, encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING)
), level AS (
  SELECT max((wanted - full_before) / open_weight) AS level
  FROM ordered WHERE (wanted - full_before) / open_weight <= most / weight
), targets AS (
  SELECT source, source_size, least(most, weight * level)::DOUBLE AS target FROM weighted, level
), classed AS (
  SELECT *, length(bin(size)) AS class,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS h,
         ('0x' || substr(md5('place:7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS h2
  FROM keys
), run AS (
  SELECT *, h % ceil(count(*) OVER (PARTITION BY source, class) / 1024.0)::BIGINT AS run FROM classed
), drawn AS (
  SELECT *, (row_number() OVER (PARTITION BY source, class, run ORDER BY h, doc_id NULLS FIRST, size) - 1
             + h2 / 4503599627370496.0::DOUBLE) / count(*) OVER (PARTITION BY source, class, run) AS draw
  FROM run
), rated AS (
  SELECT d.doc_id, d.size, d.n_rows, d.draw, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM drawn d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM (SELECT *, unnest(range(n_rows)) FROM rated)
"""


@query(MIX_SQL)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"), cycle_weight(), share=1.5, repeats=2.0)
    each = plan.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query()
def op9_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = sharding.grid(2, 2, 2)
    return sharding.place_documents(table(spark, sf_dir, "documents"), leaves, sharding.with_branch(leaves))


@query()
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), n=10)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated")
    )


@query()
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    read = warc.read_warc(spark, path, with_payload=False)
    number = lambda c: F.when(F.col(c) != "null", F.col(c).cast("long"))
    return read.select(
        number("page_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )


#: The tokenizer file and the id that ends a document. Its ids fit two bytes.
TOKENIZER, END_ID, ID_BYTES = "word_bpe_49k.json", 1, 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ids_by_key(docs: DataFrame) -> DataFrame:
    """Write ``docs`` as token ids and look every document up again."""
    spark = docs.sparkSession
    path = new_path(spark, "ids")
    tokens.write_corpus(docs, path, tokenizer_path(), END_ID, ID_BYTES)
    read = tokens.read_documents(tokens.look_up(spark, path, tokens.keys_of(docs)), with_ids=False)
    return read.select(
        F.col("key").cast("long").alias("doc_id"),
        "start",
        F.col("n").alias("n_tokens"),
        F.col("crc32").alias("ids_crc32"),
    )


@query()
def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_by_key(table(spark, sf_dir, "documents"))


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, trees).drop("text")


@query()
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"), jaccard.Rule(4, 85)).drop("set")


@query()
def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), span=50).drop("spans")


@query()
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query(licenses.oracle_sql())
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), wrapped=True)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` of which every tenth, by the hash of doc_id, repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    held = docs.withColumn("_h", h).withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    n = F.size("_words")
    some = (F.col("_h") % 10 == 0) & (n > 0)
    g = F.floor(F.col("_h") / 10)
    a = F.col("_a")
    held = held.withColumn("_a", F.when(some, g % n)).withColumn(
        "_p", F.when(some, 1 + F.floor((n - a) / (3 + g % 8)).cast("long"))
    )
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % F.col("_p")).cast("int")
    repeated = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_words", place(i)))
    text = F.when(some, F.array_join(repeated, " ")).otherwise(F.col("text"))
    return held.withColumn("text", text).drop("_h", "_words", "_a", "_p")


@query()
def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periods.collapse_runs(docs).drop("text")
    # the greatest length / period, compared as whole numbers; of equal ones the first
    higher = lambda best, r: r.length * best.period > best.length * r.period
    best = F.when(
        F.size("runs") > 0, F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(higher(b, r), r).otherwise(b))
    )
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    digest = lambda c: F.sha2(c, 256)
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        digest(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


AUDIT_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents
), words AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d
), counted AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM words GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n) AS total FROM counted GROUP BY ALL HAVING sum(docs) >= 30
), groups AS (
  SELECT DISTINCT lang, source FROM d
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
), sized AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n
  FROM groups g LEFT JOIN (SELECT lang, source, term, n FROM counted JOIN kept USING (lang, term)) c USING (lang, source)
  GROUP BY ALL
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.n + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.total + 5)) // (l.n + 5 * l.v) AS q
  FROM sized s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, 0::HUGEINT AS f FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL
  SELECT a.lang, a.source, b.source, abs(a.p - b.p) FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
), found AS (
  SELECT lang, source, 'pair' AS part, item, sum(f)::BIGINT AS value FROM pairs GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query(AUDIT_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


@query()
def op13_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = table(spark, sf_dir, "labels").where(~held_out)
    scored = compression.score_texts(docs, compression.fit_classifier(docs, known))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
