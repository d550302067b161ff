"""Every registered query with its SQL. Both read the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import code_corpus as C
from sheaf.functions import encode, paths, sizes
from sheaf.operators import assign, bundles, dedup, links, manifest, numbering, patterns, select, shards, whitespace
from sheaf.operators.clean import clean
from sheaf.operators.comments import remove_comments, strip_comments
from sheaf.options import CleanOptions, PackOptions
from sheaf.plans.pack import pack
from sheaf.sources.files import read_files, scan_files
from sheaf.sources.tables import spread, to_corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# --- corpora of the driver tables -------------------------------------------------------

DOCS = "(SELECT *, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path FROM documents)"
PAGES = (
    "(SELECT page_id, html, rtrim(regexp_replace(url, '^[a-z]+://([^?#]*).*$', '\\1'), '/') || '.html' AS path FROM pages)"
)
TURNS = (
    "(SELECT *, 'conv/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || '-' || role || '.txt' AS path"
    " FROM conversations)"
)


def documents(spark: SparkSession, sf_dir: str, keep=("doc_id", "lang", "source"), heavy: bool = False) -> DataFrame:
    """``heavy`` is for queries that work on the whole text of every row."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if heavy:
        table = spread(table.select("doc_id", "text", "lang", "source"), "doc_id")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return to_corpus(table, path, F.col("text"), keep=keep)


def pages(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    if heavy:
        table = spread(table, "page_id")
    bare = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), "/+$", "")
    return to_corpus(table, F.concat(bare, F.lit(".html")), F.col("html"), keep=["page_id"])


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    path = F.format_string("conv/%d/%d-%s.txt", "conv_id", "turn", "role")
    return to_corpus(table, path, F.col("text"), keep=["conv_id", "turn"])


NAME = "regexp_extract(path, '[^/]*$')"
EXT = f"CASE WHEN {NAME} LIKE '%.%' THEN regexp_extract({NAME}, '[^.]*$') ELSE '' END"


# --- sources ----------------------------------------------------------------------------

_META = f"{NAME} AS name, {EXT} AS extension"


@query(
    "corpus_from_tables",
    f"SELECT path, {_META}, CAST(NULL AS VARCHAR) AS language, CAST(strlen(text) AS BIGINT) AS raw_size, text AS content"
    f" FROM {DOCS} UNION ALL "
    f"SELECT path, {_META}, 'html' AS language, CAST(strlen(html) AS BIGINT) AS raw_size, html AS content FROM {PAGES}"
    f" UNION ALL SELECT path, {_META}, CAST(NULL AS VARCHAR) AS language, CAST(strlen(text) AS BIGINT) AS raw_size,"
    f" text AS content FROM {TURNS}",
)
def corpus_from_tables(spark, sf_dir):
    cols = ["path", "name", "extension", "language", "raw_size", "content"]
    return (
        documents(spark, sf_dir)
        .select(*cols)
        .unionAll(pages(spark, sf_dir).select(*cols))
        .unionAll(turns(spark, sf_dir).select(*cols))
    )


# SQL has no name for the folder the views were made of; this is the one whose results are compared
FILES = (
    "(SELECT regexp_extract(filename, '[^/]*$') AS name, regexp_extract(filename, '[.]([^./]*)$', 1) AS extension,"
    " CAST(NULL AS VARCHAR) AS language, CAST(size AS BIGINT) AS raw_size, CAST(NULL AS VARCHAR) AS error,"
    " sha256(content) AS content_sha256 FROM read_blob('/root/testdata/sf0.01/*.parquet'))"
)


@query("scan_files", f"SELECT name, extension, language, raw_size, error FROM {FILES}")
def scan(spark, sf_dir):
    return scan_files(spark, [sf_dir]).select("name", "extension", "language", "raw_size", "error")


@query("read_files", f"SELECT name, raw_size, error, content_sha256 FROM {FILES}")
def read(spark, sf_dir):
    content = F.sha2(F.col("content").cast("binary"), 256)
    return read_files(spark, [sf_dir]).select("name", "raw_size", "error", content.alias("content_sha256"))


# --- filters ----------------------------------------------------------------------------


@query(
    "glob_filter_documents",
    f"SELECT doc_id, path FROM {DOCS} WHERE NOT (source = 'src3' OR source || '/' || lang LIKE '%/fr')"
    " AND (regexp_matches(path, '/[0-9]*[02468]\\.txt$') OR regexp_matches(path, '^src1[0-9]?/en/'))",
)
def glob_filter_documents(spark, sf_dir):
    return select.select_paths(
        documents(spark, sf_dir), "*[02468].txt,src{1,1?}/en/**,!**/fr/*", "src3/**"
    ).select("doc_id", "path")


# one pattern a part, of four kinds; the SQL compares numbers where the globs compare names
_PATTERN = (
    "CASE p_partkey % 4 WHEN 0 THEN concat(p_partkey, '.txt') WHEN 1 THEN concat('src1/*/', p_partkey, '?.txt')"
    " WHEN 2 THEN concat('*', p_partkey, '.txt') ELSE concat('*/{en,fr}/', p_partkey, '[0-4]*.txt') END"
)


@query(
    "glob_filter_table",
    """
WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS kind FROM part),
d AS (SELECT doc_id, source, lang, CAST(doc_id AS VARCHAR) AS name FROM documents),
tens AS (SELECT range AS n, CAST(pow(10, range) AS BIGINT) AS ten FROM range(1, 12)),
wanted AS (
  SELECT d.doc_id FROM d JOIN p ON kind = 0 AND k = doc_id
  UNION SELECT d.doc_id FROM d JOIN p ON kind = 1 AND source = 'src1' AND doc_id >= 10 AND k = doc_id // 10
  UNION SELECT d.doc_id FROM d, tens, p WHERE kind = 3 AND lang IN ('en', 'fr') AND length(name) > n
    AND k = CAST(left(name, n) AS BIGINT) AND substr(name, CAST(n AS INT) + 1, 1) IN ('0', '1', '2', '3', '4')
), refused AS (
  SELECT d.doc_id FROM d, tens, p WHERE kind = 2 AND length(name) >= n AND k = CAST(right(name, n) AS BIGINT)
    AND length(CAST(k AS VARCHAR)) = n
)
SELECT doc_id FROM wanted WHERE doc_id NOT IN (SELECT doc_id FROM refused)
""",
)
def glob_filter_table(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    globs = part.select(F.expr(_PATTERN).alias("pattern"), F.expr("p_partkey % 4 = 2").alias("exclude"))
    return patterns.select_by_table(documents(spark, sf_dir), globs).select("doc_id")


@query(
    "glob_filter_pages",
    f"SELECT page_id, path FROM {PAGES} WHERE regexp_matches(path, '^(.*/)?(en|de)/[^/]*\\.html$')"
    " AND path NOT LIKE 'blog.%' AND NOT regexp_matches(path, '/9[0-9][^/]\\.html$')",
)
def glob_filter_pages(spark, sf_dir):
    return select.select_paths(pages(spark, sf_dir), "**/{en,de}/*.html", "blog.*/**,9[0-9]?.html").select(
        "page_id", "path"
    )


@query("size_filter", f"SELECT doc_id, CAST(strlen(text) AS BIGINT) AS raw_size FROM {DOCS} WHERE strlen(text) <= 2048")
def size_filter(spark, sf_dir):
    return select.within_size(documents(spark, sf_dir), sizes.parse_size("2KB")).select("doc_id", "raw_size")


@query(
    "drop_empty",
    "SELECT p_partkey, 'int a; ' AS content FROM part WHERE p_partkey % 5 <> 0",
)
def drop_empty(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("// "), F.col("p_name"))).otherwise(
        F.concat(F.lit("int a; /* "), F.col("p_name"), F.lit(" */"))
    )
    rows = part.select("p_partkey", text.alias("content"), F.lit("java").alias("language"))
    return select.drop_empty(remove_comments(rows)).select("p_partkey", "content")


# --- de-duplication ---------------------------------------------------------------------


@query(
    "distinct_paths",
    f"SELECT DISTINCT path, CAST(strlen(text) AS BIGINT) AS raw_size FROM {DOCS}",
)
def distinct_paths(spark, sf_dir):
    docs = documents(spark, sf_dir)
    # every document, those of one language twice
    overlap = docs.unionAll(docs.where("lang = 'en'"))
    return dedup.distinct_paths(overlap).select("path", "raw_size")


@query(
    "dedup_identity",
    "SELECT path, is_link FROM (SELECT path, is_link, row_number() OVER (PARTITION BY identity ORDER BY is_link, path) AS n"
    f" FROM (SELECT path, doc_id % 3 <> 0 AS is_link, source || '/' || CAST(doc_id // 7 AS VARCHAR) AS identity FROM {DOCS}))"
    " WHERE n = 1",
)
def dedup_identity(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("is_link", F.col("doc_id") % 3 != 0)
    identity = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 7).cast("string"))
    return dedup.distinct_identity(docs, identity, F.col("is_link")).select("path", "is_link")


@query(
    "dedup_content",
    f"SELECT path, content FROM (SELECT path, text AS content, row_number() OVER (PARTITION BY text ORDER BY path) AS n"
    f" FROM {DOCS}) WHERE n = 1",
)
def dedup_content(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return dedup.distinct_identity(docs, dedup.content_identity()).select("path", "content")


# --- projections ------------------------------------------------------------------------


@query("file_parts", f"SELECT page_id, {_META}, CAST(strlen(html) AS BIGINT) AS size FROM {PAGES}")
def file_parts(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", "name", "extension", "size")


@query("detect_language", f"SELECT file_id, path, language FROM ({C.code_sql()})")
def detect_language(spark, sf_dir):
    return C.code_corpus(spark, sf_dir).select("file_id", "path", "language")


@query(
    "relative_path",
    f"SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '/data2/' || path ELSE path END AS relative FROM {DOCS}",
)
def relative_path(spark, sf_dir):
    docs = documents(spark, sf_dir)
    kind = F.col("doc_id") % 4
    given = (
        F.when(kind == 0, F.concat(F.lit("/data/"), F.col("path")))
        .when(kind == 1, F.concat(F.lit("/data/./x/../"), F.col("path")))
        .when(kind == 2, F.concat(F.lit("//data/"), F.col("path")))
        .otherwise(F.concat(F.lit("/data2/"), F.col("path")))
    )
    return docs.select("doc_id", paths.relative_path(given, "/data/").alias("relative"))


@query(
    "display_path",
    "SELECT doc_id, CASE doc_id % 6 WHEN 4 THEN 'corpus/other/' || path WHEN 5 THEN 'corpus/work/corpus2/' || path"
    f" ELSE 'corpus/' || path END AS shown FROM {DOCS}",
)
def display_path(spark, sf_dir):
    docs = documents(spark, sf_dir)
    path = F.col("path")
    given = (
        F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("/work/corpus/"), path))
        .when(F.col("doc_id") % 6 == 1, F.concat(F.lit("C:\\work\\corpus\\"), F.replace(path, F.lit("/"), F.lit("\\"))))
        .when(F.col("doc_id") % 6 == 2, F.concat(F.lit("/work/x/../corpus/./"), path))
        .when(F.col("doc_id") % 6 == 3, path)
        .when(F.col("doc_id") % 6 == 4, F.concat(F.lit("/other/"), path))
        .otherwise(F.concat(F.lit("/work/corpus2/"), path))
    )
    return docs.select("doc_id", paths.display_path(given, "/work/corpus").alias("shown"))


_SIZE_TEXT = (
    "CAST(p_size AS VARCHAR) || CASE p_partkey % 8 WHEN 0 THEN 'B' WHEN 1 THEN ' kb' WHEN 2 THEN 'MB' WHEN 3 THEN 'Gb'"
    " WHEN 4 THEN ' T B' WHEN 5 THEN '' WHEN 6 THEN 'XB' ELSE '.5MB' END"
)


@query(
    "parse_size",
    f"SELECT p_partkey, {_SIZE_TEXT} AS text, CASE WHEN p_size <= 0 THEN NULL WHEN p_partkey % 8 <= 4"
    " THEN CAST(p_size * CAST(power(1024, p_partkey % 8) AS BIGINT) AS BIGINT) END AS bytes FROM part",
)
def parse_size(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.expr(_SIZE_TEXT.replace("VARCHAR", "STRING"))
    return part.select("p_partkey", text.alias("text"), sizes.parse_size_column(text).alias("bytes"))


_BYTES = "CAST(p_size * CAST(power(1024, p_partkey % 6) AS BIGINT) + p_partkey * (p_partkey % 977) AS BIGINT)"


@query(
    "format_size",
    "SELECT p_partkey, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' ELSE printf('%.1f', b / power(1024, e)) || ' '"
    " || substr('KMGTPE', e, 1) || 'B' END AS shown FROM (SELECT p_partkey, b, CASE WHEN b >= power(1024, 6) THEN 6"
    " WHEN b >= power(1024, 5) THEN 5 WHEN b >= power(1024, 4) THEN 4 WHEN b >= power(1024, 3) THEN 3"
    f" WHEN b >= power(1024, 2) THEN 2 ELSE 1 END AS e FROM (SELECT p_partkey, {_BYTES} AS b FROM part))",
)
def format_size(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", sizes.format_size(F.expr(_BYTES)).alias("shown"))


def _xml_sql(text: str) -> str:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("''", "&apos;"), ('"', "&quot;")):
        text = f"replace({text}, '{old}', '{new}')"
    return text


@query("escape_xml", f"SELECT page_id, {_xml_sql('html')} AS escaped FROM pages")
def escape_xml(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", encode.escape_xml(F.col("content")).alias("escaped"))


@query(
    "common_segments",
    "SELECT doc_id, CAST(CASE WHEN source <> 'src1' THEN 0 WHEN lang <> 'en' THEN 1 WHEN doc_id = 1 THEN 3 ELSE 2 END"
    " AS INTEGER) AS shared FROM documents",
)
def common_segments(spark, sf_dir):
    other = F.array(F.lit("src1"), F.lit("en"), F.lit("1.txt"), F.lit("x"))
    return documents(spark, sf_dir).select(
        "doc_id", paths.common_segments(paths.segments(F.col("path")), other).alias("shared")
    )


# --- cleaning ---------------------------------------------------------------------------

BLANK = "' ' || chr(9) || chr(13) || chr(160)"
# the documents hold no blank lines, so sentence ends become blank runs of several kinds
LOOSE = "replace(replace(text, '. ', '. ' || chr(9) || chr(10) || '  ' || chr(10) || chr(10) || ' '), ', ', ', ' || chr(10) || chr(160) || chr(10))"


def loose_text(spark, sf_dir) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    text = F.replace(F.col("text"), F.lit(". "), F.lit(". \t\n  \n\n "))
    text = F.replace(text, F.lit(", "), F.lit(", \n\u00a0\n"))
    return docs.select("doc_id", text.alias("content"))


def lines_sql(text: str) -> str:
    return f"list_transform(string_split({text}, chr(10)), lambda x: rtrim(x, ' ' || chr(9)))"


def drop_blank_sql(text: str) -> str:
    return (
        f"array_to_string(list_filter({lines_sql(text)}, lambda x: trim(x, {BLANK}) <> ''), chr(10)) || chr(10)"
    )


@query("trim_lines", f"SELECT doc_id, array_to_string({lines_sql(LOOSE)}, chr(10)) AS content FROM documents")
def trim_lines(spark, sf_dir):
    return loose_text(spark, sf_dir).select("doc_id", whitespace.trim_lines(F.col("content")).alias("content"))


@query("strip_empty_lines", f"SELECT doc_id, {drop_blank_sql(LOOSE)} AS content FROM documents")
def strip_empty_lines(spark, sf_dir):
    return loose_text(spark, sf_dir).select("doc_id", whitespace.drop_blank_lines(F.col("content")).alias("content"))


@query(
    "collapse_blank_runs",
    f"SELECT doc_id, array_to_string(list_filter(l, lambda x, i: trim(x, {BLANK}) <> '' OR i = 1"
    f" OR trim(l[i - 1], {BLANK}) <> ''), chr(10)) || chr(10) AS content"
    f" FROM (SELECT doc_id, {lines_sql(LOOSE)} AS l FROM documents)",
)
def collapse_blank_runs(spark, sf_dir):
    return loose_text(spark, sf_dir).select(
        "doc_id", whitespace.collapse_blank_lines(F.col("content")).alias("content")
    )


_HTML_KEPT = "(?is:<script[^>]*>.*?</script *>|<style[^>]*>.*?</style *>)"


@query(
    "strip_html_comments",
    f"SELECT page_id, regexp_replace(html, '({_HTML_KEPT})|(?m:^)[ \\t]*(?:(?s:<!--.*?-->)[ \\t\\r]*)+(?m:$)"
    "|(?s:<!--.*?-->)', '\\1', 'g') AS content FROM pages",
)
def strip_html_comments(spark, sf_dir):
    rows = pages(spark, sf_dir, heavy=True)
    return rows.select("page_id", strip_comments(F.col("content"), F.col("language"), False).alias("content"))


def _cleaned(**chosen) -> CleanOptions:
    off = dict.fromkeys(
        ("remove_comments", "remove_logging", "remove_accessors", "optimize_whitespace", "remove_empty_lines"), False
    )
    return CleanOptions(**{**off, **chosen})


def _clean_query(name: str, remove: set[str], options: CleanOptions, docs_are_comments: bool = False) -> None:
    sql = f"SELECT file_id, path, content FROM ({C.code_sql(remove, docs_are_comments)})"

    @query(name, sql)
    def run(spark, sf_dir):
        return clean(C.code_corpus(spark, sf_dir), options).select("file_id", "path", "content")


_clean_query("keep_doc_comments", {C.COMMENT}, _cleaned(remove_comments=True))
_clean_query(
    "strip_code_comments", {C.COMMENT}, _cleaned(remove_comments=True, preserve_doc_comments=False), True
)
_clean_query("strip_logging", {C.LOG}, _cleaned(remove_logging=True))
_clean_query("strip_accessors", {C.ACC}, _cleaned(remove_accessors=True))
_clean_query("strip_imports", {C.IMPORT}, _cleaned(remove_imports=True))

_ALL = {C.COMMENT, C.LOG, C.ACC}


def _whole_clean_sql(remove: set[str], docs: bool = False) -> str:
    return (
        f"SELECT file_id, path, language, CASE WHEN fine THEN {drop_blank_sql('content')} ELSE content END AS content,"
        f" CASE WHEN fine THEN 'cleaned' ELSE 'failed' END AS clean_status FROM ({C.code_sql(remove, docs)})"
    )


@query("clean_code", _whole_clean_sql(_ALL))
def clean_code(spark, sf_dir):
    return clean(C.code_corpus(spark, sf_dir)).select("file_id", "path", "language", "content", "clean_status")


@query("clean_code_fully", _whole_clean_sql(_ALL | {C.IMPORT}, True))
def clean_code_fully(spark, sf_dir):
    options = CleanOptions(preserve_doc_comments=False, remove_imports=True)
    return clean(C.code_corpus(spark, sf_dir), options).select(
        "file_id", "path", "language", "content", "clean_status"
    )


@query(
    "clean_unknown_language",
    f"SELECT path, text AS content, 'unchanged' AS clean_status FROM {DOCS}",
)
def clean_unknown_language(spark, sf_dir):
    return clean(documents(spark, sf_dir, heavy=True)).select("path", "content", "clean_status")


# --- manifest and budget ----------------------------------------------------------------

_FAILING = "CASE WHEN doc_id % 97 = 5 THEN 'read failed for ' || path END"
_STATUS = "CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN raw_size > 4096 THEN 'IGNORED' ELSE 'INCLUDED' END"
_LISTED = f"(SELECT path, doc_id, CAST(strlen(text) AS BIGINT) AS raw_size, {_FAILING} AS error FROM {DOCS})"


def _with_errors(spark, sf_dir) -> DataFrame:
    failing = F.when(F.col("doc_id") % 97 == 5, F.concat(F.lit("read failed for "), F.col("path")))
    return documents(spark, sf_dir).withColumn("error", failing)


@query(
    "manifest",
    f"SELECT path, raw_size, CAST(4096 AS BIGINT) AS size_limit, {_STATUS} AS status,"
    " CASE WHEN error IS NOT NULL THEN error WHEN raw_size > 4096 THEN 'size ' || CASE WHEN raw_size < 1024"
    " THEN CAST(raw_size AS VARCHAR) || ' B' WHEN raw_size < 1048576 THEN printf('%.1f KB', raw_size / 1024.0)"
    " ELSE printf('%.1f MB', raw_size / 1048576.0) END || ' exceeds limit of 4.0 KB' ELSE '' END AS reason"
    f" FROM {_LISTED}",
)
def manifest_query(spark, sf_dir):
    return manifest.manifest(_with_errors(spark, sf_dir), sizes.parse_size("4KB"))


@query(
    "budget",
    "SELECT count(*) FILTER (status = 'INCLUDED') AS included, count(*) FILTER (status = 'IGNORED') AS ignored,"
    " count(*) FILTER (status = 'ERROR') AS failed,"
    " CAST(sum(raw_size) FILTER (status = 'INCLUDED') AS BIGINT) AS total_size, CAST(1073741824 AS BIGINT) AS size_limit,"
    f" '' AS problem FROM (SELECT raw_size, {_STATUS} AS status FROM {_LISTED})",
)
def budget(spark, sf_dir):
    listing = manifest.manifest(_with_errors(spark, sf_dir), sizes.parse_size("4KB"))
    return manifest.budget(listing, sizes.parse_size("1GB"))


@query(
    "first_error",
    "SELECT count(error) AS failed, min(path) FILTER (error IS NOT NULL) AS first_path,"
    f" arg_min(error, path) FILTER (error IS NOT NULL) AS first_error FROM {_LISTED}",
)
def first_error(spark, sf_dir):
    return manifest.first_error(_with_errors(spark, sf_dir))


# --- outputs ----------------------------------------------------------------------------

_OUTPUTS = ["src1.xml", "src2/en.xml", "src2.xml", "src3/fr/all.xml", "src3/de.xml"]


@query(
    "assign_output",
    "SELECT doc_id, CASE WHEN source = 'src1' THEN 'src1.xml' WHEN source = 'src2' THEN 'src2/en.xml'"
    " WHEN source = 'src3' AND lang = 'de' THEN 'src3/de.xml' WHEN source = 'src3' THEN 'src3/fr/all.xml'"
    " ELSE 'src1_unmatched.xml' END AS output FROM documents",
)
def assign_output(spark, sf_dir):
    return assign.assign_outputs(documents(spark, sf_dir), _OUTPUTS).select("doc_id", "output")


# independent of the prefix lookup: compare every path with every output
@query(
    "assign_output_table",
    "WITH outs AS (SELECT DISTINCT source || '/' || lang || '.xml' AS output, source, lang FROM documents WHERE lang <> 'fr'),"
    " ranked AS (SELECT d.path, o.output, CASE WHEN d.lang = o.lang THEN 2 ELSE 1 END AS n, row_number() OVER"
    " (PARTITION BY d.path ORDER BY CASE WHEN d.lang = o.lang THEN 2 ELSE 1 END DESC, o.output) AS r"
    f" FROM {DOCS} d LEFT JOIN outs o ON d.source = o.source) SELECT path, output FROM ranked WHERE r = 1",
)
def assign_output_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    output = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(".xml")).alias("output")
    outputs = docs.where("lang <> 'fr'").select(output).distinct()
    # ties go to the smaller name: the ordinal is the name itself
    return assign.assign_to_table(docs, outputs.withColumn("ordinal", F.col("output")))


@query(
    "document_index",
    f"SELECT path, lang AS output, row_number() OVER (PARTITION BY lang ORDER BY path) AS index FROM {DOCS}",
)
def document_index(spark, sf_dir):
    keys = documents(spark, sf_dir).select("path", F.col("lang").alias("output"))
    return numbering.number_documents(keys)


# every third part is a link: to one hot file, to nothing, to each other, or to the one three below
_TARGET = (
    "CASE WHEN p_partkey % 3 <> 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 1 WHEN p_partkey % 13 = 0 THEN -p_partkey"
    " WHEN p_partkey % 102 = 51 THEN p_partkey + 51 WHEN p_partkey % 102 = 0 THEN p_partkey - 51 ELSE p_partkey - 3 END"
)


@query(
    "dedup_links",
    f"""
WITH RECURSIVE links AS (SELECT p_partkey AS k, {_TARGET} AS target FROM part),
walk AS (
  SELECT k, target AS place, 0 AS n FROM links WHERE target IS NOT NULL
  UNION ALL
  SELECT w.k, l.target, w.n + 1 FROM walk w JOIN links l ON l.k = w.place WHERE l.target IS NOT NULL AND w.n < 400
), ended AS (
  SELECT k, place, n FROM walk QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1
), resolved AS (
  SELECT s.k, CASE WHEN s.target IS NULL THEN s.k WHEN l.n < 400 THEN e.k END AS identity, s.target IS NOT NULL AS is_link,
         CASE WHEN s.target IS NULL THEN NULL WHEN l.n >= 400 THEN '{links.CYCLE}' WHEN e.k IS NULL THEN '{links.BROKEN}' END AS link_error
  FROM links s LEFT JOIN ended l ON l.k = s.k LEFT JOIN links e ON e.k = l.place
)
SELECT 'f/' || k AS path, 'f/' || identity AS identity, link_error FROM resolved
QUALIFY link_error IS NOT NULL OR row_number() OVER (PARTITION BY identity, link_error ORDER BY is_link, 'f/' || k) = 1
""",
)
def dedup_links(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(_TARGET).alias("to"))
    name = lambda c: F.concat(F.lit("f/"), F.col(c).cast("string"))
    files = part.select(name("p_partkey").alias("path"), name("to").alias("target"))
    return links.distinct_files(files).select("path", "identity", "link_error")


# --- bundles ----------------------------------------------------------------------------

_XML_HEAD = "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<documents>'"
_XML_TAIL = "chr(10) || '</documents>'"


def _xml_fragment(index: str, source: str, content: str) -> str:
    return (
        f"chr(10) || '<document index=\"' || CAST({index} AS VARCHAR) || '\">' || chr(10) || '<source>' || {_xml_sql(source)}"
        f" || '</source>' || chr(10) || '<document_content>' || {_xml_sql(content)} || '</document_content>' || chr(10)"
        " || '</document>'"
    )


def _xml_bundle_sql(rows: str, limit: int) -> str:
    """``rows`` gives output, path, source, content."""
    return (
        f"SELECT output, documents, CAST(strlen(whole) AS BIGINT) AS rendered_size, CASE WHEN strlen(whole) > {limit} THEN"
        f" 'output size (' || CAST(strlen(whole) AS VARCHAR) || ' bytes) exceeds maximum allowed size ({limit} bytes)' END"
        f" AS error, CASE WHEN strlen(whole) <= {limit} THEN whole END AS bundle FROM (SELECT output, count(*) AS documents,"
        f" {_XML_HEAD} || string_agg({_xml_fragment('n', 'source', 'content')}, '' ORDER BY n) || {_XML_TAIL} AS whole FROM"
        f" (SELECT *, row_number() OVER (PARTITION BY output ORDER BY path) AS n FROM ({rows})) GROUP BY output)"
    )


def _by_lang(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir, heavy=True).withColumn("output", F.concat(F.col("lang"), F.lit(".xml")))


_BY_LANG = f"SELECT lang || '.xml' AS output, path, path AS source, text AS content FROM {DOCS}"
XML_LIMIT = "50MB"


@query("xml_bundle_by_lang", _xml_bundle_sql(_BY_LANG, sizes.parse_size(XML_LIMIT)))
def xml_bundle_by_lang(spark, sf_dir):
    return bundles.render_bundles(_by_lang(spark, sf_dir), "xml", sizes.parse_size(XML_LIMIT))


_BY_SOURCE = f"SELECT source || '/' || lang || '.xml' AS output, path, path AS source, text AS content FROM {DOCS}"


@query("bundle_size_cap", _xml_bundle_sql(_BY_SOURCE, 20480))
def bundle_size_cap(spark, sf_dir):
    rows = documents(spark, sf_dir, heavy=True).withColumn(
        "output", F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(".xml"))
    )
    return bundles.render_bundles(rows, "xml", sizes.parse_size("20KB"))


SHARD_BYTES = 16384


@query(
    "bundle_shards",
    "SELECT output, path, index, CAST(start AS BIGINT) AS \"offset\", CAST(strlen(frag) AS BIGINT) AS bytes,"
    f" CAST(start // {SHARD_BYTES} AS INTEGER) AS shard FROM (SELECT *, strlen({_XML_HEAD}) + coalesce(sum(strlen(frag))"
    " OVER (PARTITION BY output ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start"
    f" FROM (SELECT *, {_xml_fragment('index', 'path', 'content')} AS frag FROM (SELECT *,"
    f" row_number() OVER (PARTITION BY output ORDER BY path) AS index FROM ({_BY_SOURCE}))))",
)
def bundle_shards(spark, sf_dir):
    rows = documents(spark, sf_dir, heavy=True).withColumn(
        "output", F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(".xml"))
    )
    return shards.shard_documents(rows, "xml", SHARD_BYTES)


@query(
    "rendered_sizes",
    "SELECT output, documents, rendered_size, error FROM (" + _xml_bundle_sql(_BY_SOURCE, 20480) + ")",
)
def rendered_sizes(spark, sf_dir):
    rows = documents(spark, sf_dir, heavy=True).withColumn(
        "output", F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(".xml"))
    )
    return bundles.check_sizes(bundles.encode_documents(rows, "xml", F.col("path")), "xml", 20480)


@query(
    "xml_fragments",
    f"SELECT output, index, {_xml_fragment('index', 'path', 'content')} AS fragment FROM (SELECT lang || '.xml' AS output,"
    f" path, text AS content, row_number() OVER (PARTITION BY lang ORDER BY path) AS index FROM {DOCS})",
)
def xml_fragments(spark, sf_dir):
    rows = _by_lang(spark, sf_dir)
    keys = numbering.number_documents(rows.select("output", "path"))
    numbered = rows.select("path", "content").join(keys, "path")
    text = bundles.fragment(
        F.col("index"), bundles.encode(F.col("path"), "xml"), bundles.encode(F.col("content"), "xml"), "xml"
    )
    return numbered.select("output", "index", text.alias("fragment"))


_BY_SOURCE = f"SELECT source || '.xml' AS output, path, path AS source, text AS content FROM {DOCS}"
BUNDLE_LIMIT = "1GB"


@query(
    "empty_outputs",
    "WITH wanted AS (SELECT DISTINCT source || '.xml' AS output FROM documents"
    " UNION ALL SELECT DISTINCT source || '.none.xml' FROM documents),"
    f" blank AS (SELECT {_XML_HEAD} || {_XML_TAIL} AS e)"
    " SELECT output, coalesce(documents, 0) AS documents, CAST(coalesce(rendered_size, strlen(e)) AS BIGINT) AS rendered_size,"
    f" error, coalesce(bundle, e) AS bundle FROM wanted LEFT JOIN ({_xml_bundle_sql(_BY_SOURCE, sizes.parse_size(BUNDLE_LIMIT))}) USING (output), blank",
)
def empty_outputs(spark, sf_dir):
    docs = documents(spark, sf_dir, heavy=True).withColumn("output", F.concat(F.col("source"), F.lit(".xml")))
    none = docs.select(F.concat(F.col("source"), F.lit(".none.xml")).alias("output"))
    wanted = docs.select("output").unionAll(none).distinct()
    return bundles.render_bundles(docs, "xml", sizes.parse_size(BUNDLE_LIMIT), outputs=wanted)


def _quoted_sql(text: str, html: bool) -> str:
    pairs = [("\\", "\\\\"), ('"', '\\"')]
    for old, new in pairs:
        text = f"replace({text}, '{old}', '{new}')"
    for code, new in ((10, "\\n"), (13, "\\r"), (9, "\\t")):
        text = f"replace({text}, chr({code}), '{new}')"
    if html:
        for old, new in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
            text = f"replace({text}, '{old}', '{new}')"
    return f"('\"' || {text} || '\"')"


def _text_bundle_sql(rows: str, head: str, piece: str, between: str, tail: str) -> str:
    return (
        "SELECT output, documents, CAST(strlen(bundle) AS BIGINT) AS rendered_size, CAST(NULL AS VARCHAR) AS error, bundle"
        f" FROM (SELECT output, count(*) AS documents, {head} || string_agg({piece}, {between} ORDER BY n) || {tail} AS bundle"
        f" FROM ({rows}) GROUP BY output)"
    )


_CONV = (
    "SELECT CAST(conv_id AS VARCHAR) AS output, path, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, path) AS n"
    f" FROM {TURNS}"
)
_NL = " || chr(10) || "


@query(
    "json_bundle_by_conversation",
    _text_bundle_sql(
        _CONV,
        f"'{{'{_NL}'  \"documents\": ['{_NL}''",
        f"'    {{'{_NL}'      \"index\": ' || CAST(n AS VARCHAR) || ','{_NL}'      \"source\": ' || {_quoted_sql('path', True)}"
        f" || ','{_NL}'      \"document_content\": ' || {_quoted_sql('text', True)}{_NL}'    }}'",
        "',' || chr(10)",
        f"chr(10) || '  ]'{_NL}'}}' || chr(10)",
    ),
)
def json_bundle_by_conversation(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("output", F.col("conv_id").cast("string"))
    return bundles.render_bundles(rows, "json", sizes.parse_size("50MB"), order=("turn", "path"))


@query(
    "yaml_bundle_by_conversation",
    _text_bundle_sql(
        _CONV,
        "'documents:' || chr(10)",
        f"'  - index: ' || CAST(n AS VARCHAR){_NL}'    source: ' || {_quoted_sql('path', False)}{_NL}"
        f"'    document_content: ' || {_quoted_sql('text', False)} || chr(10)",
        "''",
        "''",
    ),
)
def yaml_bundle_by_conversation(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("output", F.col("conv_id").cast("string"))
    return bundles.render_bundles(rows, "yaml", sizes.parse_size("50MB"), order=("turn", "path"))


@query(
    "bundle_display_paths",
    _xml_bundle_sql(
        f"SELECT source || '.xml' AS output, path, 'corpus/' || path AS source, text AS content FROM {DOCS}",
        sizes.parse_size(BUNDLE_LIMIT),
    ),
)
def bundle_display_paths(spark, sf_dir):
    docs = documents(spark, sf_dir, heavy=True).withColumn("output", F.concat(F.col("source"), F.lit(".xml")))
    return bundles.render_bundles(docs, "xml", sizes.parse_size(BUNDLE_LIMIT), source=paths.display_path(F.col("path"), "/work/corpus"))


_PACKED = PackOptions(
    include="*.{go,java,py,js,ts,kt,swift,rb},!**/Brand#1?/*",
    exclude="*7.java",
    max_file_size="1000B",
    max_output_size="1GB",
    roots=("/repo/src/Brand#2", "/repo/src/Brand#3"),
    work_dir="/repo/src",
    output_path=None,
    clean=CleanOptions(),
)
_PACK_ROWS = f"""
SELECT CASE WHEN p_brand = 'Brand#3' THEN '/repo/src/Brand#3.xml' ELSE '/repo/src/Brand#2.xml' END AS output,
  c.path, c.path AS source, CASE WHEN c.fine THEN {drop_blank_sql('c.content')} ELSE c.content END AS content
FROM ({C.code_sql(_ALL)}) c JOIN ({C.code_sql()}) o USING (file_id) JOIN part p ON p.p_partkey = c.file_id
WHERE strlen(o.content) <= 1000 AND c.language IN ('go','java','python','javascript','typescript','kotlin','swift','ruby')
  AND p.p_brand IN ('Brand#2', 'Brand#3') AND c.path NOT LIKE '%7.java'
"""


@query("pack_code", _xml_bundle_sql(_PACK_ROWS, sizes.parse_size("1GB")))
def pack_code(spark, sf_dir):
    corpus = C.code_corpus(spark, sf_dir).withColumn("path", F.concat(F.lit("/repo/"), F.col("path")))
    return pack(corpus.drop("file_id"), _PACKED)
