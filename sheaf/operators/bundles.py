"""Rendered bundles: numbered documents in XML, JSON or YAML, one row per output.

The size limit per output is applied before any text is gathered: sizes are
sums, which combine on the map side, so an output far above the limit never
reaches one task. What is gathered is at most the limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.encode import escape_xml, json_string, yaml_string

# tasks over which the rows of one output are spread when refused outputs are left out
SALTS = 32


@dataclass(frozen=True)
class Layout:
    """Fixed text around the parts of a bundle."""

    head: str
    before_index: str
    before_source: str
    before_content: str
    after_content: str
    between: str
    tail: str
    empty: str

    def fixed(self) -> int:
        parts = (self.before_index, self.before_source, self.before_content, self.after_content)
        return sum(len(p) for p in parts)


# fixed values: the exact text of each format
LAYOUTS = {
    "xml": Layout(
        head='<?xml version="1.0" encoding="UTF-8"?>\n<documents>',
        before_index='\n<document index="',
        before_source='">\n<source>',
        before_content="</source>\n<document_content>",
        after_content="</document_content>\n</document>",
        between="",
        tail="\n</documents>",
        empty='<?xml version="1.0" encoding="UTF-8"?>\n<documents>\n</documents>',
    ),
    "json": Layout(
        head='{\n  "documents": [\n',
        before_index='    {\n      "index": ',
        before_source=',\n      "source": ',
        before_content=',\n      "document_content": ',
        after_content="\n    }",
        between=",\n",
        tail="\n  ]\n}\n",
        empty='{\n  "documents": []\n}\n',
    ),
    "yaml": Layout(
        head="documents:\n",
        before_index="  - index: ",
        before_source="\n    source: ",
        before_content="\n    document_content: ",
        after_content="\n",
        between="",
        tail="",
        empty="documents: []\n",
    ),
}
ENCODERS = {"xml": escape_xml, "json": json_string, "yaml": yaml_string}


def encode(text: Column, fmt: str) -> Column:
    """A scalar in the given format, empty for null."""
    return ENCODERS[fmt](F.coalesce(text, F.lit("")))


def fragment(index: Column, source: Column, content: Column, fmt: str) -> Column:
    """One rendered document from already encoded parts."""
    lay = LAYOUTS[fmt]
    return F.concat(
        F.lit(lay.before_index),
        index.cast("string"),
        F.lit(lay.before_source),
        source,
        F.lit(lay.before_content),
        content,
        F.lit(lay.after_content),
    )


def _digits(count: Column) -> Column:
    """Total digits of the numbers 1..count."""
    total = F.lit(0).cast("bigint")
    for power in range(18):
        total = total + F.greatest(count - F.lit(10**power - 1), F.lit(0))
    return total


def rendered_sizes(encoded: DataFrame, fmt: str) -> DataFrame:
    """Documents and exact rendered bytes per output of ``(output, source, body)`` rows."""
    lay = LAYOUTS[fmt]
    sums = encoded.groupBy("output").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum((F.octet_length("source") + F.octet_length("body")).cast("bigint")).alias("_bytes"),
    )
    n = F.col("documents")
    size = (
        F.lit(len(lay.head) + len(lay.tail) - len(lay.between))
        + n * F.lit(lay.fixed() + len(lay.between))
        + _digits(n)
        + F.col("_bytes")
    )
    return sums.select("output", "documents", size.cast("bigint").alias("rendered_size"))


def _too_large(size: Column, limit: int) -> Column:
    return F.concat(
        F.lit("output size ("),
        size.cast("string"),
        F.lit(f" bytes) exceeds maximum allowed size ({limit} bytes)"),
    )


def check_sizes(encoded: DataFrame, fmt: str, limit: int) -> DataFrame:
    """``(output, documents, rendered_size, error)``; error is null within the limit."""
    over = F.col("rendered_size") > F.lit(limit)
    return rendered_sizes(encoded, fmt).withColumn("error", F.when(over, _too_large(F.col("rendered_size"), limit)))


def encode_documents(
    df: DataFrame, fmt: str, source: Column, content: str = "content", order: Sequence[str] = ("path",)
) -> DataFrame:
    """``(output, source, body, order...)`` with both texts encoded for the format.

    ``output`` is made non-null so that every use of the sizes has the same plan
    and the shuffle behind them runs once.
    """
    return df.select(
        F.coalesce("output", F.lit("")).alias("output"),
        encode(source, fmt).alias("source"),
        encode(F.col(content), fmt).alias("body"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
    )


def render_bundles(
    df: DataFrame,
    fmt: str,
    limit: int,
    source: Column | None = None,
    content: str = "content",
    order: Sequence[str] = ("path",),
    outputs: DataFrame | None = None,
) -> DataFrame:
    """One row per output: ``output, documents, rendered_size, error, bundle``.

    An output above ``limit`` bytes gets an error and no bundle. Its rows are
    dropped before they are gathered, by a join on the output and a salt, so
    that no refused output meets in one task, however large. ``outputs`` adds
    the outputs without any document, rendered as valid empty bundles.
    """
    lay = LAYOUTS[fmt]
    encoded = encode_documents(df, fmt, F.col("path") if source is None else source, content, order)
    sizes = check_sizes(encoded, fmt, limit)
    fits = sizes.where(F.col("error").isNull()).select(
        "output", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    )
    gathered = (
        encoded.withColumn("_salt", F.pmod(F.xxhash64("source", "body"), F.lit(SALTS)).cast("int"))
        .join(fits, ["output", "_salt"], "left_semi")
        .groupBy("output")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(*[F.col(c) for c in encoded.columns if c.startswith("_o")], "source", "body")
                )
            ).alias("_docs")
        )
    )
    texts = F.transform("_docs", lambda d, i: fragment(i + 1, d["source"], d["body"], fmt))
    bundles = gathered.select(
        "output",
        F.concat(F.lit(lay.head), F.array_join(texts, lay.between), F.lit(lay.tail)).alias("bundle"),
    )
    out = sizes.join(bundles, "output", "left")
    if outputs is not None:
        out = outputs.select("output").distinct().join(out, "output", "full")
        none = F.col("documents").isNull()
        out = out.select(
            "output",
            F.coalesce("documents", F.lit(0).cast("bigint")).alias("documents"),
            F.coalesce("rendered_size", F.lit(len(lay.empty)).cast("bigint")).alias("rendered_size"),
            "error",
            F.when(none, F.lit(lay.empty)).otherwise(F.col("bundle")).alias("bundle"),
        )
    return out.select("output", "documents", "rendered_size", "error", "bundle")


def write_bundles(bundles: DataFrame, folder: str) -> None:
    """Write every accepted bundle as text below ``folder/output=<name>/``.

    The job's committer publishes the files, so a lost task leaves nothing
    half-written. Spark ends a text row with a line feed, so the one a bundle
    ends with is left to it, and an XML bundle gains one. No expression here
    decodes the text: its bytes are written as they are.
    """
    bundle = F.col("bundle")
    text = F.when(F.endswith(bundle, F.lit("\n")), F.left(bundle, F.length(bundle) - 1)).otherwise(bundle)
    bundles.where(F.col("error").isNull()).select("output", text.alias("value")).write.mode("overwrite").partitionBy(
        "output"
    ).text(folder)
