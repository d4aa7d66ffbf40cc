"""Schemas of the fact tables that parsers produce and operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Block types; anything else is refused.
BLOCK_TYPES = ("heading", "paragraph", "list_item", "table", "figure", "note_header", "note_inline", "code_block", "dropped")
SCHEMAS = {
    "pages": "doc_id long, page_no int, width double, height double, text string",
    "words": "doc_id long, page_no int, word_seq int, text string, x0 double, x1 double, top double, bottom double, fontname string, size double",
    "page_rules": "doc_id long, page_no int, kind string, x0 double, x1 double, top double, bottom double, linewidth double",
    "spans": "doc_id long, page_no int, block_no int, line_no int, span_no int, text string, size double, x0 double, y0 double, x1 double, y1 double",
    "links": "doc_id long, page_no int, link_seq int, y_mid double, uri string",
    "drawings": "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double",
    "toc": "doc_id long, toc_seq int, level int, title string, page_no int",
    "blocks": "doc_id long, seq int, type string, level int, list_kind string, note_type string, text string, rows array<array<string>>",
}


def read_facts(spark: SparkSession, name: str, path: str, format: str = "parquet") -> DataFrame:
    """A fact table with its declared schema; nothing is inferred."""
    return spark.read.schema(SCHEMAS[name]).format(format).load(path)


def checked_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with stripped text; a type that isn't one raises when the row is read."""
    known = F.col("type").isin(*BLOCK_TYPES)
    right = F.when(known, F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown block type: "), F.coalesce("type", F.lit("null")))).cast("string"))
    return blocks.withColumn("type", right).withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", ""))


def rule_lines(rules: DataFrame) -> DataFrame:
    """Drawn rectangles, and lines of more than 50 points as rectangles of their width."""
    rects = rules.where("kind = 'rect'").select("doc_id", "page_no", "x0", "x1", "top", "bottom")
    lines = rules.where("kind = 'line' and x1 - x0 > 50").select("doc_id", "page_no", "x0", "x1", "top", (F.col("top") + F.coalesce("linewidth", F.lit(0.5))).alias("bottom"))
    return rects.unionByName(lines)
