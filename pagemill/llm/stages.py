"""Operators as pipeline stages: documents in, documents out, decisions carried out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines, mixing, ngram_join, pieces, toxicity
from .storage import table

#: A document scored at least this is rejected.
TOXIC = 0.5


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def _free_name(wanted: str, docs: DataFrame) -> str:
    """A column name that ``docs`` doesn't have, so that extra columns never clash with a stage's own."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores below TOXIC; the model learns from the table ``labels``.

    Null and empty texts are scored as texts without evidence and stay with any usual model;
    repeated rows share a score, so all of them stay or go; an empty table gives an empty
    table; extra columns pass through under any name.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    name = _free_name("stage_score", docs)
    return toxicity.add_score(docs, model, name).where(F.col(name) < TOXIC).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds; those left without a word go.

    Null texts stay null; of equal texts the one with the least doc_id is kept whole; rows
    without a doc_id and rows that repeat one don't lose lines to each other; an empty table
    gives an empty table; extra columns pass through under any name.
    """
    key = _free_name("stage_row", docs)
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias(key))
    found = lines.dedup_lines(rows)
    found = found.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(mixing.WORD))
    return _recounted(found.select(*[F.col("kept_text").alias(c) if c == "text" else F.col(key)[c].alias(c) for c in docs.columns]), docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are the least of their group of near-duplicates.

    Rows without a doc_id, and texts that are null or without words, link with nothing and
    stay; rows that repeat a doc_id stay or go together; an empty table gives an empty
    table; extra columns pass through under any name.
    """
    later = ngram_join.near_duplicates(docs.select("doc_id", "text")).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Rows that repeat a doc_id are taken alike, as often as the most taken of them; null
    doc_ids are one such group; a null source is a source of its own, and null or empty
    texts count no words and stay; an empty table gives an empty table; extra columns pass
    through under any name.
    """
    taken = mixing.mix(docs.select("doc_id", "text", "source")).groupBy(F.col("doc_id").alias("mixed_doc")).agg(F.max("copies").alias("mixed_copies")).where("mixed_copies > 0")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_doc"))
    found = rows.join(taken, rows["own_doc"].eqNullSafe(taken["mixed_doc"]))
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("mixed_copies").cast("int"))).alias("copy")).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces, decoded_sha256, lossless of each row.

    A null text has null pieces, an empty one none; repeated rows are encoded alike; an empty
    table gives an empty table; extra columns are ignored.
    """
    return pieces.round_trip(docs)
