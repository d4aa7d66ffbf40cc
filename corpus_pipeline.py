"""A training-data pipeline over ``documents``: five operators, each on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import stages
from pagemill.llm.storage import free, mark, table, written

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_repeated_lines),
    ("ngram_join", stages.keep_one_of_each_group),
    ("mix_sources", stages.mix_sources),
    ("sentencepiece", stages.encode_pieces),
]

#: Trained models, alignment and sampled pieces can't be written in SQL; tests hold the
#: pipeline against its parts and brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in turn; each result is written and read as the next one's input.

    What a stage wrote besides is deleted once its result is stored.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since = mark()
        docs = written(stage(spark, docs, sf_dir), name)
        free(spark, since, keep=(name,))
    return STAGES[-1][1](spark, docs, sf_dir)
