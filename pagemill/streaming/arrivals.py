"""Conversion of files as they arrive: the batch plan on each micro-batch, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators import mapping, topics
from pagemill.sources import docx

_FILE = "path string, modificationTime timestamp, length long, content binary"


def convert(files: DataFrame) -> DataFrame:
    """Topics of binary DOCX files; a file's key is a hash of its path."""
    keyed = files.select(F.xxhash64("path").alias("doc_id"), "content")
    return topics.render(mapping.map_blocks(docx.blocks(docx.parse(keyed))))


def convert_folder(spark: SparkSession, folder: str) -> DataFrame:
    return convert(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(folder))


def convert_arrivals(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Converts new files under ``folder`` into Parquet under ``target`` and stops when none is left.

    Each micro-batch writes a folder of its own, named by its number, so a repeated batch
    replaces what it wrote before.
    """
    stream = spark.readStream.schema(_FILE).format("binaryFile").option("pathGlobFilter", "*.docx").load(folder)

    def write(files: DataFrame, number: int) -> None:
        convert(files).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
