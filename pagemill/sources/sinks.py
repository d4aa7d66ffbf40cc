"""Topics and maps as files: one archive a document, or named files in a folder."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import topics as P


def _zip(files: list[tuple[str, bytes | str]]) -> bytes:
    """The same bytes for the same files."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as file:
        for name, content in files:
            file.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
    return data.getvalue()


def archives(topics: DataFrame, title: object = None, media: DataFrame | None = None, selected: bool = False) -> DataFrame:
    """doc_id, n_files, content: a ZIP of each document's topics, their map and its media.

    ``media`` is (doc_id, href, content) with hrefs like ``media/x.png``; all of a document's
    go in.  For a selection, pass its topics and ``selected``: the map lists just those and its
    title and file name say so.
    """
    name = F.col("doc_id").cast("string") if title is None else title
    titled = F.concat(name, F.lit(" (selection)")) if selected else name
    file = F.struct("topic_no", "filename", "xml", P.map_item("map").alias("item"))
    files = topics.groupBy("doc_id").agg(F.array_sort(F.collect_list(file)).alias("files")).withColumn("map", P.map_xml(F.col("files.item"), titled, "map"))
    empty = F.array().cast("array<struct<href:string,content:binary>>")
    if media is None:
        files = files.withColumn("media", empty)
    else:
        own = media.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("href", "content"))).alias("media"))
        files = files.join(own, "doc_id", "left").withColumn("media", F.coalesce("media", empty))
    listing_name = f"document{'_selection' if selected else ''}.ditamap"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc, topics_of, listing, images = (batch.column(c)[k].as_py() for c in range(4))
                held = [(f["filename"], f["xml"]) for f in topics_of] + [(listing_name, listing)] + [(m["href"], m["content"]) for m in images]
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([len(held)], pa.int32()), pa.array([_zip(held)], pa.binary())], ["doc_id", "n_files", "content"])

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "files", "map", "media").mapInArrow(run, "doc_id long, n_files int, content binary")


def image_archives(images: DataFrame) -> DataFrame:
    """group_id, n_files, content: a ZIP of the images (group_id, name, content) of each group; null contents are left out."""
    files = images.where("content is not null").groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("name", "content"))).alias("files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held = [(f["name"], f["content"]) for f in batch.column(1)[k].as_py()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([len(held)], pa.int32()), pa.array([_zip(held)], pa.binary())], ["group_id", "n_files", "content"])

    return files.select(F.col("group_id").cast("long").alias("group_id"), "files").mapInArrow(run, "group_id long, n_files int, content binary")


def trace(checks: DataFrame) -> DataFrame:
    """doc_id, line_no, message: the log lines of a document's checks, in order, for a log file or table."""
    message = F.concat(F.lit("[QUALITY] "), F.col("check_id"), F.lit(": "), F.col("status"))
    return checks.select("doc_id", F.col("check_no").cast("int").alias("line_no"), message.alias("message"))


def save_files(files: DataFrame, folder: str) -> int:
    """Writes rows (name, content) as files under ``folder``, a URI that executors reach; how many.

    A retried task writes its files again, with the same content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{root}/{name}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("name", F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
