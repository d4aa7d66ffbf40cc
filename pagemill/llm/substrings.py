"""Substring dedup with a log-structured index of window fingerprints.

A window is ``width`` consecutive words of one document.  Documents are cut into parts by
ranges of doc_id; each part is one batch of the index, and parts follow one another as
batches do in time:

1. Every part gives its distinct window fingerprints as sorted, immutable runs, dealt into
   buckets by key range.  A task sends each fingerprint once, however often it occurs.
2. In each bucket the parts' runs are merge-joined in order with the history before them.
   A hit on the 48-bit key is verified by a check of 16 bits from an independent hash.
   The history is a few sorted runs, compacted when they grow alike.
3. Hits go back to their part, which reads its documents in order, adds repeats inside the
   part, and removes every word that a repeated window covers.

An index folder makes the same thing incremental: its runs are history before part 0, and
the batch's new fingerprints become its next run.

Defined cases: a null text has no words; documents shorter than a window are kept whole;
null doc_ids come first; rows with one doc_id follow one another by text; an empty table
gives an empty table; other columns are ignored.  Memory is bounded by a part's or a
bucket's fingerprints (8 bytes each) and the longest document; both shrink with
``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges
from .storage import table, tasks, written
from .textscan import U, Chunk, check_base, chunks

WIDTH = 20
KEY_BITS, CHECK_BITS = 48, 16
_FLUSH = 3_000_000  # fingerprints that a task holds before it sends runs
_RUN = "bucket int, part int, first long, deltas binary, checks binary"
_RUN_SCHEMA = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("first", pa.int64()), ("deltas", pa.binary()), ("checks", pa.binary())])


def fingerprints(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) of each window: 48 bits of one hash, 16 of another."""
    rows, key = chunk.windows(width)
    _, check = chunk.windows(width, base=check_base())
    return rows, (key & U(0xFFFFFFFFFFFF0000)) | (check >> U(64 - CHECK_BITS))


def pack(run: np.ndarray) -> tuple[int, bytes, bytes]:
    """A sorted run as its first key, the keys' differences, and the checks."""
    keys = run >> U(CHECK_BITS)
    deltas = np.diff(keys)
    narrow = not len(deltas) or deltas.max() < 1 << 32
    return int(keys[0]), deltas.astype(np.uint32 if narrow else np.uint64).tobytes(), run.astype(np.uint16).tobytes()


def unpack(first: int, deltas: bytes, checks: bytes) -> np.ndarray:
    check = np.frombuffer(checks, dtype=np.uint16)
    narrow = len(deltas) == 4 * (len(check) - 1)
    keys = np.empty(len(check), dtype=U)
    keys[0] = first
    np.cumsum(np.frombuffer(deltas, dtype=np.uint32 if narrow else U), out=keys[1:], dtype=U)
    keys[1:] += U(first)
    return (keys << U(CHECK_BITS)) | check.astype(U)


def bucket_edges(buckets: int) -> np.ndarray:
    """Least fingerprint of each bucket: equal ranges of the key space."""
    return np.array([(i << 64) // buckets for i in range(buckets)], dtype=U)


def rows_of(runs: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    packed = [(bucket, part, *pack(run)) for bucket, part, run in runs]
    return pa.RecordBatch.from_pylist([dict(zip(_RUN_SCHEMA.names, x, strict=True)) for x in packed], schema=_RUN_SCHEMA)


class History:
    """Sorted runs; a run of at most twice the next one's size is merged into it."""

    def __init__(self) -> None:
        self.runs: list[np.ndarray] = []

    def holds(self, run: np.ndarray) -> np.ndarray:
        found = np.zeros(len(run), dtype=bool)
        for old in self.runs:
            at = np.searchsorted(old, run)
            at[at == len(old)] = 0
            found |= old[at] == run
        return found

    def add(self, run: np.ndarray) -> None:
        if not len(run):
            return
        self.runs.append(run)
        while len(self.runs) > 1 and len(self.runs[-2]) <= 2 * len(self.runs[-1]):
            top = self.runs.pop()
            merged = np.concatenate([self.runs.pop(), top])
            merged.sort(kind="stable")  # two sorted stretches: a merge
            self.runs.append(merged)


def _runs(cuts: np.ndarray, buckets: int, width: int) -> Callable:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        count, edges = 0, bucket_edges(buckets)

        def flush() -> Iterator[pa.RecordBatch]:
            for part, arrays in held.items():
                run = np.unique(np.concatenate(arrays))
                at = np.append(np.searchsorted(run, edges), len(run))
                out = [(b, part, run[at[b] : at[b + 1]]) for b in range(buckets) if at[b] < at[b + 1]]
                if out:
                    yield rows_of(out)

        for batch in batches:
            parts = ranges.parts(cuts, batch.column(0))
            for chunk in chunks(batch.column(1)):
                rows, found = fingerprints(chunk, width)
                part_of = parts[chunk.lo : chunk.hi][rows]
                for part in np.unique(part_of):
                    held.setdefault(int(part), []).append(np.unique(found[part_of == part]))
                count += len(found)
                if count >= _FLUSH:
                    yield from flush()
                    held, count = {}, 0
        yield from flush()

    return build


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list]]:
    """(key, rows) of consecutive rows with one key; rows are dicts."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != now and rows:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


def _merge(keep_runs: bool) -> Callable:
    """Merge-joins the parts' runs of each bucket; gives hits, and new fingerprints as part -1."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in grouped(batches, "bucket"):
            history, at = History(), 0
            while at < len(rows):
                part, arrays = rows[at]["part"], []
                while at < len(rows) and rows[at]["part"] == part:
                    arrays.append(unpack(rows[at]["first"], rows[at]["deltas"], rows[at]["checks"]))
                    rows[at] = {"part": part}  # its bytes may go
                    if part < 0:
                        history.add(arrays.pop())
                    at += 1
                if not arrays:
                    continue
                run = arrays[0] if len(arrays) == 1 else np.unique(np.concatenate(arrays))
                seen = history.holds(run)
                if seen.any():
                    yield rows_of([(bucket, part, run[seen])])
                history.add(run[~seen])
                if keep_runs and not seen.all():
                    yield rows_of([(bucket, -1, run[~seen])])

    return merge


def _remove(width: int) -> Callable:
    """Reads each part's hits, then its documents in order."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, hits, history = None, [], History()
        for batch in batches:
            parts = batch.column(0).to_numpy()
            for lo in [0, *(np.flatnonzero(np.diff(parts)) + 1)] if batch.num_rows else []:
                same = batch.slice(lo, int(np.searchsorted(parts[lo:] != parts[lo], True)))
                if part != parts[lo]:
                    part, hits, history = parts[lo], [], History()
                kinds = same.column(1).to_numpy()
                cut = int(np.searchsorted(kinds, 1))
                for row in same.slice(0, cut).select([4, 5, 6]).to_pylist():
                    hits.append(unpack(row["first"], row["deltas"], row["checks"]))
                docs = same.slice(cut)
                if not docs.num_rows:
                    continue
                if hits:
                    all_hits = np.concatenate(hits)
                    all_hits.sort()
                    history.add(all_hits)
                    hits = []
                for chunk in chunks(docs.column(3)):
                    yield _kept(chunk, docs.column(2).slice(chunk.lo, chunk.hi - chunk.lo), history, width)

    return remove


def _kept(chunk: Chunk, ids: pa.Array, history: History, width: int) -> pa.RecordBatch:
    rows, found = fingerprints(chunk, width)
    distinct, first, which = np.unique(found, return_index=True, return_inverse=True)
    seen = history.holds(distinct)
    repeated = seen[which] | (first[which] != np.arange(len(found)))
    history.add(distinct[~seen])

    n_words = len(chunk.starts)
    edge = np.zeros(n_words + 1, dtype=np.int64)
    offset = np.arange(len(rows)) - np.searchsorted(rows, rows)  # of the window in its row
    at = chunk.word_at[:-1][rows] + offset
    np.add.at(edge, at[repeated], 1)
    np.add.at(edge, at[repeated] + width, -1)
    covered = np.cumsum(edge)[:-1] > 0
    sums = np.append(0, np.cumsum(covered))
    removed = sums[chunk.word_at[1:]] - sums[chunk.word_at[:-1]]
    data, texts = chunk.data.tobytes(), []
    for r in range(chunk.hi - chunk.lo):
        words = data[chunk.row_at[r] : chunk.row_at[r + 1]].split()
        if removed[r]:
            words = compress(words, ~covered[chunk.word_at[r] : chunk.word_at[r + 1]])
        texts.append(b" ".join(words))
    return pa.RecordBatch.from_arrays([ids, pa.array(chunk.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def dedup_substrings(docs: DataFrame, width: int = WIDTH, index: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of each row of ``docs``.

    Kept words are joined by one space.  ``index`` names a folder of earlier batches' runs,
    which is read as history and gets this batch's run; all of its batches must use one
    width.  Without it the documents are deduplicated among themselves.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = tasks(spark)
    cuts = ranges.bounds(rows, n)
    runs = rows.mapInArrow(_runs(cuts, n, width), _RUN)
    old = _old_runs(spark, index)
    if old is not None:
        if not _same_buckets(spark, index, n):
            raise ValueError(f"the index has other buckets than the {n} of spark.sql.shuffle.partitions")
        runs = runs.union(old)
    merged = ranges.dealt(runs, n, "bucket").sortWithinPartitions("bucket", "part").mapInArrow(_merge(index is not None), _RUN)
    merged = written(merged, "hits")
    if index is not None:
        _add_run(merged.where("part < 0"), index, n)

    lines = rows.select(ranges.part(cuts, F.col("doc_id")).alias("part"), F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("long").alias("first"), F.lit(None).cast("binary").alias("deltas"), F.lit(None).cast("binary").alias("checks"))
    hits = merged.where("part >= 0").select("part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "first", "deltas", "checks")
    return ranges.dealt(lines.union(hits), n, "part").sortWithinPartitions("part", "kind", "doc_id", "text").mapInArrow(_remove(width), "doc_id long, n_words long, n_removed long, kept_text string")


def _old_runs(spark: SparkSession, index: str | None) -> DataFrame | None:
    if index is None or not _exists(spark, index):
        return None
    return spark.read.schema(f"{_RUN}, buckets int").parquet(f"{index}/run-*").drop("buckets")


def _exists(spark: SparkSession, index: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{index}/run-*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return bool(found)


def _same_buckets(spark: SparkSession, index: str, n: int) -> bool:
    held = spark.read.schema(f"{_RUN}, buckets int").parquet(f"{index}/run-*").select("buckets").distinct().limit(2).collect()
    return [row.buckets for row in held] in ([], [n])


def _add_run(new: DataFrame, index: str, buckets: int) -> None:
    """Adds an immutable run; readers see it whole, as its folder is named when it is written."""
    new.withColumn("buckets", F.lit(buckets)).write.parquet(f"{index}/run-{uuid.uuid4().hex}")


def compact(spark: SparkSession, index: str, target: str) -> None:
    """Merges an index's runs into one run of the index folder ``target``."""
    n = spark.read.schema(f"{_RUN}, buckets int").parquet(f"{index}/run-*").agg(F.max("buckets")).head()[0]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in grouped(batches, "bucket"):
            run = np.unique(np.concatenate([unpack(r["first"], r["deltas"], r["checks"]) for r in rows]))
            yield rows_of([(bucket, -1, run)])

    old = _old_runs(spark, index)
    _add_run(old.repartition(tasks(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(merge, _RUN), target, n)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
with docs as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), starts as (
  select doc_id, w, unnest(range(1, len(w) - 18)) as p from docs where len(w) >= 20
), named as (
  select doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) as h from starts
), repeated as (
  select doc_id, p from (select doc_id, p, row_number() over (partition by h order by doc_id, p) as r from named) where r > 1
), covered as (
  select distinct doc_id, unnest(range(p, p + 20)) as p from repeated
), words as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from docs
), kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by p) as t from words anti join covered using (doc_id, p) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from docs d left join kept k using (doc_id)
"""
