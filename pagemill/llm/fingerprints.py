"""Document fingerprints: one-permutation MinHash with optimal densification.

One hash of each shingle gives its bin (top bits) and its value (the rest); a bin keeps its
least value.  An empty bin i copies the first non-empty bin in a probing order drawn from i
alone, so two documents that probe alike copy alike and bins agree with probability equal
to the Jaccard similarity.  The low bits of each bin, hashed once more with the bin's own
seed so that copies in several bins don't agree by one chance, are packed; chance agreement of those
bits is subtracted when two fingerprints are compared.

Defined cases: a null text is empty; a text of 1-4 words has its whole sequence as its one
shingle; a text without words has the empty fingerprint, which is like itself (1) and
unlike all others (0); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges
from .storage import table, tasks
from .textscan import U, Chunk, buffers, chunks, code_points, mix, scan

WORDS = 5
BINS = 512  # a power of two
BITS = 4
_ATTEMPTS = 2048
_EMPTY = U(0xFFFFFFFFFFFFFFFF)
_SHIFT = U(64 - (BINS.bit_length() - 1))


def _probes(attempts: np.ndarray) -> np.ndarray:
    """The bin that each empty bin (column) tries at each attempt (row)."""
    return (mix(attempts.astype(U)[:, None] * U(BINS) + np.arange(BINS, dtype=U)[None, :], 5) >> _SHIFT).astype(np.int32)


_TABLE = _probes(np.arange(_ATTEMPTS))
_OWN = mix(np.arange(BINS, dtype=U), 9)


def densify(bins: np.ndarray) -> np.ndarray:
    """Fills empty bins of each row that has a full one; ``bins`` is changed and returned."""
    full = bins != _EMPTY
    for row in np.flatnonzero(full.any(axis=1) & ~full.all(axis=1)):
        own, empty, begin = full[row], np.flatnonzero(~full[row]), 0
        step = max(4, 2 * BINS // int(own.sum()))
        while len(empty):
            tries = _TABLE[begin : begin + step] if begin + step <= _ATTEMPTS else _probes(np.arange(begin, begin + step))
            hit = own[tries[:, empty]]
            found = hit.any(axis=0)
            first = hit.argmax(axis=0)[found]
            bins[row, empty[found]] = bins[row, tries[first, empty[found]]]
            empty, begin = empty[~found], begin + step
    return bins


def signatures(chunk: Chunk, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(packed bits of each row, whether the row has a shingle)."""
    n = chunk.hi - chunk.lo
    rows, found = chunk.windows(words, whole=True)
    bins = np.full(n * BINS, _EMPTY, dtype=U)
    np.minimum.at(bins, rows * BINS + (found >> _SHIFT).astype(np.int64), found & ~(_EMPTY << _SHIFT))
    bins = densify(bins.reshape(n, BINS))
    low = (mix(bins + _OWN[None, :]) & U((1 << BITS) - 1)).astype(np.uint8)
    return (low[:, 0::2] << 4) | low[:, 1::2], chunk.counts > 0


def likeness(a: np.ndarray, a_any: np.ndarray, b: np.ndarray, b_any: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of packed bits, corrected for chance."""
    different = a ^ b
    agree = ((different & 0xF0) == 0).sum(axis=1) + ((different & 0x0F) == 0).sum(axis=1)
    chance = 2.0**-BITS
    found = np.clip((agree / BINS - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_any & b_any, found, (~a_any & ~b_any).astype(float))


def as_text(packed: np.ndarray, some: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes().hex() if s else "" for row, s in zip(packed, some, strict=True)], pa.string())


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(1)):
            packed, some = signatures(chunk)
            ids = batch.column(0).slice(chunk.lo, chunk.hi - chunk.lo)
            yield pa.RecordBatch.from_arrays([ids, as_text(packed, some)], ["doc_id", "fingerprint"])


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) of each row of ``docs``; no row moves."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_plain, "doc_id long, fingerprint string")


def _heads(data: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that begin a code point, and how many come before each row."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    return np.append(at, len(data)), np.searchsorted(at, row_at)


def _edited(own: Chunk, n: np.ndarray, following: Chunk, following_n: np.ndarray) -> list[bytes]:
    """Each row with its last floor(n/2) code points replaced by the first of its follower."""
    heads, first = _heads(own.data, own.row_at)
    f_heads, f_first = _heads(following.data, following.row_at)
    keep = heads[first[:-1] + n - n // 2]
    take = f_heads[f_first[:-1] + np.minimum(n // 2, following_n)]
    a, b = own.data.tobytes(), following.data.tobytes()
    return [a[i:j] + b[k:m] for i, j, k, m in zip(own.row_at[:-1], keep, following.row_at[:-1], take, strict=True)]


def _compare() -> Callable:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows_of(ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        """For all rows but the last, which only follows."""
        packed, some = (np.concatenate(x) for x in zip(*(signatures(c) for c in chunks(texts)), strict=True))
        for own in chunks(texts.slice(0, len(texts) - 1)):
            lo, hi = own.lo, own.hi
            offsets, data = buffers(texts.slice(lo + 1, hi - lo))
            following = scan(data[offsets[0] : offsets[-1]], offsets - offsets[0], lo, hi, False)
            n, following_n = code_points(own.data, own.row_at), code_points(following.data, following.row_at)
            edited = _edited(own, n, following, following_n)
            blob, at = np.frombuffer(b"".join(edited), dtype=np.uint8), np.append(0, np.cumsum([len(x) for x in edited]))
            e_packed, e_some = signatures(scan(blob, at, lo, hi, False))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
                    as_text(packed[lo:hi], some[lo:hi]), as_text(e_packed, e_some),
                    pa.array(likeness(packed[lo:hi], some[lo:hi], e_packed, e_some)),
                    pa.array(likeness(packed[lo:hi], some[lo:hi], packed[lo + 1 : hi + 1], some[lo + 1 : hi + 1])),
                ],
                names,
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held_ids, held_texts = None, None, None
        for batch in batches:
            parts = batch.column(0).to_numpy()
            for lo in [0, *(np.flatnonzero(np.diff(parts)) + 1)] if batch.num_rows else []:
                n = int((parts[lo:] == parts[lo]).sum())
                ids, texts = batch.column(2).slice(lo, n), pc.fill_null(batch.column(3).slice(lo, n), "")
                if part == parts[lo]:
                    ids, texts = pa.concat_arrays([held_ids, ids]), pa.concat_arrays([held_texts, texts])
                part = parts[lo]
                if len(ids) > 1:
                    yield from rows_of(ids, texts)
                held_ids, held_texts = ids.slice(len(ids) - 1), pa.concat_arrays([texts.slice(len(texts) - 1)])

    return compare


def compare_edited(docs: DataFrame) -> DataFrame:
    """The fingerprint of each document, of its edited text, and their likeness.

    The next document is the one of the next doc_id; nulls come first, rows of one doc_id
    follow one another by text, and the first document follows the last.  Documents are
    dealt by ranges of doc_id, and each range also gets the first document of the next.
    """
    spark, n = docs.sparkSession, tasks(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = ranges.bounds(rows, n)
    found = rows.select(ranges.part(cuts, F.col("doc_id")).alias("part"), F.coalesce("doc_id", F.lit(ranges.FIRST)).alias("place"))
    firsts = sorted(tuple(r) for r in found.groupBy("part").agg(F.min("place")).collect())  # one row a part
    ends = [(firsts[i - 1][0], first) for i, (_, first) in enumerate(firsts)]
    place = F.coalesce("doc_id", F.lit(ranges.FIRST))
    heads = rows.where(place.isin([first for _, first in ends])).groupBy(place.alias("place")).agg(F.min("text").alias("text"))
    tails = heads.join(spark.createDataFrame(ends, "part int, place long"), "place")
    both = rows.select(ranges.part(cuts, F.col("doc_id")).alias("part"), F.lit(0).alias("kind"), "doc_id", "text").union(tails.select("part", F.lit(1), F.lit(None).cast("long"), "text"))
    return ranges.dealt(both, n, "part").sortWithinPartitions("part", "kind", "doc_id", "text").mapInArrow(
        _compare(), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
