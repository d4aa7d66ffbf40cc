"""Line dedup by pairwise alignment.

Lines without words are left out of all that follows, and a line weighs as much as it has
words.  Anchors are hashes of the shortest runs of consecutive lines that weigh LENGTH or
more, forward from each line and backward from it.  An anchor pairs every later holder with
its first holder, so pairs grow with holders, not with their square.  Each pair's lines are
aligned by patience diff, and an aligned block (lines that follow one another in both) that
weighs enough is deleted from the later document.

A line of a block that two documents share lies in some run that both hold: forward from the
line, backward from it, or forward from the block's first line.  So the document is aligned
with an earlier holder of each run of the block, however many documents hold it and whatever
else they hold.  A block that stands in another order than the rest of its pair's shared
lines is not aligned and stays.  The first holder of a line never loses it.

A group of pairs is one first holder and up to STAR later ones, so a template that any share
of the documents copy is dealt over many tasks; a task holds one document's lines and streams
the later ones.  Deletions of a document are joined as bit masks, one at a time.

Defined cases: a null text has no lines and stays null; an empty text has one empty line;
lines end at a line feed only; a line without words goes if the lines with words around it
both go, and stays at either end; documents without a doc_id are kept whole and nothing is
compared with them; rows of one doc_id are versions of one document, which don't delete
from each other; an empty table gives an empty table; other columns pass through, and a
column named as one of the added ones is replaced by it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mixing import WORD
from .storage import table, tasks, written
from .textscan import U, mix

LENGTH = 10  # words of a block that is deleted, or eight characters for each where words are rare
STAR = 256  # later documents that one group of pairs holds
_SLICE = 512  # documents whose runs are hashed at a time


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) of lines that a patience diff aligns, in order.

    Where no line occurs once on both sides, equal lines are told apart by how often they
    have come before.
    """
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            found.append((m, n))
        if i >= m or j >= n:
            continue
        once_a, once_b = Counter(a[i:m]), Counter(b[j:n])
        place = {x: k for k, x in enumerate(b[j:n], j) if once_b[x] == 1}
        common = [(k, place[x]) for k, x in enumerate(a[i:m], i) if once_a[x] == 1 and x in place]
        if not common:
            place = {x: k for k, x in enumerate(_numbered(b[j:n]), j)}
            common = [(k, place[x]) for k, x in enumerate(_numbered(a[i:m]), i) if x in place]
        chain = _increasing(common)
        for (p, q), (s, t) in zip([(i - 1, j - 1), *chain], [*chain, (m, n)], strict=True):
            if chain and s > p + 1 and t > q + 1:
                todo.append((p + 1, s, q + 1, t))
        found += chain
    return sorted(found)


def _numbered(lines: list[int]) -> list[tuple[int, int]]:
    seen: Counter[int] = Counter()
    out = []
    for x in lines:
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, not necessarily adjacent, that rises in both places."""
    tops: list[int] = []
    top_of: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(top_of[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            top_of.append(k)
        else:
            tops[pile], top_of[pile] = j, k
    out, k = [], top_of[-1] if top_of else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def bounds(weights: list[int], least: int) -> list[tuple[int, int]]:
    """(start, end) of the shortest runs of weight ``least`` forward and backward from each line."""
    total, n, out = [0, *accumulate(weights)], len(weights), set()
    i = j = 0
    for start in range(n):
        while j < n and total[j] - total[start] < least:
            j += 1
        if total[j] - total[start] >= least:
            out.add((start, j))
    for end in range(1, n + 1):
        while total[end] - total[i + 1] >= least:
            i += 1
        if total[end] - total[i] >= least:
            out.add((i, end))
    return sorted(out)


def deleted(earlier: list[int], later: list[int], weights: list[int], least: int) -> set[int]:
    """Places in ``later`` of its lines in aligned blocks of weight ``least`` or more."""
    out: set[int] = set()
    block: list[int] = []
    before = (-2, -2)
    for i, j in [*patience(earlier, later), (-2, -2)]:
        if (i, j) != (before[0] + 1, before[1] + 1) or i < 0:
            if sum(weights[k] for k in block) >= least:
                out.update(block)
            block = []
        block.append(j)
        before = (i, j)
    return out


def runs(lines: np.ndarray, weights: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct runs, as ``bounds`` gives them; all weights are above 0."""
    row, total = np.repeat(np.arange(len(at) - 1), np.diff(at)), np.append(0, np.cumsum(weights))
    place = np.arange(len(lines))
    forward, backward = np.searchsorted(total, total[:-1] + least), np.searchsorted(total, total[1:] - least, side="right") - 1
    start, end, row = np.append(place, backward), np.append(forward, place + 1), np.append(row, row)
    whole = (start >= at[:-1][row]) & (end <= at[1:][row])
    start, end, row = start[whole], end[whole], row[whole]
    found, live = np.zeros(len(start), dtype=U), np.arange(len(start))
    now = start.copy()
    with np.errstate(over="ignore"):
        while len(live):  # at most ``least`` lines make a run
            found[live] = mix(found[live] * U(0x9E3779B97F4A7C15) + lines[now[live]].view(U), 51)
            now[live] += 1
            live = live[now[live] < end[live]]
    order = np.lexsort((found, row))
    row, found = row[order], found[order].view(np.int64)
    once = np.append(True, (np.diff(row) != 0) | (found[1:] != found[:-1]))[: len(row)]
    return row[once], found[once]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a few, so that few texts or lists of lines are Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            yield batch.slice(lo, 64)


def _anchors(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _SLICE):
                part = batch.slice(lo, _SLICE)
                lines, weights = (part.column(k).flatten().to_numpy() for k in (1, 2))
                at = np.append(0, np.cumsum(part.column(1).value_lengths().to_numpy()))
                full = weights > 0
                at = np.append(0, np.cumsum(full))[at]
                row, found = runs(lines[full], weights[full].astype(np.int64), at, least)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(found)], ["doc", "run"])

    return run


def _align(least: int):
    """Rows are (first, piece, kind, doc, version, lines, weights), the first holder's versions first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, []
        for batch in _slices(batches):
            docs, versions, masks = [], [], []
            for first, piece, kind, doc, version, lines, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (first, piece) != now:
                    now, sides = (first, piece), []
                full = [k for k, w in enumerate(weights) if w > 0]
                own, heavy = [lines[k] for k in full], [weights[k] for k in full]
                if kind == 0:
                    sides.append(own)
                    continue
                gone = set().union(*(deleted(side, own, heavy, least) for side in sides))
                if gone:
                    mask = np.zeros(len(lines), dtype=bool)
                    mask[[full[k] for k in gone]] = True
                    docs.append(doc)
                    versions.append(version)
                    masks.append(np.packbits(mask).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(versions, pa.int64()), pa.array(masks, pa.binary())], ["doc", "version", "mask"])

    return run


def _whole_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One mask of each version of a document, from those of its pairs, which follow one another."""

    def out(key: tuple[int, int], mask: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([mask.tobytes()], pa.binary())], ["line_doc", "line_version", "line_bits"])

    now, mask = None, np.empty(0, np.uint8)
    for batch in batches:
        for doc, version, bits in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            own = np.frombuffer(bits, np.uint8)
            if (doc, version) == now:
                mask = mask | own
                continue
            if now:
                yield out(now, mask)
            now, mask = (doc, version), own
    if now:
        yield out(now, mask)


def _kept_texts(text: int, names: list[str]):
    """Adds the kept text and the counts, from the mask in the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            kept, n, gone = batch.column(text).to_pylist(), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for r, (own, bits) in enumerate(zip(kept, batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                if own is None:
                    continue
                n[r] = own.count("\n") + 1
                if bits is None:
                    continue
                lines = own.split("\n")
                mask = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(lines)).astype(bool)
                mask = _with_blanks(mask, [bool(_weighs(x)) for x in lines])
                kept[r], gone[r] = "\n".join(x for x, m in zip(lines, mask, strict=True) if not m), mask.sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kept, pa.string()), pa.array(n), pa.array(gone)], [*names, *ADDED])

    return run


def _with_blanks(mask: np.ndarray, full: list[bool]) -> np.ndarray:
    """The mask, with each stretch of lines without weight whose neighbours on both sides go."""
    place = np.flatnonzero(full)
    at = np.searchsorted(place, np.arange(len(mask)))
    inner = (at > 0) & (at < len(place)) & ~np.array(full, dtype=bool)
    out = mask.copy()
    out[inner] = mask[place[at[inner] - 1]] & mask[place[at[inner]]]
    return out


ADDED = ["kept_text", "n_lines", "n_removed"]
_WORDS = re.compile(WORD)


def _weighs(line: str) -> bool:
    return len(line) >= 8 or _WORDS.search(line) is not None


def line_hashes(docs: DataFrame) -> DataFrame:
    """(doc, version, lines, weights) of documents with an id and a text."""
    lines = "split(text, '\\n', -1)"
    return docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("version"),
        F.expr(f"transform({lines}, x -> xxhash64(x))").alias("lines"),
        F.expr(f"transform({lines}, x -> cast(greatest(regexp_count(x, r'{WORD}'), length(x) div 8) as int))").alias("weights"),
    )


def pairs(hashed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, first): each later holder of a run with the run's first holder."""
    held = hashed.select("doc", "lines", "weights").mapInArrow(_anchors(length), "doc long, run long")
    shared = held.groupBy("run").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    return held.join(shared.select("run", "first"), "run").where("first < doc").select("doc", "first").distinct()


def dedup_lines(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_removed`` added."""
    n = tasks(docs.sparkSession)
    docs = docs.drop(*ADDED)
    hashed = written(line_hashes(docs), "lines")
    found = written(pairs(hashed, length), "pairs")
    counted = found.groupBy("first").agg(F.ceil(F.count("*") / STAR).cast("int").alias("pieces"))
    star = found.join(counted, "first").select("first", F.pmod(F.xxhash64("doc"), "pieces").cast("int").alias("piece"), F.lit(1).alias("kind"), "doc")
    members = star.union(star.select("first", "piece", F.lit(0), F.col("first")).distinct()).join(hashed, "doc")
    members = members.select("first", "piece", "kind", "doc", "version", "lines", "weights").repartition(n, "first", "piece").sortWithinPartitions("first", "piece", "kind")
    masks = members.mapInArrow(_align(length), "doc long, version long, mask binary")
    masks = masks.repartition(n, "doc").sortWithinPartitions("doc", "version").mapInArrow(_whole_masks, "line_doc long, line_version long, line_bits binary")
    columns = docs.columns
    left = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("line_doc"), F.xxhash64("text").alias("line_version"))
    out = left.join(masks, ["line_doc", "line_version"], "left").select(*[F.col("row")[c].alias(c) for c in columns], "line_bits")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in zip(ADDED, (T.StringType(), T.LongType(), T.LongType()), strict=True))])
    return out.mapInArrow(_kept_texts(columns.index("text"), columns), schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
