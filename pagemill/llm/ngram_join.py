"""N-gram Jaccard join: universe partitioning by the pigeonhole principle, verified exactly.

A document's set holds the hashes of its distinct 5-word shingles.  Sets of sizes s <= t
with similarity 3/4 or more differ in at most ``(s + t) / 7`` elements, and t is at most
4/3 s, so sizes fall into bands whose sets only meet their own and the next band.

*Partition.*  A band cuts the hash universe into m segments, more than the largest allowed
difference H.  *Pigeonhole.*  If a set demands d_k of segment k and the demands sum to
H + 1, some segment differs in fewer than d_k elements: its subsets are equal (d_k = 1), or
equal after one deletion (d_k = 2).  The index holds every segment's subset, and the
one-deletion neighbours of some segments; a set probes with the cheapest demands
that sum to H + 1 (*cost-based allocation*): the cost of a subset is the estimated document
frequency of its rarest shingle, and empty subsets cost most.  Frequencies come from a count
sketch: signed sums over all shingles of all documents in a fixed number of cells.  Any
allocation is exact; estimates only steer cost.

*Short texts.*  Where a band has few segments a set may lack filled ones, and would have to
probe with empty ones that unrelated sets share.  Sets of under 114 shingles therefore get the
finest partition, each shingle a segment of its own: a partner lacks at most s/4 of them, so
one of any s/4 + 1 is held by it.  All are indexed, and the cheapest s/4 + 1 probe.  In larger
sets too few filled segments are five or more standard deviations away.

*Candidates.*  Subset hashes are grouped by value.  Small groups give their pairs; a large
group first gives a star around one member, and after these are verified only the pairs of
members outside its largest component, so a group of near copies never gives all of its
pairs.  Of these, one a document comes first, and the others only where their ends are still
in different components.  Candidates pass an exact bound (the difference of two sets is at least that of their
element counts in 128 cells of the universe) and are then verified on the words of whole
texts.

Defined cases: null texts and texts without words have empty sets and no links; 1-4 words
give one shingle, the whole sequence; equal sets are one class, linked through its least
doc_id; rows with a null doc_id are given back with their set's size and a null component,
and link nothing; rows of one doc_id
are versions of one document, in one component; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .ranges import dealt
from .storage import narrow, table, tasks, written
from .textscan import U, Chunk, chunks, mix

WORDS = 5
CELLS = 128
SINGLE = 13  # bands in which every shingle is a segment of its own
ZONE, CLOSE_ZONE = 16, 4  # every so many segments, one keeps its one-deletion neighbours
CLOSE = 16  # bands up to which they lie closer
SMALL_GROUP = 4
STAR = 256  # partners that one verification group holds
SKETCH = 1 << 20  # cells of the count sketch
PIECE = 2048  # of its cells that are one row
NOISE = 4  # times a cell's usual noise that an estimate must reach to count
TILE = 256  # members of a large group that one task compares with as many
_FLUSH = 1_000_000
_TOKEN = U(10)  # bits of a hash that make room for the row
_INDEX, _PROBE = 1, 2


def _bands(largest: int = 1 << 40) -> np.ndarray:
    """Least size of each band: a band [l, u] has u = floor(4 l / 3)."""
    low = [1]
    while low[-1] < largest:
        low.append(low[-1] * 4 // 3 + 1)
    return np.array(low, dtype=np.int64)


LOWS = _bands()
HIGHS = LOWS * 4 // 3
ALLOWED = 2 * HIGHS // 7
SEGMENTS = ALLOWED + 1 + (ALLOWED + 3) // 4


def sets(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of each distinct shingle, by row and token; tokens have 54 bits."""
    rows, found = chunk.windows(WORDS, whole=True)
    both = np.unique((rows.astype(U) << U(54)) | (found >> _TOKEN))
    return (both >> U(54)).astype(np.int64), both & U((1 << 54) - 1)


def class_ids(rows: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit name of each row's set, the same for equal sets; 0 for the empty set."""
    sums = np.zeros(n, dtype=U)
    at = np.flatnonzero(np.append(True, np.diff(rows) > 0)) if len(rows) else np.empty(0, int)
    if len(rows):
        sums[rows[at]] = mix(np.add.reduceat(mix(tokens, 31), at), 32)
    return sums.view(np.int64)


def _cell(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of the sketch that counts a token, and its sign there."""
    found = mix(tokens, 46)
    return (found >> U(64 - SKETCH.bit_length() + 1)).astype(np.int64), 1 - 2 * (found & U(1)).astype(np.int64)


def _pieces(sketch: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The pieces of a sketch that count something: their numbers, and cells as narrow as they may be."""
    cells = sketch.reshape(-1, PIECE)
    some = np.flatnonzero(cells.any(axis=1))
    return some, [cells[k].astype(np.result_type(np.min_scalar_type(cells[k].min()), np.min_scalar_type(-cells[k].max()))).tobytes() for k in some]


def _unpacked(cells: bytes) -> np.ndarray:
    return np.frombuffer(cells, dtype=f"i{len(cells) // PIECE}")


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a document, then this task's sketch: rows with a piece's number and its cells."""
    names = ["doc_id", "n_shingles", "class", "cells", "piece"]
    sketch = np.zeros(SKETCH, dtype=np.int64)
    for batch in batches:
        for chunk in chunks(batch.column(1), lower=True):
            n = chunk.hi - chunk.lo
            rows, tokens = sets(chunk)
            cell, sign = _cell(tokens)
            np.add.at(sketch, cell, sign)
            cells = np.bincount(rows * CELLS + (tokens >> U(47)).astype(np.int64), minlength=n * CELLS).reshape(n, CELLS)
            cells = np.minimum(cells, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(chunk.lo, n), pa.array(np.bincount(rows, minlength=n), pa.int64()),
                    pa.array(class_ids(rows, tokens, n)), pa.array([x.tobytes() for x in cells], pa.binary()), pa.nulls(n, pa.int32()),
                ],
                names,
            )
    some, cells = _pieces(sketch)
    if len(some):
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(cells, pa.binary()), pa.array(some, pa.int32())], names)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the (piece, cells) that a task reads; it holds one sketch."""
    sketch = np.zeros((SKETCH // PIECE, PIECE), dtype=np.int64)
    for batch in batches:
        for piece, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sketch[piece] += _unpacked(cells.as_buffer().to_pybytes())
    some, cells = _pieces(sketch)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(cells, pa.binary())], ["piece", "cells"])


def shingle_sketch(profiled: DataFrame) -> np.ndarray:
    """The count sketch of all documents, from the parts that ``_profiles`` gave.

    Parts are added in tasks, then piece by piece; the sums, SKETCH numbers, reach the driver.
    """
    schema = "piece int, cells binary"
    parts = profiled.where("piece is not null").select("piece", "cells").mapInArrow(_added, schema)
    found = parts.repartition(min(tasks(profiled.sparkSession), SKETCH // PIECE), "piece").mapInArrow(_added, schema).collect()
    sketch = np.zeros((SKETCH // PIECE, PIECE), dtype=np.int64)
    for row in found:
        sketch[row.piece] = _unpacked(row.cells)
    return sketch.ravel()


class Signatures:
    """Index and probe hashes of the sets of a chunk."""

    def __init__(self, sketch: np.ndarray) -> None:
        self.sketch = sketch
        self.least = NOISE * float(np.median(np.abs(sketch))) / 0.6745  # the median of a normal variable's size

    def costs(self, tokens: np.ndarray) -> np.ndarray:
        """Estimated document frequencies of tokens; those that don't stand out from the noise are 1."""
        cell, sign = _cell(tokens)
        found = self.sketch[cell] * sign
        return np.where(found > self.least, np.maximum(found, 1), 1)

    def of_band(self, sizes: np.ndarray, rows: np.ndarray, tokens: np.ndarray, band: np.ndarray, indexed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, hash, flags) of rows of ``sizes`` > 0 in the segments of ``band``, one a row."""
        n, m = len(sizes), SEGMENTS[band]
        need = (sizes + np.minimum(HIGHS[band], sizes * 4 // 3)) // 7 + 1
        first = np.append(0, np.cumsum(m))  # place of each row's segments
        segment = ((tokens >> U(22)) * m[rows].astype(U) >> U(32)).astype(np.int64)
        place = first[rows] + segment
        at = np.flatnonzero(np.append(True, np.diff(place) > 0))
        mixed = mix(tokens, 41)
        total = np.zeros(first[-1], dtype=U)
        held = np.zeros(first[-1], dtype=np.int64)
        cost = np.full(first[-1], 1 << 40, dtype=np.int64)  # of an empty segment
        token_cost = self.costs(tokens)
        total[place[at]] = np.add.reduceat(mixed, at)
        held[place[at]] = np.diff(np.append(at, len(place)))
        cost[place[at]] = np.minimum.reduceat(token_cost, at)

        row_of = np.repeat(np.arange(n), m)
        number = np.arange(first[-1]) - first[row_of]
        salt = mix(number.astype(U) * U(4096) + band[row_of].astype(U), 43)
        zone = number % np.where(band[row_of] < CLOSE, CLOSE_ZONE, ZONE) == 0
        wide = np.flatnonzero(zone & (held >= 2))  # may demand 2
        pricey = np.maximum(cost[wide] * (held[wide] + 1), 2)
        demand_row, demand_cost = np.append(row_of, row_of[wide]), np.append(cost, pricey)
        order = np.lexsort((demand_cost, demand_row))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(demand_row[order], demand_row[order])
        chosen = rank < need[demand_row]
        probe, double = chosen[: first[-1]], np.zeros(first[-1], dtype=bool)
        double[wide] = chosen[first[-1] :]
        probe |= double

        flags = np.where(probe, _PROBE, 0) | (_INDEX if indexed else 0)
        use = np.flatnonzero(flags)
        out = [(row_of[use], mix(total[use] + salt[use], 44), flags[use])]
        with_deletions = np.flatnonzero(double[place] | (zone[place] & (held[place] >= 3) & indexed))
        if len(with_deletions):  # tokens each of which is left out once
            p = place[with_deletions]
            f = np.where(double[p], _PROBE, 0) | np.where(zone[p] & (held[p] >= 3) & indexed, _INDEX, 0)
            out.append((row_of[p], mix(total[p] - mixed[with_deletions] + salt[p], 44), f))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def of_single(self, sizes: np.ndarray, rows: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same with every shingle indexed, the cheapest ones probing."""
        order = np.lexsort((tokens, self.costs(tokens), rows))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
        return rows, mix(tokens, 45), np.where(rank <= sizes[rows] // 4, _PROBE, 0) | _INDEX

    def of(self, sizes: np.ndarray, rows: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        band = np.searchsorted(LOWS, sizes, side="right") - 1
        single = band < SINGLE
        parts = [(single, 0), (~single, 0), ((sizes * 4 // 3 > HIGHS[band]) & (band + 1 >= SINGLE), 1)]
        found = []
        for which, after in parts:
            some = np.flatnonzero(which)
            if len(some):
                name = np.full(len(sizes), -1)
                name[some] = np.arange(len(some))
                use = name[rows] >= 0
                own = sizes[some], name[rows[use]], tokens[use]
                row, value, flags = self.of_single(*own) if single[some[0]] and not after else self.of_band(*own, band[some] + after, not after)
                found.append((some[row], value, flags))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_BLOB = "bucket int, classes binary, sizes binary, counts binary, low binary, high binary"
_BLOB_NAMES = ["bucket", "classes", "sizes", "counts", "low", "high"]


def _narrowed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0, as narrow as the largest allows; a reader tells the width from the length."""
    return numbers.astype(np.min_scalar_type(int(numbers.max()))).tobytes()


def _numbers(blobs: list[dict], name: str) -> np.ndarray:
    """A ``_narrowed`` column of some blobs, one number a class."""
    return np.concatenate([np.frombuffer(x[name], dtype=f"u{len(x[name]) * 8 // len(x['classes'])}").astype(np.int64) for x in blobs])


def _signatures(sketch: np.ndarray, buckets: int) -> Callable:
    """Packed hashes for each bucket: 38 bits and two flags each, in the order of their class."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Signatures(sketch), set()
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            name, size, row, found, flags = [], [], [], [], []
            for classes, sizes, r, h, f in held:
                row.append(r + sum(map(len, name)))
                name.append(classes)
                size.append(sizes)
                found.append(h)
                flags.append(f)
            name, size, row, found, flags = (np.concatenate(x) for x in (name, size, row, found, flags))
            bucket = ((found >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
            order = np.lexsort((row, bucket))
            bucket, row, found, flags = bucket[order], row[order], found[order], flags[order]
            low, high = found.astype(np.uint32), (((found >> U(32)) & U(63)).astype(np.uint8) << 2) | flags.astype(np.uint8)
            out, at = [], np.searchsorted(bucket, np.arange(buckets + 1))
            for b in range(buckets):
                i, j = at[b], at[b + 1]
                if i < j:
                    own, n = np.unique(row[i:j], return_counts=True)
                    out.append((b, name[own].tobytes(), _narrowed(size[own]), _narrowed(n), low[i:j].tobytes(), high[i:j].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(zip(*out, strict=True))], _BLOB_NAMES)

        for batch in batches:
            for chunk in chunks(batch.column(0), lower=True):
                n = chunk.hi - chunk.lo
                rows, tokens = sets(chunk)
                classes = class_ids(rows, tokens, n)
                fresh = np.zeros(n, dtype=bool)
                for r in np.flatnonzero(np.bincount(rows, minlength=n)):
                    if (c := int(classes[r])) not in seen:
                        seen.add(c)
                        fresh[r] = True
                if not fresh.any():
                    continue
                new = np.cumsum(fresh) - 1
                use = fresh[rows]
                rows, tokens = new[rows[use]], tokens[use]
                sizes = np.bincount(rows)
                found = make.of(sizes, rows, tokens)
                held.append((classes[fresh], sizes, *found))
                count += len(found[0])
                if count >= _FLUSH:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    return build


def _linkable(a: np.ndarray, b: np.ndarray, fa: np.ndarray, fb: np.ndarray) -> np.ndarray:
    """Sizes allow a link, and one side probes what the other has indexed."""
    return (4 * np.minimum(a, b) >= 3 * np.maximum(a, b)) & (((fa & _PROBE) > 0) & ((fb & _INDEX) > 0) | ((fb & _PROBE) > 0) & ((fa & _INDEX) > 0))


def _may_link(size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Of a group's members, those that probe or whose size lets some member that probes link with them."""
    probes = np.sort(size[(flags & _PROBE) > 0])
    near = np.searchsorted(probes, size * 4 // 3, side="right") > np.searchsorted(probes, -(-size * 3 // 4))
    return near | ((flags & _PROBE) > 0)


_FOUND = "kind int, a long, b long, size int, flags int"  # kind 0: a pair; 1: member b of group a


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of equal hashes in each bucket: pairs, stars, and members of large groups."""

    def out(kind: int, a: np.ndarray, b: np.ndarray, size: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(size, pa.int32()), pa.array(flags, pa.int32())], ["kind", "a", "b", "size", "flags"])

    def joined(blobs: list[dict]) -> Iterator[pa.RecordBatch]:
        classes = np.frombuffer(b"".join(x["classes"] for x in blobs), np.int64)
        sizes, counts = _numbers(blobs, "sizes"), _numbers(blobs, "counts")
        high = np.frombuffer(b"".join(x["high"] for x in blobs), np.uint8)
        found = (high >> 2).astype(U) << U(32) | np.frombuffer(b"".join(x["low"] for x in blobs), np.uint32)
        order = np.argsort(found)
        found = found[order]
        same = found[1:] == found[:-1]
        multiple = np.append(same, False) | np.append(False, same)
        found, order = found[multiple], order[multiple]
        which = np.searchsorted(np.cumsum(counts), order, side="right")
        owner, size, flags = classes[which], sizes[which], (high[order] & 3).astype(np.int64)
        order = np.lexsort((owner, found))  # one class comes once, with all its flags
        found, owner, size, flags = found[order], owner[order], size[order], flags[order]
        first = np.flatnonzero(np.append(True, (np.diff(found) != 0) | (np.diff(owner) != 0))) if len(found) else np.empty(0, int)
        if len(first):
            flags = np.bitwise_or.reduceat(flags, first)
        found, owner, size = found[first], owner[first], size[first]
        at = np.flatnonzero(np.append(True, np.diff(found) != 0)) if len(found) else np.empty(0, int)
        length = np.diff(np.append(at, len(found)))
        probed = np.add.reduceat((flags & _PROBE) > 0, at) > 0 if len(at) else np.empty(0, bool)
        indexed = np.add.reduceat((flags & _INDEX) > 0, at) > 0 if len(at) else np.empty(0, bool)
        pairs = []
        for gap in range(1, SMALL_GROUP):  # pairs of small groups
            use = at[(length > gap) & (length <= SMALL_GROUP) & probed & indexed]
            for k in range(SMALL_GROUP - gap):
                i = use[k + gap < length[np.searchsorted(at, use)]] + k
                pairs.append((i, i + gap))
        large = np.flatnonzero((length > SMALL_GROUP) & probed & indexed)
        for g in large:
            members = np.arange(at[g], at[g] + length[g])
            pairs.append((np.full(len(members) - 1, members[0]), members[1:]))
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, int), np.empty(0, int))
        use = _linkable(size[i], size[j], flags[i], flags[j])
        i, j = i[use], j[use]
        a, b = np.minimum(owner[i], owner[j]), np.maximum(owner[i], owner[j])
        if len(a):
            order = np.lexsort((b, a))
            keep = np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0))
            a, b = a[order][keep], b[order][keep]
            yield out(0, a, b, np.zeros(len(a)), np.zeros(len(a)))
        known = set()
        for g in large:
            s = slice(at[g], at[g] + length[g])
            s = np.arange(s.start, s.stop)[_may_link(size[s], flags[s])]
            if len(s) < 2:
                continue
            name = int(mix(np.array([np.add.reduce(mix(owner[s].view(U) * U(4) + flags[s].astype(U), 7))], dtype=U), 8).view(np.int64)[0])
            if name not in known:
                known.add(name)
                yield out(1, np.full(len(s), name), owner[s], size[s], flags[s])

    now, blobs = None, []
    for batch in batches:
        for blob in batch.to_pylist():
            if blob["bucket"] != now and blobs:
                yield from joined(blobs)
                blobs = []
            now = blob["bucket"]
            blobs.append(blob)
    if blobs:
        yield from joined(blobs)


def _far_apart(a: pa.Array, b: pa.Array, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether the counts in the cells alone rule a link out."""
    cells = [np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for x in (a, b)]
    return 7 * np.abs(cells[0] - cells[1]).sum(axis=1, dtype=np.int64) > s + t


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            s, t = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = ~_far_apart(batch.column(4), batch.column(5), s, t)
            yield batch.select([0, 1]).filter(pa.array(keep))


def shingle_words(text: bytes) -> set[bytes]:
    """The shingles of a text as words, A-Z in lower case."""
    words = text.lower().split()
    if len(words) < WORDS:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[k : k + WORDS]) for k in range(len(words) - WORDS + 1)}


def similar(common: int, a: int, b: int) -> bool:
    return 100 * common >= 75 * (a + b - common)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are (a, chunk, kind, doc, class, text), each chunk's first rows being a's own texts.

    Hashes that share clearly too little rule a pair out; every link is decided on words.
    """
    now, centers = None, []  # (tokens, text, shingles once they are needed)
    for batch in batches:
        linked = []
        for chunk in chunks(batch.column(5), lower=True):
            n = chunk.hi - chunk.lo
            rows, tokens = sets(chunk)
            classes = class_ids(rows, tokens, n)
            at = np.searchsorted(rows, np.arange(n + 1))
            part = batch.slice(chunk.lo, n)
            for r, (a, piece, kind, doc, name) in enumerate(zip(*(part.column(k).to_pylist() for k in range(5)), strict=True)):
                if classes[r] != name:
                    continue  # another text of a repeated doc_id
                if now != (a, piece):
                    now, centers = (a, piece), []
                own, text = tokens[at[r] : at[r + 1]], chunk.data[chunk.row_at[r] : chunk.row_at[r + 1]].tobytes()
                if kind == 0:
                    centers.append([own, text, None])
                    continue
                words = None
                for center in centers:
                    common = len(np.intersect1d(center[0], own, assume_unique=True))
                    if similar(common + 2, len(center[0]) + 2, len(own) + 2):
                        center[2] = shingle_words(center[1]) if center[2] is None else center[2]
                        words = shingle_words(text) if words is None else words
                        if similar(len(center[2] & words), len(center[2]), len(words)):
                            linked.append((a, doc))
                            break
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in linked], pa.int64()) for k in (0, 1)], ["a", "b"])


_MEMBER = ["anchor", "i", "j", "group", "tile", "rep", "size", "flags", "component", "cells"]


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of members of different components, of tiles i and j of a group, within the bound.

    Groups of one anchor follow one another, and a pair that they share is given once.
    """
    known: list[np.ndarray] = []

    def pairs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        both = pa.Table.from_batches(held).combine_chunks()
        i, j = both.column(1)[0].as_py(), both.column(2)[0].as_py()
        tile, rep, size, flags, component = (both.column(k).to_numpy() for k in range(4, 9))
        cells = np.frombuffer(b"".join(both.column(9).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
        left = np.flatnonzero(tile == i)
        right = left if i == j else np.flatnonzero(tile == j)
        out = []
        for n, x in enumerate(left):
            y = right[n + 1 :] if i == j else right
            y = y[(component[y] != component[x]) & _linkable(size[y], size[x], flags[y], flags[x])]
            if len(y):
                y = y[7 * np.abs(cells[y] - cells[x]).sum(axis=1, dtype=np.int64) <= size[y] + size[x]]
                out.append(np.stack([np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])], axis=1))
        found = np.concatenate([*known, *out]) if out or known else np.empty((0, 2), np.int64)
        fresh = np.zeros(len(found), dtype=bool)
        fresh[sum(map(len, known)) :] = True
        order = np.lexsort((fresh, found[:, 1], found[:, 0]))
        found, fresh = found[order], fresh[order]
        first = np.append(True, (np.diff(found, axis=0) != 0).any(axis=1))[: len(found)]
        known[:] = [found[first]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[first & fresh, k]), pa.int64()) for k in (0, 1)], ["a", "b"])

    now, held = None, []
    for batch in batches:
        keys = [batch.column(k).to_numpy() for k in range(4)]
        change = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1 if batch.num_rows > 1 else []
        for lo, hi in zip([0, *change], [*change, batch.num_rows], strict=True) if batch.num_rows else []:
            key = tuple(int(k[lo]) for k in keys)
            if key != now and held:
                yield pairs(held)
                held = []
            if now and key[:3] != now[:3]:
                known.clear()
            now = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pairs(held)


def _within(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of candidate pairs of classes, those within the bound, as least doc_ids."""
    left = classes.select(F.col("class").alias("a"), F.col("rep").alias("rep_a"), F.col("n_shingles").alias("s"), F.col("cells").alias("cells_a"))
    right = classes.select(F.col("class").alias("b"), F.col("rep").alias("rep_b"), F.col("n_shingles").alias("t"), F.col("cells").alias("cells_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select(F.least("rep_a", "rep_b"), F.greatest("rep_a", "rep_b"), "s", "t", "cells_a", "cells_b").mapInArrow(_near, "a long, b long")


def _links(near: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (a, b) of candidate pairs of least doc_ids."""
    n = tasks(near.sparkSession)
    counted = near.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("pieces"))
    star = near.join(counted, "a").select("a", F.pmod(F.xxhash64("b"), "pieces").cast("int").alias("piece"), "b")
    members = star.select("a", "piece", F.lit(1).alias("kind"), F.col("b").alias("doc")).union(star.select("a", "piece").distinct().select("a", "piece", F.lit(0), "a"))
    members = members.join(texts, "doc").select("a", "piece", "kind", "doc", "class", "text")
    members = members.repartition(n, "a", "piece").sortWithinPartitions("a", "piece", "kind")
    return members.mapInArrow(_verify, "a long, b long")


def _rest(groups: DataFrame, components_of: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidate pairs (least doc_ids) of large groups across the components found so far.

    Groups of one family share its largest component, so the least component of a group
    anchors it: groups of one anchor meet in the same tasks, where repeated pairs end.  The
    members outside a group's largest component are cut into tiles, and so are those inside
    it, which only meet the others: a tile of each goes to one task.
    """
    n = tasks(groups.sparkSession)
    named = classes.select("class", "rep").join(components_of.withColumnRenamed("vertex", "rep"), "rep", "left")
    placed = groups.join(named.select("class", "rep", F.coalesce("component", "rep").alias("component")), "class")
    parts = placed.groupBy("group", "component").agg(F.count("*").alias("n"))
    split = parts.groupBy("group").agg(
        F.min("component").alias("anchor"), F.max(F.struct("n", "component"))["component"].alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")
    ).where("n > most")
    tiles = split.groupBy("anchor").agg(F.ceil(F.max(F.col("n") - F.col("most")) / TILE).cast("int").alias("tiles"), F.ceil(F.max("most") / TILE).cast("int").alias("main_tiles"))
    tiled = placed.join(split.join(tiles, "anchor").select("group", "anchor", "main", "tiles", "main_tiles"), "group")
    is_main = F.col("component") == F.col("main")
    spread = F.xxhash64("class")
    tiled = tiled.withColumn("tile", F.when(is_main, F.col("tiles") + F.pmod(spread, "main_tiles")).otherwise(F.pmod(spread, "tiles")).cast("int"))
    last = F.when(is_main, F.col("tiles")).otherwise(F.col("tiles") + F.col("main_tiles")) - 1
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    tiled = tiled.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")).join(classes.select("class", "cells"), "class")
    dealt_out = tiled.select(*_MEMBER).repartition(n, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "group")
    return written(narrow(dealt_out.mapInArrow(_across, "a long, b long").distinct()), "across")


def _first_of_each(pairs: DataFrame) -> DataFrame:
    """One pair of each document that is in some: a pair with its least partner above it, and one with that below."""
    above, below = pairs.groupBy("a").agg(F.min("b").alias("b")), pairs.groupBy("b").agg(F.min("a").alias("a"))
    return above.unionByName(below).distinct()


def _apart(pairs: DataFrame, components_of: DataFrame) -> DataFrame:
    """Pairs of different components; a link within one would change nothing."""
    of = lambda end: components_of.select(F.col("vertex").alias(end), F.col("component").alias(f"of_{end}"))
    placed = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return placed.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def profiles(docs: DataFrame) -> DataFrame:
    """Of each row its set's size, name and counts in cells; rows with a piece are parts of the sketch."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_profiles, "doc_id long, n_shingles long, class long, cells binary, piece int")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``."""
    n = tasks(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    profiled = written(narrow(profiles(docs)), "profiles")
    profile = profiled.where("piece is null").drop("piece")
    known = profile.where("n_shingles > 0 and doc_id is not null")
    classes = written(narrow(known.groupBy("class", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("cells").alias("cells"))), "classes")
    blobs = rows.where("doc_id is not null").select("text").mapInArrow(_signatures(shingle_sketch(profiled), n), _BLOB)
    found = written(narrow(dealt(blobs, n, "bucket").sortWithinPartitions("bucket").mapInArrow(_match, _FOUND)), "candidates")

    tried = written(narrow(_within(found.where("kind = 0").select("a", "b").distinct(), classes)), "pairs")
    groups = found.where("kind = 1").select(F.col("a").alias("group"), F.col("b").alias("class"), "size", "flags").distinct()
    whole = classes.select(F.col("rep").alias("doc"), "class")
    wanted = tried.select(F.col("a").alias("doc")).union(tried.select("b")).union(groups.select("class").distinct().join(whole, "class").select("doc"))
    texts = rows.select(F.col("doc_id").alias("doc"), "text").repartition(n, "doc").join(wanted.distinct().join(whole, "doc"), "doc")
    texts = texts.persist(StorageLevel.DISK_ONLY)  # unlike a written table it stays dealt by doc, so that neither round moves it again
    versions = known.groupBy("doc_id").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("doc_id")
    own = known.join(versions, "doc_id").join(classes.select("class", "rep"), "class").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = written(narrow(_links(tried, texts).union(own)), "links")
    near = components(links)
    rest = written(narrow(_rest(groups, near, classes).join(tried, ["a", "b"], "left_anti")), "rest")
    if rest.limit(1).count():
        first = written(narrow(_first_of_each(rest)), "first")
        links = links.union(written(narrow(_links(first, texts)), "links"))
        near = components(links)
        rest = written(narrow(_apart(rest.join(first, ["a", "b"], "left_anti"), near)), "apart")
        if rest.limit(1).count():
            near = components(links.union(written(narrow(_links(rest, texts)), "links")))
    texts.unpersist()
    found = profile.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class")).alias("class"))
    found = found.join(classes.select("class", "rep"), "class", "left").join(near.withColumnRenamed("vertex", "rep"), "rep", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
with recursive docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select distinct doc_id, sh from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) end) as sh from docs)
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as i from shingles a join shingles b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)
), reach as (
  select doc_id as v, doc_id as r from docs
  union
  select links.b, reach.r from reach join links on links.a = reach.v
)
select d.doc_id, cast(coalesce(s.n, 0) as bigint) as n_shingles, c.component_id
from docs d left join sizes s using (doc_id) join (select v, min(r) as component_id from reach group by v) c on c.v = d.doc_id
"""
