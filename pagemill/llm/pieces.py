"""SentencePiece encoding and decoding: forward filtering, backward sampling.

Text is read as bytes with a space put before it and spaces standing for the vocabulary's
word mark; a byte that no piece holds is its byte piece, so everything can be encoded and
decoding gives back the very text.  Pieces never cross the start of a run of spaces, so the
lattice falls into segments.  Forward filtering sums, at every byte of each distinct
segment, the weights of all segmentations that end there; backward sampling then draws the
last piece, the one before it, and so on, each with its exact share of those sums.

Draws are hashes of (seed, row key, segment number in the row, step), so a row gets one
segmentation whatever its partition, batch or neighbours, and repeated texts under other
keys get draws of their own.  A piece's weight falls with its rank in the vocabulary as
``(rank + 2) ** -alpha``; a byte piece that stands for no character has BYTE of that.

Defined cases: a null text has null pieces and decodes to null; an empty text has none; a
null key draws as key 0; rows with one key and text agree; an empty table gives an empty
table; other columns are ignored.  Memory is bounded by a chunk or the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table
from .textscan import U, buffers, mix, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
BYTE = 1e-9
SEED = 1
_CHUNK = 1 << 20
_MARK = "▁"
_STEP = U(0x9E3779B97F4A7C15)
_CODE = mix(np.arange(1, 257, dtype=U), 23)
_BASE = U(0xD1342543DE82EF95)
_MAP = 20  # bits of the filters before exact lookups


@dataclass
class Vocabulary:
    """Pieces as bytes, and hashed for lookups; small, and shipped with the task."""

    piece: list[bytes]  # of each id; empty for ids that stand for no text
    single: np.ndarray  # id of the piece of each one byte
    single_weight: np.ndarray
    keys: np.ndarray  # sorted hashes of longer pieces
    ids: np.ndarray
    weights: np.ndarray
    is_piece: np.ndarray  # filters by hash
    is_prefix: np.ndarray
    longest: int


def _hash(data: bytes) -> np.uint64:
    h = U(0)
    with np.errstate(over="ignore"):
        for b in data:
            h = h * _BASE + _CODE[b]
    return h


def _key(h: np.ndarray, n: int) -> np.ndarray:
    return mix(h, n)


def load(path: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    """Reads the vocabulary on the driver; tasks need no file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    piece, whole, byte = [b""] * n, {}, {}
    for i in range(n):
        if model.is_byte(i):
            byte[int(model.id_to_piece(i)[3:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            piece[i] = model.id_to_piece(i).replace(_MARK, " ").encode()
            whole.setdefault(piece[i], i)
    if len(byte) < 256:
        raise ValueError("the vocabulary has no piece for some bytes, so encoding could lose text")
    for b, i in byte.items():
        piece[i] = bytes([b])
    rank = {i: r for r, i in enumerate(sorted(whole.values()))}
    single = np.array([whole.get(bytes([b]), byte[b]) for b in range(256)], dtype=np.int32)
    weight = np.array([(rank[i] + 2.0) ** -alpha if i in rank else BYTE for i in single])
    is_piece, is_prefix = np.zeros(1 << _MAP, bool), np.zeros(1 << _MAP, bool)
    found, crossing = [], []
    for text, i in whole.items():
        if b" " in text.lstrip(b" "):
            crossing.append(text)
        if len(text) > 1 and text not in crossing:
            h = U(0)
            with np.errstate(over="ignore"):
                for k, b in enumerate(text, 1):
                    h = h * _BASE + _CODE[b]
                    key = int(_key(np.array([h]), k)[0])
                    if k < len(text):
                        is_prefix[key >> (64 - _MAP)] = True
            is_piece[key >> (64 - _MAP)] = True
            found.append((key, i, (rank[i] + 2.0) ** -alpha))
    found.sort()
    keys = np.array([x[0] for x in found], dtype=U)
    ids = np.array([x[1] for x in found], dtype=np.int32)
    weights = np.array([x[2] for x in found])
    return Vocabulary(piece, single, weight, keys, ids, weights, is_piece, is_prefix, max(map(len, whole)))


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The integers first[k] .. first[k] + count[k] - 1, for each k in turn."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Lattice:
    """For each byte position of each segment, the pieces that may end there, and their shares."""

    first: np.ndarray  # first edge of each position
    share_sum: np.ndarray  # running sum of the shares, each position's adding up to 1
    length: np.ndarray
    piece: np.ndarray


def lattice(v: Vocabulary, data: np.ndarray, off: np.ndarray) -> Lattice:
    """``data`` holds segments one after the other, by falling length; ``off`` their bounds."""
    n, size = len(off) - 1, np.diff(off)
    left = np.repeat(off[1:], size) - np.arange(len(data))  # bytes to the segment's end
    at, h = np.arange(len(data)), _CODE[data]
    edges = [(at, 1, v.single[data], v.single_weight[data])]
    keep = v.is_prefix[(_key(h, 1) >> U(64 - _MAP)).astype(np.int64)]
    for k in range(2, v.longest + 1):
        keep &= left[at] >= k
        at, h = at[keep], h[keep]
        if not len(at):
            break
        with np.errstate(over="ignore"):
            h = h * _BASE + _CODE[data[at + (k - 1)]]
        key = _key(h, k)
        short = (key >> U(64 - _MAP)).astype(np.int64)
        maybe = np.flatnonzero(v.is_piece[short])
        place = np.searchsorted(v.keys, key[maybe])
        place[place == len(v.keys)] = 0
        hit = v.keys[place] == key[maybe]
        edges.append((at[maybe[hit]], k, v.ids[place[hit]], v.weights[place[hit]]))
        keep = v.is_prefix[short]
    count = np.zeros(len(data) + 1, dtype=np.int64)
    for start, k, _, _ in edges:
        count[start + k] += 1  # ends of one length differ
    first = np.append(0, np.cumsum(count[1:]))
    fill = np.append(0, first[:-1])
    total = int(first[-1])
    length, piece, weight = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total)
    for start, k, name, w in edges:
        slot = fill[start + k]
        fill[start + k] += 1
        length[slot], piece[slot], weight[slot] = k, name, w
    ring = v.longest + 1
    sums = np.zeros((n, ring))
    sums[:, 0] = 1.0
    live = n
    for t in range(1, int(size[0]) + 1 if n else 0):
        while size[live - 1] < t:
            live = int(np.searchsorted(-size[:live], -t, side="right"))
        here = off[:live] + t - 1  # positions count from the segment's first byte's end
        each = first[here + 1] - first[here]
        edge = _ragged(first[here], each)
        owner = np.repeat(np.arange(live), each)
        part = sums[owner, (t - length[edge]) % ring] * weight[edge]
        whole = np.add.reduceat(part, np.cumsum(each) - each)
        weight[edge] = part / whole[owner]
        sums[:live, t % ring] = whole
        if t % 4 == 0:  # a common factor of what may still be used changes no share
            sums[:live] /= whole[:, None]
    return Lattice(first, np.cumsum(weight), length, piece)


def encode(v: Vocabulary, rows: list[bytes], keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of all rows in order, number of pieces of each row)."""
    text = b"".join(b" " + r if r else b"" for r in rows)
    data = np.frombuffer(text, dtype=np.uint8)
    if not len(data):
        return np.empty(0, np.int32), np.zeros(len(rows), np.int64)
    row_at = np.append(0, np.cumsum([len(r) + 1 if r else 0 for r in rows]))
    space = data == 32
    opens = space & np.append(True, ~space[:-1])
    opens[row_at[:-1][np.diff(row_at) > 0]] = True
    start = np.flatnonzero(opens)
    end = np.append(start[1:], len(data))
    row = np.searchsorted(row_at, start, side="right") - 1
    up, down = powers(_BASE, len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.append(U(0), np.cumsum(_CODE[data] * up[:-1], dtype=U))
        name = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U), 29)
    _, found, which = np.unique(name, return_index=True, return_inverse=True)
    order = np.argsort(-(end - start)[found], kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    found, which = found[order], rank[which]
    size = (end - start)[found]
    off = np.append(0, np.cumsum(size))
    table_of = lattice(v, data[_ragged(start[found], size)], off)

    number = np.arange(len(start)) - np.searchsorted(row, row)  # of the segment in its row
    draw = mix(mix(mix(keys.astype(np.int64).view(U), seed)[row] + number.astype(U) * _STEP, 51), 52)
    active = np.argsort(which, kind="stable")  # like segments together: lookups near one another
    left, base = size[which[active]], off[which]
    taken, pieces = [], []
    step = 0
    while len(active):
        u = (mix(draw[active] + U(step), 53) >> U(11)).astype(np.float64) * 2.0**-53
        state = base[active] + left - 1
        low, high = table_of.first[state], table_of.first[state + 1]
        before = np.where(low > 0, table_of.share_sum[low - 1], 0.0)
        edge = np.searchsorted(table_of.share_sum, before + u * (table_of.share_sum[high - 1] - before), side="right")
        edge = np.clip(edge, low, high - 1)
        taken.append(active)
        pieces.append(table_of.piece[edge])
        left = left - table_of.length[edge]
        more = left > 0
        active, left, step = active[more], left[more], step + 1
    each = np.zeros(len(start), dtype=np.int64)
    for k, segment in enumerate(taken):
        each[segment] = k + 1
    last = np.cumsum(each) - 1
    out = np.empty(int(each.sum()), dtype=np.int32)
    for k, (segment, name) in enumerate(zip(taken, pieces, strict=True)):
        out[last[segment] - k] = name
    return out, np.bincount(row, each, len(rows)).astype(np.int64)


class Decoder:
    """Pieces back to bytes, in bulk."""

    def __init__(self, v: Vocabulary) -> None:
        self.size = np.array([len(p) for p in v.piece], dtype=np.int64)
        self.at = np.append(0, np.cumsum(self.size))[:-1]
        self.data = np.frombuffer(b"".join(v.piece), dtype=np.uint8)

    def decode(self, pieces: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The text of each row; its first byte, the space put before it, goes."""
        size = self.size[pieces]
        data = self.data[_ragged(self.at[pieces], size)].tobytes()
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))]
        return [data[a + 1 : b] if b > a else b"" for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """Runs of whole rows of about ``_CHUNK`` bytes."""
    offsets, data = buffers(texts)
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    lo = 0
    while lo < len(texts):
        hi = min(len(texts), max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _CHUNK, side="right")) - 1))
        blob = data[offsets[lo] : offsets[hi]].tobytes()
        at = offsets[lo : hi + 1] - offsets[lo]
        yield lo, [blob[at[k] : at[k + 1]] if valid[lo + k] else None for k in range(hi - lo)]
        lo = hi


def _encode(v: Vocabulary, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, rows in _groups(batch.column(1)):
                pieces, counts = encode(v, [r or b"" for r in rows], keys[lo : lo + len(rows)], seed)
                none = np.array([r is None for r in rows])
                at = pa.array(np.append(0, np.cumsum(counts)), pa.int32(), mask=np.append(none, False))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(rows)), pa.ListArray.from_arrays(at, pa.array(pieces))], ["doc_id", "pieces"])

    return run


def encode_texts(docs: DataFrame, path: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, pieces (sampled ids) of each row of ``docs``; no row moves."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(load(path, alpha), seed), "doc_id long, pieces array<int>")


def _decode(v: Vocabulary) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(v)
        for batch in batches:
            lists = batch.column(1)
            counts = np.diff(lists.offsets.to_numpy())
            texts = decoder.decode(lists.flatten().to_numpy(zero_copy_only=False), np.where(lists.is_valid().to_numpy(zero_copy_only=False), counts, 0))
            mask = lists.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary(), mask=mask).cast(pa.string())], ["doc_id", "text"])

    return run


def decode_pieces(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text of each row of (doc_id, pieces)."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("pieces").cast("array<int>").alias("pieces"))
    return rows.mapInArrow(_decode(load(path)), "doc_id long, text string")


def _round_trip(v: Vocabulary, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(v)
        for batch in batches:
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, rows in _groups(batch.column(1)):
                filled = [r or b"" for r in rows]
                pieces, counts = encode(v, filled, keys[lo : lo + len(rows)], seed)
                texts = decoder.decode(pieces, counts)
                none = np.array([r is None for r in rows])
                at = pa.array(np.append(0, np.cumsum(counts)), pa.int32(), mask=np.append(none, False))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(rows)), pa.array(counts), pa.ListArray.from_arrays(at, pa.array(pieces)),
                        pa.array([None if r is None else hashlib.sha256(t).hexdigest() for r, t in zip(rows, texts, strict=True)], pa.string()),
                        pa.array([a == b for a, b in zip(filled, texts, strict=True)]),
                    ],
                    ["doc_id", "n_pieces", "pieces", "decoded_sha256", "lossless"],
                )

    return run


def round_trip(docs: DataFrame, path: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, pieces, decoded_sha256, lossless: each text encoded and decoded again."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_round_trip(load(path, alpha), seed), "doc_id long, n_pieces long, pieces array<int>, decoded_sha256 string, lossless boolean")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
