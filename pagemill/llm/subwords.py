"""Character n-grams of words, hashed in bulk, and models fitted to bounded samples of rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import U, Chunk, mix

_SPACE = 32


def distinct_words(chunk: Chunk) -> tuple[list[bytes], np.ndarray]:
    """The chunk's distinct words, and for each word of the chunk which one it is."""
    _, first, which = np.unique(chunk.hashes, return_index=True, return_inverse=True)
    data = chunk.data.tobytes()
    return [data[i:j] for i, j in zip(chunk.starts[first], chunk.ends[first], strict=True)], which


def ngrams(words: list[bytes], sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of every lower-cased word with a mark at either end.

    Words hold no spaces; a word shorter than n gives none of size n, so every word gives
    some n-gram where 3 is among the sizes.  Rows come by size, then by word.
    """
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = b" " + b" ".join(words) + b" "
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = points == _SPACE
    word = np.cumsum(space) - 1  # of a mark: the word that follows
    coded = mix(points.astype(U), 3)
    out_word, out_bucket = [], []
    found, clear = coded, np.ones(len(points), dtype=bool)
    with np.errstate(over="ignore"):
        for n in range(2, max(sizes) + 1):
            found = found[:-1] * U(0x9E3779B97F4A7C15) + coded[n - 1 :]
            clear = clear[:-1] if n == 2 else clear[:-1] & ~space[n - 2 : -1]
            if n in sizes:
                at = np.flatnonzero(clear)
                out_word.append(word[at])
                out_bucket.append((mix(found[at], n) >> U(64 - bits)).astype(np.int64))
    if 1 in sizes:
        at = np.flatnonzero(~space)
        out_word.insert(0, word[at])
        out_bucket.insert(0, (mix(coded[at], 1) >> U(64 - bits)).astype(np.int64))
    return np.concatenate(out_word), np.concatenate(out_bucket)


def stretches(text: str | None, longest: int, parts: int = 4) -> str:
    """A text that a model is trained on: whole, or ``parts`` stretches of it from end to end.

    Stretches are as long as fit ``longest`` characters and evenly spaced, so a long text is
    represented by all of it and every sampled row counts; a null text is empty.
    """
    text = text or ""
    if len(text) <= longest:
        return text
    size, step = longest // parts, (len(text) - longest // parts) / (parts - 1)
    return " ".join(text[int(k * step) : int(k * step) + size] for k in range(parts))


def trained(rows: DataFrame, most: int, fit: Callable[[pd.DataFrame], object]) -> object:
    """What ``fit`` makes of about ``most`` rows (doc_id, ...), chosen by a hash of doc_id.

    One task reads the sample, sorted by doc_id and text, and fits the model; only the model
    reaches the driver.  ``fit`` also gets an empty sample, where there are no rows.
    """
    share = min(1.0, most / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    names = sample.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        found = pa.Table.from_batches(held).to_pandas() if held else pd.DataFrame(columns=names)
        found = found.sort_values(["doc_id", "text"], kind="stable").reset_index(drop=True)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(found))], pa.binary())], ["model"])

    made = sample.repartition(1).mapInArrow(run, "model binary").head()
    return pickle.loads(bytes(made[0])) if made else fit(pd.DataFrame(columns=names))
