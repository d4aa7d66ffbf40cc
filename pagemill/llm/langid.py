"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the hashed 1- to 4-grams of lower-cased words with their edges marked; a
feature's value is its share of the text's n-grams times its inverse document frequency.
Weights are learnt by follow-the-regularised-leader with an elastic-net penalty, so
features that carry little keep a weight of exactly zero.  A temperature fitted on texts
that training did not see calibrates the probabilities.

The model is fitted by one task to a sample of SAMPLE labelled texts of any length.
Predictions depend on the text alone.  Defined cases: a null text, or one without a letter,
is ``und`` with score 0; with no labelled rows every text is ``und``; with one language
every text with a letter is that language; rows are judged one by one, so repeats agree; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table
from .subwords import distinct_words, ngrams, stretches, trained
from .textscan import chunks

SIZES = (1, 2, 3, 4)
BITS = 16
SCALE = 100.0  # shares of n-grams are small; this brings features near 1
SAMPLE = 4_000  # labelled texts that the model is trained on
LONGEST = 20_000  # characters that stand for a sampled text; a longer one gives stretches from all of it
CALIBRATION = 5  # one of so many sampled texts is kept for calibration
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
UNKNOWN = "und"


@dataclass
class Model:
    """Weights are multiplied with the inverse document frequencies already."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        return softmax(z)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text."""
    found = []
    for chunk in chunks(pa.array(texts, pa.large_string())):
        words, which = distinct_words(chunk)
        of_word, bucket = ngrams(words, SIZES, BITS)
        order = np.argsort(of_word, kind="stable")
        bucket, at = bucket[order], np.searchsorted(of_word[order], np.arange(len(words) + 1))
        for r in range(chunk.hi - chunk.lo):
            name, times = np.unique(which[chunk.word_at[r] : chunk.word_at[r + 1]], return_counts=True)
            length = (at[name + 1] - at[name]).astype(np.int64)
            place = np.repeat(at[name] - np.append(0, np.cumsum(length))[:-1], length) + np.arange(length.sum())
            own, inside = np.unique(bucket[place], return_inverse=True)
            count = np.bincount(inside, np.repeat(times, length).astype(float), len(own))
            found.append((own, count / max(1.0, count.sum())))
    return found


def train(texts: list[str], labels: list[str], seed: int = 5) -> Model:
    """One pass of updates a text and epoch; the same rows give the same model."""
    names = sorted(set(labels))
    if len(names) < 2:
        return Model(names, np.zeros((1 << BITS, len(names)), np.float32), np.zeros(len(names)))
    y = np.searchsorted(names, labels)
    rows = features(texts)
    held = np.arange(len(rows)) % CALIBRATION == CALIBRATION - 1 if len(rows) >= 4 * CALIBRATION else np.zeros(len(rows), bool)
    fit = np.flatnonzero(~held)
    df = np.bincount(np.concatenate([rows[i][0] for i in fit]), minlength=1 << BITS)
    idf = np.log((1 + len(fit)) / (1 + df)) + 1
    k = len(names)
    z, n = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    z0, n0 = np.zeros(k), np.zeros(k)

    def solve(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            own, share = rows[i]
            x = share * idf[own] * SCALE
            w, b = solve(z[own], n[own], L1), solve(z0, n0, 0.0)
            miss = softmax(x @ w + b)
            miss[y[i]] -= 1
            g = x[:, None] * miss[None, :]
            z[own] += g - (np.sqrt(n[own] + g * g) - np.sqrt(n[own])) / ALPHA * w
            n[own] += g * g
            z0 += miss - (np.sqrt(n0 + miss * miss) - np.sqrt(n0)) / ALPHA * b
            n0 += miss * miss
    w, b = solve(z, n, L1), solve(z0, n0, 0.0)
    checked = np.flatnonzero(held) if held.any() else fit
    logits = np.array([(rows[i][1] * idf[rows[i][0]] * SCALE) @ w[rows[i][0]] + b for i in checked])
    temperature = calibrate(logits, y[checked])
    return Model(names, (w * (idf * SCALE)[:, None]).astype(np.float32), b, temperature)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(y)), y]
        return -float(np.log(np.maximum(p, 1e-300)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _predict(model: Model) -> Callable:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                n, k = chunk.hi - chunk.lo, len(model.names)
                part = batch.slice(chunk.lo, n)
                words, which = distinct_words(chunk)
                of_word, bucket = ngrams(words, SIZES, BITS)
                row = np.repeat(np.arange(n), chunk.counts)
                size = np.bincount(of_word, minlength=len(words)).astype(float)[which]
                counts = np.bincount(row, size, n)
                sums = np.zeros((n, k))
                for c in range(k):
                    of = np.bincount(of_word, model.weights[bucket, c], len(words))[which]
                    sums[:, c] = np.bincount(row, of, n)
                letter = pc.fill_null(pc.match_substring_regex(part.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
                some = letter & (k > 0)
                best, p = np.zeros(n, int), np.zeros(n)
                if k:
                    found = model.probabilities(sums, counts)
                    best, p = found.argmax(axis=1), found.max(axis=1)
                name = [model.names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(name, pa.string()), pa.array(np.where(some, p, 0.0))], ["doc_id", "lang_pred", "score"])

    return predict


def held_out(doc_id):
    """Whether a document's language may not be learnt from; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def learn(docs: DataFrame) -> Model:
    """A model of ``lang``, from the documents that are not held out."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    return trained(rows, SAMPLE, lambda found: train([stretches(t, LONGEST) for t in found["text"]], found["lang"].tolist()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row of ``docs``; no row moves."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
