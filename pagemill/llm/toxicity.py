"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character 3- to 6-grams, so a misspelt or unseen form shares most
vectors with the forms that were learnt.  A bag of subword vectors is averaged and goes into
a linear softmax.  Two bags of a text are scored: the whole text, and its worst window of
consecutive words, so that one insult weighs as much in a long text as in a short one.
Embeddings and softmax are trained together: first on all windows under their document's
label, then on each document's worst window.  How the two bags are pooled is learnt too, by
the logistic regression that calibrates scores, on rows that the model it judges didn't see.  There a
toxic row weighs as much as RECALL clean ones, since a missed one is the worse mistake.

The model is fitted by one task to a sample of SAMPLE labelled texts of any length.  Scores
depend on the text alone.  Defined cases: null and empty texts, and texts without
words, get the score of bags without evidence, the calibrated prior of nothing; texts
shorter than a window are one window; with no labelled rows, or labels of one kind, every
score is that label's share (0 without labels); repeated rows are scored alike; an empty
table gives an empty table; other columns are ignored, and none clashes with the score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import table
from .subwords import distinct_words, ngrams, stretches, trained
from .textscan import chunks

SIZES = (3, 4, 5, 6)
BITS = 17
DIM = 8
WINDOW = 2
SAMPLE = 4_000  # labelled rows that the model is trained on
LONGEST = 20_000  # characters that stand for a sampled text; a longer one gives stretches from all of it
EVIDENCE = 12.0  # G statistic of a subword's uses against the labels from which it is learnt in full
COMMON, WEAK = 0.01, 0.2  # uses for each text from which other subwords are learnt too, and how strongly
RECALL = 4.0  # clean rows that weigh as much as one toxic row in calibration
CALIBRATION = 5  # one of so many sampled rows is kept for calibration
STEPS, REFINE = 60, 60
_SLICE = 20_000  # distinct words whose subwords are worked on at a time


@dataclass
class Model:
    """Log-odds of each subword bucket, already multiplied out: a bag's score is their mean."""

    odds: np.ndarray
    bias: float
    slope: float = 1.0  # of the worst window
    offset: float = 0.0
    whole: float = 0.0  # of the whole text

    def scores(self, worst: np.ndarray, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.whole * mean + self.offset, -500, 500)))


def _prefix(x: np.ndarray) -> np.ndarray:
    return np.append(0.0, np.cumsum(x, dtype=np.float64))


def worst_windows(odds: np.ndarray, counts: np.ndarray, word_at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(mean log-odds, first word) of the worst window of each row of words; 0 and -1 without words."""
    n, length = len(word_at) - 1, np.diff(word_at)
    total, count = _prefix(odds), _prefix(counts)
    start = np.arange(len(odds))
    row = np.repeat(np.arange(n), length)
    end = np.minimum(start + window, word_at[1:][row])
    whole = (start + window <= word_at[1:][row]) | (start == word_at[:-1][row])
    mean = np.where(whole, (total[end] - total[start]) / np.maximum(count[end] - count[start], 1), -np.inf)
    best, first = np.zeros(n), np.full(n, -1)
    some = np.flatnonzero(length)
    if len(some):
        best[some] = np.maximum.reduceat(mean, word_at[some])
        hit = np.flatnonzero(mean == best[row])
        first[row[hit[::-1]]] = hit[::-1]
    return best, first


def whole_bags(odds: np.ndarray, counts: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    """Mean log-odds of all subwords of each row; 0 without words."""
    total, count = _prefix(odds)[word_at], _prefix(counts)[word_at]
    return np.diff(total) / np.maximum(np.diff(count), 1)


def _excess(found: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return found * np.log(np.maximum(found, 1e-9) / np.maximum(expected, 1e-9))


class Texts:
    """Training texts as distinct words, their subwords, and words in order."""

    def __init__(self, texts: list[str]) -> None:
        which, at = [], [0]
        place: dict[bytes, int] = {}
        for chunk in chunks(pa.array(texts, pa.large_string()), lower=True):
            own, inside = distinct_words(chunk)
            name = np.array([place.setdefault(w, len(place)) for w in own], dtype=np.int32)
            which.append(name[inside] if len(own) else np.empty(0, np.int32))
            at.extend((at[-1] + np.cumsum(chunk.counts)).tolist())
        self.n, self.which, self.word_at = len(place), np.concatenate(which), np.array(at)
        words = list(place)
        self.slices = []  # (first word, word of each subword, bucket of each subword)
        self.counts = np.zeros(self.n)
        for lo in range(0, self.n, _SLICE):
            of_word, bucket = (x.astype(np.int32) for x in ngrams(words[lo : lo + _SLICE], SIZES, BITS))
            self.slices.append((lo, of_word, bucket))
            self.counts[lo : lo + _SLICE] = np.bincount(of_word, minlength=min(_SLICE, self.n - lo))

    def word_sums(self, odds: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(w, odds[b], min(_SLICE, self.n - lo)) for lo, w, b in self.slices]) if self.slices else np.zeros(0)

    def telling(self, y: np.ndarray) -> np.ndarray:
        """How strongly each bucket is learnt: 1 where its uses speak for a label, WEAK where many
        texts use it, otherwise 0, so that no single text is learnt by heart.

        A word counts once a text.  Rare subwords count as soon as their few texts agree; where
        there are few texts, one that half of the toxic ones use and no other does is enough.
        """
        rows = np.repeat(np.arange(len(self.word_at) - 1), np.diff(self.word_at))
        own = np.unique(rows * np.int64(self.n) + self.which)
        word, row = own % max(1, self.n), own // max(1, self.n)
        uses = self.bucket_sums(np.bincount(word, minlength=self.n).astype(np.float64)).astype(np.float64)
        toxic = self.bucket_sums(np.bincount(word, y[row], self.n)).astype(np.float64)
        share = y.mean()
        g = 2 * (_excess(toxic, uses * share) + _excess(uses - toxic, uses * (1 - share)))
        common = uses >= max(3, int(COMMON * len(y)))
        return np.where(g >= min(EVIDENCE, -y.sum() * np.log(share)), 1, WEAK * common).astype(np.float32)

    def bucket_sums(self, by_word: np.ndarray) -> np.ndarray:
        total = np.zeros(1 << BITS)
        for lo, w, b in self.slices:
            total += np.bincount(b, by_word[lo + w], 1 << BITS)
        return total.astype(np.float32)


class _Adam:
    def __init__(self, shape: tuple[int, ...], rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient * gradient - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-10)


def train(texts: list[str], labels: np.ndarray, seed: int = 11) -> Model:
    """Full-batch training on all rows; the same rows give the same model.

    Calibration takes the bags of rows that a second model, trained without them, gives.
    """
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log(share + 1e-300) - np.log(1 - share + 1e-300)))
    y = labels.astype(np.float64)
    whole = learnt(Texts(texts), y, seed)
    held = np.arange(len(texts)) % CALIBRATION == CALIBRATION - 1
    if len(texts) < 4 * CALIBRATION or len(set(labels[~held])) < 2:
        held[:] = False
    part = learnt(Texts([t for t, h in zip(texts, held, strict=True) if not h]), y[~held], seed) if held.any() else whole
    checked = Texts([t for t, h in zip(texts, held, strict=True) if h or not held.any()])
    bags = checked.word_sums(part.odds)[checked.which], checked.counts[checked.which], checked.word_at
    return calibrate(whole, worst_windows(*bags)[0], whole_bags(*bags), y[held] if held.any() else y)


def learnt(fit: Texts, y: np.ndarray, seed: int) -> Model:
    """Embeddings and softmax of the texts, before calibration."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    known = fit.telling(y)[:, None]
    vectors *= known
    softmax = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    adam, adam_top = _Adam(vectors.shape, 0.05), _Adam(softmax.shape, 0.01)
    counts = fit.counts[fit.which]
    count_sums = _prefix(counts)
    length = np.diff(fit.word_at)
    row = np.repeat(np.arange(len(y)), length)
    fixed = np.concatenate([np.arange(a, b, WINDOW) for a, b in zip(fit.word_at[:-1], fit.word_at[1:], strict=True)])
    weight = {0.0: 0.5 / max(1, (y == 0).sum()), 1.0: 0.5 / max(1, (y == 1).sum())}
    for step in range(STEPS + REFINE):
        odds = vectors @ (softmax[:, 1] - softmax[:, 0])
        words = fit.word_sums(odds)[fit.which]
        if step < STEPS:
            start = fixed
            importance = 1.0 / np.bincount(row[start], minlength=len(y))[row[start]] / len(y)
        else:
            start = worst_windows(words, counts, fit.word_at)[1]
            start = start[start >= 0]
            importance = np.array([weight[v] for v in y[row[start]]])
        end = np.minimum(start + WINDOW, fit.word_at[1:][row[start]])
        size = np.maximum(count_sums[end] - count_sums[start], 1)
        total = _prefix(words)
        p = 1 / (1 + np.exp(-np.clip((total[end] - total[start]) / size + bias, -30, 30)))
        pull = (p - y[row[start]]) * importance
        change = np.zeros(len(words) + 1)
        np.add.at(change, start, pull / size)
        np.add.at(change, end, -pull / size)
        by_word = np.bincount(fit.which, np.cumsum(change)[:-1], fit.n)
        by_bucket = fit.bucket_sums(by_word)
        top = vectors.T @ by_bucket
        vectors -= known * adam.step(by_bucket[:, None] * (softmax[:, 1] - softmax[:, 0])[None, :] * len(y))
        softmax -= adam_top.step(np.stack([-top, top], axis=1) * len(y))
        if step >= STEPS:
            bias -= 0.1 * float(pull.sum())
    return Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), bias)


def calibrate(model: Model, worst: np.ndarray, mean: np.ndarray, y: np.ndarray) -> Model:
    """Logistic regression of the label on both bags, with pseudo-counts so that it converges."""
    scale = np.array([float(worst.std()) or 1.0, float(mean.std()) or 1.0])
    x = np.stack([worst / scale[0], mean / scale[1], np.ones(len(worst))], axis=1)
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    wanted, weight, w = np.where(y == 1, high, low), np.where(y == 1, RECALL, 1.0), np.zeros(3)
    ridge = np.array([1e-6, 10.0, 1e-6])  # the whole text counts only where it adds something
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(hessian, x.T @ (weight * (wanted - p)) - ridge * w)
        w = w + move * min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-9:
            break
    return Model(model.odds, model.bias, float(w[0] / scale[0]), float(w[2]), float(w[1] / scale[1]))


def _score(model: Model, text: int, name: str) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(text), lower=True):
                words, which = distinct_words(chunk)
                of_word, bucket = ngrams(words, SIZES, BITS)
                sums = np.bincount(of_word, model.odds[bucket], len(words))[which]
                counts = np.bincount(of_word, minlength=len(words)).astype(np.float64)[which]
                worst, _ = worst_windows(sums, counts, chunk.word_at)
                mean = whole_bags(sums, counts, chunk.word_at)
                n = chunk.hi - chunk.lo
                yield pa.RecordBatch.from_arrays([*(c.slice(chunk.lo, n) for c in batch.columns), pa.array(model.scores(worst, mean))], [*batch.schema.names, name])

    return score


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels.toxic``, from labelled documents that are not held out."""
    label = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("text").cast("string").alias("text")).join(label, "doc_id")
    return trained(rows, SAMPLE, lambda found: train([stretches(t, LONGEST) for t in found["text"]], found["toxic"].to_numpy(dtype=np.int64)))


def held_out(doc_id):
    """Whether a document's label may not be learnt from; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def add_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of its ``text`` as a last column; no row moves."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_score(model, docs.columns.index("text"), name), schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    found = add_score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
