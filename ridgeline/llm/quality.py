"""Document quality from random-indexing word vectors, pooled, and a two-layer network with calibrated probabilities.

Every word has a sparse random index vector; its word vector is the sum of the index vectors around
its occurrences in the training texts, plus its own. A document is the mean of its words' vectors.
Since the first layer is linear in that mean, scoring looks up each word's share of the hidden layer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import _text
from ridgeline.llm.labels import SAMPLE_CHARS, SAMPLE_ROWS, blocks, keep, release, sample, share, sigmoid, temperature

#: Hash buckets of words, dimensions and non-zero places of an index vector, words to each side that count as context, hidden units.
BUCKETS, DIMENSIONS, NONZERO, WINDOW, HIDDEN = 1 << 15, 64, 4, 2, 32
#: Words of the average text that a text's own words are mixed with, so that a few words say little; words of a training fragment.
PRIOR, FRAGMENT = 4, (4, 24)
#: Buckets of the marks that a word is in capitals, or repeats the one before it.
_CAPITALS, _REPEATED = 0, 1

def tokens(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the words and symbol runs of all texts, marks among them, and where each text's start."""
    points, at = _text.flatten(texts)
    kinds, lower = _text.classes()
    kind = kinds[points]
    change = np.append(True, kind[1:] != kind[:-1])
    bounds = np.flatnonzero(change)
    kept = kind[bounds] != _text.SPACE
    starts, ends = bounds[kept], np.append(bounds[1:], len(points))[kept]
    low = lower[points]
    hashes = _text.span_hashes(low, starts, ends)
    bucket = ((hashes >> np.uint64(20)) % np.uint64(BUCKETS - 2)).astype(np.int64) + 2
    letters = kind[starts] == _text.LETTER
    raised = np.append(0, np.cumsum(low != points))
    capital = letters & (ends - starts > 1) & (raised[ends] - raised[starts] == ends - starts)
    doc = np.searchsorted(at, starts, side="right") - 1
    word = np.flatnonzero(letters)
    again = np.zeros(len(starts), bool)
    if len(word) > 1:
        again[word[1:]] = (hashes[word[1:]] == hashes[word[:-1]]) & (doc[word[1:]] == doc[word[:-1]])
    # A mark stands after its word.
    out, owner = bucket, doc
    marks = np.concatenate((np.flatnonzero(capital), np.flatnonzero(again)))
    if len(marks):
        values = np.concatenate((np.full(int(capital.sum()), _CAPITALS), np.full(int(again.sum()), _REPEATED)))
        out, owner = np.insert(bucket, marks + 1, values), np.insert(doc, marks + 1, doc[marks])
    return out, np.searchsorted(owner, np.arange(len(texts) + 1))


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero components of every bucket's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIMENSIONS, (BUCKETS, NONZERO)), rng.choice((-1.0, 1.0), (BUCKETS, NONZERO))


def word_vectors(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Unit vectors of all buckets from the contexts in the token stream; without contexts, the own index vector."""
    place, sign = index_vectors()
    total = np.zeros(BUCKETS * DIMENSIONS)
    for lo, hi in blocks(at, 1 << 19):  # sums of whole numbers, the same in any blocks
        part, doc = found[at[lo] : at[hi]], np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
        for shift in range(1, WINDOW + 1):
            same = np.flatnonzero(doc[shift:] == doc[:-shift])
            for word, context in ((part[same], part[same + shift]), (part[same + shift], part[same])):
                for k in range(NONZERO):
                    total += np.bincount(word * DIMENSIONS + place[context, k], sign[context, k], len(total))
    vectors = total.reshape(BUCKETS, DIMENSIONS)
    own = np.zeros((BUCKETS, DIMENSIONS))
    for k in range(NONZERO):
        own[np.arange(BUCKETS), place[:, k]] += sign[:, k]
    for x in (vectors, own):
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    vectors += own
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, found: np.ndarray, at: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """The mean vector of each text; zeros for a text without words. Texts are taken together up to `most` words, a longer one alone."""
    out = np.zeros((len(at) - 1, vectors.shape[1]), vectors.dtype)
    for lo, hi in blocks(at, most):
        full = lo + np.flatnonzero(np.diff(at[lo : hi + 1]))
        if len(full):
            out[full] = np.add.reduceat(vectors[found[at[lo] : at[hi]]], at[full] - at[lo], axis=0)
    return out / np.maximum(np.diff(at), 1)[:, None]


def _trust(at: np.ndarray) -> np.ndarray:
    """How far each text's mean may leave the average text's."""
    sizes = np.diff(at)
    return (sizes / (sizes + PRIOR))[:, None]


def fragments(found: np.ndarray, at: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A run of a few words of each text; short texts are not common enough in a sample to learn from."""
    sizes = np.diff(at)
    length = np.minimum(rng.integers(FRAGMENT[0], FRAGMENT[1] + 1, len(sizes)), sizes)
    start = at[:-1] + (rng.random(len(sizes)) * (sizes - length + 1)).astype(np.int64)
    out_at = np.append(0, np.cumsum(length))
    return found[np.arange(out_at[-1]) + np.repeat(start - out_at[:-1], length)], out_at


@dataclass
class QualityModel:
    """A fitted model: each bucket's share of the hidden layer, and the rest of the network."""

    share: np.ndarray
    mean: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    scale: float
    shift: float

    def logits(self, found: np.ndarray, at: np.ndarray) -> np.ndarray:
        hidden = np.tanh((pooled(self.share, found, at) - self.mean) * _trust(at) + self.bias)
        return hidden @ self.weights + self.offset

    def score(self, texts: Sequence[str]) -> np.ndarray:
        """Probabilities of label 1."""
        out = [np.zeros(0)]
        for lo, hi in _text.chunks(texts):
            out.append(sigmoid(self.scale * self.logits(*tokens(texts[lo:hi])) + self.shift))
        return np.concatenate(out)


def train(texts: Sequence[str], y: np.ndarray, base: float, seed: int = 11, epochs: int = 60) -> QualityModel:
    """A model from whole texts; of 1000 or more every fifth one only calibrates. base: the share of label 1 among all rows."""
    return learn(*read(texts), y, base, seed, epochs)


def read(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """tokens() of many texts, in four bytes each."""
    found, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for lo, hi in _text.chunks(texts):
        part, at = tokens(texts[lo:hi])
        found.append(part.astype(np.int32))
        sizes.append(np.diff(at))
    return np.concatenate(found), np.cumsum(np.concatenate(sizes))


def learn(found: np.ndarray, at: np.ndarray, y: np.ndarray, base: float, seed: int = 11, epochs: int = 60) -> QualityModel:
    """train() on what read() gives, which needs the texts no longer."""
    rng = np.random.default_rng(seed)
    vectors = word_vectors(found, at)
    x = pooled(vectors, found, at).astype(np.float64)
    if len(y) == 0:
        x, y, at = np.zeros((1, DIMENSIONS)), np.ones(1, np.int64), np.zeros(2, np.int64)
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-3
    part, part_at = fragments(found, at, rng)
    whole = (x - mean) / std * _trust(at)
    z = np.concatenate((whole, (pooled(vectors, part, part_at) - mean) / std * _trust(part_at)))
    n, targets = len(y), np.concatenate((y, y))
    w1, b1 = rng.normal(0, DIMENSIONS**-0.5, (DIMENSIONS, HIDDEN)), np.zeros(HIDDEN)
    w2, b2 = rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)
    params = [w1, b1, w2, b2]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    calibrates = np.arange(len(y)) % 5 == 4 if len(y) >= 1000 else np.zeros(len(y), bool)
    rows, step = np.flatnonzero(~np.concatenate((calibrates, calibrates))), 0
    for _ in range(epochs):
        rng.shuffle(rows)
        for lo in range(0, len(rows), 256):
            part = rows[lo : lo + 256]
            hidden = np.tanh(z[part] @ w1 + b1)
            error = (sigmoid(hidden @ w2 + b2) - targets[part]) / len(part)
            back = error[:, None] * w2 * (1 - hidden**2)
            gradients = [z[part].T @ back + 1e-4 * w1, back.sum(axis=0), hidden.T @ error + 1e-4 * w2, np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(params, gradients, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    held = np.flatnonzero(calibrates) if calibrates.any() else np.arange(n)
    logits = np.tanh(z[held] @ w1 + b1) @ w2 + b2
    ones = max(y[held].mean(), 1e-3)
    weight = np.where(y[held] == 1, base / ones, (1 - base) / max(1 - ones, 1e-3))
    scale, shift = temperature(logits, y[held], weight)
    fold = w1 / std[:, None]
    return QualityModel((vectors @ fold).astype(np.float32), (mean @ fold).astype(np.float32), b1.astype(np.float32), w2, float(b2[0]), scale, shift)


def fit(docs: DataFrame, labels: DataFrame, seen: Column, label: str = "quality", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> QualityModel:
    """A model of labels.<label>, learned from a bounded sample of the labelled rows for which `seen` holds.

    Null texts, ids and labels are no examples, empty texts are; rows that repeat count once; very long
    texts cost only their own place in the sample. Without any examples every score is near 1/2. The
    sample is taken by a hash of doc_id, then by doc_id and text, so ties have one order. Other columns
    are never read.
    """
    texts, y = sample(docs, labels, label, seen, rows, chars)
    found, at = read(texts)
    del texts
    release()
    model = learn(found, at, y, min(max(share(docs, labels, label, seen), 0.001), 0.999))
    release()
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of whole texts, a row for each row of docs, also where rows repeat or have no doc_id.

    A null text counts as empty, and an empty text has the score of the average text; only the text
    goes into a score, so equal texts have equal scores. Other columns are ignored; an empty table
    gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by BUCKETS and HIDDEN: 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(held.value.score(texts), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_text.tidy(run), "doc_id long, score double")


def reject(docs: DataFrame, model: QualityModel, least: float = 0.3) -> DataFrame:
    """docs without the rows whose score is below `least`; a score of `least` stays.

    The kept rows have all their columns, whatever their names, and come as often as they are given. A
    null text is scored as an empty one and stays null; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return keep(docs, lambda texts: held.value.score(texts), lambda s: s >= least)
