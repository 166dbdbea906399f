"""Toxic spans by a linear-chain conditional random field over words.

Labelled tokens come from labelled documents: words (or beginnings of words) that stand in toxic
documents far more often than chance allows are toxic tokens there. The field has two states; a
word's features are hashes of itself and of its beginnings. Forward-backward marginals give the
offending spans, and their sum, peak and density give a document's calibrated score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import _text
from ridgeline.llm.labels import SAMPLE_CHARS, blocks, keep, release, sample, share, sigmoid

#: Labelled documents that are learned from at most, hash buckets of features, and lengths of a word's beginnings (0: the word).
SAMPLE_ROWS, BUCKETS, PREFIXES = 5000, 1 << 18, (0, 4, 5, 7)
#: Natural-log odds that an association with toxic documents is no chance, and how many times likelier it must make them.
EVIDENCE, RATIO = 12.0, 4.0


def words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (a row a word), starts and ends of the words of all texts in the flat array, and where each text's words start."""
    points, at = _text.flatten(texts)
    kinds, lower = _text.classes()
    starts, ends = _text.runs(kinds[points] == _text.LETTER)
    hasher = _text.SpanHasher(lower[points])
    features = np.empty((len(starts), len(PREFIXES)), np.int32)
    for k, size in enumerate(PREFIXES):
        stop = np.minimum(ends, starts + size) if size else ends
        hashes = hasher.of(starts, stop) ^ np.uint64(k + 1)
        features[:, k] = (_text.mix(hashes) >> np.uint64(46)).astype(np.int32)
    return features, starts, ends, np.searchsorted(starts, at)


class Chain:
    """A chain of two states: start odds and transition weights, with exact marginals of many chains at once."""

    def __init__(self, start: float, transitions: np.ndarray):
        self.start, self.a = float(np.exp(start)), np.exp(transitions - transitions.max())
        spread = abs(transitions[0, 0] + transitions[1, 1] - transitions[0, 1] - transitions[1, 0])
        # What lies so many words before changes a word's odds by less than 1e-12 (Birkhoff's contraction).
        self.warm = int(min(4096, max(8, np.ceil(np.log(1e-13) / np.log(max(np.tanh(spread / 4), 1e-6))))))

    def _sweep(self, factor: np.ndarray, fresh: np.ndarray, forward: bool) -> np.ndarray:
        """The recursion over all words, in lanes that each start `warm` words early; fresh words start a chain."""
        n, lane = len(factor), max(256, 2 * self.warm)
        lanes = -(-n // lane)
        padded = np.concatenate((np.ones(self.warm), factor, np.ones(lanes * lane - n)))
        begins = np.concatenate((np.zeros(self.warm, bool), fresh, np.zeros(lanes * lane - n, bool)))
        view = np.lib.stride_tricks.sliding_window_view
        e = np.ascontiguousarray(view(padded, lane + self.warm)[::lane].T)
        s = np.ascontiguousarray(view(begins, lane + self.warm)[::lane].T)
        any_start = s.any(axis=1)
        out = np.empty((lane, lanes))
        a = self.a
        ratio = np.ones(lanes)
        for k in range(lane + self.warm):
            if forward:  # odds of state 1 given what stands before and here
                ratio = (a[0, 1] + a[1, 1] * ratio) / (a[0, 0] + a[1, 0] * ratio)
                if any_start[k]:
                    ratio[s[k]] = self.start
                ratio *= e[k]
                np.clip(ratio, 1e-30, 1e30, out=ratio)
            else:  # the same for what stands after; the factor is that of the word after
                ratio = ratio * e[k]
                ratio = (a[1, 0] + a[1, 1] * ratio) / (a[0, 0] + a[0, 1] * ratio)
                if any_start[k]:
                    ratio[s[k]] = 1.0
                np.clip(ratio, 1e-30, 1e30, out=ratio)
            if k >= self.warm:
                out[k - self.warm] = ratio
        return out.T.reshape(-1)[:n]

    def messages(self, emission: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emission factors and the odds from the words before (with the own one) and after."""
        n = len(emission)
        factor = np.exp(np.clip(emission, -40, 40))
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        full = np.flatnonzero(np.diff(at))
        first[at[:-1][full]] = True
        last[at[1:][full] - 1] = True
        before = self._sweep(factor, first, True)
        after = self._sweep(np.append(factor[1:], 1.0)[::-1], last[::-1], False)[::-1]
        return factor, before, after

    def marginals(self, emission: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The probability of state 1 of every word."""
        if not len(emission):
            return np.zeros(0)
        _, before, after = self.messages(emission, at)
        odds = before * after
        return odds / (1 + odds)

    def expected(self, emission: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals, expected transition counts, and expected number of chains that start in state 1."""
        factor, before, after = self.messages(emission, at)
        odds = before * after
        p = odds / (1 + odds)
        inner = np.ones(len(emission), bool)
        full = at[:-1][np.diff(at) > 0]
        inner[full] = False
        t = np.flatnonzero(inner)
        r, right = before[t - 1], factor[t] * after[t]
        cells = np.stack([np.full(len(t), self.a[0, 0]), self.a[0, 1] * right, self.a[1, 0] * r, self.a[1, 1] * r * right])
        cells /= cells.sum(axis=0)
        return p, cells.sum(axis=1).reshape(2, 2), float(p[full].sum())


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    start: float
    transitions: np.ndarray
    document: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def marginals(self, features: np.ndarray, at: np.ndarray) -> np.ndarray:
        emission = self.weights[features].sum(axis=1, dtype=np.float64) + self.bias
        return Chain(self.start, self.transitions).marginals(emission, at)

    def score(self, texts: Sequence[str]) -> np.ndarray:
        """Probabilities of label 1."""
        out = [np.zeros(0)]
        for lo, hi in _text.chunks(texts):
            features, _, _, at = words(texts[lo:hi])
            out.append(self.document_score(self.marginals(features, at), at))
        return np.concatenate(out)

    def document_score(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = (summary(p, at) - self.mean) / self.scale
        return sigmoid(z @ self.document[:-1] + self.document[-1])


def summary(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Expected number, peak and density of toxic words of each text, on log scales."""
    sizes = np.diff(at)
    full = np.flatnonzero(sizes)
    total, peak = np.zeros(len(sizes)), np.zeros(len(sizes))
    if len(full):
        total[full] = np.add.reduceat(p, at[:-1][full])
        peak[full] = np.maximum.reduceat(p, at[:-1][full])
    peak = np.clip(peak, 1e-4, 1 - 1e-4)
    return np.stack([np.log(total + 0.01), np.log(peak / (1 - peak)), np.log1p(100 * total / (sizes + 20))], axis=1)


def toxic_tokens(features: np.ndarray, at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels of words: 1 in a toxic text where a feature stands in toxic texts beyond chance."""
    toxic, clean = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    hot = np.zeros(BUCKETS, bool)
    rate = toxic / (toxic + clean)
    for k in range(features.shape[1]):
        n1, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for lo, hi in blocks(at):
            doc = np.repeat(np.arange(lo, hi), np.diff(at[lo : hi + 1]))
            pairs = np.unique(doc * BUCKETS + features[at[lo] : at[hi], k])
            feature, label = pairs % BUCKETS, y[pairs // BUCKETS]
            n1 += np.bincount(feature[label == 1], minlength=BUCKETS)
            n += np.bincount(feature, minlength=BUCKETS)
        share1 = np.clip(n1 / np.maximum(n, 1), 1e-9, 1 - 1e-9)
        evidence = n * (share1 * np.log(share1 / rate) + (1 - share1) * np.log((1 - share1) / (1 - rate)))
        hot |= (n1 / toxic > RATIO * (n - n1 + 0.5) / clean) & (evidence > min(EVIDENCE, 0.6 * toxic * -np.log(rate)))
    return (hot[features].any(axis=1) & np.repeat(y == 1, np.diff(at))).astype(np.float64)


def train(texts: Sequence[str], y: np.ndarray, base: float, epochs: int = 12, seed: int = 5) -> ToxicityModel:
    """A model from whole texts; of 1000 or more every fifth one only calibrates. base: the share of label 1 among all rows."""
    return learn(*read(texts), y, base, epochs, seed)


def read(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features of the words of many texts, and where each text's words start."""
    features, sizes = [np.zeros((0, len(PREFIXES)), np.int32)], [np.zeros(1, np.int64)]
    for lo, hi in _text.chunks(texts):
        part, _, _, at = words(texts[lo:hi])
        features.append(part)
        sizes.append(np.diff(at))
    return np.concatenate(features), np.cumsum(np.concatenate(sizes))


def learn(features: np.ndarray, at: np.ndarray, y: np.ndarray, base: float, epochs: int = 12, seed: int = 5) -> ToxicityModel:
    """train() on what read() gives, which needs the texts no longer."""
    if len(y) == 0:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), -4.0, -4.0, np.zeros((2, 2)), np.array([0.0, 0.0, 0.0, -2.0]), np.zeros(3), np.ones(3))
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 1000 else np.zeros(len(y), bool)
    gold = toxic_tokens(features[np.repeat(~held, np.diff(at))], np.append(0, np.cumsum(np.diff(at)[~held])), y[~held])
    rng = np.random.default_rng(seed)
    learned = np.flatnonzero(~held)
    gold_at = np.append(0, np.cumsum(np.diff(at)[learned]))
    # Parameters: feature weights, bias, start, transitions; all but the bias are drawn to 0.
    weights, rest = np.zeros(BUCKETS), np.array([-3.0, 0.0, 0.0, 0.0, 0.0, 0.0])
    seen, seen_rest = np.full(BUCKETS, 1e-2), np.full(6, 1e-2)
    batches = max(1, len(gold) // 60_000)
    for epoch in range(epochs):
        deal = rng.permutation(len(learned))
        for part in np.array_split(deal, batches):
            spans = [np.arange(at[d], at[d + 1]) for d in learned[part]]
            rows = np.concatenate(spans) if spans else np.zeros(0, np.int64)
            if not len(rows):
                continue
            own = np.concatenate([gold[gold_at[i] : gold_at[i + 1]] for i in part])
            part_at = np.append(0, np.cumsum([len(s) for s in spans]))
            f = features[rows]
            chain = Chain(rest[1], rest[2:].reshape(2, 2))
            p, counts, starts = chain.expected(weights[f].sum(axis=1) + rest[0], part_at)
            error = p - own
            inner = np.ones(len(rows), bool)
            inner[part_at[:-1][np.diff(part_at) > 0]] = False
            t = np.flatnonzero(inner)
            seen_counts = np.bincount((2 * own[t - 1] + own[t]).astype(int), minlength=4)[:4].reshape(2, 2)
            g = np.bincount(f.ravel(), np.repeat(error, f.shape[1]), BUCKETS)
            used = np.flatnonzero(g)
            g[used] += 0.02 * weights[used]
            seen[used] += g[used] ** 2
            weights[used] -= 0.5 * g[used] / np.sqrt(seen[used])
            g_rest = np.concatenate(([error.sum(), starts - own[~inner].sum()], (counts - seen_counts).ravel())) + 0.5 * np.append([0.0], rest[1:])
            seen_rest += g_rest**2
            rest -= 0.3 * g_rest / np.sqrt(seen_rest)
            rest[2:] = np.clip(rest[2:], -2, 2)
    model = ToxicityModel(weights.astype(np.float32), float(rest[0]), float(rest[1]), rest[2:].reshape(2, 2).copy(), np.zeros(4), np.zeros(3), np.ones(3))
    # The document's score: a logistic function of the marginals' summary, fitted on texts the field has not seen.
    spans = [(at[lo : hi + 1] - at[lo], features[at[lo] : at[hi]]) for lo, hi in blocks(at)]
    x = np.concatenate([summary(model.marginals(f, part_at), part_at) for part_at, f in spans])
    rows = np.flatnonzero(held) if held.any() else np.arange(len(y))
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack(((x[rows] - model.mean) / model.scale, np.ones(len(rows))))
    ones = min(max(y[rows].mean(), 1e-3), 1 - 1e-3)
    weight = np.where(y[rows] == 1, base / ones, (1 - base) / (1 - ones))
    beta = np.zeros(4)
    for _ in range(60):
        q = sigmoid(z @ beta)
        gradient = z.T @ (weight * (q - y[rows])) + 0.02 * np.append(beta[:-1], 0)
        hessian = (z * (weight * np.maximum(q * (1 - q), 1e-9))[:, None]).T @ z + 0.02 * np.eye(4)
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    model.document = beta
    return model


def fit(docs: DataFrame, labels: DataFrame, seen: Column, label: str = "toxic", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> ToxicityModel:
    """A model of labels.<label>, learned from a bounded sample of the labelled rows for which `seen` holds.

    Null texts, ids and labels are no examples, empty texts are; rows that repeat count once; very long
    texts cost only their own place in the sample. Without any examples every score is 0.12. The sample
    is taken by a hash of doc_id, then by doc_id and text, so ties have one order. Other columns are
    never read.
    """
    texts, y = sample(docs, labels, label, seen, rows, chars)
    features, at = read(texts)
    del texts
    release()
    model = learn(features, at, y, min(max(share(docs, labels, label, seen), 0.001), 0.999))
    release()
    return model


def tag(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """doc_id, score and spans (start, end, probability) of whole texts, a row for each row of docs.

    A span is a run of neighbouring words whose marginals are at least `least`; places are in code
    points, the end exclusive. A null text counts as empty; an empty text has no spans and the score of a
    text without toxic words. Only the text goes into a score. Rows that repeat, or have no doc_id,
    come back as often; other columns are ignored; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by BUCKETS: 1 MB
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = batch.column(0).cast(pa.int64())
            for lo, hi in _text.chunks(texts):
                features, starts, ends, at = words(texts[lo:hi])
                p = m.marginals(features, at)
                base = np.append(0, np.cumsum([len(t) + 1 for t in texts[lo:hi]]))
                spans: list[list[dict]] = [[] for _ in range(hi - lo)]
                hot = np.flatnonzero(p >= least)
                doc = np.searchsorted(at, hot, side="right") - 1
                for k in range(len(hot)):
                    i, d = hot[k], doc[k]
                    if k and hot[k - 1] == i - 1 and doc[k - 1] == d:
                        spans[d][-1]["end"] = int(ends[i] - base[d])
                        spans[d][-1]["probability"] = max(spans[d][-1]["probability"], float(p[i]))
                    else:
                        spans[d].append({"start": int(starts[i] - base[d]), "end": int(ends[i] - base[d]), "probability": float(p[i])})
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(m.document_score(p, at), pa.float64()), pa.array(spans, span_type)], ["doc_id", "score", "spans"])

    pair = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return pair.mapInArrow(_text.tidy(run), "doc_id long, score double, spans array<struct<start:long,end:long,probability:double>>")


def reject(docs: DataFrame, model: ToxicityModel, most: float = 0.7) -> DataFrame:
    """docs without the rows whose score is `most` or more.

    The kept rows have all their columns, whatever their names, and come as often as they are given. A
    null text is scored as an empty one and stays null; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return keep(docs, lambda texts: held.value.score(texts), lambda s: s < most)
