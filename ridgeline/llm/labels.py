"""Labelled training rows, and accuracy at what a classifier has not seen."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import _text
from ridgeline.session import Workspace

#: Labelled rows and code points that a classifier is fitted on at most.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 12_000_000
#: The part of the code points, as a divisor, up to which a text comes before longer ones.
SHARE = 64


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; null keys have none."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary") if isinstance(key, str) else key), F.lit(parts)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, seen: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """Whole texts and labels of at most `rows` labelled rows for which `seen` holds, half of each label where there are enough.

    The rows are those of the least hash of their doc_id, so the sample is the same at every run.
    It is bounded in rows and in code points together, whatever the tables' size. A text of more than
    chars / SHARE code points is taken only where the others leave its label places and room, and one
    that does not fit is passed over; the next of its label takes its place. Rows with a null text,
    doc_id or label, or without a document, are no examples; rows that repeat are one. Where a doc_id
    has several labels the smallest counts.
    """
    work = Workspace(docs.sparkSession, "sample")
    known = labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    known = known.where(seen).withColumn("order", F.xxhash64("doc_id")).withColumn("y", F.expr("y = 1"))
    size, digest = F.length("text").alias("size"), F.xxhash64("text").alias("digest")
    sized = docs.where("text is not null").select("doc_id", size, digest)
    found = work.write(sized.join(known, "doc_id").where(F.col("size") <= chars).distinct())  # numbers only
    taken, room, places = [], chars, {True: rows // 2, False: rows // 2}
    for kind in (F.col("size") * SHARE <= chars, F.col("size") * SHARE > chars):
        drawn = [r for y, n in places.items() for r in found.where(kind & (F.col("y") == y)).orderBy("order", "doc_id", "digest").limit(n).collect()]
        for r in sorted(drawn, key=lambda r: (r["order"], r["doc_id"], r["digest"])):
            if r["size"] <= room:
                taken.append((r["doc_id"], r["size"], r["digest"], r["order"], r["y"]))
                room -= r["size"]
                places[r["y"]] -= 1
    schema = found.select("doc_id", "size", "digest", "order", "y").schema
    work.drop(found)
    if not taken:
        return [], np.zeros(0, np.int64)
    chosen = F.broadcast(docs.sparkSession.createDataFrame(taken, schema))  # `rows` rows of five numbers at most
    texts = docs.where("text is not null").select("doc_id", size, digest, "text").join(chosen, ["doc_id", "size", "digest"]).dropDuplicates(["doc_id", "size", "digest"])
    got = sorted((r["order"], r["doc_id"], r["text"], r["y"]) for r in texts.select("order", "doc_id", "text", "y").collect())
    return [r[2] for r in got], np.array([r[3] for r in got], np.int64)


def blocks(at: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most `most` words together, or one longer text. at: where each text's words start."""
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def release() -> None:
    """Gives memory that training has freed back to the system, where the C library can."""
    gc.collect()
    _text.trim()


def share(docs: DataFrame, labels: DataFrame, label: str, seen: Column) -> float:
    """The share of label 1 among all rows that may be learned from."""
    known = labels.where(f"doc_id is not null and {label} is not null").where(seen)
    n, ones = known.agg(F.count(F.lit(1)), F.count_if(F.col(label) == 1)).first()
    return ones / n if n else 0.5


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of logits that minimise the weighted log loss, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * logits + b)
        error, curve = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([(error * logits).sum() + 1e-3 * (a - 1), error.sum() + 1e-3 * b])
        hessian = np.array([[(curve * logits**2).sum() + 1e-3, (curve * logits).sum()], [(curve * logits).sum(), curve.sum() + 1e-3]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def keep(docs: DataFrame, score: Callable[[Sequence[str]], np.ndarray], good: Callable[[np.ndarray], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text's score is good; no row leaves its partition.

    Null texts count as empty and stay null; columns may have any names; rows that repeat are judged
    each; an empty table gives an empty result.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(good(score([t or "" for t in batch.column(at).to_pylist()]))))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # a name with a dot would not be found
    return plain.mapInArrow(_text.tidy(run), plain.schema).toDF(*docs.columns)
