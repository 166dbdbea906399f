"""Exact top-k search by inner product with pivot-table elimination.

Vectors are quantised to integers, so scores are exact. With one more coordinate that brings all
candidates to the same length, a larger inner product is a smaller Euclidean distance; distances to
pivots then bound every score from above (triangle inequality). Candidates are scored in the order
of that bound, and a query ends when no bound reaches its k-th best score.

Candidates are stored once, in blocks, with the table of their distances to the pivots; blocks of
queries stream past each of them. A pair of blocks gives at most k rows a query; the best k of
these are merged by two aggregations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.session import Workspace

K, SCALE, PIVOTS = 20, 64, 64
#: Vectors, those of the least hash of vec_id, that the pivots are chosen from; every vector is in the table.
PIVOT_SAMPLE = 2048
#: Candidates and queries of a block (fewer where vectors have more than WIDE components), and candidates that a query scores first.
CANDIDATES, QUERIES, WIDE, STEP = 16384, 1024, 64, 256
#: Lists of query blocks that candidates are paired with; each list is a row.
LISTS = 64
#: Sums of products below these are exact in single and double precision.
_EXACT_SINGLE, _EXACT = float(1 << 24), float(1 << 53)

_BLOCK = "ids binary, data binary, n int, dim int"
_TABLE = _BLOCK + ", pivots binary, distances binary"
#: A condition on valid vectors; NaN is above infinity.
_VALID = "embedding is not null and forall(embedding, x -> x is not null and abs(x) < double('inf'))"


def _stored(data: np.ndarray) -> bytes:
    """A block's vectors; components that fit are stored in four bytes."""
    return (data.astype(np.int32) if not data.size or np.abs(data).max() < 1 << 31 else data).tobytes()


def _unpack(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


def _pack(scale: int, size: int, pivots: dict[int, np.ndarray] | None = None):
    """Blocks of quantised vectors; with pivots (by dimension) also those of the block and all distances to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def block(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            data = np.vstack([x for _, x in rows])
            ids = np.array([i for i, _ in rows], np.int64)
            columns = [pa.array([ids.tobytes()], pa.binary()), pa.array([_stored(data)], pa.binary()), pa.array([len(ids)], pa.int32()), pa.array([data.shape[1]], pa.int32())]
            if pivots is None:
                return pa.RecordBatch.from_arrays(columns, ["ids", "data", "n", "dim"])
            own = pivots.get(data.shape[1])
            own = farthest(data[:256], PIVOTS) if own is None else own
            columns += [pa.array([own.tobytes()], pa.binary()), pa.array([distances(data, own).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["ids", "data", "n", "dim", "pivots", "distances"])

        for batch in batches:
            for i, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.floor(scale * np.asarray(values.values.to_numpy(zero_copy_only=False), np.float64))
                rows = held.setdefault(len(x), [])
                rows.append((i, x))
                if len(rows) >= max(1, min(size, size * WIDE // max(len(x), 1))):
                    yield block(held.pop(len(x)))
        for rows in held.values():
            yield block(rows)

    return run


def farthest(data: np.ndarray, number: int) -> np.ndarray:
    """Up to `number` pivots of the data: the first vector, then always the farthest from those before."""
    chosen = [data[0]]
    gap = ((data - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < min(number, len(data)) and gap.max() > 0:
        chosen.append(data[int(gap.argmax())])
        gap = np.minimum(gap, ((data - chosen[-1]) ** 2).sum(axis=1))
    return np.vstack(chosen)


def _pivots(rows: DataFrame, scale: int, number: int) -> dict[int, np.ndarray]:
    """Pivots of each dimension in a sample of PIVOT_SAMPLE vectors. A block of another dimension takes its own."""
    sample = rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(PIVOT_SAMPLE).collect()
    by_dim: dict[int, list[np.ndarray]] = {}
    for r in sample:
        by_dim.setdefault(len(r["embedding"]), []).append(np.floor(scale * np.array(r["embedding"], np.float64)))
    return {dim: farthest(np.vstack(x), number) for dim, x in by_dim.items()}


def _lifted(data: np.ndarray, pivots: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The greatest squared length of the data, and the squared lengths of the pivots without and with the coordinate that lifts them to it."""
    top = float((data * data).sum(axis=1).max())
    norms = (pivots * pivots).sum(axis=1)
    return top, norms, np.maximum(top, norms)


def _unit(top: float, far: np.ndarray) -> float:
    return float(np.sqrt(max(top, far.max(), 1.0)))


def distances(data: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot table: a row for each pivot, the distances of all candidates to it where all have one length, in that length (or the longest pivot's)."""
    top, norms, far = _lifted(data, pivots)
    lift, p_lift = np.sqrt(np.maximum(top - (data * data).sum(axis=1), 0)), np.sqrt(far - norms)
    squares = top + far - 2 * (data @ pivots.T + lift[:, None] * p_lift)
    return np.ascontiguousarray((np.sqrt(np.maximum(squares, 0)) / _unit(top, far)).T.astype(np.float32))


class _Block:
    """Candidates of a block with what their exact scores need."""

    def __init__(self, data: np.ndarray):
        self.data, self.most = data, float(np.abs(data).max()) if data.size else 0.0
        self.single = data.astype(np.float32)

    def scores(self, query: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Integer inner products of a query with all candidates or those at some places, exact for every size of component."""
        limit = self.most * (float(np.abs(query).max()) if query.size else 0.0) * len(query)
        if limit < _EXACT_SINGLE:
            return ((self.single if at is None else self.single[at]) @ query.astype(np.float32)).astype(np.int64)
        rows = self.data if at is None else self.data[at]
        if limit < _EXACT:
            return (rows @ query).astype(np.int64)
        whole = [int(x) for x in query]
        exact = [sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in rows]
        if any(abs(x) >= 1 << 63 for x in exact):
            raise OverflowError("a score leaves 64 bits")
        return np.array(exact, np.int64)


class Candidates:
    """A block of candidates with its pivot table."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, pivots: np.ndarray, table: np.ndarray):
        self.ids, self.pivots, self.table, self.block = ids, pivots, table, _Block(data)
        self.top, _, self.far = _lifted(data, pivots)
        self.unit = _unit(self.top, self.far)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray], int]:
        """For each query its best k, as positions and scores in (score descending, id ascending) order, and how many candidates were scored."""
        q_norms = (queries * queries).sum(axis=1)
        to_pivot = (np.sqrt(np.maximum(q_norms[:, None] + self.far - 2 * queries @ self.pivots.T, 0)) / self.unit).astype(np.float32)
        n = len(self.ids)
        gap, one = np.empty(n, np.float32), np.empty(n, np.float32)
        places, scores, counted = [], [], 0
        for i, query in enumerate(queries):
            gap.fill(0)
            for row, far in zip(self.table, to_pivot[i], strict=True):  # the maximum of all lower bounds of the distance
                np.subtract(row, far, out=one)
                np.abs(one, out=one)
                np.maximum(gap, one, out=gap)
            order = np.argsort(gap)
            # No score is above its bound; the slack covers single precision and square roots near 0.
            slack = 1e-5 * max(self.unit**2, float(q_norms[i]))
            bound = (q_norms[i] + self.top) / 2 - gap[order].astype(np.float64) ** 2 * (self.unit**2 / 2) + slack
            best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
            at, step = 0, STEP
            while at < n and (len(score) < k or bound[at] >= score[-1]):
                stop = min(at + step, n)
                if len(score) == k:  # bounds fall, so no later candidate of the step is needed either
                    stop = at + int(np.searchsorted(-bound[at:stop], -float(score[-1]), side="right"))
                part = order[at:stop]
                got = self.block.scores(query, part)
                counted += len(part)
                if len(score) == k:
                    part, got = part[got >= score[-1]], got[got >= score[-1]]
                best, score = _best(self.ids, query_ids[i], np.concatenate((best, part)), np.concatenate((score, got)), k)
                at, step = stop, step * 2
            places.append(best)
            scores.append(score)
        return places, scores, counted


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, pivots: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Candidates.search() of a block whose pivot table is made for it."""
    return Candidates(ids, data, pivots, distances(data, pivots)).search(query_ids, queries, k)


def _best(ids: np.ndarray, own: int, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    other = ids[at] != own
    at, score = at[other], score[other]
    keep = np.lexsort((ids[at], -score))[:k]
    return at[keep], score[keep]


def _search(k: int):
    """For rows sorted by block of candidates, the block's own row first and then those of query blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                ids, data = np.frombuffer(row["ids"], np.int64), _unpack(row["data"], row["n"], row["dim"])
                if row["q_block"] is None:
                    pivots = np.frombuffer(row["pivots"], np.float64).reshape(-1, row["dim"])
                    now = Candidates(ids, data, pivots, np.frombuffer(row["distances"], np.float32).reshape(len(pivots), -1))
                    continue
                places, scores, _ = now.search(ids, data, k)
                flat = np.concatenate(places)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(x) for x in places])), pa.array(now.ids[flat]), pa.array(np.concatenate(scores))], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: str = "pmod(vec_id, 20) = 0", k: int = K, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """The k candidates of the largest integer inner product with each query: query_id, rank (from 1), vec_id, score.

    vectors: vec_id, embedding; other columns are ignored. is_query: a condition on vec_id. Each
    component x counts as floor(scale * x), x as double. Candidates are all rows but those with the
    query's own vec_id; ties go to the smaller vec_id. Rows with a null vec_id, a null vector, or null
    or non-finite components take no part; vectors of another length than the query's are no
    candidates, and an empty vector is one of length 0. Rows that repeat a vec_id are candidates each;
    as a query, the least valid vector of each vec_id is answered. An empty table gives an empty
    result. A score that leaves 64 bits is an error.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "topk")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(f"vec_id is not null and {_VALID}")
    held = _pivots(rows, scale, pivots)  # at most `pivots` vectors of each dimension in the sample
    candidates = work.write(rows.mapInArrow(_pack(scale, CANDIDATES, held), _TABLE).withColumn("c_block", F.monotonically_increasing_id()))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = work.write(asked.mapInArrow(_pack(scale, QUERIES), _BLOCK).withColumn("q_block", F.monotonically_increasing_id()))
    # A stated set of queries against all rows, in blocks: query blocks are copied to each block of candidates, which moves once.
    q_blocks = asked.groupBy("dim", F.pmod(F.xxhash64("q_block"), F.lit(LISTS)).alias("list")).agg(F.collect_list("q_block").alias("q_blocks"))
    pairs = candidates.select("c_block", "dim").join(q_blocks.drop("list"), "dim").select("c_block", F.explode("q_blocks").alias("q_block"))
    streamed = pairs.join(asked, "q_block").withColumns({"pivots": F.lit(None).cast("binary"), "distances": F.lit(None).cast("binary")})
    both = candidates.withColumn("q_block", F.lit(None).cast("long")).unionByName(streamed)
    dealt = both.repartition("c_block").sortWithinPartitions("c_block", F.col("q_block").asc_nulls_first())
    found = dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
