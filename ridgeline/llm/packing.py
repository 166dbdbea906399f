"""Packing of token sequences: best fit over the histogram of lengths, then a swap-based local search.

Pieces of one length are interchangeable, so the plan is made from how many pieces there are of
each length: at most `limit` numbers, whatever the size of the corpus. Equal bins are one group
with a count. The pieces are then dealt to the plan by their rank among those of their length.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm import _text, bpe
from ridgeline.session import Workspace

LIMIT = 2048
#: Rows of a file of the written table that are ranked together.
RANKED_TOGETHER = 1 << 16
Bins = dict[tuple[int, ...], int]


def best_fit(counts: dict[int, int], limit: int) -> Bins:
    """Bins (their lengths, descending) with their counts: the longest pieces first, each into the fullest bin that has room."""
    bins: Bins = {}
    by_room: dict[int, list[tuple[int, ...]]] = {}
    rooms: list[int] = []

    def add(items: tuple[int, ...], n: int, room: int) -> None:
        if items in bins:
            bins[items] += n
            return
        bins[items] = n
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append(items)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = limit // length
                whole, rest = divmod(left, each)
                if whole:
                    add((length,) * each, whole, limit - each * length)
                if rest:
                    add((length,) * rest, 1, limit - rest * length)
                break
            room = rooms[at]
            items = by_room[room][-1]
            take = min(bins[items], left)
            bins[items] -= take
            if not bins[items]:
                del bins[items]
                by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            add((*items, length), take, room - length)
            left -= take
    return bins


def _sums(items: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What can leave a bin: the sums of its different single pieces and of its pairs, ascending, and both pieces of each (0: no second)."""
    kinds = Counter(items)
    one = np.array(sorted(kinds), np.int64)
    i, j = np.triu_indices(len(one))
    allowed = (i != j) | (np.array([kinds[x] for x in one.tolist()])[i] > 1)
    first, second = one[i[allowed]], one[j[allowed]]
    order = np.argsort(first + second, kind="stable")
    return one, (first + second)[order], first[order], second[order]


class _Takers:
    """Everything that underfull bins can give back: a row for nothing, each piece and each pair of each bin, in the order the bins came."""

    def __init__(self) -> None:
        self.n = 0
        self.rows = np.empty((1024, 4), np.int64)  # sum, number of the bin, first and second piece
        self.bins: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.fill = np.zeros(1024, np.int64)
        self.alive = np.zeros(1024, bool)

    def add(self, items: tuple[int, ...]) -> None:
        if (known := self.number.get(items)) is not None and self.alive[known]:
            return
        self.number[items] = k = len(self.bins)  # one that comes back is new to all givers
        self.bins.append(items)
        if k == len(self.fill):
            self.fill, self.alive = np.append(self.fill, np.zeros(k, np.int64)), np.append(self.alive, np.zeros(k, bool))
        self.fill[k], self.alive[k] = sum(items), True
        one, two, first, second = _sums(items)
        made = np.zeros((1 + len(one) + len(two), 4), np.int64)
        made[1 : 1 + len(one), 0] = made[1 : 1 + len(one), 2] = one
        made[1 + len(one) :, 0], made[1 + len(one) :, 2], made[1 + len(one) :, 3] = two, first, second
        made[:, 1] = k
        while self.n + len(made) > len(self.rows):
            self.rows = np.concatenate((self.rows, np.empty_like(self.rows)))
        self.rows[self.n : self.n + len(made)] = made
        self.n += len(made)

    def remove(self, items: tuple[int, ...]) -> None:
        self.alive[self.number[items]] = False

    def best(self, giver: tuple[int, ...], twice: bool, since: int, limit: int) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]] | None:
        """(taker, pieces it gets, pieces it gives) of the exchange with the rows from `since` on that adds most to squared fill; none if none adds to it.

        The giver gives one piece for none, one or two, or two pieces for one. It is its own taker only if there are two of it.
        """
        rows = self.rows[since : self.n]
        rows = rows[self.alive[rows[:, 1]]]
        if not twice:
            rows = rows[rows[:, 1] != self.number[giver]]
        if not len(rows):
            return None
        own = sum(giver)
        one, two, first, second = _sums(giver)
        fill = self.fill[rows[:, 1]]
        most = rows[:, 0] + limit - fill  # the largest sum that the taker has room for
        least = np.maximum(0, own - fill)
        top, found = 0, None
        single = (rows[:, 2] > 0) & (rows[:, 3] == 0)
        for sums, rule in ((one, None), (two, single)):
            if not len(sums):
                continue
            at = np.searchsorted(sums, most, side="right") - 1
            shift = np.where(at >= 0, sums[np.maximum(at, 0)] - rows[:, 0], 0)
            gain = np.where(shift > least, shift * (shift - own + fill), 0)
            if rule is not None:
                gain = np.where(rule, gain, 0)
            k = int(gain.argmax())
            if gain[k] > top:
                top, found = int(gain[k]), (k, (int(one[at[k]]),) if rule is None else (int(first[at[k]]), int(second[at[k]])))
        if found is None:
            return None
        row = rows[found[0]]
        return self.bins[row[1]], found[1], tuple(int(x) for x in row[2:] if x)


def _swapped(items: tuple[int, ...], without: tuple[int, ...], extra: tuple[int, ...]) -> tuple[int, ...]:
    left = list(items)
    for x in without:
        left.remove(x)
    return tuple(sorted([*left, *extra], reverse=True))


def improve(bins: Bins, limit: int) -> Bins:
    """Local search: the emptiest bins give pieces to, or swap them with, other underfull bins as long as squared fill grows, until bins are empty.

    It ends at the least possible number of bins, or when no move, one-for-one or two-for-one swap of
    any two underfull bins adds to squared fill (which is a whole number, so there is an end). Each
    exchange is made by as many equal bins as there are. A bin without an exchange waits until others
    have changed, and then is compared with the changed ones only.
    """
    bins = dict(bins)
    least = -(-sum(sum(b) * n for b, n in bins.items()) // limit)
    number = sum(bins.values())
    takers = _Takers()
    for b in sorted(bins):
        if sum(b) < limit:
            takers.add(b)
    seen = dict.fromkeys(takers.bins, 0)  # of each bin, the rows that it has been compared with
    heap = [(sum(b), b) for b in seen]
    heapq.heapify(heap)
    while number > least:
        if not heap:
            heap = [(sum(b), b) for b, n in seen.items() if n < takers.n and b in bins]
            heapq.heapify(heap)
            if not heap:
                break
        _, giver = heapq.heappop(heap)
        if giver not in bins or seen[giver] >= takers.n:
            continue
        found = takers.best(giver, bins[giver] > 1, seen[giver], limit)
        if found is None:
            seen[giver] = takers.n
            continue
        taker, give, take = found
        m = bins[giver] // 2 if taker == giver else min(bins[giver], bins[taker])
        for b in (giver, taker):
            bins[b] -= m
            if not bins[b]:
                del bins[b]
                takers.remove(b)
        for b in (_swapped(giver, give, take), _swapped(taker, take, give)):
            if not b:
                number -= m
                continue
            more = b in bins
            bins[b] = bins.get(b, 0) + m
            if sum(b) < limit and not more:
                takers.add(b)
                seen[b] = 0
                heapq.heappush(heap, (sum(b), b))
            elif sum(b) < limit and bins[b] - m == 1:  # now it can be its own taker
                seen[b] = 0
                heapq.heappush(heap, (sum(b), b))
        if giver in bins:
            heapq.heappush(heap, (sum(giver), giver))
    return bins


def plan(counts: dict[int, int], limit: int = LIMIT) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted: the pieces of a length from that rank on go to consecutive sequences at that offset."""
    rows = []
    rank = dict.fromkeys(counts, 0)
    sequence = 0
    for items, n in sorted(improve(best_fit(counts, limit), limit).items()):
        offset = 0
        for length in items:
            rows.append((length, rank[length], sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _pieces(path: str | None, limit: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = bpe.loaded(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            doc_ids = batch.column(0).cast(pa.int64())
            for lo, hi in _text.chunks(texts):
                flat, at = tokens.encode(texts[lo:hi])
                number, piece, start, length, crc = [], [], [], [], []
                for i in range(hi - lo):
                    ids = np.append(flat[at[i] : at[i + 1]], end_id).astype("<u4")
                    for k in range(0, len(ids), limit):
                        part = ids[k : k + limit]
                        number.append(lo + i)
                        piece.append(k // limit)
                        start.append(k)
                        length.append(len(part))
                        crc.append(crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(number, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def pieces(docs: DataFrame, limit: int = LIMIT, end_id: int = 0, path: str | None = None) -> DataFrame:
    """The token pieces of whole texts: doc_id, piece, start, length, ids_crc32.

    A document is the ids of its text (null or empty: none) and then end_id; only one longer than limit
    is cut, into pieces of limit and a rest. Rows that repeat, or have no doc_id, are documents each;
    other columns are ignored. An empty table gives an empty result.
    """
    pair = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return pair.mapInArrow(_text.tidy(_pieces(path, limit, end_id)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """found (a column length of 1 to limit, and any others) with sequence_id and offset, in as few sequences as the search finds.

    Each sequence is filled gaplessly from 0. Rows that repeat are packed each; an empty table gives
    an empty result, a length that is null or out of range a ValueError. Columns of found may have any
    names; its own sequence_id and offset, if there, are replaced.
    """
    spark = found.sparkSession
    found = found.select(*(f"`{c}`" for c in found.columns if c.lower() not in ("sequence_id", "offset")))
    names = [f"c{i}" for i in range(len(found.columns))]  # so that no name of the table clashes with one used here
    length = names[[c.lower() for c in found.columns].index("length")]
    work, results = Workspace(spark, "packing"), Workspace(spark, "packing")
    held = results.write(found.toDF(*names).withColumn(length, F.col(length).cast("long")))
    counts = {r[length]: r["count"] for r in held.groupBy(length).count().limit(limit + 1).collect()}  # more lengths than limit are an error
    if any(x is None or not 1 <= x <= limit for x in counts):
        raise ValueError(f"lengths must be 1 to {limit}")
    made = plan(counts, limit)
    key = made[:, 0] << 44 | made[:, 1]
    placed = spark.sparkContext.broadcast((key, made))  # grows with the number of lengths, not with the rows

    # Ranks within a length: by place in the written table. Its blocks are counted, and each is ranked by itself, however many rows have one length.
    parts = [length, "file", "block"]
    split = held.select(*names, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).withColumn("block", F.floor(F.col("row") / RANKED_TOGETHER))
    sizes = work.write(split.groupBy(*parts).count())
    before = F.sum("count").over(Window.partitionBy(length).orderBy("file", "block")) - F.col("count")
    before = results.write(sizes.withColumn("before", before).drop("count"))
    work.close()
    within = split.withColumn("rank", F.row_number().over(Window.partitionBy(*parts).orderBy("row")) - 1)
    # Both sides lie by the same key already; the counts grow with the files, so they are never broadcast.
    ranked = within.join(before.hint("merge"), parts).withColumn("rank", F.col("rank") + F.col("before")).select(*names, "rank")
    kinds = ", ".join(f"{n} {t}" for n, t in held.dtypes)
    width, at_length = len(names), names.index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = placed.value
        for batch in batches:
            size, rank = batch.column(at_length).to_numpy(), batch.column(width).to_numpy()
            at = np.searchsorted(keys, size << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long").toDF(*found.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, limit: int = LIMIT, end_id: int = 0, path: str | None = None) -> DataFrame:
    """All documents (doc_id, text) packed into sequences of at most limit tokens: the columns of pieces() and sequence_id, offset.

    Nulls, empty and very long texts, repeated rows, other columns and empty tables: as in pieces().
    Documents of one length are interchangeable; which of them goes where follows their place in the
    table that is written for the purpose.
    """
    return pack(pieces(docs, limit, end_id, path), limit)
