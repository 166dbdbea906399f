"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all coordinates of a signature: one scatters the shingles over the
universe, the other is read from ever later starting points, a circular shift for each coordinate.

1. Documents with equal shingle sets become one representative (their least id).
2. Bands of coordinates put representatives into buckets; each is verified against one document of
   each of its buckets, first the least id and then one drawn by a hash, so a bucket costs a number
   of pairs linear in its size. Verified links give components.
3. Two documents of a bucket that are in different components still may be linked. Buckets that hold
   several components are looked at in blocks: a product of incidence matrices counts the shingles
   that any two documents of different components share, and a block gives the links of a spanning
   forest of its components, fewer than it has documents. So no link of two documents that share a
   bucket is lost, at any size of bucket, while the pairs of a bucket are never listed.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import _text
from ridgeline.operators.components import components
from ridgeline.session import Workspace

#: Bands and coordinates in a band: a pair of similarity 0.85 shares no band with probability 3e-7, one of 0.8 with 6e-5.
BANDS, ROWS = 32, 6
#: Shift positions of the universe; shingles are scattered over it.
UNIVERSE = 1 << 20
#: Documents and shingles on each side of a block (about, as a hash deals them), and shingles of a block's matrices at a time.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 1 << 20, 4096
#: Rounds in which members of a bucket with several components meet a drawn one, and shingles of the texts that verification keeps between pairs.
ROUNDS, KEPT_SHINGLES = 1, 1 << 18

_SIGNED = "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>"


class Circulant:
    """Signatures of k coordinates from two permutations of the universe."""

    def __init__(self, k: int, universe: int = UNIVERSE, seed: int = 20240229):
        rng = np.random.default_rng(seed)
        self.k, self.universe = k, universe
        self.scatter = rng.permutation(universe).astype(np.int32)
        ranks = rng.permutation(universe).astype(np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((ranks, ranks[: k - 1])), k)

    def signature(self, shingles: np.ndarray, block: int = 2048) -> np.ndarray:
        """The least rank over all shingles for each of the k shifts."""
        at = np.unique(self.scatter[(shingles & np.uint64(self.universe - 1)).astype(np.int64)])
        out = np.full(self.k, np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(at), block):
            np.minimum(out, self.windows[at[i : i + block]].min(axis=0), out=out)
        return out


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(bands * rows)
        multipliers = _text.mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        band_salt = _text.mix(np.arange(1000, 1000 + bands, dtype=np.uint64))
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            sizes, his, los, keys = [], [], [], []
            for lo, hi in _text.chunks(texts):
                hashes, at = _text.shingle_hashes(texts[lo:hi], width)
                for i in range(hi - lo):
                    distinct = np.unique(hashes[at[i] : at[i + 1]])
                    digest = np.frombuffer(blake2b(distinct.tobytes(), digest_size=16).digest(), np.int64)
                    sizes.append(len(distinct))
                    his.append(digest[0])
                    los.append(digest[1])
                    if not len(distinct):
                        keys.append(np.zeros(0, np.int64))
                        continue
                    signature = circulant.signature(distinct)
                    grouped = signature.reshape(bands, rows).astype(np.uint64) * multipliers
                    keys.append(_text.mix(grouped.sum(axis=1, dtype=np.uint64) + band_salt).view(np.int64))
            offsets = np.zeros(len(keys) + 1, np.int32)
            np.cumsum([len(k) for k in keys], out=offsets[1:])
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["doc_id", "n_shingles", "set_hi", "set_lo", "bands"],
            )

    return run


def _verify(width: int, percent: int):
    """Keeps the pairs whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[str, set] = OrderedDict()
        size = 0

        def of(text: str) -> set:
            nonlocal size
            if (found := kept.get(text)) is None:
                found = kept[text] = _text.shingle_set(text, width)
                size += len(found)
                while size > KEPT_SHINGLES and len(kept) > 1:
                    size -= len(kept.popitem(last=False)[1])
            return found

        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in range(2))
            out_a, out_b = [], []
            for i in range(len(a)):
                x, y = _text.shingle_set(batch.column(2)[i].as_py() or "", width), of(batch.column(3)[i].as_py() or "")
                common = len(x & y)
                if common and 100 * common >= percent * (len(x) + len(y) - common):
                    out_a.append(a[i])
                    out_b.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links. b is the side that repeats."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_text.tidy(_verify(width, percent)), "a long, b long")


def _sets(width: int):
    """Adds each text's distinct shingles, as sorted 64-bit hashes, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            kept = batch.drop_columns(["text"])
            for lo, hi in _text.chunks(texts):
                hashes, at = _text.shingle_hashes(texts[lo:hi], width)
                distinct = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(hi - lo)]
                sets = [x.tobytes() for x in distinct]
                yield pa.RecordBatch.from_arrays([*kept.slice(lo, hi - lo).columns, pa.array(map(len, distinct), pa.int64()), pa.array(sets, pa.binary())], [*kept.schema.names, "n", "shingles"])

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = COLUMNS) -> np.ndarray:
    """How many elements each set of left shares with each of right, by products of incidence matrices over `columns` elements at a time."""
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right)]
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(both), columns):
        part = both[lo : lo + columns]
        sides = []
        for values, rows, n in ((flat[0], owner[0], len(left)), (flat[1], owner[1], len(right))):
            column = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[column] == values
            matrix = np.zeros((n, len(part)), np.float32)
            matrix[rows[hit], column[hit]] = 1
            sides.append(matrix)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j) of near, one less than the components that it joins. left, right: the component of each row and column."""
    names, node = np.unique(np.concatenate((left, right)), return_inverse=True)
    root = np.arange(len(names))  # of every component, kept up to date
    rows, columns = node[: len(left)], node[len(left) :]
    out = []
    for i in np.flatnonzero(near.any(axis=1)):
        found = np.flatnonzero(near[i])
        others, first = np.unique(root[columns[found]], return_index=True)
        for other, j in zip(others.tolist(), found[first].tolist(), strict=True):
            own = root[rows[i]]
            if other != own:
                out.append((int(i), j))
                root[root == other] = own
    return out


def _block_links(percent: int):
    """For rows sorted by bucket and block: links that join the components of the block's documents as far as any links do."""

    def of_block(rows: list[tuple]) -> list[tuple[int, int]]:
        asking, asked = [r for r in rows if r[3]], [r for r in rows if not r[3]]
        if not asking or not asked:
            return []
        common = shared_counts(*([np.frombuffer(r[6], np.uint64) for r in side] for side in (asking, asked)))
        sizes = [np.array([r[5] for r in side], np.int64) for side in (asking, asked)]
        comp = [np.array([r[4] for r in side], np.int64) for side in (asking, asked)]
        near = (common > 0) & (100 * common >= percent * (sizes[0][:, None] + sizes[1] - common)) & (comp[0][:, None] != comp[1])
        return [(asking[i][2], asked[j][2]) for i, j in _forest(near, *comp)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for batch in batches:
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "id", "asks", "comp", "n", "shingles")), strict=True):
                if row[:2] != now:
                    found += of_block(held)
                    held, now = [], row[:2]
                held.append(row)
            yield _pairs_batch(found)
        yield _pairs_batch(of_block(held))

    return run


def _pairs_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _open_buckets(members: DataFrame, labels: DataFrame, work: Workspace) -> tuple[DataFrame, int]:
    """(bucket, id, n, comp, top, asked_blocks, asking_blocks) of the buckets that hold several components, and how many there are.

    Of buckets with the same documents one stays. top is the bucket's largest component: all others
    ask, and so meet every document of another component. Statistics are written before the join, so
    that a join of a very large bucket can be split.
    """
    rows = work.write(members.join(labels.withColumnRenamed("component", "comp"), "id", "left").select("bucket", "id", "n", F.coalesce("comp", "id").alias("comp")))
    mark = F.xxhash64("id").cast("decimal(38,0)")
    counts = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"), F.sum(mark).alias("mark"))
    stats = counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("comps"), F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles"), F.sum("mark").alias("mark"), F.max(F.struct("docs", "shingles", "comp")).alias("most"))
    once = stats.where("comps > 1").groupBy("docs", "shingles", "mark", "most").agg(F.min("bucket").alias("bucket"))
    parts = lambda docs, shingles: F.ceil(F.greatest(docs / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    most = F.col("most")
    blocks = [parts(F.col("docs"), F.col("shingles")).alias("asked_blocks"), parts(F.col("docs") - most["docs"], F.col("shingles") - most["shingles"]).alias("asking_blocks")]
    buckets, seen = work.measured(once.select("bucket", most["comp"].alias("top"), *blocks), n=F.count(F.lit(1)))
    return rows.join(buckets, "bucket"), seen["n"]


def _blocks(rows: DataFrame, texts: DataFrame, width: int, work: Workspace) -> DataFrame:
    """The documents of open buckets with their shingles, dealt to blocks of askers and asked."""
    needed = rows.select(F.col("id").alias("doc_id")).distinct()
    own = texts.join(needed.hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text")
    sets = work.write(own.mapInArrow(_text.tidy(_sets(width)), "id long, n long, shingles binary"))
    asked_own, asking_own = (F.pmod(F.xxhash64("id"), F.col(c)).cast("int") for c in ("asked_blocks", "asking_blocks"))
    as_asked = F.transform(F.sequence(F.lit(0), F.col("asking_blocks") - 1), lambda x: F.struct((x * F.col("asked_blocks") + asked_own).alias("block"), F.lit(False).alias("asks")))
    as_asking = F.transform(F.sequence(F.lit(0), F.col("asked_blocks") - 1), lambda y: F.struct((asking_own * F.col("asked_blocks") + y).alias("block"), F.lit(True).alias("asks")))
    places = F.when(F.col("comp") != F.col("top"), F.concat(as_asked, as_asking)).otherwise(as_asked)
    return rows.drop("n").withColumn("place", F.explode(places)).select("bucket", "place.block", "id", "place.asks", "comp").join(sets, "id")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Components of near-duplicate documents.

    docs: doc_id, text; other columns are ignored. Returns one row per row of docs: doc_id,
    n_shingles (size of the document's set of shingles of `width` words), component_id (the least
    doc_id reachable over links, itself included) and kept (doc_id = component_id).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets.
    A null text counts as empty; empty texts have no shingles and no links. A row with a null
    doc_id takes no part: component_id is null and kept is true. Rows that repeat a doc_id come
    back as often as they are given, as one node. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work, results = Workspace(spark, "minhash"), Workspace(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = results.write(docs.mapInArrow(_text.tidy(_sign(width, bands, rows)), _SIGNED))
    full = signed.where("n_shingles > 0 and doc_id is not null")

    # Equal sets: the least id stands for all. Written first, so that the join with a very large group of copies can be split.
    least = work.write(full.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    copies = work.write(full.select("doc_id", "set_hi", "set_lo").join(least, ["set_hi", "set_lo"]).where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())
    reps = full.join(copies.select(F.col("a").alias("doc_id")), "doc_id", "left_anti")

    # Buckets of at least two, each member against the least id.
    members = reps.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    first = work.write(members.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket", "first"))
    shared = work.write(members.join(first, "bucket").select("bucket", "id", "n", F.col("first.id").alias("first_id"), F.col("first.n").alias("first_n")))
    alike = f"100 * least(n, first_n) >= {percent} * greatest(n, first_n)"
    pairs = work.write(shared.where(f"id != first_id and {alike}").select(F.col("id").alias("a"), F.col("first_id").alias("b")).distinct())
    members = shared.select("bucket", "id", "n")
    needed = members.select(F.col("id").alias("doc_id")).distinct()
    # The same plan at every size: an exchange of the documents, never a broadcast of ids.
    texts = work.write(docs.join(needed.hint("merge"), "doc_id", "left_semi"))
    links = work.write(_links(pairs, texts, width, percent))
    labels = work.write(components(links, work))
    held, number = _open_buckets(members, labels, work)
    for turn in range(ROUNDS):
        if not number:
            break
        draw = F.struct(F.xxhash64("id", F.lit(turn)), F.col("id").alias("id"), F.col("n").alias("n"), F.col("comp").alias("comp"))
        first = work.write(held.groupBy("bucket").agg(F.min(draw).alias("first")).select("bucket", F.col("first.id").alias("first_id"), F.col("first.n").alias("first_n"), F.col("first.comp").alias("first_comp")))
        pairs = held.join(first, "bucket").where(f"comp != first_comp and {alike}").select(F.col("id").alias("a"), F.col("first_id").alias("b")).distinct()
        links = links.unionByName(work.write(_links(pairs, texts, width, percent)))
        labels = work.write(components(links, work))
        held, number = _open_buckets(members, labels, work)
    if number:
        blocks = _blocks(held, texts, width, work)
        found = blocks.repartition("bucket", "block").sortWithinPartitions("bucket", "block").mapInArrow(_text.tidy(_block_links(percent)), "a long, b long")
        links = links.unionByName(work.write(_links(work.write(found.distinct()), texts, width, percent)))
    final = results.write(components(links.unionByName(copies), work))
    work.close()
    out = signed.select("doc_id", "n_shingles").join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    own = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component of near_duplicates(): that with the least doc_id, with all its columns.

    Rows that repeat a doc_id are one document; of them the row with the least text (null first, then
    by the row as JSON) stays. Rows with a null doc_id stay as they are, and so do null and empty texts,
    which have no links. An empty table gives an empty result; other columns may have any names.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no name of the table clashes with one used here
    at = {c: n for c, n in zip(docs.columns, names, strict=True)}
    key, text = at["doc_id"], at["text"]
    work = Workspace(docs.sparkSession, "deduplicate")
    found = work.write(near_duplicates(docs.select("doc_id", "text"), width, percent))
    own = docs.toDF(*names)
    left = own.join(found.where("not kept").select(F.col("doc_id").alias(key)).distinct().hint("merge"), key, "left_anti")
    repeated = work.write(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key)))
    if repeated.take(1):
        row = F.struct(*names)
        once = left.join(repeated, key, "left_semi").groupBy(key).agg(F.min_by(row, F.struct(text, F.to_json(row))).alias("row")).select("row.*")
        left = left.join(repeated, key, "left_anti").unionByName(once)
    return left.select(*names).toDF(*docs.columns)
