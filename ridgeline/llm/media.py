"""Media columns: ISO base media containers that hold bytes as samples, and a reader of their boxes and sample tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a sample (64 eight-bit frames), samples of a chunk, samples from one keyframe to the next, frames a second.
UNIT, CHUNK, GROUP, RATE = 64, 256, 16, 8000
#: Bytes of texts whose containers are made together.
BATCH_BYTES = 16 << 20
#: Box types that hold boxes, with the bytes that come before these.
_CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"udta": 0, b"dinf": 0, b"mvex": 0}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
_DINF = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
_HDLR = _full(b"hdlr", struct.pack(">I4s3I", 0, b"soun", 0, 0, 0), b"samples\0")
_SMHD = _full(b"smhd", bytes(4))
_STSD = _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16)))


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """data with bytes 0 up to a positive multiple of unit."""
    return data + bytes(-len(data) % unit or (0 if data else unit))


def write_container(payload: bytes) -> bytes:
    """A file of one sound track that holds the payload, whole units of eight-bit samples, losslessly."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive number of whole units")
    n = len(payload) // UNIT
    duration = len(payload)
    chunks, rest = divmod(n, CHUNK)
    runs = ([(1, CHUNK, 1)] if chunks else []) + ([(chunks + 1, rest, 1)] if rest else [])
    sync = np.arange(1, n + 1, GROUP, dtype=">u4")
    mvhd = _full(b"mvhd", struct.pack(">4IIH10x", 0, 0, RATE, duration, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
    tkhd = _full(b"tkhd", struct.pack(">5I8xhhH2x", 0, 0, 1, 0, duration, 0, 0, 0x100), _MATRIX, bytes(8), flags=7)
    mdhd = _full(b"mdhd", struct.pack(">4IHH", 0, 0, RATE, duration, 0x55C4, 0))
    tables = (
        _full(b"stts", struct.pack(">3I", 1, n, UNIT)),
        _full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", *r) for r in runs)),
        _full(b"stsz", struct.pack(">2I", UNIT, n)),
    )
    count = chunks + (rest > 0)

    def moov(first: int) -> bytes:
        offsets = first + np.arange(count, dtype=np.int64) * (CHUNK * UNIT)
        wide = bool(count) and int(offsets[-1]) >= 1 << 32
        stco = _full(b"co64" if wide else b"stco", struct.pack(">I", count), offsets.astype(">u8" if wide else ">u4").tobytes())
        stbl = _box(b"stbl", _STSD, *tables, stco)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, _HDLR, _box(b"minf", _SMHD, _DINF, stbl))))

    # The payload stands before the tables, so that its place does not depend on their size.
    large = len(payload) + 8 >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if large else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return _FTYP + head + payload + moov(len(_FTYP) + len(head))


@dataclass
class Track:
    """What a track's boxes tell; sizes and offsets are of its samples, in order."""

    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sync: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def keyframes(self) -> list[tuple[int, int]]:
        """(offset, length) of every sync sample."""
        return list(zip(self.offsets[self.sync].tolist(), self.sizes[self.sync].tolist(), strict=True))


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the bodies of the boxes in a range; raises ValueError where a box leaves its range."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError(f"a box at {start} is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError(f"a box at {start} is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"a box at {start} leaves its range")
        yield kind, body, start + size
        start += size


def _table(data: bytes, at: int, columns: int, kind: str = ">u4") -> np.ndarray:
    count = struct.unpack_from(">I", data, at + 4)[0]
    return np.frombuffer(data, kind, count * columns, at + 8).astype(np.int64).reshape(count, columns)


def _sample_offsets(sizes: np.ndarray, runs: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """The place of every sample: chunks hold as many samples as their run says, one after the other."""
    if not len(chunks) or not len(runs):
        return np.zeros(0, np.int64)
    stops = np.append(runs[1:, 0], len(chunks) + 1)
    per_chunk = np.repeat(runs[:, 1], np.maximum(stops - runs[:, 0], 0))[: len(chunks)]
    first = np.cumsum(per_chunk) - per_chunk
    before = np.cumsum(sizes) - sizes
    chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)[: len(sizes)]
    return chunks[chunk] + before[: len(chunk)] - before[np.minimum(first[chunk], len(sizes) - 1)]


def read_tracks(data: bytes) -> list[Track]:
    """Codec, duration, and place and size of all samples of each track, from boxes and sample tables alone."""
    tracks: list[Track] = []

    def walk(start: int, end: int, found: dict) -> None:
        for kind, lo, hi in boxes(data, start, end):
            if kind == b"trak":
                inner: dict = {}
                walk(lo, hi, inner)
                tracks.append(_track(data, inner))
            elif kind in _CONTAINERS:
                walk(lo + _CONTAINERS[kind], hi, found)
            else:
                found[kind] = lo

    walk(0, len(data), {})
    return tracks


def _track(data: bytes, at: dict) -> Track:
    out = Track()
    try:
        if b"mdhd" in at:
            version = data[at[b"mdhd"]]
            out.timescale, out.duration = struct.unpack_from(">IQ" if version else ">II", data, at[b"mdhd"] + (20 if version else 12))
        if b"stsd" in at and struct.unpack_from(">I", data, at[b"stsd"] + 4)[0]:
            out.codec = data[at[b"stsd"] + 12 : at[b"stsd"] + 16].decode("latin-1")
        if b"stsz" in at:
            size, count = struct.unpack_from(">II", data, at[b"stsz"] + 4)
            out.sizes = np.full(count, size, np.int64) if size else np.frombuffer(data, ">u4", count, at[b"stsz"] + 12).astype(np.int64)
        runs = _table(data, at[b"stsc"], 3) if b"stsc" in at else np.zeros((0, 3), np.int64)
        chunks = _table(data, at[b"co64"], 1, ">u8")[:, 0] if b"co64" in at else _table(data, at[b"stco"], 1)[:, 0] if b"stco" in at else np.zeros(0, np.int64)
        out.offsets = _sample_offsets(out.sizes, runs, chunks)
        # Without a table of sync samples every sample is one.
        out.sync = _table(data, at[b"stss"], 1)[:, 0] - 1 if b"stss" in at else np.arange(len(out.offsets))
    except (struct.error, IndexError) as e:
        raise ValueError(f"a sample table is cut off: {e}") from e
    return out


def read_payload(data: bytes, track: Track) -> bytes:
    """The bytes of all samples, in order."""
    ends = track.offsets + track.sizes
    joins = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    lows = np.concatenate(([0], joins)).astype(np.int64)
    highs = np.concatenate((joins, [len(ends)])).astype(np.int64) - 1
    return b"".join(data[track.offsets[a] : ends[b]] for a, b in zip(lows, highs, strict=True)) if len(ends) else b""


def feature(track: Track) -> str:
    """Codec, rate, duration, number of samples and keyframe byte ranges as one string."""
    ranges = ",".join(f"{a}+{n}" for a, n in track.keyframes())
    return f"codec={track.codec.strip()};rate={track.timescale};duration={track.duration};samples={len(track.sizes)};keyframes={ranges}"


_MEDIA = "doc_id long, n_bytes long, media binary"
_INFO = "codec string, timescale long, duration long, samples long, keyframes array<struct<offset:long,length:long>>, error string"


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most BATCH_BYTES together, or one larger row."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > BATCH_BYTES:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        for lo, hi in _parts([len(x) for x in raw]):
            part = raw[lo:hi]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)).cast(pa.int64()), pa.array(map(len, part), pa.int64()), pa.array([write_container(pad(x)) for x in part], pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """A media column of texts: doc_id, n_bytes (of the text in UTF-8), media (the container), a row for each of docs.

    The text's bytes, filled up with bytes 0 to a positive multiple of 64, are the samples. Null texts
    count as empty; other columns are ignored. Rows that repeat, or have no doc_id, are stored each;
    an empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_store, _MEDIA)


def inspect(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """key and what the boxes of the column's first track tell; payloads are not decoded.

    A null, empty or broken container gives nulls and the reason in `error`. Rows that repeat come back
    as often; an empty table gives an empty result. The key may be null and of any type.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                try:
                    t = read_tracks(value.as_py() or b"")[0]
                    rows.append({"codec": t.codec.strip(), "timescale": t.timescale, "duration": t.duration, "samples": len(t.sizes), "keyframes": [{"offset": a, "length": n} for a, n in t.keyframes()], "error": None})
                except (ValueError, IndexError) as e:
                    rows.append({"codec": None, "timescale": None, "duration": None, "samples": None, "keyframes": None, "error": str(e)})
            kinds = pa.struct([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))), ("error", pa.string())])
            made = pa.array(rows, kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.flatten()], [key, *(f.name for f in kinds)])

    kind = dict(media.dtypes)[key]
    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, {_INFO}")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for value in batch.column(2):  # one container at a time
            data = value.as_py()
            track = read_tracks(data)[0]
            payload = read_payload(data, track)
            rows.append((len(payload), sha256(payload).hexdigest(), crc32(payload[-UNIT:]), len(data), sha256(data).hexdigest(), feature(track)))
        size, digest, tail, media, media_digest, text = zip(*rows, strict=True) if rows else ((),) * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(tail, pa.int64()), pa.array(media, pa.int64()), pa.array(media_digest, pa.string()), pa.array(text, pa.string())],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def read_back(media: DataFrame) -> DataFrame:
    """Digests of the stored containers and of the payloads read back from them by their sample tables, a row for each container.

    media: doc_id, n_bytes, media, as store() gives them; a null or broken container is an error. An
    empty table gives an empty result.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read_back, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
