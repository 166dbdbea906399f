"""Web archives: WARC records in Zstandard frames of their own, with a dictionary in a leading skippable frame."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterable, Iterator
from hashlib import sha256
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.session import Workspace

#: Skippable frame that holds the dictionary of a .warc.zst file.
SKIPPABLE = 0x184D2A5D
#: Bytes of an archive before compression, of its dictionary, and of the records that the dictionary is built from.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 20, 64 << 10, 4 << 20
#: Payloads from this size on are stored once.
LEAST_REVISIT = 100
_URN = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP head of its response, with the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''':/?#[]@!$&'()*+,;=%~''')}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary built from records spread evenly over the archive."""
    size = sum(map(len, records))
    step = max(1, -(-size // SAMPLE_BYTES))
    samples = records[::step]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), samples, k=512, d=8, f=18, accel=4, steps=1, level=3)
    except zstandard.ZstdError:  # too few records to train on: the records themselves serve
        raw = b"".join(records)[:DICTIONARY_BYTES]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None


def write_archive(records: list[bytes], level: int = 3) -> bytes:
    """The records, each compressed by itself, after the dictionary that is built from them."""
    found = _dictionary(records)
    if found is None:
        raw, compressor = b"", zstandard.ZstdCompressor(level=level)
    else:
        raw, compressor = found.as_bytes(), zstandard.ZstdCompressor(level=level, dict_data=found)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *map(compressor.compress, records)])


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record; header names are lower-case."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE or 8 + size > len(data):
        raise ValueError("the archive does not start with a dictionary frame")
    raw = data[8 : 8 + size]
    trained = raw[:4] == struct.pack("<I", 0xEC30A437)
    dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT) if raw else None
    reader = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(memoryview(data)[8 + size :], read_across_frames=True), 1 << 20)
    while line := reader.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("a record does not start with its version")
        headers: dict[str, str] = {}
        while (line := reader.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = reader.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]) or reader.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield headers, block


def _id(value: str) -> int | None:
    digits = value.strip("<>").removeprefix(_URN)
    return int(digits) if digits else None


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """Length, digest and bytes of a record's full payload; a revisit has no bytes and takes length and digest from its heads."""
    http, _, payload = block.partition(b"\r\n\r\n")
    if headers["warc-type"] == "response":
        return len(payload), sha256(payload).hexdigest(), payload
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return length, headers["warc-payload-digest"].removeprefix("sha256:"), None


def _archives(rows: Iterable[tuple], archive_bytes: int) -> Iterator[tuple[int, bytes]]:
    held: list[bytes] = []
    size = 0
    for page_id, url, payload, digest, refers_to in rows:
        held.append(record(page_id, url, payload or b"", digest, refers_to))
        size += len(held[-1])
        if size >= archive_bytes:
            yield len(held), write_archive(held)
            held, size = [], 0
    if held:
        yield len(held), write_archive(held)


def write(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of pages (page_id, url, html): n_records, archive (the bytes of one .warc.zst file of bounded size).

    A row gives one record, its payload the html in UTF-8 (null: empty). Of the rows with equal
    payloads of at least 100 bytes the one with the least page_id is the response and the others are
    revisits of it; smaller payloads, and rows without page_id, are responses, and so are rows that
    repeat the least page_id. Rows without url have no target. Other columns are ignored. A payload of
    any length is one record, in an archive that ends with it once it has archive_bytes; an empty
    table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(f"octet_length(payload) >= {LEAST_REVISIT} and page_id is not null").select("page_id", "digest")
    least = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "refers_to")
    # Written, so that the join with a digest that very many pages share can be split.
    least = Workspace(pages.sparkSession, "warc").write(least)
    # A revisit is known by page and digest, so that rows which share a page_id but not the html stay apart.
    revisits = large.join(least, "digest").where("page_id != refers_to").distinct()
    typed = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for n, data in _archives(each(), archive_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["n_records", "archive"])

    return typed.mapInArrow(run, "n_records long, archive binary")


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for every record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload if asked for.

    archives: a column archive, as write() gives it; other columns are ignored. A record without page_id
    or target has nulls there, and a revisit has no payload. An archive that is null, cut off or does
    not start with a dictionary frame is an error; an empty table gives an empty result.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]
        names = [x.strip().split(" ")[0] for x in schema.split(",")]
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for headers, block in read_archive(data):
                    length, digest, payload = payload_of(headers, block)
                    refers = headers.get("warc-refers-to")
                    rows.append((_id(headers["warc-record-id"]), headers.get("warc-target-uri"), length, digest, headers["warc-type"], _id(refers) if refers else None, *[payload] * payloads))
                columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return archives.select("archive").mapInArrow(run, schema)


def export(archives: DataFrame, folder: str) -> list[str]:
    """Writes each archive as a file of its own in a folder of the driver, one at a time, and returns their names.

    Only one archive (of write()'s bound) is held at once. For archives beyond what one machine writes,
    write the frame itself as a table. An empty table writes nothing.
    """
    names = []
    for i, row in enumerate(archives.toLocalIterator()):
        names.append(f"{folder}/part-{i:06d}.warc.zst")
        with open(names[-1], "wb") as f:
            f.write(row["archive"])
    return names
