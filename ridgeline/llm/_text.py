"""Vectorised text primitives shared by the operators: many texts become one flat array of code points."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Code points handled at a time; a longer text is handled alone.
CHUNK_CHARS = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def trim() -> None:
    """Gives freed memory of this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with memory given back after each partition: Python workers wait for the next task, and what they keep is lost to the executor."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_CHARS + CHUNK_CHARS // 4)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def chunks(texts: Sequence[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of consecutive texts of at most limit code points together, or one longer text."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) + 1 > limit:
            yield at, i
            at, size = i, 0
        size += len(text) + 1
    if at < len(texts):
        yield at, len(texts)


def flatten(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a line feed after each, and the start of each text (with the total size at the end)."""
    joined = "\n".join(texts) + "\n" if texts else ""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=starts[1:])
    return points, starts


def runs(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last element must be False."""
    edges = np.flatnonzero(member[1:] != member[:-1]) + 1
    if len(member) and member[0]:
        edges = np.concatenate(([0], edges))
    return edges[0::2], edges[1::2]


class SpanHasher:
    """64-bit hashes of spans of code points, by prefix sums of a polynomial in an odd base."""

    def __init__(self, points: np.ndarray):
        up, self.down = _POWERS.get(len(points) + 1)
        self.sums = np.zeros(len(points) + 1, U64)
        values = points.astype(U64)
        values += U64(0x632BE59BD9B4E019)
        mix(values)
        values *= up[: len(points)]
        np.cumsum(values, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = self.sums[ends] - self.sums[starts]
        out *= self.down[starts]
        out ^= (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
        return mix(out)


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span."""
    return SpanHasher(points).of(starts, ends)


#: Classes of code points in classes().
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_TABLES: list[np.ndarray] = []


def classes() -> tuple[np.ndarray, np.ndarray]:
    """The class and the lower case of every code point, by Python's Unicode tables, made once in each process."""
    if not _TABLES:
        kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
        for c in range(0x40000):
            char = chr(c)
            kind[c] = LETTER if char.isalpha() else NUMBER if char.isnumeric() else SPACE if char.isspace() else OTHER
            if len(low := char.lower()) == 1:
                lower[c] = ord(low)
        _TABLES.extend((kind, lower))
    return _TABLES[0], _TABLES[1]


def white_space(points: np.ndarray) -> np.ndarray:
    """The blank and the controls from tab to carriage return."""
    return (points == 32) | ((points >= 9) & (points <= 13))


def lower_ascii(points: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all else as it is."""
    return points + ((points >= 65) & (points <= 90)).astype(np.uint32) * np.uint32(32)


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's words start (with the total at the end)."""
    points, starts = flatten(texts)
    begin, end = runs(~white_space(points))
    return span_hashes(lower_ascii(points), begin, end), np.searchsorted(begin, starts)


def shingle_hashes(texts: Sequence[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of width words in order, and where each text's start.

    A text of fewer words has its whole sequence as the one shingle; a text without words has none.
    """
    words, at = word_hashes(texts)
    sizes = np.diff(at)
    counts = np.where(sizes >= width, sizes - width + 1, (sizes > 0).astype(np.int64))
    out_at = np.zeros(len(at), np.int64)
    np.cumsum(counts, out=out_at[1:])
    first = np.arange(out_at[-1]) - np.repeat(out_at[:-1] - at[:-1], counts)
    length = np.repeat(np.minimum(sizes, width), counts)
    padded = np.concatenate((words, np.zeros(width, U64)))
    out = length.astype(U64)
    for k in range(width):
        part = padded[first + k]
        if k:
            part[length <= k] = 0
        out *= U64(0xC2B2AE3D27D4EB4F)
        out += part
        mix(out)
    return out, out_at


def words_of(text: str) -> list[str]:
    """The words of one text: A-Z lower-cased, split at the blank and the controls from tab to carriage return."""
    return [w for w in text.translate(_LOWER).split(" ") if w]


_LOWER = {c: c + 32 for c in range(65, 91)} | {c: 32 for c in range(9, 14)}


def shingle_set(text: str, width: int) -> set[str]:
    """The distinct shingles of one text; words hold no blank, so the joined form is unambiguous."""
    words = words_of(text)
    if len(words) < width:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}
