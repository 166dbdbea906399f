"""Byte-pair encoding and decoding of whole texts in numpy.

Texts of a batch become one array of code points. Word boundaries follow the tokenizer's own
pattern (letters, single numbers, other symbols, English contractions) and are found by character
class, a hash of each word finds its ids in a sorted table of words met before (whose letters are then
compared), and the words that are new are merged together: their symbols lie in one flat array, and
each round looks up neighbouring pairs by binary search in the sorted pair keys. Rounds of short words
merge every word's pair of lowest rank. Rounds of long words go by rank over all of them and look up
only the pairs beside a merge, so the work grows with the number of letters, not with its square.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase, Sequence as Normalizers
from tokenizers.pre_tokenizers import Split

from ridgeline.llm import _text

_LETTER, _NUMBER, _SPACE, _LAST = 1, 2, 3, 0x40000
#: Words kept between batches; beyond it the table starts anew.
KEEP_WORDS = 400_000
#: Bytes from which a word's rounds look up only the pairs beside a merge.
LONG_WORD = 64
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_NO_RANK = np.iinfo(np.int64).max


def default_vocabulary() -> str:
    """Where the public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _classes() -> np.ndarray:
    """The class of every code point, letter, number, white space or other, by the Unicode tables of the tokenizers library."""
    out = np.zeros(0x110000, np.uint8)
    points = np.r_[0:0xD800, 0xE000:_LAST]  # the planes beyond hold no letters, numbers or white space
    everything = points.astype("<u4").tobytes().decode("utf-32-le")
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for _, (start, end) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(everything):
            out[points[start:end]] = kind
    return out


def _newer() -> np.ndarray:
    """Whether a code point is unknown to Python's own Unicode tables, which may be older than the library's."""
    category = unicodedata.category
    out = np.zeros(0x110000, bool)
    out[:_LAST] = np.fromiter((category(chr(c)) == "Cn" for c in range(_LAST)), bool, _LAST)
    return out


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    at = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - at, sizes)


class WordBpe:
    """A word-end byte-pair vocabulary with the normaliser, the word pattern and the special tokens of its file."""

    def __init__(self, path: str | None = None, keep_words: int = KEEP_WORDS):
        with open(path or default_vocabulary(), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocabulary: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 << 20
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in merges], np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank, self.pair_made = keys[order], order.astype(np.int64), made[order]
        self.made_by_rank = made
        symbols = _byte_symbols()
        self.first = np.array([vocabulary[s] for s in symbols], np.int64)
        self.last = np.array([vocabulary[s + end] for s in symbols], np.int64)
        self.tokens = [""] * (max(*vocabulary.values(), *self.special.values()) + 1)
        for token, i in (vocabulary | self.special).items():
            self.tokens[i] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.classes, self.newer = _classes(), _newer()
        self.full_normaliser = Normalizers([NFC(), Lowercase()])
        self.keep_words = keep_words
        self._reset()

    # Words met before: sorted hashes, and for each its ids as a slice of one flat array.
    def _reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.known_start = np.zeros(0, np.int64)
        self.known_size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int64)
        self.letter_start = np.zeros(0, np.int64)
        self.letter_size = np.zeros(0, np.int64)
        self.letters = np.zeros(0, np.uint32)

    def merge_words(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words whose UTF-8 bytes lie one after the other in data, and how many each word has."""
        long = sizes > LONG_WORD
        if not long.any():
            return self._merge_short(data, sizes)
        inside = np.repeat(long, sizes)
        parts = [self._merge_short(data[~inside], sizes[~long]), self._merge_long(data[inside], sizes[long])]
        counts = np.empty(len(sizes), np.int64)
        for mask, (_, got) in zip((~long, long), parts, strict=True):
            counts[mask] = got
        out = np.empty(counts.sum(), np.int64)
        owner = np.repeat(long, counts)
        for mask, (ids, _) in zip((~owner, owner), parts, strict=True):
            out[mask] = ids
        return out, counts

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; pairs that are no merge have _NO_RANK."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_rank[at], _NO_RANK)

    def _merge_long(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge_words() by rank: all pairs of the lowest rank of any word merge together, and only the pairs beside them are looked up anew.

        Words do not touch, so each word's own order of merges is kept.
        """
        n = len(data)
        ends = np.cumsum(sizes)
        ids = self.first[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # the neighbouring symbols of the word, -1 where there is none
        after[ends - 1], before[ends - sizes] = -1, -1
        rank = np.full(n, _NO_RANK)  # of the pair that starts at a symbol
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look_up(places: np.ndarray) -> None:
            found = rank[places] = self._ranks(ids[places], ids[after[places]])
            places, found = places[found != _NO_RANK], found[found != _NO_RANK]
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for part in np.split(places, cuts) if len(places) else ():
                r = int(rank[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(part)

        look_up(np.flatnonzero(after >= 0))
        while ranks:
            r = heapq.heappop(ranks)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[alive[places] & (rank[places] == r)]
            if not len(places):
                continue
            # Overlapping occurrences (a a a): in a run of neighbours every second one counts, from the left.
            begins = np.append(True, after[places[:-1]] != places[1:])
            index = np.arange(len(places))
            places = places[(index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0]
            right = after[places]
            far = after[right]
            ids[places] = self.made_by_rank[r]
            alive[right] = False
            rank[right] = rank[places] = _NO_RANK
            after[places] = far
            has = far >= 0
            before[far[has]] = places[has]
            left = before[places]
            look_up(np.unique(np.concatenate((places[has], left[left >= 0]))))
        return ids[alive], np.add.reduceat(alive.astype(np.int64), ends - sizes)

    def _merge_short(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge_words() with all words in each round; a word of n bytes ends after n - 1 rounds at most."""
        ends = np.cumsum(sizes)
        ids = self.first[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_ids, done_word = [], []
        while len(ids):
            keys = np.where(word[1:] == word[:-1], ids[:-1] * self.size + ids[1:], -1)
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            hit = self.pair_keys[at] == keys
            rank = np.append(np.where(hit, self.pair_rank[at], _NO_RANK), _NO_RANK)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, starts)
            span = np.diff(np.append(starts, len(ids)))
            active = np.repeat(least != _NO_RANK, span)
            if not active.all():  # words without a further merge leave the array
                done_ids.append(ids[~active])
                done_word.append(word[~active])
                made = np.append(self.pair_made[at], 0)[active]
                ids, word, rank = ids[active], word[active], rank[active]
                span, least = span[least != _NO_RANK], least[least != _NO_RANK]
                if not len(ids):
                    break
            else:
                made = np.append(self.pair_made[at], 0)
            chosen = rank == np.repeat(least, span)
            # Overlapping occurrences (a a a): in a run of chosen neighbours every second one counts, from the left.
            index = np.arange(len(ids))
            begins = chosen & ~np.append(False, chosen[:-1])
            run_start = np.maximum.accumulate(np.where(begins, index, 0))
            chosen &= (index - run_start) % 2 == 0
            ids = np.where(chosen, made, ids)
            keep = ~np.append(False, chosen[:-1])
            ids, word = ids[keep], word[keep]
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        all_word = np.concatenate(done_word)
        order = np.argsort(all_word, kind="stable")
        return np.concatenate(done_ids)[order], np.bincount(all_word, minlength=len(sizes))

    def _words(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words in normalised code points."""
        kind = self.classes[points]
        change = np.empty(len(points), bool)
        change[0] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:])
        change |= kind == _NUMBER
        quotes = np.flatnonzero((points == 39) & change)
        for q in quotes:  # a contraction counts where an apostrophe starts a word
            tail = "".join(map(chr, points[q : q + 3]))
            for c in _CONTRACTIONS:
                if tail.startswith(c):
                    stop = q + len(c)
                    change[q + 1 : stop] = False
                    # An apostrophe after the contraction starts a run of its own and so is looked at when its turn comes.
                    if stop < len(points) and kind[stop] != _SPACE:
                        change[stop] = True
                    break
        bounds = np.flatnonzero(change)
        words = kind[bounds] != _SPACE
        return bounds[words], np.append(bounds[1:], len(points))[words]

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # the vocabulary's rule knows no final sigma
                text = text.replace("Σ", "σ")
        return text.lower()

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and where each text's start (with the total at the end)."""
        parts: list[str] = []
        owner: list[int] = []
        marks: list[tuple[int, int]] = []  # a special token stands before the part of that number
        for i, text in enumerate(texts):
            if "<|" in text and self.split_special.search(text):
                at = 0
                for m in self.split_special.finditer(text):
                    parts.append(text[at : m.start()])
                    owner.append(i)
                    marks.append((len(parts), self.special[m[0]]))
                    at = m.end()
                text = text[at:]
            parts.append(text)
            owner.append(i)
        ids, counts = [], []
        for lo, hi in _text.chunks(parts):
            got, at = self._encode_parts(parts[lo:hi])
            ids.append(got)
            counts.append(np.diff(at))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        sizes = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        owners = np.array(owner, np.int64)
        if marks:
            ends = np.cumsum(sizes)
            where = np.array([p for p, _ in marks])
            flat = np.insert(flat, ends[where - 1], [t for _, t in marks])
            sizes = sizes.copy()
            np.add.at(sizes, where - 1, 1)
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.bincount(owners, sizes, len(texts)).astype(np.int64), out=starts[1:])
        return flat, starts

    def _encode_parts(self, parts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        points, at = _text.flatten([self.normalise(p) for p in parts])
        if self.newer[points].any():
            points, at = _text.flatten([self.full_normaliser.normalize_str(p) for p in parts])
        starts, ends = self._words(points)
        first_word = np.searchsorted(starts, at)
        hashes = _text.span_hashes(points, starts, ends)
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        found = np.searchsorted(self.known, unique)
        if len(self.known):
            missing = self.known[np.minimum(found, len(self.known) - 1)] != unique
        else:
            missing = np.ones(len(unique), bool)
        if missing.any():
            if len(self.known) > self.keep_words:
                self._reset()
                missing[:] = True
            new = where[missing]
            ids, counts = self._merged(points, starts[new], ends[new])
            place = np.searchsorted(self.known, unique[missing])
            size = ends[new] - starts[new]
            for name, values in (("known", unique[missing]), ("known_start", len(self.flat) + np.cumsum(counts) - counts), ("known_size", counts), ("letter_start", len(self.letters) + np.cumsum(size) - size), ("letter_size", size)):
                setattr(self, name, np.insert(getattr(self, name), place, values))
            self.flat = np.concatenate((self.flat, ids))
            self.letters = np.concatenate((self.letters, points[_spread(starts[new], size)]))
            found = np.searchsorted(self.known, unique)
        entry = found[inverse]
        word_start, word_size = self.known_start[entry], self.known_size[entry]
        flat = self.flat
        other = self._others(points, starts, ends, entry)
        if len(other):  # another word with the same hash: merged by itself
            ids, counts = self._merged(points, starts[other], ends[other])
            word_start[other], word_size[other] = len(flat) + np.cumsum(counts) - counts, counts
            flat = np.concatenate((flat, ids))
        token_at = np.append(0, np.cumsum(word_size))
        return flat[_spread(word_start, word_size)], token_at[first_word]

    def _merged(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = [points[s:e].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace") for s, e in zip(starts, ends, strict=True)]
        return self.merge_words(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))

    def _others(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """The words whose letters are not those of their entry."""
        other = ends - starts != self.letter_size[entry]
        if len(starts):
            # The letters beside the whole text; what stands between words is passed over.
            first, kind = starts[0], np.int32 if len(points) + len(self.letters) < 1 << 30 else np.int64
            index = np.repeat((self.letter_start[entry] - starts).astype(kind), np.diff(np.append(starts, len(points))))
            index += np.arange(first, len(points), dtype=kind)
            np.minimum(index, len(self.letters) - 1, out=index)
            text = points[first:]
            differs = np.flatnonzero((self.letters[index] != text) & (text != 32)) + first
            if len(differs):
                word = np.searchsorted(starts, differs, side="right") - 1
                other[word[differs < ends[word]]] = True
        return np.flatnonzero(other)

    def ids_text(self, ids: np.ndarray) -> str:
        """Decimal ids joined by one blank."""
        return " ".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. The vocabulary's file names no decoder; then decoding joins the tokens by one blank."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_LOADED: dict[str | None, WordBpe] = {}


def loaded(path: str | None) -> WordBpe:
    """The vocabulary, read once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def _encode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _text.chunks(texts):
                flat, at = bpe.encode(texts[lo:hi])
                ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], ["doc_id", "ids"])

    return run


def _decode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            ids = batch.column(1)
            flat, at = ids.flatten().to_numpy(), np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())))
            texts = [bpe.decode(flat[lo:hi]) for lo, hi in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def _digest(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _text.chunks(texts):
                flat, at = bpe.encode(texts[lo:hi])
                slices = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                ids = [sha256(bpe.ids_text(x).encode()).hexdigest() for x in slices]
                back = [sha256(bpe.decode(x).encode()).hexdigest() for x in slices]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _pair(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token ids of whole texts: (doc_id, ids array<int>), a row for each row of docs (doc_id, text).

    Other columns are ignored. A null or empty text has no ids. Rows that repeat are encoded each.
    path: the vocabulary file on the executors; by default that of the public package.
    """
    return _pair(docs).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Texts of token ids: (doc_id, text) of (doc_id, ids), a row for each row. Null or no ids give an empty text; an empty table gives an empty result."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """What encode() and decode() give, as counts and digests in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A row for each row of docs (doc_id, text), also where rows repeat or have no doc_id; other columns
    are ignored. A null or empty text has no ids. An empty table gives an empty result.
    """
    return _pair(docs).mapInArrow(_digest(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
