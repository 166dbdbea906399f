"""Chat formatting by event-sourced reconstruction: logs of events become final messages, and these a marked-up text.

Events of a conversation are taken in sequence: `message` starts a message, `delta` appends to it,
`edit` replaces its text, `regenerate` empties it for the deltas or the edit that follow, and
`delete` drops it. Messages keep the place of their first event. The text of a turn stands between a header
and an end mark; inside texts every backslash, end mark and header mark is escaped, so the rendered
form reads back to exactly the turns it was made from.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: a turn is HEAD, the role, COLON, the text and END.
HEAD, COLON, END = "### ", ": ", " </turn>\n"
#: Roles whose texts are learned from, and the code points of a rendered piece.
LEARNED, PIECE_CHARS = ("assistant",), 1 << 18
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """text without a bare control string: a backslash stands before each, and before each backslash."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, int, int]]:
    """For each turn its marked-up text, and where in it the text under the loss mask starts and ends (0, 0: none)."""
    for role, text in turns:
        head, body = HEAD + escape(role).replace(":", "\\:") + COLON, escape(text)
        out = head + body + END
        yield out, *((len(head), len(head) + len(body)) if role in LEARNED else (0, 0))


def parse(text: str) -> tuple[str, str]:
    """Role and text of one rendered turn."""
    if not text.startswith(HEAD) or not text.endswith(END):
        raise ValueError("this is no rendered turn")
    inner = text[len(HEAD) : -len(END)]
    at = 0
    while inner[at] != ":":  # a bare colon ends the role
        at += 2 if inner[at] == "\\" else 1
    return unescape(inner[:at]), unescape(inner[at + len(COLON) :])


def split_turns(text: str) -> Iterator[tuple[int, int]]:
    """Where each turn of a rendered text starts and ends; inside roles and texts no end mark stands bare."""
    at = 0
    while at < len(text):
        stop = text.find(END, at)
        if stop < 0:
            raise ValueError("the last turn has no end")
        yield at, stop + len(END)
        at = stop + len(END)


class _Fold:
    """The messages of one conversation, folded from its events; finished ones leave as soon as no event can reach them."""

    def __init__(self) -> None:
        self.messages: dict[object, list] = {}

    def add(self, kind: str | None, message: object, role: str | None, text: str | None) -> None:
        kind = kind or "message"
        if kind == "delete":
            self.messages.pop(message, None)
            return
        found = self.messages.setdefault(message, [role or "", []])
        if kind in ("edit", "regenerate", "message"):
            found[1] = []
        if role:
            found[0] = role
        if text:
            found[1].append(text)

    def turns(self) -> Iterator[tuple[str, str]]:
        for role, parts in self.messages.values():
            yield role, "".join(parts)


_KINDS = ("message", "delta", "edit", "regenerate", "delete")
_FORMATTED = "conv_id long, piece long, formatted string, mask array<struct<start:long,end:long>>"


def _format(closed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(n).to_pylist() for n in ("conv_id", "kind", "message", "role", "text")), strict=True)

        def turns() -> Iterator[tuple[object, str, str]]:
            now, fold, started = None, _Fold(), False
            for conv, kind, message, role, text in rows():
                if started and conv != now:
                    for turn in fold.turns():
                        yield now, *turn
                    fold = _Fold()
                elif closed and fold.messages and message not in fold.messages:
                    for turn in fold.turns():  # logs whose messages come one after the other are never held whole
                        yield now, *turn
                    fold = _Fold()
                now, started = conv, True
                fold.add(kind, message, role, text)
            if started:
                for turn in fold.turns():
                    yield now, *turn

        def pieces() -> Iterator[tuple]:
            now, piece, text, mask, size, started = None, 0, [], [], 0, False
            for conv, role, body in turns():
                if started and (conv != now or size >= PIECE_CHARS):
                    yield now, piece, "".join(text), mask
                    piece = piece + 1 if conv == now else 0
                    text, mask, size = [], [], 0
                now, started = conv, True
                for out, lo, hi in render([(role, body)]):
                    text.append(out)
                    if role in LEARNED:
                        mask.append({"start": size + lo, "end": size + hi})
                    size += len(out)
            if started:
                yield now, piece, "".join(text), mask

        held: list[tuple] = []
        size = 0

        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            conv, piece, text, mask = zip(*held, strict=True) if held else ((),) * 4
            return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(piece, pa.int64()), pa.array(text, pa.string()), pa.array(mask, mask_type)], ["conv_id", "piece", "formatted", "mask"])

        for row in pieces():
            held.append(row)
            size += len(row[2])
            if size >= 4 * PIECE_CHARS:
                yield batch_of(held)
                held, size = [], 0
        yield batch_of(held)

    return run


def format_events(events: DataFrame, interleaved: bool = True) -> DataFrame:
    """Rendered conversations of events (conv_id, seq, kind, message, role, text).

    Returns conv_id, piece (from 0), formatted and mask (start and end, in code points of the piece,
    of each text to learn from). A conversation is its pieces in order; a piece ends with a whole turn.
    Events are dealt by conversation and sorted by seq, of any type that can be sorted (then kind,
    role, text and message, so ties have one order). A null kind counts as message, a null text as
    empty, a null role leaves the role as it is; an unknown kind is an error. Rows with a null conv_id
    are one conversation. With interleaved=False a message's events must follow one another; then only
    one message is held at a time, however long the conversation is. Other columns are ignored. An
    empty table gives an empty result.
    """
    fields = [F.col("conv_id").cast("long").alias("conv_id"), F.col("seq"), F.col("kind").cast("string").alias("kind"), F.col("message").cast("long").alias("message"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    rows = events.select(*fields)
    known = F.coalesce(F.col("kind").isin(*_KINDS), F.lit(True))
    rows = rows.withColumn("kind", F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), F.col("kind")))))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind", "role", "text", "message")
    return dealt.select("conv_id", "kind", "message", "role", "text").mapInArrow(_format(not interleaved), _FORMATTED)


#: What a turn's log says before it is edited or made again.
_DRAFT = "draft </turn> ### user: "


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """A log whose fold is the turns (conv_id, turn, role, text): seq, kind, message, role and text of each event.

    By a hash of conversation and turn, a turn is logged in one of four ways: as one message; as a
    message and two streamed deltas; as a draft and an edit; or as a draft, a regeneration and two
    deltas. Every row is a message of its own, also where rows repeat a turn; such turns stand in
    the order of a hash of role and text. Null texts are logged as null.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = turns.withColumn("message", F.monotonically_increasing_id()).withColumn("way", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)))
    text, size = F.col("text"), F.length("text")
    first, second = F.floor(size / 3).cast("int"), F.floor(2 * size / 3).cast("int")
    thirds = text.substr(F.lit(1), first), text.substr(first + 1, second - first), text.substr(second + 1, size - second)

    def log(*steps: tuple[str, Column]) -> Column:
        return F.array(*(F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), (F.col("role") if k == 0 else F.lit(None).cast("string")).alias("role"), body.alias("text")) for k, (kind, body) in enumerate(steps)))

    draft, none = F.lit(_DRAFT), F.lit(None).cast("string")
    ways = [
        log(("message", text)),
        log(("message", thirds[0]), ("delta", thirds[1]), ("delta", thirds[2])),
        log(("message", draft), ("delta", draft), ("edit", text)),
        log(("message", draft), ("regenerate", none), ("delta", F.concat(thirds[0], thirds[1])), ("delta", thirds[2])),
    ]
    logged = F.when(F.col("way") == 0, ways[0]).when(F.col("way") == 1, ways[1]).when(F.col("way") == 2, ways[2]).otherwise(ways[3])
    seq = F.struct("turn", F.xxhash64("role", "text").alias("order"), "message", F.col("event.step").alias("step"))
    return turns.withColumn("event", F.explode(logged)).select("conv_id", seq.alias("seq"), "event.kind", "message", "event.role", "event.text")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    state = None  # conv, turns, digest of turns, code points under the mask, digest of these, code points in all

    def done() -> None:
        if state:
            out.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

    for batch in batches:
        for conv, text, mask in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if state is None or state[0] != conv:
                done()
                state = [conv, 0, sha256(), 0, sha256(), 0]
            for lo, hi in split_turns(text):
                role, body = parse(text[lo:hi])
                state[1] += 1
                state[2].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            for span in mask:
                learned = unescape(text[span["start"] : span["end"]])
                state[3] += len(learned)
                state[4].update(learned.encode("utf-8", "surrogatepass"))
            state[5] += len(text)
        if len(out) >= 1000:
            yield _digest_batch(out)
            out = []
    done()
    yield _digest_batch(out)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * 6
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of the turns read from rendered conversations, as format_events() deals them.

    The pieces of a conversation must follow one another in a partition. A turn that cannot be read is
    an error; an empty table gives an empty result.
    """
    return formatted.select("conv_id", "piece", "formatted", "mask").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
