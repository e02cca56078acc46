"""Chat formatting: messages are folded from event logs, then rendered with a reversible template and a loss mask."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Fixed strings of the template.
OPEN, CLOSE = "### {role}:\n", "\n</turn>\n"
#: Each of these characters inside a role or text is preceded by a backslash, so no control string can appear in one.
_CONTROL = re.compile(r"[\\#<]")
_ROLE_CONTROL = re.compile(r"[\\#<:\n]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_SEGMENT = re.compile(r"### ((?:[^\\#<:\n]|\\.)*):\n((?:[^\\#<]|\\.)*)\n</turn>\n", re.S)

EVENT = "conv_id long, turn long, seq long, kind string, role string, text string"


def escape(text: str, pattern: re.Pattern = _CONTROL) -> str:
    return pattern.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's formatted text, and where its loss span starts and ends in it (equal unless the assistant speaks)."""
    head = OPEN.format(role=escape(role, _ROLE_CONTROL))
    body = escape(text)
    start = len(head)
    return head + body + CLOSE, start, start + len(body) if role == "assistant" else start


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from formatted text, any number of turns."""
    out, at = [], 0
    while at < len(formatted):
        m = _SEGMENT.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def log_of(conversations: DataFrame) -> DataFrame:
    """An event log that streams each row as a chat service would: open, deltas, for assistants a discarded first draft.

    Rows with equal (conv_id, turn) are separate turns, in the order of role and text; `copy` keeps the events of equal
    rows apart (any order of equal rows gives one result). Null texts and roles are empty.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    half = (F.length(t) / 2).cast("int")
    base = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), t.alias("text"), half.alias("half")
    )
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    first, second = F.expr("substring(text, 1, half)"), F.expr("substring(text, half + 1)")
    empty = F.lit("")
    user = F.array(event("open", empty), event("delta", first), event("edit", F.col("text")))
    other = F.array(event("open", empty), event("delta", first), event("regenerate", empty), event("delta", first), event("delta", second))
    steps = base.withColumn("e", F.when(F.col("role") == "user", user).otherwise(other))
    steps = steps.withColumns({"tie": F.xxhash64("role", "text"), "copy": F.monotonically_increasing_id()})
    return steps.select("conv_id", "turn", "tie", "copy", "role", F.posexplode("e").alias("seq", "e")).select(
        "conv_id", "turn", "tie", "copy", F.col("seq").cast("long").alias("seq"), "role", F.col("e.kind").alias("kind"), F.col("e.text").alias("text")
    )


def fold(events):
    """Messages (conv_id, turn, role, text) from one conversation-ordered run of events, one at a time.

    open starts a message; delta appends to it; edit replaces its text; regenerate discards what it has. A delta
    or edit without an open one starts a message itself. Memory is that of one message.
    """
    now = None
    for conv, turn, kind, role, text in events:
        key = (conv, turn)
        if kind == "open" or now is None or now[0] != key:
            if now is not None:
                yield (*now[0], now[1], "".join(now[2]))
            now = [key, role, []]
        if kind == "delta":
            now[2].append(text)
        elif kind == "edit":
            now[2] = [text]
        elif kind == "regenerate":
            now[2] = []
    if now is not None:
        yield (*now[0], now[1], "".join(now[2]))


def _rows(batches, names):
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names))


def _batches(rows, schema: pa.Schema, size: int = 1024):
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32())])


def reconstruct(log: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end): each final message rendered, conversations whole and in order.

    The log is dealt by conversation and sorted by sequence; the sort spills, and the fold holds one message,
    so a conversation of any length streams through its task. Offsets are code points within `formatted`. Null roles and
    texts are empty as log_of() has them, null conversations are one, null turns come first; empty texts are turns; events of
    equal rows stay apart by `copy`. An empty log gives an empty table.
    """

    def run(batches):
        rows = _rows(batches, ("conv_id", "turn", "kind", "role", "text"))
        yield from _batches(((c, t, *render_turn(role, text)) for c, t, role, text in fold(rows)), _SEGMENTS)

    ordered = log.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie", "role", "copy", "seq")
    return map_batches(ordered, run, "conv_id long, turn long, formatted string, loss_start int, loss_end int")


def digests(segments: DataFrame) -> DataFrame:
    """One row per conversation, read back from rendered segments that lie in order, conversation by conversation.

    Empty texts count as turns without loss; a conversation without an assistant has the digest of no text; a null
    conversation is one of its own; segments that repeat are turns of their own. No segments give no rows.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def walk(batches):
        now = None
        for conv, formatted, start, end in _rows(batches, ("conv_id", "formatted", "loss_start", "loss_end")):
            if now is None or now[0] != conv:
                if now is not None:
                    yield (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_turns(formatted):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
            loss = unescape(formatted[start:end])
            now[3] += len(loss)
            now[4].update(loss.encode())
            now[5] += len(formatted)
        if now is not None:
            yield (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

    def run(batches):
        yield from _batches(walk(batches), schema)

    return map_batches(segments, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
