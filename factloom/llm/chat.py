r"""Chat formatting (operator 13): event-sourced reconstruction, then rendering.

A log of events is partitioned by conversation and sorted by sequence; streamed deltas, edits
and regenerations are folded into final messages, each of which is rendered as one piece of its
conversation's formatted text:

    ### assistant:
    the text
    </turn>

Control strings inside a text get a backslash before them. Marks of the template stand at a line's
start, so none has one: taking one backslash away from before each control string gives the text
back. Headers end with their line; line feeds and backslashes in roles are escaped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrow

#: Turns of this role are learned from.
LEARNED = "assistant"
#: Rendered pieces of an Arrow batch, and characters after which it is handed on.
BATCH_PIECES, BATCH_CHARS = 2000, 4 << 20

# The template's marks.
_HEAD, _FOOT = "### ", "</turn>"
_PLAIN = re.compile(f"(?={re.escape(_HEAD)}|{re.escape(_FOOT)})")
_ESCAPED = re.compile(rf"\\(?={re.escape(_HEAD)}|{re.escape(_FOOT)})")
_TURN = re.compile(rf"{re.escape(_HEAD)}([^\n]*):\n(.*?)\n{re.escape(_FOOT)}\n", re.DOTALL)
_ORDER = ["conv_id", "turn", "message", "seq", "kind", "role", "text"]


def escape(text: str) -> str:
    return _PLAIN.sub(r"\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def conversation_log(rows: DataFrame) -> DataFrame:
    """The events behind rows (conv_id, turn, role, text): (conv_id, turn, message, seq, kind, role, text).
    Texts of the learned role are streamed, a delta for each line; others are posted at once. Rows of one
    turn are messages of their own, in order of role and a hash of the text."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    # told apart by place in the scan only where all else is equal
    message = F.concat_ws(":", role, F.hex(F.xxhash64(text)), F.monotonically_increasing_id())
    event = lambda kind, of, what: F.struct(F.lit(kind).alias("kind"), of.alias("role"), what.alias("text"))
    none = F.lit(None).cast("string")
    lines = F.transform(F.split(text, "(?<=\n)"), lambda line: event("delta", none, line))
    events = F.when(role == LEARNED, F.concat(F.array(event("post", role, none)), lines)).otherwise(F.array(event("post", role, text)))
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), message.alias("message"), events.alias("_events"))
    return out.select("conv_id", "turn", "message", F.posexplode("_events").alias("seq", "_e")).select("conv_id", "turn", "message", F.col("seq").cast("long").alias("seq"), "_e.*")


def fold(events: Iterable[tuple]) -> Iterator[tuple]:
    """(conversation, role, text) of each message, from events (conversation, turn, message, seq, kind, role, text)
    in order. ``post`` opens a message, ``delta`` adds to its text, ``edit`` puts another text in its
    place, ``regenerate`` starts it anew; other kinds say nothing. A seq that a message has had is a
    repetition and does not count. The last role given holds."""
    now, role, text, last = None, "", [], None
    for conversation, turn, message, seq, kind, of, what in events:
        if now is None or now != (conversation, turn, message):
            if now is not None:
                yield now[0], role, "".join(text)
            now, role, text, last = (conversation, turn, message), "", [], None
        if seq is not None and seq == last:
            continue
        last = seq
        role = role if of is None else of
        if kind in ("post", "delta"):
            text.append(what or "")
        elif kind in ("edit", "regenerate"):
            text = [what or ""]
    if now is not None:
        yield now[0], role, "".join(text)


def render(log: DataFrame) -> DataFrame:
    """(conv_id, piece, start, text, loss_start, loss_end): each conversation's formatted text in pieces, a turn
    each, where each piece starts in it, and which characters of it are learned from (null: none).
    All numbers are code points from 0.

    One exchange by conversation; a task holds one message at a time, however long its conversation.
    Null conv_id is a conversation of its own; null turns, messages and seqs come first; null roles and texts are ''.
    """
    log.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrow.BATCH_ROWS))
    rows = log.select(*_ORDER).repartition("conv_id").sortWithinPartitions(*_ORDER)
    kind = arrow._arrow_schema(rows.select("conv_id").schema).field(0).type
    schema = pa.schema([("conv_id", kind), ("piece", pa.int64()), ("start", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches):
        events = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out, chars = [], 0
        now, piece, start = object(), 0, 0
        for conversation, role, text in fold(events):
            if conversation != now:
                now, piece, start = conversation, 0, 0
            head, body = f"{_HEAD}{escape_role(role)}:\n", escape(text)
            whole = f"{head}{body}\n{_FOOT}\n"
            at = start + len(head)
            learned = (at, at + len(body)) if role == LEARNED else (None, None)
            out.append((conversation, piece, start, whole, *learned))
            piece, start, chars = piece + 1, start + len(whole), chars + len(whole)
            if len(out) >= BATCH_PIECES or chars >= BATCH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out, chars = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    name = rows.schema["conv_id"].dataType.simpleString()
    return arrow.mapped(rows, run, f"conv_id {name}, piece long, start long, text string, loss_start long, loss_end long")


class _Reader:
    """Reads one conversation's formatted text as it comes: turns, what is under the mask, and digests of both."""

    def __init__(self):
        self.left, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.said, self.learned = hashlib.sha256(), hashlib.sha256()

    def take(self, text: str, span: tuple[int, int] | None) -> None:
        self.chars += len(text)
        if span is not None:
            plain = unescape(text[span[0] : span[1]])
            self.loss_chars += len(plain)
            self.learned.update(plain.encode())
        self.left += text
        at = 0
        while found := _TURN.match(self.left, at):
            at = found.end()
            self.turns += 1
            self.said.update(f"{unescape_role(found[1])}\n{unescape(found[2])}\n".encode())
        self.left = self.left[at:]

    def row(self) -> tuple:
        if self.left:
            raise ValueError("a formatted text does not end with a whole turn")
        return self.turns, self.said.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """One row a conversation, read from its formatted text alone: conv_id, n_turns, turns_sha256 (role, line feed,
    text, line feed of each turn), loss_chars and loss_sha256 (of all text under the mask, unescaped), and
    formatted_chars. ``in_order``: the rows are what ``render`` gave, each conversation's pieces together
    and in order, and need no exchange; pieces that are not are an error either way."""
    formatted.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrow.BATCH_ROWS))
    rows = formatted.select("conv_id", "piece", "start", "text", "loss_start", "loss_end")
    if not in_order:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    kind = arrow._arrow_schema(rows.select("conv_id").schema).field(0).type
    schema = pa.schema([("conv_id", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        now, reader, out = None, None, []
        for batch in batches:
            for conversation, piece, start, text, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece == 0:
                    if reader is not None:
                        out.append((now, *reader.row()))
                    now, reader = conversation, _Reader()
                if reader is None or conversation != now or start != reader.chars:
                    raise ValueError("pieces are not in order")
                reader.take(text, None if first is None else (first - start, last - start))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if reader is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip((now, *reader.row())), schema, strict=True)], schema=schema)

    name = rows.schema["conv_id"].dataType.simpleString()
    return arrow.mapped(rows, run, f"conv_id {name}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
x AS (SELECT *, length(role) + length(text) + 15
             + CAST((length(text) - length(replace(text, '### ', ''))) / 4 + (length(text) - length(replace(text, '</turn>', ''))) / 7 AS BIGINT) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role)) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id"""
