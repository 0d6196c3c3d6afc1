"""Blocks into physical lines, headings and statements, with code-point offsets.

Everything is an array expression within one block's row: a block is never
shuffled, and the rows multiply only at the end, to statements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import frames, text

_BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"
_MARK = "\u0001"
_SENTENCE = r"(?<=[.!?])([ \t]+)(?=[\"'\[(]?[A-Z0-9])"
NUMBERED_RECOMMENDATION = r"(?iuU)^(Recommendation\s+(\d+))\s*[:\-–—]\s*(.+)$"
# Fixed values.
PROSE_MARKERS = ["will", "must", "shall", "is", "are", "was", "were", "has", "have", "had", "recommends", "recommended", "approved", "completed"]


def _with_starts(rows: DataFrame, pieces: str, out: str) -> DataFrame:
    """Adds ``out``: structs (piece, start) of the pieces that make up a text.

    Running sums are taken in runs of about the square root of the number of pieces, and
    every array that a lambda looks into is a column of its own, so that no
    expression over the whole text is evaluated again for each piece.
    """
    step = F.greatest(F.ceil(F.sqrt(F.size("_len"))).cast("int"), F.lit(1))
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size("_len") / step).cast("int") - 1), lambda k: F.slice("_len", k * step + 1, step))
    rows = rows.withColumn("_len", F.transform(pieces, F.length)).withColumn("_runs", runs)
    rows = rows.withColumn("_sums", F.transform("_runs", _total)).withColumn("_base", F.transform("_sums", lambda _, i: _total(F.slice("_sums", 1, i))))
    starts = F.flatten(F.zip_with("_runs", "_base", lambda run, base: F.transform(run, lambda _, i: base + _total(F.slice(run, 1, i)))))
    zipped = F.zip_with(pieces, starts, lambda piece, start: F.struct(piece.alias("piece"), start.alias("start")))
    return rows.withColumn(out, zipped).drop("_len", "_runs", "_sums", "_base")


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, b: a + b)


def _trimmed(pieces: str) -> Column:
    """Structs (text, start) without white space around; a transform of its own, for a lambda evaluates what it
    builds on anew wherever it names it."""

    def one(p: Column) -> Column:
        lead = F.length(F.regexp_extract(p["piece"], r"(?U)\A\s*+", 0))
        return F.struct(text.strip(p["piece"]).alias("text"), (p["start"] + lead).cast("int").alias("start"))

    return F.transform(pieces, one)


def is_heading(line: Column) -> Column:
    """Short lines that end in a colon, are upper-case, or have title-like words and no prose marker."""
    words = F.regexp_extract_all(line, F.lit(r"[A-Za-z0-9][A-Za-z0-9'&/\-]*"), F.lit(0))
    upper = (F.upper(line) == line) & (F.lower(line) != line)

    def worded(found: Column) -> Column:
        prose = F.exists(found, lambda w: F.lower(w).isin(PROSE_MARKERS))
        titled = F.size(F.filter(found, lambda w: F.substring(w, 1, 1).rlike("[A-Z]"))) >= F.greatest(F.lit(1), F.size(found) - 1)
        return (F.size(found) > 0) & (F.size(found) <= 12) & (upper | (~prose & titled))

    return (F.length(line) > 0) & (F.length(line) < 120) & (line.endswith(":") | (~line.rlike("[.!?]$") & text.bound(words, worded)))


def is_heading_v2(line: Column) -> Column:
    """As is_heading, but numbered recommendations are none."""
    return ~line.rlike(NUMBERED_RECOMMENDATION) & is_heading(line)


def lines(blocks: DataFrame, heading: Callable[[Column], Column] = is_heading, with_pending: bool = False) -> DataFrame:
    """Non-blank physical lines: ``line_number`` (of all lines, from 1), ``text``, ``start``,
    ``end``, ``heading`` and the heading that is the line just before, if any. With
    ``with_pending`` only lines of prose, each with the headings since the one before it."""
    pieces = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), f"({_BREAK})", "$1" + _MARK), _MARK)
    rows = _with_starts(blocks.withColumn("_pieces", pieces), "_pieces", "_lines")

    def line(p: Column, i: Column) -> Column:
        return F.struct((i + 1).alias("line_number"), p["text"].alias("text"), p["start"].alias("start"), (p["start"] + F.length(p["text"])).alias("end"), heading(p["text"]).alias("heading"))

    rows = rows.withColumn("_lines", F.transform(_trimmed("_lines"), line))

    def before(p: Column, i: Column) -> Column:
        last = F.when(i > 0, F.get("_lines", i - 1))
        name = F.regexp_replace(last["text"], r"(?U)\s*:\z", "")
        return F.struct(p["line_number"], p["text"], p["start"], p["end"], p["heading"], F.when(last["heading"], name).alias("context"), F.when(last["heading"], last["start"]).alias("context_start"))

    rows = rows.withColumn("_kept", F.filter(F.transform("_lines", before), lambda p: F.length(p["text"]) > 0))

    if with_pending:
        places = F.filter(F.sequence(F.lit(0), F.size("_kept") - 1), lambda k: (k >= 0) & ~F.get("_kept", F.greatest(k, F.lit(0)))["heading"])
        rows = rows.withColumn("_prose", F.when(F.size("_kept") > 0, places))

        def pending(at: Column, j: Column) -> Column:
            """The headings since the last line of prose."""
            last = F.when(j > 0, F.get("_prose", j - 1)).otherwise(F.lit(-1))
            found = F.transform(F.slice("_kept", last + 2, at - last - 1), lambda h: F.struct(F.regexp_replace(h["text"], r"(?U)\s*:\z", "").alias("text"), h["start"].alias("start")))
            return F.get("_kept", at).withField("pending", found)

        rows = rows.withColumn("_kept", F.transform("_prose", pending))
    rows = frames.exploded(rows, F.col("_kept"), "_line")
    kept = [c for c in blocks.columns if c != "text"]
    return rows.select(*kept, "_line.*")


def statements(blocks: DataFrame) -> DataFrame:
    """Statements of eligible blocks: lines that are no headings, split into sentences
    (numbered recommendations stay whole)."""
    chosen = blocks.where(F.col("block_type").isin(list(schemas.ELIGIBLE_BLOCK_TYPES)))
    prose = lines(chosen).where(~F.col("heading"))
    parts = F.when(F.col("text").rlike(NUMBERED_RECOMMENDATION), F.array("text")).otherwise(F.split(F.regexp_replace("text", _SENTENCE, _MARK + "$1"), _MARK))

    def part(p: Column) -> Column:
        return F.struct(p["text"].alias("text"), (F.col("start") + p["start"]).alias("start"), (F.col("start") + p["start"] + F.length(p["text"])).alias("end"))

    found = frames.exploded(_with_starts(prose.withColumn("_parts", parts), "_parts", "_placed"), F.transform(_trimmed("_placed"), part), "_part")
    return found.select("source_id", "block_id", "sequence", "block_type", "line_number", "_part.*", "context", "context_start").where(F.length("text") > 0)


_SENTENCE_V2 = r"(?U)([.!?]+)(?=\s|$)"
_LIST_MARK = r"(?U)\A(\s*(?:[A-Za-z]|\d+)\.+)" + _MARK


def statements_v2(blocks: DataFrame) -> DataFrame:
    """Statements of the second engine: sentences end at marks before white space, list
    marks such as "1." end none, and ``pending`` holds all headings since the last prose."""
    chosen = blocks.where(F.col("block_type").isin(list(schemas.ELIGIBLE_BLOCK_TYPES)))
    prose = lines(chosen, is_heading_v2, with_pending=True).where(~F.col("heading"))
    marked = F.regexp_replace(F.regexp_replace("text", _SENTENCE_V2, "$1" + _MARK), _LIST_MARK, "$1")

    def part(p: Column) -> Column:
        return F.struct(p["text"].alias("text"), (F.col("start") + p["start"]).alias("start"), (F.col("start") + p["start"] + F.length(p["text"])).alias("end"))

    found = frames.exploded(_with_starts(prose.withColumn("_parts", F.split(marked, _MARK)), "_parts", "_placed"), F.transform(_trimmed("_placed"), part), "_part")
    return found.select("source_id", "block_id", "sequence", "block_type", "line_number", "_part.*", "context", "context_start", "pending").where(F.length("text") > 0)
