"""Removal of globally repeated multi-line chunks (operator 8), in DataFrame functions only.

A text is split at line feeds. A rolling hash over the hashes of the last lines
says after which lines a chunk ends, so that an insertion moves boundaries only
near itself. Chunks of two lines or more that occur again anywhere are compared
byte for byte with their first occurrence (smallest key, then position) and
removed if they are equal to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import storage

#: A chunk ends after a line when the rolling hash of the last WINDOW lines is 0 modulo DIVISOR.
WINDOW = 2
DIVISOR = 3
MIN_LINES = 2
_MULTIPLIER = 31
_SPACE = 1 << 31


def line_hash(line: Column) -> Column:
    """The first 32 bits of the MD5 of a line, as a long."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunk_ends(hashes: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """Indexes (from 0) of the last line of each chunk; the last line always ends one."""

    def ends(i: Column) -> Column:
        rolled = F.lit(0).cast("long")
        for back in range(window - 1, -1, -1):
            own = F.when(i >= back, F.get(hashes, i - back)).otherwise(F.lit(0).cast("long"))
            rolled = (rolled * _MULTIPLIER + own) % _SPACE
        return (rolled % divisor == 0) | (i == F.size(hashes) - 1)

    return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), ends)


def chunked(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_lines`` and ``_ends`` (both null where the text is null)."""
    lined = df.withColumn("_lines", F.split(F.col(text), "\n", -1))
    return lined.withColumn("_hashes", F.transform("_lines", line_hash)).withColumn("_ends", chunk_ends(F.col("_hashes"))).drop("_hashes")


def _piece(no: Column) -> Column:
    """The text of a chunk of a row of chunked(), by its number."""
    start = F.when(no == 0, F.lit(0)).otherwise(F.get("_ends", no - 1) + 1)
    return F.array_join(F.slice("_lines", start + 1, F.get("_ends", no) - start + 1), "\n")


def _lines_of(no: Column) -> Column:
    return F.get("_ends", no) - F.when(no == 0, F.lit(-1)).otherwise(F.get("_ends", no - 1))


def _repeated(base: DataFrame) -> DataFrame:
    """For each text (_key, _fp) with chunks that occur more than once: ``_marks``, the
    number and hash of each and whether it is the first occurrence. No text is moved."""
    numbers = F.filter(F.sequence(F.lit(0), F.size("_ends") - 1), lambda no: _lines_of(no) >= MIN_LINES)
    hashed = chunked(base, "_text").select("_key", "_fp", F.explode(F.transform(numbers, lambda no: F.struct(no.alias("no"), F.xxhash64(_piece(no)).alias("h")))).alias("_p"))
    rows = hashed.select("_key", "_fp", F.col("_p.no").alias("_no"), F.col("_p.h").alias("_h"))
    where = F.struct("_key", "_no", "_fp")
    # written, so that the join has two plain exchanges and may split a hot chunk
    sums = storage.written(rows.groupBy("_h").agg(F.count("*").alias("_n"), F.min(where).alias("_first")).where("_n > 1").drop("_n"), "repeated")
    marks = rows.join(sums.hint("merge"), "_h").select("_key", "_fp", F.struct(F.col("_no").alias("no"), F.col("_h").alias("h"), (where == F.col("_first")).alias("first")).alias("_m"))
    return marks.groupBy("_key", "_fp").agg(F.collect_set("_m").alias("_marks"))


def _removed(base: DataFrame) -> DataFrame:
    """For each text (_key, _fp) with copies of earlier chunks: their numbers, ``_gone``.

    The texts of repeated chunks, and only those, meet their first occurrence and are compared with it.
    """
    marks = _repeated(base)
    held = chunked(base.join(marks.hint("merge"), ["_key", "_fp"]), "_text")
    chunk = F.transform("_marks", lambda m: F.struct(m["no"].alias("no"), m["h"].alias("h"), m["first"].alias("first"), _piece(m["no"]).alias("chunk")))
    texts = storage.written(held.select("_key", "_fp", F.explode(chunk).alias("_c")).select("_key", "_fp", "_c.*"), "chunks")
    first = storage.written(texts.where("first").groupBy("h").agg(F.min("chunk").alias("_of")), "first")
    copies = texts.where("NOT first").join(first.hint("merge"), "h").where(F.col("chunk").cast("binary") == F.col("_of").cast("binary"))
    gone = storage.written(copies.groupBy("_key", "_fp").agg(F.collect_set("no").alias("_gone")), "gone")
    storage.release(base.sparkSession, texts, first)
    storage.release_shuffles(base.sparkSession)
    return gone


def remove_repeated_chunks(df: DataFrame, key: str = "doc_id", text: str = "text", out: str | None = None) -> DataFrame:
    """All rows and columns of ``df`` with repeated chunks cut from ``text`` (or from a
    copy of it named ``out``), and ``n_lines``, ``n_removed`` (lines) beside them.

    The first occurrence of a chunk stays. Rows with a null text or key are
    unchanged, an empty text has one empty line, rows that repeat a key and text
    are all first occurrences together. Columns of ``df`` named like the added ones are replaced.
    By chunk only hashes and the texts of repeated chunks are shuffled, in joins that can
    split a hot chunk; whole texts are shuffled by key, once to take the repeated chunks from
    them and once to cut them. A task holds one text at a time, its lines and their hashes.
    """
    out = out or text
    usable = F.col("_key").isNotNull() & F.col("_text").isNotNull()
    base = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(usable).withColumn("_fp", F.xxhash64("_text"))
    gone = _removed(base)
    kept = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    others = [c for c in kept if c != text]
    whole = df.select(F.struct(*others).alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text")).withColumn("_fp", F.xxhash64("_text"))
    marked = chunked(whole.join(gone.hint("merge"), ["_key", "_fp"], "left"), "_text")
    numbers = F.sequence(F.lit(0), F.size("_ends") - 1)
    marked = marked.withColumn("_stay", F.when(F.col("_gone").isNotNull(), F.array_except(numbers, "_gone")))
    result = F.when(F.col("_stay").isNotNull(), F.array_join(F.transform("_stay", _piece), "\n")).otherwise(F.col("_text"))
    left = F.aggregate("_stay", F.lit(0), lambda n, no: n + _lines_of(no))
    columns = {c: F.col("_row")[c] for c in others} | ({text: F.col("_text")} if out != text else {})
    columns |= {out: result, "n_lines": F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long"), "n_removed": F.when(F.col("_stay").isNotNull(), F.size("_lines") - left).otherwise(F.lit(0)).cast("long")}
    names = [*[c for c in kept if c != out], out, "n_lines", "n_removed"]
    return marked.select(*[columns[c].alias(c) for c in names])


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL
), hashed AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h, max(pos) OVER (PARTITION BY doc_id) AS last FROM lines
), rolled AS (
  SELECT *, ((coalesce(lag(h) OVER d, 0) % {_SPACE}) * {_MULTIPLIER} + h) % {_SPACE} AS r FROM hashed WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), ended AS (
  SELECT *, CASE WHEN r % {DIVISOR} = 0 OR pos = last THEN 1 ELSE 0 END AS e FROM rolled
), numbered AS (
  SELECT *, sum(e) OVER (PARTITION BY doc_id ORDER BY pos) - e AS no FROM ended
), chunks AS (
  SELECT doc_id, no, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS chunk FROM numbered GROUP BY doc_id, no
), judged AS (
  SELECT *, n >= {MIN_LINES} AND row_number() OVER (PARTITION BY chunk, n >= {MIN_LINES} ORDER BY doc_id, no) > 1 AS gone FROM chunks
)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (WHERE gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
