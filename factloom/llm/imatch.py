"""I-Match document fingerprints (operator 4), in DataFrame functions only.

Document frequencies of terms are counted over all texts. The lexicon is all terms
within a band of inverse document frequency, given by its complement: the terms that are too
common, of which there are few whatever the corpus. A text's distinct lexicon
terms are sorted. Each of SUBSETS random draws orders the lexicon into nested subsets, each
about half of the one before; the text's signature is the hash of its terms in the sparsest
subset that has any. So a signature covers one or a few terms in short and in long texts
alike, and survives an edit that leaves these alone. Draws are independent and their subsets overlap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The band of log(N / df) / log(N). Its upper end is a term in one text only.
BAND = (0.25, 1.0)
#: Random draws of nested lexicon subsets, four from each hash of a term.
SUBSETS = 32
_DRAWS = 4
#: A subset has so many terms of a text at most: the first in the order of its draw.
MOST_TERMS = 8
_LETTERS = "[^\\p{L}\\p{N}]+"


def term_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of the lower-cased runs of letters and digits of a text."""
    terms = F.filter(F.split(F.lower(text), _LETTERS), lambda t: t != "")
    return F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t)))


def common_terms(df: DataFrame, text: str, band: tuple[float, float] = BAND) -> list[int]:
    """Hashes of the terms below the band, counted over all rows, sorted.

    A term below it is in more than N ** (1 - band[0]) of N texts, so with L distinct terms in a
    text on average there are at most L * N ** band[0] of them: some 10,000 for a billion texts with
    the default and a vocabulary like that of a language, and never more than that bound.
    """
    texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    total = max(2, texts.count())
    counts = texts.select(F.explode(term_hashes(F.col("_text"))).alias("_t")).groupBy("_t").agg(F.count("*").alias("_n"))
    share = F.log(F.lit(float(total)) / F.col("_n")) / math.log(total)
    return sorted(r["_t"] for r in counts.where(share < band[0]).select("_t").collect())


def lexicon_terms(terms: Column, common: list[int]) -> Column:
    """The terms that are in the lexicon, sorted."""
    return F.sort_array(F.filter(terms, lambda h: ~h.isin(common)) if common else terms)


def _seeded(seed: int):
    return lambda h: F.xxhash64(h, F.lit(seed))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` looks at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _places(hashes: Column, draw: int) -> Column:
    """The places of hashed terms in one of the four draws of a hash, 48 bits each, sorted."""
    return F.sort_array(F.transform(hashes, lambda h: F.shiftrightunsigned(F.shiftleft(h, 16 * draw), 16)))


def _sparsest(places: Column) -> Column:
    """The hash of the sparsest subset: it ends at the power of two above the least place."""
    end = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.get(places, F.lit(0)))))
    return _bound(F.struct(F.slice(places, 1, MOST_TERMS).alias("p"), end.alias("end")), lambda s: F.xxhash64(F.filter(s["p"], lambda v: v < s["end"])))


def signature(near: Column, every: Column, draw: int) -> Column:
    """The signature of one draw. ``near`` are the hashes that have a place below ``_limit`` in any draw; if
    none has one in this draw, which is rare, all are looked at."""
    return _bound(_places(near, draw), lambda p: F.when(F.get(p, F.lit(0)) < F.col("_limit"), _sparsest(p)).otherwise(_bound(_places(every, draw), _sparsest)))


def _any_near(h: Column) -> Column:
    found = F.lit(False)
    for d in range(_DRAWS):
        found = found | (h.bitwiseAND(F.col(f"_mask{d}")) == 0)
    return found


def fingerprint(df: DataFrame, text: str, out: str, common: list[int]) -> DataFrame:
    """Adds ``out``: an array of SUBSETS signatures (null without lexicon terms) and, last, the hash of all
    distinct terms. Equal texts have equal arrays; a null text counts as empty.

    The sparsest subsets hold the terms of the least places, so the hashes of terms are first thinned to
    those below a power of two that some 8 to 16 of a text's terms fall below in each draw.
    """
    df = df.withColumn("_terms", term_hashes(F.coalesce(F.col(text), F.lit("")))).withColumn("_found", lexicon_terms(F.col("_terms"), common))
    df = df.withColumn("_bits", F.greatest(F.lit(0), F.least(F.lit(16), 20 - F.length(F.bin(F.size("_found"))))))
    one, field = F.lit(1).cast("long"), F.call_function("shiftleft", F.lit(0xFFFF).cast("long"), F.col("_bits")).bitwiseAND(F.lit(0xFFFF).cast("long"))
    df = df.withColumns({"_limit": F.call_function("shiftleft", one, F.col("_bits") + 32)} | {f"_mask{d}": F.shiftleft(field, 16 * (3 - d)) for d in range(_DRAWS)})
    groups = range(SUBSETS // _DRAWS)
    df = df.withColumns({f"_hash{g}": F.transform("_found", _seeded(g)) for g in groups})
    df = df.withColumns({f"_near{g}": F.filter(f"_hash{g}", _any_near) for g in groups})
    some = F.size("_found") > 0
    parts = [F.when(some, signature(F.col(f"_near{g}"), F.col(f"_hash{g}"), d)) for g in groups for d in range(_DRAWS)]
    spent = ["_terms", "_found", "_bits", "_limit", *[f"_mask{d}" for d in range(_DRAWS)], *[f"{c}{g}" for g in groups for c in ("_hash", "_near")]]
    return df.withColumn(out, F.array(*parts, F.xxhash64(F.sort_array("_terms")))).drop(*spent)


def text_of(print_: Column) -> Column:
    """A fingerprint as text: eight hex digits for each signature, a dash for none."""
    return F.array_join(F.transform(print_, lambda h: F.when(h.isNull(), F.lit("-")).otherwise(F.lower(F.substring(F.lpad(F.hex(h), 16, "0"), 1, 8)))), " ")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: with the share s of draws whose signatures are equal, an estimate of the share of
    lexicon terms in both among those in either, the common measure 2s / (1 + s) of how far two sets
    agree. 1 if all distinct terms are equal, 0 if either is null."""
    equal = F.size(F.filter(F.zip_with(F.slice(a, 1, SUBSETS), F.slice(b, 1, SUBSETS), lambda x, y: F.coalesce(x == y, F.lit(False))), lambda e: e))
    share = equal / F.lit(float(SUBSETS))
    whole = F.get(a, F.lit(SUBSETS)) == F.get(b, F.lit(SUBSETS))
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).when(whole, F.lit(1.0)).otherwise(2 * share / (1 + share))


def buckets_of(df: DataFrame, key: str, rows_each: int = 500, fine: int = 16384, rows_most: int = 50_000) -> Column:
    """A column that numbers ranges of a numeric key with about equally many rows, found from
    approximate quantiles: of ``rows_each`` rows up to ``fine`` ranges, then larger, never of more than
    ``rows_most``. Looked up in two steps of about the square root of their number."""
    n = df.agg(F.count(key)).first()[0]
    number = int(max(1, min(fine, n // rows_each), n // rows_most))
    if not n or number < 2:
        return F.lit(0).cast("long")
    points = df.agg(F.percentile_approx(key, [k / number for k in range(1, number)], max(10_000, 4 * number))).first()[0]
    points = sorted(set(points))
    step = max(1, math.isqrt(len(points)))
    rows = [points[i : i + step] for i in range(0, len(points), step)]
    coarse = F.split(F.lit(",".join(str(r[0]) for r in rows)), ",").cast("array<bigint>")
    fine = F.transform(F.split(F.lit(";".join(",".join(map(str, r)) for r in rows)), ";"), lambda s: F.split(s, ",").cast("array<bigint>"))
    row = F.size(F.filter(coarse, lambda p: F.col(key) >= p))
    inside = F.size(F.filter(F.get(fine, row - 1), lambda p: F.col(key) >= p))
    return F.when(row == 0, F.lit(0)).otherwise((row - 1) * step + inside).cast("long")


def next_rows(df: DataFrame, key: str, ties: list[str]) -> tuple[DataFrame, Window]:
    """Rows with ``_b`` (a key range) and ``_ghost``, and the window in which each row's
    successor by key follows it. The first row of each range is repeated as a ghost at
    the end of the range before it (for the first range: of the last), so no
    range has to see another, and no task more than a range."""
    ranged = df.withColumn("_b", buckets_of(df, key)).withColumn("_ghost", F.lit(False))
    firsts = ranged.groupBy("_b").agg(F.min(F.struct(key, *ties)).alias("_first"))
    order = Window.orderBy("_b")  # a row for each range
    firsts = firsts.select("_b", "_first", F.lag("_b").over(order).alias("_before"), F.max("_b").over(Window.partitionBy()).alias("_last"))
    firsts = firsts.select(F.col("_b").alias("_own"), "_first", F.coalesce("_before", "_last").alias("_to"))
    ghosts = ranged.join(F.broadcast(firsts), (F.col("_b") == F.col("_own")) & (F.struct(key, *ties) == F.col("_first")))
    ghosts = ghosts.dropDuplicates(["_b"]).select(*[F.col("_to").alias("_b") if c == "_b" else F.lit(True).alias(c) if c == "_ghost" else c for c in ranged.columns])
    return ranged.unionByName(ghosts), Window.partitionBy("_b").orderBy("_ghost", key, *ties)


def compare_with_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    The edited text has the last floor(n/4) code points replaced by the first as many
    (or all) of the next row's text, by ascending key; after the last row comes the
    first. A null text counts as empty, a null key sorts first, rows of
    equal keys are ordered by a hash of their text. A single row follows itself. Other columns are not read.
    The key is an integer. A row holds the hashes of its text's distinct terms nine times over: about
    100 bytes a term, so some MB for a text of 50,000 different words.
    """
    own = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    common = common_terms(own, "_text")
    rows, order = next_rows(own, key, ["_tie"])
    rows = rows.withColumn("_next", F.lead("_text").over(order))
    size = F.length("_text")
    cut = F.floor(size / 4).cast("int")
    rows = rows.withColumn("n_chars", size.cast("long")).withColumn("_edited", F.concat(F.substring(F.col("_text"), F.lit(1), size - cut), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), cut)))
    rows = rows.select(key, "_tie", "_b", "_ghost", "_text", "_edited", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"))
    rows = fingerprint(fingerprint(rows, "_text", "_print", common).drop("_text"), "_edited", "_print2", common).drop("_edited")
    rows = rows.withColumn("_following", F.lead("_print").over(order)).where(~F.col("_ghost"))
    return rows.select(
        key, "n_chars", "edited_sha256", text_of(F.col("_print")).alias("fingerprint"), text_of(F.col("_print2")).alias("edited_fingerprint"),
        likeness(F.col("_print"), F.col("_print2")).alias("near_edited"), likeness(F.col("_print"), F.col("_following")).alias("near_next"),
    )
