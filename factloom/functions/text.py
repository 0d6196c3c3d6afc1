"""Text functions as Column expressions; patterns use Unicode classes like Python's."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]{2,}"


def normalise_lines(text: Column) -> Column:
    """CRLF and CR become LF, lines lose trailing blanks, blank lines at both ends go."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"(?U)[^\S\n]+(?=\n|\z)", "")
    return F.regexp_replace(text, r"\A\n+|\n+\z", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` looks at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapsed_offsets(text: Column) -> Column:
    """A struct of the collapsed text and, for each of its characters, the place of the original
    one from 0; a single space has the place of the word behind it."""

    def places(chars: Column) -> Column:
        return F.filter(F.transform(chars, lambda c, i: F.when(c.rlike(r"(?U)\A\S\z"), i)), lambda i: i.isNotNull())

    def spread(at: Column) -> Column:
        return F.flatten(F.transform(at, lambda p, j: F.when((j > 0) & (F.get(at, j - 1) < p - 1), F.array(p, p)).otherwise(F.array(p))))

    return F.struct(strip(F.regexp_replace(text, r"(?U)\s+", " ")).alias("text"), bound(places(F.split(text, "")), spread).alias("offsets"))


def strip(text: Column) -> Column:
    """One match from the front; a search for white space at the end would try each of its runs."""
    return F.regexp_extract(text, r"(?sU)\A\s*+(\S(?:.*\S)?+)?", 1)


def folded(text: Column) -> Column:
    """Lower-cased as patterns without regard to case see a text: whatever they take for an ASCII letter is that letter."""
    return F.lower(F.translate(text, "\u017f\u0130\u0131\u212a", "siik"))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


_QUOTES = str.maketrans({"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"'})
_DASHES = str.maketrans(dict.fromkeys("‐‑‒–—―−", "-"))


def comparable_text(value: str) -> str:
    """NFKC, case folding, plain quotes and dashes, single spaces, one final mark dropped."""
    value = unicodedata.normalize("NFKC", value).casefold().translate(_QUOTES).translate(_DASHES)
    value = re.sub(r"\s+", " ", value).strip()
    return value[:-1].rstrip() if value[-1:] in (".", "!", "?") else value


@F.pandas_udf(StringType())
def _comparable(values: pd.Series) -> pd.Series:
    return values if values.isna().all() else values.map(comparable_text, na_action="ignore")


def comparable(text: Column) -> Column:
    """The form in which texts are compared: built-ins for ASCII, Python's tables otherwise. Spark evaluates
    Python functions for every row, whatever branch they stand in, so those rows are null to it."""
    ascii_ = text.rlike(r"\A\p{ASCII}*\z")
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    plain = F.rtrim(F.regexp_replace(plain, r"[.!?]\z", ""))
    return F.when(ascii_, plain).otherwise(_comparable(F.when(~ascii_, text)))


def _structural(value):
    if isinstance(value, dict):
        return {k: _structural(value[k]) for k in sorted(value)}
    if isinstance(value, list):
        return [_structural(v) for v in value]
    return comparable_text(value) if isinstance(value, str) else value


@F.pandas_udf(StringType())
def structural(values: pd.Series) -> pd.Series:
    """JSON texts in the form in which values are compared: names sorted, texts in comparison form, at any
    depth; null for what is no JSON."""

    def plain(value: str) -> str | None:
        try:
            return json.dumps(_structural(json.loads(value)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return values.map(plain, na_action="ignore")


def terms(text: Column) -> Column:
    """Lower-cased runs of two or more letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def citations(answer: Column) -> Column:
    """Evidence ids cited as [SOURCE:BLOCK], in order."""
    return F.regexp_extract_all(answer, F.lit(r"\[([A-Za-z0-9_.-]+:[A-Za-z0-9_.-]+)\]"), F.lit(1))


def message_ids(value: Column) -> Column:
    """Ids in angle brackets; without any, the parts between white space."""
    found = F.regexp_extract_all(value, F.lit(r"<[^<>]+>"), F.lit(0))
    parts = F.filter(F.split(value, r"\s+"), lambda x: x != "")
    return F.when(value.isNull(), F.array().cast("array<string>")).when(F.size(found) > 0, found).otherwise(parts)


def warning_code(warning: Column) -> Column:
    """What stands before the first colon."""
    return F.split_part(warning, F.lit(":"), F.lit(1))


def error_code(class_name: Column) -> Column:
    """CamelCase to snake_case."""
    return F.lower(F.regexp_replace(class_name, r"(?<!^)(?=[A-Z])", "_"))


def safe_message(message: Column, most: int = 300) -> Column:
    """One line, paths replaced by their last part, cut to ``most`` characters."""
    one = collapse(message)
    names = F.regexp_replace(one, r"(?:[A-Za-z]:)?(?:[\\/][^\s\\/:'\"]+)*[\\/]([^\s\\/:'\"]+)", "$1")
    return F.substring(names, 1, most)


def predicate_name(value: Column) -> Column:
    """Spaces and hyphens become underscores, in lower case."""
    return F.lower(F.regexp_replace(strip(value), r"(?U)[\s-]+", "_"))


_SLUG_STOP = ["a", "an", "the", "of", "for"]


def metric_slug(subject: Column, percentage: bool) -> Column:
    """Up to ten lower-cased words without articles; a percentage says so last."""
    words = F.filter(F.transform(F.regexp_extract_all(subject, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower), lambda w: ~w.isin(_SLUG_STOP))
    if percentage:
        words = F.when((F.size(words) > 0) & ~F.element_at(words, -1).isin("rate", "percentage", "share"), F.concat(words, F.array(F.lit("percentage")))).otherwise(words)
    return F.array_join(F.slice(words, 1, 10), "_")


def document_leaks(values: Column, text: Column) -> Column:
    """Those of an array of held-out values that a text contains."""
    return F.filter(values, lambda v: F.contains(text, v))
