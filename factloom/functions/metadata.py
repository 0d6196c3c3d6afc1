"""Typed getters of parsed metadata, kept as a VARIANT column.

What a document says about itself has no fixed schema: a name can be missing, null, or of another
type than expected. Each getter gives its type or nothing; none fails.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import text


def parsed(value: Column) -> Column:
    """A JSON text as a variant; null for a null text and for what is no JSON."""
    return F.try_parse_json(value)


def simple(meta: Column, path: str) -> Column:
    """One value as a plain text: line ends LF, without blank lines at both ends; null where it is missing, null or blank.
    Numbers and booleans are written out, lists and objects as JSON."""
    found = text.normalise_lines(F.try_variant_get(meta, path, "string"))
    return F.when(~text.is_blank(found), found)


def moment(meta: Column, path: str) -> Column:
    """One value as a date and time without a zone; null unless it is one."""
    return F.try_variant_get(meta, path, "timestamp_ntz")


def number(meta: Column, path: str) -> Column:
    """One value as a whole number; 0 where there is none, as for a shape without a place."""
    return F.coalesce(F.try_variant_get(meta, path, "long"), F.lit(0).cast("long"))


def names(meta: Column, path: str) -> Column:
    """A list of texts, in order, without blank ones; a single text is a list of one, anything else an empty list."""
    many = F.try_variant_get(meta, path, "array<string>")
    one = F.when(F.try_variant_get(meta, path, "array<variant>").isNull(), F.try_variant_get(meta, path, "string"))
    found = F.coalesce(many, F.when(one.isNotNull() & ~one.startswith("{"), F.array(one)), F.array().cast("array<string>"))
    return F.filter(F.transform(found, text.normalise_lines), lambda v: ~text.is_blank(v))
