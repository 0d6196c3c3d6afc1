"""Identities, hashes and match keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_upper(value: Column) -> Column:
    return F.upper(F.sha2(value.cast("binary"), 256))


def canonical_json(*columns: Column) -> Column:
    """A JSON text of the columns in the given order, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def stable_id(prefix: str, *parts: Column) -> Column:
    """The prefix and a digest of the parts; equal parts give equal ids."""
    return F.concat(F.lit(prefix), sha256_upper(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]))))


def document_id(source_id: Column, checksum: Column) -> Column:
    """From a source id made plain and upper-cased, else from the checksum."""
    plain = F.upper(F.regexp_replace(F.regexp_replace(F.trim(source_id), "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""))
    return F.concat(F.lit("DOC-"), F.when(F.length(F.coalesce(plain, F.lit(""))) > 0, plain).otherwise(F.upper(F.substring(checksum, 1, 12))))


def block_id(document: Column, sequence: Column) -> Column:
    return F.concat(document, F.lit("-B"), F.lpad(sequence.cast("string"), 4, "0"))


def evidence_id(source: Column, block: Column) -> Column:
    return F.concat_ws(":", source, block)


def lf_hash(text: Column) -> Column:
    """The digest of a text with LF line ends."""
    return sha256_upper(F.regexp_replace(text, r"\r\n?", "\n"))


def qualifier_key(qualifiers: Column) -> Column:
    """A map as a canonical text: entries sorted by name."""
    return F.to_json(F.array_sort(F.map_entries(F.coalesce(qualifiers, F.create_map().cast("map<string,string>")))))


def qualifiers_contained(gold: Column, found: Column) -> Column:
    """Whether every entry of ``gold`` is in ``found`` with an equal value."""
    return F.forall(F.map_keys(gold), lambda k: F.coalesce(F.try_element_at(found, k).eqNullSafe(F.try_element_at(gold, k)) & F.map_contains_key(found, k), F.lit(False)))


def value_key(value_type: Column, text: Column, number: Column, currency: Column) -> Column:
    """A tagged text by which typed values are equal: decimals without trailing zeros,
    money by amount and currency, dates and statuses as they are written."""
    plain = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return (
        F.when(value_type == "money", F.concat_ws("|", F.lit("money"), plain, F.upper(currency)))
        .when(value_type.isin("number", "integer", "percentage"), F.concat_ws("|", F.lit("number"), plain))
        .otherwise(F.concat_ws("|", value_type, text))
    )


def fields_digest(*columns: Column) -> Column:
    """A self-hash: the digest of all fields but the hash itself."""
    return sha256_upper(canonical_json(*columns))
