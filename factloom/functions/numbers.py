"""Numbers, money, dates, vectors and sequences as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
SCALES = {"k": 1_000, "thousand": 1_000, "m": 1_000_000, "million": 1_000_000, "bn": 1_000_000_000, "billion": 1_000_000_000}
SYMBOLS = {"£": "GBP", "$": "USD", "€": "EUR"}

_MONTH = r"(?iU)\b(?:in|during|for|as\s+of)\s+(" + "|".join(MONTHS) + r")\s+((?:19|20)\d{2})\b"
_YEAR = r"(?iU)\b(?:in|during|for|as\s+of)\s+((?:19|20)\d{2})\b"


def _constants(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def period(text: Column) -> Column:
    """``2025-03`` for "in March 2025", ``2025`` for "in 2025", else null."""
    month = F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, _MONTH, 1))).cast("string"), 2, "0")
    return F.when(text.rlike(_MONTH), F.concat_ws("-", F.regexp_extract(text, _MONTH, 2), month)).when(text.rlike(_YEAR), F.regexp_extract(text, _YEAR, 1))


def money(currency: Column, amount: Column, scale: Column) -> tuple[Column, Column]:
    """Currency code and exact amount of a currency token, a number with commas and a scale word."""
    code = F.coalesce(F.try_element_at(_constants(SYMBOLS), currency), F.upper(currency))
    factor = F.coalesce(F.try_element_at(_constants(SCALES), F.lower(scale)), F.lit(1))
    return code, (F.regexp_replace(amount, ",", "").cast("decimal(24,9)") * factor.cast("decimal(10,0)")).cast("decimal(38,9)")


def email_date(value: Column) -> Column:
    """An RFC 2822 date as a timestamp, null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(value, r"^\s*[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)\s*$", "")
    bare = F.regexp_replace(F.trim(bare), r"\b(GMT|UT|UTC|Z)$", "+0000")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z")))


def iso_date(value: Column) -> Column:
    """Whether a text is a date yyyy-mm-dd."""
    return value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.expr("true") & F.try_to_date(value, "yyyy-MM-dd").isNotNull()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector scaled to length one; null for null, empty, zero or non-finite vectors."""
    norm = F.sqrt(dot(v, v))
    usable = (F.size(v) > 0) & (norm > 0) & ~F.isnan(norm) & (norm < float("inf")) & ~F.exists(v, lambda x: x.isNull())
    return F.when(usable, F.transform(v, lambda x: x.cast("double") / norm))


def fraction(numerator: Column, denominator: Column) -> Column:
    """A quotient, null where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def token_cost(tokens: Column, per_million: Column) -> Column:
    """Exact cost of tokens at a price for a million."""
    return (tokens.cast("decimal(18,0)") * per_million.cast("decimal(18,9)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,9)")


def planning_tokens(payload: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(payload) / 4).cast("long")


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays: one row of the usual
    table at a time, folded over ``a``."""
    zero = F.transform(F.concat(F.array(F.lit(0)), F.transform(b, lambda _: F.lit(0))), lambda x: x.cast("int"))

    def row(before: Column, x: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(b))

        def cell(done: Column, j: Column) -> Column:
            match = F.get(b, j - 1).eqNullSafe(x)
            value = F.when(match, F.get(before, j - 1) + 1).otherwise(F.greatest(F.get(before, j), F.element_at(done, -1)))
            return F.concat(done, F.array(value.cast("int")))

        return F.when(F.size(b) == 0, before).otherwise(F.aggregate(steps, F.array(F.lit(0).cast("int")), cell))

    return F.coalesce(F.element_at(F.aggregate(a, zero, row), -1), F.lit(0))
