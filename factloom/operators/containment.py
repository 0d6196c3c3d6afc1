"""Which texts contain which given passages, without comparing all with all.

A text that contains a passage has every word that stands whole inside the passage. So each
passage is looked up by one of its inner words, the one that the fewest texts have; what is found
is then searched for the passage itself. Passages without an inner word (short ones, or a single long word)
are looked up by a run of characters instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.storage import written

# What words are made of.
_LETTER = r"\p{L}\p{N}_"
#: Characters of a run; of a shorter passage, all.
RUN = 8


def inner_words(passage: Column) -> Column:
    """Words with something that is no letter on both sides inside the passage."""
    return F.array_distinct(F.regexp_extract_all(passage, F.lit(f"(?<=[^{_LETTER}])[{_LETTER}]+(?=[^{_LETTER}])"), F.lit(0)))


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"[{_LETTER}]+"), F.lit(0)))


def _runs(text: Column, size: int) -> Column:
    chars = F.split(text, "")
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(chars, i, size), "")))


def containing(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """(passage_id, text_id) of every text (text_id, text) that contains a passage (passage_id, passage).

    Each pair once, also where rows repeat. Null and empty passages are in no text. The words of
    texts are kept only where a passage has them; texts themselves are searched only for passages whose
    rarest word they have.
    """
    asked = passages.where("passage IS NOT NULL AND passage <> '' AND passage_id IS NOT NULL").select("passage_id", "passage").distinct()
    asked = written(asked.withColumn("words", inner_words(F.col("passage"))), "passages")
    own = asked.select("passage_id", "passage", F.explode("words").alias("gram"))
    grams = texts.select("text_id", F.explode(words(F.col("text"))).alias("gram"))
    found = grams.join(own.select("gram").distinct(), "gram", "left_semi")
    sizes = [r.size for r in asked.where(F.size("words") == 0).select(F.least(F.length("passage"), F.lit(RUN)).alias("size")).distinct().collect()]  # RUN at most
    if sizes:
        short = asked.where(F.size("words") == 0).select("passage_id", "passage", F.substring("passage", 1, RUN).alias("gram"))
        own = own.unionByName(short)
        runs = texts.select("text_id", F.explode(F.array_distinct(F.flatten(F.array(*[_runs(F.col("text"), s) for s in sizes])))).alias("gram"))
        found = found.unionByName(runs.join(short.select("gram").distinct(), "gram", "left_semi"))
    found = written(found.distinct(), "grams")
    common = found.groupBy("gram").agg(F.count("*").alias("n"))
    # an inner word that no text has: the passage is in none
    ranked = own.join(common, "gram", "left").groupBy("passage_id", "passage").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    pairs = found.join(ranked, "gram").select("text_id", "passage_id", "passage")
    # ids alone, each once and written: where they are few, no other text is exchanged
    ids = written(pairs.select("text_id").distinct(), "text_ids")
    whole = texts.select("text_id", "text").join(ids, "text_id", "left_semi").join(pairs, "text_id")
    return whole.where(F.contains("text", "passage")).select("passage_id", "text_id").distinct()
