"""Reports over a whole run: which rule made a fact, how a run did against gold, whether two passes agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import numbers
from factloom.operators import comparison, matching, rules_v2


def rule_of(predicate: Column, confidence: Column) -> Column:
    """The second engine's rule that made a fact: commitments by their confidence, the others by predicate."""
    named = F.create_map(*[F.lit(x) for name, (rule, _) in rules_v2.RULES.items() for x in (name, rule)])
    return F.when((predicate == "commitment") & (confidence >= 0.9), rules_v2.EXPLICIT_RULE).otherwise(F.try_element_at(named, predicate))


def report(candidates: DataFrame, gold: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: candidates, those for review and with ambiguous evidence, repeats, strict matches, values that
    agree in the alignment without values, and precision, recall and F1.

    ``candidates`` have review_status and evidence_status beside the columns of matching."""
    own = candidates.agg(F.count("*").alias("candidates"), F.count_if(F.col("review_status") == "required").alias("review_required"), F.count_if(F.col("evidence_status") == "ambiguous").alias("ambiguous_evidence"))
    aligned = matching.value_alignment(candidates, gold).agg(F.count("*").alias("aligned"), F.count_if(F.col("normalized_value_match")).alias("aligned_values"))
    measured = matching.metrics(matching.predicate_counts(candidates, gold, matches))
    return own.crossJoin(aligned).crossJoin(matching.duplicate_count(candidates)).crossJoin(measured)  # one row each


def complete(found: DataFrame, repeats: DataFrame) -> DataFrame:
    """A report with how many sources a second pass reproduced (rows of ``matching.reproducibility``), and
    whether all were."""
    passes = repeats.agg(F.count_if(F.col("status") == "passed").alias("reproduced"), F.count("*").alias("sources"))
    return found.crossJoin(passes).withColumn("complete", F.col("reproduced") == F.col("sources"))


def reproduction(first: DataFrame, second: DataFrame, gold: DataFrame, expected: dict[str, int], columns: list[str]) -> DataFrame:
    """(measure, first, second, expected, passed): counts of two passes against fixed numbers.

    Measures: candidates, those for review, with ambiguous evidence, strict matches, and meanings
    that only one pass has. A measure without an expected number passes if both passes agree."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        matched = matching.strict_matches(df, gold).agg(F.count("*").alias("strict_matches"))
        own = df.agg(F.count("*").alias("candidates"), F.count_if(F.col("review_status") == "required").alias("review_required"), F.count_if(F.col("evidence_status") == "ambiguous").alias("ambiguous_evidence"))
        return own.crossJoin(matched).unpivot([], ["candidates", "review_required", "ambiguous_evidence", "strict_matches"], "measure", name)

    only = comparison.parity(first, second, columns).select(F.lit("own_meanings").alias("measure"), F.col("only_first").alias("first"), F.col("only_second").alias("second"))
    both = counts(first, "first").join(counts(second, "second"), "measure").unionByName(only)
    numbers_ = F.create_map(*[F.lit(x) for k, n in expected.items() for x in (k, n)]) if expected else F.create_map().cast("map<string,int>")
    wanted = F.try_element_at(numbers_, F.col("measure")).cast("long")
    rows = both.withColumn("expected", wanted)
    none = (F.col("measure") != "own_meanings") | (F.col("first") == 0)
    passed = (F.col("first") == F.col("second")) & none & (F.col("expected").isNull() | (F.col("first") == F.col("expected")))
    return rows.withColumn("passed", passed)


def quality_targets(found: DataFrame, targets: dict[str, tuple[str, float]]) -> DataFrame:
    """(target, value, least, reached) of a one-row report; unreached targets bind nobody."""
    rows = F.array(*[F.struct(F.lit(name).alias("target"), F.col(column).cast("double").alias("value"), F.lit(float(least)).alias("least"), F.coalesce(F.col(column) >= least, F.lit(False)).alias("reached")) for name, (column, least) in targets.items()])
    return found.select(F.inline(rows))


def rates(counts: DataFrame, by: str) -> DataFrame:
    """Precision, recall and F1 of each value of ``by`` from its true and false positives and false negatives."""
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    return counts.select(by, numbers.fraction(tp, tp + fp).alias("precision"), numbers.fraction(tp, tp + fn).alias("recall"), F.when(tp > 0, numbers.fraction(2 * tp, 2 * tp + fp + fn)).alias("f1"))
