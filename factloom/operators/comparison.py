"""Comparing runs with gold and with each other: challenge cases, nearest candidates, traces, inventories, parity.

Facts carry ``block_ids``: the blocks of the evidence they cite. Links between
facts and cases or annotations are equi-joins on (source, block), never pairs of
everything; what is listed for each case is aggregated, ids sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import frames, keys, numbers, text
from factloom.operators import matching, nearest
from factloom.storage import written

# Fixed values.
AMBIGUOUS_METRIC = "ambiguous_metric_value_relationship"
REASONS = ["subject_text_mismatch", "subject_type_mismatch", "value_type_mismatch", "normalized_value_mismatch", "qualifier_missing", "qualifier_mismatch"]
POSSESSIVE = r"(?iU)\b(?:our|its|their)\b"


def block_ids(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts with ``block_ids``: sorted blocks of the evidence they cite."""
    cited = facts.select("candidate_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id", "block_id"), "evidence_id")
    blocks = cited.groupBy("candidate_id").agg(F.array_sort(F.collect_set("block_id")).alias("block_ids"))
    return facts.join(blocks, "candidate_id", "left").withColumn("block_ids", F.coalesce("block_ids", F.array().cast("array<string>")))


def _of_cases(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, facts' columns): facts that cite a block of a case, each once a case."""
    wanted = cases.select("case_id", "source_id", F.explode("evidence_block_ids").alias("_block"))
    cited = facts.select("source_id", "candidate_id", F.explode("block_ids").alias("_block"))
    linked = cited.join(wanted, ["source_id", "_block"]).select("case_id", "candidate_id").distinct()
    return linked.join(facts, "candidate_id")


def challenge_outcomes(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """Whether each case (case_id, source_id, evidence_block_ids, expected_behavior) went as expected.

    ``preserve_missing``: some recommendation with its number and no date; ``do_not_extract``: no fact;
    ``route_to_review``: some fact for review with the warning of ambiguous metrics. Cases
    without any linked fact are kept; other behaviours fail.
    """
    linked = _of_cases(cases, facts)
    names = F.map_keys(F.coalesce("qualifiers", F.create_map().cast("map<string,string>")))
    dated = F.exists(names, lambda n: F.contains(n, F.lit("date")) | F.contains(n, F.lit("effective")))
    plain = (F.col("predicate") == "recommendation") & F.array_contains(names, "recommendation_id") & ~dated
    review = (F.col("review_status") == "required") & F.array_contains("warnings", AMBIGUOUS_METRIC)
    ids = lambda test: F.array_sort(F.collect_list(F.when(F.coalesce(test, F.lit(False)), F.col("candidate_id"))))
    sums = linked.groupBy("case_id").agg(ids(plain).alias("_plain"), ids(F.lit(True)).alias("_all"), ids(review).alias("_review"))
    rows = cases.join(sums, "case_id", "left")
    none = F.array().cast("array<string>")
    behavior = F.col("expected_behavior")
    related = F.coalesce(F.when(behavior == "preserve_missing", F.col("_plain")).when(behavior == "do_not_extract", F.col("_all")).when(behavior == "route_to_review", F.col("_review")), none)
    rows = rows.withColumn("related_candidate_ids", related)
    passed = F.when(behavior == "do_not_extract", F.size("related_candidate_ids") == 0).otherwise(F.size("related_candidate_ids") > 0)
    return rows.select("case_id", "source_id", "expected_behavior", F.when(passed, "passed").otherwise("failed").alias("outcome"), "related_candidate_ids")


def review_packet(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """Each case with the facts that cite one of its blocks, by id, for an owner's review."""
    linked = _of_cases(cases, facts).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("candidate_id", "predicate", "subject_text", "raw_value"))).alias("candidates"))
    return cases.join(linked, "case_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<struct<candidate_id:string,predicate:string,subject_text:string,raw_value:string>>")))


def nearest_in_block(gold: DataFrame, facts: DataFrame) -> DataFrame:
    """For each annotation the fact of its source, predicate and evidence block with the fewest
    differences, ties by id; none: an empty list of differences."""
    c, g = matching.keyed(facts), matching.keyed(gold)
    cited = c.select("source_id", "predicate", "candidate_id", F.explode(F.array_distinct("block_ids")).alias("_block"), *nearest.FIELDS, "qualifiers", "subject_text")
    first = matching.ranked_nearest(cited, g.withColumnRenamed("evidence_block_id", "_block"), ["source_id", "predicate", "_block"], 1, c)
    return first.select("annotation_id", F.col("candidate_id").alias("closest_candidate_id"), F.col("subject_text").alias("closest_subject"), F.coalesce("reasons", F.array().cast("array<string>")).alias("mismatch_fields"))


def _score_reasons(of: Callable[[str], Column] = F.col) -> tuple[Column, Column]:
    """In how many respects a candidate, whose columns ``of`` gives, agrees with the annotation of the row, and why they do not match."""
    gold, own = F.col("_gq"), of("_cq")
    shared = F.filter(F.map_keys(gold), lambda k: F.map_contains_key(own, k))
    same_kind, same_value = of("value_type") == F.col("_gvalue_type"), of("_value") == F.col("_gvalue")
    tests = [
        of("_subject") != F.col("_gsubject"), of("subject_type") != F.col("_gsubject_type"), ~same_kind, same_kind & ~same_value,
        F.size(shared) < F.size(F.map_keys(gold)), F.exists(shared, lambda k: ~F.try_element_at(own, k).eqNullSafe(F.try_element_at(gold, k))),
    ]
    found = F.array_compact(F.array(F.lit("no_strict_match"), *[F.when(t, n) for t, n in zip(tests, REASONS, strict=True)]))
    points = [of("_subject") == F.col("_gsubject"), of("subject_type") == F.col("_gsubject_type"), same_kind, same_value, keys.qualifiers_contained(gold, own)]
    score = sum((F.coalesce(p, F.lit(False)).cast("int") for p in points[1:]), F.coalesce(points[0], F.lit(False)).cast("int"))
    return score, F.array_sort(found)


def pair_reasons(rows: DataFrame) -> DataFrame:
    """Adds ``reasons`` (sorted) and ``score`` to pairs with the keyed columns of a candidate
    (_subject, subject_type, value_type, _value, _cq) and of gold (_gsubject, ...)."""
    score, reasons = _score_reasons()
    return rows.withColumns({"reasons": reasons, "score": score})


def closest_by_score(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """For each unmatched annotation all candidates of its source and predicate that agree in the most respects."""
    candidates, gold, on = matching.keyed(candidates), matching.keyed(gold), ["source_id", "predicate"]
    large = nearest.large_groups(candidates, on)
    there = not large.isEmpty()
    c, g = (x.join(large, on, "left_anti") if there else x for x in (candidates, gold))

    def one(x: Column) -> Column:
        score, reasons = _score_reasons(lambda n: x[n])
        return F.struct(score.alias("score"), x["candidate_id"].alias("candidate_id"), reasons.alias("reasons"))

    rows = frames.settled(matching.beside_few(c, g, on), {"_all": F.transform("_few", one)})
    rows = frames.settled(rows, {"_best": F.array_max("_all.score")})
    small = rows.select("annotation_id", F.explode(F.filter("_all", lambda x: x["score"] == F.col("_best"))).alias("_one")).select("annotation_id", "_one.candidate_id", "_one.score", "_one.reasons")
    if not there:
        return small
    c, g = (written(x.join(large, on, "left_semi"), "keyed") for x in (candidates, gold))
    rows = pair_reasons(matching.facts_with(nearest.all_nearest(c, g, on), c, g).where("candidate_id IS NOT NULL"))
    return small.unionByName(rows.select("annotation_id", "candidate_id", "score", "reasons"))


def trace_with_matches(trace: DataFrame, matches: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Trace rows with the annotation that their candidate strictly matches, null for none."""
    return trace.join(matches.select(F.col("candidate_id").alias(key), F.col("annotation_id").alias("strict_match_annotation_id")), key, "left")


def transformation_flags(original: dict[str, Column], final: dict[str, Column], operation: Column, modifiers: Column) -> Column:
    """What the way from an original fact to a final one changed; the dicts have subject_text,
    subject_type, raw_value and normalized_value, ``modifiers`` is an array of words kept."""
    other = lambda name: ~final[name].eqNullSafe(original[name])
    plain = lambda c: F.lower(text.collapse(c))
    longer = F.contains(plain(final["raw_value"]), plain(original["raw_value"]))
    wrapper = operation == "safe_recommendation_wrapper_collapsed"
    made = F.array(
        F.when(other("subject_text"), "actor_resolved"),
        F.when(other("subject_type"), "subject_type_changed"),
        F.when(other("raw_value") & longer, "raw_value_extended").when(other("raw_value"), "raw_value_changed"),
        F.when(other("normalized_value"), "normalized_value_changed"),
        F.when(wrapper, "structural_wrapper_removed"),
        F.when(wrapper & final["normalized_value"].rlike(POSSESSIVE), "possessive_preserved"),
    )
    kept = F.transform(F.coalesce(modifiers, F.array().cast("array<string>")), lambda m: F.concat(F.lit("semantic_modifier_preserved:"), m))
    return F.concat(F.array_compact(made), kept)


def trace_counts(trace: DataFrame, columns: list[str]) -> DataFrame:
    """(counter, name, n): how often each value of each column occurs; elements of arrays singly.
    Nulls are not counted."""
    kinds = dict(trace.dtypes)
    every = None
    for column in columns:
        value = F.explode(column) if kinds[column].startswith("array") else F.col(column)
        rows = trace.select(value.alias("name")).select(F.lit(column).alias("counter"), F.col("name").cast("string").alias("name")).where("name IS NOT NULL")
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy("counter", "name").agg(F.count("*").alias("n"))


def inventory_problems(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, problem): expected and missing, not expected, or observed more than once."""
    seen = observed.groupBy(key).agg(F.count("*").alias("_n"))
    rows = expected.select(key, F.lit(True).alias("_wanted")).distinct().join(seen, key, "full")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_wanted").isNull(), "unexpected").when(F.col("_n") > 1, "repeated")
    return rows.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def reference_problems(cases: DataFrame, facts: DataFrame, codes: DataFrame) -> DataFrame:
    """(case_id, problem, name): candidate ids and warning codes that cases name and no run has."""
    ids = cases.select("case_id", F.explode("candidate_ids").alias("name"))
    words = cases.select("case_id", F.explode("warning_codes").alias("name"))
    lost = ids.join(facts.select(F.col("candidate_id").alias("name")).distinct(), "name", "left_anti").select("case_id", F.lit("unknown_candidate").alias("problem"), "name")
    mute = words.join(codes.select(F.col("code").alias("name")).distinct(), "name", "left_anti").select("case_id", F.lit("warning_not_observed").alias("problem"), "name")
    return lost.unionByName(mute)


def reconciled(stored: DataFrame, computed: DataFrame, key: list[str]) -> DataFrame:
    """(key, field, stored, computed) of every field in which a stored row and the recomputed one
    differ, a row that only one side has included."""
    fields = [c for c in stored.columns if c not in key]
    left = stored.select(*key, F.struct(*[F.col(c).cast("string").alias(c) for c in fields]).alias("_s"), F.lit(True).alias("_there"))
    right = computed.select(*key, F.struct(*[F.col(c).cast("string").alias(c) for c in fields]).alias("_c"), F.lit(True).alias("_here"))
    rows = left.join(right, key, "full")
    pairs = [F.struct(F.lit("(row)").alias("field"), F.col("_there").cast("string").alias("stored"), F.col("_here").cast("string").alias("computed"))]
    pairs += [F.struct(F.lit(f).alias("field"), F.col("_s")[f].alias("stored"), F.col("_c")[f].alias("computed")) for f in fields]
    both = F.col("_there").isNotNull() & F.col("_here").isNotNull()
    shown = F.when(both, F.array(*pairs[1:])).otherwise(F.array(pairs[0]))
    return rows.select(*key, F.inline(shown)).where(~F.col("stored").eqNullSafe(F.col("computed")))


def fractions(report: DataFrame, measures: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(metric, numerator, denominator, value) of a one-row report; value is null where the denominator is 0."""
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), n.cast("long").alias("numerator"), d.cast("long").alias("denominator"), numbers.fraction(n, d).alias("value")) for name, (n, d) in measures.items()])
    return report.select(F.inline(rows))


def all_failing(gates: DataFrame) -> DataFrame:
    """One row: how many gates there are, whether all passed, and those that did not, in order."""
    failing = F.transform(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("ordinal", "gate")))), lambda g: g["gate"])
    return gates.agg(F.count("*").alias("gates"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), failing.alias("failing"))


def semantic_payload(facts: DataFrame, columns: list[str]) -> Column:
    """A digest of a fact's meaning: the given columns without any identity, maps sorted."""
    kinds = dict(facts.dtypes)
    plain = [F.array_sort(F.map_entries(c)).alias(c) if kinds[c].startswith("map") else F.array_sort(c).alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns]
    return keys.sha256_upper(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}))


def parity(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """One row: facts of two runs, and how many meanings only one of them has (counted)."""
    count = lambda df, sign: df.select(semantic_payload(df, columns).alias("_p"), F.lit(sign).alias("_s"))
    sums = count(first, 1).unionByName(count(second, -1)).groupBy("_p").agg(F.sum("_s").alias("_d"), F.count("*").alias("_n"))
    return sums.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("facts"), F.coalesce(F.sum(F.greatest("_d", F.lit(0))), F.lit(0)).alias("only_first"), F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).alias("only_second"))


def non_overlapping(spans: DataFrame, key: str) -> DataFrame:
    """Spans (key, start, end) into which no earlier one of their key reaches, nor a longer one that
    starts where they start, whether that one stays itself or not."""
    order = Window.partitionBy(key).orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(order), F.lit(-1))
    return spans.withColumn("_reach", reach).where(F.col("start") >= F.col("_reach")).drop("_reach")
