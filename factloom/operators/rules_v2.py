"""The second rule engine: stricter subjects, headings that accumulate, several readings of a value.

It shares the staging of the first engine. What differs are the statements, the
trimming of subjects, the commitment, requirement, metric and status rules, and a
contract check after equal facts are put together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import keys, numbers, text
from factloom.operators import registry, rules, segmentation
from factloom.operators.rules import Match, _count, _group, _has, _t
from factloom.storage import written

VERSION = "rules-v0.2"
_I = "(?iuU)"

# Fixed values.
RULES = {
    "recommendation": ("V02-RULE-REC-001", 5),
    "commitment": ("V02-RULE-COM-WEAK-002", 20),
    "metric": ("V02-RULE-METRIC-001", 30),
    "requirement": ("V02-RULE-REQ-001", 40),
    "action_status": ("V02-RULE-ACTION-001", 50),
    "decision": ("V02-RULE-DEC-001", 60),
    "risk": ("V02-RULE-RISK-001", 70),
    "budget": ("V02-RULE-BUD-001", 80),
}
EXPLICIT_RULE = "V02-RULE-COM-EXPLICIT-001"
COMMITMENT = r"(has\s+committed\s+to|commits\s+to|commit\s+to|intends\s+to|intend\s+to|plans\s+to|plan\s+to|will\s+not|will)\b"
EXPLICIT = ["has committed to", "commits to", "commit to"]
GOVERNOR = r"\b(?:(?:do|does|did)(?:\s+not)?|(?:may|might|could|should|can|would)(?:\s+not)?)\s*$"
WEAK_PREFIX = r"^(?:intends? to be|plans? to be|will be|will not be)(?:\b|$)"
REQUIREMENT = r"(are\s+required\s+to|is\s+required\s+to|must\s+not|shall\s+not|required\s+to|must|shall)\b"
SUBORDINATE = r"\b(?:although|because|if|that|when|where|which|while|who)\b"
COORDINATED = r"\b(?:and|or)\s+[A-Za-z][A-Za-z'-]*\s+(?:is|are|was|were|will|must|shall|has|have|intends?|plans?|commits?)\b"
GENERIC_HEADS = ["amount", "average", "baseline", "figure", "level", "measure", "metric", "number", "percentage", "population", "proportion", "rate", "ratio", "score", "share", "target", "total", "value"]
IMPERSONAL = ["it", "that", "there", "these", "this", "those"]
ACTORS = ["initiative", "organisation", "other", "policy", "programme"]
ACTION_CUES = ["action", "activity", "deliverable", "delivery", "implementation", "milestone", "phase", "progress", "recommendation", "rollout", "step", "task", "work", "workstream"]
POPULATIONS = ["participants", "people", "population", "respondents", "residents", "users"]
LINK = r"^(.+?)\s+(?:was|were|is|are|reached|stood\s+at|measured|may\s+be)\s*$"
MARKER = r"\A\s*(?:[-–—•]|(?:[A-Za-z]|\d+)[.)])\s+"
_TOKEN = "[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*"
MOST_VALUES = MOST_READINGS = 3


def tokens(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(_TOKEN), F.lit(0))


def trim(value: Column) -> Column:
    """Without a list mark before and punctuation behind."""
    return F.regexp_replace(text.strip(F.regexp_replace(text.strip(value), "(?U)" + MARKER, "")), r"(?U)[\s:;|,\-]+\z", "")


def trim_span(value: Column) -> Column:
    return text.collapse(F.regexp_replace(value, "(?U)" + MARKER, ""))


def clause_like(value: Column) -> Column:
    return value.rlike(r"[:;?!\n]") | value.rlike(_I + SUBORDINATE) | value.rlike(_I + COORDINATED)


def bounds_problem(value: Column) -> Column:
    """Why a subject is out of bounds: no token, more than 12 tokens or 79 characters, a clause."""
    n = F.size(tokens(value))
    return F.when(n < 1, "ineligible").when((n > 12) | (F.length(value) > 79), "too_long").when(clause_like(value), "clause")


def generic_actor(value: Column) -> Column:
    """Whether a subject of no known kind may act: a noun phrase that ends in no measure."""
    found = F.transform(tokens(value), F.lower)
    return bounds_problem(value).isNull() & value.rlike("[A-Za-z]") & ~F.lower(text.collapse(value)).isin(IMPERSONAL) & ~F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("value")).isin(GENERIC_HEADS)


def _commitment() -> Match:
    pattern = r"^(.*?)" + COMMITMENT
    lead = F.regexp_extract(_t(), _I + pattern, 1)
    spoken = F.lower(text.collapse(F.regexp_extract(_t(), _I + pattern, 2)))
    before, trigger, contextual, able, own, raw, problem = map(F.col, ("_com_before", "_com_trigger", "_com_contextual", "_com_able", "_com_own", "_com_raw", "_com_problem"))
    explicit = trigger.isin(EXPLICIT)

    def fits(h: Column) -> Column:
        kind = rules.subject_type(h["text"], "commitment")
        return ~h["text"].rlike("(?U)" + MARKER) & bounds_problem(h["text"]).isNull() & kind.isin(ACTORS) & ((kind != "other") | generic_actor(h["text"]))

    trimmed = F.transform("pending", lambda h: F.struct(trim_span(h["text"]).alias("text"), h["start"].alias("start")))
    names = F.array_distinct(F.transform(able, lambda h: F.struct(F.lower(h["text"]), rules.subject_type(h["text"], "commitment"))))
    pick = F.array(F.struct(F.get(able, F.lit(0))["text"].alias("subject"), raw.alias("raw"), F.lit(None).cast("string").alias("number"), F.get(able, F.lit(0))["start"].cast("int").alias("start")))

    def late() -> Column:
        kind = F.col("_type")
        return F.when(~contextual & (kind != "metric") & (~kind.isin(ACTORS) | ((kind == "other") & ~generic_actor(F.col("subject_text")))), "abstained_commitment_ineligible_subject")

    warning = (
        F.when(~explicit & F.lower(raw).rlike("(?U)" + WEAK_PREFIX), "abstained_commitment_copular_or_passive")
        .when(contextual & (F.size(names) > 1), "abstained_commitment_ambiguous_heading_context")
        .when(contextual & (F.size(names) == 0), "abstained_commitment_ineligible_subject")
        .when(~contextual & (own.rlike("(?U)" + MARKER) | (problem == "ineligible")), "abstained_commitment_ineligible_subject")
        .when(~contextual & (problem == "too_long"), "abstained_commitment_subject_too_long")
        .when(~contextual & (problem == "clause"), "abstained_commitment_clause_like_subject")
    )
    return Match(
        when=_has(COMMITMENT) & ((lead == "") | lead.rlike(r"(?U)\s$")) & ~(spoken.isin(EXPLICIT) & lead.rlike(_I + GOVERNOR)),
        subject=F.when(~contextual, own),
        raw=raw,
        warning=warning,
        late_warning=late,
        confidence=F.when(~contextual & explicit, 0.9).otherwise(0.7),
        checked=F.lit(False),
        picks=F.when(contextual, pick),
        rule=F.when(explicit, EXPLICIT_RULE),
        steps=[
            {"_com_before": lead, "_com_trigger": spoken},
            {"_com_contextual": text.is_blank(before), "_com_own": trim_span(before), "_com_raw": text.collapse(F.substring(_t(), F.length(before) + 1, F.length(_t())))},
            {"_com_able": F.when(contextual, F.filter(trimmed, fits)), "_com_problem": bounds_problem(own)},
        ],
        words=["commit", "intend", "plan", "will"],
    )


def _requirement() -> Match:
    # "not required to" is passed over: the first other trigger counts
    pattern = r"^(.*?)(?:(?<!\bnot\s)|(?=are|is|must|shall))" + REQUIREMENT
    lead = F.regexp_extract(_t(), _I + pattern, 1)
    before, trigger, action = map(F.col, ("_req_before", "_req_trigger", "_req_action"))
    words = F.size(tokens(action))

    def late() -> Column:
        own, kind = F.col("subject_text"), F.col("_type")
        unfit = own.isNull() | own.rlike("(?U)" + MARKER) | bounds_problem(own).isNotNull() | ~kind.isin(ACTORS) | ((kind == "other") & ~generic_actor(own))
        return F.when(unfit, "abstained_requirement_ineligible_subject")

    return Match(
        when=_t().rlike(_I + pattern) & (F.col("context").isNotNull() | ~text.is_blank(lead)),
        subject=F.when(~text.is_blank(before), trim_span(before)),
        raw=text.collapse(F.substring(_t(), F.length(before) + 1, F.length(_t()))),
        warning=F.when((words < 1) | (words > 40) | (F.length(action) > 240), "abstained_requirement_ineligible_action"),
        late_warning=late,
        checked=F.lit(False),
        steps=[
            {"_req_before": lead, "_req_trigger": F.regexp_extract(_t(), _I + pattern, 2)},
            {"_req_action": text.collapse(F.substring(_t(), F.length(before) + F.length(trigger) + 1, F.length(_t())))},
        ],
        words=["must", "shall", "required"],
    )


def _metric() -> Match:
    counted = _count(rules.PERCENT)
    first = rf"^(.*?){rules.PERCENT}(.*)$"
    lead, rest, share = map(F.col, ("_met_lead", "_met_rest", "_met_share"))
    after = r"^\s+of\s+([A-Za-z][A-Za-z0-9 '\-/]{0,80}?)(?=\s+(?:were|was|are|is|had|have|reported|used|completed|met|said|received|adopted)\b)"
    before, behind = F.regexp_extract(_t(), _I + first, 1), F.regexp_extract(_t(), _I + first, 4)
    names = lambda lead: F.filter(F.transform(F.split(cleaned(lead), _I + r"\s+and\s+"), trim_span), lambda s: s != "")
    population, linked, subjects, readings = map(F.col, ("_met_population", "_met_linked", "_met_subjects", "_met_readings"))
    unit = _group(rules.COUNT, 2)
    raws = F.regexp_extract_all(_t(), F.lit(_I + rules.PERCENT), F.lit(0))
    cleaned = lambda lead: F.regexp_replace(F.regexp_replace(lead, _I + r"\s+(?:may\s+be|was|were|is|are|reached|stood\s+at|measured)\s*$", ""), r"^[ ,:;\-]+|[ ,:;\-]+$", "")

    def reading(s: Column) -> Column:
        return F.transform(raws, lambda r: F.struct(s.alias("subject"), r.alias("raw"), F.regexp_extract(r, r"^\d+(?:\.\d+)?", 0).alias("number"), F.lit(None).cast("int").alias("start")))

    several = share > 1
    cues = F.filter(F.array(*map(F.lit, POPULATIONS)), lambda c: F.array_contains(F.transform(tokens(_t()), F.lower), c))
    years = F.regexp_extract_all(_t(), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    return Match(
        when=~_has(rules.CURRENCY) & ~_has(rules.RATIO) & (((counted == 0) & (_count(rules.COUNT) > 0)) | ((counted == 1) & (_has(LINK, before) | _has(after, behind))) | (counted > MOST_VALUES) | ((counted > 1) & (F.size(names(before)) > 0))),
        subject=F.when(share == 0, unit).when(share == 1, F.coalesce(trim_span(linked), population)),
        raw=F.when(share == 0, F.regexp_extract(_t(), _I + rules.COUNT, 0)).otherwise(F.regexp_extract(_t(), _I + rules.PERCENT, 0)),
        value_type=F.when(share == 0, "number").otherwise("percentage"),
        number=F.when(share == 0, F.regexp_replace(_group(rules.COUNT, 1), ",", "")).when(share == 1, _group(first, 2)),
        qualifiers={
            "metric_name": lambda: F.when(share == 0, text.metric_slug(F.concat(unit, F.lit(" count")), False)).otherwise(text.metric_slug(F.col("subject_text"), True)),
            "unit": lambda: F.when(share == 0, F.lower(unit)).otherwise("percent"),
            "population": lambda: F.when(share == 0, unit).when((share == 1) & population.isNotNull(), population).when(F.size(cues) == 1, F.get(cues, F.lit(0))),
            "period": lambda: F.when(share == 0, numbers.period(_t())).when(F.size(years) == 1, F.get(years, F.lit(0))),
        },
        warning=F.when((share == 0) & (_count(rules.COUNT) > 1), "abstained_multiple_values").when((share > MOST_VALUES) | (several & (F.size(readings) > MOST_READINGS)), "abstained_ambiguous_metric_bounds_exceeded"),
        kind=F.when(share == 0, "metric"),
        confidence=F.when(several, 0.5).otherwise(0.9),
        status=F.when(several, "ambiguous"),
        checked=F.lit(False),
        picks=F.when(several & (share <= MOST_VALUES) & (F.size(readings) <= MOST_READINGS), readings),
        steps=[
            {"_met_share": counted, "_met_lead": before, "_met_rest": behind},
            {"_met_population": text.strip(_group(after, 1, rest)), "_met_linked": _group(LINK, 1, lead), "_met_subjects": names(lead)},
            {"_met_readings": F.flatten(F.transform(subjects, reading))},
        ],
        words=["0"],
    )


def _decision() -> Match:
    found = rules._decision()

    def late() -> Column:
        own = F.col("subject_text")
        return F.when((F.col("_type") == "other") & (bounds_problem(own).isNotNull() | ~generic_actor(own)), "abstained_ineligible_actor_noun_phrase")

    found.late_warning = late
    return found


def _action_status() -> Match:
    explicit = rf"^(.+?)\s+(?:(?:is|are|was|were|remains?|has\s+been|have\s+been)\s+)?{rules.STATUS}"
    first = rules._action_status()
    plain = _has(explicit) & ~_has(rules.RATIO)
    subject = trim(_group(explicit, 1))
    named = F.coalesce(subject.rlike(_I + rules.ACTION_WORDS), F.lit(False))
    cued = F.arrays_overlap(F.transform(tokens(subject), F.lower), F.array(*map(F.lit, ACTION_CUES)))
    kind = rules.subject_type(subject, "action_status")
    fits = kind.isin("initiative", "policy", "programme") & cued & bounds_problem(subject).isNull()
    first.when = first.when | plain
    first.warning = F.when(plain & ~named & ~F.coalesce(fits, F.lit(False)), "abstained_action_status_ineligible_subject")
    return first


MATCHERS: dict[str, Callable[[], Match]] = {
    "recommendation": rules._recommendation,
    "commitment": _commitment,
    "metric": _metric,
    "requirement": _requirement,
    "action_status": _action_status,
    "decision": _decision,
    "risk": rules._risk,
    "budget": rules._budget,
}


def outcomes(statements: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    return rules.outcomes(statements, predicates, MATCHERS, RULES, trim)


def extract(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and warnings. Of facts equal in source, subject, predicate, value and qualifiers the
    first by sequence, start and rule stays; then those that break their predicate's contract go."""
    statements = written(segmentation.statements_v2(blocks), "statements")
    rows = written(rules.candidates(outcomes(statements), blocks), "outcomes")
    made = rules.facts(rows, VERSION)
    same = Window.partitionBy("source_id", "_subject", "subject_type", "predicate", "value_key", "_qualifiers").orderBy("sequence", "start", "priority", "subject_text", "candidate_id")
    made = made.withColumns({"_subject": text.comparable(F.col("subject_text")), "_qualifiers": keys.qualifier_key(F.col("qualifiers"))})
    made = written(made.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n", "_subject", "_qualifiers"), "facts")
    broken = registry.contract_violations(made).select("candidate_id").distinct()
    kept = made.join(broken, "candidate_id", "left_anti")
    dropped = made.join(broken, "candidate_id").select("source_id", F.concat_ws(":", F.lit("abstained_incompatible_predicate_contract"), "block_id", F.concat_ws("-", "start", "end"), "rule_id").alias("warning"))
    return kept, rules.warnings(rows).unionByName(dropped).distinct()
