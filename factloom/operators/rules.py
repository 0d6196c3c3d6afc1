"""The first rule engine: statements into typed candidate facts with evidence.

Each rule is a set of expressions over one statement row. A statement yields an
outcome for each rule that matches: a candidate, or a warning that says why none
was made. Nothing is shuffled before equal candidates are put together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import frames, keys, numbers, text
from factloom.operators import segmentation
from factloom.storage import written

VERSION = "rules-v0.1"
MOST_EVIDENCE = 240
_I = "(?iuU)"

# Fixed values.
RULES = {
    "recommendation": ("DET-RULE-REC-001", 10),
    "commitment": ("DET-RULE-COM-001", 20),
    "requirement": ("DET-RULE-REQ-001", 30),
    "decision": ("DET-RULE-DEC-001", 40),
    "risk": ("DET-RULE-RISK-001", 50),
    "metric": ("DET-RULE-MET-001", 60),
    "budget": ("DET-RULE-BUD-001", 70),
    "action_status": ("DET-RULE-ACT-001", 80),
}
COMMITMENT = r"(?:will(?:\s+not)?|commits?\s+to|has\s+committed\s+to|intends?\s+to|plans?\s+to)"
REQUIREMENT = r"(?:must(?:\s+not)?|shall(?:\s+not)?|is\s+required\s+to|are\s+required\s+to|required\s+to)"
DECISION = r"(?:decided\s+to|agreed\s+to|approved|selected|chose\s+to|resolved\s+to)"
RISK = r"(?:(?:identified\s+)?risk\s+(?:of|that)|identified\s+risk\s*:|threat\s+of|adverse\s+impact)"
PERCENT = r"(\d+(?:\.\d+)?)\s*(%|percent(?:age\s+points?)?)(?![A-Za-z])"
COUNT = r"(\d[\d,]*(?:\.\d+)?)\s+(participants|respondents|users|projects|services|cases|requests|applications)\b"
RATIO = r"(\b\d+\s+(?:of|out\s+of)\s+\d+\s+((?:identified\s+)?actions?)\s+(?:(?:were|are|have\s+been)\s+)?(?:completed|met)\b)"
CURRENCY = (
    r"(?:(up\s+to)\s+)?(?:(GBP|USD|EUR|£|\$|€)\s*(\d[\d,]*(?:\.\d+)?)\s*(thousand|million|billion|k|m|bn)?"
    r"|(\d[\d,]*(?:\.\d+)?)\s*(thousand|million|billion|k|m|bn)?\s*(GBP|USD|EUR))"
)
STATUS = r"(not\s+started|in\s+progress|on\s+track|delayed|completed|delivered|met)\b"
NO_SUBJECT = ["it", "it is", "it was", "this", "they", "there", "there is", "there was"]
SUBJECT_TYPES = [
    ("programme", r"\bprogramme?s?\b|\bprograms?\b"),
    ("policy", r"\bpolicy\b|\bstrategy\b|\bframework\b|\bplan\b"),
    ("initiative", r"\bproject\b|\binitiative\b|\bplatform\b|\bservice\b|\bsystem\b"),
    ("organisation", r"\bgovernment\b|\bdepartment\b|\bboard\b|\bcouncil\b|\bauthority\b|\bregulator\b|\borganisation\b|\borganization\b|\bagency\b|\bcommittee\b|\boffice\b|\bteam\b"),
]
METRIC_WORDS = r"\brate\b|\bmeasure\b|\bpopulation\b|\brespondents?\b|\bparticipants?\b|\busers?\b|\bresidents?\b"
ACTION_WORDS = r"\baction\b|\btask\b|\bmilestone\b|\bworkstream\b|\bdeliverable\b|\brecommendation\b"
ORGANISATIONS = r"\b(?:board|council|department|authority|agency|committee|team)\b"



def _t() -> Column:
    return F.col("text")


def _has(pattern: str, of: Column | None = None) -> Column:
    return (_t() if of is None else of).rlike(_I + pattern)


def _group(pattern: str, group: int, of: Column | None = None) -> Column:
    """A group of the first match, which is made once; null without a match or if it is empty."""
    found = F.regexp_extract(_t() if of is None else of, _I + pattern, group)
    return F.get(F.filter(F.array(found), lambda g: F.length(g) > 0), F.lit(0))


def _count(pattern: str) -> Column:
    return F.size(F.regexp_extract_all(_t(), F.lit(_I + pattern), F.lit(0)))


def _may(words: list[str]) -> Column:
    """Whether the folded statement ``_low`` has one of the words, or no word is asked for."""
    low = F.col("_low")
    return reduce(Column.__or__, [low.rlike(r"(?U)\d") if w == "0" else F.contains(low, F.lit(w)) for w in words]) if words else F.lit(True)


def trim_subject(value: Column) -> Column:
    """Without white space, list marks before and punctuation behind."""
    return F.regexp_replace(F.regexp_replace(value, r"(?U)\A[\s\-•]+", ""), r"(?U)[\s:;|,\-]+\z", "")


def subject_type(value: Column, predicate: str) -> Column:
    """The first kind whose words a subject has."""
    low = F.lower(value)
    out = F.when(F.lit(predicate == "recommendation") & low.rlike(r"(?U)^recommendation\s+\d+$"), "recommendation")
    for name, pattern in SUBJECT_TYPES:
        out = out.when(low.rlike("(?U)" + pattern), name)
    if predicate == "risk":
        out = out.when(low.rlike(r"(?U)\brisk\b|\bthreat\b"), "risk")
    if predicate == "decision":
        out = out.when(low.contains("decision"), "decision")
    return out.when(F.lit(predicate == "metric") | low.rlike("(?U)" + METRIC_WORDS), "metric").otherwise("other")


def subject_is_ambiguous(value: Column) -> Column:
    """Alternatives, or two organisations joined by "and" or "or"."""
    parts = F.split(value, _I + r"\s+(?:and|or)\s+")
    return value.contains(" / ") | value.contains(";") | ((F.size(parts) > 1) & (F.size(F.filter(parts, lambda p: p.rlike(_I + ORGANISATIONS))) > 1))


@dataclass
class Match:
    """What one rule finds in a statement, as expressions over the statement's row.

    ``subject`` is null where the heading before must serve. ``warning`` stands before
    the checks of the subject, ``late_warning`` behind them. ``checked`` says whether the subject is checked at all.
    ``qualifiers`` may use ``subject_text``. ``picks`` are several readings, structs (subject,
    raw, number, start), that take the place of one; ``rule`` is a rule id other than the predicate's.
    ``steps`` are columns made before all others but ``when``, each dict from those before, so that a pattern
    is matched once for all that use it. ``words``, folded, are such that a statement has one of them where ``when``
    holds, or "0" for any digit: without them no pattern is tried.
    """

    when: Column
    subject: Column | None
    raw: Column
    value_type: Column | str = "string"
    number: Column | None = None
    currency: Column | None = None
    qualifiers: dict[str, Callable[[], Column]] = field(default_factory=dict)
    warning: Column | None = None
    late_warning: Callable[[], Column] | None = None
    kind: Column | str | None = None
    confidence: Column | None = None
    status: Column | None = None
    checked: Column | None = None
    budget: bool = False
    picks: Column | None = None
    rule: Column | None = None
    steps: list[dict[str, Column]] = field(default_factory=list)
    words: list[str] = field(default_factory=list)


def _recommendation() -> Match:
    numbered = segmentation.NUMBERED_RECOMMENDATION.removeprefix(_I)
    explicit = r"^(.+?)\s+(?:recommends?|recommended)\s+(?:that\s+)?(.+)$"
    context = r"^(?:recommends?|recommended)\s+(?:that\s+)?(.+)$"
    listed, spoken = F.col("_rec_listed"), F.col("_rec_explicit")
    return Match(
        when=_has(numbered) | _has(explicit) | _has(context),
        subject=F.when(listed, _group(numbered, 1)).when(spoken, _group(explicit, 1)),
        raw=text.strip(F.when(listed, _group(numbered, 3)).when(spoken, _group(explicit, 2)).otherwise(_group(context, 1))),
        qualifiers={"recommendation_id": lambda: F.when(listed, _group(numbered, 2).cast("int"))},
        late_warning=lambda: F.when(F.coalesce(F.length("raw_value"), F.lit(0)) == 0, "abstained_ambiguous_relationship"),
        kind=F.when(listed, "recommendation"),
        checked=~listed,
        steps=[{"_rec_listed": _has(numbered), "_rec_explicit": _has(explicit)}],
        words=["recommend"],
    )


def _actor(trigger: str, words: list[str]) -> Match:
    explicit, context = rf"^(.+?)\s+({trigger}\b.+)$", rf"^({trigger}\b.+)$"
    return Match(
        when=_has(explicit) | _has(context),
        subject=_group(explicit, 1),
        raw=text.strip(F.coalesce(_group(explicit, 2), _group(context, 1))),  # neither group is ever empty
        words=words,
    )


def _decision() -> Match:
    found = _actor(DECISION, ["decided", "agreed", "approved", "selected", "chose", "resolved"])
    found.when = found.when & ~_has(r"\b(?:proposal|proposed|option)\b.*\b(?:approve|select|choose)\b")
    return found


def _risk() -> Match:
    cell = rf"^([^|]{{1,100}}?)\s*\|\s*({RISK}.+)$"
    patterns = [
        r"^(.+?)\s+((?:may|could|will)\s+have\s+an?\s+adverse\s+impact.+)$",
        rf"^(.+?)\s+((?:faces?\s+)?(?:an?\s+)?{RISK}.+)$",
        rf"^(.+?)\s*:\s*({RISK}.+)$",
    ]
    context = rf"^({RISK}.+)$"
    subject, raw = F.lit(None).cast("string"), _group(context, 1)
    for pattern in reversed(patterns):
        subject, raw = F.when(_has(pattern), _group(pattern, 1)).otherwise(subject), F.when(_has(pattern), _group(pattern, 2)).otherwise(raw)
    table = F.col("block_type") == "table"
    own = trim_subject(_group(cell, 1))
    unclear = F.coalesce((F.length(own) == 0) | subject_is_ambiguous(own), F.lit(True))
    return Match(
        when=_has(RISK),
        subject=F.when(table, _group(cell, 1)).otherwise(subject),
        raw=text.strip(F.when(table, _group(cell, 2)).otherwise(raw)),
        warning=F.when(table & unclear, "skipped_flattened_table_relationship").when(~table & raw.isNull(), "abstained_missing_subject"),
        confidence=F.when(table, 0.5),
        status=F.when(table, "ambiguous"),
        checked=~table,
        words=["risk", "threat", "adverse"],
    )


def _metric() -> Match:
    first = rf"^(.*?){PERCENT}(.*)$"
    after = r"^\s+of\s+([A-Za-z][A-Za-z0-9 '\-/]{0,80}?)(?=\s+(?:were|was|are|is|had|have|reported|used|completed|met|said|received|adopted)\b)"
    before = r"^(.+?)\s+(?:was|were|is|are|reached|stood\s+at|measured)\s*$"
    rest, lead = F.regexp_extract(_t(), _I + first, 4), F.regexp_extract(_t(), _I + first, 1)
    population = text.strip(_group(after, 1, rest))
    share = _count(PERCENT) > 0
    unit = _group(COUNT, 2)

    def slug() -> Column:
        return F.when(share, text.metric_slug(F.col("subject_text"), True)).otherwise(text.metric_slug(F.concat(unit, F.lit(" count")), False))

    return Match(
        when=~_has(CURRENCY) & ~_has(RATIO) & (share | (_count(COUNT) > 0)),
        subject=F.when(share, F.coalesce(population, _group(before, 1, lead))).otherwise(unit),
        raw=F.when(share, F.regexp_extract(_t(), _I + PERCENT, 0)).otherwise(F.regexp_extract(_t(), _I + COUNT, 0)),
        value_type=F.when(share, "percentage").otherwise("number"),
        number=F.when(share, _group(first, 2)).otherwise(F.regexp_replace(_group(COUNT, 1), ",", "")),
        qualifiers={
            "metric_name": slug,
            "unit": lambda: F.when(share, "percent").otherwise(F.lower(unit)),
            "population": lambda: F.when(share, population).otherwise(unit),
            "period": lambda: numbers.period(_t()),
        },
        warning=F.when((_count(PERCENT) > 1) | (~share & (_count(COUNT) > 1)), "abstained_multiple_values"),
        late_warning=lambda: F.when(F.length(slug()) == 0, "abstained_missing_subject"),
        kind="metric",
        words=["0"],
    )


def _budget() -> Match:
    # the pattern looks neither ahead nor back, so it finds in the first match alone what it found there in the text
    raw, at = F.col("_sum"), F.call_function("instr", _t(), F.col("_sum"))
    first = {"_sum": F.regexp_extract(_t(), _I + CURRENCY, 0)}
    parts = {f"_sum{i}": _group(CURRENCY, i, raw) for i in range(1, 8)}
    parts |= {"_lead": F.substring(_t(), F.lit(1), at - 1), "_rest": F.substring(_t(), at + F.length(raw), F.length(_t()))}
    part = lambda i: F.col(f"_sum{i}")
    lead, rest = F.col("_lead"), F.col("_rest")
    holders = [
        r"^(.+?)\s+(?:has|received|secured|was\s+granted|is\s+allocated|was\s+allocated|will\s+receive)\b",
        r"^(.+?)\s+(?:(?:has\s+)?(?:an?\s+)?(?:approved|committed|proposed)?\s*)(?:budget|funding|investment|allocation)\b",
    ]
    given = r"\b(?:allocated|granted|provided|committed|invested)\s+to\s+([^.;]+)"
    code, amount = numbers.money(F.coalesce(part(2), part(7)), F.coalesce(part(3), part(5)), F.coalesce(part(4), part(6)))
    vague = _has(r"\b(?:about|approximately|around|roughly|circa)\s*$", F.right(lead, F.lit(24)))
    state = F.when(part(1).isNotNull(), "ceiling")
    for word in ("approved", "committed", "proposed"):
        state = state.when(_has(rf"\b{word}\b"), word)
    spoken = _has(r"\bbudget\b|\bfunding\b|\bfunded\b|\binvestment\b|\binvested\b|\ballocation\b|\ballocated\b")
    return Match(
        when=spoken & _has(CURRENCY),
        subject=F.coalesce(*[_group(p, 1, lead) for p in holders], _group(given, 1, rest)),
        raw=raw,
        value_type="money",
        number=amount,
        currency=code,
        qualifiers={"budget_status": lambda: state},
        warning=F.when(_count(CURRENCY) > 1, "abstained_multiple_values").when(vague, "abstained_ambiguous_relationship"),
        budget=True,
        steps=[first, parts],
        words=["budget", "fund", "invest", "allocat"],
    )


def _action_status() -> Match:
    action = r"\bAction\s+([A-Za-z0-9][A-Za-z0-9-]*)\b"
    ratio, named = F.col("_act_ratio"), F.col("_act_named")
    lead = trim_subject(F.regexp_extract(_t(), _I + rf"^(.*?){RATIO}", 1))
    explicit = rf"^(.+?)\s+(?:(?:is|are|was|were|remains?|has\s+been|have\s+been)\s+)?{STATUS}"
    context = rf"^{STATUS}"
    fits = F.when(_has(explicit), _has(ACTION_WORDS, trim_subject(_group(explicit, 1)))).when(_has(context), F.coalesce(_has(ACTION_WORDS, F.col("context")), F.lit(False))).otherwise(False)
    return Match(
        when=_has(RATIO) | fits,
        subject=F.when(ratio, F.when((F.length(lead) > 0) & _has(ACTION_WORDS, lead), lead).otherwise(_group(RATIO, 2))).otherwise(named),
        raw=F.when(ratio, _group(RATIO, 1)).when(named.isNotNull(), _group(explicit, 2)).otherwise(_group(context, 1)),
        value_type="status",
        qualifiers={"action_id": lambda: _group(action, 1, F.when(ratio, _t()).otherwise(F.col("subject_text")))},
        steps=[{"_act_ratio": _has(RATIO), "_act_named": _group(explicit, 1)}],
        words=["started", "progress", "track", "delayed", "completed", "delivered", "met"],
    )


MATCHERS: dict[str, Callable[[], Match]] = {
    "recommendation": _recommendation,
    "commitment": lambda: _actor(COMMITMENT, ["will", "commit", "intend", "plan"]),
    "requirement": lambda: _actor(REQUIREMENT, ["must", "shall", "required"]),
    "decision": _decision,
    "risk": _risk,
    "metric": _metric,
    "budget": _budget,
    "action_status": _action_status,
}


def _by_rule(found: dict[str, Match], get: Callable[[Match], Column | None], kind: str) -> Column:
    """For each row the expression of its rule, null for rules that have none."""
    out = None
    for name, match in found.items():
        value = get(match)
        if value is not None:
            value = value if isinstance(value, Column) else F.lit(value)
            out = F.when(F.col("predicate") == name, value) if out is None else out.when(F.col("predicate") == name, value)
    return F.lit(None).cast(kind) if out is None else out.cast(kind)


def outcomes(statements: DataFrame, predicates: list[str] | None = None, matchers: dict[str, Callable[[], Match]] | None = None, inventory: dict[str, tuple[str, int]] | None = None, trim: Callable[[Column], Column] = trim_subject) -> DataFrame:
    """One row for each statement and rule that matched: candidate fields, or ``warning``.

    Rows multiply first, by a filter of each rule's pattern; what a rule finds, its
    subject, and the checks follow in steps of their own, each on the settled columns before.
    """
    chosen, inventory = matchers or MATCHERS, inventory or RULES
    found = {p: chosen[p]() for p in (predicates or chosen)}
    if len(found) == 1:
        rows = frames.exploded(statements, F.array(*[F.when(m.when, p) for p, m in found.items()]), "predicate")
    else:  # so many patterns do not fit into one compiled stage
        rows = frames.settled(statements, {"_low": text.folded(_t())})
        rows = written(frames.exploded(rows, F.array(*[F.when(_may(m.words) & m.when, p) for p, m in found.items()]), "predicate").drop("_low"), "matched")
    for steps in zip_longest(*[m.steps for m in found.values()], fillvalue={}):
        made = {c: F.when(F.col("predicate") == name, v) for name, step in zip(found, steps) for c, v in step.items()}
        rows = frames.settled(rows, made) if made else rows
    rows = frames.settled(rows, {
        "_found": _by_rule(found, lambda m: m.subject, "string"),
        "raw_value": _by_rule(found, lambda m: m.raw, "string"),
        "value_type": _by_rule(found, lambda m: m.value_type, "string"),
        "value_number": _by_rule(found, lambda m: m.number, "decimal(38,9)"),
        "value_currency": _by_rule(found, lambda m: m.currency, "string"),
        "_early": _by_rule(found, lambda m: m.warning, "string"),
        "_checked": F.coalesce(_by_rule(found, lambda m: m.checked, "boolean"), F.lit(True)),
        "evidence_status": F.coalesce(_by_rule(found, lambda m: m.status, "string"), F.lit("supported")),
        "_confidence": _by_rule(found, lambda m: m.confidence, "double"),
    })
    if any(m.picks is not None for m in found.values()):
        rows = rows.withColumn("_pick", F.explode_outer(_by_rule(found, lambda m: m.picks, "array<struct<subject:string,raw:string,number:string,start:int>>")))
        pick = F.col("_pick")
        rows = rows.withColumns({"_found": F.coalesce(pick["subject"], "_found"), "raw_value": F.coalesce(pick["raw"], "raw_value"), "value_number": F.coalesce(pick["number"].cast("decimal(38,9)"), "value_number"), "_from": pick["start"]})
    else:
        rows = rows.withColumn("_from", F.lit(None).cast("int"))
    own = F.col("_found").isNotNull()
    rows = frames.settled(rows, {
        "subject_text": F.when(own, trim(F.col("_found"))).otherwise(F.col("context")),
        "confidence": F.coalesce("_confidence", F.when(own, 0.9).otherwise(0.7)),
        "evidence_start": F.when(F.col("_from").isNotNull(), F.col("_from")).when(own, F.col("start")).otherwise(F.col("context_start")).cast("int"),
        "value_text": F.when(F.col("value_type").isin("string", "status"), text.collapse(F.col("raw_value"))),
    })
    if len(found) > 1:
        rows = written(rows, "found")
    kinds = _by_rule(found, lambda m: m.kind, "string")
    types = None
    for name in found:
        kind = subject_type(F.col("subject_text"), name)
        types = F.when(F.col("predicate") == name, kind) if types is None else types.when(F.col("predicate") == name, kind)
    rows = rows.withColumns({"_type": types, "_kind": kinds})
    subject = F.col("subject_text")
    missing = subject.isNull() | (F.length(subject) == 0) | (F.length(subject) >= 120) | F.lower(subject).isin(NO_SUBJECT)
    money = F.col("predicate").isin([p for p, m in found.items() if m.budget])
    problem = F.when(F.col("_checked"), F.when(missing, "abstained_missing_subject").when(subject_is_ambiguous(subject), "abstained_ambiguous_relationship").when(money & ~F.col("_type").isin("initiative", "programme", "policy", "organisation"), "abstained_unsupported_subject_type"))
    late = _by_rule(found, lambda m: m.late_warning() if m.late_warning else None, "string")
    names = sorted({q for m in found.values() for q in m.qualifiers})
    empty = F.array().cast("array<struct<key:string,value:string>>")
    pairs = empty if not names else F.array(*[F.struct(F.lit(q).alias("key"), _by_rule(found, lambda m, q=q: m.qualifiers[q]() if q in m.qualifiers else None, "string").alias("value")) for q in names])
    rows = frames.settled(rows, {
        "warning": F.coalesce("_early", problem, late),
        "subject_type": F.coalesce("_kind", "_type"),
        "qualifiers": F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())),
        "rule_id": F.coalesce(_by_rule(found, lambda m: m.rule, "string"), F.try_element_at(_constant({p: inventory[p][0] for p in found}), F.col("predicate"))),
        "priority": F.try_element_at(_constant({p: inventory[p][1] for p in found}), F.col("predicate")),
    })
    return rows.select(
        "source_id", "block_id", "sequence", "block_type", "line_number", F.col("text").alias("statement"), "start", "end", "context", "rule_id", "priority", "predicate", "warning",
        "subject_text", "subject_type", "raw_value", "value_type", "value_text", "value_number", "value_currency", "qualifiers", "confidence", "evidence_status", "evidence_start",
    )


def _constant(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def candidates(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Candidates with their evidence text; too long evidence becomes a warning. Blocks are
    joined by id for the exact text between the evidence offsets."""
    texts = blocks.select("source_id", "block_id", F.col("text").alias("_block"), "location_type", "location_value")
    rows = found.join(texts, ["source_id", "block_id"])
    excerpt = F.substring(F.col("_block"), F.col("evidence_start") + 1, F.col("end") - F.col("evidence_start"))
    rows = rows.withColumn("text_excerpt", F.when(F.col("warning").isNull(), excerpt)).drop("_block")
    long = F.when(F.col("warning").isNull() & (F.length("text_excerpt") > MOST_EVIDENCE), "abstained_evidence_too_long")
    return rows.withColumn("warning", F.coalesce("warning", long))


def value_of() -> Column:
    return keys.value_key(F.col("value_type"), F.col("value_text"), F.col("value_number"), F.col("value_currency"))


def facts(rows: DataFrame, version: str = VERSION) -> DataFrame:
    """Facts with ids; of equal ones (same rule, statement, subject, value, qualifiers and
    evidence) the first by sequence, start, priority and id stays."""
    good = rows.where("warning IS NULL")
    qualifiers = keys.qualifier_key(F.col("qualifiers"))
    evidence = keys.stable_id("EVID-", *[F.col(c) for c in ("source_id", "block_id", "location_type", "location_value", "evidence_start", "end", "evidence_status")])
    good = good.withColumn("evidence_id", evidence).withColumn("value_key", value_of())
    ident = keys.stable_id("CAND-", F.lit(version), *[F.col(c) for c in ("source_id", "block_id", "rule_id", "start", "end", "subject_text", "subject_type", "predicate", "value_key")], qualifiers, F.col("evidence_id"))
    good = good.withColumn("candidate_id", ident)
    first = Window.partitionBy("candidate_id").orderBy("sequence", "start", "priority", "end")
    kept = good.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "warning")
    review = F.when((F.col("confidence") == 0.5) | (F.col("evidence_status") == "ambiguous"), "required").otherwise("not_required")
    return kept.withColumn("review_status", review).withColumn("evidence_ids", F.array("evidence_id"))


def warnings(rows: DataFrame) -> DataFrame:
    """Distinct warnings ``code:block:start-end:rule``."""
    text_ = F.concat(F.col("warning"), F.lit(":"), F.col("block_id"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(":"), F.col("rule_id"))
    return rows.where("warning IS NOT NULL").select("source_id", text_.alias("warning")).distinct()


def extract(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and warnings of blocks. Statements and what the rules make of them are written, so that each
    pattern is matched once, whatever reads the results."""
    statements = written(segmentation.statements(blocks), "statements")
    rows = written(candidates(outcomes(statements), blocks), "outcomes")
    return facts(rows), warnings(rows)
