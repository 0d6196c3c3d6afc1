"""The third rule engine: the second one's facts with precise commitments, and three rules more.

The new rules look at whole blocks, not statements: numbered recommendations and
action ratios of documents whose title names a policy, and committed budgets.
They match across line breaks; values have their white space collapsed, while the
evidence is the text as it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import keys, numbers, text
from factloom.operators import rules, rules_v2
from factloom.storage import written

VERSION = "rules-v0.3"
_I = "(?iuU)"

# Fixed values.
RECOMMENDATION_VERBS = ["adopt", "appoint", "commit", "continue", "create", "develop", "ensure", "establish", "expand", "fund", "identify", "implement", "increase", "introduce", "launch", "publish", "reform", "require", "review", "set", "support", "work"]
AGENTIVE_VERBS = ["adopt", "appoint", "build", "commit", "create", "deliver", "develop", "establish", "expand", "fund", "implement", "invest", "launch", "maintain", "open", "procure", "provide", "publish", "reform", "require", "scale", "support", "take", "work"]
POLICY_WORDS = r"\b(?:action\s+plan|policy|recommendations?|strategy|framework)\b"
NUMBERED = r"(?U)(?:^|(?<=\s))(\d{1,3})\.\s+([^.!?]{5,500}[.!?])"
RATIOS = [
    (r"\b(?:have|has|had)\s+(?:now\s+)?(met)\s+(?:our|the|their)\s+commitments?\s+against\s+(\d+)\s+of\s+(?:the\s+)?(\d+)\s+actions?\b", 1, 2, 3),
    (r"\b(\d+)\s+(?:out\s+of|of)\s+(?:the\s+)?(\d+)\s+actions?\s+(?:were\s+|are\s+|have\s+been\s+)?(completed|met)\b", 3, 1, 2),
]
MONEY = r"(GBP|USD|EUR|£|\$|€)\s*(\d[\d,]*(?:\.\d+)?)\s*(thousand|million|billion|k|m|bn)?"
BUDGETS = [
    (r"(?:launch|development|creation)\s+of\s+([A-Z][A-Za-z0-9'&()\-/\s]{1,78}?)\s*:\s*(?s:.{0,100}?)\b(?:has|have)\s+committed\s+(?:up\s+to\s+)?" + MONEY, 1, 2),
    (r"\b(?:has|have)\s+committed\s+(?:up\s+to\s+)?" + MONEY + r"\s+to\s+([A-Z][A-Za-z0-9'&()\-/\s]{1,78}?)(?=\s+[-–—]|[.,;]|$)", 4, 1),
]
WEAK = r"^(?:will(?:\s+not)?|plans?\s+to|intends?\s+to)\s+"
MODIFIERS = r"^(?:(?:also|continue\s+to|immediately|now|only|still)\s+)*"
ACTOR_WORDS = r"\b(?:agency|authority|board|council|department|government|office|organisation|organization|programme|program|project|regulator|service|team|unit)\b"
IMPERSONAL = r"^(?:and\s+)?(?:i|it|we|you|this|that|these|those|there)\b"
MONTH_YEAR = r"^(?:" + "|".join(numbers.MONTHS) + r")\s+\d{4}$"
CODE = r"^[A-Z]{1,5}\s*\d{2,6}$"
RULES = {"numbered": "V03-RULE-REC-NUMBERED-001", "ratio": "V03-RULE-ACTION-RATIO-001", "budget": "V03-RULE-BUD-COMMITTED-001", "commitment": "V03-POLICY-COMMITMENT-PRECISION-002", "other": "V03-POLICY-V02-CARRYOVER-001"}


def policy_subject(title: Column) -> Column:
    """The longest part of a title, up to its first colon and between spaced dashes, that
    names a policy and is neither a code nor a month; else the title if it names one."""
    main = text.strip(F.get(F.split(text.collapse(F.coalesce(title, F.lit(""))), ":"), F.lit(0)))
    parts = F.filter(F.transform(F.split(main, r"(?U)\s+[-–—]\s+"), text.strip), lambda p: (p != "") & ~p.rlike(CODE) & ~p.rlike(_I + MONTH_YEAR) & p.rlike(_I + POLICY_WORDS))
    longest = F.aggregate(parts, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))
    return F.when(F.size(parts) > 0, longest).when(main.rlike(_I + POLICY_WORDS), main)


def keep_commitment() -> Column:
    """Whether a fact stays: commitments below 0.9 need a weak trigger, an actor and an action."""
    subject, raw = F.col("subject_text"), F.col("raw_value")
    action = F.regexp_replace(F.regexp_replace(raw, _I + WEAK, ""), _I + MODIFIERS, "")
    verb = F.lower(F.regexp_extract(action, "^[A-Za-z]+", 0))
    actor = F.col("subject_type").isin("initiative", "organisation", "policy", "programme") | subject.rlike(_I + ACTOR_WORDS)
    precise = raw.rlike(_I + WEAK) & ~subject.rlike(_I + IMPERSONAL) & actor & verb.isin(AGENTIVE_VERBS)
    return (F.col("predicate") != "commitment") | (F.col("confidence") >= 0.9) | precise


def _fact(rule: str, excerpt: Column, subject: Column, kind: str, predicate: str, raw: Column, value_type: str, value: Column | None, qualifiers: Column, when: Column, number: Column | None = None, currency: Column | None = None) -> Column:
    null = F.lit(None)
    made = F.struct(
        F.lit(RULES[rule]).alias("rule_id"), excerpt.alias("text_excerpt"), subject.alias("subject_text"), F.lit(kind).alias("subject_type"), F.lit(predicate).alias("predicate"), raw.alias("raw_value"),
        F.lit(value_type).alias("value_type"), (null.cast("string") if value is None else value).alias("value_text"), (null if number is None else number).cast("decimal(38,9)").alias("value_number"),
        (null.cast("string") if currency is None else currency).alias("value_currency"), qualifiers.cast("map<string,string>").alias("qualifiers"),
    )
    return F.when(when, made)


def additions(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """Facts of the new rules; ``titles``: (source_id, title), a row a source."""
    named = titles.select("source_id", policy_subject(F.col("title")).alias("_policy"))
    rows = blocks.where(F.col("block_type").isin(list(schemas.ELIGIBLE_BLOCK_TYPES))).join(named, "source_id", "left")
    none = F.create_map().cast("map<string,string>")

    def numbered(m: Column) -> Column:
        action, ident = text.collapse(F.regexp_extract(m, NUMBERED, 2)), F.regexp_extract(m, NUMBERED, 1).cast("int").cast("string")
        like = F.lower(F.regexp_extract(action, "^[A-Za-z]+", 0)).isin(RECOMMENDATION_VERBS) | action.rlike(_I + r"\bshould\s+[A-Za-z]+")
        return _fact("numbered", m, F.concat(F.col("_policy"), F.lit(" recommendation "), ident), "recommendation", "recommendation", action, "string", action, F.create_map(F.lit("recommendation_id"), ident), like & F.col("_policy").isNotNull() & (F.length(m) <= rules.MOST_EVIDENCE))

    def ratio(pattern: str, status: int, done: int, total: int):
        def make(m: Column) -> Column:
            s, d, t = F.lower(F.regexp_extract(m, _I + pattern, status)), F.regexp_extract(m, _I + pattern, done).cast("int"), F.regexp_extract(m, _I + pattern, total).cast("int")
            raw = F.concat(F.lit("Commitments "), s, F.lit(" against "), d.cast("string"), F.lit(" of the "), t.cast("string"), F.lit(" actions."))
            value = F.concat(d.cast("string"), F.lit(" of "), t.cast("string"), F.lit(" actions "), s)
            return _fact("ratio", m, F.col("_policy"), "policy", "action_status", raw, "status", value, none, F.col("_policy").isNotNull() & (t > 0) & (d <= t))

        return make

    def budget(pattern: str, subject: int, money: int):
        def make(m: Column) -> Column:
            own = F.regexp_replace(F.regexp_replace(text.collapse(F.regexp_extract(m, _I + pattern, subject)), "^[ -]+|[ -]+$", ""), _I + r"^the\s+", "")
            code, amount = numbers.money(*(F.regexp_extract(m, _I + pattern, money + k) for k in range(3)))
            fits = own.rlike("^[A-Z]") & F.size(F.split(own, " ")).between(1, 10) & (F.length(m) <= rules.MOST_EVIDENCE)
            return _fact("budget", m, own, "programme", "budget", text.collapse(m), "money", None, F.create_map(F.lit("budget_status"), F.lit("committed")), fits, amount, code)

        return make

    def each(pattern: str, make) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), make)

    found = F.concat(each(NUMBERED, numbered), *[each(_I + p, ratio(p, *g)) for p, *g in RATIOS], *[each(_I + p, budget(p, *g)) for p, *g in BUDGETS])
    return rows.withColumn("_f", F.explode(F.array_compact(found))).select("source_id", "block_id", "sequence", "location_type", "location_value", "_f.*", F.lit(0.9).alias("confidence"), F.lit("supported").alias("evidence_status"), F.lit("not_required").alias("review_status"))


def extract(blocks: DataFrame, titles: DataFrame, second: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts and warnings. Of facts equal in source, subject, predicate, value and qualifiers the
    second engine's come first, then by sequence and id. ``second``: its results, if they are there already."""
    before, warnings = second or rules_v2.extract(blocks)
    rule = F.when(F.col("predicate") == "commitment", RULES["commitment"]).otherwise(RULES["other"])
    kept = before.where(keep_commitment()).withColumn("rule_id", rule)
    new = written(additions(blocks, titles), "additions")
    made = kept.select(*new.columns, F.lit(0).alias("_new")).unionByName(new.withColumn("_new", F.lit(1)))
    made = made.withColumns({"value_key": rules.value_of(), "_subject": F.lower(text.collapse(F.col("subject_text"))), "_qualifiers": keys.qualifier_key(F.col("qualifiers"))})
    made = made.withColumn("evidence_id", keys.stable_id("V03-EVID-", F.col("source_id"), F.col("block_id"), F.col("text_excerpt")))
    parts = [F.col(c) for c in ("rule_id", "source_id", "_subject", "subject_type", "predicate", "value_type", "value_key", "_qualifiers", "block_id")]
    made = made.withColumn("candidate_id", keys.stable_id("V03-CAND-", *parts))
    first = Window.partitionBy("source_id", "_subject", "subject_type", "predicate", "value_type", "value_key", "_qualifiers").orderBy("_new", "sequence", "candidate_id", "text_excerpt")
    result = made.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_new", "_subject", "_qualifiers")
    return result.withColumn("evidence_ids", F.array("evidence_id")), warnings
