"""The fourth rule engine: commitments of the third with resolved actors and plain values,
and commitments that only the second engine kept, completed to whole sentences.

Everything is an expression on the fact's row, joined once with its block and once with
its source's trusted actors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import frames, keys, text
from factloom.operators import rules, rules_v2, rules_v3
from factloom.storage import written

VERSION = "rules-v0.4"
_I = "(?iuU)"

# Fixed values.
FIRST_PERSON = r"^(?:we|our)$"
GOVERNMENT = r"^(?:the\s+)?government$"
ORGANISATION = r"\b(?:administration|agency|association|authority|board|commission|company|corporation|council|department|foundation|government|group|institute|limited|ministry|office|secretariat|service|university)\b"
ACTOR_HEAD = r"\b(?:administration|agency|association|authority|board|commission|company|corporation|council|department|foundation|government|group|initiative|institute|limited|ministry|office|organisation|organization|program|programme|project|secretariat|service|team|unit|university)\b"
NAMED_ACTOR = r"^(?:The\s+)?[A-Z][A-Za-z&'-]*(?:\s+(?:[A-Z][A-Za-z&'-]*|of|the|and|for)){0,11}$"
GENERIC_ACTOR = r"^(?:the\s+)?(?:agenc(?:y|ies)|authorit(?:y|ies)|boards?|commissions?|councils?|departments?|ministries|offices?|organisations?|organizations?|programmes?|programs?|projects?|regulators?|services?|teams?|units?)$"
AUTHOR_KEY = r"(?:^|_)(?:author|authoring_body|issuing_body|responsible_department|document_author|authored_by|issued_by)(?:$|_)"
ISSUED_BY = r"\b(?i:issued|published|authored|prepared|presented)\s+by\s+(?:the\s+)?([A-Z][A-Za-z&'-]*(?:\s+(?:[A-Z][A-Za-z&'-]*|of|the|and|for)){1,11})(?=\s*(?:[.;,]|$))"
SOFTWARE = r"(?:microsoft|adobe|libreoffice|acrobat|word\b)"
PERSON = r"^[A-Z][A-Za-z'-]+,\s*[A-Z][A-Za-z'-]+(?:\s|\(|$)"
MODIFIER = r"^(?:now|also|immediately|still|only)\b\s*"
PLANNED = r"^(?:intend(?:s)?\s+to|plan(?:s)?\s+to|commit(?:s)?\s+to|has\s+committed\s+to)\b"
WRAPPER = r"^take\s+forward\s+the\s+recommendation\s+to\s+(.+)$"
CUT_OFF = r"\b(?:and|or|the|a|an|to|of|for|with|that|which|who|into|from|by)\s*[.,;:]?$"
SPEECH = r"(?:\baccording\s+to\b[^.!?\n]{0,100},|\b(?:said|stated|reported|wrote|announced|claimed|argued|told)\b[^.!?\n]{0,100}(?:that|[:,]))\s*$"
QUOTED_SUBJECT = "[\"'“”‘’]\\s*(?:we|our|(?:the\\s+)?government)\\b"
VERBS = ["accept", "adopt", "appoint", "build", "commit", "create", "deliver", "deploy", "develop", "establish", "expand", "fund", "implement", "invest", "launch", "maintain", "open", "procure", "provide", "publish", "reform", "require", "scale", "seek", "set", "start", "support", "suspend", "take", "work"]
ABBREVIATIONS = ("dr", "e.g", "etc", "i.e", "mr", "mrs", "ms", "no", "prof", "st", "u.k", "u.s", "vs")
MOST_SENTENCE = 500
RULES = {"carry": "V04-POLICY-V03-CARRYOVER-001", "actor": "V04-POLICY-COMMITMENT-ACTOR-002", "value": "V04-POLICY-COMMITMENT-VALUE-003", "recovered": "V04-RULE-COMMITMENT-RECOVERY-004"}


def organisation(value: Column) -> Column:
    """A trimmed organisation name, null for persons, software, acronyms and fragments."""
    name = F.regexp_replace(F.regexp_replace(text.collapse(value), r"^[\s,;:.()\[\]{}]+|[\s,;:.()\[\]{}]+$", ""), _I + r"^the\s+", "")
    acronym = (F.upper(name) == name) & (F.length(F.replace(name, F.lit(" "), F.lit(""))) <= 12)
    bad = ~F.length(name).between(2, 120) | name.rlike(_I + SOFTWARE) | name.rlike(PERSON) | (F.size(F.split(name, " ")) < 2) | name.rlike(_I + CUT_OFF) | acronym
    return F.when(~bad & name.rlike(_I + ORGANISATION), name)


def trusted_actors(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source_id, actors, actor, method): how many organisations a document names as its author,
    and the one if it is one. ``documents``: source_id, authors array, metadata map."""
    authors = documents.select("source_id", F.explode("authors").alias("v"), F.lit("authors_or_senders").alias("method"))
    named = documents.select("source_id", F.explode("metadata").alias("k", "v")).where(F.col("k").rlike(_I + AUTHOR_KEY)).select("source_id", "v", F.lit("authoring_metadata").alias("method"))
    place = Window.partitionBy("source_id").orderBy("sequence", "block_id")
    front = blocks.withColumn("_n", F.row_number().over(place)).where("_n <= 4").where(F.col("block_type").isin([*schemas.ELIGIBLE_BLOCK_TYPES, "metadata"]))
    issued = front.select("source_id", F.explode(F.regexp_extract_all(text.collapse(F.substring("text", 1, 2000)), F.lit(ISSUED_BY), F.lit(1))).alias("v"), F.lit("role_aware_front_matter").alias("method"))
    every = authors.unionByName(named).unionByName(issued).withColumn("actor", organisation(F.col("v"))).where("actor IS NOT NULL")
    return every.groupBy("source_id").agg(F.count_distinct(F.lower("actor")).alias("actors"), F.min_by("actor", F.struct(F.lower("actor"), "method")).alias("actor"), F.min("method").alias("method"))


def _surroundings(rows: DataFrame) -> DataFrame:
    """Adds the 180 characters _before the subject and 120 from it on, _behind; an excerpt that is not unique in
    its block is looked at alone. In steps, so that each text is searched once."""
    block, excerpt, at = F.col("_block"), F.col("text_excerpt"), F.col("_at")
    times = (F.length(block) - F.length(F.replace(block, excerpt, F.lit("")))) / F.length(excerpt)
    inside = F.greatest(F.call_function("instr", excerpt, F.col("subject_text")), F.lit(1))
    rows = frames.settled(rows, {"_once": F.coalesce(times == 1, F.lit(False)), "_inside": inside, "_own": text.collapse(F.col("subject_text"))})
    rows = frames.settled(rows, {"_at": F.when(F.col("_once"), F.call_function("instr", block, excerpt) + F.col("_inside") - 1).otherwise(F.col("_inside"))})
    whole = F.when(F.col("_once"), block).otherwise(excerpt)
    low = F.greatest(at - 180, F.lit(1))
    return frames.settled(rows, {"_before": F.substring(whole, low, at - low), "_behind": F.substring(whole, at, F.lit(120))}).drop("_once", "_inside", "_at")


def _quoted() -> Column:
    """Whether the subject stands in a quotation or in reported speech, by its surroundings."""
    before, behind, subject = F.col("_before"), F.col("_behind"), F.col("_own")
    line = F.concat(F.regexp_extract(before, r"[^\n]*\z", 0), F.regexp_extract(behind, r"\A[^\n]*", 0))
    named = subject.rlike(_I + "(?:^according\\s+to\\b[^.!?\\n]{1,100},\\s*|^.{1,100}\\b(?:said|stated|reported|wrote|announced|claimed|argued|told)\\b[^.!?\\n]{0,40}(?:that|[:,])\\s*)[\"'“”‘’]?\\s*(?:we|our|(?:the\\s+)?government)\\b")
    return named | subject.rlike(_I + QUOTED_SUBJECT) | line.rlike(r"^\s*(?:>|\|)") | before.rlike("[\"“‘]\\s*\\z") | behind.rlike(_I + QUOTED_SUBJECT) | before.rlike(_I + SPEECH)


def statement_actor(subject: Column) -> Column:
    """Whether a subject alone is a complete actor: a generic body or a named one with a head noun."""
    whole = F.length(subject).between(2, 120) & ~subject.rlike("[,:;\"“”‘’()\\[\\]{}]") & ~subject.rlike(_I + CUT_OFF)
    return whole & (subject.rlike(_I + GENERIC_ACTOR) | (subject.rlike(NAMED_ACTOR) & subject.rlike(_I + ACTOR_HEAD)))


def _resolved(rows: DataFrame) -> DataFrame:
    """Adds _subject, _type and _method: who acts."""
    rows, own = _surroundings(rows), F.col("_own")
    first, government = own.rlike(_I + FIRST_PERSON), own.rlike(_I + GOVERNMENT)
    state = F.lower("actor").contains("government")
    method = (
        F.when(_quoted(), "quotation_or_reported_speech_blocked")
        .when(~first & ~government, F.when(statement_actor(own), "explicit_statement_actor").otherwise("preserved_parent_subject"))
        .when(F.coalesce(F.col("actors"), F.lit(0)) != 1, "unresolved")
        .when(government & ~state, "unresolved")
        .otherwise(F.col("method"))
    )
    rows = frames.settled(rows, {"_method": method, "_first": first}).drop("_own", "_before", "_behind")
    trusted = F.col("_method").isin("authors_or_senders", "authoring_metadata", "role_aware_front_matter")
    return rows.withColumns({"_subject": F.when(trusted, F.col("actor")).otherwise(F.col("subject_text")), "_type": F.when(trusted, "organisation").otherwise(F.col("subject_type"))})


def _upper_first(value: Column) -> Column:
    return F.concat(F.upper(F.substring(value, 1, 1)), F.substring(value, F.lit(2), F.length(value)))


def action_verb(value: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text.strip(value), _I + r"^(?:intend(?:s)?\s+to|plan(?:s)?\s+to|commit(?:s)?\s+to|has\s+committed\s+to|will\s+not)\s+", ""), _I + "^(?:" + MODIFIER.removeprefix("^") + ")*", "")
    return F.lower(F.regexp_extract(bare, "^[A-Za-z]+", 0))


def plain_value(raw: Column) -> tuple[Column, Column]:
    """The value of a commitment and how it was made: an affirmative "will" goes, negation,
    intent and modifiers stay, a safe wrapper gives way to what it wraps."""
    made = text.bound(text.collapse(raw), lambda value: text.bound(F.regexp_replace(value, _I + r"^will\s+", ""), lambda action: text.bound(text.strip(F.regexp_extract(action, _I + WRAPPER, 1)), lambda inner: text.bound(_how(value, action, inner), lambda how: F.struct(_kept(value, action, inner, how).alias("value"), how.alias("how"))))))
    return made["value"], made["how"]


def _kept(value: Column, action: Column, inner: Column, how: Column) -> Column:
    return _upper_first(F.when(how == "safe_recommendation_wrapper_collapsed", inner).when(how == "affirmative_will_removed", action).otherwise(value))


def _how(value: Column, action: Column, inner: Column) -> Column:
    safe = action_verb(inner).isin(VERBS) & (F.size(F.regexp_extract_all(inner, F.lit("[A-Za-z0-9]+"), F.lit(0))) >= 3) & ~inner.rlike(_I + CUT_OFF) & ~inner.rlike(_I + r"\b(?:not|might|may|could|perhaps|this|these|those|it|them|they)\b")
    wrapped = action.rlike(_I + WRAPPER)
    return (
        F.when(value.rlike(_I + r"^will\s+not\b"), "negation_preserved")
        .when(value.rlike(_I + PLANNED), "intent_or_planning_preserved")
        .when(~value.rlike(_I + r"^will\s+"), "capitalisation_only")
        .when(wrapped & safe, "safe_recommendation_wrapper_collapsed")
        .when(wrapped, "unsafe_wrapper_preserved")
        .otherwise("affirmative_will_removed")
    )


# A sentence as one pattern. Possessive runs keep matching linear.
_ABBREVIATED = r"(?<=(?:\A|[^A-Za-z.])\.{0,3}(?i:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r"))\."
_TITLED = r"(?:[^A-Za-z0-9\n]*+[A-Z][A-Za-z0-9]*+){1,10}+[^A-Za-z0-9\n]*+"
_CAPITALS = r"(?=[^\n]*\p{Lu})(?:[^A-Za-z0-9\n\p{Ll}]*+[A-Z0-9]++){1,10}+[^A-Za-z0-9\n\p{Ll}]*+"
_HEADING = r"(?=[^\n]{1,80}(?:\n|\z))(?![^\n]*[.!?][ \t\r]*(?:\n|\z))(?:" + _TITLED + "|" + _CAPITALS + r")(?:\n|\z)"
_LINE = r"\n(?![\r\n]*(?:[ \t]*(?:\d{1,3}[.)]|[-*•])\s|" + _HEADING + "))"
_PARENTHESIS = rf"\((?:[^()\n]|{_LINE}|\((?:[^()\n]|{_LINE})*+\))*+\)"
_RUN = rf"(?:[^.!?(\n]|{_LINE}|{_PARENTHESIS}|\.(?=\S)|{_ABBREVIATED})*+[.!?]"
_CLOSING = rf"(?:[^()\n]|{_LINE}|{_PARENTHESIS})*+\)"
_LEAD = 16


def completed(known: Column, rest: Column) -> Column:
    """What of ``rest`` still belongs to the sentence that ``known`` is the begin of; null if a list
    item, a heading or the limit comes before its end.

    A sentence ends at ``!`` or ``?``, or at a period that neither stands before another character nor
    ends an abbreviation; marks in parentheses (one pair in another at most, two open ones in
    ``known``) end nothing.
    """
    lead = F.substring(F.concat(F.lit(" " * _LEAD), known), -_LEAD, _LEAD)
    done = known.rlike(r"[!?]\z") | (known.rlike(r"\.\z") & ~rest.rlike(r"\A\S") & ~known.rlike(_ABBREVIATED + r"\z"))
    count = lambda mark: F.length(known) - F.length(F.replace(known, F.lit(mark), F.lit("")))
    depth = F.greatest(count("(") - count(")"), F.lit(0))
    found = lambda d: F.regexp_extract(F.concat(lead, rest), rf"\A(?s:.{{{_LEAD}}})((?:{_CLOSING}){{{d}}}{_RUN})", 1)
    ends = text.bound(depth, lambda d: F.when(d == 0, found(0)).when(d == 1, found(1)).when(d == 2, found(2)))
    return F.when(done, F.lit("")).otherwise(text.bound(ends, lambda end: F.when((end != "") & (F.length(known) + F.length(end) <= MOST_SENTENCE), end)))


def whole_sentence(block: Column, excerpt: Column, raw: Column) -> Column:
    """The excerpt with its value completed to the end of the sentence in the block; null if that
    is unsafe, or if the excerpt does not stand exactly once in the block."""
    once = (F.length(block) - F.length(F.replace(block, excerpt, F.lit("")))) == F.length(excerpt)
    inside = F.call_function("instr", excerpt, raw)
    start = F.call_function("instr", block, excerpt) + inside - 1
    rest = F.substring(block, start + F.length(raw), F.lit(MOST_SENTENCE + 100))
    whole = F.concat(F.substring(excerpt, F.lit(1), inside - 1), raw, completed(raw, rest))
    return F.when(once & (inside > 0), F.regexp_replace(whole, r"(?U)\s+\z", ""))


def extract(blocks: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, warnings and the trace of commitments: how each one's actor and value were made.
    ``documents``: source_id, title, authors array<string>, metadata map<string,string>."""
    found = rules_v2.extract(blocks)
    second = written(found[0], "second")
    third, warnings = rules_v3.extract(blocks, documents.select("source_id", "title"), (second, found[1]))
    third = written(third, "third")
    columns = ["source_id", "block_id", "sequence", "location_type", "location_value", "subject_text", "subject_type", "predicate", "raw_value", "value_type", "value_text", "value_number", "value_currency", "qualifiers", "confidence", "evidence_status", "review_status", "text_excerpt", "candidate_id"]
    texts = blocks.select("source_id", "block_id", F.col("text").alias("_block"))
    actors = trusted_actors(documents, blocks)
    kept = third.select(*columns, F.lit("retained").alias("_status"))
    identity = ["source_id", "block_id", "subject_text", "predicate", "raw_value", "value_key"]
    lost = second.where("predicate = 'commitment'").join(third.select(*identity), identity, "left_anti").select(*columns, F.lit("recovered").alias("_status"))
    rest = kept.where("predicate <> 'commitment'")
    rows = _resolved(kept.where("predicate = 'commitment'").unionByName(lost).join(texts, ["source_id", "block_id"]).join(actors, "source_id", "left"))
    recovered = F.col("_status") == "recovered"
    rows = written(rows, "resolved")
    rows = frames.settled(rows, {"_whole": F.when(recovered, whole_sentence(F.col("_block"), F.col("text_excerpt"), F.col("raw_value")))})
    found = F.call_function("instr", F.col("_whole"), F.col("raw_value"))
    rows = frames.settled(rows, {"_raw": F.when(recovered, text.collapse(F.substring(F.col("_whole"), found, F.length("_whole")))).otherwise(F.col("raw_value"))})
    value, how = plain_value(F.col("_raw"))
    rows = frames.settled(rows, {"_value": value, "_how": how})
    named = ~F.col("_first") & (F.col("_method") == "explicit_statement_actor") & F.col("subject_text").rlike(_I + ORGANISATION) & (F.size(F.split("subject_text", r"\s+")) <= 12) & ~F.col("subject_text").rlike(_I + r",|\b(?:and|or)\b")
    resolved = F.col("_first") & (F.col("_subject") != F.col("subject_text"))
    whole = F.col("_whole").isNotNull() & (F.length("_whole") <= rules.MOST_EVIDENCE) & (F.size(F.split("_raw", " ")) >= 3) & ~F.col("_raw").rlike(_I + CUT_OFF)
    reason = F.when(~(named | resolved), "actor_not_eligible_or_unresolved").when(~whole, "unsafe_or_ambiguous_parent_completion").when(~action_verb(F.col("_value")).isin(VERBS), "ineligible_action").when(F.col("_how") == "unsafe_wrapper_preserved", "unsafe_wrapper")
    rows = written(frames.settled(rows, {"_rejected": F.when(recovered, reason)}), "commitments")
    good = rows.where("_rejected IS NULL")
    rule = F.when(recovered, RULES["recovered"]).when(F.col("_value") != F.col("value_text"), RULES["value"]).otherwise(RULES["actor"])
    made = good.select(*[{"subject_text": F.col("_subject"), "subject_type": F.col("_type"), "raw_value": F.col("_raw"), "value_text": F.col("_value"), "text_excerpt": F.coalesce("_whole", "text_excerpt")}.get(c, F.col(c)).alias(c) for c in columns], rule.alias("rule_id"), F.when(recovered, 2).otherwise(1).alias("_order"))
    every = made.unionByName(rest.select(*columns, F.lit(RULES["carry"]).alias("rule_id"), F.lit(1).alias("_order")))
    every = every.withColumns({"value_key": rules.value_of(), "_s": F.lower(text.collapse(F.col("subject_text"))), "_q": keys.qualifier_key(F.col("qualifiers"))})
    first = Window.partitionBy("source_id", "_s", "subject_type", "predicate", "value_type", "value_key", "_q").orderBy("_order", "sequence", "candidate_id")
    facts = every.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_order")
    facts = facts.withColumn("parent_candidate_id", F.col("candidate_id")).withColumn("evidence_id", keys.stable_id("V04-EVID-", F.col("source_id"), F.col("block_id"), F.col("text_excerpt")))
    facts = facts.withColumn("candidate_id", keys.stable_id("V04-CAND-", *[F.col(c) for c in ("rule_id", "source_id", "_s", "subject_type", "predicate", "value_type", "value_key", "_q", "block_id")])).drop("_s", "_q")
    trace = rows.select("source_id", "block_id", F.col("candidate_id").alias("parent_candidate_id"), F.col("_status").alias("status"), F.col("_method").alias("actor_method"), F.col("_how").alias("value_operation"), F.col("_rejected").alias("rejected"))
    return facts.withColumn("evidence_ids", F.array("evidence_id")), warnings, trace
