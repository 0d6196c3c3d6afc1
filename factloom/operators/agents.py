"""The agent's three read-only tools, its limits, and its scripted policies as joins.

A policy that runs offline is a plan, not a conversation: every question is asked at
once, retrieval is one batched ranking, and what the agent does next follows from
what the tools returned. The trace of tools is an array on the case's row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import numbers
from factloom.operators import answers, retrieval

# Fixed values.
TOOLS = ("retrieve_evidence", "search_project_facts", "read_evidence_block")
MOST_REQUESTS, MOST_CALLS, MOST_HITS = 4, 4, 5
ANSWERED, INSUFFICIENT = "answered", "insufficient_evidence"
FACT_CATEGORIES = ("structured_fact_search", "evidence_inspection")


class LimitReached(RuntimeError):
    """A run asked for more than its limits allow."""


@dataclass
class Tools:
    """The facade over records (evidence_id, source_id, block_id, text, and vector for the dense
    leg), facts and an embedder of questions; every call is one query. Evidence ids are unique."""

    records: DataFrame
    facts: DataFrame
    embed: Callable[[DataFrame], DataFrame]
    calls: list[tuple[str, int]] = field(default_factory=list)

    def _count(self, tool: str) -> None:
        if len(self.calls) >= MOST_CALLS:
            raise LimitReached(f"more than {MOST_CALLS} tool calls")
        self.calls.append((tool, len(self.calls) + 1))

    def retrieve_evidence(self, question: str, source_ids: list[str] | None = None, top_k: int = MOST_HITS) -> DataFrame:
        """Hybrid hits for a question; sources are restricted before the index, so that idf follows."""
        if not question or not 1 <= top_k <= MOST_HITS:
            raise ValueError(f"a question and 1 to {MOST_HITS} hits are asked for")
        self._count(TOOLS[0])
        rows = self.records if source_ids is None else retrieval.restrict(self.records, source_ids)
        asked = self.embed(rows.sparkSession.createDataFrame([("q", question)], "qid string, text string"))
        return retrieval.hybrid(rows, asked, top_k).drop("qid")

    def search_project_facts(self, query: str | None = None, fact_type: str | None = None) -> DataFrame:
        self._count(TOOLS[1])
        return answers.search_facts(self.facts, fact_type, query)

    def read_evidence_block(self, evidence_id: str) -> DataFrame:
        """The one record with an id; an unknown id is an error."""
        self._count(TOOLS[2])
        found = retrieval.evidence(self.records, evidence_id)
        if found.isEmpty():
            raise KeyError(f"unknown evidence_id: {evidence_id}")
        return found


def run(tools: Tools, policy: Callable[[int, list], tuple[str, dict] | dict]) -> dict:
    """A bounded run: ``policy(step, results)`` gives the next call (tool, arguments) or the answer, a dict.

    It is asked at most four times; results are DataFrames. Another tool, a fifth call or no answer in
    time is an error.
    """
    results: list[DataFrame] = []
    for step in range(1, MOST_REQUESTS + 1):
        wanted = policy(step, results)
        if isinstance(wanted, dict):
            return wanted | {"tool_sequence": [tool for tool, _ in tools.calls]}
        tool, arguments = wanted
        if tool not in TOOLS:
            raise ValueError(f"unknown tool: {tool}")
        results.append(getattr(tools, tool)(**arguments))
    raise LimitReached(f"no answer after {MOST_REQUESTS} requests")


def check_limits(traces: DataFrame) -> DataFrame:
    """Adds ``problem`` to (case_id, tool_sequence): an unknown tool, or too many calls."""
    unknown = F.exists("tool_sequence", lambda t: ~t.isin(*TOOLS))
    return traces.withColumn("problem", F.when(unknown, "unknown_tool").when(F.size("tool_sequence") > MOST_CALLS, "tool_limit"))


def routing_facts(cases: DataFrame, records: DataFrame) -> DataFrame:
    """One supported fact for each routing case with a fixture, hydrated from the record it
    names; ``found`` is false where no such record exists."""
    fixed = cases.where("fixture IS NOT NULL").select("case_id", "fixture.*")
    rows = fixed.join(records.select("evidence_id", "source_id", "block_id", F.col("text").alias("excerpt")), "evidence_id", "left")
    found = F.col("block_id").isNotNull()
    return rows.select(
        F.concat(F.lit("FACT-"), "case_id").alias("fact_id"), "case_id", "fact_type", "subject", "statement", "value", F.array("evidence_id").alias("evidence_ids"), F.lit(1.0).alias("confidence"),
        F.when(found, "supported").alias("support_status"), F.lit(False).alias("review_required"), "source_id", "block_id", "excerpt", found.alias("found"),
    )


def _first_expected(listed: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, available): the first expected id among those listed for a case in order (case_id, place, evidence_id)."""
    hit = listed.join(expected, ["case_id", "evidence_id"])
    return hit.groupBy("case_id").agg(F.min_by("evidence_id", "place").alias("available"))


def answer_policy(cases: DataFrame, hits: DataFrame, facts: DataFrame) -> DataFrame:
    """What the scripted policies do with each case (case_id, category, expected_evidence_ids, fixture).

    Retrieval cases: five hits, answered from the first expected one, else insufficient. A search
    without a match abstains. The others search facts by the fixture's type and words, read
    the first expected evidence and answer from it. ``hits``: (case_id, rank, evidence_id).
    """
    searching = F.coalesce(F.col("category").isin(*FACT_CATEGORIES), F.lit(False))
    none = F.coalesce(F.col("category") == "no_match_fact_search", F.lit(False))
    expected = cases.select("case_id", F.explode("expected_evidence_ids").alias("evidence_id"))
    seen = hits.where(F.col("rank") <= MOST_HITS).select("case_id", F.col("rank").alias("place"), "evidence_id")
    retrieved = _first_expected(seen, expected).withColumnRenamed("available", "_hit")
    asked = cases.where(searching).select("case_id", F.col("fixture.fact_type").alias("fact_type"), F.lower(F.trim("fixture.query")).alias("_q"))
    words = F.lower(F.concat_ws(" ", "subject", "statement", "value"))
    # only evidence that a case expects is read, so facts meet cases by it; by type alone they would be as many pairs as their square
    cites = facts.select("fact_id", "fact_type", words.alias("_words"), F.posexplode("evidence_ids").alias("_p", "evidence_id"))
    matched = cites.join(expected, "evidence_id").join(asked, ["case_id", "fact_type"]).where(F.contains("_words", F.col("_q")))
    cited = matched.select("case_id", F.struct("fact_id", "_p").alias("place"), "evidence_id")
    read = _first_expected(cited, expected).withColumnRenamed("available", "_read")
    rows = cases.join(retrieved, "case_id", "left").join(read, "case_id", "left")
    available = F.when(none, F.lit(None)).when(searching, F.col("_read")).otherwise(F.col("_hit"))
    rows = rows.withColumn("evidence_id", available)
    sequence = F.when(none, F.array(F.lit(TOOLS[1]))).when(searching & F.col("_read").isNotNull(), F.array(F.lit(TOOLS[1]), F.lit(TOOLS[2]))).when(searching, F.array(F.lit(TOOLS[1]))).otherwise(F.array(F.lit(TOOLS[0])))
    status = F.when(F.col("evidence_id").isNotNull(), ANSWERED).otherwise(INSUFFICIENT)
    return rows.withColumns({"actual_status": status, "actual_tool_sequence": sequence, "cited_ids": F.array_compact(F.array("evidence_id"))}).drop("_hit", "_read")


def outcomes(cases: DataFrame, acted: DataFrame, records: DataFrame) -> DataFrame:
    """Scores of what was done: success, citations that exist, tools, calls too many."""
    known = records.select("evidence_id", F.lit(True).alias("_known"))
    rows = acted.join(known, "evidence_id", "left")
    own = [c for c in cases.columns if c not in acted.columns]
    rows = rows.join(cases.select("case_id", *own), "case_id") if own else rows
    return rows.withColumns({
        "task_success": answers.task_success(F.col("expected_status"), F.col("actual_status"), F.col("expected_evidence_ids"), F.col("cited_ids")),
        "citation_valid": F.when(F.col("actual_status") == ANSWERED, F.coalesce("_known", F.lit(False))),
        "tool_selection_acceptable": answers.tool_sequence_ok(F.col("acceptable_tool_sequences"), F.col("actual_tool_sequence")),
        "unnecessary_tool_calls": answers.unnecessary_calls(F.col("acceptable_tool_sequences"), F.col("actual_tool_sequence")),
    }).drop("_known")


def hashing_embedder(dimensions: int = 64):
    """An embedder without a model: signed counts of hashed terms, scaled to length one. Replaceable by
    any function that adds ``vector`` to rows with ``text``; a text without terms has none."""

    def embed(rows: DataFrame) -> DataFrame:
        terms = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
        places = F.transform(terms, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dimensions)).cast("int").alias("i"), F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
        rows = rows.withColumn("_places", places)
        sums = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.aggregate(F.filter("_places", lambda p: p["i"] == d), F.lit(0.0), lambda total, p: total + p["s"]))
        return rows.withColumn("vector", numbers.unit(sums)).drop("_places")

    return embed


def attempts_within(attempts: DataFrame, most: int = MOST_REQUESTS) -> DataFrame:
    """Attempts (run_id, at, ...) numbered in time, those beyond the limit marked."""
    order = Window.partitionBy("run_id").orderBy("at")
    return attempts.withColumn("attempt", F.row_number().over(order)).withColumn("allowed", F.col("attempt") <= most)
