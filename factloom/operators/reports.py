"""Reports: one-row and grouped aggregates over audits, runs, agents and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import numbers
from factloom.operators import ordinals

NEAR_EMPTY = 50


def page_audit(pages: DataFrame) -> DataFrame:
    """By document, of rows (document, page, chars): totals, page lists and scan risk.
    ``sample_pages`` are the first, middle and last page."""
    n = F.count("page")
    zero = F.count_if(F.col("chars") == 0)
    rows = pages.groupBy("document").agg(
        n.alias("pages"), F.coalesce(F.sum("chars"), F.lit(0)).alias("total_chars"), F.min("chars").alias("min_chars"), F.max("chars").alias("max_chars"),
        F.round(F.avg("chars"), 2).alias("mean_chars"),
        F.array_sort(F.collect_list(F.when(F.col("chars") == 0, F.col("page")))).alias("zero_pages"),
        F.array_sort(F.collect_list(F.when((F.col("chars") > 0) & (F.col("chars") < NEAR_EMPTY), F.col("page")))).alias("near_empty_pages"),
        scan_risk(zero, n).alias("scan_risk"),
    )
    return rows.withColumn("sample_pages", sample_pages(F.col("pages")))


def page_runs(pages: DataFrame, fewer: int = NEAR_EMPTY) -> DataFrame:
    """(document, first_page, last_page, n): runs of neighbouring pages with fewer than ``fewer`` characters, for rows
    (document, page, chars). What ``page_audit`` lists page by page is here as long as there are runs, and no task
    holds a document: a page's place among all pages less its place among the short ones is the same in a run."""
    placed = ordinals.positions(pages.select("document", "page", "chars"), ["document"], [F.col("page")], "_place")
    short = ordinals.positions(placed.where(F.coalesce(F.col("chars"), F.lit(0)) < fewer), ["document"], [F.col("page")], "_nth")
    runs = short.groupBy("document", F.col("_place") - F.col("_nth")).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n"))
    return runs.select("document", "first_page", "last_page", "n")


def sample_pages(count: Column) -> Column:
    return F.when(count > 0, F.array_distinct(F.array(F.lit(1).cast("long"), F.floor((count + 1) / 2).cast("long"), count.cast("long")))).otherwise(F.array().cast("array<bigint>"))


def scan_risk(zero: Column, pages: Column) -> Column:
    """none, low, medium or high by the share of pages without text; unknown without pages."""
    share = numbers.fraction(zero, pages)
    return F.when(pages == 0, "unknown").when(share == 0, "none").when(share <= 0.10, "low").when(share <= 0.40, "medium").otherwise("high")


def batch_report(items: DataFrame) -> DataFrame:
    """Of rows (status, checksum_match): how a batch went, with whether the counts add up."""
    count = lambda c, name: F.count_if(c).alias(name)
    s = F.col("status")
    rows = items.agg(F.count("*").alias("total"), count(s == "success", "succeeded"), count(s == "success_with_warnings", "with_warnings"), count(s == "failed", "failed"), count(F.col("checksum_match"), "checksum_matches"))
    return rows.withColumn("reconciled", F.col("succeeded") + F.col("with_warnings") + F.col("failed") == F.col("total"))


def counts_by(rows: DataFrame, *columns: str, every: DataFrame | None = None) -> DataFrame:
    """Row counts by columns; combinations of ``every`` that did not occur count 0."""
    found = rows.groupBy(*columns).agg(F.count("*").alias("n"))
    if every is None:
        return found
    return every.select(*columns).distinct().join(found, list(columns), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _share(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(numbers.fraction(numerator, denominator), F.lit(0.0))


def agent_metrics(outcomes: DataFrame) -> DataFrame:
    """Of rows (evaluation_group, task_success, expected_status, actual_status, citation_valid,
    tool_selection_acceptable, unnecessary_tool_calls, actual_tool_sequence): rates, 0 where
    nothing counts."""
    answered = F.col("actual_status") == "answered"
    abstain = (F.col("evaluation_group") == "routing") & (F.col("expected_status") == "insufficient")
    calls = F.size("actual_tool_sequence")
    return outcomes.agg(
        F.count("*").alias("cases"),
        _share(F.count_if(F.col("task_success")), F.count("*")).alias("task_success"),
        _share(F.count_if(answered & F.col("citation_valid")), F.count_if(answered)).alias("citation_validity"),
        _share(F.count_if(abstain & (F.col("actual_status") == "insufficient")), F.count_if(abstain)).alias("abstention"),
        _share(F.count_if(F.col("tool_selection_acceptable")), F.count("*")).alias("tool_selection"),
        _share(F.sum("unnecessary_tool_calls"), F.sum(calls)).alias("unnecessary_calls"),
        _share(F.sum(calls), F.count("*")).alias("mean_calls"),
    )


def tool_counts(calls: DataFrame, order: list[str]) -> DataFrame:
    """Calls and results by tool, in the given order of tools; tools without calls count 0."""
    tools = calls.sparkSession.createDataFrame(list(enumerate(order, 1)), "ordinal int, tool string")
    found = calls.groupBy("tool").agg(F.count("*").alias("calls"), F.coalesce(F.sum("results"), F.lit(0)).alias("results"))
    return F.broadcast(tools).join(found, "tool", "left").select("ordinal", "tool", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("results", F.lit(0)).alias("results"))


def run_report(invocations: DataFrame) -> DataFrame:
    """Of rows (status, cache, attempts, input_tokens, output_tokens, cost): counters, token
    sums, and the cost of cache misses alone."""
    miss = F.col("cache") == "miss"
    return invocations.agg(
        F.count("*").alias("invocations"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") != "success").alias("failed"),
        F.count_if(F.col("cache") == "hit").alias("cache_hits"), F.count_if(miss).alias("cache_misses"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum(F.when(miss, F.col("cost"))), F.lit(0).cast("decimal(38,9)")).cast("decimal(38,9)").alias("cost"),
    )


def cost_budget(requests: DataFrame, per_million: str, output_tokens: int, output_per_million: str, cap: str) -> DataFrame:
    """Of rows (payload): planned and conservative input tokens, their cost with the most
    output that is allowed, and whether the conservative cost is within the cap."""
    planned, conservative = numbers.planning_tokens(F.col("payload")), F.octet_length("payload").cast("long")
    rows = requests.agg(F.count("*").alias("requests"), F.sum(planned).alias("planned_tokens"), F.sum(conservative).alias("conservative_tokens"))
    output = numbers.token_cost(F.col("requests") * output_tokens, F.lit(output_per_million).cast("decimal(18,9)"))
    price = F.lit(per_million).cast("decimal(18,9)")
    rows = rows.withColumns({"planned_cost": (numbers.token_cost(F.col("planned_tokens"), price) + output).cast("decimal(38,9)"), "conservative_cost": (numbers.token_cost(F.col("conservative_tokens"), price) + output).cast("decimal(38,9)")})
    return rows.withColumn("within_cap", F.col("conservative_cost") <= F.lit(cap).cast("decimal(38,9)"))


def gates(report: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(ordinal, gate, passed) of a one-row report, in the given order."""
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("gate"), F.coalesce(check, F.lit(False)).alias("passed")) for i, (name, check) in enumerate(checks.items(), 1)])
    return report.select(F.inline(rows))


def first_failing(found: DataFrame) -> DataFrame:
    return found.where(~F.col("passed")).orderBy("ordinal").limit(1)


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a complete order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def duplicated(rows: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two tables have equal rows, counted."""
    columns = a.columns
    total = lambda df, sign: df.groupBy(*columns).agg(F.count("*").alias("_n")).withColumn("_n", F.col("_n") * sign)
    diff = total(a, 1).unionByName(total(b.select(*columns), -1)).groupBy(*columns).agg(F.sum("_n").alias("_n"))
    return diff.agg((F.count_if(F.col("_n") != 0) == 0).alias("equal"))
