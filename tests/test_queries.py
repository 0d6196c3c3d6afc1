import sys

import pytest

sys.path.insert(0, __file__.rpartition("/")[0])
import oracle
from factloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    assert oracle.differences(spark, SF, registry.queries()[name], registry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry_gives_a_stable_schema(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["qid", "rank", "evidence_id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_read_the_needed_columns_only(spark):
    plan = registry.queries()["exact_duplicates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan
    plan = registry.queries()["llm_run_report"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint>" in plan
