import re

from factloom.functions import text
from pyspark.sql import functions as F


def test_plain_texts_are_null_to_the_python_function(spark):
    values = ["Order 1.", "  A  b\tC! ", "", "Straße", "naïve – “x”.", "ﬁne  Text?", None]
    rows = spark.createDataFrame([(v,) for v in values], "t string").repartition(2)
    found = rows.select("t", text.comparable(F.col("t")).alias("c"))
    assert {(r.t, r.c) for r in found.collect()} == {(v, None if v is None else text.comparable_text(v)) for v in values}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"ArrowEvalPython \[_comparable\((CASE WHEN|if)", plan) or re.search(r"Project \[.*CASE WHEN NOT .*RLIKE", plan, re.S)
