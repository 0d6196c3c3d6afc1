from datetime import datetime

from factloom.functions import metadata
from factloom.operators import manifests, registry
from pyspark.sql import functions as F


def test_getters_give_their_type_or_nothing(spark):
    texts = ['{"title": " Plan\\r\\n\\n", "n": 3, "made": "2026-03-01T10:00:00", "by": ["A", " ", "B"]}', '{"title": 7, "n": "12", "made": 5, "by": "A"}', '{"title": "  ", "n": "x", "made": "soon", "by": {"a": 1}}', '{"title": null, "n": [1], "by": []}', '{"title"', None, "[1]"]
    meta = F.col("m")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", metadata.parsed(F.col("t")).alias("m"))
    found = rows.select("i", metadata.simple(meta, "$.title"), metadata.number(meta, "$.n"), metadata.moment(meta, "$.made"), metadata.names(meta, "$.by")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in found] == [
        (" Plan", 3, datetime(2026, 3, 1, 10), ["A", "B"]), ("7", 12, None, ["A"]), (None, 0, None, []), (None, 0, None, []), (None, 0, None, []), (None, 0, None, []), (None, 0, None, []),
    ]


def test_replies_are_held_against_the_schema_of_their_predicate(spark):
    fact = '{"candidate_id": "c", "subject_text": "s", "subject_type": "metric", "predicate": "metric", "raw_value": "1", "value_type": "number", "normalized_value": "1", "qualifiers": {"metric_name": "m", "unit": null, "population": null, "period": null}, "evidence_ids": [], "confidence": 0.5}'
    replies = [fact, fact.replace("0.5", '"0.5"'), fact.replace('"raw_value": "1", ', ""), fact.replace('"metric", "raw', '"nothing", "raw'), fact.replace('"unit": null, ', '"x": 1, '), "[]", "", None, fact[:-1], "{}"]
    found = manifests.reply_problems(spark.createDataFrame(list(enumerate(replies)), "id int, reply string")).orderBy("id", "problem").collect()
    assert [tuple(r) for r in found] == [(1, "type:confidence"), (2, "missing:raw_value"), (3, "unknown_predicate"), (4, "missing:qualifiers.unit"), (4, "unknown:qualifiers.x"), (5, "no_object"), (6, "no_object"), (7, "no_object"), (8, "no_object"), (9, "unknown_predicate")]
    assert sorted(manifests.FACT_FIELDS) == sorted(manifests.fact_variant(registry.predicates(spark).first().asDict())["properties"])


def test_schema_as_a_table(spark):
    found = {(r.predicate, r.field): r.allowed for r in manifests.schema_fields(spark).collect()}
    assert found["metric", "qualifier:metric_name"] == "required" and found["metric", "qualifier:unit"] == "optional" and found["budget", "value_type"] == "money"
