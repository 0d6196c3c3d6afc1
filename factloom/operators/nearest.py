"""Nearest candidates of annotations by what they agree in, without comparing every two.

Two facts can agree in four fields, and the candidate may have the annotation's qualifiers. Each subset of
these is a bucket key; facts that agree in it meet in an equi-join. A candidate that is among the k nearest of
an annotation is among the k first by id of the bucket of exactly what both agree in, for those before it
agree in as much and come first. So k candidates of each bucket are enough, and the rows that are joined
are bounded by the annotations, however many candidates a source has.

Facts that are alike in all that is compared are judged once: of candidates that are alike only the k first by id can be
among the k nearest of anything, and annotations that are alike have the same nearest.

All that is for groups of many candidates. Where there are few, an annotation simply gets them all, as one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import frames, keys
from factloom.storage import written

# The fields that facts can agree in.
FIELDS = ["_subject", "subject_type", "value_type", "_value"]
_SUBSETS = range(1 << len(FIELDS))
#: Groups of at most so many candidates are held as an array and compared with each annotation.
FEW = 32


def large_groups(candidates: DataFrame, on: list[str]) -> DataFrame:
    """The groups of more than FEW candidates."""
    return written(candidates.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > FEW).select(*on), "large")


def with_few(candidates: DataFrame, gold: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Annotations with ``_few``: an array of the given columns of all candidates of their group, null for none. Only for
    groups of few candidates. As in all joins here, hinted never to be broadcast: Spark knows the size of the files only, of
    which arrays and keys are many times as large."""
    groups = candidates.groupBy(*on).agg(F.collect_list(F.struct(*columns)).alias("_few"))
    return gold.join(groups.hint("merge"), on, "left")


def _missing() -> Column:
    return sum((F.when(F.col(f).isNull(), 1 << i).otherwise(0) for i, f in enumerate(FIELDS)), F.lit(0))


def _of_names(qualifiers: Column, names: Column) -> Column:
    """The qualifiers of the given names as a text, equal for equal values."""
    return F.to_json(F.transform(names, lambda n: F.struct(n.alias("n"), F.try_element_at(qualifiers, n).alias("v"))), {"ignoreNullFields": "false"})


def _with_fields(rows: DataFrame) -> DataFrame:
    """Settled, so that what the fields are made of is not written out once for each subset."""
    return frames.settled(rows, {"_fields": F.array(*[F.col(f).cast("string") for f in FIELDS]), "_missing": _missing()})


def _buckets(q: Column) -> Column:
    """A key for each subset of the fields; q null: whatever the qualifiers."""
    there = F.filter(F.array(*map(F.lit, _SUBSETS)), lambda m: m.bitwiseAND(F.col("_missing")) == 0)
    fields = lambda m: F.transform("_fields", lambda v, i: F.when(F.getbit(m, i) == 1, v))
    return F.transform(there, lambda m: F.struct(m.alias("subset"), fields(m).alias("fields"), q.alias("q")))


def annotation_buckets(gold: DataFrame, on: list[str]) -> DataFrame:
    """(on, annotation_id, bucket, level): the keys of each annotation, and how much whoever has them agrees in. Missing
    fields are in no key."""
    rows = frames.settled(_with_fields(gold), {"_q": _of_names(F.col("qualifiers"), F.array_sort(F.map_keys("qualifiers")))})
    buckets = F.explode(F.concat(_buckets(F.lit(None).cast("string")), _buckets(F.col("_q")))).alias("bucket")
    return rows.select(*on, "annotation_id", buckets).withColumn("level", F.bit_count("bucket.subset") + F.col("bucket.q").isNotNull().cast("int"))


def candidate_buckets(candidates: DataFrame, gold: DataFrame, on: list[str]) -> DataFrame:
    """(on, candidate_id, missing, bucket): the keys of each candidate. Of its qualifiers those count whose names some
    annotation of the predicate asks for, which the registry bounds; so these are broadcast, for a join by predicate would
    bring all candidates of one to one task."""
    sets = gold.select("predicate", F.array_sort(F.map_keys("qualifiers")).alias("names")).distinct().groupBy("predicate").agg(F.collect_list("names").alias("_sets"))
    rows = _with_fields(candidates.join(F.broadcast(sets), "predicate"))
    sets_there = F.filter("_sets", lambda names: F.forall(names, lambda n: F.map_contains_key("qualifiers", n)))
    rows = frames.settled(rows, {"_qs": F.transform(sets_there, lambda names: _of_names(F.col("qualifiers"), names))})
    buckets = F.concat(_buckets(F.lit(None).cast("string")), F.flatten(F.transform("_qs", _buckets)))
    return rows.select(*on, "candidate_id", F.col("_missing").alias("missing"), F.explode(buckets).alias("bucket"))


def few_nearest(candidates: DataFrame, gold: DataFrame, on: list[str], most: int) -> DataFrame:
    """(annotation_id, candidate_id): pairs of equal ``on`` among which are the ``most`` of each annotation with the fewest
    differences, ties by candidate_id. A missing field differs from nothing; candidates that miss the same
    fields are limited by themselves."""
    # the limit is applied in each task before the exchange
    order = Window.partitionBy(*on, "bucket", "missing").orderBy("candidate_id")
    first = candidate_buckets(candidates, gold, on).withColumn("_n", F.rank().over(order)).where(F.col("_n") <= most)
    return annotation_buckets(gold, on).join(first.hint("merge"), [*on, "bucket"]).select("annotation_id", "candidate_id").distinct()


def with_form(facts: DataFrame, on: list[str]) -> DataFrame:
    """Adds ``_form`` to keyed facts: equal where all is equal that facts of equal ``on`` are compared in."""
    return frames.settled(facts, {"_form": keys.fields_digest(*[F.col(c) for c in (*on, *FIELDS)], keys.qualifier_key(F.col("qualifiers")))})


def first_alike(facts: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` first by ``key`` of the facts of each form; the limit is applied in each task before the exchange."""
    order = Window.partitionBy("_form").orderBy(key)
    return facts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def all_nearest(candidates: DataFrame, gold: DataFrame, on: list[str]) -> DataFrame:
    """(annotation_id, candidate_id): all pairs of equal ``on`` that agree in as much as any candidate does with the
    annotation. Which keys those are, the keys alone say; only their candidates are joined."""
    asked = written(annotation_buckets(gold, on), "asked")
    held = written(candidate_buckets(candidates, gold, on).drop("missing"), "held")
    there = asked.join(held.select(*on, "bucket").distinct().hint("merge"), [*on, "bucket"])
    best = there.groupBy("annotation_id").agg(F.max("level").alias("_best"))
    return there.join(best.hint("merge"), "annotation_id").where("level = _best").select(*on, "bucket", "annotation_id").join(held.hint("merge"), [*on, "bucket"]).select("annotation_id", "candidate_id").distinct()
