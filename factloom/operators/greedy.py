"""One-to-one pairs as a greedy walk would choose them, without walking.

The walk takes pairs (k, t, l, r) of a key k in order of (t, l, r) and keeps each whose ends are both free. A
pair that is the first of both its ends is kept by the walk whatever else it does, so all such pairs
can be taken at once, again and again. Where the pairs of a key's first tier join every end with every
other, the walk gives the i-th l the i-th r, which are found by places alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import ordinals
from factloom.storage import written

#: Keys with at most so many pairs left are folded as an array.
FOLD = 512


def _folded(pairs: DataFrame) -> DataFrame:
    """Keys of few pairs: the walk itself, as a fold over the pairs in order."""
    kind = {n: pairs.schema[n].dataType.simpleString() for n in ("l", "r")}
    none = F.array().cast(f"array<struct<l:{kind['l']},r:{kind['r']}>>")

    def step(kept, p):
        taken = F.exists(kept, lambda x: (x["l"] == p["l"]) | (x["r"] == p["r"]))
        return F.when(taken, kept).otherwise(F.concat(kept, F.array(F.struct(p["l"].alias("l"), p["r"].alias("r")))))

    grouped = pairs.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("t", "l", "r"))).alias("all"))
    return grouped.select("k", F.explode(F.aggregate("all", none, step)).alias("m")).select("k", "m.l", "m.r")


def _round(now: DataFrame) -> DataFrame:
    """What the walk keeps for certain of pairs of the first tier of each key."""
    left, right = (now.groupBy("k", end).agg(F.count("*").alias("n")) for end in ("l", "r"))
    shape = left.groupBy("k").agg(F.count("*").alias("ls"), F.sum("n").alias("n")).join(right.groupBy("k").agg(F.count("*").alias("rs")), "k")
    full = written(shape.where(F.col("n") == F.col("ls") * F.col("rs")).select("k"), "full")
    places = [ordinals.positions(v.select("k", end).join(full, "k", "left_semi"), ["k"], [F.col(end)], "place") for v, end in ((left, "l"), (right, "r"))]
    level = places[0].join(places[1], ["k", "place"]).select("k", "l", "r")
    rest = now.join(full, "k", "left_anti")
    first_of_l, first_of_r = rest.groupBy("k", "l").agg(F.min("r").alias("r")), rest.groupBy("k", "r").agg(F.min("l").alias("l"))
    return level.unionByName(first_of_l.join(first_of_r, ["k", "l", "r"]))


def one_to_one(pairs: DataFrame) -> DataFrame:
    """(k, l, r): the pairs that the walk over (k, t, l, r) keeps. Repeated pairs count once, in their first tier;
    pairs with a null k, l or r are left out."""
    rest = written(pairs.where("k IS NOT NULL AND l IS NOT NULL AND r IS NOT NULL").groupBy("k", "l", "r").agg(F.min("t").alias("t")), "pairs")
    done = []
    while True:
        large = written(rest.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > FOLD).select("k"), "keys")
        done.append(written(_folded(rest.join(large, "k", "left_anti")), "matched"))
        rest = rest.join(large, "k", "left_semi")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, done)
        rest = written(rest, "pairs")
        matched = written(_round(rest.join(rest.groupBy("k").agg(F.min("t").alias("t")), ["k", "t"])), "matched")
        done.append(matched)
        rest = written(rest.join(matched.select("k", "l"), ["k", "l"], "left_anti").join(matched.select("k", "r"), ["k", "r"], "left_anti"), "pairs")
