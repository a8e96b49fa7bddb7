"""Links between sets of shingles by their rarest members, for a Jaccard similarity.

Two sets of at least that similarity differ in so few members that, in any one order of all shingles, the first
floor((1 - similarity) * n) + 1 of each hold one that both have. The order is by the number of sets that have a
shingle, rarest first: a text that shares only passages with others has enough shingles of its own, and no candidates.

This is exact for sets of up to SMALL shingles. A larger set takes part with the shingles of its level, those whose
hash is divisible by 2^level, between SMALL / 2 and SMALL of them on average; sets that differ little in size share a
level, as each takes part at that of sets 1 / similarity times as large too. The first ones are then as many more as leave a
pair out with a probability of under MISS (a bound on binomial tails), which is that of a collision of hashes in
practice. Shingles in over HOT_SHARE of a sample's sets come last in the order and are not counted, so no task
gathers them; the order is only a matter of cost, never of the result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Largest set that takes part as a whole; the sample that tells hot shingles, and from which share of its sets on.
SMALL, SAMPLE_SETS, HOT_SHARE = 128, 20_000, 0.01
MISS = 1e-9


def level_of(n: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n) / SMALL)))


def picked(shingles: np.ndarray) -> np.ndarray:
    """The shingles with which a set takes part."""
    return shingles[shingles & np.uint64(2 ** level_of(len(shingles)) - 1) == 0]


def _level(n: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)) / F.lit(SMALL)))).cast("int")


def _first_ones(n: Column, level: Column, similarity: float) -> Column:
    """How many of a set's shingles at a level hold one that a similar set has there."""
    differ = n - F.ceil(similarity * n - 1e-9)
    mean, most = differ / F.pow(F.lit(2.0), level), -math.log(MISS)
    more = F.ceil(mean + most / 3 + F.sqrt(F.lit(most * most / 9) + 2 * most * mean))
    return F.when(level == 0, differ).otherwise(more).cast("long") + 1


def rare_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the nodes of sets of that similarity (0.5 or more, so that sizes are a level apart at most),
    from distinct sets: node, n (its size), picks (of `picked`)."""
    own, upper = _level(F.col("n")), _level(F.floor(F.col("n") / similarity))
    levels = F.explode(F.when(upper > own, F.array(own, upper)).otherwise(F.array(own))).alias("level")
    at = F.filter("picks", lambda h: h.bitwiseAND(F.expr("cast(pow(2, level) as long) - 1")) == 0)
    placed = sets.select("node", "n", "picks", levels).select("node", "level", _first_ones(F.col("n"), F.col("level"), similarity).alias("take"), at.alias("at"))
    members = placed.select("node", "level", "take", F.size("at").alias("size"), F.explode("at").alias("h"))
    share = min(1.0, SAMPLE_SETS / max(1, sets.count()))
    some = members.where(F.shiftrightunsigned(F.xxhash64(F.lit("hot"), "node"), 2) <= F.lit(int(share * 2**62)))
    least = max(2, HOT_SHARE * min(SAMPLE_SETS, sets.count()))
    hot = materialize(some.groupBy("level", "h").agg(F.count("*").alias("k")).where(F.col("k") > least).select("level", "h"))
    # 2 * SMALL / HOT_SHARE hot shingles or so at most; their rows are each counted alone, so no task gathers them
    marked = members.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["level", "h"], "left").withColumn("spread", F.when(F.col("hot"), F.col("node")))
    df = F.when(F.col("hot"), F.lit(2**62)).otherwise(F.count("*").over(Window.partitionBy("level", "h", "spread")))
    shared = marked.withColumn("df", df).where("df > 1")
    mine = Window.partitionBy("node", "level")
    alone = F.col("size") - F.count("*").over(mine)  # shingles that no other set has come first
    firsts = shared.withColumn("place", alone + F.row_number().over(mine.orderBy("df", "h"))).where("place <= take")
    held = materialize(firsts.select("level", "h", "node"))
    first = materialize(held.groupBy("level", "h").agg(F.min("node").alias("least"), F.count("*").alias("k")).where("k > 1").drop("k"))
    return held.join(first, ["level", "h"]).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
