"""Counted values: one mergeable table behind all quantiles, moments and ranks.

count_values makes it in one pass over the rows: a row for each group, measure and distinct value, with how many rows
have it. Tables of other groupings come from merging it (merged), and running counts (ranked) in two steps, over
ranges of values and then inside a range, so no window holds all values of a group. Every mean, deviation, extreme,
quantile and rank is then an aggregate over that table; the rows themselves are not read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Ranges of values between a power of two (of |v| + 1) and the next.
RANGES = 4096


def count_values(rows: DataFrame, by: list[str], measures: dict[str, Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """by, measure, value, n and the summed columns (kept with the first measure only), stored. A row without a value
    counts under a null one."""
    first = next(iter(measures))
    entry = lambda k, v: F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value"), *(F.when(F.lit(k == first), F.col(c)).alias(c) for c in sums))
    long = rows.select(*by, F.explode(F.array(*(entry(k, v) for k, v in measures.items()))).alias("_e")).select(*by, "_e.*")
    return stored(long.groupBy(*by, "measure", "value").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums)))


def merged(counts: DataFrame, by: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """The counts of a coarser grouping."""
    return counts.groupBy(*by, "measure", "value").agg(*(F.sum(c).alias(c) for c in ("n", *sums)))


def ranked(counts: DataFrame, by: list[str]) -> DataFrame:
    """Adds held (n, 0 for a null value), upto (values of the group and measure up to this one), total and least (its
    number of values and the smallest)."""
    group, value = [*by, "measure"], F.col("value")
    span = F.floor(F.log2(F.abs(value) + 1) * RANGES * F.signum(value))
    rows = counts.withColumns({"held": F.when(value.isNotNull(), F.col("n")).otherwise(0), "_range": span})
    sums = rows.groupBy(*group, "_range").agg(F.sum("held").alias("_part"), F.min("value").alias("_low"))
    whole = Window.partitionBy(*group)  # a row per range
    before = F.coalesce(F.sum("_part").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*group, "_range", before.alias("_before"), F.sum("_part").over(whole).alias("total"), F.min("_low").over(whole).alias("least"))
    inside = F.sum("held").over(Window.partitionBy(*group, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_in", inside)
    on = F.lit(True)
    for c in [*group, "_range"]:
        on = on & rows[c].eqNullSafe(sums[c])
    return rows.join(sums, on).select(*(rows[c] for c in rows.columns if c not in ("_range", "_in")), (F.col("_before") + F.col("_in")).alias("upto"), "total", "least")


def mid_rank() -> Column:
    """The rank of a value of a ranked table, ties at their middle."""
    return F.col("upto") - (F.col("held") - 1) / 2


def rows_of(measure: str) -> Column:
    """Aggregate: rows with or without a value."""
    return F.coalesce(F.sum(F.when(F.col("measure") == measure, F.col("n"))), F.lit(0))


def mean(measure: str) -> Column:
    here = F.col("measure") == measure
    return F.sum(F.when(here, F.col("held") * F.col("value"))) / F.sum(F.when(here & (F.col("held") > 0), F.col("held")))


def deviation(measure: str) -> Column:
    """Of the population, about the smallest value, which keeps digits."""
    here, off = F.col("measure") == measure, F.col("value") - F.col("least")
    n = F.sum(F.when(here & (F.col("held") > 0), F.col("held")))
    first = F.sum(F.when(here, F.col("held") * off)) / n
    return F.sqrt(F.greatest(F.lit(0.0), F.sum(F.when(here, F.col("held") * off * off)) / n - first * first))


def extreme(measure: str, which=F.min) -> Column:
    return which(F.when(F.col("measure") == measure, F.col("value")))


def quantile(measure: str, depth: float) -> Column:
    """Exact, interpolated between neighbours; null without values."""
    here, at = F.col("measure") == measure, (F.col("total") - 1) * F.lit(float(depth))
    held = lambda place: F.max(F.when(here & (F.col("upto") - F.col("held") <= place) & (place < F.col("upto")), F.col("value")))
    low, high = held(F.floor(at)), held(F.ceil(at))
    return low + (high - low) * F.max(F.when(here, at - F.floor(at)))
