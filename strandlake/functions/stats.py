"""Statistical tests (T1 to T6), ranks and quantiles on counted values.

Ranks and quantiles come from counted values (functions.counted). Spark has no error function: p-values are worked
out by a small pandas function over one row per test or class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .counted import count_values, mean, mid_rank, quantile, ranked, rows_of


@F.pandas_udf(DoubleType())
def _erfc(x):
    return x.map(lambda v: None if v is None or v != v else math.erfc(v))


def chi_square_p(chi2: str | Column) -> Column:
    """Upper tail with one degree of freedom."""
    return _erfc(F.sqrt((F.col(chi2) if isinstance(chi2, str) else chi2) / 2))


def normal_sf(z: Column) -> Column:
    return _erfc(z / math.sqrt(2)) / 2


def benjamini_hochberg(tests: DataFrame, p: str = "p", q: str = "q") -> DataFrame:
    """q = min over p' >= p of p' n / rank, 1 at most. One row per test."""
    rank = F.row_number().over(Window.orderBy(p))
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    ranked = tests.withColumn("_r", F.col(p) * n / rank)
    least = F.min("_r").over(Window.orderBy(F.desc(p), F.asc("_r")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(q, F.least(F.lit(1.0), least)).drop("_r")


def rank_tests(entries: DataFrame, by: list[str]) -> DataFrame:
    """One row per group of entries (by, paired, measure, value, n, mine).

    Measures x and y hold the samples. rank holds what is ranked: for paired samples |x - y| without zeros, mine
    counting the positive ones (signed-rank statistic, normal approximation with tie correction, no
    continuity correction); else all values, mine counting those of x (the U of x, tie correction and 0.5 continuity)."""
    here, n = F.col("measure") == "rank", F.col("held")
    total = F.max(F.when(here, F.col("total")))
    found = ranked(entries, [*by, "paired"]).groupBy(*by, "paired").agg(
        rows_of("x").alias("nx"),
        rows_of("y").alias("ny"),
        *(mean(s).alias(f"mean_{s}") for s in "xy"),
        *(quantile(s, 0.5).alias(f"median_{s}") for s in "xy"),
        F.sum(F.when(here, mid_rank() * F.col("mine"))).alias("r"),
        F.coalesce(total, F.lit(0)).alias("k"),
        F.sum(F.when(here, n * (n * n - 1.0))).alias("ties"),
    )
    k, nx, ny, paired = F.col("k"), F.col("nx"), F.col("ny"), F.col("paired")
    u = F.col("r") - nx * (nx + 1.0) / 2
    sd = F.when(paired, F.sqrt(k * (k + 1.0) * (2.0 * k + 1.0) / 24 - F.col("ties") / 48)).otherwise(F.sqrt(nx * ny / 12.0 * ((k + 1.0) - F.when(k > 1, F.col("ties") / (k * (k - 1.0))).otherwise(F.lit(0.0)))))
    off = F.when(paired, F.col("r") - k * (k + 1.0) / 4).otherwise(u - nx * ny / 2.0 - 0.5)
    statistic = F.when(paired, F.coalesce("r", F.lit(0.0))).otherwise(u)
    p = F.coalesce(normal_sf(F.when(sd > 0, off / sd)), F.lit(1.0))
    return found.select(*by, F.when(paired, nx).otherwise(nx + ny).alias("n"), "mean_x", "mean_y", "median_x", "median_y", statistic.alias("statistic"), p.alias("p"))


def paired_entries(counts: DataFrame, by: list[str]) -> DataFrame:
    """Entries of rank_tests from counts of the measures x, y and d = x - y, rounded, over pairs that have both."""
    d = F.col("measure") == "d"
    told = counts.where(~d | (F.col("value") != 0)).select(*by, F.lit(True).alias("paired"), F.when(d, "rank").otherwise(F.col("measure")).alias("measure"), F.when(d, F.abs("value")).otherwise(F.col("value")).alias("value"), "n", F.when(d & (F.col("value") > 0), F.col("n")).otherwise(0).alias("mine"))
    return told.groupBy(*by, "paired", "measure", "value").agg(F.sum("n").alias("n"), F.sum("mine").alias("mine"))


def unpaired_entries(counts: DataFrame, by: list[str]) -> DataFrame:
    """Entries of rank_tests from counts of the measures x and y."""
    told = counts.where(F.col("value").isNotNull() & F.col("measure").isin("x", "y"))
    x = F.when(F.col("measure") == "x", F.col("n")).otherwise(0)
    both = F.explode(F.array(F.struct("measure", F.lit(0).cast("long").alias("mine")), F.struct(F.lit("rank").alias("measure"), x.alias("mine")))).alias("e")
    return told.select(*by, F.lit(False).alias("paired"), "value", "n", both).groupBy(*by, "paired", "e.measure", "value").agg(F.sum("n").alias("n"), F.sum("e.mine").alias("mine"))


_REPORT = ("n", "mean_x", "mean_y", "median_x", "median_y", "statistic", "p")
#: What a test without a single value reports.
_EMPTY = "0L as n, double(null) as mean_x, double(null) as mean_y, double(null) as median_x, double(null) as median_y, {} as statistic, 1.0D as p"


def paired_signed_rank(pairs: DataFrame) -> DataFrame:
    """One row for paired columns x, y: signed-rank statistic of x - y > 0."""
    told = pairs.where("x is not null and y is not null")
    counts = count_values(told, [], {"x": F.col("x"), "y": F.col("y"), "d": F.round(F.col("x") - F.col("y"), 12)})
    return _one(rank_tests(paired_entries(counts, []), []), "0.0D")


def rank_sum(sample: DataFrame) -> DataFrame:
    """T4: one row for (side in 'x', 'y'; v): rank-sum test that x is greater; statistic is the U of x."""
    counts = count_values(sample.where("v is not null"), ["side"], {"v": F.col("v")}).withColumn("measure", F.col("side")).drop("side")
    return _one(rank_tests(unpaired_entries(counts, []), []), "double(null)")


def _one(found: DataFrame, statistic: str) -> DataFrame:
    """The row of a test, or that of no values."""
    none = found.sparkSession.range(1).selectExpr(*(x.strip() for x in _EMPTY.format(statistic).split(", ")))
    both = found.select(*_REPORT, F.lit(0).alias("_o")).unionByName(none.withColumn("_o", F.lit(1)))
    return both.orderBy("_o").limit(1).drop("_o")


def success_rate_test(table: DataFrame) -> DataFrame:
    """T5: from one row (pass_x, fail_x, pass_y, fail_y): 2 x 2 chi-square with Yates correction."""
    a, b, c, d = (F.col(k).cast("double") for k in ("pass_x", "fail_x", "pass_y", "fail_y"))
    n = a + b + c + d
    base = (a + b) * (c + d) * (a + c) * (b + d)
    off = F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2)
    chi2 = F.when(base > 0, n * off * off / base).otherwise(F.lit(0.0))
    out = table.withColumn("statistic", chi2)
    return out.select("pass_x", "fail_x", "pass_y", "fail_y", F.when(a + b > 0, a / (a + b)).alias("rate_x"), F.when(c + d > 0, c / (c + d)).alias("rate_y"), "statistic", chi_square_p("statistic").alias("p"))
