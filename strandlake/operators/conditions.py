"""Tables of one condition and of two conditions (A1 to A16) over read statistics.

stats has read_id, label, identity, length; two-condition tables also a column condition with the
values a and b. All are grouped sums first; joins and windows run over one row per class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import counted as ct
from ..functions.stats import benjamini_hochberg, chi_square_p


def reads_per_class(stats: DataFrame) -> DataFrame:
    return stats.groupBy("label").agg(F.count("*").alias("reads"))


def bin_of(value: Column, low: float, width: float, bins: int) -> Column:
    """Index of a half-open bin; the last bin also holds its right edge. Null outside."""
    at = F.floor(F.round((value - low) / width, 9)).cast("int")
    return F.when(at == bins, bins - 1).when((at >= 0) & (at < bins), at)


def identity_histogram(stats: DataFrame, threshold: float = 0.75, width: float = 2.0) -> DataFrame:
    """bin_start (percent), reads: bins from the threshold to 100, the last one closed and maybe narrower."""
    low, bins = threshold * 100, int(-(-(100 - threshold * 100) // width))
    bin_ = bin_of(F.col("identity") * 100, low, width, bins)
    return stats.withColumn("b", bin_).where("b is not null").groupBy("b").agg(F.count("*").alias("reads")).select((F.lit(low) + F.col("b") * width).alias("bin_start"), "reads")


def identity_values(stats: DataFrame) -> DataFrame:
    return stats.select("label", (F.col("identity") * 100).alias("identity_pct"))


def letter_values(stats: DataFrame, depths: tuple[float, ...] = (0.0625, 0.125, 0.25, 0.5, 0.75, 0.875, 0.9375)) -> DataFrame:
    """Quantiles of identity per class, exact and interpolated, in long form."""
    counts = ct.count_values(stats, ["label"], {"identity": F.col("identity")})
    found = ct.ranked(counts, ["label"]).groupBy("label").agg(*(ct.quantile("identity", d).alias(f"_{i}") for i, d in enumerate(depths)))
    pairs = F.array(*(F.struct(F.lit(d).alias("depth"), F.col(f"_{i}").alias("q")) for i, d in enumerate(depths)))
    return found.select("label", F.explode(pairs).alias("z")).select("label", F.col("z.depth").alias("depth"), (F.col("z.q") * 100).alias("identity_pct"))


def coverage_matrix(sums: DataFrame) -> DataFrame:
    """From position sums (label, pos, cov, reads of the class): percent of the class's best covered
    position, mean coverage first; and its even bin."""
    mean = F.col("cov") / F.col("reads")
    best = F.max("mean_cov").over(Window.partitionBy("label"))
    pct = F.when(F.col("best") > 0, F.col("mean_cov") * 100 / F.col("best")).otherwise(F.lit(0.0))
    out = sums.withColumn("mean_cov", mean).withColumn("best", best).withColumn("pct", pct)
    return out.select("label", "pos", "mean_cov", "pct", (F.floor(F.round(F.col("pct") / 2, 9)) * 2).alias("pct_bin"))


def error_rate_matrix(sums: DataFrame) -> DataFrame:
    rate = F.when(F.col("cov") > 0, 1 - F.col("match") / F.col("cov")).otherwise(F.lit(0.0))
    return sums.select("label", "pos", rate.alias("error_rate"))


def length_histogram(stats: DataFrame) -> DataFrame:
    return stats.groupBy("length").agg(F.count("*").alias("reads"))


def count_vs_identity(stats: DataFrame) -> DataFrame:
    return stats.groupBy("label").agg(F.count("*").alias("reads"), (F.avg("identity") * 100).alias("mean_identity_pct"))


def class_summary(stats: DataFrame) -> DataFrame:
    """A8, from one pass over the reads."""
    counts = ct.count_values(stats, ["label"], {"identity": F.col("identity"), "length": F.col("length")})
    return ct.ranked(counts, ["label"]).groupBy("label").agg(
        ct.rows_of("identity").alias("reads"),
        ct.mean("identity").alias("mean_identity"),
        ct.deviation("identity").alias("std_identity"),
        ct.extreme("identity").alias("min_identity"),
        ct.extreme("identity", F.max).alias("max_identity"),
        ct.mean("length").alias("mean_length"),
        ct.deviation("length").alias("std_length"),
        ct.quantile("identity", 0.5).alias("median_identity"),
        ct.quantile("length", 0.5).alias("median_length"),
    )


def class_counts(stats: DataFrame, a: str, b: str) -> DataFrame:
    """label, count_a, count_b (0 where missing) and the totals, over the union of classes."""
    both = stats.groupBy("label").agg(F.count_if(F.col("condition") == a).alias("count_a"), F.count_if(F.col("condition") == b).alias("count_b")).where("count_a + count_b > 0")
    everything = Window.partitionBy(F.lit(1))  # a row per class
    return both.withColumn("total_a", F.sum("count_a").over(everything)).withColumn("total_b", F.sum("count_b").over(everything))


def _per(n: str, unit: float) -> Column:
    return F.when(F.col(f"total_{n}") > 0, F.col(f"count_{n}") / F.col(f"total_{n}") * unit).otherwise(F.lit(0.0))


def shares(counts: DataFrame) -> DataFrame:
    return counts.select("label", _per("a", 100).alias("share_a"), _per("b", 100).alias("share_b"), (_per("b", 100) - _per("a", 100)).alias("delta_share"))


def counts_long(counts: DataFrame, a: str, b: str) -> DataFrame:
    return counts.select("label", F.expr(f"stack(2, '{a}', count_a, '{b}', count_b) as (condition, reads)"))


def tpm(counts: DataFrame) -> DataFrame:
    return counts.select("label", _per("a", 1e6).alias("tpm_a"), _per("b", 1e6).alias("tpm_b"))


def delta_tpm(counts: DataFrame) -> DataFrame:
    return tpm(counts).select("label", (F.col("tpm_b") - F.col("tpm_a")).alias("delta_tpm"))


def log2_fold_change(counts: DataFrame) -> DataFrame:
    return tpm(counts).select("label", F.log2((F.col("tpm_b") + 1) / (F.col("tpm_a") + 1)).alias("log2fc"))


def two_cell_chi_square(counts: DataFrame) -> DataFrame:
    """Label, chi2, p. Expected counts share the class's total by the conditions' totals."""
    total = F.col("count_a") + F.col("count_b")
    expected = {n: F.col(f"total_{n}") * total / (F.col("total_a") + F.col("total_b")) for n in "ab"}
    chi2 = sum(((F.col(f"count_{n}") - expected[n]) * (F.col(f"count_{n}") - expected[n]) / expected[n] for n in "ab"), F.lit(0.0))
    fine = (expected["a"] > 0) & (expected["b"] > 0)
    out = counts.withColumn("chi2", F.when(fine, chi2).otherwise(F.lit(0.0)))
    return out.withColumn("p", F.when(fine, chi_square_p("chi2")).otherwise(F.lit(1.0)))


def volcano(counts: DataFrame, fold: float = 2.0, threshold: float = 0.05) -> DataFrame:
    """Significance by p, as reported; significant_fdr goes by q."""
    tested = benjamini_hochberg(two_cell_chi_square(counts)).join(log2_fold_change(counts), "label")
    far = F.abs("log2fc") > F.log2(F.lit(fold))
    return tested.select("label", "log2fc", "chi2", "p", "q", (-F.log10(F.col("p") + 1e-300)).alias("neg_log10_p"), (far & (F.col("p") < threshold)).alias("significant"), (far & (F.col("q") < threshold)).alias("significant_fdr"))


def position_deltas(sums: DataFrame, a: str, b: str) -> DataFrame:
    """Label, pos, metric, delta (b - a) from position sums with a condition column. error_rate
    counts deletions as errors."""
    ratio = lambda x: F.when(F.col("cov") > 0, x / F.col("cov")).otherwise(F.lit(0.0))
    rates = sums.select("label", "pos", "condition", ratio(F.col("cov") - F.col("match")).alias("error_rate"), ratio(F.col("ins")).alias("insertion_rate"), ratio(F.col("del")).alias("deletion_rate"))
    names = ("error_rate", "insertion_rate", "deletion_rate")
    one = lambda c: rates.where(F.col("condition") == c).select("label", "pos", *(F.col(n).alias(f"{n}_{c}") for n in names))
    both = one(a).join(one(b), ["label", "pos"])
    stack = ", ".join(f"'{n}', `{n}_{b}` - `{n}_{a}`" for n in names)
    return both.select("label", "pos", F.expr(f"stack(3, {stack}) as (metric, delta)"))


def comparison_summary(stats: DataFrame, a: str, b: str) -> DataFrame:
    """A16."""
    counts = class_counts(stats, a, b)
    means = stats.groupBy("label").agg(F.avg(F.when(F.col("condition") == a, F.col("identity"))).alias("mean_identity_a"), F.avg(F.when(F.col("condition") == b, F.col("identity"))).alias("mean_identity_b"))
    out = benjamini_hochberg(two_cell_chi_square(counts)).withColumn("share_a", _per("a", 100)).withColumn("share_b", _per("b", 100)).withColumn("tpm_a", _per("a", 1e6)).withColumn("tpm_b", _per("b", 1e6))
    out = out.withColumn("delta_share", F.col("share_b") - F.col("share_a")).withColumn("delta_tpm", F.col("tpm_b") - F.col("tpm_a")).withColumn("log2fc", F.log2((F.col("tpm_b") + 1) / (F.col("tpm_a") + 1)))
    return out.withColumn("fold", F.pow(F.lit(2.0), F.col("log2fc"))).drop("total_a", "total_b").join(means, "label", "left")


def top_shared_classes(stats: DataFrame, a: str, b: str, k: int = 5) -> DataFrame:
    """The k classes with the most reads among those in both conditions."""
    return class_counts(stats, a, b).where("count_a > 0 and count_b > 0").select("label", (F.col("count_a") + F.col("count_b")).alias("reads")).orderBy(F.desc("reads"), "label").limit(k)


def shared_classes(stats: DataFrame, a: str, b: str) -> DataFrame:
    """J7."""
    one = lambda c: stats.where(F.col("condition") == c).select("label").distinct()
    return one(a).join(one(b), "label")


def in_label_order(table: DataFrame, order: DataFrame) -> DataFrame:
    """Rows in a given order of labels; labels without a place fall out."""
    return table.join(order, "label").orderBy("ord")
