"""Tables of two result sets over the same reads.

Read statistics of a side: read_id, label, identity, length and counts of matches, mismatches,
insertions, deletions. The sides meet in one full outer join; every table below is grouped from it
or from one side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import counted as ct
from ..functions.stats import paired_entries, rank_tests, success_rate_test, unpaired_entries
from ..session import stored
from ..sources.tables import require_compatible
from .conditions import bin_of

UNMAPPED = "Unmapped"


def compare_reads(a: DataFrame, b: DataFrame) -> DataFrame:
    """read_id, labels and metrics of both sides, agree, delta_identity, membership."""
    side = lambda d, s: d.select("read_id", *(F.col(c).alias(f"{c}_{s}") for c in ("label", "identity", "length")))
    both = side(a, "a").join(side(b, "b"), "read_id", "full_outer")
    in_a, in_b = F.col("label_a").isNotNull(), F.col("label_b").isNotNull()
    membership = F.when(in_a & in_b, "both").when(in_a, "only_a").otherwise("only_b")
    return both.select(
        "read_id",
        F.coalesce("label_a", F.lit(UNMAPPED)).alias("label_a"),
        F.coalesce("label_b", F.lit(UNMAPPED)).alias("label_b"),
        "identity_a",
        "identity_b",
        "length_a",
        "length_b",
        (in_a & in_b & (F.col("label_a") == F.col("label_b"))).alias("agree"),
        (F.col("identity_a") - F.col("identity_b")).alias("delta_identity"),
        membership.alias("membership"),
    )


_MEMBERS = {
    "total_a": "membership <> 'only_b'",
    "total_b": "membership <> 'only_a'",
    "both": "membership = 'both'",
    "only_a": "membership = 'only_a'",
    "only_b": "membership = 'only_b'",
    "agreements": "membership = 'both' and agree",
    "disagreements": "membership = 'both' and not agree",
}


def comparison_stats(compared: DataFrame) -> DataFrame:
    """A21, in one row, from one pass over the joined reads."""
    counts = ct.count_values(compared, ["membership", "agree"], {"delta": F.col("delta_identity")})
    told = counts.groupBy("measure", "value").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.expr(which), F.col("n")).otherwise(0)).alias(name) for name, which in _MEMBERS.items()))
    names = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in _MEMBERS]
    out = ct.ranked(told, []).agg(*names, F.coalesce(ct.mean("delta"), F.lit(0.0)).alias("mean_delta"), F.coalesce(ct.quantile("delta", 0.5), F.lit(0.0)).alias("median_delta"))
    return out.withColumn("agreement_rate", F.when(F.col("both") > 0, F.col("agreements") / F.col("both")).otherwise(F.lit(0.0)))


def aligner_class_counts(compared: DataFrame) -> DataFrame:
    """Aligner, label, reads; a side's Unmapped are the other side's exclusive reads."""
    long = compared.select(F.expr("stack(2, 'a', label_a, 'b', label_b) as (aligner, label)"))
    return long.groupBy("aligner", "label").agg(F.count("*").alias("reads"))


def class_count_deltas(compared: DataFrame) -> DataFrame:
    """Reads of a minus reads of b."""
    counts = aligner_class_counts(compared)
    return counts.groupBy("label").agg(F.sum(F.when(F.col("aligner") == "a", F.col("reads")).otherwise(-F.col("reads"))).alias("delta"))


def crosstab(compared: DataFrame) -> DataFrame:
    """A20, long: every label of either side on both axes, 0 where no read falls."""
    cells = compared.groupBy("label_a", "label_b").agg(F.count("*").alias("reads"))
    labels = cells.select(F.explode(F.array("label_a", "label_b")).alias("label")).union(cells.sparkSession.range(1).select(F.lit(UNMAPPED).alias("label"))).distinct()
    axes = labels.select(F.col("label").alias("label_a")).crossJoin(labels.select(F.col("label").alias("label_b")))  # classes by classes: the table itself
    return axes.join(cells, ["label_a", "label_b"], "left").select("label_a", "label_b", F.coalesce("reads", F.lit(0)).alias("reads"))


def crosstab_wide(compared: DataFrame, labels: list[str]) -> DataFrame:
    return compared.groupBy("label_a").pivot("label_b", labels).count().na.fill(0)


def length_identity_histogram(compared: DataFrame, bins: int = 50) -> DataFrame:
    """length_bin, identity_bin, reads_a, reads_b, delta over equal bins of the joint range."""
    long = compared.select(F.expr("stack(2, 'a', length_a, identity_a, 'b', length_b, identity_b) as (side, length, identity)")).where("length is not null and identity is not null")
    limits = long.agg(F.min("length").alias("l0"), F.max("length").alias("l1"), F.min("identity").alias("i0"), F.max("identity").alias("i1"))
    placed = long.crossJoin(F.broadcast(limits))  # one row

    def place(v: str, lo: str, hi: str) -> Column:
        at = F.floor(F.round((F.col(v) - F.col(lo)) * bins / (F.col(hi) - F.col(lo)), 9)).cast("int")
        return F.when(F.col(hi) > F.col(lo), F.least(F.lit(bins - 1), at)).otherwise(F.lit(0))

    cells = placed.groupBy(place("length", "l0", "l1").alias("length_bin"), place("identity", "i0", "i1").alias("identity_bin"))
    out = cells.agg(F.count_if(F.col("side") == "a").alias("reads_a"), F.count_if(F.col("side") == "b").alias("reads_b"))
    return out.withColumn("delta", F.col("reads_a") - F.col("reads_b"))


def identity_grid(compared: DataFrame, threshold: float = 0.75, only_disagreeing: bool = False) -> DataFrame:
    """Percent bins of both identities, cells with reads only; 1.0 lies in the last bin."""
    low = int(threshold * 100 + 1e-9)
    bins = 100 - low
    rows = compared.where("membership = 'both'" + (" and not agree" if only_disagreeing else ""))
    x, y = (bin_of(F.col(f"identity_{s}") * 100, low, 1, bins).alias(f"bin_{s}") for s in "ab")
    cells = rows.select(x, y).where("bin_a is not null and bin_b is not null").groupBy("bin_a", "bin_b").agg(F.count("*").alias("reads"))
    return cells.select((F.col("bin_a") + low).alias("pct_a"), (F.col("bin_b") + low).alias("pct_b"), "reads")


def identity_rmse(compared: DataFrame) -> DataFrame:
    """A24, for all reads of both sides and for disagreeing ones."""
    square = F.col("delta_identity") * F.col("delta_identity")
    rows = compared.where("membership = 'both'")
    return rows.agg(F.sqrt(F.avg(square)).alias("rmse"), F.sqrt(F.avg(F.when(~F.col("agree"), square))).alias("rmse_disagreeing"))


def exclusive_histograms(compared: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Side, pct, reads of reads that one side alone has."""
    low = int(threshold * 100 + 1e-9)
    rows = compared.where("membership <> 'both'").select(F.substring("membership", 6, 1).alias("side"), bin_of(F.coalesce("identity_a", "identity_b") * 100, low, 1, 100 - low).alias("b"))
    return rows.where("b is not null").groupBy("side", (F.col("b") + low).alias("pct")).agg(F.count("*").alias("reads"))


def aligner_class_summary(sides: DataFrame, ref_lengths: DataFrame) -> DataFrame:
    """From read statistics with an aligner column: a row per (aligner, label) and one total row
    (All_tRNAs) per aligner, from one pass over the reads and grouping sets over their counted values. Deletions are
    not mismatches here."""
    sums = ("matches", "mismatches", "insertions", "deletions")
    counts = ct.count_values(sides, ["aligner", "label"], {"identity": F.col("identity"), "length": F.col("length")}, sums)
    sets = [["aligner", "label", "measure", "value"], ["aligner", "measure", "value"]]
    both = counts.groupingSets(sets, "aligner", "label", "measure", "value").agg(F.grouping("label").alias("is_total"), *(F.sum(c).alias(c) for c in ("n", *sums)))
    by = ["aligner", "label", "is_total"]
    grouped = ct.ranked(both, by).groupBy(*by).agg(
        ct.rows_of("identity").alias("n"),
        ct.mean("identity").alias("mean_identity"),
        ct.deviation("identity").alias("std_identity"),
        ct.mean("length").alias("mean_length"),
        *(ct.quantile("identity", p / 100).alias(f"p{p}_identity") for p in (25, 50, 75)),
        ct.quantile("length", 0.5).alias("median_length"),
        *(F.sum(c).alias(c) for c in sums),
    )
    joined = grouped.join(ref_lengths, "label", "left")
    mean_ref = F.avg("ref_len").over(Window.partitionBy("aligner"))
    total = F.col("matches") + F.col("mismatches") + F.col("insertions") + F.col("deletions")
    share = lambda c: F.when(total > 0, F.col(c) / total).otherwise(F.lit(0.0))
    joined = joined.withColumn("ref_len", F.when(F.col("is_total") == 1, mean_ref).otherwise(F.col("ref_len").cast("double")))
    names = {"matches": "match_rate", "mismatches": "mismatch_rate", "insertions": "insertion_rate", "deletions": "deletion_rate"}
    label = F.when(F.col("is_total") == 1, F.lit("All_tRNAs")).otherwise(F.col("label"))
    keep = ("n", "mean_identity", "std_identity", "p25_identity", "p50_identity", "p75_identity", "mean_length", "median_length", "ref_len")
    return joined.select("aligner", label.alias("label"), "is_total", *keep, *(share(c).alias(n) for c, n in names.items()))


def aligner_identity_histogram(sides: DataFrame) -> DataFrame:
    """Aligner, pct, reads in percent bins from 0 to 1."""
    return sides.groupBy("aligner", bin_of(F.col("identity") * 100, 0, 1, 100).alias("pct")).agg(F.count("*").alias("reads")).where("pct is not null")


def position_proportions(sums: DataFrame) -> DataFrame:
    """Match, mismatch, deletion and insertion shares of (cov + ins) at each position."""
    total = F.col("cov") + F.col("ins")
    share = lambda x, n: F.when(total > 0, x / total).otherwise(F.lit(0.0)).alias(n)
    rest = F.col("cov") - F.col("match") - F.col("del")
    return sums.select("aligner", "label", "pos", share(F.col("match"), "match_share"), share(rest, "mismatch_share"), share(F.col("del"), "deletion_share"), share(F.col("ins"), "insertion_share"))


def error_delta_matrix(sums: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Error rate of a minus that of b at positions that both have; null beyond the shorter one."""
    rate = F.when(F.col("cov") > 0, 1 - F.col("match") / F.col("cov")).otherwise(F.lit(0.0))
    one = lambda s: sums.where(F.col("aligner") == s).select("label", "pos", rate.alias(f"rate_{s}"))
    shared = one(a).select("label").distinct().join(one(b).select("label").distinct(), "label")
    out = one(a).join(one(b), ["label", "pos"], "full_outer").join(shared, "label")
    return out.select("label", "pos", (F.col(f"rate_{a}") - F.col(f"rate_{b}")).alias("delta_error"))


def run_summary(stats: DataFrame) -> DataFrame:
    """A30, from one pass over the reads."""
    names = ("identity", "matches", "mismatches", "insertions", "deletions", "length")
    counts = ct.count_values(stats, ["label"], {c: F.col(c) for c in names})
    classes = counts.agg(F.count_distinct("label").alias("classes"))
    found = ct.ranked(ct.merged(counts, []), []).agg(ct.rows_of("identity").alias("reads"), *(ct.mean(c).alias(f"mean_{c}") for c in names), *(ct.quantile(c, 0.5).alias(f"median_{c}") for c in names))
    return found.crossJoin(classes)  # one row by one row


def test_report(compared: DataFrame, threshold: float = 0.85) -> DataFrame:
    """The paired tests over all, agreeing and disagreeing reads of both sides, the unpaired one, and the
    success rates at a threshold, all from one pass over the joined reads."""
    x, y = F.col("identity_a"), F.col("identity_b")
    counts = ct.count_values(compared, ["membership", "agree"], {"x": x, "y": y, "d": F.round(x - y, 12)})
    sets = F.explode(F.array(F.lit("paired_all"), F.when(F.col("agree"), "paired_agree").otherwise("paired_disagree"))).alias("test")
    paired = paired_entries(counts.where("membership = 'both'").select(sets, "measure", "value", "n"), ["test"])
    unpaired = unpaired_entries(counts.withColumn("test", F.lit("unpaired_all")), ["test"])
    found = rank_tests(paired.unionByName(unpaired), ["test"])
    names = F.explode(F.array(*(F.lit(t) for t in ("paired_all", "paired_agree", "paired_disagree", "unpaired_all")))).alias("test")
    found = compared.sparkSession.range(1).select(names).join(found, "test", "left")  # a test without reads has a row too
    found = found.withColumns({"n": F.coalesce("n", F.lit(0)), "p": F.coalesce("p", F.lit(1.0)), "statistic": F.coalesce("statistic", F.when(F.col("test") != "unpaired_all", 0.0))})
    ok = lambda s: F.coalesce(F.sum(F.when((F.col("measure") == s) & (F.col("value") >= threshold), F.col("n"))), F.lit(0))
    rates = success_rate_test(counts.agg(*(c.alias(n) for s in "xy" for n, c in ((f"pass_{s}", ok(s)), (f"fail_{s}", ct.rows_of(s) - ok(s))))))
    rates = rates.select(F.lit("success_rate").alias("test"), (F.col("pass_x") + F.col("fail_x")).alias("n"), F.col("rate_x").alias("mean_x"), F.col("rate_y").alias("mean_y"), "statistic", "p")
    return found.unionByName(rates, allowMissingColumns=True).withColumn("significant", F.col("p") < 0.05)


def attempted_reads(*sets: DataFrame) -> DataFrame:
    """How many distinct read ids the sets hold."""
    out = sets[0].select("read_id")
    for s in sets[1:]:
        out = out.union(s.select("read_id"))
    return out.distinct().agg(F.count("*").alias("attempted"))


def merge_results(*runs: DataFrame, keep_order: str | None = None) -> DataFrame:
    """One row per read_id, that of the first run that has it; keep_order names a column with the run's number that
    is there already and stays."""
    tagged = [r if keep_order else r.withColumn("_ord", F.lit(i)) for i, r in enumerate(runs)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy("read_id").orderBy(keep_order or "_ord"))
    return out.withColumn("_n", rank).where("_n = 1").drop("_n", *([] if keep_order else ["_ord"]))


def merge_archives(*archives: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Archives as pairs of records and their one-row metadata (run_id, the must-agree fields, pod5_paths, ..) to
    one pair. Raises if models or chunk sizes differ. A read_id has the record of the first archive that
    holds it, with that archive's run_id; the metadata is the first archive's, with the paths of all (in order, once
    each) and their reads and times summed up."""
    told = [m.withColumn("_ord", F.lit(i)) for i, (_, m) in enumerate(archives)]
    metadata = told[0]
    for m in told[1:]:
        metadata = metadata.unionByName(m, allowMissingColumns=True)
    metadata = stored(require_compatible(metadata))  # a row per archive
    tagged = [r.withColumn("_ord", F.lit(i)) for i, (r, _) in enumerate(archives)]
    merged = merge_results(*tagged, keep_order="_ord").join(F.broadcast(metadata.select("_ord", "run_id")), "_ord").drop("_ord")
    paths = F.array_sort(F.collect_list(F.struct("_ord", F.coalesce("pod5_paths", F.array().cast("array<string>")).alias("p"))))
    summed = [F.sum(c).alias(c) for c in ("num_reads_processed", "total_inference_time") if c in metadata.columns]
    united = F.array_distinct(F.flatten(F.transform(paths, lambda x: x["p"]))).alias("pod5_paths")
    rest = [c for c in metadata.columns if c not in ("_ord", "pod5_paths", "num_reads_processed", "total_inference_time")]
    return merged, metadata.agg(*(F.min_by(c, "_ord").alias(c) for c in rest), united, *summed)


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Reads of a that b lacks."""
    return a.join(b.select("read_id"), "read_id", "left_anti")


def require_all(wanted: DataFrame, held: DataFrame) -> None:
    """Raises unless every wanted read_id is held."""
    missing = [r["read_id"] for r in only_in(wanted, held).select("read_id").limit(5).collect()]
    if missing:
        raise ValueError(f"reads not found, among them {missing}")
