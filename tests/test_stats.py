"""Statistical tests against hand-worked values and plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import counted as ct
from strandlake.functions import stats as st
from strandlake.operators import compare as cp
from strandlake.operators import conditions as cd


def test_chi_square_and_q_values(spark):
    rows = [(c, k) for label, a, b in (("x", 60, 30), ("y", 30, 50), ("z", 10, 20)) for k, n in (("p", a), ("q", b)) for c in [label] * n]
    counts = cd.class_counts(spark.createDataFrame(rows, "label string, condition string"), "p", "q")
    got = {r.label: (r.chi2, r.p, r.q) for r in st.benjamini_hochberg(cd.two_cell_chi_square(counts)).collect()}
    for label, want in {"x": (10, 0.00156540, 0.00469621), "y": (5, 0.02534732, 0.03802098), "z": (10 / 3, 0.06788915, 0.06788915)}.items():
        assert got[label] == pytest.approx(want, abs=1e-6)
    fold = {r.label: r.log2fc for r in cd.log2_fold_change(counts).collect()}
    assert [round(fold[k], 6) for k in "xyz"] == [-0.999998, 0.736964, 0.999993]


def mid_ranks(values):
    order = sorted(values)
    return {v: (order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in set(values)}


def test_rank_tests_match_plain_versions(spark):
    rng = random.Random(4)
    pairs = [(round(rng.gauss(0.9, 0.05), 2), round(rng.gauss(0.88, 0.05), 2)) for _ in range(200)]
    got = st.paired_signed_rank(spark.createDataFrame(pairs, "x double, y double")).first()
    d = [round(x - y, 12) for x, y in pairs if round(x - y, 12)]
    ranks = mid_ranks([abs(v) for v in d])
    w, n = sum(ranks[abs(v)] for v in d if v > 0), len(d)
    ties = sum(k**3 - k for v in ranks for k in [[abs(x) for x in d].count(v)])
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert got.statistic == pytest.approx(w) and got.p == pytest.approx(math.erfc(z / math.sqrt(2)) / 2)
    long = [(s, v) for p in pairs for s, v in zip("xy", p)]
    got = st.rank_sum(spark.createDataFrame(long, "side string, v double")).first()
    ranks = mid_ranks([v for _, v in long])
    u = sum(ranks[v] for s, v in long if s == "x") - 200 * 201 / 2
    ties = sum(k**3 - k for v in ranks for k in [[x for _, x in long].count(v)])
    z = (u - 200 * 200 / 2 - 0.5) / math.sqrt(200 * 200 / 12 * (401 - ties / (400 * 399)))
    assert got.statistic == pytest.approx(u) and got.p == pytest.approx(math.erfc(z / math.sqrt(2)) / 2)


def test_empty_tests_have_defined_results(spark):
    got = st.paired_signed_rank(spark.createDataFrame([], "x double, y double")).first()
    assert got.n == 0 and got.statistic == 0 and got.p == 1


def test_histogram_keeps_its_right_edge(spark):
    rows = spark.createDataFrame([(0.75,), (0.769,), (0.77,), (0.99,), (1.0,), (0.7,)], "identity double")
    assert {r.bin_start: r.reads for r in cd.identity_histogram(rows).collect()} == {75.0: 2, 77.0: 1, 99.0: 2}


def test_counted_values_give_moments_quantiles_and_merge(spark):
    rng = random.Random(8)
    rows = [(rng.choice("pq"), rng.choice([None, -0.5, 0.0, 1e6 + 0.25]) if rng.random() < 0.3 else round(rng.gauss(5, 40), 3)) for _ in range(2000)] + [("empty", None)] * 3
    counts = ct.count_values(spark.createDataFrame(rows, "g string, v double"), ["g"], {"v": F.col("v"), "w": F.col("v") * 2})
    depths = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    told = [ct.rows_of("v").alias("rows"), ct.mean("v").alias("mean"), ct.deviation("v").alias("std"), ct.extreme("v").alias("low"), ct.extreme("v", F.max).alias("high"), *(ct.quantile("v", d).alias(f"q{i}") for i, d in enumerate(depths)), ct.mean("w").alias("twice")]
    by_group = {r.g: r for r in ct.ranked(counts, ["g"]).groupBy("g").agg(*told).collect()}
    by_group[None] = ct.ranked(ct.merged(counts, []), []).agg(*told).first()
    for g in ("p", "q", None):
        values = [v for k, v in rows if v is not None and g in (k, None)]
        got = by_group[g]
        assert got.rows == sum(g in (k, None) for k, _ in rows)
        assert (got.mean, got.std, got.low, got.high, got.twice) == pytest.approx((np.mean(values), np.std(values), min(values), max(values), 2 * np.mean(values)))
        assert [got[f"q{i}"] for i in range(len(depths))] == pytest.approx(list(np.quantile(values, depths)))
    assert by_group["empty"].rows == 3 and by_group["empty"].mean is None and by_group["empty"].q3 is None


SIDE = "read_id string, label string, identity double, length int"


def test_report_reads_the_join_once_and_has_every_test(spark):
    """Without reads that disagree that test has an empty row; the join is not in the plan of what follows."""
    a = spark.createDataFrame([("1", "x", 0.9, 5), ("2", "y", 0.8, 5), ("3", "x", 0.7, 5)], SIDE)
    b = spark.createDataFrame([("1", "x", 0.85, 5), ("2", "y", 0.8, 5)], SIDE)
    compared = cp.compare_reads(a, b)
    for found in (cp.test_report(compared), cp.comparison_stats(compared)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FullOuter" not in plan and plan.count("Exchange") <= 14
    got = {r.test: r for r in cp.test_report(compared).collect()}
    assert list(sorted(got)) == ["paired_agree", "paired_all", "paired_disagree", "success_rate", "unpaired_all"]
    assert (got["paired_disagree"].n, got["paired_disagree"].statistic, got["paired_disagree"].p, got["paired_disagree"].mean_x) == (0, 0.0, 1.0, None)
    assert (got["paired_all"].n, got["paired_all"].statistic, got["unpaired_all"].n) == (2, 1.0, 5)
    one = cp.comparison_stats(compared).first()
    assert (one.total_a, one.total_b, one.only_a, one.agreements, one.median_delta) == (3, 2, 1, 2, pytest.approx(0.025))
    none = cp.comparison_stats(cp.compare_reads(a.limit(0), b.limit(0))).first()
    assert (none.total_a, none.mean_delta, none.median_delta, none.agreement_rate) == (0, 0.0, 0.0, 0.0)
    assert {r.n for r in cp.test_report(cp.compare_reads(a.limit(0), b.limit(0))).collect()} == {0}
