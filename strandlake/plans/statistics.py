"""Queries of the condition and comparison families, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as st
from ..operators import compare as cp
from ..operators import conditions as cd
from . import bindings as b

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def rounded(df, places: int = 5):
    return df.select(*((F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def simple(name: str, make, sql: str, places: int = 5) -> None:
    query(sql, name)(lambda spark, sf_dir: rounded(make(spark, sf_dir), places))


_r = lambda e, n, p=5: f"round({e}, {p}) + 0 as {n}"
_S = f"with {b.CONDITIONS} "
_C = f"with {b.COUNTS} "
_V = f"with {b.COMPARED} "
stats_of = b.two_conditions
counts_of = lambda spark, d: cd.class_counts(stats_of(spark, d), "F", "O")

simple("a1_reads_per_class", lambda s, d: cd.reads_per_class(stats_of(s, d)), _S + "select label, count(*) as reads from stats group by label")
simple(
    "a2_identity_histogram",
    lambda s, d: cd.identity_histogram(stats_of(s, d), 0.91),
    _S + "select 91.0::double + 2 * k as bin_start, count(*) as reads from (select least(4, floor(round((identity * 100 - 91) / 2, 9)))::int as k from stats where round((identity * 100 - 91) / 2, 9) between 0 and 4.5) group by k",
)
_DEPTHS = "[0.0625, 0.125, 0.25, 0.5, 0.75, 0.875, 0.9375]"
simple(
    "a3_identity_letter_values",
    lambda s, d: cd.letter_values(stats_of(s, d)),
    _S + f"select label, depth::double as depth, {_r('q * 100', 'identity_pct')} from (select label, unnest({_DEPTHS}) as depth, unnest(quantile_cont(identity, {_DEPTHS})) as q from stats group by label)",
)
simple("a3_identity_values", lambda s, d: cd.identity_values(stats_of(s, d)), _S + f"select label, {_r('identity * 100', 'identity_pct')} from stats")
simple("a6_length_histogram", lambda s, d: cd.length_histogram(stats_of(s, d)), _S + "select length, count(*) as reads from stats group by length")
simple("a7_count_vs_identity", lambda s, d: cd.count_vs_identity(stats_of(s, d)), _S + f"select label, count(*) as reads, {_r('avg(identity) * 100', 'mean_identity_pct')} from stats group by label")
simple(
    "a8_class_summary",
    lambda s, d: cd.class_summary(stats_of(s, d)),
    _S + f"select label, count(*) as reads, {_r('avg(identity)', 'mean_identity')}, {_r('stddev_pop(identity)', 'std_identity')}, {_r('quantile_cont(identity, 0.5)', 'median_identity')}, {_r('min(identity)', 'min_identity')}, {_r('max(identity)', 'max_identity')}, {_r('avg(length)', 'mean_length')}, {_r('stddev_pop(length)', 'std_length')}, {_r('quantile_cont(length, 0.5)', 'median_length')} from stats group by label",
)
simple("a9_shares", lambda s, d: cd.shares(counts_of(s, d)), _C + f"select label, {_r('share_a', 'share_a')}, {_r('share_b', 'share_b')}, {_r('share_b - share_a', 'delta_share')} from c")
simple("a10_counts_side_by_side", lambda s, d: cd.counts_long(counts_of(s, d), "F", "O"), _C + "select label, 'F' as condition, count_a as reads from c union all select label, 'O', count_b from c")
simple("a11_tpm", lambda s, d: cd.tpm(counts_of(s, d)), _C + f"select label, {_r('tpm_a', 'tpm_a', 4)}, {_r('tpm_b', 'tpm_b', 4)} from c", 4)
simple("a12_delta_tpm", lambda s, d: cd.delta_tpm(counts_of(s, d)), _C + f"select label, {_r('tpm_b - tpm_a', 'delta_tpm', 4)} from c", 4)
simple("a13_log2_fold_change", lambda s, d: cd.log2_fold_change(counts_of(s, d)), _C + f"select label, {_r('log2((tpm_b + 1) / (tpm_a + 1))', 'log2fc')} from c")
_E = "total_a * (count_a + count_b)::double / (total_a + total_b)"
_F = "total_b * (count_a + count_b)::double / (total_a + total_b)"
_CHI = f"((count_a - {_E}) * (count_a - {_E}) / ({_E}) + (count_b - {_F}) * (count_b - {_F}) / ({_F}))"
#: The upper tail of chi-square with one degree of freedom by its series, since DuckDB has no erfc.
_P = "(1 - list_sum(list_transform(range(0, 60), lambda n: (case when n % 2 = 0 then 1 else -1 end) * exp((2 * n + 1) * ln(sqrt({x} / 2)) - lgamma(n + 1) - ln(2 * n + 1)))) * 2 / sqrt(pi()))"
_T = f"with {b.COUNTS}, t as (select *, {_CHI} as chi2 from c), t2 as (select *, case when chi2 < 1e-12 then 1.0 else {_P.format(x='chi2')} end as p from t), q0 as (select *, p * count(*) over () / row_number() over (order by p) as r from t2), tested as (select *, least(1.0, min(r) over (order by p desc rows unbounded preceding)) as q, log2((tpm_b + 1) / (tpm_a + 1)) as log2fc from q0) "
simple("t1_two_cell_chi_square", lambda s, d: cd.two_cell_chi_square(counts_of(s, d)).select("label", "chi2", "p"), _T + f"select label, {_r('chi2', 'chi2')}, {_r('p', 'p')} from tested")
simple("t2_benjamini_hochberg", lambda s, d: st.benjamini_hochberg(cd.two_cell_chi_square(counts_of(s, d))).select("label", "p", "q"), _T + f"select label, {_r('p', 'p')}, {_r('q', 'q')} from tested")
simple(
    "a14_volcano",
    lambda s, d: cd.volcano(counts_of(s, d), 1.02, 0.2),
    _T + f"select label, {_r('log2fc', 'log2fc')}, {_r('chi2', 'chi2')}, {_r('p', 'p')}, {_r('q', 'q')}, {_r('-log10(p + 1e-300)', 'neg_log10_p')}, abs(log2fc) > log2(1.02::double) and p < 0.2 as significant, abs(log2fc) > log2(1.02::double) and q < 0.2 as significant_fdr from tested",
)
simple(
    "a16_comparison_summary",
    lambda s, d: cd.comparison_summary(stats_of(s, d), "F", "O"),
    _T
    + f"select label, count_a, count_b, {_r('chi2', 'chi2')}, {_r('p', 'p')}, {_r('q', 'q')}, {_r('share_a', 'share_a')}, {_r('share_b', 'share_b')}, {_r('tpm_a', 'tpm_a')}, {_r('tpm_b', 'tpm_b')}, {_r('share_b - share_a', 'delta_share')}, {_r('tpm_b - tpm_a', 'delta_tpm')}, {_r('log2fc', 'log2fc')}, {_r('pow(2, log2fc)', 'fold')}, {_r('mean_identity_a', 'mean_identity_a')}, {_r('mean_identity_b', 'mean_identity_b')} from tested left join (select label, avg(identity) filter (where condition = 'F') as mean_identity_a, avg(identity) filter (where condition = 'O') as mean_identity_b from stats group by label) using (label)",
)
simple("w2_top_shared_classes", lambda s, d: cd.top_shared_classes(stats_of(s, d), "F", "O"), _C + "select label, count_a + count_b as reads from c where count_a > 0 and count_b > 0 order by reads desc, label limit 5")
simple("j6_union_of_classes", lambda s, d: counts_of(s, d).select("label", "count_a", "count_b"), _C + "select label, count_a, count_b from c")
simple("j7_shared_classes", lambda s, d: cd.shared_classes(stats_of(s, d), "F", "O"), _S + "select distinct label from stats where condition = 'F' intersect select label from stats where condition = 'O'")


@query(_S + "select label, count(*) as reads, ord from stats join (select p_brand as label, row_number() over (order by p_brand desc) as ord from (select distinct p_brand from part where p_size > 10)) using (label) group by label, ord")
def j11_w3_label_order(spark, sf_dir):
    from pyspark.sql import Window

    brands = b.table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_brand").alias("label")).distinct()
    order = brands.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("label"))).cast("bigint"))  # the dimension: a row per class
    return cd.in_label_order(cd.reads_per_class(stats_of(spark, sf_dir)), order)


simple("j4_compare_reads", b.compared, _V + f"select read_id, label_a, label_b, identity_a, identity_b, length_a, length_b, agree, {_r('delta_identity', 'delta_identity')}, membership from compared")
simple("j5_membership", lambda s, d: b.compared(s, d).groupBy("membership", "agree").agg(F.count("*").alias("reads")), _V + "select membership, agree, count(*) as reads from compared group by all")
simple(
    "a21_comparison_stats",
    lambda s, d: cp.comparison_stats(b.compared(s, d)),
    _V + f"select count(*) filter (where membership <> 'only_b') as total_a, count(*) filter (where membership <> 'only_a') as total_b, count(*) filter (where membership = 'both') as both, count(*) filter (where membership = 'only_a') as only_a, count(*) filter (where membership = 'only_b') as only_b, count(*) filter (where membership = 'both' and agree) as agreements, count(*) filter (where membership = 'both' and not agree) as disagreements, {_r('avg(delta_identity)', 'mean_delta')}, {_r('quantile_cont(delta_identity, 0.5)', 'median_delta')}, round((count(*) filter (where membership = 'both' and agree))::double / count(*) filter (where membership = 'both'), 5) as agreement_rate from compared",
)
simple("a17_class_counts_per_aligner", lambda s, d: cp.aligner_class_counts(b.compared(s, d)), _V + "select 'a' as aligner, label_a as label, count(*) as reads from compared group by label_a union all select 'b', label_b, count(*) from compared group by label_b")
simple("a18_class_count_deltas", lambda s, d: cp.class_count_deltas(b.compared(s, d)), _V + "select label, sum(n)::bigint as delta from (select label_a as label, 1 as n from compared union all select label_b, -1 from compared) group by label")
simple("a20_crosstab", lambda s, d: cp.crosstab(b.compared(s, d)), _V + ", l as (select label_a as label from compared union select label_b from compared union select 'Unmapped') select x.label as label_a, y.label as label_b, count(compared.read_id) as reads from l x cross join l y left join compared on compared.label_a = x.label and compared.label_b = y.label group by x.label, y.label")
_B22 = "case when {hi} > {lo} then least(49, floor(round(({v} - {lo}) * 50 / ({hi} - {lo}), 9)))::int else 0 end"
simple(
    "a22_length_identity_histogram",
    lambda s, d: cp.length_identity_histogram(b.compared(s, d)),
    _V + f", long as (select 'a' as side, length, identity from a union all select 'b', length, identity from b), lim as (select min(length)::double as l0, max(length)::double as l1, min(identity) as i0, max(identity) as i1 from long) select {_B22.format(v='length', lo='l0', hi='l1')} as length_bin, {_B22.format(v='identity', lo='i0', hi='i1')} as identity_bin, count(*) filter (where side = 'a') as reads_a, count(*) filter (where side = 'b') as reads_b, count(*) filter (where side = 'a') - count(*) filter (where side = 'b') as delta from long, lim group by 1, 2",
)
_B23 = "least(19, floor(round(identity_{s} * 100 - 80, 9)))::int + 80"
for _n, _w, _kw in (("a23_identity_grid", "", {}), ("a23_identity_grid_disagreeing", " and not agree", {"only_disagreeing": True})):
    simple(_n, lambda s, d, kw=_kw: cp.identity_grid(b.compared(s, d), 0.8, **kw), _V + f"select {_B23.format(s='a')} as pct_a, {_B23.format(s='b')} as pct_b, count(*) as reads from compared where membership = 'both' and round(identity_a * 100 - 80, 9) >= 0 and round(identity_b * 100 - 80, 9) >= 0{_w} group by 1, 2")
simple("a24_identity_rmse", lambda s, d: cp.identity_rmse(b.compared(s, d)), _V + "select round(sqrt(avg(delta_identity * delta_identity)), 5) as rmse, round(sqrt(avg(delta_identity * delta_identity) filter (where not agree)), 5) as rmse_disagreeing from compared where membership = 'both'")
simple("a25_exclusive_histograms", lambda s, d: cp.exclusive_histograms(b.compared(s, d), 0.8), _V + "select membership[6:6] as side, least(19, floor(round(coalesce(identity_a, identity_b) * 100 - 80, 9)))::int + 80 as pct, count(*) as reads from compared where membership <> 'both' and round(coalesce(identity_a, identity_b) * 100 - 80, 9) >= 0 group by 1, 2")


@query(
    _V
    + f""", s as (select 'a' as aligner, * from a union all select 'b', * from b), refs as (select l_returnflag as label, (60 + ascii(l_returnflag) % 7)::bigint as ref_len from lineitem group by 1),
  g as (select aligner, label, grouping(label) as is_total, count(*) as n, avg(identity) as mean_identity, stddev_pop(identity) as std_identity, quantile_cont(identity, 0.25) as p25_identity, quantile_cont(identity, 0.5) as p50_identity, quantile_cont(identity, 0.75) as p75_identity,
    avg(length) as mean_length, quantile_cont(length, 0.5) as median_length, sum(matches) as m, sum(mismatches) as x, sum(insertions) as i, sum(deletions) as d from s group by grouping sets ((aligner, label), (aligner)))
  select aligner, case when is_total = 1 then 'All_tRNAs' else g.label end as label, is_total, n, {_r('mean_identity', 'mean_identity')}, {_r('std_identity', 'std_identity')}, {_r('p25_identity', 'p25_identity')}, {_r('p50_identity', 'p50_identity')}, {_r('p75_identity', 'p75_identity')}, {_r('mean_length', 'mean_length')}, {_r('median_length', 'median_length')},
    round(case when is_total = 1 then avg(ref_len) over (partition by aligner) else ref_len::double end, 5) as ref_len, {_r('m::double / (m + x + i + d)', 'match_rate')}, {_r('x::double / (m + x + i + d)', 'mismatch_rate')}, {_r('i::double / (m + x + i + d)', 'insertion_rate')}, {_r('d::double / (m + x + i + d)', 'deletion_rate')} from g left join refs on g.label = refs.label"""
)
def a26_aligner_class_summary(spark, sf_dir):
    labels = b.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label")).distinct()
    refs = labels.select("label", (60 + F.ascii("label") % 7).cast("bigint").alias("ref_len"))
    return rounded(cp.aligner_class_summary(b.both_sides(spark, sf_dir), refs))


simple("a27_aligner_identity_histogram", lambda s, d: cp.aligner_identity_histogram(b.both_sides(s, d)), _V + "select aligner, least(99, floor(round(identity * 100, 9)))::int as pct, count(*) as reads from (select 'a' as aligner, identity from a union all select 'b', identity from b) group by 1, 2")
simple(
    "a30_run_summary",
    lambda s, d: cp.run_summary(b.side(s, d, 1)),
    _V + "select count(*) as reads, count(distinct label) as classes, " + ", ".join(f"{_r(f'avg({c})', f'mean_{c}')}, {_r(f'quantile_cont({c}, 0.5)', f'median_{c}')}" for c in ("identity", "matches", "mismatches", "insertions", "deletions", "length")) + " from a",
)
_six = lambda s, d: (b.side(s, d, i).where(F.col("label") == x) for i in (1, 2) for x in ("A", "N", "R"))
simple("j8_attempted_reads", lambda s, d: cp.attempted_reads(*_six(s, d)), _V + "select count(distinct read_id) as attempted from (select read_id from a where label in ('A', 'N', 'R') union all select read_id from b where label in ('A', 'N', 'R'))")
simple(
    "j9_merge_results",
    lambda s, d: cp.merge_results(*(b.side(s, d, i).select("read_id", "label", "identity") for i in (2, 1))),
    _V + "select read_id, label, round(identity, 5) as identity from b union all select read_id, label, round(identity, 5) from a where read_id not in (select read_id from b)",
)


def _archive(spark, sf_dir, line):
    """A side as an archive whose metadata is told from its lines."""
    lines = b.table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") % 2 == line % 2)
    paths = F.array_sort(F.array_distinct(F.concat(F.collect_set(F.concat(F.lit("lines/"), F.col("l_linenumber").cast("string"))), F.collect_set(F.concat(F.lit("flags/"), "l_returnflag")))))
    metadata = lines.agg(paths.alias("pod5_paths"), F.count("*").alias("num_reads_processed")).select(F.lit(f"side {line}").alias("run_id"), F.lit("m").alias("model_name"), F.lit("t").alias("model_type"), F.lit(54).alias("chunk_size"), F.lit("float16").alias("float_dtype"), "*")
    return b.side(spark, sf_dir, line).select("read_id", "label"), metadata


def j9_archives(spark, sf_dir):
    records, metadata = cp.merge_archives(_archive(spark, sf_dir, 2), _archive(spark, sf_dir, 1))
    told = metadata.select(F.array_join("pod5_paths", ",").alias("paths"), "num_reads_processed")
    return records.groupBy("run_id").agg(F.count("*").alias("records")).crossJoin(F.broadcast(told))  # one row


_PATHS = "select distinct 'lines/' || l_linenumber as p from lineitem where l_linenumber % 2 = {k} union select distinct 'flags/' || l_returnflag from lineitem where l_linenumber % 2 = {k}"
simple(
    "j9_merge_archives",
    j9_archives,
    _V.rstrip() + f", p0 as (select 0 as o, p from ({_PATHS.format(k=0)})), p1 as (select 1 as o, p from ({_PATHS.format(k=1)}) where p not in (select p from p0)), u as (select string_agg(p, ',' order by o, p) as paths from (select * from p0 union all select * from p1)), "
    "n as (select count(*) as num_reads_processed from lineitem), m as (select 'side 2' as run_id, count(*) as records from b union all select 'side 1', count(*) from a where read_id not in (select read_id from b)) select run_id, records, paths, num_reads_processed from m, u, n",
)
simple("j12_missing_reads", lambda s, d: cp.only_in(b.side(s, d, 1), b.side(s, d, 2)).select("read_id"), _V + "select read_id from a where read_id not in (select read_id from b)")
simple("a34_distinct_reads", lambda s, d: stats_of(s, d).select("read_id").distinct(), _S + "select distinct read_id from stats")


def test_report(spark, sf_dir):
    return cp.test_report(b.compared(spark, sf_dir))


_W = """select {name} as test, count(*) as n, round(avg(x), 5) as mean_x, round(avg(y), 5) as mean_y, round(quantile_cont(x, 0.5), 5) as median_x, round(quantile_cont(y, 0.5), 5) as median_y,
  round((select coalesce(sum(r) filter (where d > 0), 0) from (select d, (rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0::double) as r from (select round(x - y, 12) as d from ({rows})) where d <> 0)), 5) as statistic from ({rows})"""
_ROWS = "select identity_a as x, identity_b as y from compared where membership = 'both'"
_U = """select 'unpaired_all' as test, count(*) as n, round(avg(v) filter (where side = 'x'), 5) as mean_x, round(avg(v) filter (where side = 'y'), 5) as mean_y, round(quantile_cont(v, 0.5) filter (where side = 'x'), 5) as median_x, round(quantile_cont(v, 0.5) filter (where side = 'y'), 5) as median_y,
  round(sum(r) filter (where side = 'x') - (count(*) filter (where side = 'x')) * ((count(*) filter (where side = 'x')) + 1.0::double) / 2, 5) as statistic
  from (select *, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0::double as r from (select 'x' as side, identity as v from a union all select 'y', identity from b))"""
_TWO = "select count(*) filter (where identity_a >= 0.85) as a1, count(*) filter (where not coalesce(identity_a >= 0.85, false)) as b1, count(*) filter (where identity_b >= 0.85) as c1, count(*) filter (where not coalesce(identity_b >= 0.85, false)) as d1 from compared"
_Z5 = f"select 'success_rate' as test, a1 + b1 as n, round(a1::double / (a1 + b1), 5) as mean_x, round(c1::double / (c1 + d1), 5) as mean_y, null::double as median_x, null::double as median_y, round((a1 + b1 + c1 + d1)::double * pow(greatest(0, abs(a1::double * d1 - b1::double * c1) - (a1 + b1 + c1 + d1) / 2.0), 2) / ((a1 + b1)::double * (c1 + d1) * (a1 + c1) * (b1 + d1)), 5) as statistic from ({_TWO})"
_report = [_W.format(name="'paired_all'", rows=_ROWS), _W.format(name="'paired_agree'", rows=_ROWS + " and agree"), _W.format(name="'paired_disagree'", rows=_ROWS + " and not agree"), _U, _Z5]
simple("t3_t4_t5_test_statistics", lambda s, d: test_report(s, d).select("test", "n", "mean_x", "mean_y", "median_x", "median_y", "statistic"), _V + " union all ".join(f"select * from ({x})" for x in _report))
#: Without SQL: p-values need the error function; unit tests hold them against math.erfc.
query(None, "t6_test_report")(lambda s, d: rounded(test_report(s, d)))
