"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source's documents are shuffled by a hash of doc_id and text and queued `most` times over. A copy's virtual
finish time is the source's words up to and with it, divided by the source's target; the copies
of all sources, in order of that time, are taken until the budget is spent. Running sums over a
source and over all copies are made in two steps, sums of about sqrt(rows) ranges and then sums
within a range, so that no task holds more than a range of a hot source or of the whole.

Defined results: null text has size 0 and is never taken; a null source is a source of its own, last
in order; null doc_id and repeated rows are documents like others (equal rows may trade places); a text of any
length counts as a whole; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_column, materialize, text_key


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, rank, target from (source, size): water-filling of share * all words by
    weight under caps of most * source_size. One row per source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("rank", rank)
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * most).withColumn("full_at", F.col("cap") / F.col("w"))
    order = Window.orderBy("full_at", "rank")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("cap_before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    by = by.withColumn("w_after", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("budget", F.sum("source_size").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(share))
    by = by.withColumn("level_here", (F.col("budget") - F.col("cap_before")) / F.col("w_after"))
    level = F.max(F.when(F.col("full_at") > F.col("level_here"), F.col("level_here"))).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    by = by.withColumn("level", level)
    target = F.when(F.col("full_at") > F.col("level_here"), F.col("level") * F.col("w")).otherwise(F.col("cap").cast("double"))
    return by.select("source", "source_size", "rank", "budget", target.alias("target"))


def _running(rows: DataFrame, by: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Running sum of value (a long) in `order` within `by`, from sums of buckets."""
    null_safe = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, bucket]]
    sums = rows.groupBy(*by, bucket).agg(F.sum(value).alias("_part"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_part").over(before), F.lit(0))).drop("_part")
    within = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_within", F.sum(value).over(within))
    on = null_safe[0]
    for c in null_safe[1:]:
        on = on & c
    return rows.alias("r").join(sums.alias("s"), on).select("r.*", "s._before").withColumn(out, F.col("_before") + F.col("_within")).drop("_before", "_within")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (words taken; repeats counted) and the carried columns
    for every row."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    rows = materialize(docs.select("doc_id", "source", size.alias("size"), key.alias("k"), *carry))
    ranges = max(1, math.isqrt(rows.count()))
    sources = materialize(source_targets(rows, weights, share, most))
    r, s = rows.alias("r"), sources.alias("s")
    joined = r.join(s, F.col("r.source").eqNullSafe(F.col("s.source"))).select("doc_id", "size", "k", "source_size", "rank", "target", "budget", *carry)
    bucket = F.floor(F.conv(F.substring("k", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(2**32))
    order = ["k", F.col("doc_id").asc_nulls_first(), "size"]
    queued = materialize(_running(joined.withColumn("b", bucket), ["rank"], "b", order, "size", "upto"))
    when = lambda turn: (F.lit(turn) * F.col("source_size") + F.col("upto")) / F.col("target")
    slot = lambda at: F.floor(at * F.lit(ranges))
    copies = queued.where("target > 0 and size > 0").select("*", F.explode(F.array(*(F.struct(F.lit(i).alias("turn"), when(i).alias("at")) for i in range(most)))).alias("c"))
    copies = copies.select("size", "budget", F.struct("c.at", "rank", "c.turn", "k", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("doc_id"), "size").alias("key"), slot(F.col("c.at")).alias("slot"))
    sums = copies.groupBy("slot").agg(F.sum("size").alias("part"), F.max("budget").alias("budget"))
    run = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("part").over(run))
    cut = sums.where("upto > budget").agg(F.min("slot").alias("cut_slot"), F.min(F.col("upto") - F.col("part")).alias("spent"))
    inside = copies.join(F.broadcast(cut), F.col("slot") == F.col("cut_slot"))  # one row
    spent = F.col("spent") + F.sum("size").over(Window.partitionBy("slot").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("now", spent).where("now <= budget").agg(F.max("key").alias("last_key"))
    cut = materialize(cut.crossJoin(last))  # one row by one row
    taken = F.lit(0).cast("long")
    for i in range(most):
        key = F.struct(when(i).alias("at"), "rank", F.lit(i).alias("turn"), "k", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("doc_id"), "size")
        here = slot(when(i))
        in_ = F.col("cut_slot").isNull() | (here < F.col("cut_slot")) | ((here == F.col("cut_slot")) & F.coalesce(key <= F.col("last_key"), F.lit(False)))
        taken = taken + F.when((F.col("target") > 0) & in_, F.col("size")).otherwise(F.lit(0))
    return queued.crossJoin(F.broadcast(cut)).select("doc_id", "size", "source_size", "target", taken.alias("taken"), *carry)


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of docs as often as the mix takes them; other columns may have any names."""
    key, number, copies = (free_column(docs, c) for c in ("_tk", "_id", "_copies"))
    keyed = docs.withColumns({number: F.col("doc_id").cast("long"), key: text_key()})
    taken = mix_sources(keyed.select("doc_id", "text", "source", number, key), weights, share, most, carry=(number, key)).where("taken > 0")
    times = taken.groupBy(number, key).agg(F.ceil(F.avg(F.col("taken") / F.col("size"))).cast("int").alias(copies))
    on = keyed[number].eqNullSafe(times[number]) & (keyed[key] == times[key])
    joined = keyed.join(times, on).select(*(keyed[c] for c in docs.columns), times[copies])
    return joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col(copies))).alias(copies)).drop(copies)


#: The same rule in one statement, with plain running sums.
SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as k
  from documents),
s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rank from d group by source),
s1 as (select *, [3, 1, 2][((rank - 1) % 3) + 1] as w, 2 * source_size as cap from s0),
s2 as (select *, cap::double / w as full_at from s1),
s3 as (select *, sum(cap) over (order by full_at, rank) - cap as cap_before,
         sum(w) over (order by full_at, rank rows between current row and unbounded following) as w_after,
         sum(source_size) over () * 1.5::double as budget from s2),
s4 as (select *, (budget - cap_before::double) / w_after::double as level_here from s3),
s as (select source, rank, source_size, budget,
         case when full_at > level_here then max(case when full_at > level_here then level_here end) over () * w else cap::double end as target from s4),
q as (select d.doc_id, d.size, d.k, s.source_size, s.rank, s.target, s.budget,
         sum(d.size) over (partition by s.rank order by d.k, d.doc_id nulls first, d.size rows unbounded preceding) as upto
      from d join s on d.source is not distinct from s.source),
c as (select *, (t.turn * source_size + upto)::double / target as vt from q, (values (0), (1)) t(turn) where target > 0 and size > 0),
g as (select *, sum(size) over (order by vt, rank, turn, k, doc_id nulls first, size rows unbounded preceding) as spent from c),
n as (select doc_id, rank, k, size, upto, count(*) filter (where spent <= budget) as copies from g group by all)
select q.doc_id, q.size, q.source_size, q.target, (coalesce(n.copies, 0) * q.size)::bigint as taken
from q left join n on q.doc_id is not distinct from n.doc_id and q.rank = n.rank and q.upto = n.upto and q.k = n.k
"""
