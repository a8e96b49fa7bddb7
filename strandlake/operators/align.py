"""Alignment jobs (P7, P8, L1 to L6): DataFrame pipelines around the batch kernels.

Each row carries its read segment and its reference, so rows of any class share a batch and no class needs
a task of its own; candidates are joined to the small reference table before the kernel, and the cheap
tests run before it too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import batches, kernels
from ..functions import cigar as cg
from ..functions.arrays import let, once
from ..schemas import MATCH
from ..session import stored

#: Cells of one kernel call, a byte each; longer reads go in smaller lots. Larger lots are slower, as they leave the cache.
LOT_CELLS = 1 << 24


@dataclass(frozen=True)
class Parameters:
    gap_open: float = 2.0
    gap_extend: float = 0.5
    local_open: float = -6.0
    local_extend: float = -1.0
    local_match: float = 3.0
    local_mismatch: float = 1.0
    identity: float = 0.75
    min_matches: int = 25
    fragment_deletions: float = 0.15
    fragment_edits: float = 0.3
    improvement: float = 0.001
    compat: bool = False  # rescue keeps the first candidate that spans enough


def base_positions(mv: str | Column, ts: str | Column) -> Column:
    """Signal place of each base, in signal order."""
    m = F.col(mv) if isinstance(mv, str) else mv
    t = F.col(ts) if isinstance(ts, str) else ts
    marks = F.filter(F.transform(m, lambda v, i: F.when((i > 0) & (v == 1), i)), lambda i: i.isNotNull())
    return F.transform(marks, lambda i: i * m[0] + t)


def cut_region(seq: Column, positions: Column, start: Column, end: Column) -> Column:
    """struct(sub, three_clip, five_clip): bases whose signal lies in [start, end]; the sequence runs
    against the signal. sub is empty if no base reaches a bound."""

    def cut(p: Column) -> Column:
        at = F.size(F.filter(p, lambda x: x < start))  # places are ascending
        upto = F.size(F.filter(p, lambda x: x <= end))
        first = F.greatest(at - 1, F.lit(0))
        hit = (at < F.size(p)) & (upto > 0)
        sub = F.when(hit, F.reverse(F.substring(F.reverse(seq), first + 1, F.greatest(upto - first, F.lit(0))))).otherwise(F.lit(""))
        return F.struct(sub.alias("sub"), first.alias("three_clip"), F.greatest(F.lit(0), F.size(p) - upto).alias("five_clip"))

    return let(positions, cut)


def _kernel(rows: DataFrame, query: str, ref: str, wanted: str | None, kind: str, params: Parameters, clips: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ops, q_start, q_end, r_start, r_end, hits; null where `wanted` is not true or a text is empty. With `clips`,
    the columns of bases before and after the query in its read (or none), adds _t, the CIGAR with its clips trimmed to
    the first good window, and _ed, its edits before, instead of ops."""
    names = rows.columns
    where = {c: names.index(c) for c in (query, ref, wanted, *(clips or ())) if c}
    added = ["ops"] if clips is None else ["_t", "_ed"]
    shown = ["q_start", "q_end", "r_start", "r_end", "hits"]

    def align(queries, refs):
        if kind == "glocal":
            return kernels.glocal(queries, refs, params.gap_open, params.gap_extend)
        return kernels.local(queries, refs, params.local_open, params.local_extend, params.local_match, params.local_mismatch)

    def run(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            q, t = (batch.column(where[c]).to_pylist() for c in (query, ref))
            ask = batch.column(where[wanted]).to_pylist() if wanted else [True] * batch.num_rows
            todo = sorted((i for i in range(batch.num_rows) if ask[i] and q[i] and t[i]), key=lambda i: (len(q[i]), len(t[i])))
            out: list[list] = [[None] * batch.num_rows for _ in range(6)]
            while todo:
                cells = (len(q[todo[-1]]) + len(t[todo[-1]]) + 1) * (max(len(q[todo[-1]]), len(t[todo[-1]])) + 1)
                lot, todo = todo[-max(1, LOT_CELLS // cells) :], todo[: -max(1, LOT_CELLS // cells)]
                a = align([q[i].encode() for i in lot], [t[i].encode() for i in lot])
                for k, i in enumerate(lot):
                    for column, x in zip(out, (a.ops[k].astype(np.int32), a.query_start[k], a.query_end[k], a.ref_start[k], a.ref_end[k], a.matches[k])):
                        column[i] = x
            ops, *numbers = [pa.array(out[0], pa.list_(pa.int32())), *(pa.array([None if x is None else int(x) for x in c], pa.int32()) for c in out[1:])]
            arrays = [ops]
            if clips is not None:
                lead, tail = (batch.column(where[c]) for c in clips) if clips else (0, 0)
                edits = batches.from_edits(ops, pc.add(lead, numbers[0]), pc.add(tail, pc.subtract(pa.array([len(x or "") for x in q], pa.int32()), numbers[1])))
                arrays = [batches.trim_to_window(edits.field(0), pa.array([8]), pa.array([6])), edits.field(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays, *numbers], names=[*names, *added, *shown])

    types = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    kinds = ", ".join(f"{c} {t}" for c, t in zip(added, ["array<int>"] if clips is None else [cg.TRIMMED, "int"]))
    return rows.mapInArrow(run, f"{types}, {kinds}, q_start int, q_end int, r_start int, r_end int, hits int")


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows out evenly before a kernel: they are small, and AQE would join their partitions by bytes
    where the work is in the cells."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "read_id", "rank")


def glocal(rows: DataFrame, query: str, ref: str, params: Parameters = Parameters()) -> DataFrame:
    """L1 over a frame of sequences."""
    return _kernel(rows, query, ref, None, "glocal", params)


def local(rows: DataFrame, query: str, ref: str, wanted: str | None = None, params: Parameters = Parameters()) -> DataFrame:
    """L2 over a frame of sequences."""
    return _kernel(rows, query, ref, wanted, "local", params)


def _with_local(rows: DataFrame, query: str, ref: str, wanted: str | None, params: Parameters, clips: tuple[str, str] | None = None) -> DataFrame:
    """Adds l, struct(cigar, pos, ed, span) of a local alignment, null if it has too few matches."""
    rows = _kernel(rows, query, ref, wanted, "local", params, clips or ())
    done = F.struct(F.col("_t.cigar").alias("cigar"), (F.col("r_start") + F.col("_t.shift")).alias("pos"), (F.col("_ed") - F.col("_t.removed")).alias("ed"), (F.col("r_end") - F.col("r_start") - F.col("_t.shift")).alias("span"))
    return rows.withColumn("l", F.when(F.col("hits") >= params.min_matches, done)).drop("_ed", "_t")


def align_candidates(candidates: DataFrame, params: Parameters = Parameters()) -> DataFrame:
    """L3: candidates (read_id, rank, seq, mv, ts, region, ref_idx, ref_seq) to read_id, rank, ref_idx,
    mapped, pos, mapq, flag, cigar, ed, fragment, identity, matches. Rank 1 is the primary."""
    region = F.col("region")
    start = F.greatest(region["start"], F.col("ts"))
    cut = cut_region(F.col("seq"), base_positions("mv", "ts"), start, region["end"])
    rows = once(candidates, "cut", F.when(region["start"] >= 0, cut)).withColumn("sub", F.coalesce("cut.sub", F.lit("")))
    rows = rows.select("read_id", "rank", "ref_idx", "ref_seq", "sub", F.coalesce("cut.five_clip", F.lit(0)).alias("five"), F.coalesce("cut.three_clip", F.lit(0)).alias("three"))
    one = _kernel(spread(rows), "sub", "ref_seq", None, "glocal", params, ("five", "three"))
    trimmed = F.struct(F.col("_t.cigar").alias("cigar"), F.col("_t.shift").alias("pos"), (F.col("_ed") - F.col("_t.removed")).alias("ed"))
    one = one.withColumn("g", F.when(F.col("hits").isNotNull(), trimmed)).drop("_ed", "_t", "q_start", "q_end", "r_start", "r_end", "hits")
    some = F.size("g.cigar") > 0
    one = one.withColumn("is_frag", F.coalesce(some & cg.is_fragment("g.cigar", F.length("ref_seq"), params.fragment_deletions), F.lit(False)))
    two = _with_local(one, "sub", "ref_seq", "is_frag", params, ("five", "three"))
    whole_ok = some & ~F.col("is_frag") & (cg.identity("g.cigar") >= params.identity) & (cg.total("g.cigar", MATCH) >= params.min_matches)
    frag_ok = F.col("is_frag") & F.col("l").isNotNull() & (F.size("l.cigar") > 0) & (F.col("l.ed") <= F.col("l.span") * params.fragment_edits)
    chosen = F.when(F.coalesce(frag_ok, F.lit(False)), F.struct("l.cigar", "l.pos", "l.ed")).when(F.coalesce(whole_ok, F.lit(False)), F.struct("g.cigar", "g.pos", "g.ed"))
    two = once(two, "c", chosen).withColumn("mapped", F.col("c").isNotNull())
    return two.select(
        "read_id",
        "rank",
        "ref_idx",
        "mapped",
        "c.pos",
        F.when(F.col("rank") == 1, 60).otherwise(0).alias("mapq"),
        F.when(~F.col("mapped"), 4).when(F.col("rank") == 1, 0).otherwise(256).alias("flag"),
        "c.cigar",
        "c.ed",
        (F.col("mapped") & F.col("is_frag")).alias("fragment"),
        cg.identity("c.cigar").alias("identity"),
        cg.total("c.cigar", MATCH).alias("matches"),
    )


def best_of_two(aligned: DataFrame, params: Parameters = Parameters()) -> DataFrame:
    """L4: keeps both candidates of a read, the better one first: winner mapq 60 and flag 0, loser 0 and
    256; swapped tells that the second won."""
    fields = ["ref_idx", "mapped", "pos", "cigar", "ed", "fragment", "identity", "matches"]
    pick = lambda r: F.first(F.when(F.col("rank") == r, F.struct(*fields)), ignorenulls=True).alias(f"c{r}")  # noqa: E731  one row per rank
    both = aligned.groupBy("read_id").agg(pick(1), pick(2))
    least = params.min_matches
    better = F.col("c2.mapped") & (~F.col("c1.mapped") | ((F.col("c2.matches") >= least) & ((F.col("c1.matches") < least) | (F.col("c2.identity") > F.col("c1.identity") + params.improvement))))
    both = both.withColumn("swapped", F.coalesce(better, F.lit(False)))
    first = F.when(F.col("swapped"), F.col("c2")).otherwise(F.col("c1"))
    second = F.when(F.col("swapped"), F.col("c1")).otherwise(F.col("c2"))
    rows = both.select("read_id", "swapped", F.explode(F.array(F.struct(F.lit(1).alias("rank"), first.alias("c")), F.struct(F.lit(2).alias("rank"), second.alias("c")))).alias("e"))
    rows = rows.select("read_id", "e.rank", *(F.col(f"e.c.{f}").alias(f) for f in fields), (F.col("swapped") & (F.col("e.rank") == 1)).alias("swapped")).where("mapped is not null")
    mapq, flag = F.when(F.col("rank") == 1, 60).otherwise(0), F.when(~F.col("mapped"), 4).when(F.col("rank") == 1, 0).otherwise(256)
    return rows.withColumn("mapq", mapq).withColumn("flag", flag)


def rescue(candidates: DataFrame, params: Parameters = Parameters()) -> DataFrame:
    """Whole reads (read_id, rank 1 to 3, seq, ref_idx, ref_seq) against their candidates, locally; the
    best candidate, if it is good enough. mapq is 3 for the first candidate, then 2 and 1."""
    rows = _with_local(spread(candidates.select("read_id", "rank", "ref_idx", "seq", "ref_seq")), "seq", "ref_seq", None, params).where("l is not null and size(l.cigar) > 0")
    score = (F.col("l.span") - F.col("l.ed")) / F.col("l.span")
    order = [(F.col("l.span") >= 25).desc(), "rank"] if params.compat else [(F.col("l.span") >= 25).desc(), score.desc(), "rank"]
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy("read_id").orderBy(*order))).where("_n = 1")
    best = best.withColumn("identity", cg.identity("l.cigar")).withColumn("matches", cg.total("l.cigar", MATCH)).where((F.col("identity") >= params.identity) & (F.col("matches") >= params.min_matches))
    return best.select("read_id", "ref_idx", F.lit(True).alias("mapped"), "l.pos", (4 - F.col("rank")).alias("mapq"), F.lit(0).alias("flag"), "l.cigar", "l.ed", F.lit(False).alias("fragment"), "identity", "matches", (F.col("rank") - 1).alias("rescue_rank"))


def candidate_rows(reads: DataFrame, calls: DataFrame, refs: DataFrame, most: int) -> DataFrame:
    """Reads that are not split and have a call, a row for each of the first candidates."""
    called = reads.where(~F.col("is_split")).join(calls, "read_id")
    rows = called.select("read_id", "seq", "mv", "ts", "region", F.posexplode(F.slice("top3", 1, most)).alias("rank", "ref_idx")).withColumn("rank", F.col("rank") + 1)
    dims = refs.select("ref_idx", F.col("seq").alias("ref_seq"))  # a row per class
    return rows.join(dims, "ref_idx")


def align_reads(reads: DataFrame, calls: DataFrame, refs: DataFrame, secondary: bool = True, params: Parameters = Parameters()) -> DataFrame:
    """Alignments of called reads. With `secondary`, the second candidate competes, is written as a
    secondary row if it is mapped, and unmapped reads are tried again on all three."""
    aligned = align_candidates(candidate_rows(reads, calls, refs, 2 if secondary else 1), params)
    none = F.lit(None).cast("int").alias("rescue_rank")
    if not secondary:
        return aligned.where("rank = 1").drop("rank").withColumn("swapped", F.lit(False)).withColumn("rescue_rank", none)
    judged = stored(best_of_two(aligned, params))  # three steps read it, and the kernels should run once
    winners = judged.where("rank = 1").drop("rank")
    lost = winners.where(~F.col("mapped")).select("read_id")
    again = stored(rescue(candidate_rows(reads.join(lost, "read_id", "left_semi"), calls, refs, 3), params).withColumn("swapped", F.lit(False)))
    kept = winners.join(again.select("read_id"), "read_id", "left_anti").withColumn("rescue_rank", none)
    seconds = judged.where("rank = 2 and mapped").drop("rank").withColumn("rescue_rank", none)
    return kept.unionByName(again).unionByName(seconds)


def with_read_columns(aligned: DataFrame, reads: DataFrame) -> DataFrame:
    """Adds the sequence and fails on a CIGAR that does not fit it."""
    joined = aligned.join(reads.select("read_id", "seq"), "read_id")
    fits = ~F.col("mapped") | cg.is_consistent("cigar", F.length("seq"))
    return joined.where(F.coalesce(F.assert_true(fits, F.lit("CIGAR and sequence lengths differ")).isNull(), F.lit(True)))


def sorted_for_output(aligned: DataFrame) -> DataFrame:
    """By reference and position over all partitions."""
    return aligned.repartitionByRange("ref_idx", "pos").sortWithinPartitions("ref_idx", "pos")
