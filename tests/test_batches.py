"""Batch kernels of CIGARs against walks of single bases, and what their jobs shuffle."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.functions import batches, kernels
from strandlake.functions import cigar as cg
from strandlake.operators import align, annotate, tracks
from strandlake.plans import bindings, registry

CIGAR = "array<struct<op: int, len: int>>"
REF = "ACGTTGCAAC" * 4
DATA = "/root/testdata/sf0.001"


def made(seed, n, ops=(0, 1, 2, 3, 4, 5, 6, 7, 8)):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        cigar = [(rng.choice(ops), rng.randint(0, 7)) for _ in range(rng.randint(0, 9))]
        rows.append((f"r{k // 2}", rng.randint(0, 9), cigar, "".join(rng.choices("ACGTé", k=rng.randint(0, 30))), 0, rng.choice("xy")))
    return [*rows, ("none", 3, None, None, 0, "x")]


def frame(spark, rows):
    return spark.createDataFrame(rows, f"read_id string, pos int, cigar {CIGAR}, seq string, ref_idx int, label string")


def places(pos, cigar):
    """(op, q, r) of every place."""
    q, r, out = 0, pos, []
    for op, n in cigar:
        for _ in range(n):
            if op not in (5, 6):
                out.append((op, q, r))
            q, r = q + (op in (0, 1, 4, 7, 8)), r + (op in (0, 2, 3, 7, 8))
    return out


def runs(ops):
    return [(op, len(list(g))) for op, g in itertools.groupby(ops)]


def test_resolved_and_trimmed_as_base_by_base(spark):
    rows = made(1, 300)
    refs = spark.createDataFrame([(0, "x", REF, 40)], "ref_idx int, ref_name string, seq string, len int")
    told = tracks.resolve_matches(frame(spark, rows), refs)
    got = told.select("cigar", cg.trim_to_window("cigar").alias("w"), cg.trim_to_matches("cigar").alias("m"), cg.expand("cigar").alias("ops")).collect()
    for (_, pos, cigar, seq, _, _), found in zip(rows, got):
        if cigar is None:
            assert found.cigar is None and (found.w.cigar, found.m.cigar) == ([], [])
            continue
        want = []
        for op, q, r in places(pos, cigar):
            same = q < len(seq) and r < len(REF) and seq[q] == REF[r]
            want.append(op if op else 7 if same else 8)
        assert found.ops == want
        if all(op for op, _ in cigar):
            assert [tuple(e) for e in found.cigar] == cigar
        hits = [o == 7 for o in want]
        head = next((e for e in found.cigar if e.op not in (5, 6)), None)
        lead = head.len if head is not None and head.op == 4 else 0
        first = next((i for i in range(lead, len(want) - 7) if sum(hits[i : i + 8]) >= 6), None)
        for trim, a, z in ((found.w, None if first is None else hits.index(True, first), len(want)), (found.m, hits.index(True) if any(hits) else None, len(want) - hits[::-1].index(True) if any(hits) else None)):
            if a is None:
                assert (trim.cigar, trim.shift, trim.removed) == ([], 0, 0)
                continue
            out = want[:a] + want[z:]
            clips = [sum(o in (1, 4, 7, 8) for o in part) for part in (want[:a], want[z:])]
            parts = [*([(4, clips[0])] if clips[0] else []), *runs(want[a:z]), *([(4, clips[1])] if clips[1] else [])]
            assert ([tuple(e) for e in trim.cigar], trim.shift, trim.removed) == (parts, sum(o in (2, 3, 7, 8) for o in want[:a]), sum(o in (1, 2, 8) for o in out))


def test_tracks_and_sums_as_base_by_base(spark):
    """Two alignments of each read id; those of one label are one read."""
    rows = made(2, 200, (1, 2, 3, 4, 5, 6, 7, 8))
    start, end = 4, 17
    want, reads = {}, {}
    for name, pos, cigar, _, _, label in rows:
        mine = [0, 0, 0, 0]
        for op, _, r in places(pos, cigar or []):
            at = r - 1 if op == 1 else r
            if op in (1, 2, 7, 8) and start <= at < end and at >= pos:
                counted = (op == 7, op == 1, op != 1, op == 2)
                mine = [x + y for x, y in zip(mine, counted)]
                key = (name, label, at)
                want[key] = tuple(x + y for x, y in zip(want.get(key, (0,) * 4), counted))
        reads.setdefault(name, []).append(tuple(mine))
    df = frame(spark, rows)
    got = tracks.tracks(df, F.lit(start), F.lit(end), "label").collect()
    assert {(r.read_id, r.label, r.position): (r.match, r.ins, r.cov, r["del"]) for r in got} == want and len(got) == len(want)
    sums = {}
    for (_, label, at), counts in want.items():
        sums[label, at] = tuple(x + y for x, y in zip(sums.get((label, at), (0,) * 4), counts))
    assert {(r.label, r.pos): (r.match, r.ins, r.cov, r["del"]) for r in tracks.position_sums(df, F.lit(start), F.lit(end), "label").collect()} == sums
    stats = {}
    for r in tracks.track_stats(df, F.lit(start), F.lit(end)).collect():
        stats.setdefault(r.read_id, []).append((r.matches, r.insertions, r.length, r.deletions))
    assert {k: sorted(v) for k, v in stats.items()} == {k: sorted(kept) for k, v in reads.items() if (kept := [x for x in v if x[1] + x[2]])}


def test_unresolved_sums_fail(spark):
    with pytest.raises(Exception, match="M is not resolved"):
        tracks.position_sums(frame(spark, made(3, 20)), F.lit(0), F.lit(40), "label").collect()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_lambda_walks_along_bases(spark):
    df = frame(spark, made(4, 3)).withColumns({"mv": F.array(F.lit(5)), "ts": F.lit(1), "ref_end": F.lit(9), "ref_len": F.lit(9), "class_code": F.lit(9)})
    for c in (cg.expand("cigar"), cg.placed("cigar", "pos"), cg.resolve_aligned("cigar", "seq", "seq", "pos"), cg.trim_to_window("cigar"), cg.trim_to_matches("cigar"), cg.region_counts("cigar", "pos", F.lit(0), F.lit(9)), annotate.signal_runs(annotate.label_stretches())):
        assert "lambda" not in plan(df.select(c))


def test_reads_of_a_class_do_not_meet_in_one_task(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = frame(spark, made(5, 9)).withColumns({"flag": F.lit(0), "is_split": F.lit(False), "mapq": F.lit(9)})
        refs = spark.createDataFrame([(0, "x", REF, 40)], "ref_idx int, ref_name string, seq string, len int")
        assert all("Exchange hashpartitioning" not in plan(x) for x in (tracks.resolve_matches(df, refs), tracks.read_stats(df, refs)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_places_are_not_shuffled(spark):
    shown = plan(tracks.tracks(frame(spark, made(6, 9)), F.lit(0), F.lit(9)))
    assert 0 < shown.index("Generate inline") < shown.index("Exchange hashpartitioning")


def summed_pairs(alignments):
    """read_id, op, places, query_sum, ref_sum, last_query of single places."""
    return sorted(map(tuple, tracks.aligned_pairs(alignments).groupBy("read_id", "op").agg(F.count("*"), F.sum("query_pos"), F.sum("ref_pos"), F.max("query_pos")).collect()), key=str)


@pytest.mark.parametrize("rows_of_a_batch", [1, 3, 10_000])
def test_pair_sums_are_those_of_single_places(spark, rows_of_a_batch):
    rows = made(11, 60)
    rows += [(None, *r[1:]) for r in rows[:3]] + [("no place", 3, [(5, 2), (6, 1)], "A", 0, "x"), ("no position", None, [(7, 2)], "AA", 0, "x"), ("empty", 1, [], "", 0, "x")] + [("many", k, [(7, 3), (1, 1)], "AAAA", 0, "x") for k in range(20)]
    df = frame(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_of_a_batch))
    try:
        found = [sorted(map(tuple, x.collect()), key=str) for x in (tracks.pair_sums(df.repartition(7)), tracks.pair_sums(df.repartition(3, "read_id"), together=True))]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = summed_pairs(df)
    assert found == [expected, expected] and ("many", 7, 60, 60, sum(3 * k + 3 for k in range(20)), 2) in expected and any(r[0] is None for r in expected)


def test_places_of_long_reads_are_made_in_lots(monkeypatch):
    rng = random.Random(12)
    cigars = [[(rng.choice([0, 1, 2, 3, 4, 5, 7, 8]), rng.choice([0, 1, 9, 400])) for _ in range(rng.randint(0, 6))] for _ in range(30)]
    args = np.arange(0, 30, 3), pa.array(range(30)), pa.array([[o for o, _ in c] for c in cigars], pa.list_(pa.int32())), pa.array([[n for _, n in c] for c in cigars], pa.list_(pa.int32()))
    whole = batches.pair_sums_of(*args)
    for lot in (1, 7, 64):
        monkeypatch.setattr(batches, "LOT", lot)
        assert all((x == y).all() for x, y in zip(whole, batches.pair_sums_of(*args)))
    monkeypatch.undo()
    args = np.zeros(1, int), pa.array([5]), pa.array([[7, 3, 7]], pa.list_(pa.int32())), pa.array([[10, 30_000_000, 10]], pa.list_(pa.int32()))
    tracemalloc.start()
    places, query, ref, last = (x[0] for x in batches.pair_sums_of(*args))
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert (places[3], query[3], ref[3], last[7]) == (30_000_000, -30_000_000, sum(range(15, 30_000_015)), 19)
    with pytest.raises(ValueError, match="below 0"):
        batches.pair_sums_of(np.zeros(1, int), pa.array([5]), pa.array([[-1]]), pa.array([[2]]))


def test_sums_of_pairs_are_not_shuffled(spark):
    shown = query_plan(spark, "p15_aligned_pairs")
    assert shown.count("REPARTITION_BY_NUM") == 1 and "hashpartitioning(read_id" not in shown


def test_lines_of_one_name_are_one_read_of_pairs(spark, tmp_path, monkeypatch):
    """In several files, and with names that meet as nulls have no part in them."""
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(200)
    unnamed = lines.limit(5).withColumns({"l_linenumber": F.lit(7), "l_orderkey": F.lit(None).cast("long")})
    named = unnamed.withColumns({"l_orderkey": F.lit(7).cast("long"), "l_linenumber": F.lit(None).cast("int")})
    lines.unionAll(lines.where("l_linenumber < 3")).unionAll(unnamed).unionAll(named).repartition(6).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(bindings, "TASK_ROWS", 20)
    found = registry.QUERIES["p15_aligned_pairs"](spark, str(tmp_path))
    assert dict(found.dtypes) == {"read_id": "string", "op": "int", "places": "bigint", "query_sum": "bigint", "ref_sum": "bigint", "last_query": "int"}
    assert found.rdd.getNumPartitions() > 10
    expected = summed_pairs(bindings.resolved(spark, str(tmp_path)))
    assert sorted(map(tuple, found.collect()), key=str) == expected and len({r[:2] for r in expected}) == len(expected)


def test_more_rows_are_dealt_to_more_tasks(spark):
    assert bindings.dealt(spark.range(0, 1_000_000, 1, 1)).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert bindings.dealt(spark.range(0, 9, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("kernel", [kernels.glocal, kernels.local])
def test_a_lot_of_alignments_takes_little_memory(kernel):
    query, ref = b"ACGTTGCAAC" * 20, b"ACGTTGCAAC" * 18
    lot = align.LOT_CELLS // ((len(query) + len(ref) + 1) * (len(query) + 1))
    tracemalloc.start()
    try:
        kernel([query] * lot, [ref] * lot)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30e6


def test_alignment_takes_two_python_steps(spark):
    df = spark.createDataFrame([("r", 1, "ACGT", [5, 1, 1, 1, 1], 1, (1, 9), 0, "ACGT")], "read_id string, rank int, seq string, mv array<int>, ts int, region struct<start: int, end: int>, ref_idx int, ref_seq string")
    shown = plan(align.align_candidates(df))
    assert shown.count("MapInArrow") == 2 and "ArrowEvalPython" not in shown


def test_alignments_and_clip_shifts_are_compiled(spark):
    df = frame(spark, made(4, 3))
    assert "lambda" not in plan(df.select(cg.clip_shifts("cigar", "cigar")))
    assert "lambda" not in plan(bindings.alignments(spark, "/root/testdata/sf0.001"))


def test_clip_shifts_go_by_the_outmost_operations_with_a_place(spark):
    rows = made(7, 200, (1, 2, 4, 5, 6, 7))
    df = spark.createDataFrame([(a[2], b[2]) for a, b in zip(rows, rows[1:])], f"a {CIGAR}, b {CIGAR}")
    for (a, _), (b, _), found in zip([(r[2], 0) for r in rows], [(r[2], 0) for r in rows[1:]], df.select(cg.clip_shifts("a", "b").alias("c")).collect()):
        clip = lambda x, i: ([n if op == 4 else None for op, n in x or [] if op not in (5, 6)] or [None])[i]
        assert found.c == tuple(0 if clip(b, i) is None else clip(b, i) - (clip(a, i) or 0) for i in (-1, 0))


def test_a_read_goes_on_over_batches(spark):
    rows = [(k, None if k == "none" else "xy"[i % 2], i % 3, [(7, 3), (1, 1), (7, 2)]) for k, n in (("a", 1), ("b", 9), (None, 5), ("none", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, f"read_id string, label string, pos int, cigar {CIGAR}")
    shown = plan(tracks.tracks(df, F.lit(0), F.lit(9), "label"))
    assert "ObjectHashAggregate" not in shown  # which sorts, and keeps a buffer of rows for each read
    ask = lambda: sorted(map(repr, tracks.tracks(df, F.lit(0), F.lit(9), "label").collect()))
    want = ask()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert ask() == want and len(want) == len(set(want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    match = {}
    for k, label, pos, _ in rows:
        for place in range(pos, pos + 5):
            match[k, label, place] = match.get((k, label, place), 0) + 1
    assert {(r.read_id, r.label, r.position): r.match for r in tracks.tracks(df, F.lit(0), F.lit(9), "label").collect()} == match


@pytest.mark.parametrize("kernel", [kernels.glocal, kernels.local])
def test_a_cell_of_a_read_is_one_number_of_four_bytes(kernel, monkeypatch):
    rng, used, whole = random.Random(8), [], kernels._Cells.__init__

    def noted(self, *args):
        whole(self, *args)
        used.append(self.type)

    def wide(self, *args):
        whole(self, *args)
        self.type, self.letter = np.int64, 55

    refs = ["".join(rng.choices("ACGT", k=rng.randint(1, 320))) for _ in range(40)]
    reads = [("".join(rng.choices("ACGT", k=9)) + r[: len(r) // 2] + r[len(r) // 2 + rng.randint(0, 3) :]).encode() for r in refs]
    refs = [r.encode() for r in refs]
    monkeypatch.setattr(kernels._Cells, "__init__", noted)
    four = kernel(reads, refs)
    monkeypatch.setattr(kernels._Cells, "__init__", wide)
    eight = kernel(reads, refs)
    assert used == [np.int32]
    assert all((x == y).all() for x, y in zip(four.ops, eight.ops))
    assert all((getattr(four, k) == getattr(eight, k)).all() for k in ("query_start", "query_end", "ref_start", "ref_end", "matches"))


def test_costs_become_whole_numbers():
    assert [kernels._scale(*x) for x in ((2.0, 1.0), (2.0, 0.5), (-3.0, 0.25), (2.3, 0.7), (0.01, 5), (1 / 3, 1))] == [1, 2, 4, 10, 100, 1 << 16]


def query_plan(spark, name):
    return plan(registry.QUERIES[name](spark, DATA))


def test_gates_need_no_bases(spark):
    assert "ArrowEvalPython" not in query_plan(spark, "f8_f9_f11_gates")


def test_labels_of_bases_need_no_resolved_cigars(spark):
    shown = query_plan(spark, "p18_w7_base_labels")
    assert "label_stretches(" in shown and "resolve_aligned(" not in shown


def test_runs_are_worked_out_once(spark):
    assert query_plan(spark, "l8_p19_annotate_reads").count("signal_runs(") == 1


@pytest.mark.parametrize("name", ["a31_f1_f2_f4_f5_f7_statuses", "a32_condition_statuses"])
def test_statuses_take_one_pass(spark, name):
    shown = query_plan(spark, name)
    assert shown.count("resolve_aligned(") == 1 and "Union" not in shown


def test_statuses_of_rows_that_are_not_judged(spark):
    ops = [(7, 30)]
    rows = [
        ("good", 0, ops, "A" * 30, 0, 0, False),
        ("unmapped", 0, None, "A" * 30, None, 4, True),
        ("unmapped of a class", 0, ops, "A" * 30, 0, 4, False),
        ("short", 0, ops, "A" * 9, 7, 0, False),
        ("split", 0, ops, "A" * 30, 0, 0, True),
        ("of no class", 0, ops, "A" * 30, 7, 0, False),
        ("no cigar", 0, None, "A" * 30, 0, 0, False),
    ]
    df = spark.createDataFrame(rows, f"read_id string, pos int, cigar {CIGAR}, seq string, ref_idx int, flag int, is_split boolean").withColumn("mapq", F.lit(9))
    for columns in (["ref_idx", "ref_name", "len"], ["ref_idx", "ref_name", "len", "seq"]):
        refs = spark.createDataFrame([(0, "x", 40, REF)], "ref_idx int, ref_name string, len int, seq string").select(*columns)
        got = {r.read_id: (r.label, r.identity, r.matches, r.length, r.status) for r in tracks.read_stats(df, refs).collect()}
        none = (None, None, 0, 0)
        assert got == {"good": ("x", 1.0, 30, 30, "pass"), "unmapped": (*none, "unmapped"), "unmapped of a class": (*none, "unmapped"), "short": (*none, "failed"), "no cigar": ("x", 0.0, None, None, "failed")}


def test_counted_reads_are_not_dealt(spark):
    assert query_plan(spark, "a4_w5_coverage_matrix").count("REPARTITION_BY_NUM") == 1
