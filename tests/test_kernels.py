"""Golden cases and plain versions of the array, CIGAR and alignment kernels."""

import functools
import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import arrays as ar
from strandlake.functions import cigar as cg
from strandlake.functions import kernels
from strandlake.operators import align, annotate, compare, smoothing, tracks
from strandlake.schemas import LETTERS
from strandlake.sources import tables as src

CODES = {letter: op for op, letter in enumerate(LETTERS)}
CIGAR = "array<struct<op: int, len: int>>"


def parse(text):
    return [(CODES[o], int(n)) for n, o in re.findall(r"(\d+)([A-Z=])", text)]


def test_signal_kernels(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 6.0], [1, 2, 0, 2, 0, 3], [0, 0, 2, 2, 2, 5, 1]), ("b", [], [1, 2], [])], "read_id string, x array<double>, p array<int>, l array<int>")
    out = {r.read_id: r for r in rows.select("read_id", ar.standardize("x").alias("z"), ar.class_span("p", F.lit(54)).alias("span"), ar.run_lengths("l").alias("rle"), ar.top_k("x").alias("top"), ar.whole_chunks("x", 3, 5).alias("cut"), ar.chunked("x", 2).alias("tokens")).collect()}
    assert [round(v, 6) for v in out["a"].z] == [-1.069045, -0.534522, 0.0, 1.603567]
    assert tuple(out["a"].span) == (108, 269) and tuple(out["b"].span) == (-1, -1)
    assert [tuple(r) for r in out["a"].rle] == [(0, 2), (2, 3), (5, 1), (1, 1)] and out["b"].rle == []
    assert out["a"].top == [3, 2, 1] and out["a"].cut == [1.0, 2.0, 3.0] and out["a"].tokens == [[1.0, 2.0], [3.0, 6.0]]
    assert out["b"].z is None and out["b"].cut == [] and out["b"].tokens == []


def test_nan_samples_become_zero(spark):
    rows = spark.createDataFrame([([1.0, float("nan"), 3.0],)], "x array<double>")
    z, m = rows.select(ar.standardize("x"), ar.min_max("x")).first()
    assert z[1] == 0.0 and m[1] == 0.0 and m[0] == pytest.approx(-1) and m[2] == pytest.approx(1)


@pytest.mark.parametrize(
    "text, whole, window",
    [("5S6D1=1D3=32D45S", ("5S1=1D3=45S", 6, 38), ("", 0, 0)), ("3S2X1D8=1X4=2S", ("5S8=1X4=2S", 3, 3), ("5S8=1X4=2S", 3, 3)), ("3S2X", ("", 0, 0), ("", 0, 0)), ("", ("", 0, 0), ("", 0, 0))],
)
def test_trims(spark, text, whole, window):
    rows = spark.createDataFrame([(parse(text),)], f"cigar {CIGAR}")
    m, w = rows.select(cg.trim_to_matches("cigar"), cg.trim_to_window("cigar")).first()
    for got, (cigar, shift, removed) in ((m, whole), (w, window)):
        assert ([tuple(e) for e in got.cigar], got.shift, got.removed) == (parse(cigar), shift, removed)


def test_cut_region(spark):
    rows = spark.createDataFrame([("ACGT", [5, 1, 0, 1, 1, 0, 1], 10, 24, 33), ("ACGT", [5, 1, 0, 1, 1, 0, 1], 10, 90, 99)], "seq string, mv array<int>, ts int, a int, z int")
    p = align.base_positions("mv", "ts")
    one, two = rows.select(p.alias("p"), align.cut_region(F.col("seq"), p, F.col("a"), F.col("z")).alias("c")).collect()
    assert one.p == [15, 25, 30, 40] and tuple(one.c) == ("CGT", 0, 1)
    assert two.c.sub == ""


def test_tracks(spark):
    rows = spark.createDataFrame([("r", 1, parse("1S2=1I1X1D2="))], f"read_id string, pos int, cigar {CIGAR}")
    t = tracks.tracks(rows, F.lit(0), F.lit(8))
    got = {r.position: (r["match"], r.ins, r.cov, r["del"]) for r in t.collect()}
    assert got == {1: (1, 0, 1, 0), 2: (1, 1, 1, 0), 3: (0, 0, 1, 0), 4: (0, 0, 1, 1), 5: (1, 0, 1, 0), 6: (1, 0, 1, 0)}
    s = tracks.track_stats(rows, F.lit(0), F.lit(8)).first()
    assert s.identity == pytest.approx(4 / 7) and (s.mismatches, s.insertions, s.deletions, s.length) == (1, 1, 1, 6)


def test_statuses_partition_reads(spark):
    rows = spark.createDataFrame(
        [("a", "A" * 30, 0, False, 0, 0, 60, parse("30=")), ("b", "A" * 9, 0, False, 0, 0, 60, parse("9=")), ("c", "A" * 30, 4, False, 0, 0, 0, []), ("d", "A" * 30, 256, False, 0, 0, 60, parse("30=")), ("e", "A" * 30, 0, True, 0, 0, 60, parse("30=")), ("f", "A" * 30, 0, False, 7, 0, 60, parse("30=")), ("g", "A" * 30, 0, False, 0, 90, 60, parse("30="))],
        f"read_id string, seq string, flag int, is_split boolean, ref_idx int, pos int, mapq int, cigar {CIGAR}",
    )
    refs = spark.createDataFrame([(0, "x", 40)], "ref_idx int, ref_name string, len int")
    got = {r.read_id: r.status for r in tracks.read_stats(rows, refs).collect()}
    assert got == {"a": "pass", "b": "failed", "c": "unmapped", "g": "failed"}


def test_smoothing_golden():
    e = np.array([[[0, 3, 1, 0], [0, 1, 3, 0], [2, 0, 1, 0], [0, 0, 3, 1], [3, 0, 0, 1], [0, 0, 0, 4]]], float)
    assert smoothing.best_paths(e, np.array([6]), smoothing.transitions())[0].tolist() == [1, 2, 2, 2, 0, 3]


GOLDEN = [("TTACGTACGTGG", "ACGTACGT", "mmmmmmmm", 2, 10), ("ACGACGT", "ACGTACGT", "mmmdmmmm", 0, 7), ("ACGTTACGT", "ACGTACGT", "mmmimmmmm", 0, 9), ("ACCTACGT", "ACGTACGT", "mmsmmmmm", 0, 8)]
LETTER = {7: "m", 2: "d", 1: "i", 8: "s"}


def test_glocal_golden():
    got = kernels.glocal([g[0].encode() for g in GOLDEN], [g[1].encode() for g in GOLDEN])
    for k, (_, _, ops, start, end) in enumerate(GOLDEN):
        assert ("".join(LETTER[o] for o in got.ops[k].tolist()), got.query_start[k], got.query_end[k]) == (ops, start, end)


def reads_back(ops, query, ref, at, to):
    """Follows operations from (at, to); every = and X must tell the truth. Returns where it ends."""
    for op in ops:
        if op in (7, 8):
            assert (query[at] == ref[to]) == (op == 7)
        at, to = at + (op != 2), to + (op != 1)
    return at, to


@functools.cache
def least_edits(a, b):
    """Over all ways to turn a into b with single edits."""
    if not a or not b:
        return len(a) + len(b)
    return min(least_edits(a[1:], b[1:]) + (a[0] != b[0]), least_edits(a[1:], b) + 1, least_edits(a, b[1:]) + 1)


@functools.cache
def best_score(a, b):
    """Over all alignments of all of a with all of b: 3 for a match, -1 for a mismatch, -2 for a base in a gap."""
    if not a or not b:
        return -2 * (len(a) + len(b))
    return max(best_score(a[1:], b[1:]) + (3 if a[0] == b[0] else -1), best_score(a[1:], b) - 2, best_score(a, b[1:]) - 2)


def pieces(text):
    return {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}


def short_pairs(seed, n, longest):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("ACG", k=rng.randint(1, longest)))
    return [(word(), word()) for _ in range(n)]


def test_glocal_is_cheapest_for_its_end_with_even_gaps():
    pairs = short_pairs(3, 300, 6)
    got = kernels.glocal([a.encode() for a, _ in pairs], [b.encode() for _, b in pairs], 1.0, 1.0)
    for k, (q, t) in enumerate(pairs):
        ops, start, end = got.ops[k].tolist(), int(got.query_start[k]), int(got.query_end[k])
        assert reads_back(ops, q, t, start, 0) == (end, len(t))
        assert sum(o != 7 for o in ops) == min(least_edits(q[s:end], t) for s in range(end + 1))
        assert got.matches[k] == ops.count(7)


def test_local_is_best_with_even_gaps():
    pairs = short_pairs(5, 200, 6)
    got = kernels.local([a.encode() for a, _ in pairs], [b.encode() for _, b in pairs], -2.0, -2.0, 3.0, -1.0)
    for k, (q, t) in enumerate(pairs):
        ops = got.ops[k].tolist()
        assert reads_back(ops, q, t, int(got.query_start[k]), int(got.ref_start[k])) == (got.query_end[k], got.ref_end[k])
        assert sum({7: 3, 8: -1}.get(o, -2) for o in ops) == max([0, *(best_score(a, b) for a in pieces(q) for b in pieces(t))])
        assert got.matches[k] == ops.count(7)


def test_kernels_prefer_one_long_gap_and_find_exact_copies():
    ref = "ACGTAACCGGTTACGTCAGTCAAGGT"
    cut, grown = ref[:6] + ref[10:], ref[:13] + "CCCCC" + ref[13:]
    queries = [f"TTGA{x}CATT" for x in (ref, cut, grown)]
    want = [[7] * 26, [7] * 6 + [2] * 4 + [7] * 16, [7] * 13 + [1] * 5 + [7] * 13]
    g = kernels.glocal([q.encode() for q in queries], [ref.encode()] * 3)
    l1 = kernels.local([q.encode() for q in queries], [ref.encode()] * 3, mismatch=-4.0)
    for k in range(3):
        lengths = lambda ops: [(o, sum(1 for _ in run)) for o, run in itertools.groupby(ops)]
        for got in (g, l1):  # a gap may lie a base to the side where bases repeat
            assert [o for o, _ in lengths(got.ops[k].tolist())] == [o for o, _ in lengths(want[k])]
            assert (got.query_start[k], got.query_end[k], got.matches[k]) == (4, len(queries[k]) - 4, want[k].count(7))


def test_kernels_do_not_depend_on_the_batch():
    pairs = short_pairs(9, 60, 40)
    q, t = [a.encode() for a, _ in pairs], [b.encode() for _, b in pairs]
    for kernel in (kernels.glocal, kernels.local):
        whole = kernel(q, t)
        for k in range(0, 60, 7):
            one = kernel(q[k : k + 1], t[k : k + 1])
            same = [(getattr(one, f)[0] == getattr(whole, f)[k]) for f in ("query_start", "query_end", "ref_start", "ref_end", "matches")]
            assert all(same) and one.ops[0].tolist() == whole.ops[k].tolist()


@pytest.mark.parametrize("kernel", [kernels.glocal, kernels.local])
def test_kernels_do_not_depend_on_what_they_keep(kernel, monkeypatch):
    for seed, longest in ((11, 30), (12, 90)):
        pairs = short_pairs(seed, 40, longest)
        q, t = [a.encode() for a, _ in pairs], [b.encode() for _, b in pairs]
        whole = kernel(q, t)
        for size in (1, 2, 7):
            with monkeypatch.context() as m:
                m.setattr(kernels, "KEEP", 1)
                m.setattr(kernels._Blocks, "__init__", with_blocks_of(kernels._Blocks.__init__, size))
                cut = kernel(q, t)
            assert [x.tolist() for x in cut.ops] == [x.tolist() for x in whole.ops]
            assert all((getattr(cut, f) == getattr(whole, f)).all() for f in ("query_start", "query_end", "ref_start", "ref_end", "matches"))


def with_blocks_of(init, size):
    def made(self, *args):
        init(self, *args)
        self.size, self.moves = size, self.moves[:1].repeat(size, 0)

    return made


@pytest.mark.parametrize("kernel,n", [(kernels.glocal, 20_000), (kernels.local, 8_000)])
def test_long_reads_in_bounded_memory(kernel, n):
    """20,000 letters on 20,000: 800 MB if every operation were kept."""
    rng = random.Random(6)
    ref = "".join(rng.choices("ACGT", k=n))
    x, y, z = n // 4, n // 2, 3 * n // 4
    read = ref[:x] + "ACGTACGTAC" + ref[x:y] + ref[y + 30 : z] + {"A": "C"}.get(ref[z], "A") + ref[z + 1 :]
    tracemalloc.start()
    try:
        got = kernel([read.encode()], [ref.encode()])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < min(200e6, 1.7 * n * n)  # all operations: 2 n n bytes
    ops, end = got.ops[0].tolist(), int(got.query_end[0])
    assert reads_back(ops, read, ref, int(got.query_start[0]), int(got.ref_start[0])) == (end, n) and got.ref_start[0] == 0
    if kernel is kernels.local:  # a glocal end is chosen by cost over length, so it may leave out some of the read
        assert (end, ops.count(1), ops.count(2)) == (n - 20, 10, 30) and ops.count(8) < 10
    assert got.matches[0] == ops.count(7) > n - 100


def test_aligned_operation_is_told_by_bases(spark):
    lines = ["r1\t0\tx\t1\t60\t30M\t*\t0\t0\t" + "A" * 30 + "\t*", "r2\t0\tx\t1\t60\t30=\t*\t0\t0\t" + "A" * 30 + "\t*", "r3\t0\tx\t3\t60\t2S20M1D6M\t*\t0\t0\t" + "A" * 12 + "C" * 8 + "A" * 8 + "\t*"]
    rows = src.parse_sam(spark.createDataFrame([(x,) for x in lines], "value string")).withColumn("ref_idx", F.lit(0))
    refs = spark.createDataFrame([(0, "x", "A" * 40, 40)], "ref_idx int, ref_name string, seq string, len int")
    got = {r.read_id: r for r in tracks.read_stats(rows, refs, three=0).collect()}
    assert (got["r1"].status, got["r1"].identity, got["r1"].length) == (got["r2"].status, got["r2"].identity, got["r2"].length) == ("pass", 1.0, 30)
    assert (got["r3"].matches, got["r3"].mismatches, got["r3"].deletions, got["r3"].length) == (18, 8, 1, 27)
    cigars = {r.read_id: [tuple(e) for e in r.cigar] for r in tracks.resolve_matches(rows, refs).collect()}
    assert cigars == {"r1": [(7, 30)], "r2": [(7, 30)], "r3": [(4, 2), (7, 10), (8, 8), (7, 2), (2, 1), (7, 6)]}
    trimmed = {r.read_id: [tuple(e) for e in r.c] for r in rows.select("read_id", cg.trim_to_matches("cigar")["cigar"].alias("c")).collect()}
    assert trimmed["r1"] == [(0, 30)] and trimmed["r3"] == [(4, 2), (0, 20), (2, 1), (0, 6)]
    with pytest.raises(Exception, match="M is not resolved"):
        tracks.tracks(rows, F.lit(0), F.lit(40)).collect()


def sam(spark, *records):
    """Rows of (name, flag, 1-based pos, CIGAR, seq)."""
    lines = [(f"{n}\t{flag}\tx\t{pos}\t60\t{c}\t*\t0\t0\t{seq}\t*",) for n, flag, pos, c, seq in records]
    return src.parse_sam(spark.createDataFrame(lines, "value string")).withColumn("ref_idx", F.lit(0))


def test_hard_clips_padding_and_skips_do_not_end_a_job(spark):
    """One clean read, one supplementary with hard clips: both have identity 1."""
    rows = sam(spark, ("r1", 0, 1, "30M", "A" * 30), ("r2", 2048, 1, "4H30M", "A" * 30), ("r3", 0, 1, "2H3S10M2P10M5N10M1H", "C" * 3 + "A" * 30), ("r4", 4, 0, "*", "A" * 30))
    refs = spark.createDataFrame([(0, "x", "A" * 40, 40)], "ref_idx int, ref_name string, seq string, len int")
    kept = {r.read_id: r for r in tracks.read_stats(rows, refs, keep_secondary=True).collect()}
    assert {n: (r.status, r.identity, r.length, r.deletions) for n, r in kept.items() if n != "r4"} == {"r1": ("pass", 1.0, 30, 0), "r2": ("pass", 1.0, 30, 0), "r3": ("pass", 1.0, 30, 0)}
    assert {r.read_id for r in tracks.read_stats(rows, refs).collect()} == {"r1", "r3", "r4"} and kept["r4"].status == "unmapped"
    told = {r.read_id: [tuple(e) for e in r.cigar] for r in tracks.resolve_matches(rows, refs).collect()}
    assert told["r2"] == [(5, 4), (7, 30)] and told["r3"] == [(5, 2), (4, 3), (7, 10), (6, 2), (7, 10), (3, 5), (7, 10), (5, 1)]
    pairs = [(r.op, r.query_pos, r.ref_pos) for r in tracks.aligned_pairs(tracks.resolve_matches(rows, refs)).where("read_id = 'r3'").orderBy("k", "j").collect()]
    assert pairs == [(4, i, -1) for i in range(3)] + [(7, 3 + i, i) for i in range(20)] + [(3, -1, 20 + i) for i in range(5)] + [(7, 23 + i, 25 + i) for i in range(10)]
    places = tracks.tracks(tracks.resolve_matches(rows, refs).where("read_id = 'r3'"), F.lit(0), F.lit(40)).orderBy("position").collect()
    assert [r.position for r in places] == [*range(20), *range(25, 35)] and all((r.match, r.ins, r.cov, getattr(r, "del")) == (1, 0, 1, 0) for r in places)


def test_operations_without_bases_in_trimming_and_checks(spark):
    rows = spark.createDataFrame([(parse("3H2S1X9=4N5=2P6=1D2S1H"),), (parse("5H"),)], f"cigar {CIGAR}")
    m, w, ok, identity, shifts = rows.select(cg.trim_to_matches("cigar"), cg.trim_to_window("cigar"), cg.is_consistent("cigar", F.lit(25)), cg.identity("cigar"), cg.clip_shifts("cigar", cg.trim_to_matches("cigar")["cigar"])).first()
    assert ([tuple(e) for e in m.cigar], m.shift, m.removed) == (parse("3S9=4N11=2S"), 1, 2)
    assert ([tuple(e) for e in w.cigar], w.shift, w.removed) == (parse("3S9=4N11=1D2S"), 1, 1)
    assert ok and identity == 20 / 22 and tuple(shifts) == (0, 1)
    assert rows.where(F.size("cigar") == 1).select(cg.trim_to_window("cigar")["cigar"], cg.trim_to_matches("cigar")["cigar"]).first() == ([], [])


def test_skips_and_hard_clips_go_through_sam_text(spark):
    rows = sam(spark, ("r", 0, 3, "3H2S10=4N5=2P6=1H", "A" * 23)).withColumn("ref_name", F.lit("x"))
    back = src.parse_sam(src.to_sam(rows))
    assert back.select("cigar").first() == rows.select("cigar").first()


def test_annotation_runs_match_base_by_base(spark):
    """Labels by walking single bases, runs by counting single samples."""
    rng = random.Random(4)
    rows = []
    for k in range(60):
        ops = [(rng.choice([4, 1]), rng.randint(0, 3))] if k % 3 else []
        for _ in range(rng.randint(1, 6)):
            ops += [(rng.choice([7, 7, 8]), rng.randint(1, 12)), (rng.choice([1, 2]), rng.randint(0, 4))]
        ops = [(o, n) for o, n in [*ops, (7, rng.randint(1, 5)), (4, rng.randint(0, 3))] if n]
        bases = sum(n for o, n in ops if o != 2)
        mv = [rng.choice([3, 5])]
        for _ in range(bases):
            mv += [1] + [0] * rng.randint(0, 2)
        pos = rng.randint(0, 12)
        rows.append((f"r{k}", pos, pos + sum(n for o, n in ops if o in (2, 7, 8)), 40, 9, ops, mv, rng.randint(0, 9)))
    frame = spark.createDataFrame(rows, f"read_id string, pos int, ref_end int, ref_len int, class_code int, cigar {CIGAR}, mv array<int>, ts int")
    lead, tail = 8, 10
    runs = {r.read_id: [tuple(x) for x in r.rle] for r in frame.select("read_id", annotate.signal_runs(annotate.label_stretches(lead, tail)).alias("rle")).collect()}
    flat = {}
    for r in annotate.base_labels(frame, lead, tail).collect():
        flat.setdefault(r.read_id, {})[r.query_pos] = r.label
    for name, pos, ref_end, ref_len, code, ops, mv, ts in rows:
        labels, at, before, seen, past = [], pos, None, False, False
        for op, n in ops:
            for _ in range(n):
                if op in (7, 8):
                    before, seen, past = at, seen or at == pos, past or at >= ref_end - 1
                    labels.append(2 if at < lead else 1 if past or at > ref_len - tail else code)
                elif op != 2:
                    labels.append(2 if not seen else 1 if past else 2 if before < lead else 1 if before > ref_len - tail else code)
                at += op in (2, 7, 8)
        assert [flat[name][i] for i in range(len(labels))] == labels
        starts = [i * mv[0] + ts - mv[0] for i, v in enumerate(mv) if i and v == 1]
        samples, end = [0] * starts[0], ts + (len(mv) - 1) * mv[0]
        for label, a, z in zip(labels[::-1], starts, [*starts[1:], end]):
            samples += [label] * (z - a)
        assert runs[name] == [(x, sum(1 for _ in g)) for x, g in itertools.groupby(samples)]


def test_sinks_and_lookups(spark, tmp_path):
    numbers = spark.createDataFrame([(1234567.891, 2, "x"), (None, 3, None)], "v double, n int, t string")
    src.write_report(numbers, f"{tmp_path}/report", 4)
    back = spark.read.option("sep", "\t").option("header", "true").csv(f"{tmp_path}/report")
    assert {tuple(r) for r in back.collect()} == {("1234567.8910", "2", "x"), (None, "3", None)}
    ids = spark.range(1000).selectExpr("cast(id as string) read_id", "id")
    shards = src.with_shards(ids.repartition(7), "id", 100).collect()
    assert all(r.shard == r.id // 100 for r in shards)
    src.write_sharded(ids, f"{tmp_path}/shards", 90)
    held = src.with_file(src.scan(spark, f"{tmp_path}/shards"))
    assert held.groupBy("file").count().agg(F.max("count")).first()[0] <= 90
    found = src.select_reads(held, ids.where("id in (3, 700)"))
    assert {r.read_id for r in found.collect()} == {"3", "700"} and found.where("file like 'part-%'").count() == 2
    compare.require_all(ids.where("id < 5"), ids)
    with pytest.raises(ValueError, match="2000"):
        compare.require_all(ids.selectExpr("'2000' as read_id"), ids)
    pairs = spark.createDataFrame([("a", "x", "y", "both"), ("b", "x", "x", "both"), ("c", "x", "Unmapped", "only_a")], "read_id string, label_a string, label_b string, membership string")
    wide = [r.asDict() for r in compare.crosstab_wide(pairs, ["x", "y", "Unmapped", "z"]).collect()]
    assert wide == [{"label_a": "x", "x": 1, "y": 1, "Unmapped": 1, "z": 0}]


def test_align_job_outputs_fit_their_reads(spark):
    from strandlake.plans import jobs

    r = jobs.reads(spark, "/root/testdata/sf0.001")
    done = align.align_reads(r.drop("region", "top3"), r.select("read_id", "top3", "region"), jobs.refs(spark, "/root/testdata/sf0.001"))
    rows = align.with_read_columns(done, r).collect()
    primary = [x for x in rows if not x.flag & 256]
    assert len(primary) == len({x.read_id for x in primary}) > 0
    assert all(0 <= x.identity <= 1 and x.matches >= 25 for x in rows if x.mapped)
    truth = {x.read_id: x.truth for x in r.collect()}
    mapped = [x for x in primary if x.mapped]
    assert sum(x.ref_idx == truth[x.read_id] for x in mapped) >= 0.95 * len(mapped) > 0.9 * len(primary) * 0.95


def test_best_of_two_follows_its_rule(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(120):
        pair = []
        for rank in (1, 2)[: 1 + (k % 9 > 0)]:
            mapped = rng.random() < 0.7
            pair.append((f"r{k}", rank, 10 * k + rank, mapped, 5 if mapped else None, parse("30=") if mapped else None, 0, False, rng.choice([0.8, 0.9, 0.9005, 0.95]) if mapped else None, rng.choice([20, 25, 40]) if mapped else None))
        rows += pair
        one, two = pair[0], pair[1] if len(pair) > 1 else None
        swap = bool(two and two[3] and (not one[3] or (two[9] >= 25 and (one[9] < 25 or two[8] > one[8] + 0.001))))
        order = [two, one] if swap else [one, *([two] if two else [])]
        for place, x in enumerate(order):
            flag = 4 if not x[3] else 256 if place else 0
            want[x[2]] = (place + 1, 0 if place else 60, flag, swap and place == 0)
    frame = spark.createDataFrame(rows, f"read_id string, rank int, ref_idx int, mapped boolean, pos int, cigar {CIGAR}, ed int, fragment boolean, identity double, matches int")
    assert {r.ref_idx: (r["rank"], r.mapq, r.flag, r.swapped) for r in align.best_of_two(frame).collect()} == want


def test_rescue_takes_the_candidate_that_fits(spark):
    rng = random.Random(12)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    rows, want = [], {}
    for k in range(20):
        refs = [dna(80) for _ in range(3)]
        true = k % 4  # 3: none of them
        body = list(refs[true]) if true < 3 else list(dna(80))
        body[40] = "ACGT"[("ACGT".index(body[40]) + 1) % 4]
        rows += [(f"r{k}", rank + 1, rank, dna(15) + "".join(body) + dna(9), refs[rank]) for rank in range(3)]
        if true < 3:
            want[f"r{k}"] = (true, 3 - true, true)
    frame = spark.createDataFrame(rows, "read_id string, rank int, ref_idx int, seq string, ref_seq string")
    params = align.Parameters(local_mismatch=-1.0)
    found = align.rescue(frame, params).collect()
    assert {r.read_id: (r.ref_idx, r.mapq, r.rescue_rank) for r in found} == want
    lengths = {r: len(q) for r, _, _, q, _ in rows}
    assert all(sum(n for o, n in r.cigar if o != 2) == lengths[r.read_id] and r.identity > 0.9 and r.matches >= 70 for r in found)


def test_sorted_sink_is_in_order_over_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(5), rng.randrange(40)) for _ in range(500)]
    out = align.sorted_for_output(spark.createDataFrame(rows, "ref_idx int, pos int").repartition(6))
    parts = {}
    for r in out.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect():
        parts.setdefault(r.part, []).append((r.ref_idx, r.pos))
    assert [x for k in sorted(parts) for x in parts[k]] == sorted(rows)


def test_variants(spark):
    reads = spark.createDataFrame([("a", "f", "ACGT"), ("b", "f", "AAAA"), ("c", "f", "ACGA")], "read_id string, family string, seq string")
    variants = spark.createDataFrame([("f", "x", "ACGT"), ("f", "y", "TCGA")], "family string, variant string, seq string")
    got = {r.read_id: (r.variant, r.dist) for r in annotate.nearest_variant(reads, variants).collect()}
    assert got == {"a": ("x", 0)}  # b and c tie
