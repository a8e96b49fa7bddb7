"""Archives: merging with metadata, point look-ups, interval scans, shards over micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import compare
from strandlake.sources import tables as src
from strandlake.streaming import reads as stream

META = "run_id string, model_name string, model_type string, chunk_size int, float_dtype string, pod5_paths array<string>, num_reads_processed bigint"


def test_merged_archives_keep_first_records_and_all_paths(spark):
    records = lambda *rows: spark.createDataFrame(rows, "read_id string, label string")
    meta = lambda *row: spark.createDataFrame([row], META)
    a = records(("1", "x"), ("2", "y")), meta("ra", "m", "t", 54, "float16", ["p1", "p2"], 2)
    b = records(("2", "z"), ("3", "z")), meta("rb", "m", "t", 54, "float32", ["p2", "p3"], 2)
    c = records(("3", "w"), ("4", "w")), meta("rc", "m", "t", 54, "float16", None, 2)
    merged, told = compare.merge_archives(a, b, c)
    assert sorted(map(tuple, merged.select("read_id", "label", "run_id").collect())) == [("1", "x", "ra"), ("2", "y", "ra"), ("3", "z", "rb"), ("4", "w", "rc")]
    one = told.first()
    assert (one.pod5_paths, one.num_reads_processed, one.run_id, one.float_dtype) == (["p1", "p2", "p3"], 6, "ra", "float16")
    for field, other in (("model_name", ("rb", "other", "t", 54)), ("chunk_size", ("rb", "m", "t", 60))):
        with pytest.raises(ValueError, match=field):
            compare.merge_archives(a, (b[0], meta(*other, "float32", [], 2)))


def scanned(df):
    """Rows and files that the scans of an executed frame gave out."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        metrics = [leaves.apply(i).metrics() for i in range(leaves.size())]
        metrics = [m for m in metrics if m.contains("numFiles")]  # not those of a table without rows
        return rows, sum(m.apply("numOutputRows").value() for m in metrics), sum(m.apply("numFiles").value() for m in metrics)
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")


def test_look_up_reads_few_row_groups(spark, tmp_path):
    """Ten ids of 40,000: under a tenth of the rows leave the scan, and every record is found."""
    frame = spark.range(40_000).select(F.sha1(F.col("id").cast("string")).alias("read_id"), "id")
    src.write_indexed(frame, f"{tmp_path}/a", row_group_bytes=1 << 14, distinct=2000)
    ids = [r.read_id for r in frame.where("id % 4000 = 7").collect()]
    rows, given, _ = scanned(src.look_up(spark, f"{tmp_path}/a", ids))
    assert sorted(r.id for r in rows) == list(range(7, 40_000, 4000)) and len(ids) == 10 and given < 4000
    many = [r.read_id for r in frame.where("id % 1000 = 7").collect()]
    rows, given, _ = scanned(src.look_up(spark, f"{tmp_path}/a", [*many, "not there"]))
    assert len(rows) == 40 and given < 40_000
    assert scanned(src.look_up(spark, f"{tmp_path}/a", []))[0] == []


def test_interval_scan_opens_overlapping_files_only(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"r{i}", rng.choice([0, 1, 1, 1]), p := rng.randrange(5000), p + rng.choice([1, 30, 400])) for i in range(3000)]
    rows += [("edge", 1, 990, 1000), ("in", 1, 999, 1001), ("long", 1, 0, 5000), ("unmapped", None, None, None)]
    frame = spark.createDataFrame(rows, "read_id string, ref_idx int, pos int, ref_end int").repartition(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the small shuffle becomes one file
    try:
        src.write_coordinate_sorted(frame, f"{tmp_path}/a", 100)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    files = spark.read.parquet(f"{tmp_path}/a/alignments").select("read_id", "ref_idx").distinct().select(F.input_file_name()).distinct().count()
    for ref, start, end in ((1, 1000, 1010), (1, 0, 1), (0, 4990, 5000), (1, 0, 6000), (7, 0, 10)):
        got, _, opened = scanned(src.read_interval(spark, f"{tmp_path}/a", ref, start, end))
        assert {r.read_id for r in got} == {n for n, r, p, e in rows if r == ref and p < end and e > start}
        if end - start <= 10:
            assert opened < max(4, files)
    assert src.read_interval(spark, f"{tmp_path}/a", 1, 1000, 1010).where("read_id = 'edge'").count() == 0
    written = spark.read.parquet(f"{tmp_path}/a/alignments").withColumn("f", F.col("_metadata.file_name")).groupBy("f").agg(F.min(F.struct("ref_idx", "pos")).alias("a"), F.max(F.struct("ref_idx", "pos")).alias("z")).where("a.ref_idx is not null").orderBy("f").collect()
    assert all(x.z <= y.a for x, y in zip(written, written[1:]))


def test_shards_hold_exactly_n_over_batches_and_a_restart(spark, tmp_path):
    schema, n = "read_id bigint, label string", 7

    def arrive(first, sizes):
        for k, size in enumerate(sizes):
            rows = [(1000 * (first + k) + i, "x") for i in range(size)]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        arriving = stream.arriving(spark, f"{tmp_path}/in", schema, 1)
        stream.write_exact_shards(arriving, f"{tmp_path}/out", f"{tmp_path}/state", n, "read_id").awaitTermination()
        return stream.read_shards(spark, f"{tmp_path}/out", schema)

    sizes = [3, 1, 2, 20, 5, 1, 4]
    arrive(0, sizes[:4])
    assert run().count() == 26
    arrive(4, sizes[4:])
    found = run()
    counts = [r["count"] for r in found.groupBy("shard").count().orderBy("shard").collect()]
    assert counts == [7] * 5 + [1]
    assert sorted(r.read_id for r in found.collect()) == [1000 * k + i for k, size in enumerate(sizes) for i in range(size)]
