"""Scans and sinks (S1 to S15). Records live in Parquet; SAM, FASTA and JSON come as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..session import stored


def scan(spark: SparkSession, path: str | list[str], schema: str | None = None, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """Parquet files under one or more paths, with a declared schema and a file name pattern."""
    reader = spark.read
    if schema:
        reader = reader.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.parquet(*([path] if isinstance(path, str) else path))


def select_reads(reads: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted read ids."""
    return reads.join(wanted.select("read_id").distinct(), "read_id", "left_semi")


#: Ids of one pushed-down list: Parquet readers take longer lists as one range.
LIST_IDS = 10


def write_indexed(records: DataFrame, path: str, row_group_bytes: int = 1 << 20, distinct: int = 1_000_000, key: str = "read_id") -> None:
    """An archive for point look-ups: sorted by the key over all files, in small row groups, whose bounds and
    Bloom filters of the key tell which of them a look-up must read."""
    options = {"parquet.block.size": row_group_bytes, f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": distinct, "parquet.page.row.count.limit": 1000}
    records.repartitionByRange(key).sortWithinPartitions(key).write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def look_up(spark: SparkSession, path: str, ids: list, key: str = "read_id") -> DataFrame:
    """The records of some ids from an indexed archive, by lists that are pushed down to the files."""
    found = F.lit(False)
    for i in range(0, len(ids), LIST_IDS):
        found = found | F.col(key).isin(*ids[i : i + LIST_IDS])
    return spark.read.parquet(path).where(found)


def write_coordinate_sorted(aligned: DataFrame, path: str, bin_size: int = 1 << 14) -> None:
    """Alignments (ref_idx, pos, ref_end, ..) sorted by reference and position over all files, and beside them an
    index of the bins of positions that each file's alignments overlap. Unmapped rows (null ref_idx) come last."""
    aligned.repartitionByRange(F.col("ref_idx").asc_nulls_last(), "pos").sortWithinPartitions(F.col("ref_idx").asc_nulls_last(), "pos").write.parquet(f"{path}/alignments")
    written = aligned.sparkSession.read.parquet(f"{path}/alignments").where("ref_idx is not null").select("ref_idx", "pos", "ref_end", F.col("_metadata.file_path").alias("file"))
    first, last = (F.floor(c / F.lit(bin_size)) for c in (F.col("pos"), F.greatest(F.col("ref_end") - 1, "pos")))
    spans = written.groupBy("file", "ref_idx", first.alias("first"), last.alias("last")).agg(F.min("pos").alias("low"), F.max("ref_end").alias("high"))
    bins = spans.select("file", "ref_idx", "low", "high", F.explode(F.sequence("first", "last")).alias("bin"))
    bins.groupBy("ref_idx", "bin", "file").agg(F.min("low").alias("low"), F.max("high").alias("high")).repartitionByRange("ref_idx", "bin").sortWithinPartitions("ref_idx", "bin").withColumn("bin_size", F.lit(bin_size)).write.parquet(f"{path}/index")


def read_interval(spark: SparkSession, path: str, ref_idx: int, start: int, end: int) -> DataFrame:
    """Alignments that overlap [start, end) of a reference. Only files that the index names are opened; their
    names, at most one for each file that the interval meets, come to the driver."""
    index = spark.read.parquet(f"{path}/index").where(F.col("ref_idx") == ref_idx)
    bins = F.col("bin").between(F.floor(F.lit(start) / F.col("bin_size")), F.floor(F.lit(end - 1) / F.col("bin_size")))
    files = [r.file for r in index.where(bins & (F.col("low") < end) & (F.col("high") > start)).select("file").distinct().collect()]
    schema = spark.read.parquet(f"{path}/alignments").schema
    found = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return found.where((F.col("ref_idx") == ref_idx) & (F.col("pos") < end) & (F.col("ref_end") > start))


def with_file(df: DataFrame) -> DataFrame:
    """Adds the file of each row."""
    return df.withColumn("file", F.col("_metadata.file_name"))


def parse_sam(lines: DataFrame, value: str = "value") -> DataFrame:
    """SAM text to reads with tags; header lines are left out, unmapped records kept."""
    f = F.split(F.col(value), "\t")
    rows = lines.where(~F.startswith(F.col(value), F.lit("@"))).select(f.alias("f"))
    code = F.create_map(*(F.lit(x) for op, letter in enumerate(schemas.LETTERS) for x in (letter, op)))
    parts = F.regexp_extract_all(F.col("f")[5], F.lit(r"(\d+[MIDNSHP=X])"), 1)
    cigar = F.transform(parts, lambda p: F.struct(code[F.right(p, F.lit(1))].alias("op"), F.left(p, F.length(p) - 1).cast("int").alias("len")))
    tags = F.map_from_entries(F.transform(F.filter(F.slice(F.col("f"), 12, 1000), lambda t: F.length(t) >= 5), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 6, 1 << 30))))
    rows = rows.withColumn("tags", tags)
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    return rows.select(
        F.col("f")[0].alias("read_id"),
        F.col("f")[1].cast("int").alias("flag"),
        F.col("f")[2].alias("ref_name"),
        (F.col("f")[3].cast("int") - 1).alias("pos"),
        F.col("f")[4].cast("int").alias("mapq"),
        cigar.cast(schemas.CIGAR).alias("cigar"),
        F.col("f")[9].alias("seq"),
        F.col("f")[10].alias("qual"),
        F.transform(F.split(F.regexp_replace(tag("mv"), "^c,", ""), ","), lambda v: v.cast("int")).alias("mv"),
        tag("ts").cast("int").alias("ts"),
        tag("ns").cast("bigint").alias("ns"),
        tag("pi").isNotNull().alias("is_split"),
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(spark.read.text(path))


def to_sam(alignments: DataFrame) -> DataFrame:
    """SAM text of alignments, one value column."""
    letter = F.create_map(*(F.lit(x) for pair in enumerate(schemas.LETTERS) for x in pair))
    text = F.array_join(F.transform("cigar", lambda c: F.concat(c["len"].cast("string"), letter[c["op"]])), "")
    return alignments.select(F.concat_ws("\t", "read_id", F.col("flag").cast("string"), "ref_name", (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), F.when(F.size("cigar") > 0, text).otherwise("*"), F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*")).alias("value"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """ref_idx in order of files and of records in them, ref_name (to the first blank), seq, len; wrapped
    lines are joined. Pieces of files are numbered by running counts, records within their piece."""
    records = spark.read.option("lineSep", ">").text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    records = records.where(F.trim(F.col("value")) != "").withColumn("_at", F.monotonically_increasing_id())
    pieces = records.groupBy("_f", "_b").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per piece
    head, body = F.substring_index("value", "\n", 1), F.expr("substring(value, instr(value, '\n') + 1)")
    rows = records.select("_f", "_b", "_at", F.regexp_extract(F.trim(head), r"^\S*", 0).alias("ref_name"), F.regexp_replace(body, r"\s", "").alias("seq"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_at"))).join(pieces.withColumn("_before", before), ["_f", "_b"])
    return rows.select((F.col("_before") + F.col("_n") - 1).cast("int").alias("ref_idx"), "ref_name", "seq", F.length("seq").alias("len"))


def union_results(scores: DataFrame, calls: DataFrame) -> DataFrame:
    """Full and summary records in one frame, told apart by kind (0 full, 1 summary)."""
    return scores.withColumn("kind", F.lit(0)).unionByName(calls.withColumn("kind", F.lit(1)), allowMissingColumns=True)


#: Fixed names that must agree between archives, and legacy names with their present ones.
MUST_AGREE = ("model_name", "model_type", "chunk_size")
RENAMED = {"num_classes": "num_classification_classes", "num_classes_seq2seq": "num_segmentation_classes"}


def present_names(metadata: DataFrame) -> DataFrame:
    for old, new in RENAMED.items():
        if old in metadata.columns:
            metadata = metadata.withColumn(new, F.coalesce(*([new] if new in metadata.columns else []), old)).drop(old)
    return metadata


def check_metadata(metadata: DataFrame) -> DataFrame:
    """One row of how many values each must-agree field and float_dtype have."""
    return present_names(metadata).agg(*(F.count_distinct(c).alias(c) for c in (*MUST_AGREE, "float_dtype")))


def require_compatible(metadata: DataFrame) -> DataFrame:
    """Raises if archives of different models or chunk sizes meet; returns the metadata."""
    found = check_metadata(metadata).first()
    if bad := [c for c in MUST_AGREE if found[c] > 1]:
        raise ValueError(f"archives differ in {', '.join(bad)}")
    return present_names(metadata)


def archive_summary(records: DataFrame, file: str | Column = "file") -> DataFrame:
    """Records per file, and in total (file null)."""
    return records.rollup(F.col(file).alias("file") if isinstance(file, str) else file.alias("file")).agg(F.count("*").alias("records"))


def write_sharded(df: DataFrame, path: str, records: int) -> None:
    """Files of at most so many records."""
    df.write.option("maxRecordsPerFile", records).parquet(path)


def with_shards(df: DataFrame, order: str, records: int) -> DataFrame:
    """Deterministic shard numbers by order. Rows are dealt out by ranges of the order, which are numbered by
    running sums, so no task sees all rows."""
    ranged = stored(df.repartitionByRange(order).withColumn("_b", F.spark_partition_id()))
    sums = ranged.groupBy("_b").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    n = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return ranged.withColumn("_n", n).join(sums.withColumn("_before", before), "_b").withColumn("shard", F.floor((F.col("_before") + F.col("_n") - 1) / records)).drop("_b", "_k", "_n", "_before")


def write_report(df: DataFrame, path: str, places: int = 6, sep: str = "\t") -> None:
    """Delimited text with rounded numbers, without thousands separators."""
    shown = lambda c, t: F.format_string(f"%.{places}f", F.col(c).cast("double")) if t in ("double", "float") or t.startswith("decimal") else F.col(c)
    df.select(*(F.when(F.col(c).isNotNull(), shown(c, t)).alias(c) for c, t in df.dtypes)).write.option("sep", sep).option("header", "true").csv(path)


def write_annotations(codes: DataFrame, annotations: DataFrame, path: str) -> None:
    """The table of class codes and the run lengths of each read."""
    codes.write.parquet(f"{path}/annotation_codes")
    annotations.write.parquet(f"{path}/annotations")


def label_map(lines: DataFrame, value: str = "value") -> DataFrame:
    """A JSON object of names to rows (ref_name, label)."""
    return lines.select(F.explode(F.from_json(value, "map<string, string>")).alias("ref_name", "label"))


def label_order(lines: DataFrame, value: str = "value") -> DataFrame:
    """A JSON list to rows (label, ord)."""
    return lines.select(F.posexplode(F.from_json(value, "array<string>")).alias("ord", "label")).select("label", "ord")
