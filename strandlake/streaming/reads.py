"""Structured Streaming over arriving reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import arrays as ar
from ..session import stored
from ..sources.tables import with_shards


def arriving(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def preprocess(signals: DataFrame, stride: int = 54, max_tokens: int = 1200) -> DataFrame:
    """Whole chunks, standardized; stateless, the same for batch and stream."""
    cut = ar.whole_chunks("signal", stride, max_tokens)
    return signals.select("read_id", ar.standardize(cut).alias("signal"), ar.token_count("signal", stride, max_tokens).alias("n_tokens"))


def decode(scores: DataFrame) -> DataFrame:
    """Scores to calls."""
    return ar.compress(scores)


def one_result_per_read(results: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """R2: the first result of a read id; state is kept for the delay."""
    return results.withWatermark(time, delay).dropDuplicatesWithinWatermark(["read_id"])


def class_counts(calls: DataFrame, label: str = "label") -> DataFrame:
    """Running counts, for update or complete mode."""
    return calls.groupBy(label).agg(F.count("*").alias("reads"))


def write_shards(results: DataFrame, path: str, checkpoint: str, records: int, available_now: bool = True) -> StreamingQuery:
    """Files of at most so many records as results arrive, in a folder per batch so that a replayed batch
    replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("maxRecordsPerFile", records).parquet(f"{path}/batch={number}")

    writer = results.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_exact_shards(results: DataFrame, path: str, checkpoint: str, records: int, order: str, available_now: bool = True) -> StreamingQuery:
    """Shards of exactly so many records over all micro-batches. Each batch adds to the open shard that the one before
    left, writes the shards that are full, in its own order, and leaves the rest as the open shard. Everything a batch
    writes is in folders of its number, so a replayed batch, also after a restart, replaces itself."""
    spark = results.sparkSession

    def sink(batch: DataFrame, number: int) -> None:
        first = 0
        if number:
            first = spark.read.parquet(f"{path}/next/batch={number - 1}").first()["shard"]
            batch = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/open/batch={number - 1}"))
        numbered = stored(with_shards(batch, order, records))
        full = numbered.count() // records
        shards = numbered.where(F.col("shard") < full).withColumn("shard", (F.col("shard") + first).cast("long"))
        shards.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/full/batch={number}")
        numbered.where(F.col("shard") >= full).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/open/batch={number}")
        spark.range(1).select(F.lit(first + full).cast("long").alias("shard")).write.mode("overwrite").parquet(f"{path}/next/batch={number}")

    writer = results.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of write_exact_shards with their shard; what the last batch has left open is the last one."""
    last = spark.read.parquet(f"{path}/next").orderBy(F.desc("batch")).first()
    full = spark.read.option("basePath", f"{path}/full").schema(f"{schema}, batch int, shard long").parquet(f"{path}/full").drop("batch")
    rest = spark.read.schema(schema).parquet(f"{path}/open/batch={last['batch']}")
    return full.unionByName(rest.withColumn("shard", F.lit(last["shard"]).cast("long")))
