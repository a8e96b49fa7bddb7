"""A shared folder for what a job writes between its steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir; a local one is set only where none is named and the
    session is local, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-work-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes a frame that several later steps read, and reads it again."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
