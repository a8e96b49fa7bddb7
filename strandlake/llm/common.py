"""Session helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this package: a word is a run of other characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SCRATCH: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    A local folder is set only where none is named and the session is local, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-shared-"))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what operators stored in the shared folder inside: for jobs whose result is
    written before the end of the block."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table that several later steps read to the shared folder, and reread it.

    This cuts the lineage as checkpoint() does, in Parquet, so a lost executor loses nothing."""
    path = path or shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: str | Column = "text") -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def free_column(df: DataFrame, name: str) -> str:
    """A name like the given one that clashes with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of rows with equal keys (integers without nulls)."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in keys], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and tuple(key[a]) != now:
                yield pa.Table.from_batches(held)
                held = []
            now = tuple(key[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]) -> object:
    """What tasks of one kernel build once in a worker (see tidy)."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def forget(but: str | None) -> None:
    """Drops what other kernels keep."""
    for key in [k for k in _KEPT if k != but]:
        del _KEPT[key]


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Wraps a batch function so that the worker, which Spark uses again, gives back its memory at the end. What
    is kept under the key `keeps` stays for the next task of the same kernel, until a task of another comes."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)  # a function of the module, as this one is sent with copies of what it names
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
