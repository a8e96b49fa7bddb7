"""Pluggable batch scoring of signals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import compress


def score_reads(signals: DataFrame, fn: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], batch_size: int = 1024, chunk_size: int = 54, save_raw: bool = True) -> DataFrame:
    """scores (or calls, without save_raw) from signals (read_id, signal).

    fn(padded, lengths) gets reads of like length, padded with zeros, and returns arrays `classification`
    (reads x classes), `segmentation` (reads x chunks x codes) and, at will, `fragmentation`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x or [] for x in batch.column(1).to_pylist()]
            order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
            names = ("classification", "segmentation", "fragmentation")
            out: dict[str, list] = {n: [None] * len(rows) for n in names}
            for a in range(0, len(order), batch_size):
                part = order[a : a + batch_size]
                lengths = np.array([len(rows[i]) for i in part])
                padded = np.zeros((len(part), max(1, lengths.max())), dtype=np.float32)
                for line, i in zip(padded, part):
                    line[: len(rows[i])] = rows[i]
                for name, values in fn(padded, lengths).items():
                    for k, i in enumerate(part):
                        v = values[k]
                        out[name][i] = v[: lengths[k] // chunk_size].tolist() if name == "segmentation" else v.tolist()
            kinds = (pa.list_(pa.float32()), pa.list_(pa.list_(pa.float32())), pa.list_(pa.float32()))
            chunks = pa.array([len(r) // chunk_size for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), chunks, pa.array([chunk_size] * len(rows), pa.int32()), *(pa.array(out[n], t) for n, t in zip(names, kinds))], names=["read_id", "num_chunks", "chunk_size", *names])

    schema = "read_id string, num_chunks int, chunk_size int, classification array<float>, segmentation array<array<float>>, fragmentation array<float>"
    scores = signals.select("read_id", F.col("signal").cast("array<float>").alias("signal")).mapInArrow(run, schema)
    return scores if save_raw else compress(scores)


def template_scores(signal: str | Column, templates: list[list[float]]) -> Column:
    """The built-in scorer: inner products of a signal with fixed templates, as an array."""
    x = F.col(signal) if isinstance(signal, str) else signal
    one = lambda t: F.aggregate(F.zip_with(x, F.array(*map(F.lit, t)), lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    return F.array(*map(one, templates))
