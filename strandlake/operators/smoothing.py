"""Constrained smoothing of chunk calls by the best allowed path through the segment codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Segment codes that may follow each code (0 read, 1 adapter, 2 and 3 splints).
ALLOWED = {0: (0, 3), 1: (1, 2), 2: (0, 2), 3: (3,)}
FORBIDDEN = -1e8


def transitions(allowed: dict[int, tuple[int, ...]] | None = None) -> np.ndarray:
    allowed = ALLOWED if allowed is None else allowed
    n = 1 + max(max(allowed), max((max(v) for v in allowed.values() if v), default=0))
    out = np.full((n, n), FORBIDDEN)
    for a, follow in allowed.items():
        out[a, list(follow)] = 0.0
    return out


def best_paths(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Paths of a batch: reads x chunks x codes, padded; the lower code wins a tie."""
    n, steps, k = emissions.shape
    score = emissions[:, 0].copy()
    back = np.zeros((n, steps, k), dtype=np.int8)
    for t in range(1, steps):
        reach = score[:, :, None] + moves[None]
        came = reach.argmax(1)
        new = np.take_along_axis(reach, came[:, None], 1)[:, 0] + emissions[:, t]
        live = (t < lengths)[:, None]
        score = np.where(live, new, score)
        back[:, t] = np.where(live, came, np.arange(k))
    path = np.zeros((n, steps), dtype=np.int32)
    at = score.argmax(1)
    for t in range(steps - 1, -1, -1):
        path[:, t] = at
        at = back[np.arange(n), t, at]
    return path


def smooth(scores: DataFrame, allowed: dict[int, tuple[int, ...]] | None = None) -> DataFrame:
    """read_id, num_chunks, chunk_size, smoothed. Null or empty scores give a null path."""
    moves = transitions(allowed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[] if r is None else r[:n] for r, n in zip(batch.column(3).to_pylist(), batch.column(1).to_pylist())]
            order = np.argsort([len(r) for r in rows], kind="stable")
            out: list = [None] * len(rows)
            for part in np.array_split(order, max(1, len(order) // 512)):  # of like length
                part = [i for i in part if rows[i]]
                if not part:
                    continue
                lengths = np.array([len(rows[i]) for i in part])
                e = np.zeros((len(part), lengths.max(), len(moves)))
                for k, i in enumerate(part):
                    e[k, : len(rows[i])] = rows[i]
                for k, (i, p) in enumerate(zip(part, best_paths(e, lengths, moves))):
                    out[i] = p[: lengths[k]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.int32()))], names=["read_id", "num_chunks", "chunk_size", "smoothed"])

    source = scores.select("read_id", "num_chunks", "chunk_size", F.col("segmentation").cast("array<array<double>>").alias("segmentation"))
    return source.mapInArrow(run, "read_id string, num_chunks int, chunk_size int, smoothed array<int>")
