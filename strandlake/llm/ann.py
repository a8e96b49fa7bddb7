"""Approximate nearest neighbours by inner product, with learned partitions.

The number of parts grows with the square root of the rows up to MOST_PARTS, so that parts and the rows of one grow
alike, and larger parts beyond are cut into more blocks; one path serves every size. Fitting, on the driver, on a
sample of about `sample_rows` vectors or SAMPLE_PER_PART for each part, MOST_SAMPLE at most, with tables of sample by
parts made in blocks, so that its memory stops growing with the rows:
link each to its nearest, cut that graph into parts of equal size that few links cross, and train a small
network to name the parts in which a vector's neighbours lie. Indexing gives every row its most probable
part. A query goes to its most probable parts, as many as the sample needs for `target_recall`, and is
compared with all their vectors in double precision: first in its most probable part, whose k-th score is
a bound below which no vector of its other parts need be returned. Parts are split into blocks of bounded
size, and the queries of a part likewise, so no task holds more than one block of each.

Defined results: null vec_id, and vectors that are null, zero, hold null or non-finite values or have
another length than most, take no part; rows that share a vec_id are not candidates for each other;
ties go to the smaller vec_id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidy

BLOCK_ROWS, BLOCK_QUERIES = 16_384, 4_096
SAMPLE_PER_PART, MOST_PARTS, MOST_SAMPLE = 64, 1280, 40_960
#: Numbers of a block of a large table on the driver.
BLOCK_CELLS = 1 << 21


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)"
    )
    length = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return fine.where(F.size("v") == (length["d"] if length else 0))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product with each row, itself left out."""
    out = np.empty((len(x), k), dtype=np.int64)
    for rows in row_blocks(len(x), len(x)):
        s = x[rows] @ x.T
        s[np.arange(len(s)), rows] = -np.inf
        out[rows] = np.argpartition(-s, k, axis=1)[:, :k]
    return out


def row_blocks(rows: int, columns: int) -> list[np.ndarray]:
    """Row numbers in lots whose table of so many columns stays small."""
    step = max(1, BLOCK_CELLS // max(1, columns))
    return [np.arange(i, min(rows, i + step)) for i in range(0, rows, step)]


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, sweeps: int = 8) -> np.ndarray:
    """A part for each row, none above 1.1 times its share: grown around spread centres, then each row
    moves to the part of most of its neighbours while there is room."""
    n = len(x)
    centres = x[rng.choice(n, parts, replace=False)]
    blocks = row_blocks(n, parts)
    affinity = lambda rows: x[rows] @ centres.T - 0.5 * (centres**2).sum(1)
    for _ in range(10):
        near = np.concatenate([affinity(rows).argmax(1) for rows in blocks])
        centres = np.stack([x[near == p].mean(0) if (near == p).any() else x[rng.integers(n)] for p in range(parts)])
    room = int(np.ceil(1.1 * n / parts))
    part, size = np.full(n, -1), np.zeros(parts, dtype=np.int64)
    nearest_first = np.argsort(-np.concatenate([affinity(rows).max(1) for rows in blocks]), kind="stable")
    for rows in blocks:
        rows = nearest_first[rows]
        for i, choices in zip(rows, np.argsort(-affinity(rows), axis=1)):
            p = choices[np.argmax(size[choices] < room)]
            part[i], size[p] = p, size[p] + 1
    both = [list(row) for row in graph]
    for i, row in enumerate(graph):
        for j in row:
            both[j].append(i)
    for _ in range(sweeps):
        moved = 0
        for i in rng.permutation(n):
            links = np.bincount(part[both[i]], minlength=parts)
            best = int(links.argmax())
            if links[best] > links[part[i]] and size[best] < room:
                size[part[i]] -= 1
                size[best] += 1
                part[i], moved = best, moved + 1
        if not moved:
            break
    return part


class Router:
    """A network with one hidden layer from a vector to the parts of its neighbours."""

    def __init__(self, x: np.ndarray, wanted: np.ndarray, weights: np.ndarray, parts: int, rng: np.random.Generator, hidden: int = 128, epochs: int = 60):
        """wanted: for each row the parts that its weights go to."""
        d = x.shape[1]
        self.scale = float(np.sqrt((x**2).sum(1).mean())) or 1.0
        w = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        z = x / self.scale
        for epoch in range(epochs):
            rate = 4e-3 * (1 - epoch / epochs)
            for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
                a, y = z[rows] * d**0.5, np.zeros((len(rows), parts))
                np.add.at(y, (np.arange(len(rows))[:, None], wanted[rows]), weights)
                h = np.maximum(0, a @ w[0] + w[1])
                o = h @ w[2] + w[3]
                p = np.exp(o - o.max(1, keepdims=True))
                g = (p / p.sum(1, keepdims=True) - y) / len(rows)
                gh = (g @ w[2].T) * (h > 0)
                t += 1
                for k, grad in enumerate((a.T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.w = w

    def logits(self, x: np.ndarray) -> np.ndarray:
        a = x / self.scale * x.shape[1] ** 0.5
        return np.maximum(0, a @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]


def fit(sample: np.ndarray, parts: int, k: int, target_recall: float, seed: int = 5) -> tuple[Router, int]:
    """The router and how many parts to probe for target_recall, measured on a fifth of the sample that
    the router was not trained on."""
    rng = np.random.default_rng(seed)
    sample = sample[rng.permutation(len(sample))]
    links = min(max(k, 10), len(sample) - 1)
    graph = neighbour_graph(sample, links)
    part = balanced_parts(sample, graph[:, :10], parts, rng)
    wanted = np.concatenate([part[graph], part[:, None]], axis=1)
    test = len(sample) // 5
    router = Router(sample[test:], wanted[test:], np.array([1 / (2 * links)] * links + [0.5]), parts, rng)
    own = np.concatenate([router.logits(sample[rows]).argmax(1) for rows in row_blocks(len(sample), parts)])
    ranks = lambda rows: np.argsort(np.argsort(-router.logits(sample[rows]), axis=1), axis=1)
    need = np.concatenate([np.take_along_axis(ranks(rows), own[graph[rows]], axis=1) for rows in row_blocks(test, parts)])
    for probe in range(1, parts):
        if (need < probe).mean() >= target_recall:
            return router, probe
    return router, parts


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 1)


def part_count(rows: int, per_root: float = 8.0) -> int:
    """sqrt(rows) / per_root, from one to MOST_PARTS: 28 parts of 1,800 for 50,000 rows, 1,250 of 80,000 for 100 million."""
    return max(1, min(MOST_PARTS, round(rows**0.5 / per_root)))


def _compare(q: pa.Table, c: pa.Table, k: int) -> pa.Table:
    """The k nearest of a block of candidates to each query of a block, at or above the query's bound."""
    out = []
    if len(q) and len(c):
        ids, x = c.column("vec_id").to_numpy(), _matrix(c.column("v"))
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        asked, y, bounds = q.column("query_id").to_numpy(), _matrix(q.column("q")), q.column("bound").to_numpy()
        for i in range(0, len(y), 256):
            s = y[i : i + 256] @ x.T
            s[asked[i : i + 256, None] == ids] = -np.inf
            most = min(k, s.shape[1])
            least = np.maximum(-np.partition(-s, most - 1, axis=1)[:, most - 1], bounds[i : i + 256])
            # a hair below, as products summed in another order differ in their last bits
            a, b = np.nonzero((s >= (least - 1e-12 * np.abs(least))[:, None]) & (s > -np.inf))
            exact = (y[i + a] * x[b]).sum(1)
            best = np.lexsort((ids[b], -exact, a))
            a, b, exact = a[best], b[best], exact[best]
            few = np.arange(len(a)) - np.searchsorted(a, a) < k
            out.append(pa.table({"query_id": asked[i + a[few]], "vec_id": ids[b[few]], "score": exact[few]}))
    return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def search(vectors: DataFrame, is_query, k: int = 20, sample_rows: int = 8192, target_recall: float = 0.95, per_root: float = 8.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query holds."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors))
    n = rows.count()
    parts = part_count(n, per_root)
    wanted = min(MOST_SAMPLE, max(sample_rows, SAMPLE_PER_PART * parts))
    chosen = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit("ann"), "vec_id"), 2) <= F.lit(int(min(1.0, wanted / max(1, n)) * 2**62)))
    sample = chosen.toArrow().sort_by("vec_id")  # about `wanted` rows
    router, probe = fit(_matrix(sample.column("v")), parts, k, target_recall) if parts > 1 else (None, 1)  # one part needs no choice
    shared = spark.sparkContext.broadcast(router)  # a small network

    def ranked(x: np.ndarray) -> np.ndarray:
        return np.argsort(-shared.value.logits(x), axis=1, kind="stable") if shared.value else np.zeros((len(x), 1), np.int64)

    def assign(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranked(_matrix(batch.column(1)))[:, 0].astype(np.int32))], names=["vec_id", "v", "part"])

    index = materialize(rows.mapInArrow(tidy(assign), "vec_id long, v array<double>, part int"))
    held = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # a row per part
    sizes = np.array([held.get(p, 0) for p in range(parts)])

    def route(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            order = ranked(x)
            # at least `probe` parts, and more while they hold too few candidates
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            take = (np.arange(parts) < probe) | (before <= k)
            i, j = np.nonzero(take)
            # the first parts that hold more than k rows together give the bound of the others
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), pa.array(order[i, j].astype(np.int32)), pa.array(before[i, j] <= k)], names=["query_id", "q", "part", "early"])

    queries = materialize(rows.where(is_query).mapInArrow(tidy(route), "query_id long, q array<double>, part int, early boolean"))
    asked = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}  # a row per part
    rows_in = F.array(*(F.lit(-(-held.get(p, 0) // BLOCK_ROWS) or 1) for p in range(parts)))[F.col("part")]
    queries_in = F.array(*(F.lit(-(-asked.get(p, 0) // BLOCK_QUERIES) or 1) for p in range(parts)))[F.col("part")]
    blocks = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long")))
    cands = index.withColumn("cb", F.pmod(F.xxhash64("vec_id"), rows_in)).withColumn("qb", blocks(queries_in))
    key = ["part", "cb", "qb"]

    def compared(some: DataFrame) -> DataFrame:
        asks = some.withColumn("qb", F.pmod(F.xxhash64("query_id"), queries_in)).withColumn("cb", blocks(rows_in))
        return asks.groupBy(*key).cogroup(cands.groupBy(*key)).applyInArrow(lambda q, c: _compare(q, c, k), "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    early = materialize(best(compared(queries.where("early").withColumn("bound", F.lit(float("-inf"))))))
    bounds = early.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    late = queries.where("not early").join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    found = early.drop("rank").unionAll(compared(late).select("query_id", "vec_id", "score"))
    return best(found).select("query_id", "rank", "vec_id", "score")
