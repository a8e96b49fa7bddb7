"""Array kernels on signals and scores, all in built-in higher-order functions (P1 to P5, P20, P25,
P26, D1 to D4, D6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def no_nan(x: Column) -> Column:
    return F.nanvl(x, F.lit(0.0))


def array_total(x: str | Column) -> Column:
    """Sum of a double array; NaN and null count as 0."""
    return F.aggregate(_c(x), F.lit(0.0), lambda acc, v: acc + F.coalesce(no_nan(v.cast("double")), F.lit(0.0)))


def standardize(x: str | Column) -> Column:
    """Z-score with mean and variance over all samples, NaN ones included in the count."""
    n = F.size(_c(x))
    mean = array_total(x) / n
    var = array_total(F.transform(_c(x), lambda v: v.cast("double") * v)) / n - mean * mean
    stat = F.array(F.struct(mean.alias("m"), F.sqrt(F.greatest(var, F.lit(0.0)) + 1e-8).alias("s")))
    return F.when(n > 0, F.flatten(F.transform(stat, lambda t: F.transform(_c(x), lambda v: no_nan((v - t["m"]) / t["s"])))))


def fit_standardizer(signals: DataFrame, x: str = "signal") -> DataFrame:
    """One row mean, std over all samples of all signals."""
    parts = signals.select(array_total(x).alias("s"), array_total(F.transform(_c(x), lambda v: v.cast("double") * v)).alias("q"), F.size(x).alias("n"))
    sums = parts.agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    mean = F.col("s") / F.col("n")
    return sums.select(mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)) + 1e-8).alias("std"))


def apply_standardizer(signals: DataFrame, fitted: DataFrame, x: str = "signal") -> DataFrame:
    joined = signals.crossJoin(F.broadcast(fitted))  # one row
    return joined.withColumn(x, F.transform(x, lambda v: no_nan((v - F.col("mean")) / F.col("std")))).drop("mean", "std")


def min_max(x: str | Column, scale: float = 2.0, offset: float = -1.0) -> Column:
    """P3 for one signal: the least sample becomes offset, the largest offset + scale (about)."""
    real = F.filter(_c(x), lambda v: ~F.isnan(v))
    stat = F.array(F.struct(F.array_min(real).cast("double").alias("lo"), F.array_max(real).cast("double").alias("hi")))

    def scaled(t: Column) -> Column:
        factor = F.lit(scale) / (t["hi"] - t["lo"] + 1e-8)
        return F.transform(_c(x), lambda v: no_nan(v * factor + (F.lit(offset) - t["lo"] * factor)))

    return F.flatten(F.transform(stat, scaled))


def fit_min_max(signals: DataFrame, x: str = "signal", scale: float = 2.0, offset: float = -1.0) -> DataFrame:
    """P3 for all signals: one row factor, shift."""
    real = F.filter(x, lambda v: ~F.isnan(v))
    lims = signals.agg(F.min(F.array_min(real)).cast("double").alias("lo"), F.max(F.array_max(real)).cast("double").alias("hi"))
    factor = F.lit(scale) / (F.col("hi") - F.col("lo") + 1e-8)
    return lims.select(factor.alias("factor"), (F.lit(offset) - F.col("lo") * factor).alias("shift"))


def apply_min_max(signals: DataFrame, fitted: DataFrame, x: str = "signal") -> DataFrame:
    joined = signals.crossJoin(F.broadcast(fitted))  # one row
    return joined.withColumn(x, F.transform(x, lambda v: no_nan(v * F.col("factor") + F.col("shift")))).drop("factor", "shift")


def whole_chunks(x: str | Column, stride: int, max_tokens: int) -> Column:
    """Cut to whole chunks, at most max_tokens of them."""
    return F.slice(_c(x), F.lit(1), F.least(F.floor(F.size(_c(x)) / stride), F.lit(max_tokens)).cast("int") * stride)


def token_count(x: str | Column, stride: int, max_tokens: int) -> Column:
    return F.least(F.floor(F.size(_c(x)) / stride), F.lit(max_tokens)).cast("int")


def chunked(x: str | Column, stride: int) -> Column:
    """P5: array of consecutive runs of stride samples; a rest is left out."""
    n = F.floor(F.size(_c(x)) / stride).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(_c(x), i * stride + 1, F.lit(stride)))).otherwise(F.array().cast("array<array<double>>"))


def softmax(x: str | Column) -> Column:
    """D1."""
    top = F.array_max(_c(x))
    e = F.transform(_c(x), lambda v: F.exp(v.cast("double") - top))
    return F.flatten(F.transform(F.array(array_total(e)), lambda t: F.transform(e, lambda v: v / t)))


def argmax(x: str | Column) -> Column:
    """Place (from 0) of the first largest value."""
    return (F.array_position(_c(x), F.array_max(_c(x))) - 1).cast("int")


def trimmed(segmentation: str | Column, num_chunks: str | Column) -> Column:
    return F.slice(_c(segmentation), F.lit(1), F.least(F.size(_c(segmentation)), _c(num_chunks)))


def chunk_softmax(segmentation: str | Column, num_chunks: str | Column) -> Column:
    return F.transform(trimmed(segmentation, num_chunks), softmax)


def chunk_argmax(segmentation: str | Column, num_chunks: str | Column) -> Column:
    return F.transform(trimmed(segmentation, num_chunks), argmax)


def top_k(x: str | Column, k: int = 3) -> Column:
    """D3: places of the k largest values, largest first; of equals the first place."""
    ranked = F.array_sort(F.transform(_c(x), lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda t: t["i"])


def class_span(preds: str | Column, chunk_size: str | Column, code: int = 0) -> Column:
    """struct(start, end) in samples from the first to the last chunk of the class; (-1, -1) without."""
    p, size = _c(preds), _c(chunk_size)
    first = F.array_position(p, code) - 1
    last = F.size(p) - F.array_position(F.reverse(p), code)
    return F.when(first >= 0, F.struct((first * size).cast("int").alias("start"), ((last + 1) * size - 1).cast("int").alias("end"))).otherwise(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end")))


def compress(scores: DataFrame) -> DataFrame:
    """Scores to calls."""
    region = class_span(chunk_argmax("segmentation", "num_chunks"), "chunk_size")
    fragmented = F.coalesce(argmax("fragmentation") > 0, F.lit(False))
    return scores.select("read_id", top_k("classification").alias("top3"), region.alias("region"), fragmented.alias("fragmented"), "num_chunks", "chunk_size")


def resolve_names(calls: DataFrame, class_labels: DataFrame) -> DataFrame:
    """Names of the three first classes. class_labels has a row per class."""
    out = calls
    for i, name in enumerate(("class", "second", "third")):
        dim = class_labels.select(F.col("class_idx").alias("_i"), F.col("ref_name").alias(name))
        out = out.join(dim, F.element_at(F.col("top3"), i + 1) == F.col("_i"), "left").drop("_i")
    return out.select("read_id", "class", "region", "second", "third", "fragmented")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column that is worked out once a row: a generator, as Catalyst copies the expression of a plain
    column into every filter over it."""
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(value)).alias(name))


def let(value: Column, body) -> Column:
    """Names a value inside an expression, so that it is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def run_lengths(x: str | Column, kind: str = "int") -> Column:
    """P20: array of (value, n) runs."""

    def runs(a: Column) -> Column:
        new = lambda i: (i == 1) | ~F.element_at(a, i).eqNullSafe(F.element_at(a, F.greatest(i - 1, F.lit(1))))
        starts = F.filter(F.sequence(F.lit(1), F.size(a)), new)
        pair = lambda s: F.transform(s, lambda at, k: F.struct(F.element_at(a, at).alias("value"), (F.coalesce(F.try_element_at(s, k + 2), F.size(a) + 1) - at).alias("n")))
        return F.when(F.size(a) > 0, let(starts, pair)).otherwise(F.array().cast(f"array<struct<value: {kind}, n: int>>"))

    return let(_c(x), runs)


def region_mask(region: str | Column, num_chunks: str | Column, chunk_size: str | Column) -> Column:
    """P25: 0 for the chunks of the region, -1 for others; no region, all -1."""
    r, size = _c(region), _c(chunk_size)
    first, last = F.floor(r["start"] / size), F.floor((r["end"] + 1) / size) - 1
    return F.transform(F.sequence(F.lit(0), _c(num_chunks) - 1), lambda i: F.when((r["start"] >= 0) & (i >= first) & (i <= last), 0).otherwise(-1))


def probability_curves(scores: DataFrame) -> DataFrame:
    """read_id, segment, x (middle sample of the chunk), p."""
    rows = scores.select("read_id", "chunk_size", F.posexplode(chunk_softmax("segmentation", "num_chunks")).alias("chunk", "probs"))
    rows = rows.select("read_id", (F.col("chunk") * F.col("chunk_size") + F.col("chunk_size") / 2).alias("x"), F.posexplode("probs").alias("segment", "p"))
    return rows.select("read_id", "segment", "x", "p")
