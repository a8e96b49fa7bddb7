"""Word passages that recur across documents: common ground of the two substring deduplicators.

A window is `window` consecutive words. Its anchor is the run of `gram` words in it with the least
hash (leftmost of equals), so equal windows have equal anchors at equal places, wherever they
stand. Neighbouring windows mostly share an anchor occurrence; such a stretch is a run: (a, seg,
doc_id, start, n) with the anchor's hash, the hash of all its words, the first window and the
number of windows. Every window of a document lies in one run.

A window recurs if its words start in a document with a smaller doc_id too. Within the runs of an
anchor it is enough to look at the first document of each distinct content (seg): in later documents
the whole run recurs.

Rows with null doc_id take no part and stay as they are; documents of equal doc_id do not affect
one another; null and short texts have no windows; texts of any length are whole, as one chunk; repeated rows
get the same result; columns besides doc_id and text are passed on, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_column, materialize, text_key, tidy
from .words import Chunk, chunks, join_hash, mix, text_buffers, window_argmin, window_hashes, word_hashes

WINDOW, GRAM = 50, 25
#: Rows that a task handles at a time where it passes texts on.
SLICE = 256


@dataclass
class Runs:
    """Runs of a chunk; start and anchor count words from the chunk's first."""

    doc: np.ndarray
    start: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    a: np.ndarray
    seg: np.ndarray
    words: np.ndarray  # hash of each word
    windows: np.ndarray  # hash of each window


def runs_of(c: Chunk, window: int = WINDOW, gram: int = GRAM) -> Runs:
    h = word_hashes(c.data, c.starts, c.ends)
    whole, grams = window_hashes(h, window), window_hashes(h, gram)
    none = np.zeros(0, np.int64)
    s = np.flatnonzero(c.doc[: len(whole)] == c.doc[window - 1 :]) if len(whole) else none
    if not len(s):
        return Runs(none, none, none, none, none, none, h, whole)
    anchor = window_argmin(grams, window - gram + 1)[s]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1)]))
    n = np.diff(np.append(first, len(s)))
    start, anchor = s[first], anchor[first]
    seg = join_hash(join_hash(whole[start], whole[start + n - 1]), n.astype(np.uint64))
    return Runs(c.doc[start], start, n, anchor, mix(grams[anchor]).view(np.int64), seg.view(np.int64), h, whole)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tk, text of the rows that take part; tk tells texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text").where("doc_id is not null")


def resolve(window_rows: DataFrame) -> DataFrame:
    """doc_id, tk, start, n of recurring windows, from windows (a, wh, doc_id, tk, pos) of anchors that no one
    task sees whole: compared by hashes of anchor and window, 128 bits in effect."""
    least = materialize(window_rows.groupBy("a", "wh").agg(F.min("doc_id").alias("least")))  # stored, so that the join below can be split at a hot key
    return window_rows.join(least, ["a", "wh"]).where("doc_id > least").select("doc_id", "tk", F.col("pos").alias("start"), F.lit(1).alias("n"))


def spans_by_document(found: DataFrame) -> DataFrame:
    """doc_id, tk, spans (array of start, n windows)."""
    return found.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def removed_words(n_words: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Marks the words that recurring windows cover."""
    step = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + counts + window - 1, n_words), -1)
    return np.cumsum(step[:-1]) > 0


def _spans(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    flat = column[i].values
    return flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)


def _with_spans(rows: DataFrame, spans: DataFrame, doc_id: str, key: str, found: str) -> DataFrame:
    """Adds the spans of each row; rows with null doc_id have none and do not meet in one task."""
    s = spans.select(F.col("doc_id").alias(doc_id), F.col("tk").alias(key), F.col("spans").alias(found))
    none = rows.where(F.col(doc_id).isNull()).withColumn(found, F.lit(None).cast(dict(s.dtypes)[found]))
    return rows.where(F.col(doc_id).isNotNull()).join(s, [doc_id, key], "left").unionByName(none)


def kept_digests(docs: DataFrame, spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text")
    source = _with_spans(rows, spans, "doc_id", "tk", "spans").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            spans = batch.column(2)
            n, gone, digest = [], [], []
            for i in range(batch.num_rows):
                words = data[at[i] : at[i + 1]].tobytes().split()
                n.append(len(words))
                if spans[i].is_valid:
                    drop = removed_words(len(words), *_spans(spans, i), window)
                    words = [w for w, d in zip(words, drop.tolist()) if not d]
                gone.append(n[-1] - len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return source.mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cut(text: pa.Array, starts: np.ndarray, counts: np.ndarray, window: int) -> str:
    """One text without the words of the windows, up to the next word kept."""
    c = next(chunks(text))
    drop = removed_words(len(c.starts), starts, counts, window)
    keep = np.ones(len(c.data), bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], drop.view(np.int8), [0]])))
    for first, last in zip(edge[::2], edge[1::2]):
        keep[c.starts[first] : c.starts[last] if last < len(c.starts) else len(c.data)] = False
    return c.data[keep].tobytes().decode()


def cut_texts(docs: DataFrame, spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs with recurring passages cut out of text; what is left keeps its white space."""
    columns = docs.columns
    doc_id, key, found = (free_column(docs, c) for c in ("_id", "_tk", "_spans"))
    rows = docs.withColumns({doc_id: F.col("doc_id").cast("long"), key: text_key()})
    source = _with_spans(rows, spans, doc_id, key, found).select(*columns, found)
    place = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, SLICE):
                batch = whole.slice(a, SLICE)
                spans, column = batch.column(len(columns)), batch.column(place)
                flagged = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist()
                if flagged:
                    out = column.to_pylist()
                    for i in flagged:
                        out[i] = _cut(column.slice(i, 1), *_spans(spans, i), window)
                    column = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays([column if j == place else batch.column(j) for j in range(len(columns))], names=columns)

    cut = source.mapInArrow(tidy(run), ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
    return cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in columns else cut
