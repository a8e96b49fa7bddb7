"""Substring deduplication with repeated-phrase automata.

1. Confirm: the anchors of passages.py that occur in two documents or more are the recurring phrases;
   the smallest doc_id that holds one owns it.
2. Compile: phrases are dealt to shards by owner, so the copies of a text meet in one shard. A task
   compiles its shard's phrases into an Aho-Corasick automaton (a word is three symbols of 32).
   A shard with many documents is split: each part compiles the same phrases.
3. Stream: every document with a phrase goes through the automata of the shards that have one of its phrases; a
   document is sent once for each owner it shares a phrase with at most, however many shards there are.
   The automaton's hits are the only occurrences known from here on: every window around a hit belongs
   to the leftmost hit inside it, and windows of one phrase with the same words in two documents recur
   in the later one. That is decided in the task where a shard is whole, by shuffle where it is split.

Defined results: see passages.py; an empty table gives no rows; other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages
from .common import materialize, tidy
from .words import chunks, join_hash, window_hashes, word_hashes

#: Phrases compiled into one automaton, about; documents that one task streams, about.
SHARD_PHRASES, PART_DOCS = 15_000, 4_000


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """a, doc_id: each anchor of a document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for c in chunks(batch.column(1)):
                r = passages.runs_of(c, window, gram)
                order = np.lexsort((r.a, r.doc))
                a, doc = r.a[order], r.doc[order]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]) if len(a) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(ids[c.first + doc[new]])], names=["a", "doc_id"])

    return passages.keyed(docs).select("doc_id", "text").mapInArrow(tidy(run), "a long, doc_id long")


def _symbols(words: np.ndarray) -> np.ndarray:
    """Three symbols of 32 for each word hash."""
    return np.stack([(words >> np.uint64(s)).astype(np.uint8) & 31 for s in (0, 5, 10)], 1) + np.uint8(48)


def _emit(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """From documents with routes (shard, parts, own) and own phrases: phrases and texts for the shards."""
    names = ["shard", "part", "kind", "doc_id", "tk", "whole", "payload"]
    for batch in batches:
        ids, keys, column, routes, own = batch.columns
        for i in range(batch.num_rows):
            key = int(keys[i].as_py()) % 2**62
            rows = []
            mine = own[i].as_py()
            for r in routes[i].as_py():
                whole = r["parts"] == 1
                rows.append((r["shard"], key % r["parts"], 1, whole, column[i].as_py().encode()))
                if r["own"]:
                    for c in chunks(column.slice(i, 1)):
                        found = passages.runs_of(c, window, gram)
                        at = found.anchor[np.isin(found.a, np.array(mine, dtype=np.int64))]
                        symbols = _symbols(found.words)
                        phrases = b"".join(symbols[p : p + gram].tobytes() for p in np.unique(at).tolist())
                    rows += [(r["shard"], p, 0, whole, phrases) for p in range(r["parts"])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([ids[i].as_py()] * len(rows), pa.int64()), pa.array([keys[i].as_py()] * len(rows), pa.int64()), pa.array([r[3] for r in rows], pa.bool_()), pa.array([r[4] for r in rows], pa.binary())],
                names=names,
            )


def _around_hits(automaton, phrases: np.ndarray, text: pa.Array, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Phrase, start, n and hash of the stretch of windows of each hit in one text, and the hash of every window.

    A window belongs to the leftmost hit inside it, which its words alone decide."""
    c = next(chunks(text))
    words = word_hashes(c.data, c.starts, c.ends)
    windows = window_hashes(words, window)
    found = np.array(list(automaton.iter(_symbols(words).tobytes().decode("latin-1"))), dtype=np.int64).reshape(-1, 2)
    found = found[(found[:, 0] + 1) % 3 == 0]  # whole words
    at, which = (found[:, 0] + 1) // 3 - gram, found[:, 1]
    start = np.maximum(np.maximum(at + gram - window, 0), np.concatenate([[0], at[:-1] + 1])) if len(at) else at
    n = np.minimum(at, len(windows) - 1) - start + 1
    start, n, which = start[n > 0], n[n > 0], which[n > 0]
    seg = join_hash(join_hash(windows[start], windows[start + n - 1]), n.astype(np.uint64)) if len(n) else np.zeros(0, np.uint64)
    return phrases[which], start, n, seg.view(np.int64), windows.view(np.int64)


class _Part:
    """What the hits of one part of a shard show, in order of doc_id.

    A shard in one part has every document with its phrases, so its windows are resolved here and only
    recurring ones leave the task. The stretches of a shard in several parts are handed on."""

    def __init__(self, whole: bool):
        self.whole, self.seen, self.out = whole, {}, []
        self.firsts: dict[int, list[tuple]] = {}

    def add(self, hits: tuple[np.ndarray, ...], doc_id: int, tk: int) -> None:
        windows = hits[4]
        for a, start, n, seg in zip(*(x.tolist() for x in hits[:4])):
            first = self.seen.setdefault((a, seg), doc_id) == doc_id
            own = windows[start : start + n] if first else None
            if not self.whole:
                self.out.append((a, seg, doc_id, tk, start, n, own))
            elif first:
                self.firsts.setdefault(a, []).append((seg, doc_id, tk, start, own))
            else:
                self.out.append((None, None, doc_id, tk, start, n, None))

    def close(self) -> None:
        for stretches in self.firsts.values():
            if len({r[0] for r in stretches}) > 1:
                least: dict[int, int] = {}
                for _, doc_id, tk, start, own in stretches:  # ascending doc_id
                    for i, w in enumerate(own.tolist()):
                        if least.setdefault(w, doc_id) < doc_id:
                            self.out.append((None, None, doc_id, tk, start + i, 1, None))
        self.firsts, self.seen = {}, {}


def _locate(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Streams a part's documents through its automaton. Rows with null a recur; the others are stretches at
    hits, with window hashes for the first document of each content in the part."""
    import ahocorasick

    now, part, size = None, _Part(True), 3 * gram
    automaton, phrases, compiled = None, {}, None
    for batch in batches:
        for shard, number, kind, doc_id, tk, whole, payload in zip(*(c.to_pylist() for c in batch.columns[:6]), batch.columns[6]):
            if now != (shard, number):
                part.close()
                if part.out:
                    yield _runs(part.out)
                now, part = (shard, number), _Part(whole)
                automaton, phrases, compiled = ahocorasick.Automaton(ahocorasick.STORE_INTS), {}, None
            if kind == 0:
                text = payload.as_py().decode("latin-1")
                for p in range(0, len(text), size):
                    phrase = text[p : p + size]
                    automaton.add_word(phrase, phrases.setdefault(phrase, len(phrases)))
                continue
            if compiled is None:
                automaton.make_automaton()
                compiled = np.array([xxhash.xxh64_intdigest(p) for p in phrases], np.uint64).view(np.int64)
                phrases = {}
            if automaton.kind == ahocorasick.AHOCORASICK:
                part.add(_around_hits(automaton, compiled, pa.array([payload.as_py()], pa.binary()).cast(pa.string()), window, gram), doc_id, tk)
            if len(part.out) > 20_000:
                yield _runs(part.out)
                part.out = []
    part.close()
    if part.out:
        yield _runs(part.out)


def _runs(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["a", "seg", "doc_id", "tk", "start", "n", "windows"])


def repeated_spans(docs: DataFrame, window: int = passages.WINDOW, gram: int = passages.GRAM, shard_phrases: int = SHARD_PHRASES, part_docs: int = PART_DOCS) -> DataFrame:
    """doc_id, tk, spans: the windows of each document that start in a document of smaller doc_id too."""
    held = materialize(anchors(docs, window, gram))
    recurring = materialize(held.groupBy("a").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last"))
    shards = max(1, recurring.count() // shard_phrases)
    placed = recurring.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)))
    pairs = materialize(held.join(placed, "a").groupBy("doc_id", "shard").agg(F.max(F.col("doc_id") == F.col("owner")).alias("own")))
    load = materialize(pairs.groupBy("shard").agg(F.ceil(F.count("*") / part_docs).alias("parts")))
    routes = pairs.join(load, "shard").groupBy("doc_id").agg(F.collect_list(F.struct("shard", "parts", "own")).alias("routes"))
    own = recurring.groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list("a").alias("own"))
    source = passages.keyed(docs).join(routes, "doc_id").join(own, "doc_id", "left").select("doc_id", "tk", "text", "routes", "own")
    sent = source.mapInArrow(tidy(lambda b: _emit(b, window, gram)), "shard long, part long, kind int, doc_id long, tk long, whole boolean, payload binary")
    dealt = sent.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind", "doc_id")
    found = materialize(dealt.mapInArrow(tidy(lambda b: _locate(b, window, gram)), "a long, seg long, doc_id long, tk long, start int, n int, windows array<long>"))
    recur = found.where("a is null").select("doc_id", "tk", "start", "n")
    runs = found.where("a is not null")  # of shards in several parts
    firsts = materialize(runs.groupBy("a", "seg").agg(F.min("doc_id").alias("least")))  # stored, so that the joins below can be split at a hot key
    later = runs.select("a", "seg", "doc_id", "tk", "start", "n").join(firsts, ["a", "seg"]).where("doc_id > least").select("doc_id", "tk", "start", "n")
    several = firsts.groupBy("a").agg(F.count("*").alias("contents")).where("contents > 1")
    told = runs.where("windows is not null").join(firsts.join(several, "a"), ["a", "seg"]).where("doc_id = least")
    windows = told.select("a", "doc_id", "tk", "start", F.posexplode("windows").alias("i", "wh"))
    windows = materialize(windows.select("a", "wh", "doc_id", "tk", (F.col("start") + F.col("i")).alias("pos")))
    return materialize(passages.spans_by_document(recur.unionAll(later).unionAll(passages.resolve(windows))))


def drop_repeats(docs: DataFrame, window: int = passages.WINDOW) -> DataFrame:
    """docs with every passage of `window` words or more that a smaller doc_id has too cut out."""
    return passages.cut_texts(docs, repeated_spans(docs, window), window)
