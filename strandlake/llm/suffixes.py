"""Suffix-array deduplication with a sparse suffix array.

1. Suffixes are kept at content-selected positions only, the minimiser positions of passages.py (about one
   word in 13). They are range-partitioned and sorted by their first word and the hash of their first `gram`
   words, so that suffixes with that beginning are neighbours; a long stretch of equal ones spreads over tasks.
   Neighbours with the same surroundings recur whole; a suffix whose beginning no other document has is out.
2. What is left, the first of each surroundings, comes with its words: from the position on, and back from
   it. These suffixes are range-partitioned by their first words, so that a beginning of `gram` words stays together,
   and a task puts them in order of their words and compares neighbours by their common prefix, which gives the
   suffixes that agree so many words to the right; the same order of the words before the position gives those
   that agree so many words to the left. A window that reaches o words
   back recurs if a suffix of a smaller doc_id agrees with its own on o words to the left and the others to the right.
   Words are compared, not hashes.

Suffixes whose beginning may go on in another task (the first and the last stretch of a task, and one of over
STRETCH rows) are matched by grouping the hashes of their windows instead, so no task needs a whole stretch.

Defined results: see passages.py; an empty table gives no rows; other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages
from .common import materialize, tidy
from .words import chunks, window_hashes, word_hashes

_SUFFIX = {"lead": "long", "a": "long", "seg": "long", "doc_id": "long", "tk": "long", "start": "int", "n": "int", "at": "int"}
_DDL = ", ".join(f"{c} {t}" for c, t in _SUFFIX.items())
#: Rows of one beginning that a task looks at together; a longer stretch is matched by its windows.
STRETCH = 100_000


def suffixes(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The suffixes at minimiser positions (at), with the windows around them: start, n. lead orders by the
    first eight bytes of the first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy() for i in (0, 1))
            for c in chunks(batch.column(2)):
                r = passages.runs_of(c, window, gram)
                row, base = c.first + r.doc, c.word_from[r.doc]
                lead = np.zeros((len(r.a), 8), np.uint8)
                begin, length = c.starts[r.anchor], c.ends[r.anchor] - c.starts[r.anchor]
                for k in range(8):
                    inside = length > k
                    lead[inside, k] = c.data[begin[inside] + k]
                lead = (lead.view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
                columns = (lead, r.a, r.seg, ids[row], keys[row], *(x.astype(np.int32) for x in (r.start - base, r.n, r.anchor - base)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=list(_SUFFIX))

    return passages.keyed(docs).mapInArrow(tidy(run), _DDL)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes whose windows recur whole (first = false) and firsts that have to be compared."""
    names = list(_SUFFIX)

    def judge(t: pa.Table, edge_first: bool, edge_last: bool) -> Iterator[pa.RecordBatch]:
        if not len(t):
            return
        lead, a, seg, doc = (t.column(c).to_numpy() for c in names[:4])
        new_a = np.concatenate([[True], (a[1:] != a[:-1]) | (lead[1:] != lead[:-1])])
        new_seg = new_a | np.concatenate([[True], seg[1:] != seg[:-1]])
        stretch, run = np.cumsum(new_a) - 1, np.cumsum(new_seg) - 1
        first_doc = doc[new_seg]  # in order, so the least
        firsts = doc == first_doc[run]
        stretch_of_run = stretch[new_seg]
        least = np.full(stretch[-1] + 1, np.iinfo(np.int64).max)
        most = np.full(stretch[-1] + 1, np.iinfo(np.int64).min)
        np.minimum.at(least, stretch_of_run, first_doc)
        np.maximum.at(most, stretch_of_run, first_doc)
        compare = least < most
        compare[0] |= edge_first
        compare[-1] |= edge_last
        keep = ~firsts | compare[stretch]
        if keep.any():
            yield pa.RecordBatch.from_arrays([*(pa.array(t.column(c).to_numpy()[keep]) for c in names), pa.array(firsts[keep])], names=[*names, "first"])

    yield from _stretches(batches, ["lead", "a"], judge)


def _stretches(batches: Iterator[pa.RecordBatch], by: list[str], judge) -> Iterator[pa.RecordBatch]:
    """Hands sorted rows on in lots that end where `by` changes; tells judge which lots begin or end inside
    a stretch that may go on elsewhere."""
    held, begun = [], False
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        last = np.ones(len(t), bool)
        for c in by:
            last &= pc.equal(t.column(c), t.column(c)[len(t) - 1]).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(~last)
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield from judge(t.slice(0, cut), not begun, False)
            begun, held = True, t.slice(cut).combine_chunks().to_batches()
        elif len(t) > STRETCH:
            yield from judge(t, True, True)
            begun, held = False, []
    if held:
        yield from judge(pa.Table.from_batches(held), not begun, True)


def contexts(docs: DataFrame, firsts: DataFrame, gram: int, window: int) -> DataFrame:
    """The words of suffixes: head (the first `gram`), rest (those that follow, as far as the last window
    reaches) and back (those before, nearest first, as far as the first window reaches)."""
    by_doc = firsts.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("start", "n", "at")).alias("places"))
    source = passages.keyed(docs).join(by_doc, ["doc_id", "tk"]).select("doc_id", "tk", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, tk, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                words = text.as_py().encode().split()
                for x in places.as_py():
                    start, n, at = x["start"], x["n"], x["at"]
                    head, rest, back = words[at : at + gram], words[at + gram : start + n - 1 + window], words[start:at][::-1]
                    rows.append((b" ".join(head), b" ".join(rest), b" ".join(back), doc_id, tk, start, n, at))
                if len(rows) > 4096:
                    yield _context_batch(rows)
                    rows = []
            if rows:
                yield _context_batch(rows)

    return source.mapInArrow(tidy(run), "head string, rest string, back string, doc_id long, tk long, start int, n int, at int")


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    arrays = [pa.array(c, pa.binary()).cast(pa.string()) for c in columns[:3]] + [pa.array(c, t) for c, t in zip(columns[3:], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
    return pa.RecordBatch.from_arrays(arrays, names=["head", "rest", "back", "doc_id", "tk", "start", "n", "at"])


def _word_codes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """rows x width codes of the words of each row, -1 beyond its last."""
    lists = pc.split_pattern(column.combine_chunks(), " ")
    codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    empty = pc.equal(column.combine_chunks(), "").to_numpy(zero_copy_only=False)
    size = np.diff(lists.offsets.to_numpy())
    out = np.full((len(size), width), -1, dtype=np.int32)
    out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = codes
    out[empty] = -1
    return out


def _agreeing(group: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """rows x (width + 1): the class of rows of a group that agree on so many leading words, from the common
    prefixes of neighbours in the order of their words."""
    order = np.lexsort((*codes.T[::-1], group))
    g, c = group[order], codes[order]
    common = np.cumprod(c[1:] == c[:-1], axis=1).sum(1)
    common[g[1:] != g[:-1]] = -1
    breaks = common[:, None] < np.arange(codes.shape[1] + 1)
    out = np.zeros((len(group), codes.shape[1] + 1), dtype=np.int64)
    out[order[1:]] = np.cumsum(breaks, axis=0)
    return out


def extended(t: pa.Table, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and start of each window that recurs among whole stretches of suffixes."""
    reach = window - gram
    head = t.column("head").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    right, left = _word_codes(t.column("rest"), reach), _word_codes(t.column("back"), reach)
    agree_right, agree_left = _agreeing(head, right), _agreeing(head, left)
    n_right, n_left = (right >= 0).sum(1), (left >= 0).sum(1)
    doc, at = t.column("doc_id").to_numpy(), t.column("at").to_numpy()
    rows, starts = [], []
    for o in range(reach + 1):  # windows that reach o words back and reach - o beyond the head
        has = np.flatnonzero((n_left >= o) & (n_right >= reach - o))
        key = np.unique(agree_right[has, reach - o] * len(doc) + agree_left[has, o], return_inverse=True)[1]
        least = np.full(len(has), np.iinfo(np.int64).max)
        np.minimum.at(least, key, doc[has])
        later = has[doc[has] > least[key]]
        rows.append(later)
        starts.append(at[later] - o)
    return np.concatenate(rows), np.concatenate(starts)


_MATCH = "a long, wh long, doc_id long, tk long, pos int"


def _extend(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Recurring windows (a and wh null), and windows of stretches that may go on in another task."""

    def out(t: pa.Table, row: np.ndarray, pos: np.ndarray, a=None, wh=None) -> pa.RecordBatch:
        none = pa.nulls(len(row), pa.int64())
        told = [pa.array(t.column(c).to_numpy()[row]) for c in ("doc_id", "tk")]
        return pa.RecordBatch.from_arrays([none if a is None else pa.array(a), none if wh is None else pa.array(wh), *told, pa.array(pos.astype(np.int32))], names=["a", "wh", "doc_id", "tk", "pos"])

    def open_windows(t: pa.Table) -> Iterator[pa.RecordBatch]:
        back = [" ".join(x.split(" ")[::-1]) for x in t.column("back").to_pylist()]
        text = pa.array([f"{b} {h} {r}" for b, h, r in zip(back, t.column("head").to_pylist(), t.column("rest").to_pylist())], pa.string())
        start, at = t.column("start").to_numpy(), t.column("at").to_numpy()
        for c in chunks(text):
            words = word_hashes(c.data, c.starts, c.ends)
            whole, grams = window_hashes(words, window), window_hashes(words, gram)
            s = np.flatnonzero(c.doc[: len(whole)] == c.doc[window - 1 :]) if len(whole) else np.zeros(0, np.int64)
            doc = c.doc[s]
            row = c.first + doc
            yield out(t, row, start[row] + s - c.word_from[doc], grams[c.word_from[doc] + at[row] - start[row]].view(np.int64), whole[s].view(np.int64))

    def judge(t: pa.Table, edge_first: bool, edge_last: bool) -> Iterator[pa.RecordBatch]:
        head = t.column("head")
        inner = np.ones(len(t), bool)
        for edge, i in ((edge_first, 0), (edge_last, len(t) - 1)):
            if edge:
                inner &= ~pc.equal(head, head[i]).to_numpy(zero_copy_only=False)
        if not inner.all():
            yield from open_windows(t.filter(pa.array(~inner)))
        t = t.filter(pa.array(inner))
        if len(t):
            yield out(t, *extended(t, window, gram))

    yield from _stretches(batches, ["head"], judge)


def repeated_spans(docs: DataFrame, window: int = passages.WINDOW, gram: int = passages.GRAM) -> DataFrame:
    """doc_id, tk, spans: the windows of each document that start in a document of smaller doc_id too."""
    order = ["lead", "a", "seg", "doc_id"]
    ordered = suffixes(docs, window, gram).repartitionByRange(*order).sortWithinPartitions(*order)
    matched = materialize(ordered.mapInArrow(tidy(_neighbours), _DDL + ", first boolean"))
    told = materialize(contexts(docs, matched.where("first"), gram, window))
    # ranges go by short keys, as Spark samples them to the driver: the first words, then a hash that keeps a beginning together
    keyed = told.withColumns({"lead": F.substring("head", 1, 40), "whole": F.xxhash64("head")})
    array = keyed.repartitionByRange("lead", "whole", "doc_id").sortWithinPartitions("lead", "whole", "head", "rest", "back", "doc_id").drop("lead", "whole")
    found = materialize(array.mapInArrow(tidy(lambda b: _extend(b, window, gram)), _MATCH))
    one = found.where("a is null").select("doc_id", "tk", F.col("pos").alias("start"), F.lit(1).alias("n"))
    whole = matched.where("not first").select("doc_id", "tk", "start", "n")
    return materialize(passages.spans_by_document(whole.unionAll(one).unionAll(passages.resolve(found.where("a is not null")))))


def drop_repeats(docs: DataFrame, window: int = passages.WINDOW) -> DataFrame:
    """docs with every passage of `window` words or more that a smaller doc_id has too cut out."""
    return passages.cut_texts(docs, repeated_spans(docs, window), window)
