"""Document fingerprints by a randomised edit embedding.

A text is embedded by a random walk over its characters: at step j the walk writes the character it
stands on and then stays or moves on, by a coin shared by all texts and drawn from (j, character).
Walks over texts at a small edit distance fall into step again after an edit, so edit distance becomes
Hamming distance of what they write. The embedding has about two steps per character; the fingerprint
keeps one written symbol from each block of 2^level steps, the level being the least that leaves
PLACES blocks. Places of a level are a subset of those of the level below, so prints of
texts of different lengths still compare place by place.

Defined results: null counts as empty; an empty text has the print "00" and is like another empty
one only; equal texts have equal prints; doc_id null sorts first; repeated rows and ties are ordered
by text; a single document is its own next; a text of any length is walked as a whole; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialize, shuffle_partitions, tidy
from .simhash import components, spanning_forest

CLASSES, PERIOD, PLACES = 64, 4096, 512
#: Bytes of a text that deal out rows of one doc_id.
PREFIX = 64
_SYMBOLS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", dtype=np.uint8)
_NONE = ord(".")
_STATES: list = []


def _states() -> list:
    """The walk as a machine: state j is a list of the next states by character class, with j at its end."""
    if not _STATES:
        move = np.random.default_rng(20).integers(0, 2, (PERIOD, CLASSES), dtype=np.int64)
        following = np.zeros((PERIOD, CLASSES), dtype=np.int64)
        at = np.full(CLASSES, -1)
        for j in range(2 * PERIOD - 1, -1, -1):  # the next step at or after j at which each class moves on
            at = np.where(move[j % PERIOD] == 1, j, at)
            if j < PERIOD:
                following[j] = at + 1
        lists = [[] for _ in range(PERIOD)]
        for j, row in enumerate((following % PERIOD).tolist()):
            lists[j].extend(lists[k] for k in row)
            lists[j].append(j)
        _STATES.extend(lists)
    return _STATES


def _coin(level: int, x: np.ndarray) -> np.ndarray:
    y = (x.astype(np.uint64) + np.uint64(level) * np.uint64(0x9E3779B9)) * np.uint64(0xD6E8FEB86659FD93)
    return ((y >> np.uint64(37)) & np.uint64(1)).astype(np.int64)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return ((points * np.uint32(2654435761)) >> np.uint32(26)).astype(np.uint8)


def _walk(c: np.ndarray, state: int = 0) -> np.ndarray:
    """Step (modulo PERIOD) at which the walk reaches each character and the end."""
    path = accumulate(c.tobytes(), getitem, initial=_states()[state])
    return np.fromiter(map(itemgetter(CLASSES), path), dtype=np.int64, count=len(c) + 1)


def _print(c: np.ndarray, steps: np.ndarray) -> str:
    if not len(c):
        return "00"
    held = np.diff(steps)
    held[held <= 0] += PERIOD
    ends = np.cumsum(held)  # the walk leaves character i at step ends[i]
    level = max(0, int(np.ceil(np.log2(int(ends[-1]) / PLACES))))
    x = np.arange(-(-int(ends[-1]) // 2**level))
    for down in range(level, 0, -1):
        x = 2 * x + _coin(down, x)
    place = np.searchsorted(ends, x, "right")
    out = np.where(place < len(c), _SYMBOLS[c[np.minimum(place, len(c) - 1)]], _NONE).astype(np.uint8)
    return f"{level:02x}" + out.tobytes().decode()


def edit_print(text: str) -> str:
    c = classes(text)
    return _print(c, _walk(c))


def _coarser(symbols: np.ndarray, level: int) -> np.ndarray:
    b = np.arange(-(-len(symbols) // 2))
    x = 2 * b + _coin(level + 1, b)
    return np.where(x < len(symbols), symbols[np.minimum(x, len(symbols) - 1)], _NONE)


def likeness(a: str, b: str) -> float:
    """Share of equal places of two prints, at the coarser level of both; 0 to 1."""
    (la, a_), (lb, b_) = sorted((int(x[:2], 16), x[2:]) for x in (a, b))
    if not a_ or not b_:
        return float(a_ == b_)
    p, q = np.frombuffer(a_.encode(), np.uint8), np.frombuffer(b_.encode(), np.uint8)
    while la < lb:
        p, la = _coarser(p, la), la + 1
    n = min(len(p), len(q))
    return float((p[:n] == q[:n]).sum()) / max(len(p), len(q))


def _sort_key(doc_id: str, text: str) -> Column:
    """Text that sorts as (doc_id, nulls first, and the first bytes of the text) does."""
    flipped = F.lpad(F.hex(F.col(doc_id).bitwiseXOR(F.lit(-(2**63)))), 16, "0")  # negative numbers before others
    return F.concat(F.coalesce(F.concat(F.lit("1"), flipped), F.lit("0")), F.hex(F.substring(F.encode(text, "UTF-8"), 1, PREFIX)))


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, text and next_text of each row in order of (doc_id, text); the last one's next is the first.

    Ranges of doc_id, and of the text's first bytes where rows share one or have none, are dealt out once; the first
    row of each range is sent to the range before it as well, so each task reads its rows and one more in order.
    Limits come from a sample of keys; they and the least key of each range are all that the driver gets."""
    n = partitions or shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k", _sort_key("doc_id", "text"))
    share = min(1.0, 100 * n / max(1, docs.count()))
    some = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit("ranges"), "k"), 2) <= F.lit(int(share * 2**62))).select("k")
    told = np.sort(np.array([r.k for r in some.collect()], dtype=object))  # about 100 keys a range
    cuts = np.unique(told[np.arange(1, n) * len(told) // n]) if len(told) else told

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(dtype=object), "right").astype(np.int32))

    rows = rows.withColumn("part", range_of("k"))
    firsts = {r["part"]: r["least"] for r in rows.groupBy("part").agg(F.min("k").alias("least")).collect()}  # a row per range
    used = sorted(firsts)
    if not used:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"))
    before = {p: used[i - 1] for i, p in enumerate(used)}

    @F.pandas_udf("int")
    def guest_of(part: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([before[p] if firsts[p] == x else None for p, x in zip(part, k)], dtype="Int32")

    sent = rows.withColumn("before", guest_of("part", "k"))
    to = lambda part, guest: F.struct(F.col(part).alias("to"), F.lit(guest).alias("guest"))
    sent = sent.select("doc_id", "text", F.explode(F.filter(F.array(to("part", False), to("before", True)), lambda s: s["to"].isNotNull())).alias("s"))
    sent = sent.select("s.to", "s.guest", "doc_id", "text")
    dealt = sent.repartitionById(max(used) + 1, F.col("to")).sortWithinPartitions("to", "guest", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        out: list[tuple] = []
        held = 0
        for batch in batches:
            guest, ids, texts = batch.column(1), batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if last is not None:
                    out.append((*last, text))
                    held += len(text) + len(last[1])
                last = None if guest[i].as_py() else (ids[i].as_py(), text)
                if guest[i].as_py():
                    yield _rows(out)
                    for _ in batches:  # further guests tie with the first
                        pass
                    return
                if held > 1 << 22:
                    yield _rows(out)
                    out, held = [], 0
        if out:
            yield _rows(out)

    return dealt.mapInArrow(tidy(run), "doc_id long, text string, next_text string")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.string())], names=["doc_id", "text", "next_text"])


def edit_prints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [edit_print(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, fingerprint string")


def edit_report(docs: DataFrame) -> DataFrame:
    """Prints of every text, of the text with its second half overwritten from the next document, and
    their likenesses."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple | None = None  # rows come in order, so a next text is soon a text

        def walked(text: str) -> tuple:
            c = classes(text)
            steps = _walk(c)
            return text, c, steps, _print(c, steps)

        for batch in batches:
            out: list[list] = [[] for _ in names]
            for i in range(batch.num_rows):
                text, following = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                half = len(text) // 2
                edited = text[: len(text) - half] + following[:half]
                _, c, steps, own = known if known and known[0] == text else walked(text)
                known = walked(following)
                kept = len(text) - half
                c = np.concatenate([c[:kept], known[1][:half]])  # the edited text, walked from where it differs
                changed = _print(c, np.concatenate([steps[:kept], _walk(c[kept:], int(steps[kept]))]))
                row = (batch.column(0)[i].as_py(), len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, known[3]))
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=names)

    return with_next(docs).mapInArrow(tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _band_keys(reps: DataFrame, band: int, block_rows: int) -> DataFrame:
    """doc_id, key, blocks, own of each band key that several of reps (fingerprint, doc_id) share: a key of more than
    `block_rows` prints has several blocks, of which each print is in one."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i in range(batch.num_rows):
                print_ = batch.column(0)[i].as_py()
                symbols, level = np.frombuffer(print_[2:].encode(), np.uint8), int(print_[:2], 16)
                for lv, s in ((level, symbols), (level + 1, _coarser(symbols, level))):
                    for b in range(0, max(1, len(s) - band + 1), band):
                        ids.append(batch.column(1)[i].as_py())
                        out.append(f"{lv:02x}{b:03x}" + s[b : b + band].tobytes().decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "key"])

    keyed = reps.select("fingerprint", "doc_id").mapInArrow(tidy(keys), "doc_id long, key string")
    shared = keyed.groupBy("key").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    return materialize(keyed.join(shared, "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")))


def near_pairs(docs: DataFrame, band: int = 8, min_likeness: float = 0.5, max_edit: float | None = None, block_rows: int = 1000) -> DataFrame:
    """a, b, likeness: all links between class representatives (documents of equal print share one).

    Bit-sampled banding: every run of `band` places, at a print's own level and the next, is a
    key; all prints of a key are compared with each other, and links under min_likeness fall out. A key
    of more than `block_rows` prints is dealt out as pairs of blocks. With max_edit, links are verified by
    exact edit distance over length."""
    prints = edit_prints(docs).where("doc_id is not null")
    reps = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).where("length(fingerprint) > 2"))

    keyed = _band_keys(reps, band, block_rows)
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = keyed.select("key", F.col("own").alias("p"), every.alias("q"), F.col("doc_id").alias("a"))
    other = keyed.select("key", every.alias("p"), F.col("own").alias("q"), F.col("doc_id").alias("b"))
    pairs = one.join(other, ["key", "p", "q"]).where("a < b").select("a", "b").distinct()
    left, right = (reps.select(F.col("doc_id").alias(x), F.col("fingerprint").alias(f"f{x}")) for x in "ab")

    @F.pandas_udf("double")
    def alike(p, q):
        import pandas as pd

        return pd.Series([likeness(x, y) for x, y in zip(p, q)], dtype="float64")

    found = pairs.join(left, "a").join(right, "b").withColumn("likeness", alike("fa", "fb")).where(F.col("likeness") >= min_likeness).select("a", "b", "likeness")
    if max_edit is None:
        return found
    texts = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    both = found.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return both.where(F.levenshtein("ta", "tb") <= max_edit * F.greatest(F.length("ta"), F.length("tb"))).select("a", "b", "likeness")


def _at_level(prints: list[str], level: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of prints at a level at or above their own, padded with 0, and their lengths (0: own level is above)."""
    rows = []
    for p in prints:
        own, symbols = int(p[:2], 16), np.frombuffer(p[2:].encode(), np.uint8)
        while own < level:
            symbols, own = _coarser(symbols, own), own + 1
        rows.append(symbols if own == level else symbols[:0])
    n = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), max(1, n.max(initial=0))), np.uint8)
    for row, r in zip(out, rows):
        row[: len(r)] = r
    return out, n


def _laid(prints: list[str], level: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """As _at_level, with each band filled up with 0 to places of whole bytes, and each row to bands of whole words."""
    symbols, n = _at_level(prints, level)
    bands, places = -(-symbols.shape[1] // band), -(-band // 8) * 8
    filled = np.zeros((len(prints), bands * band), np.uint8)
    filled[:, : symbols.shape[1]] = symbols
    out = np.zeros((len(prints), -(-bands // 8) * 8, places), np.uint8)
    out[:, :bands, :band] = filled.reshape(len(prints), bands, band)
    return out.reshape(len(prints), -1), n


def _alike(symbols: np.ndarray, n: np.ndarray, i: int, js: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Likeness of print i and prints js, laid out at one level, and their equal places, a bit each."""
    same = symbols[js] == symbols[i]
    bits = np.packbits(same.reshape(-1)).reshape(len(same), same.shape[1] // 8)
    longer = np.maximum(n[js], n[i])
    equal = np.bitwise_count(bits.view(np.uint64)).sum(1, dtype=np.int64) - (same.shape[1] - longer)  # both filled up: no place
    return equal / np.maximum(longer, 1), bits


def _first_band(bits: np.ndarray, alike: np.ndarray, n: np.ndarray, i: int, js: np.ndarray, band: int) -> np.ndarray:
    """The first band that print i and each of prints js share (-1: none)."""
    longer, shorter = np.maximum(n[js], n[i]), np.minimum(n[js], n[i])
    size = -(-band // 8)
    whole = (bits.reshape(len(bits), bits.shape[1] // size, size) == 255).all(2)
    whole &= (np.arange(whole.shape[1]) + 1) * band <= shorter[:, None]
    first = np.where(whole.any(1), whole.argmax(1), -1)
    short = (longer < band) & (n[js] == n[i]) & (alike == 1)  # a print shorter than a band is one key
    return np.where(short, 0, first)


def _links_of_key(key: str, ids: np.ndarray, sides: np.ndarray | None, prints: list[str], band: int, min_likeness: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each print to others of a key, and the root of its tree. A pair that shares several keys is
    counted at the first, lower levels first; with `sides`, pairs of two sides only.

    Likeness comes first, as bits of equal places; only pairs that are near are asked for their first band."""
    level, at = int(key[:2], 16), int(key[2:5], 16) // band
    lower = np.array([int(p[:2], 16) < level for p in prints], bool)
    side = np.zeros(len(ids), np.int64) if sides is None else np.unique(sides, return_inverse=True)[1]
    order = np.lexsort((lower, side))  # what print i is compared with lies in a row, those of a lower level last
    lower, side, prints = lower[order], side[order], [prints[k] for k in order]
    here, below = _laid(prints, level, band), _laid(prints, level - 1, band) if lower.any() else None
    counts, other = np.zeros(len(ids), np.int64), int(np.searchsorted(side, 1))

    def near(i: int, first: int, last: int, both_lower: bool) -> np.ndarray:
        if first == last:
            return np.zeros(0, np.int64)
        alike, bits = _alike(*(below if both_lower else here), i, slice(first, last))  # two of a lower level are judged there
        k = np.flatnonzero(alike >= min_likeness)
        alike, bits, js = alike[k], bits[k], k + first
        if both_lower:  # unless they met there
            js = js[_first_band(bits, alike, below[1], i, js, band) < 0]
            alike, bits = _alike(*here, i, js)
        return js[_first_band(bits, alike, here[1], i, js, band) == at]

    def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(len(ids) if sides is None else other):
            first = i + 1 if sides is None else other
            middle = len(ids) if not lower[i] else first + int(np.count_nonzero(~lower[first:]))
            js = np.concatenate([near(i, x, y, both) for x, y, both in ((first, middle, False), (middle, len(ids), True))])
            if len(js):
                counts[i] += len(js)
                counts[js] += 1
                yield np.full(len(js), i), js

    root = spanning_forest(len(ids), links())
    back = np.argsort(order)
    return counts[back], order[root][back]


def near_classes(docs: DataFrame, band: int = 8, min_likeness: float = 0.5, block_rows: int = 1000) -> DataFrame:
    """doc_id, class_id (the smallest doc_id that links of near_pairs reach) and n_links (of its print to other
    prints) of every row; empty texts are one class, rows with null doc_id have none.

    The pairs are those of near_pairs, but never leave their task: of each key, or pair of blocks of a key, come a count
    for each print and a spanning forest."""
    prints = materialize(edit_prints(docs))
    reps = materialize(prints.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")))
    keyed_ = _band_keys(reps.where("length(fingerprint) > 2"), band, block_rows)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = keyed_.join(reps, "doc_id").select("key", "own", "doc_id", "fingerprint", other)
    dealt = dealt.select(F.xxhash64("key").alias("g"), "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "doc_id", "fingerprint")
    dealt = dealt.repartition("g", "p", "q").sortWithinPartitions("g", "p", "q", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in keyed(batches, ["g", "p", "q"]):
            for key in t.column("key").unique().to_pylist():  # one, unless hashes meet
                rows = t.filter(pc.equal(t.column("key"), key))
                ids, own = rows.column("doc_id").to_numpy(), rows.column("own").to_numpy()
                two = rows.column("p")[0].as_py() != rows.column("q")[0].as_py()
                counts, root = _links_of_key(key, ids, own if two else None, rows.column("fingerprint").to_pylist(), band, min_likeness)
                told = counts > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[told]), pa.array(ids[root[told]]), pa.array(counts[told])], names=["node", "to", "n"])

    told = materialize(dealt.mapInArrow(tidy(run), "node long, to long, n long"))
    links = told.groupBy("node").agg(F.sum("n").alias("n_links"))
    roots = components(told.select(F.col("node").alias("a"), F.col("to").alias("b")).where("a <> b"))
    found = reps.withColumnRenamed("doc_id", "node").join(roots, "node", "left").join(links, "node", "left")
    found = found.select("fingerprint", F.coalesce("root", "node").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    mine = F.col("doc_id").isNotNull()
    return prints.join(found, "fingerprint", "left").select("doc_id", F.when(mine, F.col("class_id")).alias("class_id"), F.when(mine, F.col("n_links")).alias("n_links"))
