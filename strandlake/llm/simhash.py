"""SimHash near-duplicate groups by a self-join of binary tries.

Fingerprints of equal value are merged first. Two fingerprints within `budget` bits agree on at
least one of budget + 1 blocks of bits, so each (block, value) is a subtree forest of its own that
Spark deals out by key; inside it pairs of trie nodes are descended together, the differing bits
are summed, and a pair is left as soon as the budget is exceeded. A key with more than `group_rows`
fingerprints is dealt anew by a further block of the remaining bits, thrice at most; what is still
larger then (near copies that share a segment) is dealt out as pairs of blocks. A task returns a spanning forest of the links in its groups, never all
pairs; the forests are joined by star contraction.

Defined results: null text counts as empty, no word gives fingerprint zero (linked like any other);
rows with null doc_id get a fingerprint and a null component; repeated rows share their result;
texts of any length count as a whole; an empty table gives no rows; columns besides doc_id and text are
not read. drop_near_duplicates tells rows of one doc_id by their texts and passes other columns on, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_column, materialize, text_key, tidy
from .prefixes import picked, rare_links
from .shingles import shingle_hashes, shingle_set
from .words import lots, mix, text_buffers

_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, ngram: int, bits: int) -> np.ndarray:
    """bits / 64 unsigned words; a bit is set if it is set in over half of the shingle hashes."""
    return set_fingerprint(shingle_hashes(text, ngram), bits)


def set_fingerprint(blocks: Iterable[np.ndarray], bits: int) -> np.ndarray:
    n, counts = 0, np.zeros(bits, dtype=np.int64)
    lanes = np.arange(bits // 8) * 256
    for h in blocks:
        n += len(h)
        wide = np.stack([h, *(mix(h + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)) for i in range(1, bits // 64))], axis=1)
        raw = wide.astype(">u8").view(np.uint8).reshape(len(h), bits // 8)
        seen = np.bincount((raw + lanes).ravel(), minlength=256 * len(lanes)).reshape(len(lanes), 256)
        counts += (seen @ _BITS_OF).ravel()
    return np.packbits(counts * 2 > n).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, ngram: int = 5, bits: int = 64) -> DataFrame:
    """doc_id, w0 .. (bits / 64 longs) for every row."""
    names = [f"w{i}" for i in range(bits // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            out = np.zeros((batch.num_rows, bits // 64), dtype=np.uint64)
            for i in range(batch.num_rows):
                if at[i] < at[i + 1]:
                    out[i] = fingerprint(data[at[i] : at[i + 1]].tobytes(), ngram, bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, i].view(np.int64)) for i in range(bits // 64))], names=["doc_id", *names])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"{n} long" for n in names))


def trie_pairs(values: np.ndarray, width: int, budget: int, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of a sorted array whose values differ in `budget` bits or fewer.

    The trie is the sorted array: a node is a range of values with a common prefix. Pairs of nodes
    are descended bit by bit; small pairs are compared outright."""
    n = len(values)
    todo = [(width, np.array([[0, n, 0, n, 0]], dtype=np.int64))]
    while todo:
        depth, pairs = todo.pop()
        if len(pairs) > block:
            todo += [(depth, pairs[:block]), (depth, pairs[block:])]
            continue
        same = pairs[:, 0] == pairs[:, 2]
        na, nb = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        leaf = (na * nb <= 64) if depth else np.ones(len(pairs), bool)
        for lo1, hi1, lo2, hi2, _ in _bounded(pairs[leaf], block):
            yield from _compare(values, lo1, hi1, lo2, hi2, budget)
        pairs, same = pairs[~leaf], same[~leaf]
        if not len(pairs):
            continue
        bit = depth - 1
        cut = np.uint64(1 << bit)
        high = np.uint64((2**64 - 1) >> bit << bit)
        mid1 = np.clip(np.searchsorted(values, (values[pairs[:, 0]] & high) | cut), pairs[:, 0], pairs[:, 1])
        mid2 = np.clip(np.searchsorted(values, (values[pairs[:, 2]] & high) | cut), pairs[:, 2], pairs[:, 3])
        lo1, hi1, lo2, hi2, err = pairs.T
        kids = np.concatenate(
            [
                np.stack([lo1, mid1, lo2, mid2, err], 1),
                np.stack([mid1, hi1, mid2, hi2, err], 1),
                np.stack([lo1, mid1, mid2, hi2, err + 1], 1),
                np.stack([mid1, hi1, lo2, mid2, err + 1], 1)[~same],
            ]
        )
        kids = kids[(kids[:, 0] < kids[:, 1]) & (kids[:, 2] < kids[:, 3]) & (kids[:, 4] <= budget)]
        kids = kids[(kids[:, 0] != kids[:, 2]) | (kids[:, 1] - kids[:, 0] > 1)]
        if len(kids):
            todo.append((bit, kids))


def _bounded(pairs: np.ndarray, block: int) -> Iterator[tuple]:
    """Node pairs in lots whose products stay near `block`; a larger pair is cut into strips."""
    if not len(pairs):
        return
    size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    small = pairs[size <= block]
    if len(small):
        lots = np.cumsum(size[size <= block]) // block
        for lot in np.split(small, np.flatnonzero(np.diff(lots)) + 1):
            yield tuple(lot.T)
    for lo1, hi1, lo2, hi2, err in pairs[size > block]:
        step = max(1, block // (hi2 - lo2))
        for lo in range(lo1, hi1, step):
            yield tuple(np.array([x]) for x in (lo, min(hi1, lo + step), lo2, hi2, err))


def _compare(values, lo1, hi1, lo2, hi2, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    na, nb = hi1 - lo1, hi2 - lo2
    size = na * nb
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    wide = np.repeat(nb, size)
    i, j = np.repeat(lo1, size) + within // wide, np.repeat(lo2, size) + within % wide
    near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
    if near.any():
        yield i[near], j[near]


def spanning_forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The root of each of n items; links within a tree are skipped in bulk."""
    root = np.arange(n)
    for i, j in links:
        open_ = root[i] != root[j]
        while open_.any():
            i, j = i[open_], j[open_]
            a, b = root[i], root[j]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
            open_ = root[i] != root[j]
    return root


def _masks(width: int, blocks: int) -> list[list[list[int]]]:
    """By level and path: the masks of the blocks that the next level fixes besides."""

    def cut(bits: list[int]) -> list[list[int]]:
        size = -(-len(bits) // blocks)
        return [bits[i * size : (i + 1) * size] for i in range(blocks)]

    paths, levels = [(0, list(range(width)))], []
    for _ in range(3):
        level, following = [], []
        for mask, rest in paths:
            level.append([])
            for part in cut(rest):
                more = mask | sum(1 << b for b in part)
                level[-1].append(more)
                following.append((more, [b for b in rest if b not in part]))
        levels.append(level)
        paths = following
    return levels


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def near_links(reps: DataFrame, words: int, segment_bits: int, budget: int, total_budget: int, group_rows: int = 20_000) -> DataFrame:
    """Links (a, b) between the nodes of reps (node, w0 ..), distinct in w0 ..; stars that span the trees
    of each dealt group. Candidates differ in `budget` bits or fewer in one of the segments; a link
    differs in `total_budget` or fewer bits of all words."""
    names = [f"w{i}" for i in range(words)]
    group = ["seg", "path", "at", "p", "q"]
    per_word = 64 // segment_bits
    levels = _masks(segment_bits, budget + 1)
    low = _signed(2**segment_bits - 1)
    segments = [F.shiftrightunsigned(F.col(n), s * segment_bits).bitwiseAND(F.lit(low)) if per_word > 1 else F.col(n) for n in names for s in range(per_word)]

    def children(level: int, path, value):
        masks = F.array(*(F.array(*(F.lit(_signed(m)) for m in ms)) for ms in levels[level]))
        return F.transform(masks[path], lambda m, i: F.struct((path * (budget + 1) + i).cast("int").alias("path"), value.bitwiseAND(m).alias("at")))

    def join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(t: pa.Table, edges: list) -> None:
            key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in group], 1)
            new = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            lo, hi = np.concatenate([[0], new]), np.concatenate([new, [len(key)]])
            node = t.column("node").to_numpy()
            value = t.column("value").to_numpy().view(np.uint64)
            full = np.stack([t.column(c).to_numpy().view(np.uint64) for c in names], 1)
            for a, b in zip(lo[hi - lo > 1], hi[hi - lo > 1]):
                order = a + np.argsort(value[a:b])
                v, f, m = value[order], full[order], node[order]

                def links():
                    for i, j in trie_pairs(v, segment_bits, budget):
                        near = np.bitwise_count(f[i] ^ f[j]).sum(1, dtype=np.int64) <= total_budget
                        yield i[near], j[near]

                root = spanning_forest(b - a, links())
                least = np.full(b - a, np.iinfo(np.int64).max)
                np.minimum.at(least, root, m)
                least = least[root]
                off = least != m
                if off.any():
                    edges.append(np.stack([m[off], least[off]], 1))

        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            edges: list[np.ndarray] = []
            solve(t, edges)
            if edges:
                e = np.concatenate(edges)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, k]) for k in range(2)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            t = pa.Table.from_batches(held)
            last = [t.column(c)[len(t) - 1].as_py() for c in group]
            open_ = np.ones(len(t), bool)
            for c, x in zip(group, last):
                open_ &= t.column(c).to_numpy() == x
            first = int(np.argmax(open_))
            if first:
                yield from flush(t.slice(0, first))
            held = t.slice(first).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    rows = reps.select("node", *names, F.posexplode(F.array(*segments)).alias("seg", "value"))
    path = F.lit(0)
    out = None
    for level in range(3):
        keyed = rows.select("node", *names, "seg", "value", F.explode(children(level, path, F.col("value"))).alias("k"))
        keyed = keyed.select("node", *names, "seg", "value", "k.path", "k.at")
        hot = materialize(keyed.groupBy("seg", "path", "at").agg(F.count("*").alias("n")).where(F.col("n") > group_rows))
        hot = None if hot.isEmpty() else hot
        here = keyed.join(hot, ["seg", "path", "at"], "left_anti") if hot is not None else keyed
        here = here.withColumns({"p": F.lit(0), "q": F.lit(0)})
        if level == 2 and hot is not None:
            here = here.unionByName(_block_pairs(keyed.join(hot, ["seg", "path", "at"]), group_rows))
        dealt = here.repartition(*group).sortWithinPartitions(*group)
        links = dealt.select(*group, "node", "value", *names).mapInArrow(tidy(join_groups), "a long, b long")
        out = links if out is None else out.unionAll(links)
        if hot is None:
            break
        rows, path = keyed.join(hot, ["seg", "path", "at"], "left_semi"), F.col("path")
    return out


def _block_pairs(hot: DataFrame, group_rows: int) -> DataFrame:
    """Rows of groups of n members, once for each pair of blocks (p, q) that theirs is in."""
    blocks = F.ceil(F.col("n") / F.lit(max(1, group_rows // 2))).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = hot.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).drop("own", "other", "n")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of links (a, b).

    Alternating star contraction: each round is two grouped minima and joins; rounds end when
    nothing moves. Only two sums per round come to the driver."""
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        # minima are stored before they are joined, so that AQE can split the joins at the centre of a star
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = materialize(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        edges = materialize(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, ngram: int = 5, bits: int = 64, segment_bits: int = 64, budget: int = 2, total_budget: int = 2, group_rows: int = 20_000) -> DataFrame:
    """doc_id, w0 .., component_id (smallest doc_id reachable over links) for every row."""
    names = [f"w{i}" for i in range(bits // 64)]
    prints = materialize(fingerprints(docs, ngram, bits))
    reps = materialize(prints.where("doc_id is not null").groupBy(*names).agg(F.min("doc_id").alias("node")))
    roots = components(near_links(reps, bits // 64, segment_bits, budget, total_budget, group_rows))
    classes = reps.join(roots, "node", "left").select(*names, F.coalesce("root", "node").alias("root"))
    joined = prints.join(classes, names, "left")
    return joined.select("doc_id", *names, F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"))


def similar_forest(sets: list[np.ndarray], side: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Tree edges that join what the pairs of sets of that Jaccard similarity join; with `side`, pairs of two
    sides only. A pair is left unverified only if its ends are joined already or its sizes rule it out."""
    n = np.array([len(x) for x in sets], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    shingles = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(shingles) + 1, bool)
    root, edges = np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        rest = rest[(root[rest] != root[i]) & (np.minimum(n[rest], n[i]) >= similarity * np.maximum(n[rest], n[i]))]
        if side is not None:
            rest = rest[side[rest] != side[i]]
        if not len(rest):
            continue
        own = shingles[at[i] : at[i + 1]]
        mark[own] = True
        lot = 16  # the first links found join most of a family, so lots begin small
        while len(rest):
            js, rest, lot = rest[:lot], rest[lot:], min(4 * lot, 1024)
            js = js[root[js] != root[i]]
            if not len(js):
                continue
            first = np.cumsum(n[js]) - n[js]
            hit = mark[shingles[np.repeat(at[js] - first, n[js]) + np.arange(n[js].sum())]]
            total = np.concatenate([[0], np.cumsum(hit)])
            shared = total[first + n[js]] - total[first]
            js = js[shared >= similarity * (n[i] + n[js] - shared)]
            joined, which = np.unique(root[js], return_index=True)
            edges += [(i, int(j)) for j in js[which]]
            if len(joined):
                root[np.isin(root, joined)] = root[i]
        mark[own] = False
    return edges


#: Distinct shingles and texts of a block of a group; a task holds two blocks of one group.
BLOCK_SHINGLES, BLOCK_TEXTS = 1 << 19, 1024


def similar_links(texts: DataFrame, ngram: int, similarity: float) -> DataFrame:
    """Links (a, b) that join what the pairs of texts of one group with the Jaccard similarity of distinct
    shingles join, exactly, from g, p, q, node, side, text: every pair of blocks (p, q) of a group g is a
    key that Spark deals out."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(0))
            for first, last in lots(at, 1 << 20):
                sets = [shingle_set(data[at[i] : at[i + 1]].tobytes(), ngram).tobytes() for i in range(first, last)]
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *(c.slice(first, last - first) for c in batch.columns[1:])], names=["shingles", "node", "g", "block", "blocks"])

    def join_group(key: tuple, nodes: list, sides: list, sets: list) -> pa.RecordBatch:
        edges = similar_forest(sets, np.array(sides) if key[1] != key[2] else None, similarity) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[e[k]] for e in edges], pa.int64()) for k in range(2)], names=["a", "b"])

    def join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sides, sets = None, [], [], []
        for batch in batches:
            for *k, node, side, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if key is not None:
                        yield join_group(key, nodes, sides, sets)
                    key, nodes, sides, sets = k, [], [], []
                if not nodes or nodes[-1] != node:  # repeated rows come together
                    nodes.append(node)
                    sides.append(side)
                    sets.append(np.frombuffer(shingles, np.uint64))
        if key is not None:
            yield join_group(key, nodes, sides, sets)

    sets = texts.select("text", "node", "g", "block", "blocks").mapInArrow(tidy(to_sets), "shingles binary, node long, g long, block int, blocks int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = sets.select("*", other).select("g", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "node", "block", "shingles")
    dealt = dealt.repartition("g", "p", "q").sortWithinPartitions("g", "p", "q", "node")
    return dealt.mapInArrow(tidy(join_groups), "a long, b long")


def set_prints(docs: DataFrame, ngram: int, bits: int) -> DataFrame:
    """doc_id, tk, bytes, n, picks, w0 .., s0, s1 for every row: text key, length, size of the set of distinct shingles,
    those of them that prefixes.rare_links compares, fingerprint and 128-bit hash of the set."""
    names = [*(f"w{i}" for i in range(bits // 64)), "s0", "s1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(2))
            out, n, picks = np.zeros((batch.num_rows, len(names)), dtype=np.uint64), [], []
            for i in range(batch.num_rows):
                found = shingle_set(data[at[i] : at[i + 1]].tobytes(), ngram)
                n.append(len(found))
                picks.append(picked(found).view(np.int64))
                if len(found):
                    out[i, :-2] = set_fingerprint([found], bits)
                out[i, -2:] = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.uint64)
            told = [batch.column(0), batch.column(1), pa.array(np.diff(at)), pa.array(n, pa.int64()), pa.array(picks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*told, *(pa.array(out[:, k].view(np.int64)) for k in range(len(names)))], names=["doc_id", "tk", "bytes", "n", "picks", *names])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text")
    return source.mapInArrow(tidy(run), "doc_id long, tk long, bytes long, n long, picks array<long>, " + ", ".join(f"{n} long" for n in names))


def similar_groups(docs: DataFrame, ngram: int, similarity: float, bits: int, segment_bits: int, budget: int, total_budget: int, group_rows: int = 20_000) -> DataFrame:
    """doc_id, tk, root and root_tk (the smallest of its group) for every row with a doc_id; tk is the text's key.

    Texts with the same set of shingles are one class. Classes of equal print, what near_links joins by prints and
    what rare_links joins by rare shingles are one loose group, in which similar_links verifies the texts before
    a link joins anything. rare_links leaves out no link of that similarity (see there), where the prints miss some."""
    names = [f"w{i}" for i in range(bits // 64)]
    prints = materialize(set_prints(docs.where("doc_id is not null"), ngram, bits))
    classes = prints.groupBy(*names, "s0", "s1").agg(F.min(F.struct("doc_id", "tk", "bytes")).alias("least"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))  # stored, so a class keeps its number
    reps = materialize(classes.groupBy(*names).agg(F.min("node").alias("rep"), F.count("*").alias("n")))
    of = classes.join(reps, names).select("node", "rep")
    sets = prints.select("doc_id", "tk", "n", "picks").join(classes.select("node", "least.doc_id", "least.tk"), ["doc_id", "tk"])
    exact = rare_links(materialize(sets.dropDuplicates(["doc_id", "tk", "node"]).select("node", "n", "picks")), similarity)
    exact = exact.join(of.select(F.col("node").alias("a"), F.col("rep").alias("ra")), "a").join(of.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    likely = near_links(reps.select(F.col("rep").alias("node"), *names), bits // 64, segment_bits, budget, total_budget, group_rows)
    found = components(likely.unionAll(exact))
    # roots are not among its nodes; a print of several classes is a group without a link too
    groups = found.select("node", F.col("root").alias("g")).unionAll(found.select("root", "root").distinct())
    groups = reps.join(groups, F.col("rep") == F.col("node"), "left").where("g is not null or n > 1").select(*names, F.coalesce("g", "rep").alias("g"))
    loose = materialize(classes.join(groups, names).select("least.*", "node", "g"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("bytes") / (4 * BLOCK_SHINGLES), F.lit(1))).cast("int")
    sizes = materialize(loose.groupBy("g").agg(blocks.alias("blocks")))
    loose = loose.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).drop("bytes")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text").join(loose, ["doc_id", "tk"])
    roots = components(similar_links(texts, ngram, similarity))
    classes = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = materialize(classes.groupBy("root").agg(F.min("least").alias("first")))
    classes = classes.join(least, "root").select(*names, "s0", "s1", F.col("first.doc_id").alias("root"), F.col("first.tk").alias("root_tk"))
    return prints.join(classes, [*names, "s0", "s1"]).select("doc_id", "tk", "root", "root_tk")


def drop_near_duplicates(docs: DataFrame, ngram: int = 5, similarity: float = 0.8, bits: int = 256, segment_bits: int = 32, budget: int = 4, total_budget: int = 64) -> DataFrame:
    """One row of each near-duplicate group stays, that with the smallest (doc_id, text key).

    Of 256 bits, two texts whose five-word shingles have a Jaccard similarity of 0.8 differ in 39 on
    average (the angle between their shingle vectors), hardly ever in over 64; eight segments of 32 bits find
    such a pair with 92 % (texts of 8 words) to over 99 % probability, and the rarest shingles
    of both (prefixes.rare_links) find every one. The prints count each distinct shingle once, as the similarity
    does, and every link is verified on the shingles themselves. Rows with null doc_id stay."""
    found = similar_groups(docs, ngram, similarity, bits, segment_bits, budget, total_budget)
    key, number = free_column(docs, "_tk"), free_column(docs, "_id")
    gone = found.where("root <> doc_id or root_tk <> tk").select(F.col("doc_id").alias(number), F.col("tk").alias(key)).distinct()
    keyed = docs.withColumns({number: F.col("doc_id").cast("long"), key: text_key()})
    kept = keyed.where(F.col(number).isNotNull()).join(gone, [number, key], "left_anti").dropDuplicates([number, key])
    return kept.unionByName(keyed.where(F.col(number).isNull())).select(*docs.columns)
