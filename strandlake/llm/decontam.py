"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

build_index stores a posting (h, term, row, pos) for every term of every document. The index is partitioned by
documents: each task lists its own documents and sorts by h, the hash of the term, so that posting lists lie together
in a file, Parquet's bounds prune a look-up, and no posting is shuffled to build it. A head entry with an empty term
holds a document's id and number of terms.

exact_hits takes windows of `size` item terms. The two rarest terms of each window give gaps (term, term,
distance); their two posting lists, adjusted by their offsets, are intersected on (row, place, gap). The places that are left put
an item on a diagonal (place in the document minus place in the item), along which the postings of the
other terms around are intersected too: runs of `size` terms are the occurrences. near_hits asks for all terms of
a window in any order within `span` terms. What comes from the items is broadcast if its measured size allows;
else the same joins are shuffled.

Defined results: null text has no terms; null and repeated doc_ids are documents like others (an inner row number
tells them apart); items without a term occur nowhere; a null item_id is an item with an empty id, and rows of one
item_id are one item; items of equal text are looked up once; texts of any length count as a whole; empty tables give no rows
or no hits; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .terms import item_terms, listed, sized


def build_index(docs: DataFrame) -> DataFrame:
    """h, term, row, pos, n_words, doc_id; the last two in head entries (empty term) only."""
    head = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
    return materialize(listed(docs).select(F.xxhash64("term").alias("h"), "term", "row", "pos", head("n_words"), head("doc_id")).sortWithinPartitions("h"))


def heads(index: DataFrame) -> DataFrame:
    """row, doc_id, n_words of every document."""
    return index.where((F.col("h") == F.xxhash64(F.lit(""))) & (F.col("term") == "")).select("row", "doc_id", "n_words")


class Phrases:
    """The items' distinct sequences of terms, with the terms' frequencies in an index.

    terms: pid, len, j, h, term, c; members: pid, item_id (text)."""

    def __init__(self, index: DataFrame, items: DataFrame):
        told = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), item_terms().alias("words")).where(F.size("words") > 0)
        phrases = materialize(told.select("words").distinct().withColumn("pid", F.monotonically_increasing_id()))
        self.members = materialize(told.distinct().join(phrases, "words").select("pid", "item_id"))
        places = phrases.select("pid", F.size("words").alias("len"), F.posexplode("words").alias("j", "term")).withColumn("h", F.xxhash64("term"))
        self.vocabulary = materialize(places.select("h", "term").distinct())
        counts = materialize(index.join(sized(self.vocabulary), ["h", "term"]).groupBy("h", "term").agg(F.count("*").alias("c")))
        self.terms = materialize(places.join(counts, ["h", "term"], "left").select("pid", "len", "j", "h", "term", F.coalesce("c", F.lit(0)).alias("c")))

    def windows(self, size: int) -> DataFrame:
        """pid, len, k, entries (structs j, h, term, c) of each window of k = min(size, len) terms whose terms all occur."""
        whole = self.terms.groupBy("pid", "len").agg(F.array_sort(F.collect_list(F.struct("j", "h", "term", "c"))).alias("all"))
        k = F.least("len", F.lit(size))
        cut = whole.select("pid", "len", k.alias("k"), F.explode(F.transform(F.sequence(F.lit(0), F.col("len") - k), lambda s: F.slice("all", s + 1, F.least("len", F.lit(size))))).alias("entries"))
        return cut.where(~F.exists("entries", lambda e: e.c == 0))


def _rarest(entries: str = "entries") -> Column:
    """The entries of a window as structs (c, j, h, term), rarest first."""
    return F.array_sort(F.transform(entries, lambda e: F.struct(e.c.alias("c"), e.j.alias("j"), e.h.alias("h"), e.term.alias("term"))))


def _within(index: DataFrame, vocabulary: DataFrame, rows: DataFrame) -> DataFrame:
    """The postings that can match: of the given terms, and of the given rows where these are few enough to send."""
    near = index.join(sized(vocabulary), ["h", "term"], "left_semi").select("h", "term", "row", "pos")
    sent = sized(rows)
    return near if sent is rows else near.join(sent, "row", "left_semi")


def exact_hits(index: DataFrame, phrases: Phrases, size: int = 10) -> DataFrame:
    """row, pid, first, n: runs of document terms from place `first` that windows of a phrase cover."""
    ranked = phrases.windows(size).select("pid", "len", "k", _rarest().alias("r"))
    a, b = F.element_at("r", 1), F.element_at("r", F.least(F.lit(2), F.col("k")))
    pairs = ranked.select("pid", "len", "k", a.j.alias("ja"), a.h.alias("ha"), a.term.alias("ta"), b.h.alias("hb"), b.term.alias("tb"), (b.j - a.j).alias("apart")).distinct()
    pairs = materialize(pairs)
    gaps = materialize(pairs.select("ha", "ta", "hb", "tb", "apart").distinct().withColumn("gap", F.monotonically_increasing_id()))
    sides = gaps.select("gap", F.explode(F.array(F.struct(F.col("ha").alias("h"), F.col("ta").alias("term"), F.lit(0).alias("off"), F.lit(1).alias("side")), F.struct(F.col("hb").alias("h"), F.col("tb").alias("term"), F.col("apart").alias("off"), F.lit(2).alias("side")))).alias("s"))
    sides = materialize(sides.select("gap", "s.*"))
    lists = index.join(sized(sides), ["h", "term"]).select("row", (F.col("pos") - F.col("off")).alias("at"), "gap", "side")
    both = lists.groupBy("row", "at", "gap").agg(F.bit_or("side").alias("sides")).where("sides = 3")
    around = pairs.alias("p").join(phrases.terms.alias("t"), (F.col("p.pid") == F.col("t.pid")) & F.col("t.j").between(F.col("ja") - F.col("k") + 1, F.col("ja") + F.col("k") - 1))
    around = around.select("ha", "ta", "hb", "tb", "apart", "p.pid", "k", "ja", "t.j", F.col("t.h").alias("h"), F.col("t.term").alias("term"))
    around = materialize(around.join(gaps, ["ha", "ta", "hb", "tb", "apart"]).select("gap", "pid", "k", "ja", "j", "h", "term"))
    probes = both.join(sized(around), "gap").select("row", "pid", "k", (F.col("at") - F.col("ja")).alias("diagonal"), "j", "h", "term")
    probes = materialize(probes.distinct().withColumn("pos", F.col("diagonal") + F.col("j")))
    rows = materialize(probes.select("row").distinct())
    matched = probes.join(_within(index, phrases.vocabulary, rows), ["row", "pos", "h", "term"])
    run = Window.partitionBy("row", "pid", "diagonal").orderBy("j")
    runs = matched.withColumn("island", F.col("j") - F.row_number().over(run)).groupBy("row", "pid", "diagonal", "island")
    runs = runs.agg(F.min("pos").alias("first"), F.count("*").cast("int").alias("n"), F.max("k").alias("k")).where("n >= k")
    return materialize(runs.select("row", "pid", "first", "n"))


def near_hits(index: DataFrame, phrases: Phrases, size: int = 10, span: int = 20) -> DataFrame:
    """row, pid: documents in which all terms of a window of the phrase occur within `span` terms, in any order."""
    told = phrases.windows(size).select("pid", _rarest().alias("r"))
    told = told.select("pid", F.array_distinct(F.transform("r", lambda e: F.struct(e.c.alias("c"), e.h.alias("h"), e.term.alias("term")))).alias("r"))
    sets = materialize(told.select("r").distinct().withColumn("wid", F.monotonically_increasing_id()))
    owners = materialize(told.join(sets, "r").select("wid", "pid").distinct())
    wanted = materialize(sets.select("wid", F.size("r").alias("m"), F.posexplode("r").alias("rank", "e")).select("wid", "m", "rank", "e.h", "e.term"))
    # lists of the two rarest terms meet in blocks of `span` places, those of the rarest in the blocks beside as well
    lists = index.join(sized(materialize(wanted.where("rank < 2"))), ["h", "term"]).select("row", "pos", "wid", "m", "rank")
    block = lambda pos: F.floor(pos / F.lit(span)).cast("int")
    beside = F.explode(F.array(block(F.col("pos")) - 1, block(F.col("pos")), block(F.col("pos")) + 1)).alias("block")
    anchors = lists.where("rank = 0").select("row", "wid", "m", "pos", beside)
    others = lists.where("rank = 1 or m = 1").select("row", "wid", F.col("pos").alias("pos2"), block(F.col("pos")).alias("block"))
    met = anchors.join(others, ["row", "wid", "block"]).where(F.abs(F.col("pos") - F.col("pos2")) < span).select("row", "wid", "m", "pos").distinct()
    met = materialize(met)
    probes = met.join(sized(wanted), ["wid", "m"]).select("row", "wid", "m", "pos", "h", "term", beside)
    near = _within(index, phrases.vocabulary, materialize(met.select("row").distinct()))
    near = near.select("row", "h", "term", F.col("pos").alias("pos2"), block(F.col("pos")).alias("block"))
    around = probes.join(near, ["row", "block", "h", "term"]).where(F.abs(F.col("pos") - F.col("pos2")) < span)
    ahead = Window.partitionBy("row", "wid", "pos").orderBy("pos2").rangeBetween(0, span - 1)
    full = around.withColumn("held", F.size(F.collect_set(F.struct("h", "term")).over(ahead))).where("held = m")
    return materialize(full.select("row", "wid").distinct().join(sized(owners), "wid").select("row", "pid").distinct())


def _item_lists(hits: DataFrame, phrases: Phrases) -> DataFrame:
    """row, item_ids (sorted as strings) of hits (row, pid)."""
    pairs = hits.select("row", "pid").distinct().join(sized(phrases.members), "pid")
    return pairs.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    index = build_index(docs)
    phrases = Phrases(index, items)
    hits = exact_hits(index, phrases, size)
    covered = hits.select("row", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("pos")).distinct()
    told = heads(index).join(covered.groupBy("row").agg(F.count("*").alias("n_hit")), "row", "left").join(_item_lists(hits, phrases), "row", "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("item_ids", F.array().cast("array<string>"))
    return told.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def near_items(docs: DataFrame, items: DataFrame, size: int = 10, span: int = 20) -> DataFrame:
    """doc_id, item_id (text): documents that hold all terms of a window of an item within `span` terms."""
    index = build_index(docs)
    phrases = Phrases(index, items)
    found = near_hits(index, phrases, size, span).join(sized(phrases.members), "pid").select("row", "item_id").distinct()
    return found.join(heads(index), "row").select("doc_id", "item_id")


#: The same rule by whole windows as strings: every window length that items have is cut out of the documents.
SQL = r"""
with d as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select coalesce(item_id::varchar, '') as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
iw as (select distinct item_id, least(10, len(w)) as k, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') as win
       from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from i where len(w) > 0)),
dw as (select row, s, k, array_to_string(w[s:s + k - 1], ' ') as win
       from (select row, w, k, unnest(range(1, len(w) - k + 2)) as s from d, (select distinct k from iw) where len(w) >= k)),
hit as (select dw.row, dw.s, iw.k, iw.item_id from dw join iw on dw.k = iw.k and dw.win = iw.win),
cov as (select row, count(distinct p) as n_hit from (select row, unnest(range(s, s + k)) as p from hit) group by row),
its as (select row, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct row, item_id from hit) group by row)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cov using (row) left join its using (row)
"""
