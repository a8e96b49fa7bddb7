"""Ranked lexical search by NRA (no random access) over impact-sorted posting lists.

The index holds, for each term that the items ask for, the documents with it by falling impact: the share of a
document's score that does not depend on the term's weight. It is partitioned into shards of documents, dealt out
by a hash of the document and bounded in postings, so a common term is spread over all of them. In a shard the lists of an
item are read in blocks from the top. Each document seen has an interval: the sum of what was read, and that
plus the impacts at which its other lists stand. Reading goes on until every document that may still be
among the best has a closed interval, so members, ties and scores are exact. The best of all shards are then ranked.

Items go through the same shuffle as the postings, in blocks of about BLOCK_TERMS terms, so nothing in a task grows with
their number.

Defined results: null text has no terms; an item without terms, or whose terms occur nowhere, has no rows; null and
repeated doc_ids are documents like others, a null one comes last among equal scores and is returned as null; repeated
rows of an item are one item, items of equal text are looked up once; texts of any length count as a whole; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, materialize, tidy
from .terms import item_terms, listed, sized

#: Postings of a shard, entries of a block of items, first rows read of each list (then doubled).
SHARD_POSTINGS, BLOCK_TERMS, FIRST_READ = 1 << 19, 1 << 16, 256
_KEY = ["block", "shard"]


def best_by_nra(lists: list[tuple[np.ndarray, np.ndarray]], order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best documents (numbers below len(order)), their scores, and how many postings were read.

    A list is (documents, impacts), impacts falling and not negative; equal scores go by `order`."""
    n = len(order)
    low, credit = np.zeros(n, np.int64), np.zeros(n, np.int64)  # credit: where the lists stand in which a document was seen
    at, stand, block = [0] * len(lists), [int(v[0]) if len(v) else 0 for _, v in lists], FIRST_READ
    while True:
        for t, (docs, impacts) in enumerate(lists):
            if at[t] == len(docs):
                continue
            to = min(at[t] + block, len(docs))
            seen, new = docs[: at[t]], docs[at[t] : to]
            now = int(impacts[to]) if to < len(docs) else 0
            low[new] += impacts[at[t] : to]
            credit[seen] += now - stand[t]
            credit[new] += now
            at[t], stand[t] = to, now
        high = low + (sum(stand) - credit)
        least = np.partition(low, n - k)[n - k] if n > k else 0
        open_ = np.flatnonzero(high >= max(least, 1))
        if (low[open_] == high[open_]).all():
            best = open_[np.lexsort((order[open_], -low[open_]))][:k]
            return best, low[best], sum(at)
        block *= 2


def _rank_shards(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for t in keyed(batches, _KEY):
        kind, term, value, number, doc, gone = (t.column(c).to_numpy() for c in ("kind", "tid", "value", "number", "doc", "gone"))
        asked = int(np.searchsorted(kind, 1))  # items first
        if asked == len(kind):
            continue
        rows, first, local = np.unique(number[asked:], return_index=True, return_inverse=True)
        order = np.empty(len(rows), np.int64)
        order[np.lexsort((rows, doc[asked:][first], gone[asked:][first]))] = np.arange(len(rows))
        terms = term[asked:]
        items, begin = np.unique(number[:asked], return_index=True)
        found: list[tuple] = []
        for item, a, b in zip(items.tolist(), begin, [*begin[1:], asked]):
            lists = []
            for x, w in zip(term[a:b], value[a:b]):
                lo, hi = np.searchsorted(terms, [x, x + 1])
                if lo < hi and w:
                    lists.append((local[lo:hi], value[asked + lo : asked + hi] * w))
            if lists:
                best, scores, _ = best_by_nra(lists, order, k)
                at = asked + first[best]
                found.append((np.full(len(best), item), rows[best], doc[at], gone[at], scores))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[c] for f in found])) for c in range(5)], names=["qid", "row", "doc", "gone", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 for each item.

    The weight of a term is w = floor(1000 * ln((2N + 2) / (2df + 1))), its impact
    (10^9 * tf) div (1000 * tf + 12m) with m = 75 + (25 * n * N) div L."""
    told = items.select("item_id", item_terms().alias("words")).where(F.size("words") > 0).distinct()
    asked = materialize(told.select("words").distinct().withColumn("qid", F.monotonically_increasing_id()))
    members = materialize(told.join(asked, "words").select("item_id", "qid"))
    entries = asked.select("qid", F.explode("words").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    vocabulary = entries.select("term").distinct().select("term", (F.monotonically_increasing_id() + 1).alias("tid"))
    heads = docs.sparkSession.range(1).select(F.lit("").alias("term"), F.col("id").alias("tid"))  # 0: heads of documents
    vocabulary = materialize(vocabulary.unionAll(heads))
    counted = listed(docs).join(sized(vocabulary), "term").groupBy("row", "doc_id", "n_words", "tid").agg(F.count("*").alias("tf"))
    counted = materialize(counted)
    n, words, postings = counted.agg(F.count_if((F.col("tid") == 0) & (F.col("n_words") > 0)), F.sum(F.when(F.col("tid") == 0, F.col("n_words"))), F.count_if(F.col("tid") > 0)).first()
    shards = max(1, -(-postings // SHARD_POSTINGS))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = materialize(counted.where("tid > 0").groupBy("tid").agg(F.count("*").alias("df")).select("tid", weight.alias("w")))
    wanted = entries.join(sized(vocabulary), "term").join(sized(weights), "tid")
    parts = max(1, -(-entries.count() // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int")
    wanted = materialize(wanted.select(block.alias("block"), "qid", "tid", (F.col("times") * F.col("w")).alias("value")))
    # both kinds of rows of a block and shard meet: the items' entries, then the postings by term and falling impact
    queries = wanted.select("block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("kind"), "tid", "value", F.col("qid").alias("number"), F.lit(0).cast("long").alias("doc"), F.lit(0).alias("gone"))
    impact = F.expr(f"(1000000000 * tf) div (1000 * tf + 12 * (75 + (25 * n_words * {n}) div {words or 1}))")
    blocks = materialize(wanted.select("block", "tid").distinct())
    listed_ = counted.join(sized(blocks), "tid").select("block", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("kind"), "tid", impact.alias("value"), F.col("row").alias("number"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"), F.col("doc_id").isNull().cast("int").alias("gone"))
    # items by number, postings by term and falling impact
    # a task for each block and shard: hashed keys would put several into one
    dealt = queries.unionAll(listed_).repartitionById(parts * shards, F.col("block") * shards + F.col("shard"))
    first = F.when(F.col("kind") == 0, F.col("number")).otherwise(F.col("tid"))
    dealt = dealt.withColumns({"o1": first, "o2": F.when(F.col("kind") == 0, F.lit(0)).otherwise(-F.col("value"))}).sortWithinPartitions(*_KEY, "kind", "o1", "o2", "number").drop("o1", "o2")
    ranked = dealt.mapInArrow(tidy(lambda batches: _rank_shards(batches, k)), "qid long, row long, doc long, gone int, score long")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "gone", "doc", "row"))
    best = materialize(ranked.withColumn("rank", rank).where(F.col("rank") <= k))
    return best.join(members, "qid").select("item_id", "rank", F.when(F.col("gone") == 0, F.col("doc")).alias("doc_id"), "score")


#: The same scores in one statement, every matching document ranked.
SQL = r"""
with d as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
i as (select distinct item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
q as (select row_number() over () as qid, item_id, ws from i),
qt as (select qid, item_id, term, count(*)::bigint as times from (select qid, item_id, unnest(ws) as term from q) group by all),
g as (select count(*) filter (where len(ws) > 0)::bigint as n, sum(len(ws))::bigint as l from d),
p as (select row, term, count(*)::bigint as tf from (select row, unnest(ws) as term from d) where term in (select term from qt) group by all),
w as (select term, floor(1000 * ln((2 * g.n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, g group by term, g.n),
s as (select qt.qid, qt.item_id, p.row, sum(qt.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * len(d.ws) * g.n) // g.l))))::bigint as score
      from qt join p using (term) join w using (term) join d on d.row = p.row, g group by all),
r as (select s.item_id, row_number() over (partition by s.qid order by s.score desc, d.doc_id nulls last) as rank, d.doc_id, s.score from s join d on d.row = s.row where s.score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 20
"""
