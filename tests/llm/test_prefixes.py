"""Links by rarest shingles against all pairs of sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import prefixes, simhash
from strandlake.llm.shingles import shingle_set

DOCS = "doc_id long, text string, lang string, s0 string, node string"


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]


def corpus(seed):
    """Families of near copies of many lengths, a passage in every third text, copies, short and empty texts."""
    rng = random.Random(seed)
    passage, texts = words(rng, 40), ["", " ", "one", "one two three", "x " * 500]
    for n in (5, 6, 8, 9, 16, 24, 60, 150, 400):
        for _ in range(6):
            base = words(rng, n)
            if rng.random() < 0.3:
                base[n // 2 : n // 2] = passage
            texts.append(" ".join(base))
            for _ in range(4):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, len(base) // 40))):
                    at = rng.randrange(len(copy))
                    copy[at : at + rng.choice([0, 1])] = words(rng, rng.choice([0, 1]))
                texts.append(" ".join(copy))
    return texts + texts[:20] + [" ".join(passage)] * 3 + [None]


def similar_pairs(texts, similarity):
    sets = [shingle_set((t or "").encode(), 5) for t in texts]
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both) and (both or not len(sets[i]) + len(sets[j])):
                yield i, j


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("seed,similarity,hot,small", [(1, 0.8, 1.0, 128), (2, 0.8, 0.0, 128), (3, 0.6, 1.0, 1 << 20), (4, 0.8, 1.0, 64)])
def test_links_join_every_similar_pair(spark, monkeypatch, seed, similarity, hot, small):
    """Also if nothing, or all that sets share, counts as hot, and with levels of few shingles."""
    monkeypatch.setattr(prefixes, "HOT_SHARE", hot)
    monkeypatch.setattr(prefixes, "SMALL", small)
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "en", "clash", "clash") for i, t in enumerate(texts)], DOCS).repartition(3)
    prints = simhash.set_prints(docs, 5, 64)
    rows = [(r.doc_id, r.s0, r.s1, len(s := shingle_set((texts[r.doc_id] or "").encode(), 5)), prefixes.picked(s).view(np.int64).tolist()) for r in prints.select("doc_id", "s0", "s1").collect()]
    prints = spark.createDataFrame(rows, "doc_id long, s0 long, s1 long, n long, picks array<long>")  # with the levels set here
    classes = prints.groupBy("s0", "s1").agg(F.min("doc_id").alias("node"))
    sets = prints.join(classes, ["s0", "s1"]).where("doc_id = node").select("node", "n", "picks")
    node = {r.doc_id: r.node for r in prints.join(classes, ["s0", "s1"]).select("doc_id", "node").collect()}
    links = [(r.a, r.b) for r in prefixes.rare_links(sets, similarity).collect()]
    found = roots(len(texts), [*links, *node.items()])
    missed = [(i, j) for i, j in similar_pairs(texts, similarity) if found[i] != found[j]]
    assert not missed
    if hot == 1.0:  # texts that share a passage only are no candidates
        assert len(set(found)) > 40


@pytest.mark.parametrize("n,edits", [(8, 0), (16, 0), (24, 1), (120, 2), (364, 8)])
def test_no_pair_of_any_length_is_lost(spark, n, edits):
    """Pairs of a text and the same with a word more (edits 0), or with words changed."""
    rng, texts = random.Random(n), []
    for _ in range(120):
        base = words(rng, n)
        other = list(base)
        for at in rng.sample(range(n), edits):
            other[at] = words(rng, 1)[0]
        texts += [" ".join(base), " ".join(other if edits else [*other, *words(rng, 1)])]
    docs = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in enumerate(texts)], DOCS).repartition(4)
    sets = [shingle_set(t.encode(), 5) for t in texts]
    alike = [len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8 for a, b in zip(sets[::2], sets[1::2])]
    assert any(alike)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {*range(0, 240, 2), *(2 * k + 1 for k, same in enumerate(alike) if not same)}


def test_groups_are_those_of_all_pairs(spark):
    texts = corpus(9)
    docs = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in enumerate(texts)], DOCS).repartition(3)
    found = roots(len(texts), similar_pairs(texts, 0.8))
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == {i for i, r in enumerate(found) if i == r}
