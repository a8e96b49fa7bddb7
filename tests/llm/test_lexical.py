"""Ranked search, decontamination and fill-in-the-middle against plain versions on small hand-made tables."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import pytest

from strandlake.llm import decontam, infill, lexical, queries, terms

DOCS = "doc_id long, text string, lang string, row string, pos string, term string"
ITEMS = "item_id long, text string, qid string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def words_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["the", "The", "of", "ñ", "Ñandú", "漢字"] + ["".join(rng.choices("abcé", k=rng.randint(1, 4))) for _ in range(60)]
    line = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", " _"]) for _ in range(n))
    items = [(i, line(rng.randint(1, 40))) for i in range(25)] + [(30, None), (31, " .. "), (None, line(12)), (32, "the the the the the the the the the the the the"), (33, "rarest")]
    items += [(40 + i, items[3][1]) for i in range(8)] + [items[4]] + [(2, line(15))]
    docs = [(i, line(rng.randint(0, 60))) for i in range(60)]
    for i in range(40):
        _, passage = items[rng.randrange(25)]
        w = (passage or "").split()
        a = rng.randrange(len(w))
        docs.append((100 + i, f"..{line(rng.randint(0, 20))} {' '.join(w[a : a + rng.randint(5, 30)])} {line(rng.randint(0, 20))}!"))
    docs += [(200 + i, f"{items[3][1]} x") for i in range(20)]  # a hot passage
    docs += [(300, None), (301, ""), (302, "..."), (None, items[5][1]), (None, None), (303, "the " * 300 + "RAREST end"), docs[61], docs[61], (docs[62][0], "another text"), (304, " ".join(line(20) for _ in range(200)))]
    return docs, items


@pytest.fixture(scope="module")
def frames(spark, rows):
    docs, items = rows
    return spark.createDataFrame([(i, t, "en", "clash", "clash", "clash") for i, t in docs], DOCS).repartition(3), spark.createDataFrame([(i, t, "clash") for i, t in items], ITEMS).repartition(2)


@pytest.fixture(params=["sent", "shuffled"])
def way(request, monkeypatch):
    """With the items' tables broadcast, and with every join shuffled."""
    if request.param == "shuffled":
        monkeypatch.setattr(terms, "MOST_BROADCAST", 0)


def plain_ranking(docs, items, k=20):
    held = [(i, Counter(words_of(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in set(items):
        asked = Counter(words_of(text))
        found = []
        for i, c in held:
            m = 75 + (25 * sum(c.values()) * n) // total
            score = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, x in asked.items() if w in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,block,read", [(1 << 19, 1 << 16, 256), (150, 40, 1)])
def test_op11_ranks_as_brute_force(rows, frames, way, monkeypatch, shard, block, read):
    for name, value in (("SHARD_POSTINGS", shard), ("BLOCK_TERMS", block), ("FIRST_READ", read)):
        monkeypatch.setattr(lexical, name, value)
    got = lexical.search(*frames)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_ranking(*rows)


def test_op11_intervals_close_before_lists_end(monkeypatch):
    """The reader stops early where the tops of the lists decide, and never with an open interval."""
    monkeypatch.setattr(lexical, "FIRST_READ", 4)
    rng = np.random.default_rng(3)
    n = 20_000
    top = np.sort(rng.integers(1, 50, n))[::-1].copy()
    top[:30] = np.arange(10**6, 10**6 - 30, -1)
    same = rng.permutation(n)
    docs, scores, read = lexical.best_by_nra([(same, top), (same, top)], np.arange(n), 10)
    assert scores.tolist() == [2 * x for x in top[:10].tolist()] and docs.tolist() == same[:10].tolist() and read < 200
    for _ in range(200):
        size, lists = int(rng.integers(1, 40)), []
        for _ in range(int(rng.integers(1, 6))):
            members = rng.permutation(size)[: rng.integers(1, size + 1)]
            lists.append((members, np.sort(rng.integers(0, 4, len(members)))[::-1]))
        order = rng.permutation(size)
        total = np.zeros(size, np.int64)
        for d, v in lists:
            total[d] += v
        want = sorted((d for d in range(size) if total[d] > 0), key=lambda d: (-total[d], order[d]))[:5]
        docs, scores, _ = lexical.best_by_nra(lists, order, 5)
        assert docs.tolist() == want and scores.tolist() == total[want].tolist()


def plain_contamination(docs, items, size=10):
    asked = {}
    for item, text in items:
        w = words_of(text)
        k = min(size, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            asked.setdefault(tuple(w[s : s + k]), set()).add("" if item is None else str(item))
    out = []
    for i, t in docs:
        w, hit, found = words_of(t), set(), set()
        for k in range(1, size + 1):
            for s in range(len(w) - k + 1):
                if (x := tuple(w[s : s + k])) in asked:
                    hit |= set(range(s, s + k))
                    found |= asked[x]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_op12_hits_are_those_of_brute_force(rows, frames, way):
    got = decontam.contamination(*frames)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_contamination(*rows)


def test_op12_shorter_windows(rows, frames):
    got = decontam.contamination(*frames, size=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_contamination(*rows, size=3)


def test_op12_terms_in_any_order_within_a_span(rows, frames, way):
    size, span = 4, 7
    want = []
    for (i, t), (item, text) in product(rows[0], set(rows[1])):
        w, x = words_of(t), words_of(text)
        k = min(size, len(x))
        sets = [set(x[s : s + k]) for s in range(len(x) - k + 1)] if k else []
        if any(need <= set(w[a : a + span]) for need in sets for a in range(len(w))):
            want.append((i, "" if item is None else str(item)))
    got = decontam.near_items(*frames, size, span)
    key = lambda x: (str(x[0]), x[1])
    # a document's rows of different texts under one id are told apart inside
    assert sorted(set(map(tuple, got.collect())), key=key) == sorted(set(want), key=key)


def test_op12_index_needs_no_shuffle_and_no_python(frames):
    listed = terms.listed(frames[0])
    plan = listed.sortWithinPartitions("term")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") <= 1  # the fixture's repartition


@pytest.mark.parametrize("unit", ["point", "word"])
def test_op13_skip_list_finds_every_rank(unit, monkeypatch):
    monkeypatch.setattr(infill, "PIECE", 37)
    rng = random.Random(3)
    for n in (0, 1, 5, 63, 64, 65, 1000, 5000):
        text = "".join(rng.choice(["a", "é", "漢", "😀", " ", "\n"]) for _ in range(n))
        starts = [i for i in range(n) if i == 0 or unit == "point" or (text[i - 1] in " \n" and text[i] not in " \n")] + [n]
        found = infill.SkipList(np.frombuffer(text.encode(), np.uint8), unit)
        assert found.units == len(starts) - 1 and all((lane[:-1, 0] == infill.SPAN * infill.FAN**k).all() for k, lane in enumerate(found.lanes))
        assert [found.seek(r) for r in range(len(starts))] == [(s, len(text[:s].encode())) for s in starts]


def plain_infill(i, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return i, n, "spm", a, b - a, sha(f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"), sha(text)
    return i, n, "psm", a, b - a, sha(f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"), sha(text)


def test_op13_outputs_and_restored_texts(spark, rows):
    rng = random.Random(9)
    told = rows[0] + [(1000 + i, "".join(rng.choice("<PSM>éa😀") for _ in range(rng.randint(0, 9)))) for i in range(300)] + [(2000, "é漢😀 " * 50_000), (-5, "negative id")]
    frame = spark.createDataFrame([(i, t, "plain", "n", "x", "y") for i, t in told], "doc_id long, text string, form string, n string, output string, unit string").repartition(3)
    got = sorted((tuple(r) for r in infill.infill_digests(frame).collect()), key=str)
    assert got == sorted((plain_infill(i, t) for i, t in told), key=str)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_empty_tables(spark, frames):
    docs, items = (f.limit(0) for f in frames)
    assert lexical.search(docs, frames[1]).count() == lexical.search(frames[0], items).count() == 0
    assert decontam.contamination(docs, frames[1]).count() == decontam.near_items(docs, frames[1]).count() == decontam.near_items(frames[0], items).count() == 0
    assert {tuple(r)[2:] for r in decontam.contamination(frames[0], items).collect()} == {(0, 0, hashlib.sha256(b"").hexdigest(), False)}
    assert infill.infill_digests(docs).count() == 0


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_decontaminate", "op13_fill_in_middle"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found, done = queries.QUERIES[name](spark, SF), con.execute(queries.SQL[name])
    columns = [c[0] for c in done.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(done.fetchall(), key=str)
