"""The corpus pipeline: each stage on its predecessor's rows, held against plain versions."""

import hashlib
import random
import re

import pytest

import corpus_pipeline
from strandlake.llm import langid
from strandlake.llm.common import materialize

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def stages(spark):
    rng = random.Random(11)
    shared = prose(rng, 80)
    rows = [(i, prose(rng, 120), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(5)]  # exact copies
    for i in range(5):  # near copies
        w = rows[10 + i][1].split()
        w[60] = "changed"
        rows.append((200 + i, " ".join(w), "en", "s1"))
    rows += [(300 + i, f"{prose(rng, 60)} {shared} {prose(rng, 60)}", None, "s2") for i in range(4)]
    rows += [(400, "12 34 !?", "en", "s0"), (401, None, "en", "s0")]
    frames = [spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], COLUMNS)]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(materialize(stage(spark, frames[-1], "")))
    return rows, frames


def test_stage_columns_and_names(stages):
    _, frames = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "mix_sources", "bpe"]
    assert all(f.columns == frames[0].columns for f in frames[1:-1])


def test_language_stage_drops_texts_without_letters(stages):
    rows, (_, out, *_) = stages
    assert {r.doc_id for r in out.collect()} == {i for i, *_ in rows} - {400, 401}
    assert out.where("lang is null").count() == 0


def test_language_stage_rejects_by_no_score(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one text", None, "s0", 8), (2, "12", "en", "s0", 2)], COLUMNS)
    monkeypatch.setattr(langid, "predict", lambda docs, model, label, score: docs.selectExpr("*", f"if(doc_id = 2, 'und', 'fr') as {label}", f"0.1D as {score}"))
    assert [(r.doc_id, r.lang) for r in corpus_pipeline.identify_language(spark, docs, "").collect()] == [(1, "fr")]


def test_near_duplicate_stage_keeps_one(stages):
    _, (_, before, out, *_) = stages
    kept = {r.doc_id for r in out.collect()}
    assert kept == {r.doc_id for r in before.collect()} - {*range(100, 105), *range(200, 205)}


def test_passage_stage_cuts_later_copies(stages):
    rows, (_, _, before, out, *_) = stages
    was, now = ({r.doc_id: r.text.split() for r in f.collect()} for f in (before, out))
    for i in was:
        later = i in (301, 302, 303)
        assert len(now[i]) == len(was[i]) - 80 * later and (later or now[i] == was[i])


def test_mix_and_tokens(stages):
    from tokenizers import Tokenizer

    from strandlake.llm import queries

    _, (*_, before, mixed, tokens) = stages
    assert 1.3 < sum(len(r.text.split()) for r in mixed.collect()) / sum(len(r.text.split()) for r in before.collect()) <= 1.5
    library = Tokenizer.from_file(queries.tokenizer_path())
    texts = {r.doc_id: r.text for r in mixed.collect()}
    got = tokens.collect()
    assert len(got) == mixed.count()
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == b"".join(x.to_bytes(4, "little") for x in ids) and r.n_tokens == len(ids)


def plain_pipeline(rows):
    """The pipeline's rule on (doc_id, text, lang, source) with distinct doc_ids, one document at a time."""
    docs = [r for r in sorted(rows) if any(map(str.isalpha, r[1] or ""))]
    # near duplicates: exact five-word shingles, smallest doc_id of a group stays
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t, *_ in docs for w in [t.lower().split()]}
    root = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a in root:
            for b in root:
                if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
                    moved = True
    docs = [r for r in docs if root[r[0]] == r[0]]
    # repeated passages of 50 words, cut up to the next word kept
    first, cut = {}, []
    for i, t, *_ in docs:
        w = t.split()
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    for i, t, lang, source in docs:
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        w = [t[a:b] for a, b in spans]
        gone = {k for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i for k in range(s, s + 50)}
        edges = [a for a, _ in spans] + [len(t)]
        text = (t[: edges[0]] if spans else t) + "".join(t[edges[k] : edges[k + 1]] for k in range(len(w)) if k not in gone)
        if text.split():
            cut.append((i, text, lang, source))
    # the mix: virtual finish times, until the budget is spent
    size = {i: len(t.split()) for i, t, *_ in cut}
    whole = {}
    for i, _, _, s in cut:
        whole[s] = whole.get(s, 0) + size[i]
    order = sorted(whole)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    budget = left = 1.5 * sum(whole.values())
    open_, target = set(order), {}
    while open_:
        full = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= 2 * whole[s]}
        target |= {s: 2.0 * whole[s] for s in full} or {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        if not full:
            break
        left -= sum(2 * whole[s] for s in full)
        open_ -= full
    queue, upto = [], {}
    for k, i, t, lang, s in sorted((hashlib.md5(f"{i}:{t}".encode()).hexdigest(), i, t, lang, s) for i, t, lang, s in cut):
        upto[s] = upto.get(s, 0) + size[i]
        queue += [((turn * whole[s] + upto[s]) / target[s], order.index(s), turn, k, i, t, s) for turn in (0, 1)]
    out, spent = [], 0
    for *_, i, t, s in sorted(queue):
        spent += size[i]
        if spent > budget:
            break
        out.append((i, s, t))
    return out


def test_run_equals_the_plain_version(spark, stages, tmp_path):
    from tokenizers import Tokenizer

    from strandlake.llm import queries

    rows, frames = stages
    frames[0].write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, s, t in plain_pipeline(rows):
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, s, len(ids), b"".join(x.to_bytes(4, "little") for x in ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(r.doc_id, r.source, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) > 40


def test_stages_take_nulls_empties_repeats_long_texts_and_clashing_names(spark):
    rng = random.Random(3)
    long = prose(rng, 30_000)
    rows = [(1, long, None, None, 0), (1, long, None, None, 0), (2, long + " end", "en", "s", 0), (3, None, None, "s", 0), (4, "", "en", None, 0), (None, "a b c", "de", "s", 0), (None, "a b c", "de", "s", 0), (5, "tie one two", "en", "s", 0), (6, "tie one two", "en", "s", 0)]
    clash = {"score": 1.5, "lang_pred": "x", "tk": 5, "spans": "y", "_tk": 6, "_id": "z", "_copies": 7, "copies": 8, "_spans": 9, "size": 10, "taken": 11, "target": 12, "ids": 13, "n_tokens": 14, "node": 15, "g": 16}
    names = COLUMNS + "".join(f", `{c}` {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for c, v in clash.items())
    docs = spark.createDataFrame([(*r, *clash.values()) for r in rows], names)
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, ""))
        assert stage(spark, docs.limit(0), "").count() == 0
        if name == "bpe":
            break
        assert out.columns == docs.columns and all(r[c] == v for r in out.collect() for c, v in clash.items()), name
        docs = out
        if name == "simhash_near_dedup":
            assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 0, 1, 5]
    assert {r.doc_id for r in out.collect()} <= {None, 1, 5} and out.count() > 0


def test_run_is_repeatable(spark):
    one, two = (sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()) for _ in range(2))
    assert one == two and one
