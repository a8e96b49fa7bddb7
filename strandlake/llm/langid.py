"""Language identification by hierarchical discrimination.

A first linear classifier, one machine per family against the rest, picks the language family; inside a
family, one linear support vector machine per pair of languages votes. Inputs are hashed byte
trigrams of the whole text. The machines are fitted on a sample of labelled rows of at most about
`sample_rows`, spread evenly over the languages; only their vectors come to the driver.

Defined results: null texts and texts without a letter are `und` with score 0; with no
labelled row everything is `und`; with one label everything else has that; rows with null doc_id
are held out; repeated rows and ties are scored alike; a text of any length counts as a whole, piece by
piece; the other columns are passed on, whatever their names, or not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_column, tidy
from .words import lots, text_buffers

#: Languages of a family by ISO 639-1 code. A language not named here is its own family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi mr ne bn gu pa",
    "semitic": "ar he mt am",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

DIMS = 2048
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GROUP_BYTES, _GROUP_ROWS = 1 << 19, 256


def vectors(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One unit vector per text: log counts of hashed trigrams of its bytes, a blank on either side. Long
    texts are counted piece by piece."""
    n = len(at) - 1
    counts = np.zeros(n * DIMS, dtype=np.float32)
    for first in range(int(at[0]), int(at[-1]), _GROUP_BYTES):
        last = min(int(at[-1]), first + _GROUP_BYTES)
        place = np.arange(first, last)
        doc = np.searchsorted(at, place, "right") - 1
        part = _LOWER[data[first:last]].astype(np.uint32)
        before = np.where(place > at[doc], _LOWER[data[np.maximum(place - 1, 0)]], 32).astype(np.uint32)
        after = np.where(place + 1 < at[doc + 1], _LOWER[data[np.minimum(place + 1, len(data) - 1)]], 32).astype(np.uint32)
        slot = ((before | part << np.uint32(8) | after << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(21)
        counts += np.bincount(doc * DIMS + slot, minlength=n * DIMS)
    counts = np.log1p(counts.reshape(n, DIMS))
    return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)


def _groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, at = text_buffers(column)
    for a, b in lots(at, _GROUP_BYTES, _GROUP_ROWS):
        yield a, b, data, at[a : b + 1]


@dataclass
class Model:
    families: list[tuple[str, list[str]]]
    family_weights: np.ndarray  # families x DIMS + 1
    pairs: dict[str, list[tuple[int, int]]]
    pair_weights: dict[str, np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x1 = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
        margin = x1 @ self.family_weights.T
        odds = np.exp(4 * (margin - margin.max(1, keepdims=True)))
        sure = odds.max(1) / odds.sum(1)
        pick, labels, score = margin.argmax(1), np.empty(len(x), dtype=object), np.zeros(len(x))
        for f, (name, languages) in enumerate(self.families):
            rows = np.flatnonzero(pick == f)
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(languages)))
            soft = np.zeros((len(rows), len(languages)))
            if self.pairs[name]:
                m = x1[rows] @ self.pair_weights[name].T
                p = 1 / (1 + np.exp(-4 * np.clip(m, -50, 50)))
                for k, (i, j) in enumerate(self.pairs[name]):
                    votes[:, i] += m[:, k] > 0
                    votes[:, j] += m[:, k] <= 0
                    soft[:, i] += p[:, k]
                    soft[:, j] += 1 - p[:, k]
                soft /= len(languages) - 1
            else:
                soft[:] = 1
            best = (votes + 1e-3 * soft).argmax(1)
            labels[rows] = np.array(languages, dtype=object)[best]
            score[rows] = sure[rows] * soft[np.arange(len(rows)), best]
        return labels.tolist(), np.clip(score, 0, 1)


def fit_svm(x: np.ndarray, y: np.ndarray, weight: float = 1e-4, rounds: int = 120) -> np.ndarray:
    """Linear support vector machine (squared hinge, classes weighted alike) by accelerated gradient."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 1 / (2 * max(1e-9, float((share * np.einsum('ij,ij->i', x, x)).sum())) + weight)
    w = z = np.zeros(x.shape[1], np.float32)
    t = 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        following = z - step * (weight * z - 2 * x.T @ (share * slack * y))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = following + (t - 1) / t2 * (following - w), following, t2
    return w


def fit(labelled: DataFrame, sample_rows: int = 4000) -> Model | None:
    """From (text, lang, u) with u a hash of the row, uniform over longs."""
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return None
    each = max(8, sample_rows // len(sizes))
    keep = F.lit(False)
    for lang, count in sizes.items():
        limit = F.lit(int(min(1.0, each / count) * (2**62)))
        keep = keep | ((F.col("lang") == lang) & (F.shiftrightunsigned("u", 2) <= limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in _groups(batch.column(0)):
                x = vectors(data, at).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    sample = labelled.where(keep).select("text", "lang").mapInArrow(tidy(run), "lang string, x binary").toArrow()
    lang = np.array(sample.column("lang").to_pylist(), dtype=object)
    x = np.stack([np.frombuffer(v, np.float16) for v in sample.column("x").to_pylist()]).astype(np.float32) if len(lang) else np.zeros((0, DIMS), np.float32)
    order = np.lexsort((x @ np.arange(DIMS), lang.astype(str))) if len(lang) else []
    x, lang = x[order], lang[order]
    by: dict[str, list[str]] = {}
    for code in sorted(sizes):
        by.setdefault(_FAMILY.get(code, code), []).append(code)
    families = sorted(by.items())
    family = np.array([_FAMILY.get(c, c) for c in lang], dtype=object)
    sign = lambda mask: np.where(mask, 1.0, -1.0)
    first = np.stack([fit_svm(x, sign(family == name)) for name, _ in families])
    pairs, weights = {}, {}
    for name, codes in families:
        pairs[name] = [(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes))]
        of = lambda i, j, codes=codes: np.isin(lang, [codes[i], codes[j]])
        fitted = [fit_svm(x[of(i, j)], sign(lang[of(i, j)] == codes[i])) for i, j in pairs[name]]
        weights[name] = np.stack(fitted).astype(np.float32) if fitted else np.zeros((0, DIMS + 1), np.float32)
    return Model(families, first.astype(np.float32), pairs, weights)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit_documents(docs: DataFrame, sample_rows: int = 4000) -> Model | None:
    """Learns from text and lang of documents that are not held out."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return fit(known.select("text", "lang", F.xxhash64(F.lit("langid"), "doc_id").alias("u")), sample_rows)


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """The kept columns (all, unless named), and the predicted language and its score under the given names,
    which must not be among the kept ones."""
    keep = docs.columns if keep is None else keep
    source = docs.select(*keep, *(() if "text" in keep else ("text",)))
    place, kept = source.columns.index("text"), [source.columns.index(c) for c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS floats per pair of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b, data, at in _groups(batch.column(place)):
                if model is None:
                    labels, sure = ["und"] * (b - a), np.zeros(b - a)
                else:
                    labels, sure = model.predict(vectors(data, at))
                    letters = np.array([_has_letter(data[at[i] : at[i + 1]]) for i in range(b - a)])
                    labels = [x if y else "und" for x, y in zip(labels, letters)]
                    sure = np.where(letters, sure, 0.0)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in kept), pa.array(labels, pa.string()), pa.array(sure.astype(np.float64))], names=[*keep, label, score])

    types = ", ".join(f"`{c}` {dict(source.dtypes)[c]}" for c in keep)
    return source.mapInArrow(tidy(run), f"{types}, `{label}` string, `{score}` double")


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs whose text has a letter, with a missing lang filled in by the best guess; other
    columns may have any names."""
    label = free_column(docs, "_lang_pred")
    found = predict(docs, model, label=label, score=free_column(docs, "_score")).where(F.col(label) != "und")
    return found.withColumn("lang", F.coalesce("lang", label)).select(*docs.columns)


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _has_letter(data: np.ndarray) -> bool:
    return bool(_LETTER[data].any()) or any(map(str.isalpha, data.tobytes().decode("utf-8", "replace")))
