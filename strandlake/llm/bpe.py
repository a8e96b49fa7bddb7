"""BPE encoding and decoding with forced-boundary splitting.

A pair of adjacent characters of the byte alphabet that occurs inside no vocabulary token can never
be merged over, so a cut there changes nothing. A 256 x 256 table over the bytes of a text marks the
pairs at which a pre-token must end as well (white space, and letters, digits and punctuation
side by side, where no token holds the pair); a text is cut there in one vectorised pass. What is
left is normalised and pre-tokenised by the tokenizer's own rules, cut at every forced boundary
inside, and each piece is merged by itself. Fragments repeat, so a worker keeps the ids of those it has met
(a table bounded in bytes, freed when a task of another kernel comes). Ids of fragments are then concatenated.

Defined results: null and empty texts have no tokens and decode to an empty text; texts of any
length are cut in one pass; rows, ties and repeats are independent; other columns are kept out.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, tidy
from .words import lots, text_buffers

#: Bytes of fragments, and of pieces, whose ids a worker remembers, about.
CACHE_BYTES, PIECE_BYTES = 40 << 20, 16 << 20
#: Text that goes back to Spark in one batch.
LOT_BYTES = 1 << 20


class Decoder:
    """What decode() gives without a decoder: the tokens, one space between them."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        named = {t: i for t, i in spec["model"]["vocab"].items()} | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t.encode() for t, i in named.items()}

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b" ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist() if i in tokens])


class ForcedBoundaryBPE(dict):
    """Maps a white-space-free UTF-8 fragment to its ids (little-endian unsigned 32-bit)."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        super().__init__()
        spec = json.loads(definition)
        self.rules = Tokenizer.from_str(definition)
        self.vocab = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"] or ""
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {tuple(m): i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        bare = [t.removesuffix(self.end) for t in self.vocab]
        self.inside = {t[i : i + 2] for t in bare for i in range(len(t) - 1)}
        assert not any(re.search(r"[\x20\x09-\x0D]", t) for t in self.vocab), "white space must be a forced boundary"
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the byte alphabet
        rest = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.cuts = self._table()
        self.pieces: dict[tuple[str, bool], list[int]] = {}
        self.held = self.held_pieces = 0
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _table(self) -> np.ndarray:
        """Whether a pair of bytes, at 256 * first + second, is a certain cut between pre-tokens. Only ASCII
        pairs of unlike kind, or of two digits, which are always apart, that no token holds."""
        kind = np.zeros(256, np.int64)
        kind[33:127], kind[48:58], kind[65:91], kind[97:123] = 3, 2, 1, 1
        unlike = (kind[:, None] != kind) | ((kind[:, None] == 2) & (kind == 2))
        table = unlike & (kind[:, None] > 0) & (kind > 0)
        for pair in self.inside | {t[i : i + 2] for t in self.special for i in range(len(t) - 1)}:
            if pair.isascii() and not (pair[0].isdigit() and pair[1].isdigit()):
                for a in {pair[0], pair[0].upper()}:
                    for b in {pair[1], pair[1].upper()}:
                        table[ord(a), ord(b)] = False
        return table.ravel()

    def fragments(self, text: bytes) -> list[bytes]:
        data = np.frombuffer(text, np.uint8)
        at = np.flatnonzero(self.cuts[(data[:-1].astype(np.uint16) << 8) | data[1:]]) + 1
        if len(at):
            out = np.full(len(data) + len(at), 32, np.uint8)
            keep = np.ones(len(out), bool)
            keep[at + np.arange(len(at))] = False
            out[keep] = data
            text = out.tobytes()
        return (text if b"<|" in text else text.lower()).split()

    def __missing__(self, fragment: bytes) -> bytes:
        ids: list[int] = []
        text = fragment.decode("utf-8", "replace")
        if text.isalpha() and text == text.lower() and max(text) < "\u0250":  # composed Latin letters are a pre-token as they are
            ids, text = self.word(fragment.decode("latin-1").translate(self.alphabet)), ""
        for i, part in enumerate(self.special_at.split(text) if self.special_at and text else [text]):
            if i % 2:
                ids.append(self.special[part])
            elif part:
                for word, _ in self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(part)):
                    ids += self.word(word)
        out = pack(f"<{len(ids)}I", *ids)
        if len(fragment) <= 256:
            self.held += len(fragment) + len(out) + 150
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = 0
            self[fragment] = out
        return out

    def word(self, word: str) -> list[int]:
        """Ids of a pre-token: each piece between forced boundaries is merged alone."""
        ids, start, inside = [], 0, self.inside
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in inside:
                ids += self.piece(word[start:i], False)
                start = i
        return ids + self.piece(word[start:], True)

    def piece(self, text: str, last: bool) -> list[int]:
        ids = self.pieces.get((text, last))
        if ids is None:
            parts = list(text)
            if last:
                parts[-1] += self.end
            ids = self.merge(parts) if len(parts) > 24 else self.merge_short(parts)
            if len(text) <= 64:
                self.held_pieces += len(text) + 8 * len(ids) + 300
                if self.held_pieces > PIECE_BYTES:
                    self.pieces.clear()
                    self.held_pieces = 0
                self.pieces[text, last] = ids
        return ids

    def merge_short(self, parts: list[str]) -> list[int]:
        rank, far = self.ranks.get, len(self.ranks)
        order = [rank(p, far) for p in zip(parts, parts[1:])]
        while order and (least := min(order)) < far:
            i = order.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i:
                order[i - 1] = rank((parts[i - 1], parts[i]), far)
            if i < len(order):
                order[i] = rank((parts[i], parts[i + 1]), far)
        return [self.vocab[p] for p in parts if p in self.vocab]

    def merge(self, parts: list[str]) -> list[int]:
        """Merges in order of rank, then place; a heap over a linked list."""
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if parts[i] != pair[0] or j >= n or parts[j] != pair[1]:
                continue
            parts[i], parts[j], after[i] = pair[0] + pair[1], "", after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (parts[i], parts[after[i]])) in ranks:
                    heapq.heappush(heap, (ranks[p], i, p))
            if before[i] >= 0 and (p := (parts[before[i]], parts[i])) in ranks:
                heapq.heappush(heap, (ranks[p], before[i], p))
        return [self.vocab[p] for p in parts if p and p in self.vocab]

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, self.fragments(text)))


def encode_texts(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The kept columns, ids (little-endian unsigned 32-bit numbers, binary) and n_tokens; with `decoded`
    also what the ids decode to (string), by the same task."""
    text_of = _read(tokenizer_path)
    definition = docs.sparkSession.sparkContext.broadcast(text_of)  # a vocabulary file: under 2 MB
    key = f"bpe/{xxhash.xxh64_hexdigest(text_of)}"
    names = [*keep, "ids", "n_tokens", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, back = kept(key, lambda: (ForcedBoundaryBPE(definition.value), Decoder(definition.value)))
        for batch in batches:
            data, at = text_buffers(batch.column(len(keep)))
            for a, b in lots(at, LOT_BYTES):
                ids = [bpe.encode(data[at[i] : at[i + 1]].tobytes()) for i in range(a, b)]
                out = [*batch.slice(a, b - a).columns[: len(keep)], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(map(back.decode, ids), pa.binary()).cast(pa.string())] if decoded else [])], names=names)

    source = docs.select(*keep, text)
    types = ", ".join(f"`{c}` {t}" for c, t in source.dtypes[:-1])
    return source.mapInArrow(tidy(run, key), f"{types}, ids binary, n_tokens long" + (", decoded string" if decoded else ""))


def decode_ids(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds decoded (string) to a frame with ids as made by encode_texts."""
    definition = encoded.sparkSession.sparkContext.broadcast(_read(tokenizer_path))
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = None
        for batch in batches:
            back = back or Decoder(definition.value)
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [back.decode(x.as_py() or b"") for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(tidy(run), ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes) + ", decoded string")


def token_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    found = encode_texts(docs, tokenizer_path, decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
