"""CIGAR functions (P9 to P15, F12). A CIGAR is an array of (op, len). Sums are built-in functions; what walks along
operations or bases is worked out for a batch of rows at once (batches.py), as a lambda would be interpreted base by
base. Such a column is a Python one: it goes into no lambda, and through `once` where filters lie over it.

Aligners that write M leave open whether bases agree; resolve_aligned tells by comparing them, once after the
scan. Until then M uses up both sides, counts as a match where a CIGAR is trimmed, and identity is null.

All operations of SAM are placed by what they use up: N moves along the reference and counts for nothing else (it is
no deletion and covers nothing), H and P use up neither side and have no place; trimming leaves them out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ALIGNED, CIGAR, DELETION, INSERTION, MATCH, MISMATCH, ON_READ
from . import batches
from .arrays import _c


def expand(cigar: str | Column) -> Column:
    """One operation code per consumed place."""
    return batches.column(batches.expand, "array<int>", cigar)


def encode(ops: str | Column) -> Column:
    return batches.column(batches.encode, CIGAR, ops)


def from_edits(ops: str | Column, lead: str | Column, tail: str | Column) -> Column:
    """struct(cigar, ed) from operation codes and the clips around them."""
    return batches.column(batches.from_edits, f"struct<cigar: {CIGAR}, ed: int>", ops, lead, tail)


def total(cigar: str | Column, *ops: int) -> Column:
    """Summed length of some operations."""
    return F.aggregate(_c(cigar), F.lit(0), lambda acc, c: acc + F.when(c["op"].isin(*ops), c["len"]).otherwise(0))


def resolve_aligned(cigar: str | Column, seq: str | Column, ref_seq: str | Column, pos: str | Column) -> Column:
    """The CIGAR with M told apart into = and X by the bases of read and reference; others as they are."""
    return batches.column(batches.resolve_aligned, CIGAR, cigar, F.upper(_c(seq)), F.upper(_c(ref_seq)), pos)


#: What a trim gives.
TRIMMED = f"struct<cigar: {CIGAR}, shift: int, removed: int>"


def trim_to_window(cigar: str | Column, window: int = 8, least: int = 6) -> Column:
    """P10: struct(cigar, shift, removed): from the first match of the first window of operations, past a
    leading clip, that has enough matches; what lies before is clipped. An empty CIGAR if none has."""
    return batches.column(batches.trim_to_window, TRIMMED, cigar, F.lit(window), F.lit(least))


def trim_to_matches(cigar: str | Column) -> Column:
    """struct(cigar, shift, removed) from the first to the last match (= or M)."""
    return batches.column(batches.trim_to_matches, TRIMMED, cigar)


def clip_shifts(before: str | Column, after: str | Column) -> Column:
    """struct(five, three): by how much the clip at the end and at the start has grown."""
    return batches.column(batches.clip_shifts, "struct<five: int, three: int>", before, after)


def identity(cigar: str | Column) -> Column:
    """Matches over matches, mismatches, insertions and deletions; null while M is not resolved."""
    n = total(cigar, MATCH, MISMATCH, INSERTION, DELETION)
    return F.when((n > 0) & (total(cigar, ALIGNED) == 0), total(cigar, MATCH) / n)


def is_consistent(cigar: str | Column, seq_length: str | Column) -> Column:
    """Query-consuming operations add up to the sequence."""
    return total(cigar, *ON_READ) == _c(seq_length)


def is_fragment(cigar: str | Column, ref_length: str | Column, share: float = 0.15) -> Column:
    """deletions make up a share of the reference or more."""
    return total(cigar, DELETION) / _c(ref_length) >= share


def placed(cigar: str | Column, pos: str | Column) -> Column:
    """The operations with where each begins: array of (op, len, q, r)."""
    return batches.column(batches.placed, "array<struct<op: int, len: int, q: int, r: int>>", cigar, _c(pos).cast("int"))


def region_counts(cigar: str | Column, pos: str | Column, start: Column, end: Column) -> Column:
    """struct(match, ins, cov, del) of the places of [start, end) that an alignment covers, by
    overlaps of its operations. An insertion counts where the reference position before it does. M must be resolved."""
    return batches.column(batches.region_counts, "struct<match: int, ins: int, cov: int, del: int>", cigar, pos, start, end)
