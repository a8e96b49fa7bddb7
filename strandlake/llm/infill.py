"""Fill-in-the-middle transformation: every text is cut at two ranks and put together in another order.

Ranks count units (code points, or words with the white space after them). A text gets an indexable
skip list: a link of the lowest lane passes over SPAN units, one of each express lane over FAN links of the lane
below, and every link carries how many units, code points and bytes it passes over. A rank is found from the top
lane down, along each lane as far as the sum of unit widths allows; the sums of the other widths are
then the place in code points and bytes. The list is built piece by piece and keeps one row per link of SPAN
units, so a text costs little more than its bytes.

Defined results: null text counts as empty; an empty text, or one that holds a sentinel, is plain (unchanged,
no cuts); null doc_id hashes as an empty number; repeated rows give the same output; texts of any length are cut
as a whole; an empty table gives no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .words import lots, text_buffers

SPAN, FAN, PIECE = 64, 16, 1 << 20
SENTINELS = ("<P>", "<S>", "<M>")
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def point_starts(data: np.ndarray) -> np.ndarray:
    return np.flatnonzero((data & 0xC0) != 0x80)


def unit_starts(data: np.ndarray, unit: str, last: int | None = None) -> np.ndarray:
    """Where units start in a piece of UTF-8; last: the byte before it, None at the start of a text."""
    if unit == "point":
        return point_starts(data)
    space = _SPACE[data]
    before = np.concatenate([[last is None or _SPACE[last]], space[:-1]])
    begin = before & ~space
    begin[0] |= last is None
    return np.flatnonzero(begin)


class SkipList:
    """lanes[k][i]: units, code points and bytes that link i of lane k passes over."""

    def __init__(self, data: np.ndarray, unit: str = "point"):
        self.data, self.unit = data, unit
        marks, units, points = [np.zeros((0, 3), np.int64)], 0, 0
        for first in range(0, len(data), PIECE):
            part = data[first : first + PIECE]
            starts, at = unit_starts(part, unit, int(data[first - 1]) if first else None), point_starts(part)
            k = np.arange(-units % SPAN, len(starts), SPAN)
            marks.append(np.stack([units + k, points + np.searchsorted(at, starts[k]), first + starts[k]], 1))
            units, points = units + len(starts), points + len(at)
        self.units, self.points = units, points
        marks.append(np.array([[units, points, len(data)]]))
        self.lanes = [np.diff(np.concatenate(marks), axis=0)]
        while len(self.lanes[-1]) > FAN:
            below = self.lanes[-1]
            self.lanes.append(np.add.reduceat(below, np.arange(0, len(below), FAN)))

    def seek(self, rank: int) -> tuple[int, int]:
        """Code points and bytes before unit `rank` (0 to units)."""
        i, at = 0, np.zeros(3, np.int64)
        for lane in reversed(self.lanes):
            i *= FAN
            while i < len(lane) and at[0] + lane[i, 0] <= rank:
                at += lane[i]
                i += 1
        units, points, byte = at.tolist()
        if units < rank:  # inside one link of the lowest lane
            part = self.data[byte : byte + int(self.lanes[0][i, 2])]
            starts = unit_starts(part, self.unit, int(self.data[byte - 1]) if byte else None)
            to = int(starts[rank - units])
            points, byte = points + len(point_starts(part[:to])), byte + to
        return points, byte


def draws(doc_id: int | None) -> list[int]:
    """The first four 32-bit numbers of SHA-256 of `1:` and the decimal doc_id."""
    told = hashlib.sha256(b"1:" if doc_id is None else b"1:%d" % doc_id).digest()
    return [int.from_bytes(told[i : i + 4], "big") for i in range(0, 16, 4)]


def infill(docs: DataFrame, unit: str = "point", percent: int = 90, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output for every row.

    form is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle), each part behind its sentinel."""
    p, s, m = (x.encode() for x in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            for first, last in lots(at, 1 << 22):
                found = []
                for i in range(first, last):
                    units, text = SkipList(data[at[i] : at[i + 1]], unit), data[at[i] : at[i + 1]].tobytes()
                    n, (h1, h2, h3, h4) = units.units, draws(ids[i])
                    if not n or p in text or s in text or m in text or h3 % 100 >= percent:
                        found.append((n, "plain", None, None, text))
                        continue
                    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                    (from_, a), (to, b) = units.seek(low), units.seek(high)
                    if h4 % 100 < spm_percent:
                        found.append((n, "spm", from_, to - from_, b"".join((s, text[b:], p, text[:a], m, text[a:b]))))
                    else:
                        found.append((n, "psm", from_, to - from_, b"".join((p, text[:a], s, text[b:], m, text[a:b]))))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]
                output = pa.array([x[4] for x in found], pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *columns, output], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(tidy(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str | Column, form: str | Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of infill was made of."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    p, s, m = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(one) + len(second) + 1, F.length(output))
        two = F.substring_index(rest, m, 1)
        return one, two, F.substring(rest, F.length(two) + len(m) + 1, F.length(output))

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def infill_digests(docs: DataFrame) -> DataFrame:
    """infill over code points, with digests of the output and of the text restored from it."""
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    found = infill(docs)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored("output", "form")).alias("restored_sha256"))


#: The same cuts by substrings.
SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
x as (select doc_id, t, n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from x)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then t
                        when 'psm' then '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1, n) || '<M>' || substring(t, a + 1, b - a)
                        else '<S>' || substring(t, b + 1, n) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) end) as output_sha256,
       sha256(t) as restored_sha256
from f
"""
