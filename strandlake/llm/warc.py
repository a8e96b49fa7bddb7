"""WARC archives written and read through a chunked record table.

Payloads are cut into rows of record identifier and chunk number before anything is shuffled, so no later step
holds a whole payload; the digest is carried from chunk to chunk and stands in the last one's row. Which of
equal payloads is the response is decided on digests alone. In the file each chunk of a longer payload is a
segment of the record (the format's own continuation records). A record's segments never part: files are made
of whole records, about `file_bytes` of payload each. Files are written and read by Spark (gzip, one record
after another), so any store that Spark knows can hold them.

A chunk never holds or completes the byte string that separates records in the reader: it is cut inside.

Defined results: null html is an empty payload; null url leaves its header out; rows that share the largest
page_id of a payload are responses all, and so are rows with null page_id; payloads of any length are
chunked; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, tidy
from .words import text_buffers

CHUNK = 1 << 16
_BREAK = b"\r\n\r\n"
_VERSION = b"WARC/1.1"
_TRAP = _BREAK + _VERSION
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunks_of(payload: memoryview | bytes, size: int = CHUNK) -> Iterator[bytes]:
    """Pieces of UTF-8 text, cut between characters and inside every separator look-alike; one at least."""
    at, n = 0, len(payload)
    if not n:
        yield b""
    while at < n:
        end = min(n, at + size)
        while end < n and end > at + 1 and payload[end] & 0xC0 == 0x80:
            end -= 1
        piece = bytes(payload[at:end])
        trap = (_BREAK + piece).find(_TRAP)  # the header before it ends in a break as well
        if trap >= 0:
            end = at + trap + len("WARC/")
            piece = piece[: end - at]
        yield piece
        at = end


def base32_sha1(pieces) -> tuple[str, int]:
    sha, n = hashlib.sha1(), 0
    for p in pieces:
        sha.update(p)
        n += len(p)
    return base64.b32encode(sha.digest()).decode(), n


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def _field(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def chunk_table(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunked record table: record, number, last, page_id, url (of the first chunk), sha and bytes (of the
    whole payload, at its last chunk), chunk. It is stored, so a record keeps its number."""
    names = ["record", "number", "last", "page_id", "url", "sha", "bytes", "chunk"]
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records, ids, urls = (batch.column(i).to_pylist() for i in range(3))
            data, at = text_buffers(batch.column(3))
            held, out = 0, []
            for i in range(batch.num_rows):
                payload, sha, done, number = data[at[i] : at[i + 1]].data, hashlib.sha1(), 0, 0
                for piece in chunks_of(payload, size):
                    sha.update(piece)
                    number, done = number + 1, done + len(piece)
                    last = done >= len(payload)
                    out.append((records[i], number, last, ids[i], urls[i] if number == 1 else None, base64.b32encode(sha.digest()).decode() if last else None, done if last else None, piece))
                    held += len(piece)
                    if held > 1 << 21:
                        yield _batch(out, kinds, names)
                        held, out = 0, []
            if out:
                yield _batch(out, kinds, names)

    source = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return materialize(source.mapInArrow(tidy(run), "record long, number long, last boolean, page_id long, url string, sha string, bytes long, chunk binary"))


def _batch(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def record_roles(chunks: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """record, keeper (the response's page_id where the record revisits it, else null), sha, bytes: a row per record."""
    ends = chunks.where("last").select("record", "page_id", "sha", "bytes")
    keepers = materialize(ends.groupBy("sha", "bytes").agg(F.max("page_id").alias("keeper")))  # stored, so that the join can be split at a hot digest
    again = (F.col("page_id") < F.col("keeper")) & (F.col("bytes") >= min_revisit_bytes)
    return ends.join(keepers, ["sha", "bytes"]).select("record", F.when(again, F.col("keeper")).alias("keeper"), "sha", "bytes")


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", chunk: int = CHUNK, min_revisit_bytes: int = 0, file_bytes: int = 64 << 20, records_per_file: int = 1_000_000) -> None:
    """Writes a record per row of pages. A record's role goes before its chunks to the task that writes it; a
    file has about file_bytes of payload and records_per_file records at most on average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeper, digest, held, done, origin, out = None, "", 0, 0, "", []
        for batch in batches:
            for number, last, page, url, sha, refers, piece in zip(*(batch.column(c).to_pylist() for c in ("number", "last", "page_id", "url", "sha", "keeper")), batch.column("chunk")):
                if number == 0:
                    keeper, digest, done = refers, sha, 0
                    continue
                common = [f"WARC-Date: {date}", f"WARC-Page-ID: {'' if page is None else page}"] + ([f"WARC-Target-URI: {_field(url)}"] if url is not None else [])
                if number == 1:
                    origin = _record_id(page, digest)
                if keeper is not None:
                    if number == 1:
                        head = ["WARC-Type: revisit", f"WARC-Record-ID: {origin}", *common, f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(keeper, digest)}", f"WARC-Refers-To-Page-ID: {keeper}", "Content-Length: 0"]
                        out.append(_record(head, b""))
                    continue
                block = piece.as_py()
                done += len(block)
                if number == 1:
                    head = ["WARC-Type: response", f"WARC-Record-ID: {origin}", *common, f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html"]
                    head += [] if last else ["WARC-Segment-Number: 1"]
                else:
                    head = ["WARC-Type: continuation", f"WARC-Record-ID: {_record_id(f'{page}/{number}', digest)}", *common, f"WARC-Segment-Number: {number}", f"WARC-Segment-Origin-ID: {origin}"]
                    head += [f"WARC-Segment-Total-Length: {done}"] if last else []
                out.append(_record([*head, f"Content-Length: {len(block)}"], block))
                held += len(block)
                if held > 1 << 21:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])
                    held, out = 0, []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])

    spark = pages.sparkSession
    chunks = chunk_table(pages, chunk)
    roles = materialize(record_roles(chunks, min_revisit_bytes))
    total = roles.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    files = max(shuffle_partitions(spark), -(-total["bytes"] // file_bytes), -(-total["n"] // records_per_file))
    begin = roles.select("record", F.lit(0).cast("long").alias("number"), "sha", "keeper")
    rows = chunks.drop("sha", "bytes").unionByName(begin, allowMissingColumns=True)
    dealt = rows.repartition(int(files), "record").sortWithinPartitions("record", "number")
    dealt.mapInArrow(tidy(run), "value string").write.option("lineSep", _BREAK.decode()).option("compression", "gzip").text(path)


def _record(head: list[str], block: bytes) -> bytes:
    return b"\r\n".join([_VERSION, *(h.encode() for h in head)]) + _BREAK + block


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """page_id, kind, segment, last, refers_to, digest, chunk: the record table of archives.

    A gzip file is read by one task from its start, and holds whole records, so their chunks are in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for value in batch.column(0).cast(pa.binary()):
                head, _, block = value.as_py().partition(_BREAK)
                lines = [x for x in head.decode().split("\r\n") if x and x != _VERSION.decode()]
                field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
                size = int(field["Content-Length"])
                number = int(field.get("WARC-Segment-Number", 1))
                last = "WARC-Segment-Total-Length" in field or (number == 1 and "WARC-Segment-Number" not in field)
                number_of = lambda k: int(field[k]) if field.get(k, "") else None
                row = (number_of("WARC-Page-ID"), field["WARC-Type"], number, last, number_of("WARC-Refers-To-Page-ID"), field.get("WARC-Payload-Digest", "").removeprefix("sha1:"), block[:size])
                for column, x in zip(out, row):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.binary()))], names=["page_id", "kind", "segment", "last", "refers_to", "digest", "chunk"])

    text = spark.read.option("lineSep", f"{_TRAP.decode()}\r\n").text(path)
    return text.mapInArrow(tidy(run), "page_id long, kind string, segment long, last boolean, refers_to long, digest string, chunk binary")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; lengths and digests
    are carried over the chunks as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, size, due = hashlib.sha1(), 0, 1
        for batch in batches:
            out: list[tuple] = []
            for page, kind, segment, last, refers, digest, chunk in zip(*(c.to_pylist() if i < 6 else c for i, c in enumerate(batch.columns))):
                if kind == "revisit":
                    out.append((page, None, digest, kind, refers))
                    continue
                if segment != due:
                    raise ValueError(f"record of page {page}: segment {segment} where {due} is due")
                sha.update(chunk.as_buffer())
                size, due = size + len(chunk.as_buffer()), due + 1
                if last:
                    out.append((page, size, base64.b32encode(sha.digest()).decode(), "response", None))
                    sha, size, due = hashlib.sha1(), 0, 1
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return read_chunks(spark, path).mapInArrow(tidy(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Gives revisits the length and digest of the response that they refer to."""
    records = materialize(records)  # archives are parsed once
    full = records.where("record_type = 'response' and page_id is not null").groupBy("page_id", "payload_digest").agg(F.first("payload_bytes").alias("size"))
    full = materialize(full)  # stored, so that the join can be split at a page that many refer to
    again = records.where("record_type = 'revisit'").alias("r").join(full.alias("f"), (F.col("r.refers_to") == F.col("f.page_id")) & (F.col("r.payload_digest") == F.col("f.payload_digest")))
    again = again.select("r.page_id", F.col("f.size").alias("payload_bytes"), "f.payload_digest", "r.record_type", "r.refers_to")
    return records.where("record_type = 'response'").unionByName(again)
