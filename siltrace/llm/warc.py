"""WARC archives as tables of chunks.

An archive is a table of rows ``archive, record, chunk, data, running``: the bytes of a
record's rows in chunk order are one WARC/1.1 record, and records one after another are a
WARC file. No step builds a whole record: a writer emits a payload chunk by chunk with the
SHA-1 of all payload bytes so far, and a reader goes through sorted rows with the state of
one record.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.llm.near_dup import FILTER_BITS, _bitmap
from siltrace.session import small_batches, stored

CHUNK = 1 << 16
ARCHIVE_SCHEMA = "archive int, record bigint, chunk int, data binary, running string"


def _head(row: dict) -> bytes:
    response = row["refers_to"] is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{row['id']}>",
        f"WARC-Target-URI: {' '.join((row['url'] or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['sha1']}",
        "Content-Type: application/http; msgtype=response",
    ]
    if not response:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    lines.append(f"Content-Length: {len(http) + (row['size'] if response else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _parts(row: dict, payload: pa.Scalar, size: int):
    """(bytes, SHA-1 of the payload bytes so far) of one record: head, payload chunks, end."""
    digest = hashlib.sha1()
    yield _head(row), digest.hexdigest()
    if row["refers_to"] is None and payload.is_valid:
        view = memoryview(payload.as_buffer())
        for at in range(0, len(view), size):
            part = view[at : at + size].tobytes()
            digest.update(part)
            yield part, digest.hexdigest()
    yield b"\r\n\r\n", digest.hexdigest()


def _dealt(batches, bits, marked: bool):
    """The rows whose bit is set (``marked``) or not; rows without a bit count as not set."""
    for batch in batches:
        bit = np.asarray(batch.column(batch.schema.get_field_index("bit")).fill_null(-1), np.int64)
        there = (bit >= 0) & ((bits.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1)
        yield batch.filter(pa.array(there == marked))


def _written(batches, size: int):
    for batch in batches:
        columns = {n: c for n, c in zip(batch.schema.names, batch.columns)}
        html = columns.pop("html")
        out, held = [], 0
        for i, row in enumerate(pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).to_pylist()):
            for k, (data, running) in enumerate(_parts(row, html[i], size)):
                out.append((row["archive"], row["record"], k, data, running))
                held += len(data)
                if held > 4 << 20:
                    yield _batch(out)
                    out, held = [], 0
        if out:
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["archive", "record", "chunk", "data", "running"])


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, chunk: int = CHUNK) -> DataFrame:
    """The archive table of ``pages``, stored in the shared folder: one record for each row.

    The payload is the text in UTF-8 (null: empty). Of records with equal payloads of at least
    ``least`` bytes, those with the largest id are responses and the others revisit it;
    smaller payloads are all responses. Only rows whose payload's digest may be a repeated one, by a
    bitmap of 8 MB, are shuffled to meet it; all others are written where they are read. Where every equal row's id is null, all are responses.
    Repeated rows get a record each. An empty table gives an empty archive.
    """
    small_batches(pages.sparkSession)
    source = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    known = source.select("*", F.octet_length(F.coalesce("html", F.lit(""))).cast("bigint").alias("size"), F.sha1(body).alias("sha1"), F.when(F.octet_length("html") >= least, F.sha2(body, 256)).alias("same"))
    big = known.where("same is not null").select("same", "id")
    last = stored(big.groupBy("same").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("same", "last"), "warc-repeated")
    dealt = known.withColumn("bit", F.pmod(F.when(F.col("same").isNotNull(), F.xxhash64("same")), F.lit(1 << FILTER_BITS)))
    bits = pages.sparkSession.sparkContext.broadcast(_bitmap(last.select(F.col("same").alias("id"))))

    def written(rows: DataFrame, refers_to, k: int, deal=lambda batches: batches) -> DataFrame:
        # the two parts of an archive get even and odd numbers
        numbered = rows.select("id", "url", "html", "size", "sha1", refers_to.alias("refers_to"), (F.spark_partition_id() * 2 + k).alias("archive"), (F.monotonically_increasing_id() * 2 + k).alias("record"), *(["bit"] if k == 0 else []))
        return numbered.mapInArrow(lambda batches: _written(deal(batches), chunk), ARCHIVE_SCHEMA)

    alone = written(dealt, F.lit(None).cast("bigint"), 0, lambda batches: _dealt(batches, bits, False))
    maybe = dealt.mapInArrow(lambda batches: _dealt(batches, bits, True), dealt.schema)
    met = written(maybe.join(last, "same", "left"), F.expr("if(id <=> last, null, last)"), 1)
    return stored(alone.unionByName(met), "warc")


def _fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")[1:])}


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isdecimal() else None


class _Record:
    """Reads one record's bytes as they come; ``fields`` stay empty where no head can be read."""

    def __init__(self):
        self.head, self.fields, self.http, self.left, self.digest, self.seen = b"", {}, {}, None, hashlib.sha1(), 0
        self.next, self.gap, self.rest = 0, False, b""

    def add(self, chunk: int, data: bytes) -> None:
        self.gap |= chunk != self.next
        self.next = chunk + 1
        if self.left is None and not self.gap:
            self.head += data
            if self.head.count(b"\r\n\r\n") < 2:
                return
            warc, http, data = self.head.split(b"\r\n\r\n", 2)
            self.head = b""
            length = _number(_fields(warc).get("content-length"))
            if warc.startswith(b"WARC/1.1\r\n") and length is not None:
                self.fields, self.http, self.left = _fields(warc), _fields(http), max(0, length - len(http) - 4)
            else:
                self.gap = True
        part = data if self.left is None else data[: self.left]
        if self.left is not None:
            self.left -= len(part)
            self.rest = (self.rest + data[len(part) :])[:5]
        self.digest.update(part)
        self.seen += len(part)

    def row(self) -> tuple:
        def page(name):
            x = self.fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
            return int(x) if x.removeprefix("-").isdecimal() else None

        kind, stated = self.fields.get("warc-type"), self.fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind is None:
            return None, self.seen, None, None, None, False
        read = kind == "response"
        whole = not self.gap and self.left == 0 and self.rest == b"\r\n\r\n" and (not read or self.digest.hexdigest() == stated)
        return page("warc-record-id"), self.seen if read else _number(self.http.get("content-length")), self.digest.hexdigest() if read else stated, kind, page("warc-refers-to"), whole


def _read(batches):
    now, record = None, None
    for batch in batches:
        out = []
        for key, chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if key != now:
                if record:
                    out.append(record.row())
                now, record = key, _Record()
            record.add(chunk, data.as_py())
        if out:
            yield _records(out)
    if record:
        yield _records([record.row()])


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole"])


def read_archives(archive: DataFrame) -> DataFrame:
    """``id, payload_bytes, payload_digest, record_type, refers_to, whole`` of each record.

    Sizes and digests of responses are those of the bytes read; a revisit states those of the
    payload it stands for. ``whole`` is false where bytes, a chunk or the end mark are missing or the digest differs.
    A record whose head is missing or can't be read has the size of its bytes, and null otherwise. An empty
    archive gives no rows; columns besides those of an archive are not looked at.
    """
    small_batches(archive.sparkSession)
    rows = archive.repartition("record").sortWithinPartitions("record", "chunk").select("record", "chunk", "data")
    return rows.mapInArrow(_read, "id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, whole boolean")
