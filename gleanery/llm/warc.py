"""WARC archives as a table of chunks, written and read without holding a record in memory.

A record is cut into chunks of at most `CHUNK` bytes: rows of archive, record, chunk number and bytes. Chunk 0 is the WARC
header, the others carry the payload, and each has the SHA-256 of the payload up to its end. The bytes of an archive's rows in
order are a plain WARC file. The reader streams over the chunks of a record, parses the header, digests the payload as it comes
and checks length and digest against the header.

Scale: records that are equal in payload are found over 32-byte digests with ids, combined on the map side, so a payload that a
third of all pages share is one row per task. Only the revisits (page and response ids) are joined to the pages; payloads of
revisits are not stored. Writing needs no shuffle of payloads while the revisits are few; reading deals chunks by record.

Defined results: a null html is an empty payload; payloads below `REVISIT_LEAST` bytes are always responses. Of equal payloads
the smallest page_id is the response; rows that repeat that page_id with that payload are responses too. Rows of one page_id with
different payloads are judged each by its own payload. Rows without page_id are responses. Empty tables give empty archives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.staging import staged

CHUNK = 256 * 1024
REVISIT_LEAST = 100
_EMPTY = hashlib.sha256().hexdigest()

_CHUNKS = "archive int, record long, chunk int, data binary, upto long, digest string"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload a page with a smaller id has."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    digests = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.unhex(F.sha2(payload.cast("binary"), 256)).alias("digest"),
        F.octet_length(payload).alias("n"),
    ).where(F.col("n") >= REVISIT_LEAST)
    digests = staged(digests.drop("n"), "payloads")
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    repeated = staged(firsts.where("n > 1").drop("n"), "repeated")
    return digests.join(repeated, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to")


def _header(page_id: int | None, url: str, size: int, digest: str, refers_to: int | None) -> bytes:
    body = size if refers_to is None else 0
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        # A url from the web may hold line ends, which would end the header field.
        f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {body}",
    ]
    if refers_to is not None:
        lines.insert(3, f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.insert(4, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join([*lines, "", ""]).encode()


def record_chunks(
    page_id: int | None, url: str, payload: memoryview, refers_to: int | None, size: int = CHUNK
) -> Iterator[tuple[int, bytes, int, str]]:
    """Chunk number, bytes, payload bytes and payload digest up to the chunk's end."""
    full = hashlib.sha256(payload).hexdigest()
    yield 0, _header(page_id, url, len(payload), full, refers_to), 0, _EMPTY
    if refers_to is None:
        running, number = hashlib.sha256(), 0
        for start in range(0, len(payload), size):
            part, number = payload[start : start + size], number + 1
            running.update(part)
            yield number, bytes(part), start + len(part), running.hexdigest()
        yield number + 1, b"\r\n\r\n", len(payload), full
    else:
        yield 1, b"\r\n\r\n", 0, _EMPTY


def write_archives(pages: DataFrame, name: str = "archive") -> DataFrame:
    """Write one record per page; the chunk table."""
    links = staged(revisits(pages), "revisits")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        html.alias("html"),
        F.unhex(F.sha2(html.cast("binary"), 256)).alias("digest"),
    ).join(links.dropDuplicates(["page_id", "digest"]), ["page_id", "digest"], "left")
    return staged(rows.drop("digest").mapInArrow(_write, _CHUNKS), name)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    archive, record, out, held = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            page_id, refers_to = batch.column("page_id")[i].as_py(), batch.column("refers_to")[i].as_py()
            payload = memoryview(batch.column("html")[i].as_buffer() or b"")
            for number, data, upto, digest in record_chunks(page_id, batch.column("url")[i].as_py(), payload, refers_to):
                out.append((archive, record, number, data, upto, digest))
                held += len(data)
                if held >= 4 * CHUNK:
                    yield _chunk_batch(out)
                    out, held = [], 0
            record += 1
    if out:
        yield _chunk_batch(out)


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string())
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["archive", "record", "chunk", "data", "upto", "digest"])


class RecordReader:
    """Fed the chunks of records in order; `done` returns the finished record's row."""

    def __init__(self, header: bytes) -> None:
        fields = dict(line.split(": ", 1) for line in header.decode().split("\r\n")[1:] if line)
        page, refers = fields["WARC-Record-ID"][10:-1], fields.get("WARC-Refers-To", "")[10:-1]
        self.page_id = int(page) if page else None
        self.refers_to = int(refers) if refers else None
        self.kind = fields["WARC-Type"]
        self.expected = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        self.full, self.left = int(fields["X-Payload-Length"]), int(fields["Content-Length"])
        self.running = hashlib.sha256()

    def feed(self, data: memoryview) -> None:
        part = data[: self.left]
        self.left -= len(part)
        self.running.update(part)

    def done(self) -> tuple:
        if self.left or (self.kind == "response" and self.running.hexdigest() != self.expected):
            raise ValueError(f"record of page {self.page_id}: the payload does not match its header")
        return self.page_id, self.full, self.expected, self.kind, self.refers_to


def read_archives(chunks: DataFrame) -> DataFrame:
    """One row per record of the archives, from what the records say."""
    dealt = chunks.select("archive", "record", "chunk", "data").repartition("archive", "record")
    return dealt.sortWithinPartitions("archive", "record", "chunk").mapInArrow(_read, _RECORDS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, kinds = None, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for batch in batches:
        out = []
        numbers, data = batch.column("chunk").to_pylist(), batch.column("data")
        for i, number in enumerate(numbers):
            part = memoryview(data[i].as_buffer())
            if number == 0:
                if reader is not None:
                    out.append(reader.done())
                reader = RecordReader(bytes(part))
            else:
                reader.feed(part)
        if out:
            yield _rows(out, kinds, names)
    if reader is not None:
        yield _rows([reader.done()], kinds, names)


def _rows(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def export_archive(chunks: DataFrame, archive: int, path: str) -> None:
    """One archive as a plain WARC file on the caller's disk, streamed partition by partition."""
    rows = chunks.where(F.col("archive") == archive).orderBy("record", "chunk").select("data")
    with open(path, "wb") as file:
        for row in rows.toLocalIterator():
            file.write(row["data"])
