"""WARC archives of pages: one gzip member a record, and a sequential reader.

Payloads are compared by digest before they are written: the page with the
largest id of each group of equal payloads becomes a response record, the others
revisit it and hold the HTTP headers alone. Each task writes archives of a
bounded size to the shared folder under names of its own; the manifest lists
those of the attempts that succeeded, and only they are read back.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import durable, small_batches, work_dir

ARCHIVE_BYTES = 64 << 20
#: Payloads of fewer bytes are never revisited.
REVISIT_BYTES = 0
LEVEL = 6
#: Tasks that archives are read in at most; more archives share a task.
READ_TASKS = 20_000
_READ = 1 << 20
_ID = "urn:gridloom:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"  # pages carry no date


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, body = self.block.partition(b"\r\n\r\n")
        return _fields(head.decode("utf-8", "replace").split("\r\n")[1:]), body


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A record, uncompressed; a revisit if ``refers_to`` is given."""
    digest = sha1_base32(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{page_id}>",
        f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {_clean(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(stream: BinaryIO) -> Iterator[bytes]:
    """Each gzip member's data, decompressed as the stream is read on."""
    rest = b""
    while rest or (rest := stream.read(_READ)):
        inflate, out = zlib.decompressobj(31), bytearray()
        while not inflate.eof:
            out += inflate.decompress(rest)
            rest = inflate.unused_data
            if not inflate.eof and not (rest := stream.read(_READ)):
                raise ValueError("archive ends within a member")
        yield bytes(out)


def records(stream: BinaryIO) -> Iterator[Record]:
    """Each record of an archive, framed by its length, its digests verified."""
    for data in members(stream):
        head, gap, rest = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not gap or not lines[0].startswith("WARC/"):
            raise ValueError("no record header")
        headers = _fields(lines[1:])
        size = int(headers["content-length"])
        if rest[size:] != b"\r\n\r\n":
            raise ValueError("content length does not fit the record")
        record = Record(headers, rest[:size])
        if headers.get("warc-block-digest", "sha1:" + sha1_base32(record.block)) != "sha1:" + sha1_base32(record.block):
            raise ValueError("block digest does not fit")
        if headers["warc-type"] == "response":
            if headers["warc-payload-digest"] != "sha1:" + sha1_base32(record.http[1]):
                raise ValueError("payload digest does not fit")
        yield record


def _page(urn: str | None) -> int | None:
    tail = urn.strip("<>").removeprefix(_ID) if urn else "None"
    return None if tail == "None" else int(tail)


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Archives of ``pages(page_id, url, payload, refers_to)`` under ``root``; their manifest.

    The manifest is (path, records, bytes), a row for each archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        out, path, count, size = None, "", 0, 0
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if out is None:
                    path, count, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                member = gzip_member(page_record(row["page_id"], row["url"], row["payload"], row["refers_to"]))
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, count, size))
                    out = None
            yield _batch(done, _MANIFEST)
        if out is not None:
            out.close()
            yield _batch([(path, count, size)], _MANIFEST)

    small_batches(pages.sparkSession)
    return durable(pages.mapInArrow(run, "path string, records long, bytes long"))


_MANIFEST = pa.schema({"path": pa.string(), "records": pa.int64(), "bytes": pa.int64()})
_RECORDS = pa.schema(
    {
        "page_id": pa.int64(),
        "url": pa.string(),
        "payload_bytes": pa.int64(),
        "payload_digest": pa.string(),
        "record_type": pa.string(),
        "refers_to": pa.int64(),
        "payload": pa.binary(),
    }
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def read_archives(manifest: DataFrame, root: str, with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record.

    With ``with_payload`` the payload follows; a revisit has none of its own.
    """
    schema = _RECORDS if with_payload else _RECORDS.remove(len(_RECORDS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(root)
        for path in (x for batch in batches for x in batch.column("path").to_pylist()):
            rows, size = [], 0
            with store.open_input_stream(path, compression=None) as stream:
                for r in records(stream):
                    http, body = r.http
                    h = r.headers
                    rows.append(
                        (_page(h["warc-record-id"]), h.get("warc-target-uri"), int(http["content-length"]),
                         h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], _page(h.get("warc-refers-to")),
                         body if h["warc-type"] == "response" else None)
                    )
                    size += len(body) if with_payload else 0
                    if len(rows) >= 1000 or size >= ARCHIVE_BYTES:
                        yield _batch(rows, schema)
                        rows, size = [], 0
            yield _batch(rows, schema)

    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # A task for each archive up to READ_TASKS, or else the file scan would put small ones together.
    tasks = min(max(1, manifest.count()), READ_TASKS)
    return manifest.repartition(tasks).mapInArrow(run, ddl + (", payload binary" if with_payload else ""))


def with_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, payload, refers_to): the largest id of equal payloads is referred to.

    Of repeated rows with that id all are responses. A null id is less than any
    other; a null page counts as empty. Ids are longs.
    """
    read = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    equal = read.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest")
    shared = equal.agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1")
    # Written, so that Spark knows its size: small ones are broadcast, and the payloads are not shuffled.
    shared = durable(shared.select(F.col("digest").alias("shared_digest"), "response_id"))
    joined = read.join(shared, F.col("digest") == F.col("shared_digest"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def archived(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Every page written to archives in the shared folder and read back from them."""
    root = work_dir(pages.sparkSession)
    return read_archives(write_archives(with_revisits(pages, id_col, html_col, url_col), root), root)


#: The same rows in SQL: SHA-1 in base 32, 40 bits at a time.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, translate(
    to_base(('0x' || h[1:10])::BIGINT, 32, 8) || to_base(('0x' || h[11:20])::BIGINT, 32, 8)
    || to_base(('0x' || h[21:30])::BIGINT, 32, 8) || to_base(('0x' || h[31:40])::BIGINT, 32, 8),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> top THEN top END AS refers_to FROM m
"""
