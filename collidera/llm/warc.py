"""WARC archives: a writer with revisit records and a reader that salvages damage.

The writer makes a record per page. Of pages with equal payloads of at least
``min_bytes`` bytes, that with the smallest id is a ``response`` and the others are
``revisit`` records that name it. Every record is a gzip member of its own, and archives
are rolled at ``archive_bytes``. A task writes a file under another name and renames it
when it is whole; its rows are sorted, so a repeated task writes the same files again.

The reader checks members, version lines, lengths, record ends and block digests. After
a failed check it searches for the next member or version line that starts a valid
record, goes on there, and reports the bytes in between as a gap. A member that is cut
or damaged is read as far as it unpacks, and version lines are searched in what came out.

Defined results: a null payload is an empty one, a null url is left out, line breaks in
a url are percent-encoded. A null id is read back as null; it never becomes the response
others refer to unless no id of the group is known, and then all are responses. Repeated
rows of the smallest id are all responses. Empty tables make no archive. An archive is
read as one binary row, so it must stay below Spark's limit of 2 GB for one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collidera.llm.skew import lookup
from collidera.sources.shared_folder import new_path, settled

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
ID = "urn:page:"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")


@dataclass(frozen=True)
class Archives:
    min_bytes: int = 100
    archive_bytes: int = 8 << 20
    date: str = "2024-01-01T00:00:00Z"
    level: int = 6


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, size: int, digest: str,
    kind: str, refers_to: int | None, date: str,
) -> bytes:
    """One uncompressed record; a revisit has the HTTP header only, with the full length."""
    http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}"]
    block = "\r\n".join([*http, "", ""]).encode()
    if kind == "response":
        block += payload
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    head = "\r\n".join(lines).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + head + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def page_roles(pages: DataFrame, a: Archives = Archives()) -> DataFrame:
    """``(page_id, payload_digest, payload_bytes, record_type, refers_to)``, one row per
    distinct page id and payload. The payloads themselves are not shuffled."""
    html = F.coalesce("html", F.lit(""))
    meta = settled(
        pages.select(
            "page_id",
            F.sha2(html.cast("binary"), 256).alias("payload_digest"),
            F.octet_length(html).cast("long").alias("payload_bytes"),
        ).distinct()
    )
    groups = settled(
        meta.table.groupBy("payload_digest").agg(
            F.min("page_id").alias("_first"), F.count("*").alias("_n")
        )
    ).table
    again = (F.col("payload_bytes") >= a.min_bytes) & (
        F.coalesce(F.col("page_id") != F.col("_first"), F.col("_first").isNotNull())
    )
    return lookup(meta.table, groups, "payload_digest", meta.rows).select(
        "page_id",
        "payload_digest",
        "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first")).alias("refers_to"),
    )


def write_warc(pages: DataFrame, folder: str, a: Archives = Archives()) -> DataFrame:
    """Writes ``pages`` below ``folder``; returns ``(archive, records, bytes)`` per file.

    ``folder`` is a URI that pyarrow's file systems open on every worker (``file``,
    ``hdfs``, ``s3``, ``gs``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        task, done, members, size = TaskContext.get(), [], [], 0

        def close() -> None:
            nonlocal members, size
            if members:
                name = f"part-{task.partitionId():06d}-{len(done):05d}.warc.gz"
                hidden = f"{base}/_{name}.{task.taskAttemptId()}"
                with files.open_output_stream(hidden, compression=None) as out:
                    out.write(b"".join(members))
                files.move(hidden, f"{base}/{name}")
                done.append((name, len(members), size))
            members, size = [], 0

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in COLUMNS), strict=True):
                page_id, url, html, *rest = row
                payload = (html or "").encode("utf-8", "surrogatepass")
                data = record_bytes(page_id, url, payload, *rest, a.date)
                members.append(gzip_member(data, a.level))
                size += len(members[-1])
                if size >= a.archive_bytes:
                    close()
        close()
        names, records, sizes = zip(*done, strict=True) if done else ([], [], [])
        counts = [pa.array(x, pa.int64()) for x in (records, sizes)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *counts], names=["archive", "records", "bytes"]
        )

    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    roles = page_roles(pages, a).withColumnRenamed("page_id", "_page")
    keyed = pages.select("page_id", "url", "html").withColumn("_digest", digest)
    same = F.col("page_id").eqNullSafe(F.col("_page"))
    same &= F.col("_digest") == F.col("payload_digest")
    joined = keyed.join(roles, same).select(*COLUMNS)
    written = joined.sortWithinPartitions("page_id", "payload_digest", "url")
    return settled(written.mapInArrow(run, "archive string, records long, bytes long")).table


COLUMNS = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]


REQUIRED = ("warc-type", "warc-record-id", "warc-date")


class Damage(Exception):
    """A failed check of an archive."""


def parsed_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at a version line."""
    if not VERSION_LINE.match(data, at):
        raise Damage("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damage("header not ended")
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header line without a colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    missing = [h for h in REQUIRED if not headers.get(h)]
    if missing:
        raise Damage(f"no {missing[0]}")
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise Damage("no content length")
    begin, end = stop + 4, stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damage("record not ended")
    block = data[begin:end]
    algorithm, _, digest = headers.get("warc-block-digest", "").partition(":")
    if algorithm == "sha256" and hashlib.sha256(block).hexdigest() != digest:
        raise Damage("block digest differs")
    return headers, block, end + 4


def records_of(data: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """``(offset, length, damage, headers, block)`` of plain records and of gaps."""
    at = 0
    while at < len(data):
        try:
            headers, block, end = parsed_record(data, at)
            yield at, end - at, None, headers, block
        except Damage as damage:
            end = at
            while True:
                found = VERSION_LINE.search(data, end + 1)
                end = found.start() if found else len(data)
                try:
                    if found:
                        parsed_record(data, end)
                except Damage:
                    continue
                break
            yield at, end - at, str(damage), {}, b""
        at = end


#: Compressed bytes given to the unpacker at first, and at most, at a time.
FIRST_PIECE, LARGEST_PIECE = 512, 64 << 10


def member_at(data: bytes, at: int) -> tuple[bytes, int | None]:
    """Content and end of the gzip member at an offset.

    Of a damaged member the content before the damage, and no end. A member is fed in
    pieces that grow with it, so that its time does not depend on what follows it.
    """
    unpacker, view = zlib.decompressobj(31), memoryview(data)
    found, size, begin = [], FIRST_PIECE, at
    while not unpacker.eof and begin < len(data):
        piece = view[begin : begin + size]
        before = unpacker.copy()
        try:
            found.append(unpacker.decompress(piece))
        except zlib.error:
            # What the piece holds before the damage, byte by byte.
            with suppress(zlib.error):
                for k in range(len(piece)):
                    found.append(before.decompress(piece[k : k + 1]))
            return b"".join(found), None
        begin, size = begin + len(piece), min(2 * size, LARGEST_PIECE)
    if unpacker.eof:
        return b"".join(found), begin - len(unpacker.unused_data)
    return b"".join([*found, unpacker.flush()]), None


def member_after(data: bytes, at: int) -> int:
    """The next offset at which a member begins that holds a version line, or the end."""
    while (at := data.find(MAGIC, at + 1)) >= 0:
        with suppress(zlib.error):
            head = zlib.decompressobj(31).decompress(memoryview(data)[at : at + LARGEST_PIECE])
            if VERSION_LINE.search(head):
                return at
    return len(data)


def salvaged(data: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """Records and gaps of an archive, compressed by member or plain.

    Offsets are bytes of the archive. A record of a member has the member's offset and
    length, and so has a gap inside one. Of a damaged member those records are kept whose
    block digests prove them right; the member itself is a gap that ends where the next
    one begins.
    """
    if VERSION_LINE.search(data) and MAGIC not in data[:3]:
        yield from records_of(data)
        return
    at = 0
    while at < len(data):
        content, end = member_at(data, at)
        whole = end is not None
        if not whole:
            end = member_after(data, at)
        for _, _, reason, headers, block in records_of(content):
            if whole or reason is None and headers.get("warc-block-digest", "").startswith("sha256:"):
                yield at, end - at, reason, headers, block
        if not whole or not content:
            yield at, end - at, "gzip member is damaged" if not whole else "empty gzip member", {}, b""
        at = end


#: Record bytes handed over at a time.
BATCH_BYTES = 16 << 20
READ_SCHEMA = (
    "archive string, offset long, length long, damage string, record_type string,"
    " record_id string, target_uri string, refers_to string, payload_digest string,"
    " payload_bytes long, payload binary"
)


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes | None, int, str]:
    """Payload, its full length and its digest; a revisit states the last two."""
    head, _, body = block.partition(b"\r\n\r\n")
    if headers.get("warc-type") == "revisit":
        size = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
        return None, int(size[1]) if size else 0, digest
    http = headers.get("content-type", "").startswith("application/http")
    body = body if http else block
    return body, len(body), hashlib.sha256(body).hexdigest()


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives in ``path``; gaps have ``damage`` and no record."""

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in READ_SCHEMA.split(",")]
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def row_of(offset: int, length: int, damage: str | None, headers: dict, block: bytes):
        if damage is not None:
            return offset, length, damage, *[None] * 7
        payload, size, digest = payload_of(headers, block)
        named = ("warc-type", "warc-record-id", "warc-target-uri", "warc-refers-to")
        stated = (headers.get(h) for h in named)
        return offset, length, None, *stated, digest, size, payload if with_payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for found in salvaged(content):
                    rows.append((archive, *row_of(*found)))
                    held += len(found[-1])
                    if held > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    return files.select("path", "content").mapInArrow(run, READ_SCHEMA)


def warc_round_trip(pages: DataFrame, a: Archives = Archives()) -> DataFrame:
    """Pages written to archives in the shared folder and read back, one row per page."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    written = write_warc(pages, folder, a)

    def number(column: str) -> Column:
        digits = F.regexp_extract(F.coalesce(column, F.lit("")), rf"^<{ID}(-?\d+)>$", 1)
        return F.nullif(digits, F.lit("")).cast("long")

    if written.isEmpty():
        return spark.createDataFrame([], ROUND_TRIP)
    records = read_warc(spark, folder, with_payload=False).filter("damage is null")
    return records.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )


ROUND_TRIP = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
)

#: DuckDB statement for ``warc_round_trip`` with the default parameters.
ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d
  FROM pages),
g AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d
"""
