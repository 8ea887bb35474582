"""WARC archives, written by a deterministic sharded writer.

Records are cut into ranges of the page id by a histogram of their bytes and sorted within a range, so the same
pages give the same files. A file is rolled once its compressed size reaches ``file_bytes``; it begins with a warcinfo record, and every record
is a gzip member of its own. Record ids follow from page id, payload digest and a count of rows that have both in common. Headers and digests are made anew from the payload. Files get temporary names, are renamed when whole, and are listed
in a manifest, so tasks of lost executors are repeated without harm.

Of equal payloads of at least ``MIN_SHARED`` bytes, that of the smallest page id is a response and the others are
revisits of it, without a payload.

Defined results:
- null html is empty; null urls are written as ``about:blank``;
- repeated page ids: rows that share the smallest id of their payload are all responses, and the first by url is the one referred to; records of
  null ids have no page id and are never referred to; they are responses unless a page with an id has their payload; a page id of very many
  rows is cut between payloads;
- an empty table makes an archive without files; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import ranges, staging

MIN_SHARED = 100
#: Payload bytes of a range (a task), compressed bytes after which a file is rolled, and the gzip level.
RANGE_BYTES, FILE_BYTES, LEVEL = 16 << 20, 64 << 20, 4
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, file_range int, roll int, records long, bytes long, sha256 string"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Bytes handed to the unpacker at once.
STEP = 1 << 14
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def record_id(page_id: int | None, digest: str, again: int = 0) -> str:
    """The id of a record; ``again``: how many rows before it have the same page id and payload."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}/{again}')}>"


def clean_url(url: str | None) -> str:
    """A header value of one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def headed(head: dict[str, str], block: bytes) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def warcinfo(path: str) -> bytes:
    """The first record of a file."""
    block = b"software: pointloom\r\nformat: WARC File Format 1.1\r\n"
    head = {
        "WARC-Type": "warcinfo",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(SPACE, path)}>",
        "WARC-Date": DATE,
        "WARC-Filename": path,
        "Content-Type": "application/warc-fields",
        "Content-Length": str(len(block)),
    }
    return headed(head, block)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, again: int, refers_to: tuple[int, str | None] | None) -> bytes:
    """``refers_to``: page id and url of the response that a revisit refers to."""
    http = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest, again),
        "WARC-Date": DATE,
        "WARC-Target-URI": clean_url(url),
        "WARC-Payload-Digest": "sha256:" + digest,
        "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        head["WARC-Page-ID"] = str(page_id)
    if refers_to is not None:
        first, target = refers_to
        head |= {
            "WARC-Profile": PROFILE,
            "WARC-Refers-To": record_id(first, digest),
            "WARC-Refers-To-Target-URI": clean_url(target),
            "WARC-Refers-To-Date": DATE,
            "WARC-Refers-To-Page-ID": str(first),
        }
    return headed(head, block)


def member(data: bytes, level: int) -> bytes:
    """A gzip member without time or name."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def revisits(rows: DataFrame) -> DataFrame:
    """(id, digest, first, first_url): the rows of (id, url, digest, size) that revisit an earlier page; counts are combined before they are shuffled."""
    keys = rows.where(F.col("size") >= MIN_SHARED)
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url")))
    shared = keys.groupBy("digest").agg(least.alias("least"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("least").isNotNull())
    found = keys.select("id", "digest").join(shared.select("digest", F.col("least.id").alias("first"), F.col("least.url").alias("first_url")), "digest")
    return found.where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "digest", "first", "first_url").distinct()


def write(pages: DataFrame, at: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", range_bytes: int = RANGE_BYTES, file_bytes: int = FILE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write the archive and return its manifest, in order: a row for each file.

    Pages and notes of revisits (a few bytes each, with the response's url) meet in one shuffle by page id; a note sorts before its page."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    notes = revisits(rows.select("id", "url", "digest", F.octet_length("html").alias("size"))).select("id", F.col("first_url").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "first")
    tie = F.conv(F.substring("digest", 1, 12), 16, 10).cast("long")
    rows, notes = (x.withColumn("tie", tie) for x in (rows.withColumn("first", F.lit(None).cast("long")), notes))
    # ranges are those of the pages; notes are dealt by the same bounds
    place, count = ranges.places(rows, "id", F.octet_length("html") + 500, range_bytes, F.col("tie"))
    dealt = rows.unionByName(notes).withColumn("part", place).repartitionById(count, F.col("part"))
    ordered = dealt.sortWithinPartitions("part", F.col("id").asc_nulls_first(), "tie", "digest", F.col("html").isNotNull(), "url").select("part", "id", "url", "html", "digest", "first")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        held: list[bytes] = []
        size, roll, part = 0, 0, None
        own: tuple = (None, None, None)  # range, page id and digest of the rows at hand, how many of them there were, and what they revisit
        again, refers = 0, None

        def close() -> None:
            nonlocal size, roll, held
            if held:
                path = f"pages-{part:06d}-{roll:04d}.warc.gz"
                blob = b"".join([member(warcinfo(path), level), *held])
                staging.commit_file(f"{at}/{path}", blob)
                made.append((path, part, roll, len(held), len(blob), hashlib.sha256(blob).hexdigest()))
            size, roll, held = 0, roll + 1, []

        for batch in batches:
            for p, page, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    close()
                    part, roll = p, 0
                if (p, page, digest) != own:
                    own, again, refers = (p, page, digest), 0, None
                if html is None:
                    refers = (first, url)
                    continue
                if size >= file_bytes:
                    close()
                held.append(member(record(page, url, html.encode(), digest, again, refers), level))
                size += len(held[-1])
                again += 1
        close()
        columns = list(zip(*made, strict=True)) if made else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=["path", "file_range", "roll", "records", "bytes", "sha256"])

    ordered.mapInArrow(work, MANIFEST).write.parquet(f"{at}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{at}/manifest").orderBy("file_range", "roll")


def parse(blob: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; the members of the file are unpacked one by one."""
    at = 0
    while at < len(blob):
        unpacker = zlib.decompressobj(31)
        data = bytearray()
        while not unpacker.eof and at < len(blob):  # in steps, so that what follows the member is not copied again and again
            data += unpacker.decompress(blob[at : at + STEP])
            at += STEP
        at = min(at, len(blob)) - len(unpacker.unused_data)
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        yield headers, bytes(rest[: int(headers["Content-Length"])])


def read(spark: SparkSession, at: str) -> DataFrame:
    """The records of an archive: ids, url, type, digest and sizes as the headers have them, and the payload of responses, checked against its digest."""
    files = ranges.files(spark.read.schema(MANIFEST).parquet(f"{at}/manifest"), "file_range")
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(1).to_pylist():
                rows: list[tuple] = []
                for head, block in parse(staging.read_file(f"{at}/{path}")):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    revisit = head["WARC-Type"] == "revisit"
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: the payload of {head['WARC-Record-ID']} has another digest")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    page = head.get("WARC-Page-ID")
                    rows.append((None if page is None else int(page), head["WARC-Target-URI"], head["WARC-Type"], digest, size, int(head["WARC-Refers-To-Page-ID"]) if revisit else None, None if revisit else payload))
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(work, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def query(spark, sf_dir: str) -> DataFrame:
    """``op8_warc``: writes all pages and reads the archive back."""
    at = staging.folder(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), at)
    return read(spark, at).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
     f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN f.first IS NOT NULL AND f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= 100
"""
