"""WARC records in ZIP packages, and a reader that never extracts them.

A package holds `archive/data.warc` and `indexes/index.cdxj`, both stored. The reader
parses the end of the central directory (ZIP64's too), the central entries, and the local
header of a member, and then reads single records by their ranges. A package is closed
when its payloads reach PACKAGE_BYTES.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.files import reading, writing
from voxloom.llm.shared import new_folder, text_or_empty, written

WARC, INDEX = "archive/data.warc", "indexes/index.cdxj"
PACKAGE_BYTES = 128 << 20
#: Neighbouring records are read together up to so many bytes.
READ_BYTES = 8 << 20
LEAST_REVISIT = 100
DATE = "2000-01-01T00:00:00Z"


# ---- ZIP directories


@dataclass
class Member:
    name: str
    method: int
    size: int
    header_at: int


def members(f) -> dict[str, Member]:
    """The members of a ZIP by name, from its central directory; f has size() and read_at(n, offset)."""
    size = f.size()
    tail_at = max(0, size - 65_557)
    tail = f.read_at(size - tail_at, tail_at)
    i = len(tail)
    while (i := tail.rfind(b"PK\5\6", 0, i)) >= 0:  # a comment may hold the mark too
        if len(tail) - i >= 22 and i + 22 + struct.unpack_from("<H", tail, i + 20)[0] == len(tail):
            break
    else:
        raise ValueError("no end of a central directory: not a ZIP, or cut off")
    n, length, at = struct.unpack_from("<HII", tail, i + 10)
    if 0xFFFF == n or 0xFFFFFFFF in (length, at):
        mark, _, end_at, _ = struct.unpack("<4sIQI", f.read_at(20, tail_at + i - 20))
        if mark != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        end = f.read_at(56, end_at)
        if end[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of the central directory")
        n, length, at = struct.unpack_from("<QQQ", end, 32)
    directory, i, found = f.read_at(length, at), 0, {}
    for _ in range(n):
        if directory[i : i + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, i + 8)
        packed, plain, a, b, c = struct.unpack_from("<IIHHH", directory, i + 20)
        (header_at,) = struct.unpack_from("<I", directory, i + 42)
        name = directory[i + 46 : i + 46 + a].decode("utf-8" if flags & 0x800 else "cp437")
        extra, j = directory[i + 46 + a : i + 46 + a + b], 0
        while j + 4 <= len(extra):
            kind, m = struct.unpack_from("<HH", extra, j)
            if kind == 1:  # ZIP64: only the fields that overflowed, in this order
                wide, k = extra[j + 4 : j + 4 + m], 0
                if plain == 0xFFFFFFFF:
                    plain, k = struct.unpack_from("<Q", wide, k)[0], k + 8
                if packed == 0xFFFFFFFF:
                    packed, k = struct.unpack_from("<Q", wide, k)[0], k + 8
                if header_at == 0xFFFFFFFF:
                    header_at = struct.unpack_from("<Q", wide, k)[0]
            j += 4 + m
        found[name] = Member(name, method, packed, header_at)
        i += 46 + a + b + c
    return found


def data_at(f, m: Member) -> int:
    """Where a stored member's bytes begin."""
    head = f.read_at(30, m.header_at)
    if head[:4] != b"PK\3\4" or m.method != 0:
        raise ValueError(f"{m.name} is not a stored member")
    a, b = struct.unpack_from("<HH", head, 26)
    return m.header_at + 30 + a + b


# ---- WARC records


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record with its HTTP block, or a revisit record of headers alone."""
    name = "none" if page_id is None else page_id
    uri = (url or f"urn:page:{name}").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http + (payload if refers_to is None else b"")
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's headers (names in lower case), its HTTP headers and its payload."""

    def headers(raw: bytes) -> dict[str, str]:
        return {k.decode().lower(): v.decode() for k, v in (x.split(b": ", 1) for x in raw.split(b"\r\n")[1:])}

    end = data.index(b"\r\n\r\n")
    head = headers(data[:end])
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    cut = block.index(b"\r\n\r\n")
    return head, headers(block[:cut]), block[cut + 4 :]


def _id(uri: str | None) -> int | None:
    return int(uri[10:-1]) if uri and uri != "<urn:page:none>" else None


def write_packages(pages: DataFrame, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes a record for each row of pages(page_id, url, html, payload_digest, refers_to); returns the table (path, n_records) of the packages."""
    folder = new_folder(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for i in range(0, b.num_rows, 500) for row in zip(*(c.to_pylist() for c in b.slice(i, 500).columns), strict=True))
        row, k = next(rows, None), 0
        while row is not None:
            path, index, at = f"{folder}/part-{TaskContext.get().partitionId():06d}-{k}-{uuid.uuid4().hex}.zip", [], 0
            with writing(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
                with package.open(zipfile.ZipInfo(WARC), "w", force_zip64=True) as member:
                    while row is not None and at < package_bytes:
                        page_id, url, html, digest, refers_to = row
                        data = record(page_id, url, html.encode("utf-8"), digest, refers_to)
                        member.write(data)
                        index.append(f"{page_id} " + json.dumps({"offset": at, "length": len(data)}))
                        at += len(data)
                        row = next(rows, None)
                package.writestr(zipfile.ZipInfo(INDEX), "\n".join(index) + "\n")
            k += 1
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(index)]})

    return written(pages.select("page_id", "url", text_or_empty("html").alias("html"), "payload_digest", "refers_to").mapInArrow(write, "path string, n_records long"), "warc-files")


def records_of(path: str) -> Iterator[bytes]:
    """Every record of a package by its range in the index; neighbours are read together."""
    with reading(path) as f:
        found = members(f)
        listed = f.read_at(found[INDEX].size, data_at(f, found[INDEX])).decode()
        ranges = [(x["offset"], x["length"]) for x in (json.loads(line.split(" ", 1)[1]) for line in listed.splitlines())]
        base, i = data_at(f, found[WARC]), 0
        while i < len(ranges):
            first, j = ranges[i][0], i + 1
            while j < len(ranges) and ranges[j][0] == sum(ranges[j - 1]) and sum(ranges[j]) - first <= READ_BYTES:
                j += 1
            data = f.read_at(sum(ranges[j - 1]) - first, base + first)
            for at, n in ranges[i:j]:
                yield data[at - first : at - first + n]
            i = j


def read_packages(files: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of the packages: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and html if payloads (null for revisits).

    Length and digest of a response come from the payload as read, those of a revisit from its headers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            rows: list[tuple] = []
            held = 0
            for data in records_of(path):
                head, http, payload = parsed(data)
                response = head["warc-type"] == "response"
                n = len(payload) if response else int(http["content-length"])
                digest = hashlib.sha256(payload).hexdigest() if response else head["warc-payload-digest"].removeprefix("sha256:")
                rows.append((_id(head["warc-record-id"]), head["warc-target-uri"], n, digest, head["warc-type"], _id(head.get("warc-refers-to"))) + ((payload.decode() if response else None,) if payloads else ()))
                held += len(payload) * payloads
                if len(rows) >= 5_000 or held > READ_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["html"] * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * payloads

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("path").repartition(max(1, files.count())).mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * payloads)


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages(page_id, url, html) with payload_digest and refers_to.

    Of rows with equal payloads of `least` bytes or more, that with the smallest page_id is
    the response; the others refer to it. A null html is an empty payload. Rows that repeat
    a page_id are the same page and share its verdict. A null page_id refers to any other,
    and is a response where there is none.
    """
    digest = F.sha2(text_or_empty("html"), 256)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", digest.alias("payload_digest"))
    first = written(
        pages.where(F.octet_length(text_or_empty("html")) >= least).select(F.col("page_id").cast("long").alias("page_id"), digest.alias("payload_digest"))
        .groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL").drop("n"),
        "revisited",
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(first, "payload_digest", "left").select("page_id", "url", "html", "payload_digest", refers.alias("refers_to"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_packages(with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return read_packages(files, payloads=False).drop("url")


SQL = {
    "op8_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS f FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> f THEN f END AS refers_to
        FROM f"""
}
