"""WARC: deduplicated archives by payload digest, and reading them back.

Writing is a join of pages with the first page of their payload's digest, and text
files whose records end as the format asks; reading parses whole files by their
content lengths, then resolves revisits: headers meet on the payload digest, and a
revisit takes its payload's length from the original response.

Edge cases: a null html is an empty payload, a null url leaves its header out and line
breaks in one are percent-encoded; a null page_id comes after all numbers; rows that
share the smallest page_id of a payload are all responses; a payload may hold any
bytes, blank lines and record headers included; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import storage

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS_SCHEMA = (
    "record_id string, record_type string, page_id long, target_uri string, payload_digest string, "
    "payload_bytes long, refers_to_id string, payload binary"
)
# Files hold about so many payload bytes before compression, so that a task reads back a bounded file.
FILE_BYTES = 16 << 20


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of a SHA-1, from its hexadecimal digits, five at a time."""
    digest = F.sha1(data)
    letters = []
    for k in range(8):
        twenty = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(twenty, shift).bitwiseAND(31) + 1
            letters.append(F.substring(F.lit(BASE32), at, F.lit(1)))
    return F.concat(*letters)


def resolve(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Pages with payload, digest, record type and the response that a revisit refers to.

    Only digests and ids are shuffled to find the first page of a payload, summed before
    the shuffle. In the join a digest has one row on the right, so a payload that a third
    of the pages share can be split on the left.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary")))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    first = rows.groupBy("payload_digest").agg(
        F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url")
    )
    rows = rows.join(first, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
        F.when(revisit, F.col("first_url")).alias("refers_to_url"),
    )


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(
        F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4),
        F.lit("-"), part(21, 12), F.lit(">"),
    )


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def records(resolved: DataFrame, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """One string per record, without the two line breaks that end it."""
    response = F.col("record_type") == "response"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.col("payload_bytes")),
        F.lit("\r\n"),
    )
    block = F.when(response, F.concat(http, F.col("payload"))).otherwise(http)
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(~response, F.lit(REVISIT))),
        _line("WARC-Refers-To", F.when(~response, _record_id(F.col("refers_to"), F.col("payload_digest")))),
        _line("WARC-Refers-To-Target-URI", F.when(~response, F.col("refers_to_url"))),
        _line("X-Page-ID", F.col("page_id")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
    )
    sized = resolved.select(head.alias("head"), block.alias("block"))
    return sized.select(
        F.concat("head", _line("Content-Length", F.octet_length("block")), F.lit("\r\n"), F.col("block")).alias("value")
    )


def write(resolved: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Compressed archives below ``path``; a file takes about ``FILE_BYTES``, cut by record count."""
    rows, size = resolved.agg(F.count("*"), F.sum(F.col("payload_bytes") + 1024)).first()
    per_file = max(1, int(rows * FILE_BYTES // max(size or 1, 1)))
    (
        records(resolved, date)
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", per_file)
        .text(path)
    )


def parse(data: bytes) -> Iterator[dict]:
    """Records of one archive, compressed as one or several members, or plain."""
    view = memoryview(_inflate(data))
    at = 0
    while at < len(view):
        end = _find(view, at)
        if end < 0:
            raise ValueError("an archive ends within a header")
        head = bytes(view[at:end]).decode("utf-8")
        fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
        start = end + len(END)
        length = int(fields["Content-Length"])
        block = view[start : start + length]
        if len(block) < length:
            raise ValueError("an archive ends within a record")
        body = _find(block, 0) + len(END)
        response = fields["WARC-Type"] == "response"
        page = fields.get("X-Page-ID")
        yield {
            "record_id": fields["WARC-Record-ID"],
            "record_type": fields["WARC-Type"],
            "page_id": None if page is None else int(page),
            "target_uri": fields.get("WARC-Target-URI"),
            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "payload_bytes": length - body if response else None,
            "refers_to_id": fields.get("WARC-Refers-To"),
            "payload": bytes(block[body:]) if response else None,
        }
        at = start + length + len(END)


def _find(view: memoryview, at: int, step: int = 4096) -> int:
    """Where the next blank line is, looked for piece by piece; -1 if there is none."""
    while at < len(view):
        found = bytes(view[at : at + step]).find(END.encode())
        if found >= 0:
            return at + found
        at += step - len(END) + 1
    return -1


def _inflate(data: bytes) -> bytes:
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives below ``path``, payloads of responses with them if asked for."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in HEADERS_SCHEMA.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                some: list[dict] = []
                for record in parse(content):
                    if not payloads:
                        record["payload"] = None
                    some.append(record)
                    if len(some) >= 2_000:
                        yield _frame(some, names)
                        some = []
                if some:
                    yield _frame(some, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(parsed, HEADERS_SCHEMA)


def _frame(some: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(some, columns=names)
    return out.astype({"page_id": "Int64", "payload_bytes": "Int64"})


def resolve_revisits(headers: DataFrame) -> DataFrame:
    """Headers with the page and the length of the response that a revisit refers to."""
    answers = headers.filter(F.col("record_type") == "response").groupBy("payload_digest").agg(
        F.min(F.struct("page_id", "payload_bytes")).alias("original")
    )
    joined = headers.drop("payload").join(answers, "payload_digest", "left")
    revisit = F.col("record_type") == "revisit"
    return joined.select(
        "page_id",
        F.when(revisit, F.col("original.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.when(revisit, F.col("original.page_id")).alias("refers_to"),
        "record_id",
        "target_uri",
        "refers_to_id",
    )


def archive(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as deduplicated archives, read them back and resolve the revisits."""
    spark = pages.sparkSession
    path = path or storage.scratch_path(spark, "warc")
    write(resolve(pages, min_bytes=min_bytes), path)
    return resolve_revisits(read(spark, path, payloads=False))
