"""WARC archives: write pages, resolve revisits by payload digest, read archives back."""

from __future__ import annotations

import hashlib
import re
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, arrow_rows, load

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digits of radix 32 and of base 32.
_RADIX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: 40 hexadecimal digits as four numbers of eight digits each."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), _RADIX, _BASE32)


def _record_id(page_id: Column, digest: Column, kind: str) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _line(value: Column) -> Column:
    """A header's value: no line breaks, null as empty."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " ")


def _headers(*pairs: tuple[str, Column | str]) -> Column:
    parts: list[Column] = [F.lit("WARC/1.1\r\n")]
    for name, value in pairs:
        parts += [F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n")]
    return F.concat(*parts, F.lit("\r\n"))


def resolve(headers: DataFrame, ws: Workspace, min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Responses and revisits among headers (page_id, url, digest, bytes, row).

    Headers are shuffled by digest into one original each (the largest page_id; a null page_id only if
    there is no other; of equal rows one), and joined back. Smaller payloads are responses all."""
    order = F.struct(F.col("page_id").isNotNull().alias("has_id"), "page_id", "row")
    originals = ws.stage(
        headers.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max(F.struct(order.alias("key"), "url")).alias("top")).select(
            "digest", F.col("top.key.page_id").alias("refers_to"), F.col("top.key.row").alias("original"), F.col("top.url").alias("refers_url")
        ),
        "originals",
    )
    joined = ws.stage(headers.join(originals, "digest", "left"), "resolved")
    is_response = F.col("original").isNull() | (F.col("original") == F.col("row"))
    return joined.where(is_response), joined.where(~is_response)


def write_archives(pages: DataFrame, ws: Workspace, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0, file_rows: int = 20_000) -> str:
    """Write a record for each row of pages (page_id, url, html) and return the archives' folder.

    Records are ended by an empty line pair, which is the line separator of the text files written: the
    archives go through Spark's own committer to any file system it reaches. Only responses carry a payload.
    A null html is an empty payload, a null url or page_id an empty header. Files hold file_rows at most; a very long page is
    one record, made and read whole by one task."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    headers = ws.stage(keyed.select("page_id", _line(F.col("url")).alias("url"), "digest", F.octet_length("payload").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")), "headers")
    responses, revisits = resolve(headers, ws, min_bytes)

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    page, digest = F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.concat(F.lit("sha1:"), F.col("digest"))
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", digest), ("WARC-Page-Id", page), ("Content-Type", "application/http;msgtype=response")]
    wanted = responses.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "bytes", "url")
    source = keyed.select("page_id", "digest", "payload")
    repeated = headers.groupBy("page_id", "digest").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        source = source.dropDuplicates(["page_id", "digest"])
    full = source.join(wanted, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")))
    full = full.select(F.concat(
        _headers(("WARC-Type", "response"), ("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"), "response")), *common,
                 ("Content-Length", (F.col("bytes") + F.octet_length(http)).cast("string"))), http, F.col("payload")).alias("value"))
    refers = _record_id(F.col("refers_to"), F.col("digest"), "response")
    again = revisits.select(F.concat(
        _headers(("WARC-Type", "revisit"), ("WARC-Record-ID", _record_id(F.concat_ws("-", page, F.col("row").cast("string")), F.col("digest"), "revisit")), *common,
                 ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers), ("WARC-Refers-To-Target-URI", F.col("refers_url")),
                 ("WARC-Refers-To-Page-Id", F.coalesce(F.col("refers_to").cast("string"), F.lit(""))),
                 ("Content-Length", F.octet_length(http).cast("string"))), http).alias("value"))
    out = ws.path("archives")
    full.unionByName(again).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_rows).text(out)
    return out


RECORDS = "page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC stream; ValueError where it is broken."""
    held = b""
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            more = next(stream, b"")
            if not more:
                if held.strip():
                    raise ValueError("the archive ends inside a header")
                return
            held += more
        version, *lines = held[:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a record: {version[:40]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        parts, have = [held[end + 4 :]], len(held) - end - 4
        while have < size + 4:
            more = next(stream, b"")
            if not more:
                raise ValueError("the archive ends inside a record")
            parts.append(more)
            have += len(more)
        held = b"".join(parts)
        if held[size : size + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its header says")
        yield headers, held[:size]
        held = held[size + 4 :]


def _inflate(data: bytes, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Decompressed chunks of a gzip file, of one member or many; plain data passes."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        member = zlib.decompressobj(31)
        while data and not member.eof:
            if out := member.decompress(data, chunk):
                yield out
            data = member.unconsumed_tail or member.unused_data
            if member.eof:
                break
            if not out and not data:
                raise ValueError("the archive's compression is cut off")


def _parser(with_payload: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for head, block in _records(_inflate(data.as_py())):
                    http, _, body = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and (len(body) != size or b32encode(hashlib.sha1(body).digest()).decode() != digest):
                        raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
                    number = lambda key, head=head: int(head[key]) if head.get(key) else None
                    rows.append((number("warc-page-id"), head["warc-type"], head["warc-target-uri"], digest, size, number("warc-refers-to-page-id"), body if with_payload else None))
                    held += len(body) if with_payload else 0
                    if len(rows) >= 5000 or held > 1 << 24:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return parse


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """RECORDS of all archives in a folder, gzip or plain. Payload digests of responses are checked; a broken archive fails."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parser(with_payload), RECORDS)


def op9_warc_revisits(spark, sf_dir):
    """Pages through deduplicated archives and back. Tables without rows give no rows."""
    ws = Workspace(spark, "op9")
    out = write_archives(load(spark, sf_dir, "pages"), ws)
    with arrow_rows(spark, 1):
        found = ws.stage(read_archives(spark, out, with_payload=False).drop("payload"), "read")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGITS = " || ".join(f"substr('{_BASE32}', (v[{1 + i // 8}] >> {35 - 5 * (i % 8)} & 31)::INT + 1, 1)" for i in range(32))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS s FROM p),
n AS (SELECT page_id, payload_bytes, [('0x' || substr(s, a, 10))::BIGINT FOR a IN [1, 11, 21, 31]] AS v FROM d),
x AS (SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest FROM n)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = max(page_id) OVER w THEN NULL ELSE max(page_id) OVER w END AS refers_to
FROM x WINDOW w AS (PARTITION BY payload_digest)"""
