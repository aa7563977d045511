"""WARC archives: writing with revisits of equal payloads, and transaction assembly.

Each page becomes a request, a response or revisit, and a metadata record; the first and
last name the second as concurrent to them. Records are built by expressions and written
as gzipped files whose record separator is the line separator. Reading parses the bytes
by their Content-Length, checks every payload against its digest, and joins the records
of a transaction through WARC-Concurrent-To to one nested row for each capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm import common

END = "\r\n"
DATE = "2000-01-01T00:00:00Z"
#: Bytes of payload that an archive file aims at, and the records it has at most; a reader holds a file in memory.
FILE_BYTES, RECORDS_PER_FILE = 64 << 20, 30000
#: Payloads of fewer bytes are never revisited.
REVISIT_BYTES = 0


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four digits of base 32."""
    h = F.sha1(payload)
    four = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*four), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str, rid: Column, block: Column, *more: tuple[str, Column], media: str) -> Column:
    """Header and block of one record, without the separator at its end."""
    lines = [F.lit(f"WARC/1.1{END}WARC-Type: {kind}{END}WARC-Date: {DATE}{END}WARC-Record-ID: <"), rid, F.lit(f">{END}Content-Type: {media}{END}")]
    for name, value in more:
        lines.append(F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(END))))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END + END), block)


def records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """One column `value`: three records for each row of (page_id, url, html).

    Of rows with equal payloads of at least `revisit_bytes`, that with the least page_id is
    the response (one row of it if it repeats, ids before nulls), others are revisits.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "%0A").alias("url"), payload.alias("html"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("n", F.octet_length("html").cast("long"))
    order = F.struct(F.col("page_id").isNull().alias("x"), F.col("page_id").alias("id"), F.col("row").alias("row"))
    first = rows.filter(F.col("n") >= revisit_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    joined = common.join_counted(rows.withColumnRenamed("n", "bytes"), first.filter("n > 1"), "digest").withColumnRenamed("bytes", "n")
    again = F.coalesce((F.col("n") >= revisit_bytes) & (F.col("first.row") != F.col("row")), F.lit(False))
    rid = lambda row, part: F.concat(F.lit(f"urn:capture:{part}:"), row.cast("string"))
    own, uri = rid(F.col("row"), "response"), ("WARC-Target-URI", F.col("url"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n").cast("string"), F.lit(END + END))
    to = ("WARC-Concurrent-To", F.concat(F.lit("<"), own, F.lit(">")))
    refers = ("WARC-Refers-To", F.concat(F.lit("<"), rid(F.col("first.row"), "response"), F.lit(">")))
    profile = ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    http = "application/http; msgtype=response"
    capture = F.when(again, _record("revisit", own, head, uri, digest, refers, profile, media=http)).otherwise(_record("response", own, F.concat(head, F.col("html")), uri, digest, media=http))
    request = _record("request", rid(F.col("row"), "request"), F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{END}{END}")), uri, to, media="application/http; msgtype=request")
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(END), F.when(again, F.concat(F.lit("refers-to-page-id: "), F.coalesce(F.col("first.id").cast("string"), F.lit("")), F.lit(END))).otherwise(""))
    meta = _record("metadata", rid(F.col("row"), "metadata"), fields, uri, to, media="application/warc-fields")
    return joined.select(F.explode(F.array(request, capture, meta)).alias("value"))


def write(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Archives of all pages as gzipped files in the folder `path`."""
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0.0
    most = int(min(RECORDS_PER_FILE, max(3, 3 * FILE_BYTES / (mean + 1000))))
    out = records(pages, revisit_bytes).write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", most)
    out.text(path)


def inflate(content: bytes) -> bytes:
    """The bytes of a file of one or more gzip members, or as they are if it is not gzipped."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        d = zlib.decompressobj(31)
        out.append(d.decompress(content))
        content = d.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields with lower-case names, block) of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8").split(END)
        if end < 0 or not head[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        start, n = end + 4, int(fields["content-length"])
        if start + n > len(data):
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, data[start : start + n]
        at = start + n + 4


_ROW = "capture_id string, kind string, record_id string, uri string, payload_bytes long, payload_digest string, page_id long, refers_to long, payload binary"


def read(spark, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives in a folder; payloads only if asked for.

    A payload that does not have its digest, or a cut record, is an error.
    """
    names = [x.split()[0] for x in _ROW.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _ROW.split(", ")]

    def row(f: dict[str, str], block: bytes) -> tuple:
        rid, kind = f["warc-record-id"].strip("<>"), f["warc-type"]
        capture = f.get("warc-concurrent-to", "").strip("<>") or rid
        uri, n, digest, page, refers, payload = f.get("warc-target-uri"), None, None, None, None, None
        if kind in ("response", "revisit"):
            head, _, body = block.partition(b"\r\n\r\n")
            digest = f["warc-payload-digest"].removeprefix("sha1:")
            n = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
            if kind == "response":
                if len(body) != n or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                    raise ValueError(f"the payload of {rid} differs from its digest")
                payload = body if payloads else None
        elif kind == "metadata":
            own = dict(x.split(": ", 1) for x in block.decode().split(END) if ": " in x)
            page, refers = (int(own[k]) if own.get(k) else None for k in ("page-id", "refers-to-page-id"))
        return capture, kind, rid, uri, n, digest, page, refers, payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = [row(*r) for r in parse(inflate(content.as_py()))]
                for i in range(0, len(found), 2000):
                    part = list(zip(*found[i : i + 2000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _ROW)


def assemble(found: DataFrame) -> DataFrame:
    """capture_id, request, response and metadata as structs: one row for each capture.

    A missing record is null; of repeated ones the greatest record id counts.
    """
    part = lambda kinds, *cols: F.max(F.when(F.col("kind").isin(*kinds), F.struct("record_id", "kind", *cols)))
    return found.groupBy("capture_id").agg(
        part(["request"], "uri").alias("request"),
        part(["response", "revisit"], "uri", "payload_bytes", "payload_digest", "payload").alias("response"),
        part(["metadata"], "page_id", "refers_to").alias("metadata"),
    )


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Every page through an archive and back. Null html is an empty payload; a null page_id stays null."""
    path = common.new_path(spark, "warc")
    write(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    rows = assemble(read(spark, path).drop("payload").withColumn("payload", F.lit(None).cast("binary")))
    return rows.select("metadata.page_id", "response.payload_bytes", "response.payload_digest", F.col("response.kind").alias("record_type"), F.col("metadata.refers_to").alias("refers_to"))


SQL = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT r, page_id, strlen(h) AS payload_bytes, sha1(h) AS x FROM p),
n AS (
  SELECT *, row_number() OVER (PARTITION BY x ORDER BY page_id NULLS LAST, r) AS k,
         first_value(page_id) OVER (PARTITION BY x ORDER BY page_id NULLS LAST, r) AS least
  FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k > 1 THEN least END AS refers_to
FROM n"""
