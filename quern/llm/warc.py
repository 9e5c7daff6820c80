"""WARC archives of pages: written as text records, read back, and assembled into one nested row for each capture."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, save, table

CRLF = "\r\n"
#: Equal payloads of so many bytes at least are stored once.
REVISIT_BYTES = 1000
#: Pages in one archive file at most, and bytes up to which a page may be so; pages up to 2, 4, 8 ... times as large
#: come half, a quarter, an eighth ... as many to a file, down to one: a file holds some 20 MB of payload, or one page.
PAGES_A_FILE, SMALL_BYTES = 600, 1 << 15
#: Records, and bytes of payload, that a reading task passes on at once.
BATCH_RECORDS, BATCH_BYTES = 300, 8 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD = "type string, record_id string, concurrent_to string, refers_to string, uri string, page_id long, payload_bytes long, payload_digest string, payload binary"


def _urn(*parts: Column) -> Column:
    h = F.md5(F.encode(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts]), "UTF-8"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), *[F.concat(F.lit("-"), F.substring(h, i, n)) for i, n in ((9, 4), (13, 4), (17, 4), (21, 12))], F.lit(">"))


def _record(kind: str | Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its closing line ends, which the writer adds. A null field is left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit("WARC/1.1" + CRLF + "WARC-Type: "), kind, F.lit(CRLF + f"WARC-Date: {DATE}" + CRLF))]
    lines += [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)), F.lit("")) for k, v in fields]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def _one_line(url: Column) -> Column:
    return F.regexp_replace(F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), "^ +| +$", "%20")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write request, response (or revisit) and metadata records of each row (page_id, url, html) to gzipped archive files under ``path``.

    Of rows with equal payloads of REVISIT_BYTES or more, the one with the largest page_id (then url) is the
    response; the others are revisits without payload that refer to it. Rows that repeat that one are responses too.
    The files come from Spark's own text writer, whose line end is a record's end: it works on any file system, and
    a task that runs twice is committed once.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html"))
    above = F.ceil(F.log2(F.greatest(F.col("bytes"), F.lit(SMALL_BYTES)) / SMALL_BYTES)).cast("int")
    sizes = sorted(r["c"] for r in rows.select(above.alias("c")).distinct().collect())  # 17 at most
    large = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest")
    first = save(large.agg(F.max(F.struct("page_id", "url")).alias("kept"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "kept"), "warc-kept")
    rows = rows.join(first, F.col("digest") == F.col("of"), "left")
    again = F.col("of").isNotNull() & ~F.struct("page_id", "url").eqNullSafe(F.col("kept"))
    uri = _one_line(F.col("url"))
    own = _urn(F.lit("capture"), F.col("page_id"), F.col("url"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    request = _record("request", [("WARC-Record-ID", _urn(F.lit("request"), own)), ("WARC-Concurrent-To", own), ("WARC-Target-URI", uri), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    capture = _record(
        F.when(again, "revisit").otherwise("response"),
        [("WARC-Record-ID", own), ("WARC-Target-URI", uri), ("Content-Type", F.lit("application/http; msgtype=response")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Refers-To", F.when(again, _urn(F.lit("capture"), F.col("kept.page_id"), F.col("kept.url"), F.col("digest")))), ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))],
        F.when(again, http).otherwise(F.concat(http, F.col("html"))),
    )
    about = _record("metadata", [("WARC-Record-ID", _urn(F.lit("metadata"), own)), ("WARC-Concurrent-To", own), ("WARC-Target-URI", uri), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)))
    for c in sizes or [0]:  # one scan for each size that occurs
        records = rows.where(above == c).select(F.explode(F.array(request, capture, about)).alias("value"))
        most = 3 * max(1, PAGES_A_FILE >> c)
        records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/size={c}")


def _head(stream: BinaryIO) -> bytes:
    """A record's header up to its empty line; nothing at the end of the archive."""
    lines = []
    while (line := stream.readline()) and line != b"\r\n":
        lines.append(line)
    if lines and (not line or not lines[0].startswith(b"WARC/1.")):
        raise ValueError(f"no WARC record at {lines[0][:80]!r}")
    if line and not lines:
        raise ValueError("no WARC record at an empty line")
    return b"".join(lines)


def parse_archive(data: bytes, payloads: bool) -> Iterator[tuple]:
    """Records of one archive in RECORD's columns, unpacked one at a time. A record that breaks the format is an error: nothing is skipped."""
    stream = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    while head := _head(stream):
        fields = dict(line.split(": ", 1) for line in head.decode().removesuffix(CRLF).split(CRLF)[1:])
        size = int(fields["Content-Length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"cut record {fields.get('WARC-Record-ID')}")
        kind, page, n, digest, payload = fields["WARC-Type"], None, None, None, None
        if kind in ("response", "revisit"):
            cut = block.find(b"\r\n\r\n") + 4
            http = dict(line.split(": ", 1) for line in block[: cut - 4].decode().split(CRLF)[1:])
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            n = int(http["Content-Length"])
            if kind == "response":
                payload = block[cut:]
                if hashlib.sha1(payload).hexdigest() != digest or len(payload) != n:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
        elif kind == "metadata":
            value = block.decode().removeprefix("pageId: ").rstrip(CRLF)
            page = int(value) if value else None
        yield kind, fields["WARC-Record-ID"], fields.get("WARC-Concurrent-To"), fields.get("WARC-Refers-To"), fields["WARC-Target-URI"], page, n, digest, payload if payloads else None


def _records(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    types = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for row in parse_archive(data.as_py(), payloads):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) >= BATCH_RECORDS or held >= BATCH_BYTES:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, RECORD)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the archive files under ``path``, in RECORD's columns."""
    return save(_records(spark, path, payloads), "warc-records")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: record_id, uri, capture, request, metadata, from records joined by their concurrent-to identifiers.

    A capture without request or metadata has nulls there. Records that repeat stay repeated.
    """
    whole = F.struct("type", "record_id", "concurrent_to", "refers_to", "uri", "page_id", "payload_bytes", "payload_digest", "payload")
    pick = lambda *kinds: F.collect_list(F.when(F.col("type").isin(*kinds), whole))
    groups = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("transaction")).agg(pick("response", "revisit").alias("captures"), pick("request").alias("requests"), pick("metadata").alias("abouts"))
    return groups.select("transaction", "requests", "abouts", F.posexplode("captures").alias("i", "capture")).select(
        F.col("transaction").alias("record_id"), F.col("capture.uri").alias("uri"), "capture", F.get("requests", F.col("i")).alias("request"), F.get("abouts", F.col("i")).alias("metadata")
    )


def archive_pages(pages: DataFrame, path: str | None = None, payloads: bool = True) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``path`` (a fresh one in the shared folder if none is given), read them back and assemble; the archives are read as often as the result is.

    Null html is an empty payload, a null url an empty target, a null page_id null again. Very long payloads are one
    record. Repeated rows give repeated captures. Further columns are ignored. No rows give no rows.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path)
    return assemble(_records(spark, path, payloads))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest are those of the assembled payload; of a revisit, those of the response that it refers to."""
    payload = F.col("capture.payload")
    rows = save(archive_pages(table(spark, sf_dir, "pages")).select(F.col("metadata.page_id").alias("page_id"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload).alias("digest"), F.col("capture.type").alias("record_type"), F.col("capture.refers_to").alias("target"), "record_id"), "warc-captures")
    wanted = rows.select(F.col("target").alias("wanted")).where("wanted is not null").distinct()
    named = rows.join(wanted, F.col("record_id") == F.col("wanted"), "left_semi").groupBy(F.col("record_id").alias("of")).agg(F.max("page_id").alias("refers_to"), F.max("bytes").alias("of_bytes"), F.max("digest").alias("of_digest"))
    return rows.join(named, F.col("target") == F.col("of"), "left").select("page_id", F.coalesce("bytes", "of_bytes").alias("payload_bytes"), F.coalesce("digest", "of_digest").alias("payload_digest"), "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM f
"""
