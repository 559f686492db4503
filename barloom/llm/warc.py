"""WARC archives without repeated payloads: revisit records instead of copies, written and read back by Spark."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.llm.common import keyed, numbered, one_to_one, shared_folder, staged

#: parts into which rows of one payload are split on their way to the original's id
SALTS = 64
#: most bytes of records in one archive
ARCHIVE_BYTES = 16 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
CRLF = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(text: Column) -> Column:
    """SHA-1 in base32: each 5 of the 40 hexadecimal digits are 4 characters."""
    digest = F.sha1(text.cast("binary"))
    out = []
    for i in range(0, 40, 5):
        bits = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("long")
        out += [F.substring(F.lit(ALPHABET), (F.shiftright(bits, s).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def resolved(headers: DataFrame, least_bytes: int) -> DataFrame:
    """headers(row, digest, payload_bytes, page_id) -> (row, first_id, first_row): the original's page_id and row number for every revisit.

    Headers alone are shuffled. Rows of one digest are split by salt, the first row of each part goes up to the digest and
    back to its parts, so a payload that a third of all pages have is never in one task. Payloads under `least_bytes` are never revisited.
    """
    salted = headers.where(F.col("payload_bytes") >= least_bytes).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")
    parts = staged(salted.groupBy("digest", "salt").agg(F.min(place).alias("part_first"), F.count(F.lit(1)).alias("many")))
    firsts = parts.groupBy("digest").agg(F.min("part_first").alias("first"), F.sum("many").alias("many")).where("many > 1")
    back = staged(parts.select("digest", "salt").join(staged(firsts.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"))), "digest"))
    return salted.join(back, ["digest", "salt"]).where("row <> first_row").select("row", "first_id", "first_row")


def record_id(page_id: Column, row: Column) -> Column:
    """Unique for each row: ids may be null or repeat, row numbers don't."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"), F.lit(">"))


def one_line(x: Column) -> Column:
    return F.regexp_replace(x, r"[\r\n]+", " ")


def records(pages: DataFrame, revisits: DataFrame) -> DataFrame:
    """The text of each page's WARC record without the two line ends behind it."""
    rows = pages.join(revisits, "row", "left").withColumn("revisit", F.col("first_row").isNotNull())
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    original = F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("first_id"), F.col("first_row")), F.lit(f"{CRLF}WARC-Profile: {REVISIT}{CRLF}"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF), F.lit("WARC-Type: "), F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), F.lit(CRLF),
        F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("row")), F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), one_line(F.col("url")), F.lit(CRLF)), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF), F.when(F.col("revisit"), original).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))
    return rows.select(F.concat(head, block).alias("record"))


def placed(records: DataFrame, most_bytes: int) -> DataFrame:
    """record, archive: a task's records in the order they come, a new archive whenever the next one would pass `most_bytes`.
    A record that is longer is an archive of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = filled = 0
        for batch in batches:
            numbers = []
            for size in pc.binary_length(batch.column(0)).to_pylist():
                if filled and filled + size > most_bytes:
                    archive, filled = archive + 1, 0
                filled += size + len(CRLF + CRLF)
                numbers.append(archive)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int32())], ["record", "archive"])

    return records.mapInArrow(run, "record string, archive int")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes one record for each row of pages(page_id, url, html) to WARC files of at most `archive_bytes` below `path`; a longer
    record has a file to itself.

    A payload is the html in UTF-8, null as empty. Of equal payloads of at least `least_bytes` bytes the one with the smallest page_id
    (null last, one row of those that repeat it) is a response with fresh headers, the others are revisit records that name its
    record. Record ids are unique, whether ids are null or repeat.
    Line ends in urls become spaces; a null url has no header. Extra columns are ignored; no pages give no records.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def measured(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
        return rows, staged(rows.select("row", "page_id", "digest", "payload_bytes"))

    rows, headers = measured(keyed(pages, "row")[0])
    if not one_to_one(headers, "row"):
        rows, headers = measured(numbered(pages, "row"))
    # records end with two line ends, which is what the text writer puts behind each row
    out = placed(records(rows, staged(resolved(headers, least_bytes))), archive_bytes)
    out.write.partitionBy("archive").option("lineSep", CRLF + CRLF).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record, by Content-Length."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        first, *lines = archive[at:end].decode().split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError("no record at byte " + str(at))
        headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        size = int(headers["content-length"])
        yield headers, archive[end + 4:end + 4 + size]
        at = end + 4 + size
        if archive[at:at + 4] != b"\r\n\r\n":
            raise ValueError("record without its end")
        at += 4


def page_of(uri: str | None) -> int | None:
    page = "none" if uri is None else uri.split(":")[2]
    return None if page == "none" else int(page)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record below `path`. Digests of responses are computed from what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in parse(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = headers["warc-payload-digest"].partition(":")[2]
                    if headers["warc-type"] == "response":
                        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError("payload differs from its headers")
                    rows.append((page_of(headers["warc-record-id"]), size, digest, headers["warc-type"], page_of(headers.get("warc-refers-to")), headers.get("warc-target-uri")))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the archives to the shared folder and gives the records read back."""
    path = shared_folder(pages.sparkSession)
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path)
