"""WARC archives with revisit resolution.

Headers (id, digest, length) alone are shuffled by payload digest; of equal payloads that are long
enough the record with the smallest id is the response, the others become revisit records that refer
to it. Only then do the decisions meet the payloads, by id, and Spark's text writer, with the record
separator of WARC as its line separator, writes the archives, so its commit protocol holds. Record ids are fresh
UUIDs; the page's own id is a header of its own. Records of like size share files, so that a file has at most
`max_bytes` of payload, or one record: archives can be read whole, record by record, by Content-Length.

Defined results: null html is an empty payload, always a response; a null id orders after all others
and comes back null; rows that repeat the smallest id with its payload are all responses, rows that
repeat another id all revisits; a null url becomes about:blank, white space and control characters in
urls are percent-encoded; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize, new_path

NO_ID = 2**63 - 1
EOL = "\r\n"
#: Headers of our own: the page's id, and for revisits that of the response's page.
PAGE, ORIGINAL = "X-Page-ID", "X-Refers-To-Page-ID"
#: Payload bytes of a file, unless it has one record only.
MAX_BYTES = 128 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def resolve(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """id, url, html, bytes, digest and refers_to, which is null for responses."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    records = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    records = records.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha2(F.col("html").cast("binary"), 256)})
    heads = records.where(F.col("bytes") >= least_bytes).select("id", "digest")
    originals = materialize(heads.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "originals")
    revisits = heads.join(originals.hint("merge"), "digest").where("id > first").select("id", "digest", F.col("first").alias("refers_to")).distinct()
    return records.join(materialize(revisits, "revisits"), ["id", "digest"], "left")


def _own_id(id_: Column) -> Column:
    return F.when(id_ == NO_ID, F.lit("none")).otherwise(id_.cast("string"))


def record(date: str) -> Column:
    """A record without the blank lines that end it. Revisits name the page of their response, as record ids are new in every archive."""
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("about:blank"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL + EOL))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    return F.concat(
        F.lit(f"WARC/1.1{EOL}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{EOL}WARC-Record-ID: <urn:uuid:"), F.uuid(), F.lit(f">{EOL}{PAGE}: "), _own_id(F.col("id")), F.lit(f"{EOL}WARC-Date: {date}{EOL}WARC-Target-URI: "), url,
        F.lit(f"{EOL}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{EOL}WARC-Profile: {PROFILE}{EOL}{ORIGINAL}: "), _own_id(F.col("refers_to")))).otherwise(""),
        F.lit(f"{EOL}Content-Type: application/http; msgtype=response{EOL}Content-Length: "), F.octet_length(block).cast("string"), F.lit(EOL + EOL), block,
    )


def _write(records: DataFrame, path: str, max_bytes: int, largest: int, date: str | None) -> None:
    """One pass for payloads up to a 2000th of max_bytes; a further one for each class of larger ones, if there are any. largest: bytes of the largest payload."""
    date, low = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), -1
    for records_each in (2000, 40, 1):
        high = max_bytes // records_each if records_each > 1 else largest
        if low < max(largest, 0):
            lines = records.where((F.col("bytes") > low) & (F.col("bytes") <= high)).select(record(date).alias("value"))
            lines.write.mode("append").option("lineSep", EOL + EOL).option("maxRecordsPerFile", records_each).text(path)
        low = high


def write_archives(pages: DataFrame, path: str, least_bytes: int = 100, max_bytes: int = MAX_BYTES, date: str | None = None) -> None:
    """Write a record for each row of pages (page_id, url, html) to archives in the folder, which is new."""
    largest = pages.agg(F.max(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    _write(resolve(pages, least_bytes), path, max_bytes, largest, date)


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split(EOL)
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def parse(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """WARC headers, HTTP headers and payload of each record."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        head = _headers(data[at:end])
        block = data[end + 4 : (at := end + 4 + int(head["content-length"]))]
        http, _, payload = block.partition(b"\r\n\r\n")
        yield head, _headers(http), payload
        at += 4


def _id(value: str) -> int | None:
    return None if value == "none" else int(value)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record; payload_bytes and payload_digest of a revisit are those of the full payload. A wrong digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for head, http, payload in parse(content.as_py()):
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{head['warc-record-id']}: the payload doesn't have the digest of its header")
                    refers = head.get(ORIGINAL.lower())
                    rows.append((_id(head[PAGE.lower()]), head["warc-target-uri"], kind, int(http["content-length"]), digest, refers and _id(refers), payload if payloads and kind == "response" else None))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in RECORD.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def deduplicate_archives(spark: SparkSession, source: str, target: str, least_bytes: int = 100, max_bytes: int = MAX_BYTES) -> None:
    """Read archives, resolve revisits, write archives with a fresh record for each response and revisit.

    Revisits of the source meet their originals by payload digest, headers only; one without an original
    is an error. Those of payloads that are too short for revisits get the payload and become responses.
    """
    id_ = F.coalesce(F.col("page_id"), F.lit(NO_ID)).alias("id")
    heads = read_archives(spark, source, payloads=False).where("record_type in ('response', 'revisit')")
    heads = materialize(heads.select(id_, "url", F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"), "record_type"), "heads")
    originals = materialize(heads.where("record_type = 'response'").groupBy("digest").agg(F.min("id").alias("first"), F.max("bytes").alias("bytes")), "originals")
    revisits = heads.where("record_type = 'revisit'").select("id", "url", "digest").join(originals.hint("merge"), "digest", "left")
    revisits = materialize(revisits, "source-revisits")
    if lost := revisits.where("first is null").count():
        raise ValueError(f"{lost} revisits have no original response in {source}")

    responses = read_archives(spark, source).where("record_type = 'response'")
    pages = responses.select("page_id", "url", F.col("payload").cast("string").alias("html"))
    columns = ["id", "url", "html", "bytes", "digest", "refers_to"]
    kept = revisits.where(F.col("bytes") >= least_bytes).withColumns({"html": F.lit(""), "refers_to": F.col("first")}).select(columns)
    short = responses.where(F.octet_length("payload") < least_bytes).select(F.col("payload_digest").alias("digest"), F.col("payload").cast("string").alias("html"))
    wanted = revisits.where(F.col("bytes") < least_bytes)
    short = materialize(short.join(wanted.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"]), "short-payloads")
    filled = wanted.join(short.hint("merge"), "digest").withColumn("refers_to", F.lit(None).cast("long")).select(columns)
    _write(resolve(pages, least_bytes).select(columns).unionByName(kept).unionByName(filled), target, max_bytes, heads.agg(F.max("bytes")).first()[0] or 0, None)


def round_trip(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Write pages to archives in the shared folder and read these back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path, payloads=False)
