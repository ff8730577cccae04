"""WARC archives without repeated payloads: writing, reading back, and resolving revisit records."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.llm.util import join_uneven, keep, work_dir

CRLF = "\r\n"
LEAST = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"


def originals(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """_digest, _first (struct of id and url) for each payload that several pages share.

    Only headers (digest, id, url) are shuffled, and pre-aggregated: a digest of any number of pages is one row a task."""
    heads = pages.filter(F.col("_bytes") >= least).groupBy("_digest").agg(F.min(F.struct(F.col("_id").isNull().alias("null"), F.col("_id").alias("id"), F.col("_url").alias("url"))).alias("_first"), F.count("*").alias("_n"))
    return keep(heads.filter("_n > 1").select("_digest", "_first"), "originals")


def prepare(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    clean = F.regexp_replace(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    return pages.select(F.col(f"`{id_col}`").alias("_id"), clean.alias("_url"), body.alias("_body"), F.sha2(body.cast("binary"), 256).alias("_digest"), F.octet_length(body).cast("long").alias("_bytes"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = LEAST) -> DataFrame:
    """One WARC record for each row, as text in column value.

    Of rows with equal payloads of at least `least` bytes, the one with the smallest id (null last) becomes a response, rows
    that repeat its id and url too; the others become revisit records that refer to it. Smaller payloads, null and empty
    ones among them, are all responses. Other columns are not read. The payloads themselves move only if the table of shared
    digests is too large to be broadcast; the join may then be split where one digest is hot (adaptive skew join)."""
    rows = prepare(pages, id_col, url_col, payload_col)
    shared = originals(rows, least)
    both = rows.join(shared.withColumnRenamed("_digest", "_d"), (F.col("_digest") == F.col("_d")) & (F.col("_bytes") >= least), "left")
    own = F.col("_first").isNull() | (F.col("_id").eqNullSafe(F.col("_first.id")) & (F.col("_url") == F.col("_first.url")))
    name = lambda i, u: F.concat(F.lit("<urn:sha256:"), F.sha2(F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("")), u, F.col("_digest")), 256), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))
    page = lambda i: F.coalesce(i.cast("string"), F.lit(""))
    block = F.concat(F.lit(HTTP), line("Content-Length", F.col("_bytes").cast("string")), F.lit(CRLF), F.when(own, F.col("_body")).otherwise(""))
    common = [line("WARC-Target-URI", F.col("_url")), line("WARC-Date", F.lit(date)), line("WARC-Record-ID", name(F.col("_id"), F.col("_url"))), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))), line("X-Page-ID", page(F.col("_id"))), line("X-Payload-Length", F.col("_bytes").cast("string"))]
    revisit = [line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(F.col("_first.id"), F.col("_first.url"))), line("WARC-Refers-To-Target-URI", F.col("_first.url")), line("WARC-Refers-To-Date", F.lit(date)), line("X-Refers-To-Page", page(F.col("_first.id")))]
    tail = F.concat(line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", F.octet_length(F.col("_block")).cast("string")), F.lit(CRLF), F.col("_block"))
    out = both.withColumn("_block", block).withColumn("_own", own)
    return out.select(F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(F.col("_own"), "response").otherwise("revisit"), F.lit(CRLF), *common, F.when(F.col("_own"), "").otherwise(F.concat(*revisit)), tail).alias("value"))


def write_archives(pages: DataFrame, path: str, **how) -> None:
    """Writes the records as gzipped WARC files below path, one or more a task (the text sink ends each record)."""
    records(pages, **how).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


_RECORD = pa.schema([("type", pa.string()), ("id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("page_id", pa.string()), ("refers_to", pa.string()), ("refers_to_page", pa.string()), ("digest", pa.string()), ("length", pa.int64()), ("payload", pa.binary()), ("payload_sha256", pa.string())])


def parse(stream) -> Iterator[dict]:
    """Records of a WARC stream, by their content lengths."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        block = stream.read(int(head["content-length"]))
        payload = block.partition(b"\r\n\r\n")[2] if head["warc-type"] in ("response", "revisit") else block
        own = head["warc-type"] != "revisit"
        digest = head.get("warc-payload-digest", "").partition(":")[2]
        yield {"type": head["warc-type"], "id": head.get("warc-record-id"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "page_id": head.get("x-page-id") or None, "refers_to": head.get("warc-refers-to"), "refers_to_page": head.get("x-refers-to-page") or None, "digest": digest, "length": len(payload) if own else int(head.get("x-payload-length", -1)), "payload": payload if own else None, "payload_sha256": hashlib.sha256(payload).hexdigest() if own else digest}


def read_archives(spark: SparkSession, path: str, payloads: bool = True, batch_bytes: int = 16 << 20) -> DataFrame:
    """Every record of the archives (gzipped or not) below path. Archives are parsed as streams, in one task each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for value in batch.column(0):
                raw = value.as_buffer()
                stream = pa.BufferReader(raw)
                packed = raw.size > 1 and raw[:2].to_pybytes() == b"\x1f\x8b"
                stream = gzip.GzipFile(fileobj=stream) if packed else io.BytesIO(raw)
                for r in parse(stream):
                    held += len(r["payload"] or b"")
                    if not payloads:
                        r["payload"] = None
                    rows.append(r)
                    if held > batch_bytes or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _RECORD)

    schema = "type string, id string, url string, date string, page_id string, refers_to string, refers_to_page string, digest string, length long, payload binary, payload_sha256 string"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("content").mapInArrow(read, schema)


def resolve_revisits(read: DataFrame) -> DataFrame:
    """read_archives' rows with the payload of revisit records, by a join of their target's record id to the responses'.

    Equal response records (of repeated pages) count once. Revisits whose original is missing keep a null payload."""
    own = read.filter("type <> 'revisit'")
    first = own.groupBy(F.col("id").alias("_id")).agg(F.first("payload").alias("_payload"))
    back = read.filter("type = 'revisit'").drop("payload").join(first, F.col("refers_to") == F.col("_id"), "left").withColumnRenamed("_payload", "payload").drop("_id")
    return own.unionByName(back)


def digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    path = f"{work_dir(spark)}/archives"
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType.simpleString()
    read = keep(read_archives(spark, path, payloads=False).select("type", "id", "page_id", "refers_to", "refers_to_page", "length", "payload_sha256"), "read")
    # a revisit's length and digest are those of the response that it refers to, as it was read
    own = read.filter("type = 'response'")
    kept = own.groupBy(F.col("id").alias("_id")).agg(F.max("length").alias("_length"), F.max("payload_sha256").alias("_sha256"))
    back = read.filter("type = 'revisit'").drop("length", "payload_sha256")
    times = back.groupBy("refers_to").agg(F.count("*").alias("_n"))
    kept = kept.join(times, F.col("_id") == F.col("refers_to")).select(F.col("_id").alias("refers_to"), F.col("_length").alias("length"), F.col("_sha256").alias("payload_sha256"), "_n")
    both = own.unionByName(join_uneven(back, kept, ["refers_to"], "_n").drop("_n"))
    return both.select(F.col("page_id").cast(kind), F.col("length").alias("payload_bytes"), F.col("payload_sha256").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to_page").cast(kind).alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
d AS (SELECT page_id, strlen(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lo FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> lo THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> lo THEN lo END AS refers_to
FROM f"""
