r"""A content-addressed WARC archive: payload bytes once, exact record headers apart, records rebuilt by joins.

``write_archive`` makes two tables in the shared folder. ``payloads`` holds every different payload once, under its SHA-256; grouping
compares the payloads' bytes, so a digest names one payload only, and that is checked again as it is written.
``headers`` holds for every page the exact bytes that precede the payload: the WARC header and the HTTP header. Of the records
whose payloads are equal and have at least ``revisit_from`` bytes, the one with the largest id is the response, the others are
revisits of it (identical-payload-digest) without a payload.

``read_records`` joins the two tables into the original record bytes; ``parse_records`` takes those bytes apart again.

Defined results: a null html is an empty payload, a null url an empty target. Records with a null id have an empty number in
their record id; they are responses unless some equal payload has an id. Repeated rows with the largest id are responses each. No rows: no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._join import left_join_by_weight
from ._scratch import Scratch

RECORD_ID = "urn:lamella:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    headers: str
    payloads: str
    records: int


def _lines(*parts: str | Column) -> Column:
    """Header lines; a str is literal text, pieces of one line follow each other, and CRLF ends are written out."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 1000, date: str = "2024-01-01T00:00:00Z") -> Archive:
    """Write the archive of all rows; ``date`` is the WARC-Date of every record."""
    scratch = Scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    digest = F.sha2("payload", 256).alias("digest")
    stored = rows.select("id", digest, "payload").groupBy("digest", "payload").agg(F.max("id").alias("first_id"), F.count(F.lit(1)).alias("uses"))
    stored = scratch.write(stored.select("digest", "payload", F.octet_length("payload").cast("long").alias("bytes"), "first_id", "uses"), "payloads")
    if stored.select("digest").groupBy("digest").count().where("count > 1").limit(1).count():
        raise RuntimeError("two different payloads share a SHA-256 digest")
    light = scratch.write(rows.select("id", "url", digest, F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")), "light")
    total = light.count()
    many = stored.where("uses > 1").select("digest", "first_id", "uses")
    light = left_join_by_weight(light, many, ["digest"], "uses", total)
    revisit = F.col("uses").isNotNull() & (F.col("bytes") >= revisit_from) & F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    http = _lines("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.col("bytes").cast("string"), "\r\n\r\n")
    number = F.coalesce(F.col("id").cast("string"), F.lit(""))
    head = _lines(
        "WARC/1.1\r\nWARC-Type: ", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        f"\r\nWARC-Date: {date}\r\nWARC-Record-ID: <{RECORD_ID}", number, ">\r\nWARC-Target-URI: ", F.col("url"),
        "\r\nWARC-Payload-Digest: sha1:", F.col("sha1"),
        F.when(revisit, _lines(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{RECORD_ID}", F.col("first_id").cast("string"), ">")).otherwise(F.lit("")),
        "\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ",
        (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))).cast("string"), "\r\n\r\n", http,
    )
    headers = light.select("id", head.cast("binary").alias("header"), F.when(~revisit, F.col("digest")).alias("digest"), F.coalesce("uses", F.lit(1).cast("long")).alias("uses"))
    headers.write.mode("overwrite").parquet(scratch.path("headers"))
    scratch.drop("light")
    return Archive(scratch.path("headers"), scratch.path("payloads"), total)


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """(record): the bytes of every record, header, block and the two line ends, from the stored tables alone."""
    headers, payloads = spark.read.parquet(archive.headers), spark.read.parquet(archive.payloads)
    # A payload that many responses share is short, as longer ones have one response: the broadcast part stays small.
    used = headers.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("responses"))
    payloads = payloads.select("digest", "payload").join(used, "digest")
    whole = left_join_by_weight(headers.where("digest is not null").select("digest", "header"), payloads, ["digest"], "responses", max(archive.records, 1024 * 64))
    ends = F.lit("\r\n\r\n").cast("binary")
    return whole.select(F.concat("header", "payload", ends).alias("record")).union(headers.where("digest is null").select(F.concat("header", ends).alias("record")))


def parse_records(records: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, declared_digest, payload_digest, payload_bytes, payload) from record bytes.

    payload_digest is computed anew from a response's payload; a revisit has the digest and length that its headers declare.
    """
    text = F.col("record").cast("string")
    parts = records.select("record", F.regexp_extract(text, r"\A(?s)(.*?\r\n\r\n)", 1).alias("head"))
    field = lambda name, pattern: F.regexp_extract("head", rf"\r\n{name}: {pattern}\r\n", 1)
    parts = parts.select("head", F.expr("substring(record, octet_length(head) + 1, cast(regexp_extract(head, '\\r\\nContent-Length: (\\\\d+)\\r\\n', 1) as int))").alias("block"))
    parts = parts.withColumn("http", F.regexp_extract(F.col("block").cast("string"), r"\A(?s)(.*?\r\n\r\n)", 1))
    kind = field("WARC-Type", "(\\w+)")
    payload = F.expr("substring(block, octet_length(http) + 1)")
    declared = field("WARC-Payload-Digest", "sha1:([0-9a-f]+)")
    revisit = kind == "revisit"
    as_long = lambda c: F.when(c != "", c).cast("long")
    return parts.select(
        as_long(field("WARC-Record-ID", f"<{RECORD_ID}(-?\\d*)>")).alias("page_id"),
        field("WARC-Target-URI", "([^\r\n]*)").alias("url"),
        kind.alias("record_type"),
        as_long(field("WARC-Refers-To", f"<{RECORD_ID}(-?\\d*)>")).alias("refers_to"),
        declared.alias("declared_digest"),
        F.when(revisit, declared).otherwise(F.sha1(payload)).alias("payload_digest"),
        F.when(revisit, F.regexp_extract("http", r"\r\nContent-Length: (\d+)\r\n", 1).cast("long")).otherwise(F.octet_length(payload).cast("long")).alias("payload_bytes"),
        F.when(~revisit, payload).alias("payload"),
    )
