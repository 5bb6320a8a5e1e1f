"""Content-addressed WARC archive.

Two tables in one folder: ``payloads`` holds the bytes of each distinct payload
once under their SHA-256, ``records`` the exact header block of every record with
the digest of its payload.  Reading joins both, recomputes every digest and fails
on a payload that does not match its address.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.session import ensure_checkpoint_dir

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: str) -> Column:
    """Upper-case base32 of the SHA-1: twenty bits, five hex digits, make four characters."""
    hexed = F.sha1(F.col(payload))
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for NULL; line ends inside a value are escaped."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def _urn(record_id: str) -> Column:
    return F.concat(F.lit("<urn:record:"), F.col(record_id).cast("string"), F.lit(">"))


def page_records(pages: DataFrame) -> DataFrame:
    """(record_id, url, payload) of raw pages; NULL html is an empty payload."""
    return pages.select(F.col("page_id").alias("record_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))


def write_archive(records: DataFrame, path: str, smallest: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write (record_id, url, payload) as an archive.

    Of equal payloads of at least ``smallest`` bytes the smallest record_id is the
    response and the others revisit it; shorter ones are all responses.  Their
    bytes are stored once either way.  Rows repeated with one record_id are all
    what that id is.  A NULL record_id writes no id field and never becomes the
    owner of a payload that has another.  NULL url writes no URI field.
    """
    digested = records.withColumn("sha256", F.sha2("payload", 256))
    payloads = digested.groupBy("sha256").agg(F.first("payload").alias("payload"))
    payloads.write.mode("errorifexists").parquet(f"{path}/payloads")
    slim = digested.select("record_id", "url", "sha256", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1("payload").alias("sha1"))
    owners = slim.groupBy("sha256").agg(F.min("record_id").alias("owner"))
    joined = slim.join(owners, "sha256")
    revisit = (F.col("bytes") >= smallest) & F.coalesce(~F.col("record_id").eqNullSafe(F.col("owner")), F.lit(False)) & F.col("owner").isNotNull()
    joined = joined.withColumn("revisit", revisit)
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        F.when(F.col("revisit"), F.lit(f"WARC-Type: revisit{CRLF}")).otherwise(F.lit(f"WARC-Type: response{CRLF}")),
        _field("WARC-Record-ID", _urn("record_id")),
        F.lit(f"WARC-Date: {date}{CRLF}"),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("revisit"), F.concat(_field("WARC-Refers-To", _urn("owner")), F.lit(f"WARC-Profile: {PROFILE}{CRLF}"))).otherwise(F.lit("")),
        F.lit(f"Content-Type: text/html; charset=utf-8{CRLF}"),
        F.concat(F.lit("Content-Length: "), F.when(F.col("revisit"), F.lit("0")).otherwise(F.col("bytes").cast("string")), F.lit(CRLF + CRLF)),
    )
    joined.select(F.encode(header, "UTF-8").alias("header"), "sha256").write.mode("errorifexists").parquet(f"{path}/records")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payloads with length and SHA-1; a stored payload that fails its SHA-256 stops the job."""
    kept = spark.read.parquet(f"{path}/payloads")
    checked = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("sha256"))).cast("binary"))
    return kept.select("sha256", checked.alias("payload")).select(
        "sha256", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1("payload").alias("payload_digest"))


def header_field(name: str) -> Column:
    """A field of the header block, NULL where it is absent."""
    found = F.regexp_extract(F.decode(F.col("header"), "UTF-8"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.nullif(found, F.lit(""))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record: header block, payload, and ``record``, the exact bytes of the original WARC record.

    Payload facts are computed once per stored payload, before the join, and a
    caller that leaves ``payload`` and ``record`` out ships no payload at all.
    """
    records = spark.read.parquet(f"{path}/records")
    joined = records.join(read_payloads(spark, path), "sha256")
    kind = header_field("WARC-Type")
    end = F.encode(F.lit(CRLF + CRLF), "UTF-8")
    body = F.when(kind == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return joined.withColumn("record_type", kind).withColumn("record", F.concat("header", body, end))


def record_number(value: Column) -> Column:
    return F.regexp_extract(value, r"^<urn:record:(-?\d+)>$", 1).try_cast("long")


def op2(spark, sf_dir: str) -> DataFrame:
    from panelwright.llm.common import read

    path = f"{ensure_checkpoint_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(page_records(read(spark, sf_dir, "pages")), path)
    return read_archive(spark, path).select(
        record_number(header_field("WARC-Record-ID")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        record_number(header_field("WARC-Refers-To")).alias("refers_to"))


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
o AS (SELECT x, min(page_id) AS owner FROM p GROUP BY x)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(p.x, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM p JOIN o USING (x)"""
