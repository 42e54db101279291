"""A content-addressed web archive.

``write_archive`` makes two Parquet tables: ``payloads`` holds the bytes of every payload once,
by SHA-256; ``headers`` holds each record's exact header block and the digest of its payload.
``read_archive`` joins them back to whole records and checks every payload against its digest.

Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is
the response and the others are revisits; smaller payloads are all responses.

Defined cases: a null html is an empty payload; a null url leaves the target line out; control
characters in a url are percent-encoded, so a header line never breaks; a null page_id gives
``<urn:page:null>`` and counts as the smallest; repeated rows of one page are records of the
same kind; an empty table gives an empty archive; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_END))


def _safe(url: Column) -> Column:
    for code in (*range(32), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def _header(date: str) -> Column:
    """The exact header block of a record, up to and with the blank line."""
    revisit = F.col("refers_to").isNotNull()
    return F.concat(
        F.lit("WARC/1.1" + _END),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", _safe(F.col("url"))), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _urn(F.col("refers_to"))), _line("WARC-Profile", F.lit(_PROFILE)))).otherwise(F.lit("")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(_END),
    )


def write_archive(pages: DataFrame, path: str, least: int = LEAST, date: str = DATE) -> None:
    """Write the records of ``pages`` (page_id, url, html) below ``path``.

    Each payload is hashed where it is read.  Only digests and ids are shuffled to choose the
    responses (map-side maxima, so a payload of a third of all pages costs no more).
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    hashed = pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    spark = pages.sparkSession
    hashed.drop("payload").write.parquet(f"{path}/records")
    records = spark.read.schema(hashed.drop("payload").schema).parquet(f"{path}/records")
    best = records.groupBy("sha256").agg(
        F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("members"),
        # one strong digest must mean one payload
        F.assert_true((F.min("payload_bytes") == F.max("payload_bytes")) & (F.min("sha1") == F.max("sha1"))).alias("checked"),
    )
    best = best.filter(F.col("checked").isNull()).drop("checked")
    shared = best.filter("members > 1")
    # the bytes of a payload that occurs once stay where they are read; only shared ones look for their keeper
    joined = records.join(shared.withColumnRenamed("sha256", "digest"), F.col("sha256") == F.col("digest"), "left")
    revisit = F.col("digest").isNotNull() & (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    joined.withColumn("refers_to", F.when(revisit, F.col("keeper"))).select(
        "page_id", "sha256", _header(date).alias("header"),
    ).write.parquet(f"{path}/headers")
    hashed.select("sha256", "payload").groupBy("sha256").agg(F.any_value("payload").alias("payload")).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The original records: ``page_id, header, payload, record`` with the exact bytes.

    ``record`` is what a WARC file would hold: header block, body (none for a revisit) and the
    two closing line ends.  A payload that does not match its digest fails the read.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    right = F.sha2("payload", 256) == F.col("sha256")
    payloads = payloads.filter(F.when(right, F.lit(True)).otherwise(F.raise_error(F.lit("payload digest mismatch")).cast("boolean")))
    body = F.when(F.col("header").contains("\nWARC-Type: revisit\r"), F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n"))
    return headers.join(payloads, "sha256").select("page_id", "header", "payload", record.alias("record"))


def field(name: str) -> Column:
    found = F.regexp_extract("header", rf"\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def record_index(records: DataFrame) -> DataFrame:
    """What the header lines and the bytes of each record say."""
    refers = F.regexp_extract(field("WARC-Refers-To"), "^<urn:page:(.*)>$", 1).try_cast("bigint")
    return records.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        refers.alias("refers_to"),
    )


def archive_round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write ``pages`` to a fresh archive in the shared folder and index what is read back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "archive")
    write_archive(pages, path, least)
    return record_index(read_archive(spark, path))
