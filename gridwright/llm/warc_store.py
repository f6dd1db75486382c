"""Content-addressed WARC archive.

An archive is two tables below one folder: ``payloads`` keeps the bytes of every distinct payload once under its
SHA-256, ``records`` keeps the exact header of every record and the address of its payload.  Original records come
back through a join, and every payload read is verified against the address it was found by and against the SHA-1
and length in its header; a mismatch raises.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest id is the response and
the others revisit it; shorter ones are all responses (their bytes are stored once all the same).

Narrow rows (id, URL, digests) decide everything; payload bytes move once to be made distinct, after each task has
dropped its own copies, and once to meet the records.  A payload that a third of the records share is a hot key of
that second join, which adaptive execution splits on the record side.

Defined results: a null payload is empty; a null URL leaves its header line out; line breaks in a URL are
percent-encoded; an id repeated with the same payload is a response each time; a null id is never the response
that others refer to; an empty table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm.store import shared_path

MIN_REVISIT = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "\r\n"


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))


def _header(record_type: Column, date: str) -> Column:
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    revisit = record_type == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{LINE}"), _line("WARC-Type", record_type), _line("WARC-Record-ID", urn("id")), _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), _line("WARC-Payload-Length", F.col("n").cast("string")),
        _line("WARC-Refers-To", F.when(revisit, urn("holder"))), _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("Content-Type", F.lit("text/html")), _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))), F.lit(LINE))


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", *,
                  min_revisit: int = MIN_REVISIT, date: str = DATE) -> None:
    """Write one record per row of ``pages`` to ``folder``."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    addressed = rows.withColumn("address", F.sha2("payload", 256))
    addressed.select("address", "payload").dropDuplicates(["address"]).write.parquet(f"{folder}/payloads")
    narrow = addressed.select("id", "url", "address", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n"))
    held = narrow.groupBy("address").agg(F.max("id").alias("holder"))
    typed = narrow.join(held, "address").withColumn(
        "type", F.when((F.col("n") >= min_revisit) & ~F.col("id").eqNullSafe(F.col("holder")), "revisit").otherwise("response"))
    typed.select("id", _header(F.col("type"), date).alias("header"), "address").write.parquet(f"{folder}/records")


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """id, header, payload (the full bytes, also of a revisit) and the fields of the header, verified."""
    records = spark.read.parquet(f"{folder}/records")
    payloads = spark.read.parquet(f"{folder}/payloads")
    joined = records.join(payloads, "address", "left")
    fields = joined.select(
        "id", "header", "address", "payload", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        _field("WARC-Type").alias("record_type"), F.nullif(F.regexp_extract("header", r"\r\nWARC-Refers-To: <urn:page:([^>]*)>\r\n", 1), F.lit("")).alias("refers_to"),
        _field("WARC-Target-URI").alias("url"), _field("WARC-Payload-Digest").alias("_digest"), _field("WARC-Payload-Length").alias("_length"))
    sound = (F.sha2("payload", 256) == F.col("address")) & (F.concat(F.lit("sha1:"), F.col("sha1")) == F.col("_digest")) & (
        F.col("payload_bytes").cast("string") == F.col("_length"))
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("archive damaged at "), F.col("address"))).cast("string"))
    kind = records.schema["id"].dataType
    return fields.withColumn("payload_digest", checked).withColumn("refers_to", F.col("refers_to").cast(kind)).drop("sha1", "_digest", "_length")


def record_bytes(header: Column, record_type: Column, payload: Column) -> Column:
    """The original record: header, block and the two closing line breaks."""
    block = F.when(record_type == "revisit", F.lit(b"")).otherwise(payload)
    return F.concat(header.cast("binary"), block, F.lit(LINE * 2).cast("binary"))


def archived(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` to a fresh archive in the shared folder and read it back."""
    folder = shared_path(pages.sparkSession, "archive")
    write_archive(pages, folder, id_col, url, html)
    return read_archive(pages.sparkSession, folder)
