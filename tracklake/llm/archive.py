"""Content-addressed WARC archive.

The archive is two Parquet tables: ``payloads`` holds the bytes of each distinct
payload once under its SHA-256, ``records`` holds the exact header block of every
record and the address of its payload.  Original records are put together again by a
join on the address; every payload read back is hashed and compared first.

Of records with equal payloads of at least ``revisit_bytes`` bytes the one with the
largest page_id is the response and the others are revisits that refer to it;
smaller payloads are always responses.  Equal payloads are stored once either way.

Defined results: a null html is an empty payload; a null url is written as an empty
target; rows that repeat a page_id with equal payload are records of their own, each
of the same type (the largest page_id is the response's even when it repeats); a null
page_id never becomes the response while another is there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder

REVISIT_BYTES = 1000
#: Records of one payload join in so many groups, as very many may share it.
JOIN_GROUPS = 8
# fixed values: header names and the profile of a revisit by equal payload digest (WARC 1.1)
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def header() -> Column:
    """The header block of a record from the columns of ``describe``, ending with the empty line."""
    crlf = "\r\n"
    fields = [
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(F.regexp_replace("url", r"[\r\n]", " "), F.lit(""))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to")))),
        F.when(F.col("record_type") == "revisit", F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        # a revisit has no block of its own
        F.concat(F.lit("Content-Length: "), F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    return F.concat(F.concat_ws(crlf, F.lit(VERSION), *fields), F.lit(crlf + crlf))


def describe(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Record columns of every page without its payload: only ids, sizes and digests are shuffled."""
    payload = _payload(F.col("html"))
    read = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"), F.sha2(payload, 256).alias("address"),
    )
    # an aggregate combines on the map side, so a payload shared by very many pages is no hot key
    first = read.groupBy("address").agg(F.max("page_id").alias("_response"))
    salted = first.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(JOIN_GROUPS - 1))))
    dealt = read.withColumn("_group", F.pmod(F.xxhash64("page_id", "url"), F.lit(JOIN_GROUPS)).cast("int"))
    joined = dealt.join(salted, ["address", "_group"])
    revisit = (F.col("payload_bytes") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("_response"))
    return joined.select(
        "page_id", "url", "payload_bytes", "payload_digest", "address",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("_response")).alias("refers_to"),
    )


def write(pages: DataFrame, folder: str | None = None, revisit_bytes: int = REVISIT_BYTES) -> str:
    """Write the archive and return its folder (by default a new one in the shared folder)."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/archive-{uuid.uuid4().hex}"
    describe(pages, revisit_bytes).select(header().alias("header"), "address", "page_id").write.parquet(f"{folder}/records")
    payload = _payload(F.col("html"))
    holders = pages.select(payload.alias("payload"), F.sha2(payload, 256).alias("address"))
    holders.groupBy("address").agg(F.any_value("payload").alias("payload")).write.parquet(f"{folder}/payloads")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records with their verified payloads: header, payload, page_id.

    Fails on a payload whose bytes do not hash to its address.  Each payload has one row,
    so adaptive execution can split the records of a frequent one.
    """
    stored = spark.read.parquet(f"{folder}/payloads")
    sound = F.sha2("payload", 256) == F.col("address")
    verified = stored.select("address", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "address"))).alias("payload"))
    return spark.read.parquet(f"{folder}/records").join(verified, "address").select("header", "payload", "page_id")


def restore(records: DataFrame) -> DataFrame:
    """Exact bytes of each original record (header, payload unless a revisit, closing lines)."""
    block = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select("page_id", F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n")).alias("record"))


def field(name: str) -> Column:
    """Value of a header field, null if absent."""
    value = F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(F.col("header").contains(f"\r\n{name}: "), value)


def listing(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from the archive."""
    def page_of(name: str) -> Column:
        return F.regexp_extract(field(name), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

    return records.select(
        page_of("WARC-Record-ID").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), field("WARC-Type").alias("record_type"), page_of("WARC-Refers-To").alias("refers_to"),
    )
