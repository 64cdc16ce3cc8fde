"""A content-addressed WARC archive.

The payload table holds every payload once, under its SHA-256; the header
table holds the exact header of every record and the digest of its payload.
Original records come back by joining the two, and digests are computed anew
from the bytes of what came back. A payload that a third of all records share
is dealt over many tasks in each join.

A null payload is empty, very long ones are kept whole. Payloads of fewer than
``min_revisit_bytes`` bytes are responses all of them; of the other records
with equal payloads the one with the smallest id is the response (a row
repeated with that id too), the rest are revisits. Rows without an id are
responses if no row with their payload has one. A null URL leaves its header
line out; line breaks in a URL are percent-encoded. Only id, URL and payload
are read, so other columns do not matter, whatever their names; an empty table
makes an empty archive. Ids are integers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import join_groups, shared_path, staged

CRLF = "\r\n"
#: The digits of base 32 in order: fixed values.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


@dataclass(frozen=True)
class Archive:
    headers: str
    payloads: str


def base32_sha1(payload) -> F.Column:
    """Bare upper-case base32 SHA-1 of a binary column."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*groups)), BASE32_HEX, BASE32)


def write_archive(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", path: str | None = None) -> Archive:
    """Write a record for each row of ``pages``; payload bytes cross the network once, to the one place of their digest and first id."""
    path = path or shared_path(pages.sparkSession, "warc")
    body, own = F.coalesce(F.col(payload).cast("binary"), F.lit(b"")), F.col(id_col)
    key, owner = F.unhex(F.sha2(body, 256)), F.coalesce(own.cast("string"), F.lit(""))
    rows = pages.select(own.alias("id"), F.col(url).cast("string").alias("url"), key.alias("key"), base32_sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("n"))
    rows = staged(rows, "warc-digests")
    first = staged(rows.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("n_records")), "warc-first")
    told = join_groups(rows, first, ["key"], "n_records", ["id", "url"])
    role = F.when((F.col("n") < min_revisit_bytes) | F.col("id").eqNullSafe(F.col("first_id")), "response").otherwise("revisit")
    told = told.withColumn("role", role)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    length = F.octet_length("http_header") + F.when(F.col("role") == "response", F.col("n")).otherwise(0)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("role")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(F.col("role") == "revisit", F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    told = told.withColumn("http_header", http).select("id", "key", "role", F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2)).alias("record_header"), "http_header")
    told.write.option("compression", "zstd").parquet(f"{path}/headers")
    owners = first.select("key", F.coalesce(F.col("first_id").cast("string"), F.lit("")).alias("owner"), "n_records")
    # repeated rows store their payload once, and so do rows without an id
    bodies = pages.select(key.alias("key"), owner.alias("owner"), body.alias("payload")).join(owners, ["key", "owner"])
    bodies.dropDuplicates(["key", "owner"]).select("key", "n_records", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    return Archive(f"{path}/headers", f"{path}/payloads")


def read_payloads(spark, archive: Archive) -> DataFrame:
    """Stored payloads whose bytes still have the digest they are filed under, and the number of records that have them."""
    rows = spark.read.parquet(archive.payloads)
    intact = F.unhex(F.sha2("payload", 256)) == F.col("key")
    return rows.where(F.when(intact, True).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.hex("key"))).cast("boolean")))


def rebuild_records(spark, archive: Archive) -> DataFrame:
    """``record``: the whole bytes of each WARC record, of which ``header_bytes`` are its header; ``payload``: what it stands for, also of revisits."""
    sizes = spark.read.parquet(archive.payloads).select("key", "n_records")
    rows = join_groups(spark.read.parquet(archive.headers), read_payloads(spark, archive), ["key"], "n_records", ["id"], sizes=sizes)
    body = F.when(F.col("role") == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.encode("record_header", "UTF-8"), F.encode("http_header", "UTF-8"), body, F.lit((CRLF * 2).encode()))
    return rows.select(record.alias("record"), F.octet_length("record_header").alias("header_bytes"), "payload")


def describe_records(spark, archive: Archive) -> DataFrame:
    """``record_id, payload_bytes, payload_digest, record_type, refers_to`` of every rebuilt record.

    Type and references are read from the header in the record's bytes, length
    and digest from the payload that came back with it.
    """
    head = F.decode(F.substring("record", F.lit(1), F.col("header_bytes")), "UTF-8")
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))
    number = lambda name: F.nullif(F.regexp_extract("head", rf"(?m)^{name}: <urn:page:(-?\d+)>", 1), F.lit("")).cast("long")
    rows = rebuild_records(spark, archive).select(head.alias("head"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    return rows.select(number("WARC-Record-ID").alias("record_id"), "payload_bytes", "payload_digest", field("WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"))
