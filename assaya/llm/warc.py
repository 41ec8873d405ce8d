"""Content-addressed WARC archive.

Two tables: ``blobs`` holds each payload once, under its SHA-256; ``headers`` holds the exact
header bytes of every record. Records are rebuilt by joining the two. A digest is trusted only
after the stored bytes have been hashed again (reading fails on a mismatch).

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest
page_id is the response, the others are revisits of it; smaller payloads are always responses.

Defined results: a null html is an empty payload; a null url gives an empty target; a null
page_id sorts after all others, so such a record is a response only if no other holds its
payload; of rows that repeat a page_id and payload one is the response; control characters in
a url are percent-encoded in the header; an empty table gives empty archives; other columns
are not stored.

Groups of copies are dealt out by salts: only counts of partners, digests and payloads of
under ``MIN_REVISIT`` bytes are repeated per salt, so a hot payload never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove, scratch, table, written

MIN_REVISIT = 100
SALTS = 32
_EOL = "\r\n"


def _salt(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")


def _salted(small: DataFrame) -> DataFrame:
    """Each row of ``small`` once per salt."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _header(kind: Column, page_id: Column, url: Column, digest: Column, size: Column, refers: Column, date: str) -> Column:
    """The exact header bytes of one record, up to and with the blank line."""
    target = F.coalesce(url, F.lit(""))
    for c in ("\r", "\n"):
        target = F.replace(target, F.lit(c), F.lit("%%%02X" % ord(c)))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(_EOL))

    revisit = kind == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))),
        F.lit(f"WARC-Date: {date}{_EOL}"),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_EOL}"), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers.cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        F.lit(f"Content-Type: text/html; charset=utf-8{_EOL}"),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(size).cast("string")),
        F.lit(_EOL),
    )


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``pages`` (page_id, url, html) as the tables ``headers`` and ``blobs`` below ``path``."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    index, index_path = written(rows.select("page_id", "url", "digest", "size"), "warc-index")
    owners, owners_path = written(index.groupBy("digest", "size").agg(F.min("page_id").alias("owner")), "warc-owners")

    large = F.col("size") >= MIN_REVISIT
    # Rows that repeat the owner's page_id and payload: one of them is the response.
    nth = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url"))
    owned = owners.where(large).select("digest", "owner")
    is_owner = F.col("page_id").eqNullSafe(F.col("owner"))
    copies = index.where(large).withColumn("salt", _salt(F.col("page_id")))
    copies = copies.join(_salted(owned), ["digest", "salt"]).drop("salt")
    ranked = copies.where(is_owner).withColumn("first", nth == 1).unionByName(copies.where(~is_owner).withColumn("first", F.lit(False)))
    small = index.where(~large).withColumn("owner", F.col("page_id")).withColumn("first", F.lit(True))
    records = ranked.select(*small.columns).unionByName(small)
    kind = F.when(F.col("first"), F.lit("response")).otherwise(F.lit("revisit"))
    refers = F.when(~F.col("first"), F.col("owner"))
    header = _header(kind, F.col("page_id"), F.col("url"), F.col("digest"), F.col("size"), refers, date)
    records.select("page_id", kind.alias("record_type"), refers.alias("refers_to"), "digest", (~large).alias("small"), F.encode(header, "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")

    # Each payload's bytes travel once, with the owner; rows that repeat the owner fold into one.
    mine = owners.select(F.coalesce("owner", F.lit(-1)).alias("page_id"), F.col("owner").isNull().alias("orphan"), F.col("digest"))
    keyed = rows.select(F.coalesce("page_id", F.lit(-1)).alias("page_id"), F.col("page_id").isNull().alias("orphan"), "digest", "payload")
    found = keyed.join(mine, ["page_id", "orphan", "digest"], "left_semi")
    found.groupBy("page_id", "orphan", "digest").agg(F.first("payload").alias("payload")).select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/blobs")
    remove(pages.sparkSession, index_path, owners_path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild the records: page_id, record_type, refers_to, digest, record (bytes; a revisit has no block), payload_bytes and payload_digest of the full payload."""
    headers = spark.read.parquet(f"{path}/headers")
    blobs = spark.read.parquet(f"{path}/blobs")
    found = F.sha2("payload", 256)
    blobs = blobs.select("digest", F.when(found == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("stored bytes do not match digest "), F.col("digest"))).cast("binary")).alias("payload"))
    sized = blobs.select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"))
    tiny = F.col("payload_bytes") < MIN_REVISIT
    # Small payloads may have many responses: these few bytes are repeated per salt. A large one has one response.
    stored = _salted(sized.where(tiny)).unionByName(sized.where(~tiny).withColumn("salt", F.lit(0)))
    salt = F.when(F.col("small"), _salt(F.col("page_id"))).otherwise(F.lit(0))
    tail = F.encode(F.lit(_EOL * 2), "UTF-8")
    responses = headers.where(F.col("record_type") == "response").withColumn("salt", salt).join(stored, ["digest", "salt"])
    responses = responses.select("page_id", "record_type", "refers_to", "digest", F.concat("header", "payload", tail).alias("record"), "payload_bytes")
    known = _salted(sized.where(~tiny).select("digest", "payload_bytes"))
    revisits = headers.where(F.col("record_type") == "revisit").withColumn("salt", _salt(F.col("page_id"))).join(known, ["digest", "salt"])
    revisits = revisits.select("page_id", "record_type", "refers_to", "digest", F.concat("header", tail).alias("record"), "payload_bytes")
    return responses.unionByName(revisits)


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """page_id and the full payload of every record, revisits included."""
    blobs = spark.read.parquet(f"{path}/blobs")
    return spark.read.parquet(f"{path}/headers").join(blobs, "digest").select("page_id", "record_type", "digest", "payload")


def parsed(records: DataFrame) -> DataFrame:
    """What each rebuilt record's own bytes state: the fields of its header, the length and SHA-256 of its block."""
    text = F.decode(F.col("record"), "ISO-8859-1")  # a character for each byte
    out = records.withColumn("_head", F.substring_index(text, _EOL * 2, 1))
    kind = records.schema["page_id"].dataType

    def field(name: str) -> Column:
        return F.regexp_extract("_head", rf"\r\n{name}: ([^\r\n]*)", 1)

    def page(name: str) -> Column:
        return F.when(field(name) != "", F.nullif(F.regexp_extract(field(name), "^<urn:page:(.*)>$", 1), F.lit("none"))).cast(kind)

    start, size = F.length("_head") + 5, F.octet_length("record") - F.length("_head") - 8
    return out.select(
        *records.columns,
        page("WARC-Record-ID").alias("page_read"),
        field("WARC-Type").alias("type_read"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("digest_read"),
        field("Content-Length").cast("long").alias("length_read"),
        size.cast("long").alias("block_bytes"),
        F.sha2(F.substr("record", start, size), 256).alias("block_digest"),
        page("WARC-Refers-To").alias("refers_read"),
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column is read from the rebuilt records; a revisit's payload length is that of the bytes it refers to."""
    path = scratch(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    response = F.col("type_read") == "response"
    return parsed(read_archive(spark, path)).select(
        F.col("page_read").alias("page_id"),
        F.when(response, F.col("block_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.col("block_digest")).otherwise(F.col("digest_read")).alias("payload_digest"),
        F.col("type_read").alias("record_type"),
        F.col("refers_read").alias("refers_to"),
    )


ORACLE_SQL = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha256(html) as payload_digest, min(page_id) over (partition by html) as first_id from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes < {MIN_REVISIT} or page_id = first_id then 'response' else 'revisit' end as record_type,
  case when payload_bytes >= {MIN_REVISIT} and page_id <> first_id then first_id end as refers_to
from d
"""
