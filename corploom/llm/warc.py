"""Content-addressed WARC archive.

Payload bytes are stored once in a table keyed by their SHA-256, exact record
headers in a table of their own, and a join reconstructs the records.  Payloads
are written in buckets of their key, so that join moves headers to payloads and
never a payload; a payload that very many records share is joined to them in
several tasks.  Every payload read back is hashed again and must bear out its
key; a record whose payload is not there is an error.

Each record has an id of its own, made of its content and its place in the
table.  Page ids, and urls as they were, stand in fields of their own, since a
record id must not repeat and a target URI must not hold line ends (they are
written ``%0D`` and ``%0A`` there).

Defined results: a null payload is the empty one; a null url is the empty
target; very long payloads are stored whole; of equal large payloads those rows
that carry the greatest page id are responses (repeated rows with one id alike),
all others revisit one of them; null ids count as least; an empty table makes an
empty archive; other columns are ignored.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Payloads below this many bytes are always written in full.
LEAST_BYTES = 1000
_END = "\r\n"


def _http(length: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), length.cast("string"), F.lit(_END * 2))


def write_archive(pages: DataFrame, headers_path: str, payloads_path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = LEAST_BYTES, date: datetime | None = None) -> int:
    """Write one WARC record per row as two Parquet tables.

    headers: ``key`` (SHA-256 of the payload), ``header`` (the record's exact
    WARC header and, for responses, HTTP header).  payloads: ``key, payload``.
    ``date`` is when the pages were fetched; if it is not given, now.  Returns
    the number of payloads' buckets, for ``read_records``.
    """
    when = (date or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        body.alias("payload"),
    ).select(
        "id", "url", F.length("payload").cast("long").alias("n"),
        F.unhex(F.sha2("payload", 256)).alias("key"), F.sha1("payload").alias("sha1"), "payload",
    )
    # written once, so that record ids stay as they are if a task runs again
    known = Scratch(pages.sparkSession, "warc")
    told = F.concat_ws(" ", F.monotonically_increasing_id().cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("-")), "sha1", "url")
    lean = known.save(rows.drop("payload").withColumn("name", F.regexp_replace(F.md5(told.cast("binary")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "urn:uuid:$1-$2-$3-$4-$5")))
    # the id that stands for each payload: partially aggregated, so copies meet as one row for each task
    least_id = -(1 << 63)
    first = lean.groupBy("key").agg(
        F.max(F.struct(F.coalesce("id", F.lit(least_id)).alias("id"), "url", "name")).alias("r")
    ).select(F.col("key").alias("k"), F.col("r.id").alias("first_id"), F.col("r.url").alias("first_url"), F.col("r.name").alias("first_name"))
    first = known.save(first)
    joined = lean.join(first, lean["key"] == first["k"])
    response = (F.col("n") < least_bytes) | (F.coalesce("id", F.lit(least_id)) == F.col("first_id"))
    kind = F.when(response, "response").otherwise("revisit")
    http = F.when(response, _http(F.col("n"))).otherwise(F.lit(f"HTTP/1.1 200 OK{_END}{_END}"))
    target = lambda u: F.replace(F.replace(u, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(f"WARC/1.1{_END}WARC-Type: "), kind,
        F.lit(f"{_END}WARC-Record-ID: <"), F.col("name"),
        F.lit(f">{_END}WARC-Date: {when}{_END}WARC-Target-URI: "), target(F.col("url")),
        F.lit(f"{_END}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.lit(f"{_END}X-Payload-Length: "), F.col("n").cast("string"),
        F.when(F.col("id").isNotNull(), F.concat(F.lit(f"{_END}X-Page-Id: "), F.col("id").cast("string"))).otherwise(""),
        F.when(F.col("url").rlike(r"[\r\n]"), F.concat(F.lit(f"{_END}X-Target-Base64: "), F.regexp_replace(F.base64(F.encode("url", "UTF-8")), r"\s", ""))).otherwise(""),
        F.when(response, "").otherwise(F.concat(
            F.lit(f"{_END}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_END}WARC-Refers-To: <"),
            F.col("first_name"), F.lit(f">{_END}WARC-Refers-To-Target-URI: "), target(F.col("first_url")),
            F.when(F.col("first_id") != least_id, F.concat(F.lit(f"{_END}X-Refers-To-Page-Id: "), F.col("first_id").cast("string"))).otherwise(""),
        )),
        F.lit(f"{_END}Content-Type: application/http; msgtype=response{_END}Content-Length: "),
        F.when(response, F.length(http) + F.col("n")).otherwise(F.length(http)).cast("string"),
        F.lit(_END * 2), http,
    )
    joined.select("key", F.encode(header, "UTF-8").alias("header")).write.option("compression", "zstd").parquet(headers_path)
    # payloads: of each key any row's bytes, for they are equal; copies in one task meet before they are dealt
    spark = pages.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"payloads_{uuid.uuid4().hex}"
    once = rows.select("key", "payload").dropDuplicates(["key"])
    once.write.format("parquet").bucketBy(buckets, "key").sortBy("key").option("compression", "zstd").option("path", payloads_path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone; the files are the archive's
    known.drop(first, lean)
    return buckets


def read_headers(spark: SparkSession, headers_path: str) -> DataFrame:
    """Parsed headers: ``key, header, page_id, url, record_type, payload_digest, payload_bytes, refers_to``."""
    text = F.decode("header", "UTF-8")
    field = lambda name, rx: F.regexp_extract(text, rf"\r\n{name}: {rx}\r\n", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    return spark.read.schema("key binary, header binary").parquet(headers_path).select(
        "key", "header",
        number(field("X-Page-Id", r"(-?\d+)")).alias("page_id"),
        F.coalesce(F.decode(F.unbase64(F.nullif(field("X-Target-Base64", r"([^\r]*)"), F.lit(""))), "UTF-8"), field("WARC-Target-URI", r"([^\r]*)")).alias("url"),
        F.regexp_extract(text, r"^WARC/1\.1\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type"),
        field("WARC-Payload-Digest", r"sha1:([0-9a-f]*)").alias("payload_digest"),
        number(field("X-Payload-Length", r"(\d+)")).alias("payload_bytes"),
        number(field("X-Refers-To-Page-Id", r"(-?\d+)")).alias("refers_to"),
    )


def read_payloads(spark: SparkSession, payloads_path: str, buckets: int | None = None) -> DataFrame:
    """``key, payload``; fails where the stored bytes do not bear out their key.  With ``buckets`` rows stay where their key's bucket is read."""
    if buckets is None:
        stored = spark.read.schema("key binary, payload binary").parquet(payloads_path)
    else:
        name = f"payloads_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {name} (key BINARY, payload BINARY) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{payloads_path}'")
        stored = spark.table(name)
    return stored.select(
        "key",
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("key"), F.col("payload")).otherwise(
            F.raise_error(F.concat(F.lit("stored payload differs from its digest "), F.hex("key"))).cast("binary")
        ).alias("payload"),
    )


def read_records(spark: SparkSession, headers_path: str, payloads_path: str, buckets: int | None = None) -> DataFrame:
    """Original records: the parsed header, ``payload`` and the exact ``record`` bytes; fails where a payload is missing.

    With ``buckets``, as ``write_archive`` returned it, no payload is shuffled
    but those of hot keys: a key with more than half a bucket's share of the
    records, so at most two for each bucket.  Their records are dealt into as
    many shares as they are worth, with a copy of the payload each; that makes
    four copies for each bucket at most.
    """
    heads, payloads = read_headers(spark, headers_path), read_payloads(spark, payloads_path, buckets)
    if buckets is None:
        whole = heads.join(payloads, "key", "left")
    else:
        stored = spark.read.schema("key binary").parquet(headers_path)
        share = max(1.0, stored.count() / (2 * buckets))
        hot = stored.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share)
        hot = Scratch(spark, "warc").save(hot.select(F.col("key").alias("hot"), F.ceil(F.col("n") / share).cast("int").alias("shares")))
        told = heads.join(F.broadcast(hot), F.col("key") == F.col("hot"), "left")  # two keys for each bucket at most
        cold = told.where("hot is null").drop("hot", "shares").join(payloads, "key", "left")
        dealt = told.where("hot is not null").withColumn("share", F.pmod(F.xxhash64("header"), F.col("shares")).cast("int")).drop("hot", "shares")
        copies = payloads.join(F.broadcast(hot), F.col("key") == F.col("hot")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("key", "share", "payload")
        whole = cold.unionByName(dealt.join(copies, ["key", "share"], "left").drop("share"))
    missing = F.raise_error(F.concat(F.lit("no stored payload of digest "), F.hex("key"))).cast("binary")
    whole = whole.withColumn("payload", F.coalesce("payload", missing))
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return whole.withColumn("record", F.concat("header", block, F.encode(F.lit(_END * 2), "UTF-8")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written and its record read back; digest and length are those of the payload in the reconstructed record."""
    place = Scratch(spark, "archive")
    headers, payloads = place.path(), place.path()
    buckets = write_archive(table(spark, sf_dir, "pages"), headers, payloads)
    records = read_records(spark, headers, payloads, buckets)
    told = F.sha1("payload").alias("payload_digest")
    return records.select("page_id", F.length("payload").cast("long").alias("payload_bytes"), told, "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         sha256(coalesce(html, '')) AS k
  FROM pages
), q AS (SELECT *, max(page_id) OVER (PARTITION BY k) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 1000 OR page_id = top THEN NULL ELSE top END AS refers_to
FROM q
"""
