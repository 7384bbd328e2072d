"""Content-addressed WARC archive.

An archive is two Parquet tables in a folder that all executors share:
``payloads`` (digest, payload) holds the bytes of every distinct payload once,
``headers`` (page_id, url, digest, header) the exact header block of every
record. The key is the SHA-256 of the bytes; WARC's own SHA-1 is in the header.
Reading joins the two on the key, checks each payload against it once, and
rebuilds the records: a response's is header, payload and the closing line
ends, a revisit's has no payload of its own, but its full payload is known from
the join. All steps are Spark SQL; per record only digests and numbers are
grouped, so that a payload shared by a third of the pages is counted before
the shuffle, and payloads move at most once, not at all while there are fewer
than ``BROADCAST_ROWS`` repetitions.

Among records with equal payloads of at least ``min_bytes`` the one with the
smallest (page_id, url), nulls last, is the response and the others revisit it;
smaller payloads are all responses.

Rows: null html is the empty payload, a null page_id is written as an empty
number and read back as null, a null url as the empty string. Rows equal in
every column are records of their own, of which one at most is the response.
An empty table gives an empty archive. Other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_BYTES = 0
BROADCAST_ROWS = 1_000_000


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal digest whose bits divide by 20."""
    chars = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1))
                  for shift in (15, 10, 5, 0)]
    return F.concat(*chars)


def _line(name: str, value: Column) -> Column:
    """A header line; line ends within a value would end it and are escaped."""
    value = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Writes ``pages`` as an archive into the folder."""
    payload = F.col(payload_col)
    if dict(pages.dtypes)[payload_col] != "binary":
        payload = F.encode(payload.cast("string"), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                        F.coalesce(payload, F.lit(b"")).alias("payload"))
    keyed = rows.withColumn("digest", F.sha2("payload", 256))
    heads = keyed.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"),
                         F.sha1("payload").alias("sha1"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    alike = heads.groupBy("page_id", "url", "digest", "bytes", "sha1").agg(F.count("*").alias("copies"))
    first = alike.groupBy("digest").agg(F.min(order).alias("first"))
    records = (alike.join(first, "digest")
               .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
               .withColumn("response", (F.col("bytes") < min_bytes)
                           | (F.col("copy") == 1) & F.col("page_id").eqNullSafe(F.col("first.page_id"))
                           & (F.col("url") == F.col("first.url"))))
    digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("response"), "response").otherwise("revisit")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", digest),
        F.when(F.col("response"), "").otherwise(F.concat(
            _line("WARC-Refers-To", _urn(F.col("first.page_id"))), _line("WARC-Profile", F.lit(REVISIT_PROFILE)))),
        _line("Content-Length", F.when(F.col("response"), F.col("bytes")).otherwise(0).cast("string")),
        F.lit("\r\n"))
    records.select("page_id", "url", "digest", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{folder}/headers")
    # The bytes of each payload once. What is not the first of its kind, or not
    # the only row like it, is left out; rows like others are reduced to one apart.
    firsts = alike.join(first, "digest").withColumn(
        "is_first", F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("url") == F.col("first.url")))
    apart = cut(firsts.filter("copies > 1 OR NOT is_first").select(
        F.col("digest").alias("d"), F.col("page_id").alias("p"), F.col("url").alias("u"), "is_first"))
    same = (F.col("digest") == F.col("d")) & (F.col("url") == F.col("u")) & F.col("page_id").eqNullSafe(F.col("p"))
    if apart.count() <= BROADCAST_ROWS:  # then payloads need not move
        single = keyed.join(F.broadcast(apart), same, "left_anti")
        several = keyed.join(F.broadcast(apart.filter("is_first")), same, "left_semi")
    else:
        single = keyed.join(apart, same, "left_anti")
        several = keyed.join(apart.filter("is_first"), same, "left_semi")
    several = several.groupBy("digest", "url", "page_id").agg(F.first("payload").alias("payload"))
    single.select("digest", "payload").unionAll(several.select("digest", "payload")).write.parquet(f"{folder}/payloads")


def _field(name: str) -> Column:
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def _joined(spark: SparkSession, folder: str, with_bytes: bool) -> DataFrame:
    stored = spark.read.parquet(f"{folder}/payloads").select(
        "digest", *["payload"] * with_bytes, F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_of_hex(F.sha1("payload")).alias("payload_digest"),
        (F.sha2("payload", 256) == F.col("digest")).alias("verified"))
    return spark.read.parquet(f"{folder}/headers").join(stored, "digest", "left")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Per record of the archive: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, and verified: the stored bytes have the key they
    are stored under and the digest that the header states."""
    refers = _field("WARC-Refers-To")
    return _joined(spark, folder, False).select(
        F.regexp_extract(_field("WARC-Record-ID"), r"<urn:page:([^>]*)>", 1).alias("id"), "page_id", "url", "payload_bytes",
        "payload_digest", _field("WARC-Type").alias("record_type"),
        F.nullif(F.regexp_extract(refers, r"<urn:page:([^>]*)>", 1), F.lit("")).alias("refers_to"),
        (F.col("verified") & (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))))
        .alias("verified"))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, record, payload): the exact bytes of every record as a
    WARC file holds them, and its full payload."""
    body = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return _joined(spark, folder, True).select(
        "page_id", "url", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages")
    write_archive(pages, folder)
    kind = dict(pages.dtypes)["page_id"]
    return read_index(spark, folder).select(
        F.nullif("id", F.lit("")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"), "verified")


OP8_SQL = f"""
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h,
         row_number() OVER (PARTITION BY payload ORDER BY page_id NULLS LAST, url NULLS FIRST) AS k,
         first_value(page_id) OVER (PARTITION BY payload ORDER BY page_id NULLS LAST, url NULLS FIRST) AS first_id
  FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{BASE32}',
         (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INT) >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k = 1 THEN NULL ELSE first_id END AS refers_to, TRUE AS verified
FROM d
"""
