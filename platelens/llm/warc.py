"""Content-addressed web archive.

Payload bytes are stored once per strong digest (SHA-256); every record keeps
its exact WARC header block in a separate table that names the payload's
digest. Reading back joins the two, recomputes the digests from the stored bytes
and fails if a header disagrees with them. Payloads that repeat collapse in the
task that scans them, before the only shuffle that carries payloads; headers
join on the digest without the payload unless whole records are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column: 40 bits of the hex digest make
    8 digits of base 32, which are then renamed to the RFC 4648 alphabet."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), *_BASE32)


def block_of(record: Column) -> Column:
    """The block of a whole record: what stands between the first blank line and
    the two line ends (one byte a character in ISO-8859-1, so places are bytes)."""
    start = F.instr(F.decode(record, "ISO-8859-1"), "\r\n\r\n") + 4
    return F.substring(record, start, F.octet_length(record) - start - 3)


def rebuilt(records: DataFrame) -> DataFrame:
    """``records`` of an archive with lengths and digests measured on the whole
    records: on a response's own block, on the payload a revisit's digest names.
    A record that differs from its stored payload is an error."""
    response = F.col("record_type") == "response"
    body = F.when(response, block_of(F.col("record"))).when(F.octet_length(block_of(F.col("record"))) == 0, F.col("payload"))
    return (records.withColumn("_body", body).withColumn("_sha1", base32_sha1(F.col("_body")))
            .withColumn("payload_bytes", F.octet_length("_body").cast("long"))
            .withColumn("payload_digest", F.when(F.col("_sha1") == F.col("payload_digest"), F.col("_sha1")).otherwise(
                F.raise_error(F.lit("archive record does not hold its payload"))))
            .drop("_body", "_sha1"))


def _urn(id_: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(">"))


def write_archive(records: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url",
                  body_col: str = "html", date: str = "1970-01-01T00:00:00Z", least: int = 0) -> None:
    """Write ``records`` under ``path`` as payloads/ and headers/.

    The payload is the body in UTF-8 (null: empty). Of records with equal
    payloads of at least ``least`` bytes the one with the smallest id is the
    response (a null id comes last; rows that repeat that id and payload are the
    same record and all responses), the others are revisits of it; smaller
    payloads are always responses. CR and LF are taken out of URIs; a null URI
    has no header line. Other columns are not read. An empty table gives an
    empty archive.
    """
    rows = records.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{uri_col}`").alias("_uri"),
                          F.encode(F.coalesce(F.col(f"`{body_col}`"), F.lit("")), "UTF-8").alias("payload"))
    hashed = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    store = (hashed.groupBy("digest")
             .agg(F.first("payload").alias("payload"), F.min("_id").alias("response_id")))
    store.write.option("compression", "zstd").parquet(f"{path}/payloads")

    spark = records.sparkSession
    kept = spark.read.schema(store.schema).parquet(f"{path}/payloads").select("digest", "response_id")
    per_row = hashed.select("_id", "_uri", "digest", F.octet_length("payload").alias("n"),
                            base32_sha1(F.col("payload")).alias("sha1"))
    first = F.col("_id").eqNullSafe(F.col("response_id")) | (F.col("n") < least)

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(_END))

    header = F.concat(
        F.lit("WARC/1.1" + _END),
        line("WARC-Type", F.when(first, "response").otherwise("revisit")),
        line("WARC-Record-ID", _urn(F.col("_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("_uri", "[\r\n]", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(first, "").otherwise(F.concat(line("WARC-Refers-To", _urn(F.col("response_id"))),
                                             line("WARC-Profile", F.lit(_PROFILE)))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(first, F.col("n")).otherwise(0).cast("string")))
    (per_row.join(kept, "digest").select("digest", F.encode(header, "UTF-8").alias("header"))
     .write.option("compression", "zstd").parquet(f"{path}/headers"))


def read_archive(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The archive's records, one row each: page_id, record_type, refers_to,
    payload_bytes, payload_digest, the payload itself and the whole record
    (header, blank line, block, two line ends) as it stands in a WARC file.

    Lengths and digests are computed from the stored bytes before the join, so a
    reader that asks for neither ``payload`` nor ``record`` moves no payloads.
    A stored payload that does not match its digest, or a header that names
    another one, is an error.
    """
    stored = (spark.read.schema("digest binary, payload binary, response_id " + id_type)
              .parquet(f"{path}/payloads")
              .select(F.col("digest").alias("_d"), "payload",
                      F.octet_length("payload").cast("long").alias("payload_bytes"),
                      base32_sha1(F.col("payload")).alias("payload_digest"),
                      (F.unhex(F.sha2("payload", 256)) == F.col("digest")).alias("_sound")))
    head = F.decode("header", "UTF-8")

    def value(name: str) -> Column:
        got = F.regexp_extract(head, rf"(?m)^{name}: ([^\r\n]*)", 1)
        return F.when(got != "", got)

    heads = (spark.read.schema("digest binary, header binary").parquet(f"{path}/headers")
             .select("digest", "header",
                     F.regexp_extract(value("WARC-Record-ID"), ":x-page:([^>]*)>", 1).try_cast(id_type).alias("page_id"),
                     value("WARC-Type").alias("record_type"),
                     F.regexp_extract(value("WARC-Refers-To"), ":x-page:([^>]*)>", 1).try_cast(id_type).alias("refers_to"),
                     value("WARC-Payload-Digest").alias("_named")))
    sound = F.col("_sound") & (F.col("_named") == F.concat(F.lit("sha1:"), F.col("payload_digest")))
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    crlf = F.lit(b"\r\n")
    return (heads.join(stored, heads.digest == stored._d)
            .select("page_id", "record_type", "refers_to", "payload_bytes",
                    F.when(sound, F.col("payload_digest")).otherwise(
                        F.raise_error(F.lit("archive payload does not match its digest"))).alias("payload_digest"),
                    "payload", F.concat(F.col("header"), crlf, block, crlf, crlf).alias("record")))
