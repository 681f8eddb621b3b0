"""Content-addressed web archive: payloads stored once, exact record headers kept apart.

An archive is a folder of two Parquet tables.

* ``payloads``: every distinct payload once, under its SHA-256. A digest counts only if it holds:
  a payload is hashed again when it is read, and one that doesn't match its key fails the job.
* ``headers``: for every record the exact text of its WARC header block, the digest of its
  payload and its place among the records.

Records with equal payloads of at least ``least_bytes`` bytes share one response, that with the
smallest page id; the others are revisits that refer to it. Smaller ones are all responses. Joins
by digest put the two tables together again: ``records`` gives each page's header and its whole
payload, ``export`` writes standard WARC files, in which a revisit has no payload.

Hashes are computed where the pages are read. Which record is the response is decided on digests
and ids (aggregated before they are shuffled); payloads are reduced to one per digest in the map
tasks first, so a payload that a third of the pages share costs one row per task. Everything is
DataFrame functions.

Defined results
* a null html is an empty payload; equal empty payloads are revisits like any other;
* null page ids come after all others; a revisit of a response without an id has a null refers_to;
* repeated rows are records of their own, one of them the response;
* carriage returns and line feeds in a URL are percent-encoded in its header line; a null URL has
  no header line;
* an empty table gives an archive without records;
* only the id, the URL and the html are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wosearch.session import materialise, new_path

LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the format.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"

HEADERS = (
    "page_id long, record_type string, refers_to long, header string, payload_sha256 string"
)


def base32(hex_digest: Column) -> Column:
    """RFC 4648 text of a digest given in hex, whose length is a multiple of 5 bytes."""
    # Five hex digits are four letters.
    def letters(group: Column) -> Column:
        value = F.conv(F.substr(hex_digest, group * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*(
            F.substr(F.lit(ALPHABET), F.shiftright(value, bits).bitwiseAND(31) + 1, F.lit(1))
            for bits in (15, 10, 5, 0)
        ))

    groups = F.sequence(F.lit(0), (F.length(hex_digest) / 5).cast("int") - 1)
    return F.array_join(F.transform(groups, letters), "")


def record_id(*parts: Column) -> Column:
    """A URN that depends on the parts alone, so that reruns over the same splits agree."""
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)).cast("binary"))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts)), F.lit(">"))


def _one_line(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _header_block(date: str) -> Column:
    """The record's header lines, up to and with the empty line.

    The block of a response is its payload, that of a revisit is empty.
    """
    is_revisit = F.col("record_type") == "revisit"

    def line(name: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
        return F.coalesce(text if when is None else F.when(when, text), F.lit(""))

    return F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _one_line(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_sha1"))),
        line("WARC-Profile", F.lit(PROFILE), is_revisit),
        line("WARC-Refers-To", F.col("refers_to_record"), is_revisit),
        line("WARC-Refers-To-Target-URI", _one_line(F.col("refers_to_url")), is_revisit),
        line("WARC-Refers-To-Date", F.lit(date), is_revisit),
        # Extension fields: the archive's own keys.
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("X-Refers-To-Page-Id", F.col("refers_to").cast("string"), is_revisit),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(is_revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )


def field(header: Column, name: str) -> Column:
    """Value of a header line, null where there is none."""
    found = F.regexp_extract(header, f"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.contains(header, F.lit(f"{CRLF}{name}: ")), found)


def _payload(html: Column) -> Column:
    return F.coalesce(html.cast("string"), F.lit("")).cast("binary")


def write(
    pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = DATE,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> None:
    """Archive the pages in the folder ``path``."""
    whole = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        _payload(F.col(html_col)).alias("payload"),
    )
    # One row per record without its payload; ``row`` tells repeated rows apart.
    known = materialise(
        whole.select(
            "page_id", "url", F.monotonically_increasing_id().alias("row"),
            F.sha2("payload", 256).alias("payload_sha256"),
            base32(F.sha1("payload")).alias("payload_sha1"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
        ).withColumn("record_id", record_id(F.col("page_id"), F.col("url"), F.col("row"), F.col("payload_sha1"))),
        "warc-records",
    )
    first = F.min(F.struct(
        F.col("page_id").isNull().alias("no_id"), "page_id", "row", "record_id", "url"
    ))
    shared = known.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_sha256").agg(
        first.alias("first"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1").select(
        "payload_sha256", F.col("first.page_id").alias("response_id"),
        F.col("first.row").alias("response_row"),
        F.col("first.record_id").alias("response_record"), F.col("first.url").alias("response_url"),
    )
    is_revisit = F.col("response_row") != F.col("row")
    typed = known.join(shared, "payload_sha256", "left").withColumns({
        "record_type": F.when(is_revisit, "revisit").otherwise("response"),
        "refers_to": F.when(is_revisit, F.col("response_id")),
        "refers_to_record": F.when(is_revisit, F.col("response_record")),
        "refers_to_url": F.when(is_revisit, F.col("response_url")),
    })
    typed.select(
        "page_id", "record_type", "refers_to", _header_block(date).alias("header"), "payload_sha256"
    ).write.parquet(f"{path}/headers")
    once = whole.select(F.sha2("payload", 256).alias("payload_sha256"), "payload").groupBy(
        "payload_sha256"
    ).agg(F.first("payload").alias("payload"))
    once.write.parquet(f"{path}/payloads")


def headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEADERS).parquet(f"{path}/headers")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """payload_sha256, payload; one whose digest isn't its key fails the job."""
    stored = spark.read.schema("payload_sha256 string, payload binary").parquet(f"{path}/payloads")
    return stored.withColumn("payload", F.when(
        F.sha2("payload", 256) == F.col("payload_sha256"), F.col("payload")
    ).otherwise(F.raise_error(
        F.concat(F.lit("a stored payload doesn't match its digest "), "payload_sha256")
    ).cast("binary")))


def records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: header columns, header text and the whole payload of each."""
    return headers(spark, path).join(payloads(spark, path), "payload_sha256")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per record as read back: page_id, payload_bytes, payload_digest, record_type,

    refers_to. Ids, types and references come from the header texts. Lengths and digests are those
    of the stored payloads, computed once for each; payloads don't travel.
    """
    stored = payloads(spark, path).select(
        "payload_sha256", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"),
    )
    header = F.col("header")
    read = headers(spark, path).select(
        field(header, "X-Page-Id").cast("long").alias("page_id"),
        field(header, "WARC-Type").alias("record_type"),
        field(header, "X-Refers-To-Page-Id").cast("long").alias("refers_to"), "payload_sha256",
    )
    return read.join(stored, "payload_sha256").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def export(spark: SparkSession, path: str, out: str, compression: str = "none") -> None:
    """Write the records as standard WARC files; a record ends with two line breaks.

    Payloads are joined to responses only.
    """
    own = headers(spark, path)
    bodies = payloads(spark, path).withColumn("payload", F.col("payload").cast("string"))
    full = own.filter("record_type = 'response'").join(bodies, "payload_sha256").select(
        F.concat("header", "payload").alias("value")
    )
    empty = own.filter("record_type = 'revisit'").select(F.col("header").alias("value"))
    full.unionByName(empty).write.option("lineSep", CRLF * 2).option(
        "compression", compression
    ).text(out)


def archive(pages: DataFrame) -> DataFrame:
    """Archive the pages in the shared folder and read the records back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    return digests(spark, path)
