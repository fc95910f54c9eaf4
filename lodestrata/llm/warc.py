"""WARC as a content-addressed archive: payload bytes once per strong digest, record headers apart, records by join.

`write_archive` stores one Parquet table, payloads: seq, address (SHA-256 of the payload, hex), header (the exact bytes of each record before its
payload: the WARC header with its empty line, and of a response the HTTP head with its own) and, of responses alone, payload. What is
revisited is there once.

`read_archive` verifies that each payload has that SHA-256, that its SHA-1 is the header's WARC-Payload-Digest and that the
header's length is right, and joins the revisits to the responses on the address; `record_bytes`
gives the WARC/1.1 record back, byte for byte, and `parse_records` takes such records apart again, by their bytes alone. A response record holds its payload; a revisit record
has an empty block and names the record that it repeats, and its payload comes from the join where it is asked for.

Of records with equal payloads of at least `min_revisit` bytes the one with the smallest page_id (null
last; of repeated rows one) is the response and the others are revisits of it.

Defined cases: null html is the empty payload; null URLs give an empty WARC-Target-URI, and line ends in one are percent-encoded; repeated rows
are records of their own. An empty table gives an empty archive. A payload or header that fails
verification stops the read with an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import materialize, table_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
WARC_DATE = "2024-01-01T00:00:00Z"
RECORD_SCHEMA = "seq long, address string, header binary, payload binary"
MIN_REVISIT = 0


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 hex digits as 8 groups of 20 bits, 4 characters each."""
    digest = F.sha1(data)
    chars = []
    for g in range(8):
        bits = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*chars)


def _record_id(page: Column, seq: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), seq.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def http_head(length: Column) -> Column:
    """The head of an HTTP response with a payload of so many bytes, as bytes."""
    said = ["HTTP/1.1 200 OK", CRLF, "Content-Type: text/html; charset=utf-8", CRLF, "Content-Length: "]
    return F.encode(F.concat(F.lit("".join(said)), length.cast("string"), F.lit(CRLF * 2)), "UTF-8")


def write_archive(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> str:
    """Archive all rows of pages (page_id, url, html); the folder's path."""
    spark = pages.sparkSession
    path = table_path(spark, "warc")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    addressed = pages.select(F.monotonically_increasing_id().alias("seq"), "page_id", "url", payload.alias("payload"))
    address = F.sha2("payload", 256).alias("address")
    digests = addressed.select(
        "seq",
        "page_id",
        # Line ends would end the header field.
        F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        sha1_base32(F.concat(http_head(F.length("payload")), "payload")).alias("block_sha1"),
        address,
        sha1_base32(F.col("payload")).alias("sha1"),
        F.length("payload").cast("long").alias("length"),
        "payload",
    )
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id"), F.col("seq")))
    # Written, so that the join below has an exchange on both sides and a hot address can be split. pages must give the same rows whenever they are read.
    owned = addressed.select("seq", "page_id", address).groupBy("address").agg(first.alias("owner"))
    owners = materialize(owned.select("address", F.col("owner.seq").alias("owner_seq"), F.col("owner.page_id").alias("owner_page")), "warc-owners")
    repeats = (F.col("length") >= min_revisit) & (F.col("seq") != F.col("owner_seq"))
    kind = F.when(repeats, "revisit").otherwise("response")
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        field("WARC-Type", kind),
        field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("seq"))),
        field("WARC-Date", F.lit(WARC_DATE)),
        field("WARC-Target-URI", F.col("url")),
        field("X-Page-Id", number("page_id")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(
            repeats,
            F.concat(
                field("WARC-Refers-To", _record_id(F.col("owner_page"), F.col("owner_seq"))),
                field("X-Refers-To-Page-Id", number("owner_page")),
                field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ),
        ).otherwise(""),
        field("X-Payload-Length", number("length")),
        F.when(~repeats, F.concat(field("Content-Type", F.lit("application/http;msgtype=response")), field("WARC-Block-Digest", F.concat(F.lit("sha1:"), "block_sha1")))).otherwise(""),
        field("Content-Length", F.when(repeats, F.lit(0).cast("long")).otherwise(F.col("length") + F.length(http_head(F.col("length")))).cast("string")),
        F.lit(CRLF),
        F.when(~repeats, F.decode(http_head(F.col("length")), "UTF-8")).otherwise(""),
    )
    # Payloads go through one shuffle, with what their headers need.
    records = digests.join(owners, "address").select("seq", "address", F.encode(header, "UTF-8").alias("header"), F.when(~repeats, F.col("payload")).alias("payload"))
    records.write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def header_field(header: Column, name: str) -> Column:
    """A field's value from header text; null where there is no such field."""
    line = rf"(?s)\r\n{name}: ([^\r]*)\r\n"
    return F.when(header.rlike(line), F.regexp_extract(header, line, 1))


def read_archive(spark: SparkSession, path: str, repeated: bool = True) -> DataFrame:
    """seq, header, payload and the fields of every record, verified. Without `repeated`, revisits have no payload: then digests and lengths alone are joined."""
    records = spark.read.schema(RECORD_SCHEMA).parquet(f"{path}/payloads")
    text = F.decode("header", "UTF-8")
    named = records.select(
        "seq",
        "header",
        "address",
        "payload",
        *[header_field(text, f).alias(c) for f, c in (("WARC-Type", "record_type"), ("X-Page-Id", "page"), ("X-Refers-To-Page-Id", "refers"), ("WARC-Target-URI", "url"), ("WARC-Payload-Digest", "digest"), ("X-Payload-Length", "said_length"))],
    )
    facts = [F.sha2("payload", 256).alias("real"), sha1_base32(F.col("payload")).alias("sha1"), F.length("payload").cast("long").alias("length")]
    own = named.where(F.col("payload").isNotNull()).select("*", *facts)
    held = records.where(F.col("payload").isNotNull()).select("address", *facts, *(["payload"] if repeated else []))
    once = held.groupBy("address").agg(*[F.first(c).alias(c) for c in held.columns if c != "address"])
    others = named.where(F.col("payload").isNull()).drop("payload").join(once, "address", "left")
    if not repeated:
        others = others.withColumn("payload", F.lit(None).cast("binary"))
    sound = (F.col("real") == F.col("address")) & (F.concat(F.lit("sha1:"), "sha1") == F.col("digest")) & (F.col("length") == F.col("said_length").cast("long"))
    return own.unionByName(others).select(
        "seq",
        "header",
        "payload",
        "url",
        F.when(sound, F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("archive record fails verification: "), F.col("seq").cast("string")))).alias("record_type"),
        F.when(F.col("page") != "", F.col("page").cast("long")).alias("page_id"),
        F.when(F.col("refers") != "", F.col("refers").cast("long")).alias("refers_to"),
        F.col("said_length").cast("long").alias("payload_bytes"),
        F.substring("digest", 6, 32).alias("payload_digest"),
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """seq and record: the WARC record of each archived row, as it stands in a WARC file."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    end = F.lit((CRLF * 2).encode())
    return records.select("seq", F.concat("header", body, end).alias("record"))


def parse_records(records: DataFrame) -> DataFrame:
    """seq, page_id, url, record_type, refers_to, payload, payload_bytes and payload_digest, from the bytes of each record (seq, record).

    A revisit has no payload of its own: its size and digest are those that it tells. A block that isn't as long as its header says, or whose
    digest isn't the header's, is an error.
    """
    # A character of ISO-8859-1 is a byte, so places in this string are places in the record.
    plain = records.select("seq", "record", F.decode("record", "ISO-8859-1").alias("plain"))
    ends = plain.select("*", F.instr("plain", F.lit(CRLF * 2)).alias("head_end"))
    named = ends.select("*", F.decode(F.substring("record", F.lit(1), F.col("head_end") + 1), "UTF-8").alias("head")).select("*", header_field(F.col("head"), "Content-Length").cast("int").alias("size"))
    split = named.select("*", F.substring("record", F.col("head_end") + 4, F.col("size")).alias("block"))
    http_end = F.instr(F.decode("block", "ISO-8859-1"), F.lit(CRLF * 2))
    field = lambda name: header_field(F.col("head"), name)
    response = field("WARC-Type") == "response"
    parts = split.select(
        "seq", "head", "block", response.alias("response"),
        F.when(response, F.substring("block", http_end + 4, F.length("block"))).alias("payload"),
        ((F.length("block") == F.col("size")) & (~response | (F.concat(F.lit("sha1:"), sha1_base32(F.col("block"))) == field("WARC-Block-Digest")))).alias("sound"),
    )
    broken = F.raise_error(F.concat(F.lit("record can't be parsed: "), F.col("seq").cast("string")))
    return parts.select(
        "seq",
        F.nullif(field("X-Page-Id"), F.lit("")).cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        F.when(F.coalesce("sound", F.lit(False)), field("WARC-Type")).otherwise(broken).alias("record_type"),
        F.nullif(field("X-Refers-To-Page-Id"), F.lit("")).cast("long").alias("refers_to"),
        "payload",
        F.when(F.col("response"), F.length("payload").cast("long")).otherwise(field("X-Payload-Length").cast("long")).alias("payload_bytes"),
        F.when(F.col("response"), sha1_base32(F.col("payload"))).otherwise(F.substring(field("WARC-Payload-Digest"), 6, 32)).alias("payload_digest"),
    )
