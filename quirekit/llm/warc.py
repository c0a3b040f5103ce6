"""Content-addressed WARC archive: payload bytes once by strong digest, exact headers apart, records through joins.

A record's header is everything before its payload: the WARC fields and the
HTTP header of the response. A revisit has the HTTP header for its whole block
and names the record that it revisits. Headers and payloads are two tables; a
record is its header, the payload that its digest names (revisits: none) and two
line ends.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, prepare, shared_dir

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Line end of headers.
CRLF = "\r\n"
#: Payloads of fewer bytes are stored as responses each time.
LEAST_REVISIT_BYTES = 0
#: Profile of revisits.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of the bytes, 32 characters."""
    digits = F.sha1(payload)
    chars = []
    for g in range(8):
        n = F.conv(F.substring(digits, 5 * g + 1, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(_BASE32), F.shiftright(n, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*chars)


@dataclass(frozen=True)
class Archive:
    """Folders of an archive: ``records`` has exact headers, ``payloads`` the bytes of each digest once."""

    records: str
    payloads: str


def _record_id(page_id: Column, url: Column, digest: Column, number: Column) -> Column:
    """A URN that no other record of the archive has, and that a revisit can tell of the record it revisits."""
    shown = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    h = F.md5(F.concat_ws("\n", shown(page_id), F.hex(digest), number.cast("string"), shown(url)).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _fields(*pairs: tuple[str, Column]) -> Column:
    """Lines ``name: value``; one without a value is left out."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in pairs))


def one_line(text: Column) -> Column:
    """The text with line ends as in URLs, since a header field is one line; other texts stay as they are."""
    return F.replace(F.replace(text, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def header(date: str) -> Column:
    """The record's bytes before its payload, of columns record_id, page_id, url, payload_digest, payload_bytes, and refers_to, refers_id, refers_url of a revisit."""
    revisit = F.col("refers_id").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), _fields(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("payload_bytes").cast("string"))), F.lit(CRLF))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    warc = _fields(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", F.col("record_id")),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Profile", F.when(revisit, PROFILE)),
        ("WARC-Refers-To", F.col("refers_id")),
        ("WARC-Refers-To-Target-URI", F.when(revisit, F.col("refers_url"))),
        ("WARC-Refers-To-Date", F.when(revisit, date)),
        ("X-Page-ID", F.col("page_id").cast("string")),
        ("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", block.cast("string")),
    )
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), warc, F.lit(CRLF), http)


def write_archive(pages: DataFrame, folder: str, least: int = LEAST_REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Writes a record per row of ``pages`` (page_id, url, html) under ``folder`` and returns the archive.

    Null html is an empty payload. Of rows with equal payloads of at least
    ``least`` bytes, that of the least page_id is the response; the others
    revisit it. Smaller payloads are responses all. Rows that repeat a page_id
    and payload are records each, of one type and with an id each; a null
    page_id is after all others, and then every row of the payload is a
    response. A null url has no field; line ends in one are written as %0D and
    %0A. ``date`` is that of all records, since pages have none. Payloads count
    as equal by SHA-256. Other columns are ignored.

    Ids, urls and digests alone are shuffled. Payloads that stand in one row
    are written where they are read; only those of repeated digests are
    shuffled, one from each task.
    """
    spark = pages.sparkSession
    prepare(spark)
    archive = Archive(f"{folder}/records", f"{folder}/payloads")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), one_line(F.col("url").cast("string")).alias("url"), payload.alias("payload"))
    full = full.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    thin = full.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    # Equal rows are counted before they move, so that many copies of one are few.
    rows = thin.groupBy("digest", "page_id", "url", "payload_bytes", "payload_digest").agg(F.count("*").alias("n")).checkpoint()
    first = rows.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url")).alias("f"), F.sum("n").alias("copies")).where("copies > 1").checkpoint()
    repeated = first.count()
    firsts = maybe_broadcast(first.select("digest", "f"), repeated)
    again = (F.col("payload_bytes") >= least) & F.col("f.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("f.page_id"))
    typed = rows.join(firsts, "digest", "left").withColumn("revisit", F.coalesce(again, F.lit(False)))
    typed = typed.withColumns({
        "refers_to": F.when(F.col("revisit"), F.col("f.page_id")),
        "refers_url": F.when(F.col("revisit"), F.col("f.url")),
        "refers_id": F.when(F.col("revisit"), _record_id(F.col("f.page_id"), F.col("f.url"), F.col("digest"), F.lit(1))),
        "number": F.explode(F.sequence(F.lit(1), F.col("n"))),
    })
    typed = typed.withColumn("record_id", _record_id(F.col("page_id"), F.col("url"), F.col("digest"), F.col("number")))
    typed.select(header(date).cast("binary").alias("header"), "digest", (~F.col("revisit")).alias("has_payload")).write.option("compression", "zstd").parquet(archive.records)
    digests = maybe_broadcast(first.select("digest"), repeated)
    single = full.join(digests, "digest", "left_anti").select("digest", "payload")
    several = full.join(digests, "digest", "left_semi").groupBy("digest").agg(F.first("payload").alias("payload"))
    single.union(several).write.option("compression", "zstd").parquet(archive.payloads)
    return archive


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """The original records' bytes, ``record``: header, payload and two line ends.

    Each payload's digest is verified against the key under which it is stored.
    """
    records, payloads = spark.read.parquet(archive.records), spark.read.parquet(archive.payloads)
    end = F.lit(CRLF + CRLF).cast("binary")
    verified = F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.hex("digest"))).cast("binary"))
    responses = records.where("has_payload").join(payloads.select("digest", verified.alias("payload")), "digest")
    return responses.select(F.concat("header", "payload", end).alias("record")).union(records.where("not has_payload").select(F.concat("header", end).alias("record")))


def parsed(records: DataFrame) -> DataFrame:
    """Fields of records, read from their bytes alone.

    page_id, url, record_id, record_type, refers_to, refers_id, payload_bytes
    and payload_digest. A response's last two are those of its payload's bytes;
    a revisit, which has none, states them in its headers. ``intact`` says
    whether the lengths and digests that the headers state are those of the bytes.
    """
    text = F.col("record").cast("string")
    found = records.select("record", F.substring_index(text, CRLF + CRLF, 1).alias("__warc"), F.substring_index(F.substring_index(text, CRLF + CRLF, 2), CRLF + CRLF, -1).alias("__http"))
    found = found.withColumn("__at", F.octet_length("__warc") + F.octet_length("__http") + 8)
    field = lambda of, name, what: F.nullif(F.regexp_extract(of, rf"(?:^|\r\n){name}: {what}(?:\r\n|$)", 1), F.lit(""))
    found = found.select(
        F.expr("substring(record, __at + 1, octet_length(record) - __at - 4)").alias("__payload"),
        field("__warc", "X-Page-ID", r"(-?\d+)").cast("long").alias("page_id"),
        field("__warc", "WARC-Target-URI", r"([^\r\n]*)").alias("url"),
        field("__warc", "WARC-Record-ID", r"(<[^>]*>)").alias("record_id"),
        field("__warc", "WARC-Type", r"(\w+)").alias("record_type"),
        field("__warc", "X-Refers-To-Page-ID", r"(-?\d+)").cast("long").alias("refers_to"),
        field("__warc", "WARC-Refers-To", r"(<[^>]*>)").alias("refers_id"),
        field("__warc", "WARC-Payload-Digest", r"sha1:(\w+)").alias("__stated"),
        field("__http", "Content-Length", r"(\d+)").cast("long").alias("__length"),
        (field("__warc", "Content-Length", r"(\d+)").cast("long") == F.octet_length("record") - F.octet_length("__warc") - 8).alias("__whole"),
    )
    # The digest is spelt from a column of its own, so that it isn't computed for each character.
    found = found.withColumns({"__sha": base32_sha1(F.col("__payload")), "__n": F.octet_length("__payload").cast("long"), "__full": F.col("record_type") == "response"})
    return found.select(
        "page_id", "url", "record_id", "record_type", "refers_to", "refers_id",
        F.when(F.col("__full"), F.col("__n")).otherwise(F.col("__length")).alias("payload_bytes"),
        F.when(F.col("__full"), F.col("__sha")).otherwise(F.col("__stated")).alias("payload_digest"),
        (F.col("__whole") & F.when(F.col("__full"), (F.col("__sha") == F.col("__stated")) & (F.col("__n") == F.col("__length"))).otherwise(F.col("__n") == 0)).alias("intact"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives ``pages`` in a new folder of the shared one, reads the records back and returns their fields."""
    spark = pages.sparkSession
    archive = write_archive(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return parsed(read_archive(spark, archive))


_N = lambda g: f"CAST('0x' || substr(h, {5 * g + 1}, 5) AS INT)"
#: DuckDB SQL of the query's rows over ``pages``.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       {" || ".join(f"substr('{_BASE32}', (({_N(g)} >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
