"""Files as tables (S1, S2, S9-S11, S16, S17) and sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import hashing
from ..functions.text import csv_cell

#: Files above this size aren't read.
MOST_BYTES = 200 << 20
#: Charsets that are tried once neither the declared one nor the markup's own fits.
FALLBACKS = ("utf-8", "utf-8-sig", "cp1252", "latin-1")
_SNIFF = re.compile(rb"charset=[\"']?([A-Za-z0-9_\-]+)", re.I)


def read_bytes(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """Path, size, content and its digest of every file below a path; larger ones have neither content nor digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    content = F.when(F.col("length") <= most, F.col("content"))
    return files.select("path", F.col("length").alias("size"), content.alias("content")).withColumn("checksum", hashing.sha256(F.col("content")))


def decode_bytes(data: bytes | None, declared: str | None = None) -> str | None:
    """Text by the declared charset, the one that the first 4096 bytes name, then the fallbacks."""
    if data is None:
        return None
    named = _SNIFF.search(data[:4096])
    for charset in (declared, named.group(1).decode() if named else None, *FALLBACKS):
        try:
            if charset:
                return data.decode(charset)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("latin-1")


def decoded(content: Column, declared: Column) -> Column:
    """S2 of a binary column; null stays null."""

    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for data, charset in parts:
            yield pa.array([decode_bytes(d, c) for d, c in zip(data.to_pylist(), charset.to_pylist(), strict=True)], pa.string())

    return arrow_udf(run, "string")(content, declared)


def in_memory(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of given rows."""
    return spark.createDataFrame(rows, schema)


def asset_id(url: Column, host: str) -> Column:
    """The id that an asset's URL names: its path after ``upload`` without version, transformations and extension; null for other hosts."""
    parts = F.split(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/upload/(.+)$", 1), "/")
    kept = F.filter(parts, lambda p, i: ~(p.rlike(r"^v\d+$") | ((i < F.size(parts) - 1) & p.rlike(r"^(?:[a-z]{1,3}_[^/]+)(?:,[a-z]{1,3}_[^/]+)*$"))))
    path = F.regexp_replace(F.array_join(kept, "/"), r"\.[A-Za-z0-9]{1,8}$", "")
    return F.when((F.parse_url(url, F.lit("HOST")) == host) & (path != ""), path)


CSV_COLUMNS = ("type", "severity", "status", "confidence", "page", "selector", "message")


def csv_lines(issues: DataFrame) -> DataFrame:
    """A line per finding, cells quoted where they have to be, confidence in percent."""
    shown = {**{c: F.col(c) for c in CSV_COLUMNS}, "confidence": F.concat(F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%"))}
    return issues.select(F.concat_ws(",", *(csv_cell(shown[c]) for c in CSV_COLUMNS)).alias("value"))


def write_csv(issues: DataFrame, folder: str, order: list) -> None:
    """Lines in a total order, with a header first in every file."""
    lines = csv_lines(issues.orderBy(*order)).select(F.regexp_replace("value", r"\r?\n", " ").alias(",".join(CSV_COLUMNS)))
    lines.write.option("header", True).option("quote", "").option("sep", "\u0001").csv(folder)


def publish_html(documents: DataFrame, folder: str) -> None:
    """Documents (doc, html) as a table of one row each, partitioned by nothing so that files are as many as tasks."""
    documents.select("doc", "html").write.option("compression", "zstd").parquet(folder)


def bundle_manifest(images: DataFrame) -> DataFrame:
    """The entries of a bundle (job_id, name, src): a path for each image that has a source, and the others as failed."""
    ok = F.coalesce(F.trim("src") != "", F.lit(False))
    return images.select("job_id", "name", "src", F.when(ok, F.concat(F.lit("images/"), "name")).alias("entry"), F.when(~ok, "no source").alias("error"))
