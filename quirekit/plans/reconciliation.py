"""Flagship: block-level reconciliation of documents against benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .catalog import FLAGSHIP, register

_SUMMARY_SQL = r"""
WITH lines AS (
  SELECT source, trim(regexp_replace(regexp_replace(lower(line), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm
  FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
), auth AS (
  SELECT DISTINCT norm FROM (
    SELECT trim(regexp_replace(regexp_replace(lower(line), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm
    FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark)) WHERE norm <> ''
)
SELECT source, CAST(count(*) AS BIGINT) AS n_blocks, CAST(count(a.norm) AS BIGINT) AS n_matched,
       CAST(count(*) - count(a.norm) AS BIGINT) AS n_extra,
       CAST(count(DISTINCT a.norm) AS BIGINT) AS n_auth_found,
       round(CAST(count(a.norm) AS DOUBLE) / count(*), 4) AS matched_share
FROM lines l LEFT JOIN auth a ON l.norm = a.norm WHERE l.norm <> '' GROUP BY source
"""


@register(FLAGSHIP, _SUMMARY_SQL)
def reconciliation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: how many text blocks the authoritative side confirms.

    Blocks are compared by strong digests of their normalised text, and counted
    by source and digest before the join, so that a common block is one row per
    task and no text is shuffled; Spark picks broadcast or shuffle by the size
    of the authoritative side.
    """
    from ..functions.text import normalize_sql

    def blocks(df: DataFrame, *keys: str) -> DataFrame:
        lines = df.select(*keys, F.explode(F.split("text", "\n")).alias("line")).select(*keys, normalize_sql(F.col("line")).alias("norm")).where("norm <> ''")
        return lines.select(*keys, F.unhex(F.sha2("norm", 256)).alias("digest"))

    counted = blocks(table(spark, sf_dir, "documents"), "source").groupBy("source", "digest").agg(F.count("*").alias("n"))
    auth = blocks(table(spark, sf_dir, "benchmark")).distinct().select("digest", F.lit(True).alias("found"))
    matched = F.coalesce(F.sum(F.when(F.col("found"), F.col("n"))), F.lit(0))
    return (
        counted.join(auth, "digest", "left")
        .groupBy("source")
        .agg(F.sum("n").alias("n_blocks"), matched.alias("n_matched"), F.count("found").alias("n_auth_found"))
        .select("source", "n_blocks", "n_matched", (F.col("n_blocks") - F.col("n_matched")).alias("n_extra"), "n_auth_found",
                F.round(F.col("n_matched") / F.col("n_blocks"), 4).alias("matched_share"))
    )
