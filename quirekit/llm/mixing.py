"""Mixing sources to target weights by repetition rates and hash-seeded copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import maybe_broadcast, prepare

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Words as runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the seed and the id, alike in every run and engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Source targets from ``(source, source_size)``, a row per source.

    Shares of the total follow the weights. Sources whose share would exceed
    ``most`` times their size stop there; the excess goes to the others by
    weight. In the order of size per weight, the level of the first source
    that isn't full is the level of all that aren't. The windows run over a
    row per source, not over documents.
    """
    rank = W.orderBy(F.col("source").asc_nulls_last())
    by_fill = W.orderBy("full_at", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    filled = sizes.withColumn("weight", weight).withColumn("full_at", most * F.col("source_size") / F.col("weight"))
    filled = filled.withColumns({"total": F.sum("source_size").over(every), "weights": F.sum("weight").over(every), "spent": F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    filled = filled.withColumn("level", (F.col("total") - F.col("spent")) / (F.col("weights") - F.col("gone")))
    filled = filled.withColumn("final", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(every))
    return filled.select("source", "source_size", "weight", F.least((most * F.col("source_size")).cast("double"), F.coalesce(F.col("final.level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 0) -> DataFrame:
    """Rows of ``docs`` with ``size``, ``source_size``, ``target``, ``rate`` and ``copies``.

    The rate of a source is its target over its size, 0 for a size of 0. A row
    gets floor(rate) copies and one more with the probability of the fraction,
    by a hash of the seed and doc_id; so rows that repeat a doc_id decide
    alike. Null sources form one source, last in order. Sources are summed
    before anything moves; the table of targets is broadcast if its counted
    rows are few, and otherwise joined by a shuffle that Spark splits where a
    source is hot.
    """
    prepare(docs.sparkSession)
    sized = docs.withColumns({"size": word_count(F.col("text")), "__source": F.col("source").cast("string")})
    by_source = targets(sized.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("source_size")), weights, most).checkpoint()
    by_source = by_source.select(F.col("source").alias("__of"), "source_size", "target", F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0).alias("rate"))
    joined = sized.drop("source_size", "target", "rate", "copies").join(maybe_broadcast(by_source, by_source.count()), F.col("__source").eqNullSafe(F.col("__of")))
    extra = uniform(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")
    return joined.withColumn("copies", (F.floor("rate") + extra.cast("long")).cast("int")).drop("__source", "__of")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 0) -> DataFrame:
    """The mixture itself: each row as many times as it has copies, with the columns of ``docs``."""
    found = mixed(docs.withColumn("__row", F.struct(*docs.columns)), weights, most, seed)
    return found.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).select("__row.*")


#: DuckDB SQL of the query's rows over ``documents``, for the default parameters.
ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), ranked AS (
  SELECT source, source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)
), filled AS (
  SELECT *, CAST({MOST_EPOCHS} * source_size AS DOUBLE) / weight AS full_at FROM ranked
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum({MOST_EPOCHS} * source_size) OVER w, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM filled WINDOW w AS (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, least(CAST({MOST_EPOCHS} * source_size AS DOUBLE), coalesce((SELECT arg_min(level, full_at) FROM levels WHERE level <= full_at), 0.0) * weight) AS target FROM levels
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least({MOST_EPOCHS}.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS rate
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
