"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import ensure_checkpoint_dir, table  # noqa: F401

#: Rows of one Arrow batch. Texts may be long, so batches hold few of them.
BATCH_ROWS = 500

#: Tables of at most this many rows may be broadcast after they were counted.
BROADCAST_ROWS = 200_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def prepare(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches and makes sure that a checkpoint folder is set.

    The folder is that of ``sources.tables.ensure_checkpoint_dir``.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ensure_checkpoint_dir(spark)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names, for tables an operator writes."""
    prepare(spark)
    return ensure_checkpoint_dir(spark)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again, so that it is neither computed twice nor rewritten by the optimizer."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint only for a table whose counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def held_out(doc_id, folds: int, fold: int):
    """True where crc32 of the id as text leaves ``fold`` modulo ``folds``; a null id is in training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer over uint64 arrays (splitmix64); products wrap around."""
    x = x ^ (x >> _S30)
    x *= _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


def text_rows(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values of ``columns``."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Components of an undirected graph as ``(node, component)``, component the least node.

    Alternates the large-star and small-star steps, each a partial minimum per
    node and an equi-join that Spark can split where a node is hot. The edges
    of every round are checkpointed; rounds grow with the logarithm of the
    graph's diameter. Loops and null ends are dropped; nodes without an edge to
    another one are absent from the result.
    """
    now = (
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("u") != F.col("v")))
        .distinct().checkpoint()
    )
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        now = small.distinct().checkpoint()
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
