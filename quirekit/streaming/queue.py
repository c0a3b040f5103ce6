"""The job queue as streams (§2.9): claims, coalesced rebuild requests, states folded from events. Sinks are idempotent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Precedence of states at one time: a cancellation holds against progress.
FINAL = ("CANCELLED",)


def read_requests(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def coalesced(requests: DataFrame, key: str, at: str, run_seconds: int) -> DataFrame:
    """Rebuilds that requests lead to: key, ``window`` number and n_requests.

    Requests of a key within one run's length lead to one rebuild, however many
    they are: time is cut into windows of ``run_seconds``. Works on tables and on
    streams, where the caller sets a watermark on ``at``.
    """
    slot = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(run_seconds * 1_000_000)).alias("slot")
    return requests.where(F.col(key).isNotNull()).groupBy(key, slot).agg(F.count("*").alias("n_requests"))


def run_coalesced(spark: SparkSession, requests: DataFrame, target: str, checkpoint: str, key: str, at: str, run_seconds: int) -> DataFrame:
    """Runs a stream of requests to its end and returns its rebuilds.

    Every micro-batch is reduced to a row per key and window and written under
    its own number, over what an earlier attempt at the batch left; so a batch
    that is run again changes nothing. Batches are added up when they are read.
    """

    def write(batch: DataFrame, number: int) -> None:
        coalesced(batch, key, at, run_seconds).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = requests.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.option("basePath", target).parquet(target).groupBy(key, "slot").agg(F.sum("n_requests").alias("n_requests"))


def folded_states(events: DataFrame, key: str, at: str, seq: str, status: str) -> DataFrame:
    """The state of every job after all its events: the latest one by time and sequence, but CANCELLED once it was, unless requeued after that.

    A maximum per key, combined before the shuffle, so it is the same however
    the events are split into batches.
    """
    stamp = F.struct(F.col(at), F.col(seq))
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max(F.struct(stamp.alias("t"), F.col(status).alias("s"))).alias("__last"),
        F.max(F.when(F.col(status).isin(*FINAL), stamp)).alias("__cancelled"),
        F.max(F.when(F.col(status) == "QUEUED", stamp)).alias("__queued"),
        F.count("*").alias("n_events"),
    ).select(key, F.when(F.col("__cancelled").isNotNull() & (F.col("__queued").isNull() | (F.col("__queued") < F.col("__cancelled"))), "CANCELLED").otherwise(F.col("__last.s")).alias("status"), "n_events")


def claimed(jobs: DataFrame, n: int, created: str = "created_at", id_: str = "id") -> DataFrame:
    """The ``n`` oldest queued jobs as PROCESSING with no progress: a top-k; a single writer makes the claim atomic."""
    return jobs.where(F.col("status") == "QUEUED").orderBy(created, id_).limit(n).withColumns({"status": F.lit("PROCESSING"), "progress": F.lit(0)})


def appended_logs(jobs: DataFrame, entries: DataFrame, key: str = "id") -> DataFrame:
    """Progress entries (key, at, level, message) added to the jobs' logs in their order; a job's log is short."""
    new = entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "level", "message"))).alias("__new"))
    return jobs.join(new, key, "left").withColumn("logs", F.concat("logs", F.coalesce("__new", F.array().cast("array<struct<at:timestamp,level:string,message:string>>")))).drop("__new")


def poll_delay(idle: int, interval: int = 3, back_off: int = 10, after: int = 20) -> int:
    """Seconds to the next poll: the back-off once there was nothing to do ``after`` times."""
    return back_off if idle >= after else interval


def running_slots(jobs: DataFrame, limit: int = 2) -> DataFrame:
    """The concurrency limit: queued jobs that may start now, the oldest first, beside those that run."""
    running = jobs.where(F.col("status") == "PROCESSING").agg(F.count("*").alias("running"))
    oldest = jobs.where(F.col("status") == "QUEUED").orderBy("created_at", "id").limit(limit)
    return oldest.withColumn("place", F.row_number().over(W.orderBy("created_at", "id"))).crossJoin(F.broadcast(running)).where(F.col("place") <= F.lit(limit) - F.col("running")).drop("place", "running")
