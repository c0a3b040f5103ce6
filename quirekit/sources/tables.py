"""Parquet tables and the folder for checkpoints, for every query."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads ``{sf_dir}/{name}.parquet`` by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Makes sure that a checkpoint folder is set, and returns the shared folder.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    temporary one is made if driver and executors are one process, as in tests;
    on a cluster an error is raised, since its machines share no folder that
    could be guessed.
    """
    context = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir().isEmpty():
        if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset; it has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return folder or context.getCheckpointDir().get()
