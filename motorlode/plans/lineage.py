"""Cuts the lineage of intermediate tables that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results that all executors share: the session's `spark.checkpoint.dir`.

    Only under a local master a temporary folder is made where that is unset.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="motorlode-checkpoint-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    """The path of a new folder below the shared one."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """`df`, written to the cluster's checkpoint folder and read again.

    A table that many joins share would otherwise be planned and computed once for each of them.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
