"""Sinks: deterministic text, bucketed and prefix-partitioned tables, manifests and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlode import policy
from motorlode.functions import text as T
from motorlode.operators import approvals
from motorlode.sources.readers import contents


def sorted_tsv(rows: DataFrame, path: str, key: str = "id") -> None:
    """Rows as tab-separated text in the order of their key; range-partitioned, so no task holds all."""
    cells = [T.null_cell(F.col(c).cast("string")) for c in rows.columns]
    rows.orderBy(key).select(F.concat_ws("\t", *cells).alias("value")).write.mode("overwrite").text(path)


def bucketed(patterns: DataFrame, path: str) -> None:
    """Patterns by shard of their schema, each sorted by pattern."""
    p = patterns.withColumn("schema_bucket", F.pmod("schema_id", F.lit(policy.SHARDS)))
    p.repartition("schema_bucket").sortWithinPartitions("schema_bucket", "pattern_id").write.mode("overwrite").partitionBy("schema_bucket").parquet(path)


def by_prefix(rows: DataFrame, path: str) -> None:
    """Approvals copied to each beginning of their masks."""
    approvals.exploded(rows).repartition("wmi").sortWithinPartitions("wmi", "approval_id").write.mode("overwrite").partitionBy("wmi").parquet(path)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, sha256, bytes) of the files of a folder."""
    return contents(spark, folder).select("name", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def report(rows: DataFrame, path: str) -> None:
    """A report as compressed JSON lines with its nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).option("compression", "gzip").json(path)
