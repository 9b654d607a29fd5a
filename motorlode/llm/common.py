"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared_folder(spark: SparkSession) -> str:
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


def stored(df: DataFrame) -> DataFrame:
    """`df`, written as Parquet to the shared folder and read again: smaller than a checkpoint."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, written to the cluster's shared checkpoint folder and read again: lineage ends here.

    For the folder see _shared_folder.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key` and `text` alone, a null text as an empty one."""
    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text))


def give_back() -> None:
    """Memory that this Python worker has freed goes back to the system.

    Workers outlive their tasks, and what their allocators keep for later stands beside the memory of the
    executor and of other workers.
    """
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow, after which the worker gives back the memory it has freed."""

    def giving_back(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(giving_back, schema)


def mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow of a function from one RecordBatch to a dict of columns (or None for no rows)."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows and (cols := fn(batch)) is not None:
                yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], type=f.type) for f in out], schema=out)

    return in_arrow(df, run, schema)


#: Rows of a narrow table (a few numbers each) that may be broadcast: under 100 MB as a hash table.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if a count shows it to be small; beyond that a join shuffles it."""
    return F.broadcast(df) if df.count() <= most else df
