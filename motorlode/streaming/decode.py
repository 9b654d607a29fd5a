"""Streams of requests against static rule tables.

Lookups are stateless stream-static joins and run in append mode; whatever aggregates over a
request runs per micro-batch, where a request is whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from motorlode.operators import approvals, codes, wmi


def wmi_candidates(requests: DataFrame, assignments: DataFrame) -> DataFrame:
    """Manufacturer candidates of streamed requests, in append mode."""
    return wmi.candidates(wmi.prepared(requests), assignments)


def code_candidates(requests: DataFrame, types: DataFrame) -> DataFrame:
    return codes.candidates(requests, types)


def approval_candidates(requests: DataFrame, table: DataFrame) -> DataFrame:
    return approvals.candidates(wmi.prepared(requests), table)


def per_batch(requests: DataFrame, resolve: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that resolves each micro-batch as a table and hands it to `write`, once per batch id."""
    return requests.writeStream.foreachBatch(lambda batch, n: write(resolve(batch), n)).option("checkpointLocation", checkpoint)
