"""Type-code lookup on two codes; every entry stays a candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlode.functions import text as T


def prepared(requests: DataFrame) -> DataFrame:
    h, t = T.normalized(F.col("hsn")), T.normalized(F.col("tsn"))
    return requests.withColumns({"norm_hsn": h, "norm_tsn": t, "input_status": T.type_code_status(h, t)})


def ordered(types: DataFrame) -> DataFrame:
    """All entries in the order in which they are published: by both codes and the object's number."""
    return types.orderBy("hsn", "tsn", "source_object_id")


def candidates(requests: DataFrame, types: DataFrame) -> DataFrame:
    """A row for each valid request and entry, and one without for requests that have none."""
    t = types.withColumnsRenamed({"hsn": "type_hsn", "tsn": "type_tsn"})
    on = (F.col("input_status") == "VALID") & (F.col("norm_hsn") == F.col("type_hsn")) & (F.col("norm_tsn") == F.col("type_tsn"))
    return prepared(requests).join(t, on, "left").drop("type_hsn", "type_tsn")


def resolve(found: DataFrame) -> DataFrame:
    """(req_id, input_status, n_candidates, status, trade_name): a value only of a single entry."""
    n = F.col("n_candidates")
    out = found.groupBy("req_id").agg(F.first("input_status").alias("input_status"), F.count("source_object_id").alias("n_candidates"), F.max("trade_name").alias("one"))
    status = F.when(F.col("input_status") != "VALID", "INVALID_INPUT").when(n == 0, "UNKNOWN").when(n == 1, "RECOGNIZED").otherwise("AMBIGUOUS")
    return out.withColumn("status", status).withColumn("trade_name", F.when(F.col("status") == "RECOGNIZED", F.col("one"))).drop("one")
