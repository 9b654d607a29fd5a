"""Answers to given requests, in bulk or one by one; `python -m motorlode` is a command line for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlode import queries
from motorlode.functions import text as T
from motorlode.operators import codes, wmi
from motorlode.plans import answer

REQUEST = "req_id bigint, supplied string, model_year int, market string"
CODES = "req_id bigint, hsn string, tsn string"


def valid_context(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests whose year and market can be, the others with their problem)."""
    r = requests.withColumn("problem", T.context_problem(F.col("model_year"), F.col("market")))
    return r.where("problem is null").drop("problem"), r.where("problem is not null")


def lookup(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """What the manufacturer key of each request (REQUEST) establishes."""
    return queries.wmi_resolution(spark, requests)


def decode(spark: SparkSession, requests: DataFrame, long: bool = False) -> DataFrame:
    """(req_id, answer) of each request (REQUEST) as JSON; with `long` also details."""
    return (queries.answer_long if long else queries.answer_short)(spark, requests)


def lookup_types(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """(req_id, input_status, answer) of each request by type codes (CODES) as JSON."""
    return answer.short_types(codes.prepared(requests), queries.code_decision(spark, requests))


def decode_one(spark: SparkSession, supplied: str, model_year: int | None = None, market: str | None = None, long: bool = False) -> tuple[str, dict]:
    """(structure, answer) of one identifier; a context that can't be raises ValueError."""
    import json

    r = spark.createDataFrame([(0, supplied, model_year, market)], REQUEST)
    if bad := valid_context(r)[1].first():
        raise ValueError(bad["problem"])
    row = decode(spark, r, long).first()
    found = json.loads(row["answer"]) | ({"details": json.loads(row["details"])} if long else {})
    return wmi.prepared(r).first()["structure"], found


def lookup_type(spark: SparkSession, hsn: str, tsn: str) -> tuple[str, dict]:
    """(input status, answer) of one pair of type codes."""
    import json

    row = lookup_types(spark, spark.createDataFrame([(0, hsn, tsn)], CODES)).first()
    return row["input_status"], json.loads(row["answer"])
