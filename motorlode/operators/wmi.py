"""Manufacturer lookup: requests meet assignments on their key; every field gets a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlode import policy
from motorlode.functions import text as T


def prepared(requests: DataFrame) -> DataFrame:
    """(req_id, supplied, model_year, market, normalized, structure)."""
    n = T.normalized(F.col("supplied"))
    return requests.withColumns({"normalized": n, "structure": T.structure(n)})


def may_apply(markets: Column, start: Column, end: Column, market: Column, year: Column) -> Column:
    """Whether constraints leave room for a context; open ends and empty markets do."""
    fits = market.isNull() | (F.size(markets) == 0) | F.array_contains(markets, market)
    return fits & (year.isNull() | year.between(F.coalesce(start, F.lit(policy.FIRST_YEAR)), F.coalesce(end, F.lit(policy.LAST_YEAR))))


def established(markets: Column, start: Column, end: Column, market: Column, year: Column) -> Column:
    """Whether a context says enough to confirm constraints."""
    return ((F.size(markets) == 0) | market.isNotNull()) & ((start.isNull() & end.isNull()) | year.isNotNull())


def lookup_keys(requests: DataFrame, assignments: DataFrame) -> DataFrame:
    """`requests` with wmi: extended where an assignment extends the first three characters; null for odd lengths."""
    longer = assignments.where(F.length("wmi") == 6).select(F.substring("wmi", 1, 3).alias("prefix"), F.lit(True).alias("longer")).distinct()
    n = F.col("normalized")
    r = requests.withColumn("prefix", F.when(F.col("structure") != "UNSUPPORTED_LENGTH", F.substring(n, 1, 3)))
    return r.join(longer, "prefix", "left").withColumn("wmi", F.when(F.col("longer"), T.extended_key(n)).otherwise(F.col("prefix"))).drop("prefix", "longer")


def candidates(requests: DataFrame, assignments: DataFrame, manufacturers: DataFrame | None = None) -> DataFrame:
    """A row for each request and assignment that may apply, and one without for requests that have none."""
    a = assignments if manufacturers is None else assignments.join(manufacturers.select(F.col("id").alias("manufacturer_id"), F.col("name").alias("manufacturer"), "country"), "manufacturer_id", "left")
    a = a.withColumnsRenamed({"id": "assignment_id", "wmi": "assigned"})
    on = (F.col("wmi") == F.col("assigned")) & may_apply(F.col("markets"), F.col("from_year"), F.col("to_year"), F.col("market"), F.col("model_year"))
    keyed = lookup_keys(requests, assignments).join(a, on, "left")
    return keyed.withColumn("established", established(F.col("markets"), F.col("from_year"), F.col("to_year"), F.col("market"), F.col("model_year")))


def ordered_distinct(order: str, value: str) -> Column:
    """Distinct values of a group that aren't null, in order of their first row."""
    rows = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value))))
    return F.array_distinct(F.transform(rows, lambda r: r[value]))


def knowledge(values: Column, missing: Column, unsure: Column) -> Column:
    """Several values are ambiguous; a missing one leaves the field unknown; never the first or most frequent."""
    return F.when(F.size(values) > 1, "AMBIGUOUS").when(missing, "UNKNOWN").when(unsure, "NEEDS_CONTEXT").otherwise("KNOWN")


def resolve(found: DataFrame, fields: dict[str, str]) -> DataFrame:
    """A row for each request: match status, candidates, and status, possibilities and value of each field.

    fields: name of a field to its column among the candidates.
    """
    unsure = F.bool_or(~F.col("established"))
    aggregates = [F.count("assignment_id").alias("n_candidates"), F.coalesce(unsure, F.lit(False)).alias("unsure"), F.first("structure").alias("structure")]
    for name, column in fields.items():
        aggregates += [ordered_distinct("assignment_id", column).alias(f"{name}_possibilities"), F.bool_or(F.col(column).isNull()).alias(f"{name}_missing")]
    out = found.groupBy("req_id").agg(*aggregates)
    n = F.col("n_candidates")
    out = out.withColumn("status", F.when(F.col("structure") == "UNSUPPORTED_LENGTH", "UNSUPPORTED_FORMAT").when(n == 0, "UNKNOWN").when(n > 1, "AMBIGUOUS").when(F.col("unsure"), "NEEDS_CONTEXT").otherwise("RECOGNIZED"))
    for name in fields:
        values = F.col(f"{name}_possibilities")
        status = knowledge(values, F.col(f"{name}_missing"), F.col("unsure"))
        out = out.withColumn(f"{name}_status", status).withColumn(name, F.when(F.col(f"{name}_status") == "KNOWN", values[0])).drop(f"{name}_missing")
    return out.drop("unsure")
