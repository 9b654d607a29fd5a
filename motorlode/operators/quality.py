"""Data-quality checks; each returns the offending rows, so that an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlode import policy


def overlaps(assignments: DataFrame) -> DataFrame:
    """Pairs of assignments of one key whose years and markets can both apply, and that no ambiguity group allows.

    An equi-join on the key; years, markets and the order of the pair are its residual.
    """
    side = lambda s: assignments.select("wmi", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "from_year", "to_year", "markets", "ambiguity_group")))
    start = F.greatest(F.coalesce("from_year_a", F.lit(policy.FIRST_YEAR)), F.coalesce("from_year_b", F.lit(policy.FIRST_YEAR)))
    end = F.least(F.coalesce("to_year_a", F.lit(policy.LAST_YEAR)), F.coalesce("to_year_b", F.lit(policy.LAST_YEAR)))
    markets = (F.size("markets_a") == 0) | (F.size("markets_b") == 0) | F.arrays_overlap("markets_a", "markets_b")
    grouped = F.coalesce(F.col("ambiguity_group_a") == F.col("ambiguity_group_b"), F.lit(False))
    pairs = side("a").join(side("b"), "wmi").where((F.col("id_a") < F.col("id_b")) & (start <= end) & markets & ~grouped)
    return pairs.select("wmi", "id_a", "id_b")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key is no parent's; a null key is one."""
    return rows.join(parents.select(F.col(parent_key).alias("parent")), F.col(key) == F.col("parent"), "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that are null or repeat."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null)


def page_counts(rows: DataFrame, page: str, expected: DataFrame | None = None) -> DataFrame:
    """(page, n_rows) of every page; with `expected` (page, n_rows), the pages that have others."""
    counts = rows.groupBy(page).agg(F.count("*").alias("n_rows"))
    if expected is None:
        return counts
    j = counts.join(expected.withColumnRenamed("n_rows", "expected_rows"), page, "full_outer")
    return j.where(~F.col("n_rows").eqNullSafe(F.col("expected_rows")))


def gaps(rows: DataFrame, page: str, row: str) -> DataFrame:
    """Rows whose number within the page isn't one more than that before it (the first: 1)."""
    before = F.lag(row).over(Window.partitionBy(page).orderBy(row))
    return rows.where("1 = 1").withColumn("before", F.coalesce(before, F.lit(0))).where(F.col(row) != F.col("before") + 1)


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_rows, new_rows, ratio, exclusion_change, ok) of two editions with an `excluded` flag."""
    count = lambda d, p: d.agg(F.count("*").alias(f"{p}_rows"), F.avg(F.col("excluded").cast("double")).alias(f"{p}_excluded"), F.lit(1).alias("one"))
    low, high = policy.EDITION_GROWTH
    both = count(old, "old").join(count(new, "new"), "one")  # two single rows
    ratio, change = F.try_divide(F.col("new_rows"), F.col("old_rows")), F.col("new_excluded") - F.col("old_excluded")
    return both.select("old_rows", "new_rows", F.round(ratio, 6).alias("ratio"), F.round(change, 6).alias("exclusion_change"), (ratio.between(low, high) & (change <= policy.EXCLUSION_POINTS)).alias("ok"))


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side alone, with the side: the symmetric difference of two inventories."""
    j = a.select(*keys).distinct().withColumn("in_a", F.lit(True)).join(b.select(*keys).distinct().withColumn("in_b", F.lit(True)), keys, "full_outer")
    return j.where("in_a is null or in_b is null").select(*keys, F.when(F.col("in_a").isNull(), "b").otherwise("a").alias("side"))


def compared(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(n_both, only_a, only_b, equal, a_within_b) of the distinct keys of two sets."""
    j = a.select(*keys).distinct().withColumn("in_a", F.lit(True)).join(b.select(*keys).distinct().withColumn("in_b", F.lit(True)), keys, "full_outer")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    counts = j.agg(n(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("n_both"), n(F.col("in_b").isNull()).alias("only_a"), n(F.col("in_a").isNull()).alias("only_b"))
    return counts.withColumns({"equal": (F.col("only_a") == 0) & (F.col("only_b") == 0), "a_within_b": F.col("only_a") == 0})


def same_columns(rows: DataFrame, expected: dict[str, str]) -> list[str]:
    """What a schema lacks or has otherwise; empty if it is as expected."""
    have = dict(rows.dtypes)
    return [f"{k}: {have.get(k)} instead of {v}" for k, v in expected.items() if have.get(k) != v]


def fingerprint(*columns: Column) -> Column:
    """A digest of rows that doesn't depend on their order."""
    return F.concat_ws(":", F.count("*").cast("string"), F.hex(F.bit_xor(F.xxhash64(*columns))))
