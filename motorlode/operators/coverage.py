"""Coverage of a corpus of prefixes: grouped labels, probe consensus, coverage and precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorlode import policy
from motorlode.functions import text as T
from motorlode.plans.lineage import settled


def grouped(corpus: DataFrame, fields: list[str], prefix: str = "prefix", count: str = "vehicle_count") -> DataFrame:
    """(prefix, weight, field -> sorted distinct labels): conflicting labels are kept."""
    return corpus.groupBy(prefix).agg(F.sum(F.col(count).cast("long")).alias("weight"), *(F.array_sort(F.collect_set(T.comparable_label(F.col(f)))).alias(f) for f in fields))


def probe_consensus(probes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, value) of probes (keys, status, value): a value only if all of them know the same.

    Labels are compared in their comparable form. Two known ones disagree, whatever other probes
    say; a status that isn't KNOWN must be that of all probes.
    """
    label = F.when(F.col("status") == "KNOWN", T.comparable_label(F.col("value")))
    p = probes.groupBy(*keys).agg(F.array_sort(F.collect_set("status")).alias("statuses"), F.array_sort(F.collect_set(label)).alias("values"))
    known = F.array_contains("statuses", "KNOWN")
    only = F.size("statuses") == 1
    status = F.when(only & known & (F.size("values") == 1), "KNOWN").when(F.size("values") > 1, "PROBE_DISAGREEMENT").when(only & ~known, F.col("statuses")[0]).otherwise("PROBE_INCOMPLETE")
    return p.withColumn("status", status).select(*keys, "status", F.when(F.col("status") == "KNOWN", F.col("values")[0]).alias("value"))


def supported_prefix(prefix):
    """Whether a ten-character prefix can be probed: no extended manufacturer key, and the alphabet's characters alone."""
    return prefix.rlike(r"\A[A-HJ-NPR-Z0-9]{10}\z") & (F.substring(prefix, 3, 1) != "9")


def judged(consensus: DataFrame, labels: DataFrame, keys: list[str], aliases: DataFrame | None = None) -> DataFrame:
    """Consensus against the corpus's labels (keys, weight, labels), with exact_match and alias_match.

    SOURCE_CONFLICT where the corpus has several labels, UNSUPPORTED_PREFIX where nothing was probed.
    aliases: accepted (make, observed, decoded); labels then also have makes, and a known value that
    is an alias of the label of the only make matches too.
    """
    j = labels.join(consensus, keys, "left")
    status = F.when(F.size("labels") != 1, "SOURCE_CONFLICT").otherwise(F.coalesce("status", F.lit("UNSUPPORTED_PREFIX")))
    j = j.withColumn("status", status).withColumn("exact_match", (F.col("status") == "KNOWN") & (F.col("value") == F.col("labels")[0]))
    if aliases is None:
        return j.withColumn("alias_match", F.col("exact_match"))
    accepted = aliases.select(*(T.comparable_label(F.col(c)).alias(f"alias_{c}") for c in ("make", "observed", "decoded"))).distinct().withColumn("accepted", F.lit(True))
    same = (F.when(F.size("makes") == 1, F.col("makes")[0]) == F.col("alias_make")) & (F.col("labels")[0] == F.col("alias_observed")) & (F.col("value") == F.col("alias_decoded"))
    j = j.join(accepted, same, "left")
    return j.withColumn("alias_match", F.col("exact_match") | ((F.col("status") == "KNOWN") & F.col("accepted").isNotNull())).drop("accepted", "alias_make", "alias_observed", "alias_decoded")


def summary(judged_: DataFrame, by: list[str], weight=None) -> DataFrame:
    """(by, total, eligible, known, exact_matches, alias_matches, coverage, exact_precision, alias_precision);
    weighted by a column if one is given. Prefixes that conflict or aren't supported aren't eligible."""
    w = F.lit(1) if weight is None else F.col(weight)
    some = lambda c: F.sum(F.when(c, w).otherwise(0)).alias
    matched = lambda c: some(F.coalesce(c, F.lit(False)))(f"{c}es")
    out = judged_.groupBy(*by).agg(F.sum(w).alias("total"), some(~F.col("status").isin("SOURCE_CONFLICT", "UNSUPPORTED_PREFIX"))("eligible"), some(F.col("status") == "KNOWN")("known"), matched("exact_match"), matched("alias_match"))
    share = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 6)
    return out.withColumns({"coverage": share("known", "eligible"), "exact_precision": share("exact_matches", "known"), "alias_precision": share("alias_matches", "known")})


def top(rows: DataFrame, by: list[str], order: list, n: int = policy.MISMATCHES) -> DataFrame:
    """The first n rows of each group; Spark keeps n a group in each task before it shuffles them."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def first_groups(groups: DataFrame, n: int, key: str = "prefix") -> DataFrame:
    """The first n groups by key, for a trial run."""
    return groups.orderBy(key).limit(n)


def systematic(rows: DataFrame, by: list[str], order: list[str], step: int) -> DataFrame:
    """Every step-th row of each group, the first included.

    Rows are numbered within ranges of their order, each range on top of the counts of those before
    it, so that a large group isn't sorted in one task.
    """
    ranged = settled(rows.repartitionByRange(*by, *order).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("range", *by).count()  # a row for each range and group in it
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("range", *by).orderBy(*order)) - 1
    numbered = ranged.withColumn("own", own).join(counts.select("range", *by, before.alias("before")), ["range", *by])
    return numbered.withColumn("nth", F.col("own") + F.col("before")).where(F.pmod("nth", F.lit(step)) == 0).select(*rows.columns, "nth")


def target_coverage(approvals: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, approvals, covered, examples): distinct approvals of a target's makes whose type its
    pattern takes and its exclusion doesn't. The pattern minds case where case_sensitive says so, the
    exclusion never."""
    a = approvals.select("approval_id", F.col("fields")["make"].alias("make"), F.col("fields")["type"].alias("type"))
    t = targets.withColumn("make", F.explode("makes"))
    m = t.join(a, "make").where(F.regexp_like("type", F.when(F.col("case_sensitive"), F.col("include")).otherwise(F.concat(F.lit("(?iu)"), F.col("include")))) & ~F.coalesce(F.regexp_like("type", F.concat(F.lit("(?iu)"), F.nullif("exclude", F.lit("")))), F.lit(False)))
    per = m.groupBy("target").agg(F.array_sort(F.collect_set("approval_id")).alias("ids"))
    return targets.select("target").join(per, "target", "left").select("target", F.coalesce(F.size("ids"), F.lit(0)).alias("approvals"), F.coalesce(F.size("ids") > 0, F.lit(False)).alias("covered"), F.coalesce(F.slice("ids", 1, policy.EXAMPLES), F.array().cast("array<string>")).alias("examples"))
