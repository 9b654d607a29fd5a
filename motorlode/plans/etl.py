"""Source preparation: from dump tables and directories to the tables that the engine reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlode import policy
from motorlode.functions import text as T
from motorlode.functions.etl import wildcard_regex


def export_filter(wmis: DataFrame, today) -> tuple[DataFrame, DataFrame]:
    """(accepted, excluded with reasons) of (wmi, available date text): every reason is kept."""
    date = F.try_to_date(F.substring("available", 1, 10), "yyyy-MM-dd")
    reasons = F.array_compact(F.array(F.when(~F.col("wmi").rlike(r"\A[A-HJ-NPR-Z0-9]{3}(?:[A-HJ-NPR-Z0-9]{3})?\z"), F.lit("INVALID_WMI")), F.when(date.isNull(), F.lit("NO_AVAILABILITY_DATE")), F.when(date > today, F.lit("FUTURE_AVAILABILITY_DATE"))))
    r = wmis.withColumn("reasons", reasons)
    return r.where("size(reasons) = 0").drop("reasons"), r.where("size(reasons) > 0")


def assignments(wmis: DataFrame, manufacturers: DataFrame, types: DataFrame, wmi_makes: DataFrame, makes: DataFrame) -> DataFrame:
    """(wmi, manufacturer, brand, category): many makes of a key stay many rows, a key without any stays one."""
    j = wmis.join(manufacturers, "manufacturer_id").join(types, "type_id", "left").join(wmi_makes, "wmi_id", "left").join(makes, "make_id", "left")
    return j.select("wmi", F.col("manufacturer_name").alias("manufacturer"), F.upper(T.text_cell(F.col("make_name"))).alias("brand"), F.col("type_name").alias("category"))


def public_schemas(links: DataFrame, public_wmis: DataFrame, schemas: DataFrame) -> DataFrame:
    """Schema intervals of public keys and schemas past review; open ends close at the fixed year."""
    good = schemas.where(~F.col("tobeqced").eqNullSafe(F.lit("t"))).select("schema_id")
    return links.join(public_wmis.select("wmi_id", "wmi"), "wmi_id").join(good, "schema_id", "left_semi").select("wmi", "schema_id", "year_from", F.coalesce("year_to", F.lit(policy.OPEN_END)).alias("year_to"))


def public_elements(elements: DataFrame) -> DataFrame:
    return elements.where(~F.col("isprivate").eqNullSafe(F.lit("t")) & F.col("decode").isNotNull())


def resolved_values(patterns: DataFrame, elements: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """`patterns` with value: the attribute's name in the dictionary that its element names, else itself.

    dictionaries: (table, id, name) of all lookup tables together, so that one join serves all.
    """
    e = elements.select("element_id", F.lower("lookup_table").alias("lookup_table"))
    d = dictionaries.select(F.lower("table").alias("lookup_table"), F.col("id").alias("attribute_id"), F.col("name").alias("looked_up"))
    return patterns.join(e, "element_id").join(d, ["lookup_table", "attribute_id"], "left").withColumn("value", F.coalesce("looked_up", F.when(F.col("lookup_table").isNull(), F.col("attribute_id")))).drop("looked_up", "lookup_table")


def compiled_patterns(patterns: DataFrame) -> DataFrame:
    """`patterns` with regex, capture and shard; keys without meaning go. Each distinct key is compiled once."""
    keys = patterns.select("keys").distinct().withColumn("regex", wildcard_regex("keys")).where("regex is not null")
    hashes = F.instr("keys", "#")
    last = F.length("keys") - F.instr(F.reverse("keys"), "#") + 1
    start = F.when(hashes > 0, hashes - 1).otherwise(-1)
    return patterns.join(keys, "keys").withColumns({"capture": start, "capture_length": F.when(hashes > 0, last - hashes + 1).otherwise(0), "schema_bucket": F.pmod("schema_id", F.lit(policy.SHARDS))})


def accepted_approvals(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted with masks, excluded, counters) of rows (category, template, ..): one bad alternative excludes its row."""
    r = rows.withColumns({"masks": T.templates(F.col("template")), "passenger": F.coalesce(F.col("category").isin(*policy.PASSENGER_CATEGORIES), F.lit(False))})
    counters = r.agg(F.count("*").alias("n_rows"), F.sum(F.col("passenger").cast("long")).alias("n_passenger"), F.sum((F.col("passenger") & F.col("masks").isNotNull()).cast("long")).alias("n_accepted"))
    return r.where("passenger and masks is not null").drop("passenger"), r.where("not passenger or masks is null").drop("passenger"), counters


def directory_comparison(directory: DataFrame, assigned: DataFrame) -> DataFrame:
    """(wmi, relation) of two tables (wmi, name): SAME, DIFFERENT_NAMES, DIRECTORY_ONLY or ASSIGNED_ONLY."""
    names = lambda d, c: d.groupBy("wmi").agg(F.array_sort(F.collect_set(T.comparable_label(F.col("name")))).alias(c))
    j = names(directory, "listed").join(names(assigned, "assigned"), "wmi", "full_outer")
    relation = F.when(F.col("assigned").isNull(), "DIRECTORY_ONLY").when(F.col("listed").isNull(), "ASSIGNED_ONLY").when(F.col("listed") == F.col("assigned"), "SAME").otherwise("DIFFERENT_NAMES")
    return j.select("wmi", relation.alias("relation"), F.array_join(F.coalesce("listed", "assigned"), "|").alias("names"))


def directory_counts(directory: DataFrame) -> DataFrame:
    """(wmis, repeated, multi_hsn, multi_name) of rows (wmi, hsn, name)."""
    per = directory.groupBy("wmi").agg(F.count("*").alias("n"), F.count_distinct("hsn").alias("hsns"), F.count_distinct("name").alias("names"))
    more = lambda c: F.sum((F.col(c) > 1).cast("long"))
    return per.agg(F.count("*").alias("wmis"), more("n").alias("repeated"), more("hsns").alias("multi_hsn"), more("names").alias("multi_name"))


def directory_rules(directory: DataFrame) -> DataFrame:
    """(rule_id, identifier, pattern, name) of well-formed directory rows (page, row, part1, part2, name)."""
    d = directory.withColumn("identifier", T.directory_identifier(F.col("part1"), F.col("part2"))).where("identifier is not null")
    return d.select(T.row_locator(F.col("page"), F.col("row")).alias("rule_id"), "identifier", T.directory_pattern(F.col("identifier")).alias("pattern"), "name")


def preferences(preferred: DataFrame, directory: DataFrame, assigned: DataFrame) -> DataFrame:
    """Preferred directory rows (wmi, name, brand) whose assignment is the only one of its key and still so named."""
    unique = assigned.groupBy("wmi").agg(F.count("*").alias("n"), F.max("brand").alias("assigned_brand")).where("n = 1")
    d = directory.select("wmi", F.col("name").alias("listed")).distinct()
    j = preferred.join(d, "wmi", "left").join(unique, "wmi", "left")
    ok = (F.col("listed") == F.col("name")) & F.col("assigned_brand").isNotNull()
    return j.withColumn("ok", F.coalesce(ok, F.lit(False))).select("wmi", "name", "brand", "ok")


def layout_rules(layouts: DataFrame, attributes: DataFrame, years: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, claims) of maker layouts: a pattern of 17 tokens each, and a claim for each character.

    layouts: (layout, wmi, required map position -> characters, plant, source_id); attributes:
    (layout, position, characters, code, value); years: (layout, code, year).
    """
    at = lambda p: F.coalesce(F.concat(F.lit("["), F.try_element_at("required", F.lit(p)), F.lit("]")), F.lit("."))
    pattern = F.concat("wmi", *[at(p) for p in range(3, 10)], F.col("plant"), F.lit("[0-9]{6}"))
    rules = layouts.select(F.col("layout").alias("id"), pattern.alias("pattern"), F.lit(".{11}000000").alias("exclude"), "source_id")
    of = lambda d, position: d.select(F.col("layout").alias("rule_id"), position.alias("position"), F.explode(F.split("characters", "")).alias("characters"), "code", "value").where("characters <> ''")
    y = years.select("layout", F.col("code").alias("characters"), F.lit("ProductionYear").alias("code"), F.col("year").cast("string").alias("value"))
    return rules, of(attributes, F.col("position")).unionByName(of(y, F.lit(9)))


def latest(editions: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The latest edition of each source."""
    return editions.groupBy(*by).agg(F.max(order).alias(order), F.max_by(value, order).alias(value))
