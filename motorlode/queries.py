"""Registered queries of the engine's operators: (spark, data folder) to DataFrame."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlode import policy
from motorlode.functions import text as T
from motorlode.operators import approvals, codes, coverage, decide, identity, literals, merge, patterns, quality, wmi
from motorlode.plans import answer, etl
from motorlode.plans import specimens as S
from motorlode.plans.lineage import new_folder, settled
from motorlode.sources import readers, writers

TODAY = datetime.date(2026, 9, 30)


# d is a data folder, from whose tables requests are generated, or the requests themselves (see api.py).
def _prepared(spark, d) -> DataFrame:
    return wmi.prepared(d if isinstance(d, DataFrame) else S.requests(spark, d))


def _codes(spark, d) -> DataFrame:
    return d if isinstance(d, DataFrame) else S.code_requests(spark, d)


def _joined(c):
    return F.array_join(c, "|")


def _wmi_candidates(spark, d):
    return wmi.candidates(_prepared(spark, d), S.table(spark, "assignments"), S.table(spark, "manufacturers"))


def _years(spark, d):
    return settled(patterns.years(_prepared(spark, d), S.table(spark, "rich_wmis")))


def _tables(spark, *names):
    return [S.table(spark, n) for n in names]


def _matches(spark, d):
    return patterns.matches(_years(spark, d), *_tables(spark, "schemas", "patterns"))


def _facts(spark, d):
    years = _years(spark, d)
    return settled(patterns.decode(years, *_tables(spark, "schemas", "patterns", "engines", "models", "conversions"))), years


def _coded_fields(spark, d):
    facts, years = _facts(spark, d)
    f = patterns.fields(facts, years).join(S.table(spark, "elements"), "element_id")
    return facts, years, f.select("req_id", F.lit("patterns").alias("rule"), "code", "status", "possibilities", "value")


def _literal(spark, d):
    m = literals.matches(_prepared(spark, d), S.table(spark, "rules"))
    m = settled(m)
    return m, literals.claims(m, S.table(spark, "rule_claims"))


def _known(spark, prepared):
    """Requests of modern format whose key the pattern scheme knows."""
    modern = prepared.where("structure = 'MODERN_FORMAT'").withColumn("wmi", T.rich_key(F.col("normalized")))
    return modern.join(S.table(spark, "rich_wmis").select("wmi"), "wmi", "left_semi").select("req_id", "model_year", "market")


def _details(spark, d):
    facts, years, fields = _coded_fields(spark, d)
    prepared = settled(_prepared(spark, d))
    matched, held = _literal(spark, d)
    known = _known(spark, prepared)
    results = literals.results(matched).unionByName(merge.pattern_result(years, known, fields))
    every = fields.drop("value").unionByName(literals.fields(held).drop("value"))
    details, merged = merge.merged(settled(results), settled(every), prepared)
    return facts, held, details, settled(merged), prepared


def _decided(spark, d):
    facts, held, details, merged, prepared = _details(spark, d)
    found = settled(_wmi_candidates(spark, d))
    brands = wmi.resolve(found, {"brand": "brand"}).select("req_id", "brand_status")
    rows = found.where("assignment_id is not null").select("req_id", "brand")
    appr = approvals.candidates(prepared, S.table(spark, "approvals"))
    out = decide.decide(prepared.select("req_id", "structure", "model_year", "market"), details, merged, rows, brands, appr, *_tables(spark, "make_aliases", "model_aliases"))
    return out, facts, held, details, merged, prepared


def vin_normalize_structure(spark, d):
    return _prepared(spark, d).select("req_id", "normalized", "structure")


def type_code_validity(spark, d):
    return codes.prepared(_codes(spark, d)).select("req_id", "norm_hsn", "norm_tsn", "input_status")


def wmi_key_lookup_path(spark, d):
    return wmi.lookup_keys(_prepared(spark, d), S.table(spark, "assignments")).select("req_id", "wmi")


def wmi_key_rich_path(spark, d):
    return _prepared(spark, d).where("structure = 'MODERN_FORMAT'").select("req_id", T.rich_key(F.col("normalized")).alias("wmi"), T.pattern_key(F.col("normalized")).alias("pattern_key"))


def wmi_candidates(spark, d):
    return _wmi_candidates(spark, d).where("assignment_id is not null").select("req_id", "assignment_id", "manufacturer", "country", "established")


def wmi_resolution(spark, d):
    """For each request, what its key establishes, and how surely."""
    r = wmi.resolve(_wmi_candidates(spark, d), {"brand": "brand", "manufacturer": "manufacturer", "category": "category", "country": "country"})
    return r.select("req_id", "n_candidates", "status", "brand_status", "brand", _joined("brand_possibilities").alias("brand_possibilities"), "manufacturer_status", "manufacturer", "category_status", "category", "country_status", "country")


def type_code_lookup(spark, d):
    return codes.resolve(codes.candidates(_codes(spark, d), S.table(spark, "types")))


def year_candidates(spark, d):
    return _years(spark, d).select("req_id", "wmi", "year")


def pattern_matches(spark, d):
    return _matches(spark, d).select("req_id", "year", "element_id", "pattern_id", "priority", "kind", "value")


def pattern_top1(spark, d):
    return patterns.select(_matches(spark, d)).select("req_id", "year", "element_id", "value", "rule_id", "place")


def pattern_fields(spark, d):
    facts, years = _facts(spark, d)
    return patterns.fields(facts, years).select("req_id", "element_id", "status", _joined("possibilities").alias("possibilities"), "value")


def formula_capture(spark, d):
    return _matches(spark, d).where("kind = 'NUMERIC_PATTERN'").select("req_id", "year", "element_id", "rule_id", "value")


def engine_relation(spark, d):
    return patterns.engine_facts(_matches(spark, d), S.table(spark, "engines")).select("req_id", "year", "element_id", "value", "rule_id", "priority")


def model_make(spark, d):
    chosen = patterns.select(_matches(spark, d))
    return patterns.make_from_model(chosen, S.table(spark, "models")).where(F.col("element_id") == policy.MAKE_ELEMENT).select("req_id", "year", "value", "attribute_id", "kind", "rule_id")


def unit_conversion(spark, d):
    facts, _ = _facts(spark, d)
    return facts.where("kind = 'UNIT_CONVERSION'").select("req_id", "year", "element_id", "value", "rule_id")


def literal_rules(spark, d):
    return literals.results(_literal(spark, d)[0]).drop("has_alternatives")


def literal_fields(spark, d):
    return literals.fields(_literal(spark, d)[1]).select("req_id", "rule", "code", "status", _joined("possibilities").alias("possibilities"), "value")


def merged_fields(spark, d):
    _, _, _, merged, _ = _details(spark, d)
    return merged.select("req_id", "code", "status", _joined("possibilities").alias("possibilities"), "value")


def details_status(spark, d):
    return _details(spark, d)[2]


def details_messages(spark, d):
    """Stages and warnings of each request's result."""
    facts, years, fields = _coded_fields(spark, d)
    prepared = settled(_prepared(spark, d))
    matched, _ = _literal(spark, d)
    known = _known(spark, prepared)
    results = literals.results(matched).unionByName(merge.pattern_result(years, known, fields))
    texts = literals.messages(matched).unionByName(merge.pattern_messages(years, known, fields))
    out = merge.messages(results, texts, prepared)
    return out.select("req_id", _joined("stages").alias("stages"), _joined("warnings").alias("warnings"))


def approval_masks(spark, d):
    return approvals.candidates(_prepared(spark, d), S.table(spark, "approvals")).select("req_id", "approval_id", "source_row")


def approval_fields(spark, d):
    return approvals.fields(approvals.candidates(_prepared(spark, d), S.table(spark, "approvals"))).select("req_id", "code", _joined("possibilities").alias("possibilities"))


def approval_status(spark, d):
    p = _prepared(spark, d)
    return approvals.statuses(p, approvals.candidates(p, S.table(spark, "approvals")))


def template_validation(spark, d):
    ok, bad, _ = etl.accepted_approvals(S.table(spark, "masks"))
    return ok.select("row", _joined("masks").alias("masks"), F.lit(True).alias("accepted")).unionByName(bad.select("row", _joined("masks").alias("masks"), F.lit(False).alias("accepted")))


def identity_consensus(spark, d):
    rows = _wmi_candidates(spark, d).where("assignment_id is not null").select("req_id", F.col("brand").alias("value"))
    c = identity.consensus(identity.make_of(rows, S.table(spark, "make_aliases")), ["req_id"])
    return c.select("req_id", _joined(F.transform("identities", lambda i: i["id"])).alias("ids"), "unmapped", "labels", identity.status_of(F.col("identities"), F.col("unmapped"), F.lit("KNOWN")).alias("status"))


def decision_status(spark, d):
    out = _decided(spark, d)[0]
    return out.select("req_id", "make_status", "make", "make_reason", "make_id", "model_status", "model", "model_reason", "model_id", "modelYear_status", "modelYear", "modelYear_reason", "productionYear_status", "productionYear", _joined(F.transform("assumptions", lambda a: F.concat(a["code"], F.coalesce(F.concat(F.lit("["), F.array_join(a["sourceMarkets"], ","), F.lit("]")), F.lit("")), F.lit(":"), F.array_join(a["fields"], ",")))).alias("assumptions"))


def code_decision(spark, d):
    return decide.decide_codes(codes.candidates(_codes(spark, d), S.table(spark, "types")), *_tables(spark, "make_aliases", "model_aliases"))


def _credited(spark, decided, facts, held):
    names = F.create_map(*[F.lit(x) for n, c in policy.PRIMARY.items() for x in (c, n)])
    f = facts.join(S.table(spark, "elements"), "element_id").select("req_id", "code", F.lit("patterns").alias("source_id"))
    used = f.unionByName(held.where("not conflict").select("req_id", "code", "source_id")).withColumn("field", F.try_element_at(names, F.col("code"))).where("field is not null")
    return answer.credits(used.select("req_id", "field", "source_id").distinct(), decided, S.table(spark, "sources"))


def source_credits(spark, d):
    out, facts, held, _, _, _ = _decided(spark, d)
    return _credited(spark, out, facts, held).select("req_id", "source_id", _joined("paths").alias("paths"), "terms")


def answer_short(spark, d):
    out, facts, held, _, _, prepared = _decided(spark, d)
    return answer.short(prepared, out, _credited(spark, out, facts, held))


def answer_long(spark, d):
    out, facts, held, details, merged, prepared = _decided(spark, d)
    f = facts.withColumn("source_id", F.lit("patterns"))
    return answer.long(answer.short(prepared, out, _credited(spark, out, facts, held)), out, f, details, merged)


def constraint_overlaps(spark, d):
    return quality.overlaps(S.table(spark, "assignments"))


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def orphan_references(spark, d):
    lines = _read(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    no_order = quality.orphans(lines, "l_orderkey", _read(spark, d, "orders"), "o_orderkey").select(F.lit("order").alias("reference"), F.col("l_orderkey").alias("key"))
    no_part = quality.orphans(lines, "l_partkey", _read(spark, d, "part"), "p_partkey").select(F.lit("part").alias("reference"), F.col("l_partkey").alias("key"))
    return no_order.unionByName(no_part).groupBy("reference").agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"))


def duplicate_keys(spark, d):
    return quality.duplicates(_read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


def wmi_export_filter(spark, d):
    ok, bad = etl.export_filter(S.table(spark, "wmi_rows"), F.lit(TODAY))
    return ok.select("wmi", F.lit("").alias("reasons")).unionByName(bad.select("wmi", _joined("reasons").alias("reasons")))


def assignment_etl(spark, d):
    ok, _ = etl.export_filter(S.table(spark, "wmi_rows"), F.lit(TODAY))
    return etl.assignments(ok, *_tables(spark, "dump_manufacturers", "vehicle_types", "wmi_makes", "makes"))


def _named(spark, d):
    customers = _read(spark, d, "customer").select(F.col("c_custkey") % 1000, F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))).toDF("wmi", "name")
    suppliers = _read(spark, d, "supplier").select(F.col("s_suppkey") % 1000, F.concat(F.lit("Nation  "), F.col("s_nationkey").cast("string"))).toDF("wmi", "name")
    return customers, suppliers


def directory_comparison(spark, d):
    return etl.directory_comparison(*_named(spark, d))


def directory_counts(spark, d):
    c = _read(spark, d, "customer").select((F.col("c_custkey") % 1000).alias("wmi"), F.col("c_mktsegment").alias("hsn"), F.col("c_nationkey").cast("string").alias("name"))
    return etl.directory_counts(c)


def inventory_difference(spark, d):
    a, b = _named(spark, d)
    return quality.difference(a.select("wmi"), b.select("wmi"), ["wmi"])


def _prefix(d):
    """`d` (orders) with k and the ten-character prefix that stands for it; some can't be probed."""
    k = F.col("o_custkey") % 500
    third = F.when(k % 9 == 0, "9").when(k % 50 == 1, "I").otherwise("G")
    return d.withColumn("k", k).withColumn("prefix", F.concat(F.lit("1H"), third, F.lit("AAAA"), F.lpad(k.cast("string"), 3, "0")))


def _probes(spark, d):
    """Orders as probes of supported prefixes, with what each of them knows."""
    o = _prefix(_read(spark, d, "orders")).where(coverage.supported_prefix(F.col("prefix")))
    status = F.when((F.col("k") % 5 == 0) & (F.col("o_orderkey") % 11 == 0), "UNKNOWN").when(F.col("k") % 5 == 1, "AMBIGUOUS").otherwise("KNOWN")
    value = F.when(F.col("k") % 7 == 3, F.lit(None)).when(F.col("k") % 3 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 2 == 0, " Golf ").otherwise("golf")
    return o.select("prefix", status.alias("status"), F.when(status == "KNOWN", value).alias("value"))


def _labels(spark, d):
    o = _prefix(_read(spark, d, "orders"))
    label = F.when(F.col("k") % 4 == 0, F.col("o_orderstatus")).when(F.col("k") % 4 == 1, "GOLF").otherwise("golf  VII")
    return coverage.grouped(o.select("prefix", label.alias("labels"), F.concat(F.lit("make "), (F.col("k") % 4).cast("string")).alias("makes"), F.lit(1).alias("vehicle_count")), ["labels", "makes"])


def probe_consensus(spark, d):
    return coverage.probe_consensus(_probes(spark, d), ["prefix"])


def _judged(spark, d):
    return coverage.judged(coverage.probe_consensus(_probes(spark, d), ["prefix"]), _labels(spark, d), ["prefix"], S.table(spark, "accepted_aliases"))


def coverage_matches(spark, d):
    return _judged(spark, d).select("prefix", "weight", "status", "exact_match", "alias_match")


def coverage_summary(spark, d):
    return coverage.summary(_judged(spark, d).withColumn("field", F.lit("label")), ["field"])


def coverage_weighted(spark, d):
    return coverage.summary(_judged(spark, d).withColumn("make", F.when(F.size("labels") == 1, F.col("labels")[0]).otherwise("SOURCE_CONFLICT")), ["make"], "weight")


def target_coverage(spark, d):
    p = _read(spark, d, "part")
    a = p.select(F.format_string("p%08d", F.col("p_partkey")).alias("approval_id"), F.create_map(F.lit("make"), F.col("p_brand"), F.lit("type"), F.col("p_name")).alias("fields"))
    return coverage.target_coverage(a, S.table(spark, "targets")).select("target", "approvals", "covered", _joined("examples").alias("examples"))


def top_mismatches(spark, d):
    o = _read(spark, d, "orders")
    return coverage.top(o.select("o_orderstatus", "o_orderkey", "o_totalprice"), ["o_orderstatus"], [F.col("o_totalprice").desc(), "o_orderkey"])


def systematic_sample(spark, d):
    return coverage.systematic(_read(spark, d, "orders").select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], ["o_orderkey"], 31).select("o_orderstatus", "o_orderkey")


def drift_guard(spark, d):
    flagged = lambda t, c: _read(spark, d, t).select((F.col(c) < 0).alias("excluded"))
    return quality.drift(flagged("customer", "c_acctbal"), flagged("supplier", "s_acctbal"))


def directory_rules(spark, d):
    return etl.directory_rules(_directory(spark, d))


def directory_pages(spark, d):
    """Rows of each page of the directory, and its row numbers that are missing or repeated."""
    rows = _directory(spark, d)
    gaps = quality.gaps(rows.select("page", "row"), "page", "row").groupBy("page").agg(F.count("*").alias("n_gaps"))
    return quality.page_counts(rows, "page").join(gaps, "page", "left").select("page", "n_rows", F.coalesce("n_gaps", F.lit(0).cast("long")).alias("n_gaps"))


def _directory(spark, d):
    """Customers as directory rows of 50 a page: a key of three characters, for some with an extension."""
    key = F.upper(F.translate(F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 2), "abcdef", "ABCDEF"))
    nine = F.col("c_custkey") % 6 == 0
    part1 = F.concat(key, F.when(nine, "9").when(F.col("c_custkey") % 7 == 0, "O").otherwise("A"))
    part2 = F.when(nine & (F.col("c_custkey") % 12 == 0), F.substring(F.upper(F.md5(F.col("c_name").cast("binary"))), 1, 3))
    c = _read(spark, d, "customer")
    return c.select(F.floor(F.col("c_custkey") / 50).cast("int").alias("page"), (F.col("c_custkey") % 50 + 1).cast("int").alias("row"), part1.alias("part1"), part2.alias("part2"), F.col("c_name").alias("name"))


def _dump(spark, d) -> str:
    """Parts and nations as a dump in the shared folder: tabs, backslashes and nulls are escaped."""
    cell = lambda c: F.coalesce(F.regexp_replace(F.regexp_replace(c.cast("string"), r"\\", r"\\\\"), "\t", r"\\t"), F.lit(r"\N"))
    line = lambda k, text: spark.createDataFrame([(k, -1, text)], "block int, k long, value string")
    part = _read(spark, d, "part").select(F.lit(1).alias("block"), F.col("p_partkey").cast("long").alias("k"), F.concat_ws("\t", cell(F.col("p_partkey")), cell(F.concat("p_name", F.lit("\t\\"))), cell(F.when(F.col("p_size") > 9, F.col("p_brand")))).alias("value"))
    nation = _read(spark, d, "nation").select(F.lit(4).alias("block"), F.col("n_nationkey").cast("long").alias("k"), F.concat_ws("\t", cell(F.col("n_nationkey")), cell(F.col("n_name"))).alias("value"))
    lines = line(0, 'COPY public.part (id, "name", brand) FROM stdin;').unionByName(part).unionByName(line(2, r"\.")).unionByName(line(3, "COPY nation (id, name) FROM stdin;")).unionByName(nation).unionByName(line(5, r"\."))
    lines.orderBy("block", "k").coalesce(1).select("value").write.text(path := new_folder(spark, "dump"))
    return path


def dump_table(spark, d):
    return readers.copy_table(spark, _dump(spark, d), "part")


def dump_inventory(spark, d):
    return readers.copy_inventory(spark, _dump(spark, d))


def null_marked_text(spark, d):
    """Parts written as text in the order of their key, nulls marked, and read back."""
    p = _read(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 9, F.col("p_brand")).alias("p_brand"), F.lit("").alias("empty"))
    writers.sorted_tsv(p, path := new_folder(spark, "text"), "p_partkey")
    return readers.null_cells(spark, path, p.columns)


def pattern_shards(spark, d):
    """Parts as patterns of schemas, written by shard and read back."""
    p = _read(spark, d, "part").select(F.col("p_partkey").cast("int").alias("schema_id"), F.col("p_size").cast("int").alias("pattern_id"), F.col("p_type" if "p_type" in _read(spark, d, "part").columns else "p_name").alias("keys"))
    writers.bucketed(p, path := new_folder(spark, "patterns"))
    return readers.shards(spark, path).select("schema_bucket", "schema_id", "pattern_id")


def approval_shards(spark, d):
    """Approvals copied to each of their prefixes."""
    writers.by_prefix(S.table(spark, "approvals").drop("wmi"), path := new_folder(spark, "approvals"))
    return readers.shards(spark, path).select("wmi", "approval_id", "source_row")


def folder_manifest(spark, d):
    """A folder checked against its own manifest without one line and with one more: names and problems."""
    path = new_folder(spark, "bundle")
    _read(spark, d, "region").coalesce(1).write.parquet(f"{path}/a")
    _read(spark, d, "nation").coalesce(1).write.parquet(f"{path}/b")
    known = writers.manifest(spark, path).where("name not like 'b/%'").select("name", "sha256")
    found = readers.verified(spark, path, known.unionByName(spark.createDataFrame([("c/gone", "0")], "name string, sha256 string")))
    return found.where("name not like '%SUCCESS%'").select(F.substring_index("name", "/", 1).alias("folder"), "problem")


def set_relations(spark, d):
    """Parts that are sold and all parts, as sets of keys."""
    return quality.compared(_read(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), _read(spark, d, "part").select(F.col("p_partkey").alias("k")), ["k"])


def ordered_types(spark, d):
    """The type-code entries with their place in the order of publication."""
    return codes.ordered(S.table(spark, "types")).select("hsn", "tsn", "source_object_id", F.monotonically_increasing_id().alias("place"))


def first_prefixes(spark, d):
    return coverage.first_groups(_labels(spark, d).select("prefix", "weight"), 20)


def model_alias_precedence(spark, d):
    """Parts as models of a make (brand): the smallest id of each label within it."""
    models = _read(spark, d, "part").select(F.col("p_brand").alias("make_id"), T.identity_key(F.substring("p_name", 1, 4)).alias("alias"), F.format_string("m%08d", "p_partkey").alias("model_id"))
    return identity.model_alias_table(models)


def latest_editions(spark, d):
    o = _read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("date").cast("string").alias("edition")).agg(F.max("o_orderkey").alias("locator"))
    return etl.latest(o, ["source"], "edition", "locator")


def public_schemas(spark, d):
    """Lines as links of keys (suppliers) and schemas (parts); some parts await review, some suppliers aren't public."""
    links = _read(spark, d, "lineitem").select(F.col("l_suppkey").alias("wmi_id"), F.col("l_partkey").alias("schema_id"), F.year("l_shipdate").alias("year_from"), F.when(F.col("l_returnflag") != "N", F.year("l_shipdate") + 1).alias("year_to"))
    keys = _read(spark, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("wmi_id"), F.col("s_name").alias("wmi"))
    schemas = _read(spark, d, "part").select(F.col("p_partkey").alias("schema_id"), F.when(F.col("p_size") < 10, "t").when(F.col("p_size") < 30, "f").alias("tobeqced"))
    return etl.public_schemas(links, keys, schemas).groupBy("wmi", "schema_id").agg(F.count("*").alias("n"), F.min("year_from").alias("year_from"), F.max("year_to").alias("year_to"))


def resolved_values(spark, d):
    """Lines as patterns whose attribute names a part, a supplier or itself, as their element says."""
    kind = F.col("l_linenumber") % 3
    p = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", kind.cast("int").alias("element_id"), F.when(kind == 0, F.col("l_partkey")).when(kind == 1, F.col("l_suppkey") * 2).otherwise(F.col("l_quantity").cast("long")).cast("string").alias("attribute_id"))
    elements = spark.createDataFrame([(0, "Part"), (1, "SUPPLIER"), (2, None)], "element_id int, lookup_table string")
    names = lambda t, k, n: _read(spark, d, t).select(F.lit(t).alias("table"), F.col(k).cast("string").alias("id"), F.col(n).alias("name"))
    return etl.resolved_values(p, elements, names("part", "p_partkey", "p_name").unionByName(names("supplier", "s_suppkey", "s_name"))).select("l_orderkey", "l_linenumber", "value")


def preferences(spark, d):
    """Nations' suppliers as a directory, customers' nations as assignments, and preferred rows of each nation."""
    named = lambda t, p: _read(spark, d, t).select(F.col(f"{p}_nationkey").alias("wmi"), F.concat(F.lit(f"{p} "), F.col(f"{p}_nationkey").cast("string")).alias("name"))
    assigned = _read(spark, d, "customer").select((F.col("c_custkey") % 400).alias("wmi"), F.col("c_mktsegment").alias("brand")).distinct()
    preferred = _read(spark, d, "nation").select(F.col("n_nationkey").alias("wmi"), F.concat(F.when(F.col("n_regionkey") == 1, "x ").otherwise("s "), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("brand"))
    return etl.preferences(preferred, named("supplier", "s"), assigned.where("wmi >= 5"))


def document_urls(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.array_join(T.urls(F.coalesce("text", F.lit(""))), " ").alias("urls"))


def encoded_cells(spark, d):
    """Names of parts as base64 cells, and read back."""
    cell = T.encoded_cell(F.col("p_name"))
    return _read(spark, d, "part").select("p_partkey", cell.alias("cell"), T.decoded_cell(cell).alias("name"))


QUERIES = {
    f.__name__: f
    for f in (
        vin_normalize_structure, type_code_validity, wmi_key_lookup_path, wmi_key_rich_path, wmi_candidates, wmi_resolution, type_code_lookup, year_candidates, pattern_matches, pattern_top1,
        pattern_fields, formula_capture, engine_relation, model_make, unit_conversion, literal_rules, literal_fields, merged_fields, details_status, approval_masks, approval_fields, approval_status,
        template_validation, identity_consensus, decision_status, code_decision, source_credits, answer_short, answer_long, constraint_overlaps, orphan_references, duplicate_keys, wmi_export_filter,
        assignment_etl, directory_comparison, directory_counts, inventory_difference, probe_consensus, coverage_matches, coverage_summary, coverage_weighted, target_coverage, top_mismatches, systematic_sample, drift_guard,
        directory_rules, directory_pages, latest_editions, details_messages, dump_table, dump_inventory, null_marked_text, pattern_shards, approval_shards, folder_manifest, set_relations, ordered_types, first_prefixes, model_alias_precedence, public_schemas, resolved_values, preferences, document_urls, encoded_cells,
    )
}
