import json

import pytest
from pyspark.sql import functions as F

from motorlode.operators import approvals, codes, coverage, decide, identity, literals, merge, patterns, quality, wmi
from motorlode.plans import answer, etl
from motorlode.plans import specimens as S

REQUEST = "req_id bigint, supplied string, model_year int, market string"


def requests(spark, *rows):
    return wmi.prepared(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], REQUEST))


def decoded(spark, r):
    """What the registered queries do, over given requests."""
    from motorlode.functions import text as T

    t = lambda n: S.table(spark, n)
    years = patterns.years(r, t("rich_wmis")).cache()
    facts = patterns.decode(years, *map(t, ("schemas", "patterns", "engines", "models", "conversions"))).cache()
    fields = patterns.fields(facts, years).join(t("elements"), "element_id").select("req_id", F.lit("patterns").alias("rule"), "code", "status", "possibilities")
    m = literals.matches(r, t("rules"))
    held = literals.claims(m, t("rule_claims"))
    known = r.where("structure = 'MODERN_FORMAT'").withColumn("wmi", T.rich_key(F.col("normalized"))).join(t("rich_wmis").select("wmi"), "wmi", "left_semi")
    results = literals.results(m).unionByName(merge.pattern_result(years, known.select("req_id", "model_year", "market"), fields))
    details, merged = merge.merged(results, fields.unionByName(literals.fields(held).drop("value")), r)
    return facts, details.cache(), merged.cache()


def answers(spark, r):
    facts, details, merged = decoded(spark, r)
    found = wmi.candidates(r, S.table(spark, "assignments"), S.table(spark, "manufacturers"))
    brands = wmi.resolve(found, {"brand": "brand"}).select("req_id", "brand_status")
    a = approvals.candidates(r, S.table(spark, "approvals"))
    out = decide.decide(r.select("req_id", "structure", "model_year", "market"), details, merged, found.where("assignment_id is not null").select("req_id", "brand"), brands, a, S.table(spark, "make_aliases"), S.table(spark, "model_aliases"))
    return out, facts, details, merged


def test_lookup_statuses(spark):
    r = requests(spark, ("1HGAAAAAAAAAAAAAA", None, None), ("1C4AAAAAAAAAAAAAA", None, None), ("1H9AAAAAAAA333AAA", None, None), ("1H9333AAAAAAAAAAA", None, None), ("1HGIAAAAAAAAAAAAA", None, None), ("\t1HGAAAAAAAAAAAAAA", None, None), ("WVWAAAAAAAAAAAAAA", None, None), ("XP7AAAAAAAAAAAAAA", 2019, None))
    got = {x["req_id"]: x for x in wmi.resolve(wmi.candidates(r, S.table(spark, "assignments"), S.table(spark, "manufacturers")), {"brand": "brand", "manufacturer": "manufacturer"}).collect()}
    assert [got[i]["status"] for i in range(8)] == ["RECOGNIZED", "AMBIGUOUS", "RECOGNIZED", "UNKNOWN", "RECOGNIZED", "UNSUPPORTED_FORMAT", "NEEDS_CONTEXT", "UNKNOWN"]
    assert got[1]["brand_possibilities"] == ["DELTA", "DELTA TRUCKS"] and got[1]["brand_status"] == "AMBIGUOUS"
    assert (got[1]["manufacturer_status"], got[1]["manufacturer"]) == ("NEEDS_CONTEXT", None)
    assert got[0]["brand"] == "ALPHA" and got[6]["brand"] is None


def test_type_codes(spark):
    r = spark.createDataFrame([(1, " 0005 ", "amq"), (2, "5", "AMQ"), (3, "0004", "AMR"), (4, "9999", "ZZZ")], "req_id bigint, hsn string, tsn string")
    found = codes.candidates(r, S.table(spark, "types"))
    got = {x["req_id"]: x for x in codes.resolve(found).collect()}
    assert [got[i]["status"] for i in (1, 2, 3, 4)] == ["RECOGNIZED", "INVALID_INPUT", "AMBIGUOUS", "UNKNOWN"]
    d = {x["req_id"]: x for x in decide.decide_codes(found, S.table(spark, "make_aliases"), S.table(spark, "model_aliases")).collect()}
    assert (d[1]["make"], d[1]["model"]) == ("Alpha", "Alpha") and d[3]["model_status"] == "UNKNOWN" and d[4]["make_reason"] == "NO_TYPE_CODE_MATCH"


def test_documented_specimens(spark):
    r = requests(spark, ("WVWZZZ1KZ5P000001", None, "DE"), ("WVWZZZ1KZ5P000001", 2006, "DE"), ("XP7YGAEK0TB000001", None, "DE"), ("XP7YGAEK0TB000000", None, "DE"), ("WVWZZZ1KZ6P000001", None, "DE"), ("3VWZZZ1KZ5P000001", None, "DE"))
    out, _, details, merged = answers(spark, r)
    got = {x["req_id"]: x for x in out.collect()}
    fields = {(x["req_id"], x["code"]): x for x in merged.collect()}
    status = {x["req_id"]: x["status"] for x in details.collect()}
    assert (got[0]["make"], got[0]["model"], got[0]["modelYear"]) == ("Volkswagen", "Golf", "2005")
    assert fields[0, "PlantCity"]["value"] == "MOSEL"
    assert status[1] == "CONTEXT_CONFLICT" and got[1]["model_status"] == "CONFLICT"
    assert (got[2]["model"], got[2]["productionYear"], got[2]["modelYear"]) == ("Model Y", "2026", None)
    assert fields[2, "PlantCity"]["value"] == "BERLIN"
    assert (3, "PlantCity") not in fields and (4, "PlantCity") not in fields and (5, "PlantCity") not in fields


def test_missing_in_one_cycle_is_unknown(spark):
    r = requests(spark, ("5UPAA2420AA000001", None, "US"), ("5UPAA2420AA000001", 2010, "US"), ("5UPAA2420AA000001", 2010, None))
    facts, _, merged = decoded(spark, r)
    got = {(x["req_id"], x["code"]): x for x in merged.collect()}
    assert got[0, "Model"]["status"] == "UNKNOWN" and got[0, "Model"]["possibilities"] == ["Hauler"]
    assert got[1, "Model"]["value"] == "Hauler" and got[2, "Model"]["status"] == "NEEDS_CONTEXT"
    assert sorted(x["value"] for x in facts.where("req_id = 1 and element_id = 121").collect()) == ["Rack", "Winch"]


def test_conversions_never_chain(spark):
    years = spark.createDataFrame([(1, "X" * 17, None, "US", "1HG", 2004, "k")], "req_id bigint, normalized string, model_year int, market string, wmi string, year int, key string")
    m = spark.createDataFrame([(1, 2004, 11, "1000", "a", "PATTERN", "1", 1, "*", 1, None, 1)], "req_id bigint, year int, element_id int, value string, attribute_id string, kind string, rule_id string, schema_id int, keys string, priority int, changed string, pattern_id int")
    got = {x["element_id"]: x["value"] for x in patterns.conversions(patterns.select(m), m, S.table(spark, "conversions")).collect()}
    assert got == {11: "1000", 12: "61.023744", 13: "1"}  # 13 from 11, not from the converted 12
    assert years.count() == 1


def test_rule_order_and_repeats_dont_matter(spark):
    r = requests(spark, ("WVWZZZ1KZ5P000001", None, "DE"), ("TMBAAAAAAAAAAAAAA", None, "CH"), ("TMBAAAAAA3AAAAAAA", 1999, "AT"))
    rules, claims = S.table(spark, "rules"), S.table(spark, "rule_claims")
    run = lambda a, b: sorted(map(str, literals.fields(literals.claims(literals.matches(r, a), b)).collect()))
    assert run(rules, claims) == run(rules.orderBy(F.desc("id")), claims.union(claims).orderBy(F.desc("value")))
    by_rule = {(x["rule"], x["code"]): x for x in literals.fields(literals.claims(literals.matches(r, rules), claims)).where("req_id = 1").collect()}
    assert by_rule["old-tmb", "Model"]["status"] == "AMBIGUOUS"


def test_approvals(spark):
    r = requests(spark, ("TMBA1AAAAAAAAAAAA", None, None), ("TMBZZZZZZZZZZZZZZ", None, None), ("short", None, None))
    found = approvals.candidates(r, S.table(spark, "approvals"))
    assert {x["req_id"]: x["status"] for x in approvals.statuses(r, found).collect()} == {0: "CANDIDATES", 1: "NO_MATCH", 2: "INVALID_INPUT"}
    f = {x["code"]: x["possibilities"] for x in approvals.fields(found).collect()}
    assert f == {"make": ["SKODA"], "type": ["5E"]}


def test_consensus_never_picks_a_majority(spark):
    rows = spark.createDataFrame([(1, "ALPHA"), (1, "alpha "), (2, "ALPHA"), (2, "VW"), (3, "ALPHA"), (3, None)], "req_id bigint, value string")
    c = identity.consensus(identity.make_of(rows, S.table(spark, "make_aliases")), ["req_id"])
    got = {x["req_id"]: x["s"] for x in c.select("req_id", identity.status_of(F.col("identities"), F.col("unmapped"), F.lit("KNOWN")).alias("s")).collect()}
    assert got == {1: "RESOLVED", 2: "AMBIGUOUS", 3: "UNKNOWN"}


def test_alias_precedence(spark):
    s = "alias string, make_id string, name string, source_id string"
    makes = spark.createDataFrame([("A", "2", "two", "m"), ("A", "1", "one", "m"), ("B", "3", "three", "m")], s)
    labels = spark.createDataFrame([("A", "0", "zero", "l"), ("C", "5", "five", "l")], s)
    explicit = spark.createDataFrame([("B", "9", "nine", "e")], s)
    assert {x["alias"]: x["make_id"] for x in identity.alias_table(makes, labels, explicit).collect()} == {"A": "1", "B": "9", "C": "5"}


def test_answers_keep_nulls_and_long_extends_short(spark):
    r = requests(spark, ("WVWZZZ1KZ5P000001", None, "DE"), ("nonsense", None, None))
    out, facts, details, merged = answers(spark, r)
    held = literals.claims(literals.matches(r, S.table(spark, "rules")), S.table(spark, "rule_claims"))
    used = held.where("code in ('Make', 'Model')").select("req_id", F.lower("code").alias("field"), "source_id").distinct()
    short = answer.short(r, out, answer.credits(used, out, S.table(spark, "sources")))
    a = {x["req_id"]: json.loads(x["answer"]) for x in short.collect()}
    assert a[0]["vehicle"]["model"] == "Golf" and a[0]["sources"][0]["fields"] == ["/vehicle/make", "/vehicle/makeId", "/vehicle/model", "/vehicle/modelId"]
    assert a[1]["vehicle"]["make"] is None and a[1]["inputStatus"] == "UNSUPPORTED_LENGTH" and a[1]["sources"] == []
    long = answer.long(short, out, facts.withColumn("source_id", F.lit("patterns")), details, merged)
    for x in long.collect():
        assert json.loads(x["answer"]) == a[x["req_id"]] and "decisions" in json.loads(x["details"])
    assert answer.summary(out).where("req_id = 0").first()["text"].startswith("make: Volkswagen (RESOLVED)")


def test_assumptions_name_the_markets_of_their_evidence(spark):
    """A foreign rule's claims are assumed across markets, whatever scope the merged result has."""
    r = requests(spark, ("WVWZZZ1KZ5P000001", None, None), ("1HGAA1111AA000001", None, None), ("1HGAA1111AA000001", None, "DE"))
    out, facts, details, _ = answers(spark, r)
    got = {x["req_id"]: [a.asDict() for a in x["assumptions"]] for x in out.collect()}
    cross = [a for a in got[0] if a["code"] == "CROSS_MARKET_MATCH"]
    assert cross and "EUROPE" in cross[0]["sourceMarkets"] and cross[0]["message"].startswith("Possible match from EUROPE")
    assert [a["code"] for a in got[1]] in (["US_MARKET_ASSUMED"], []) and all(a["sourceMarkets"] == ["US"] and a["requestedMarket"] == "DE" for a in got[2] if a["code"] == "CROSS_MARKET_MATCH")
    none = spark.createDataFrame([], "req_id bigint, field string, source_id string")
    texts = [json.loads(x["answer"])["assumptions"] for x in answer.short(r, out, answer.credits(none, out, S.table(spark, "sources"))).collect()]
    assert all(set(a) in ({"code", "fields"}, {"code", "fields", "requestedMarket", "sourceMarkets", "message"}) for t in texts for a in t)


def test_quality(spark):
    assert [tuple(x) for x in quality.overlaps(S.table(spark, "assignments")).collect()] == [("TMB", "a04", "a10")]
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 2)], "page int, row int")
    assert sorted((x["page"], x["row"]) for x in quality.gaps(rows, "page", "row").collect()) == [(1, 4), (2, 2)]
    assert quality.duplicates(spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int"), ["k"]).count() == 2
    flagged = spark.range(100).select((F.col("id") < 2).alias("excluded"))
    assert quality.drift(flagged, flagged).first()["ok"] and not quality.drift(flagged, flagged.limit(50)).first()["ok"]
    assert quality.same_columns(rows, {"page": "int", "row": "string"}) == ["row: int instead of string"]


def test_etl(spark):
    ok, bad = etl.export_filter(S.table(spark, "wmi_rows"), F.lit("2026-09-30").cast("date"))
    assert {x["wmi"]: x["reasons"] for x in bad.collect()}["O"] == ["INVALID_WMI", "NO_AVAILABILITY_DATE"]
    rows = etl.assignments(ok, *[S.table(spark, t) for t in ("dump_manufacturers", "vehicle_types", "wmi_makes", "makes")])
    assert sorted((x["wmi"], x["brand"]) for x in rows.collect() if x["wmi"] == "1HG") == [("1HG", "ALPHA MOTOR"), ("1HG", "BETA")]
    p = spark.createDataFrame([(300, "A*#"), (2, "[A]#")], "schema_id int, keys string")
    got = etl.compiled_patterns(p).collect()
    assert [(x["regex"], x["capture"], x["capture_length"], x["schema_bucket"]) for x in got] == [(r"\AA.[0-9]", 2, 1, 44)]
    layouts = spark.createDataFrame([("l", "XP7", {3: "Y"}, "B", "s")], "layout string, wmi string, required map<int,string>, plant string, source_id string")
    attributes = spark.createDataFrame([("l", 6, "EF", "BodyClass", "SUV")], "layout string, position int, characters string, code string, value string")
    years = spark.createDataFrame([("l", "T", 2026)], "layout string, code string, year int")
    rules, claims = etl.layout_rules(layouts, attributes, years)
    assert rules.first()["pattern"] == "XP7[Y]......B[0-9]{6}" and claims.count() == 3


def test_probes(spark):
    rows = [("a", "KNOWN", "Golf"), ("a", "KNOWN", " golf "), ("b", "KNOWN", "x"), ("b", "KNOWN", "y"), ("b", "UNKNOWN", None), ("c", "KNOWN", "x"), ("c", "UNKNOWN", None), ("d", "UNKNOWN", None), ("e", "KNOWN", None), ("f", "UNKNOWN", None), ("f", "AMBIGUOUS", None)]
    p = spark.createDataFrame(rows, "prefix string, status string, value string")
    consensus = coverage.probe_consensus(p, ["prefix"])
    got = {x["prefix"]: (x["status"], x["value"]) for x in consensus.collect()}
    assert got == {"a": ("KNOWN", "GOLF"), "b": ("PROBE_DISAGREEMENT", None), "c": ("PROBE_INCOMPLETE", None), "d": ("UNKNOWN", None), "e": ("PROBE_INCOMPLETE", None), "f": ("PROBE_INCOMPLETE", None)}
    labels = spark.createDataFrame([("a", 3, ["GOLF"], ["VW"]), ("g", 5, ["POLO"], ["VW"]), ("d", 2, ["X", "Y"], ["VW"])], "prefix string, weight long, labels array<string>, makes array<string>")
    one = coverage.summary(coverage.judged(consensus, labels, ["prefix"]).withColumn("all", F.lit(1)), ["all"], "weight").first()
    assert (one["total"], one["eligible"], one["known"], one["coverage"]) == (10, 3, 3, 1.0)  # neither conflicts nor unsupported prefixes are eligible


def test_aliases_count_for_their_make_alone(spark):
    consensus = spark.createDataFrame([("a", "KNOWN", "GOLF"), ("b", "KNOWN", "GOLF"), ("c", "UNKNOWN", None)], "prefix string, status string, value string")
    labels = spark.createDataFrame([("a", 1, ["GOLF VII"], ["VW"]), ("b", 1, ["GOLF VII"], ["VW", "SEAT"]), ("c", 1, ["GOLF VII"], ["VW"])], "prefix string, weight long, labels array<string>, makes array<string>")
    aliases = spark.createDataFrame([("vw", " Golf  vii", "golf"), ("vw", "golf vii", "GOLF")], "make string, observed string, decoded string")
    got = {x["prefix"]: (x["exact_match"], x["alias_match"]) for x in coverage.judged(consensus, labels, ["prefix"], aliases).collect()}
    assert got == {"a": (False, True), "b": (False, False), "c": (False, False)}


def test_targets_mind_case_as_told(spark):
    a = spark.createDataFrame([("1", {"make": "VW", "type": "Golf Sport"}), ("2", {"make": "VW", "type": "GOLF"}), ("3", {"make": "SEAT", "type": "Golf"})], "approval_id string, fields map<string,string>")
    t = spark.createDataFrame([("x", ["VW"], "golf", False, "SPORT"), ("y", ["VW"], "Golf", True, None), ("z", ["none"], ".", True, "")], "target string, makes array<string>, include string, case_sensitive boolean, exclude string")
    assert {x["target"]: (x["approvals"], x["covered"], x["examples"]) for x in coverage.target_coverage(a, t).collect()} == {"x": (1, True, ["2"]), "y": (1, True, ["1"]), "z": (0, False, [])}


def test_alternatives_without_fields_count_in_a_merge(spark):
    """A result says something as soon as it has alternatives: each candidate year and each literal rule is one."""
    r = spark.createDataFrame([(k, None if k != 4 else "US") for k in range(1, 6)], "req_id bigint, market string")
    results = spark.createDataFrame(
        [
            (1, "golf", "EUROPE", "DECODED", True), (1, "patterns", "US", "UNKNOWN", True),  # candidate years, no facts
            (2, "golf", "EUROPE", "DECODED", True), (2, "patterns", "US", "UNKNOWN", False),  # no candidate year
            (3, "patterns", "US", "UNKNOWN", False),
            (4, "b", "DE", "CONTEXT_CONFLICT", True), (4, "a2", "EUROPE", "DECODED", True), (4, "patterns", "US", "CONTEXT_CONFLICT", False), (4, "z", "CH", "CONTEXT_CONFLICT", True),
            (5, "golf", "EUROPE", "DECODED", True), (5, "patterns", "US", "NEEDS_CONTEXT", True),
        ],
        "req_id bigint, rule string, scope string, status string, has_alternatives boolean",
    )
    fields = spark.createDataFrame([(1, "golf", "Model", "AMBIGUOUS", ["a", "b"]), (2, "golf", "Model", "AMBIGUOUS", ["a", "b"]), (5, "golf", "Model", "KNOWN", ["a"]), (5, "patterns", "Model", "NEEDS_CONTEXT", ["c"])], "req_id bigint, rule string, code string, status string, possibilities array<string>")
    details, out = merge.merged(results, fields, r)
    assert {x["req_id"]: (x["status"], x["scope"]) for x in details.collect()} == {1: ("NEEDS_CONTEXT", "MULTIPLE"), 2: ("DECODED", "EUROPE"), 3: ("UNKNOWN", "US"), 4: ("CONTEXT_CONFLICT", "DE"), 5: ("DECODED", "MULTIPLE")}
    assert {x["req_id"]: (x["status"], x["value"]) for x in out.collect()} == {1: ("AMBIGUOUS", None), 2: ("AMBIGUOUS", None), 5: ("KNOWN", "a")}


@pytest.mark.parametrize("name", ["wmi_resolution", "pattern_top1", "merged_fields", "details_status", "coverage_weighted", "target_coverage", "public_schemas", "resolved_values", "directory_rules"])
def test_registered_queries_equal_their_sql(spark, name):
    import duckdb

    from motorlode.oracles import ORACLES
    from motorlode.queries import QUERIES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "part", "lineitem", "customer", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    want, got = con.execute(ORACLES[name]).df(), QUERIES[name](spark, d).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda x: sorted(map(tuple, x[sorted(x.columns)].astype(object).where(x[sorted(x.columns)].notna(), None).astype(str).values.tolist()))
    assert rows(want) == rows(got)
