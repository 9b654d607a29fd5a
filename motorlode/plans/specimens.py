"""Synthetic requests and rule tables, rendered for Spark and for SQL text from one definition.

The identifiers are generated from order keys and stand for no vehicle; rules, makes and numbers are
invented but for the two makers' documented layouts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlode.functions.etl import capture_of, wildcard_to_regex

KEYS = ("1HG", "WVW", "5UP", "TMB", "1C4", "1H9", "1HG", "XP7", "ZZZ", "1HG")
HEX, UPPER = "0123456789abcdef", "ABCDEFGHJKLMNPRSTUVWXYZ"


def _digest(start: int, n: int, to: str) -> str:
    """n characters, the hex digits of the key's digest from `start` on, each mapped to one of `to`."""
    return f"translate(substr(md5(cast(o_orderkey as {{text}})), {start}, {n}), '{HEX}', '{to}')"


def _supplied() -> str:
    key = "case o_orderkey % 10 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KEYS)) + " end"
    body = " || ".join([key, _digest(1, 2, "ABAABBACABABABBC"), _digest(3, 1, "1212121212121212"), _digest(4, 2, "ABABA5ABABABAB5A"), "'X'", _digest(7, 1, "ABCDEFGHJKLMNP56"), _digest(8, 1, "PAWPAWPAWPAWPAWP"), "'33'", _digest(9, 1, "3333333333333334"), _digest(10, 3, "0123456789ABCDEF")])
    serial = "lpad(cast(o_custkey % 1000000 as {text}), 6, '0')"
    kind = "(o_orderkey {div} 4) % 16"
    vin = f"case {kind} when 0 then 'WVWZZZ1KZ5P' || {serial} when 1 then 'XP7YGAEK0TB' || {serial} when 5 then 'WVWZZZ1KZ5W' || {serial} else {body} end"
    # a sixth of them padded and in lower case, with letters outside the alphabet, or too short
    changed = f"translate({vin}, case {kind} when 2 then '{UPPER}' when 3 then '3' else '_' end, case {kind} when 2 then '{UPPER.lower()}' when 3 then 'I' else '_' end)"
    return f"case when {kind} = 2 then '  ' else '' end || substr({changed}, 1, case when {kind} = 4 then 16 else 17 end) || case when {kind} = 2 then ' ' else '' end"


_YEAR = "cast(case o_orderkey % 7 when 1 then 2005 when 2 then 2010 when 3 then 1980 + o_custkey % 48 end as int)"
_MARKET = "case (o_orderkey {div} 7) % 5 when 0 then 'US' when 1 then 'DE' when 2 then 'CH' end"
_SPARK, _DUCK = {"div": "div", "text": "string"}, {"div": "//", "text": "varchar"}

REQUESTS_SQL = f"SELECT o_orderkey AS req_id, {_supplied().format(**_DUCK)} AS supplied, {_YEAR} AS model_year, {_MARKET.format(**_DUCK)} AS market FROM orders"

_HSN = "case p_partkey % 9 when 0 then '5' when 1 then ' 0005 ' when 2 then '00a5' else lpad(cast(p_partkey % 12 as {text}), 4, '0') end"
_TSN = "case p_partkey % 7 when 0 then 'amq' when 1 then 'AB' when 2 then ' AAB ' else 'AM' || substr('QRS', cast(1 + p_partkey % 3 as int), 1) end"
CODES_SQL = f"SELECT p_partkey AS req_id, {_HSN.format(**_DUCK)} AS hsn, {_TSN.format(**_DUCK)} AS tsn FROM part"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("req_id"), F.expr(_supplied().format(**_SPARK)).alias("supplied"), F.expr(_YEAR).alias("model_year"), F.expr(_MARKET.format(**_SPARK)).alias("market"))


def code_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("req_id"), F.expr(_HSN.format(**_SPARK)).alias("hsn"), F.expr(_TSN.format(**_SPARK)).alias("tsn"))


def _patterns():
    rows = [
        # schema, pattern, element, keys, attribute, value, changed
        (101, 1, 28, "A*1*A", "1861", "Alpha", "2015-01-02"), (101, 2, 28, "AA1**", "1862", "Beta", "2015-01-02"), (101, 3, 28, "*****", "1861", "Alpha", None),
        (101, 4, 18, "*[AB]*", "J30", "J30", "2014-05-05"), (101, 5, 13, "**#", "", "", "2014-05-05"), (102, 6, 28, "B****", "1862", "Beta", "2016-01-01"),
        (102, 7, 11, "**2*", "2997.7", "2997.7", None), (102, 8, 5, "*A*5*|*P", "9", "Coupe", ""), (102, 9, 5, "*A***|*[AP]", "8", "Sedan", "2013-01-01"),
        (103, 10, 28, "[A-C]****", "77", "Hauler", "2012-02-02"), (103, 11, 121, "A", "x1", "Rack", None), (103, 12, 121, "*A", "x2", "Winch", None),
        (104, 13, 28, "C", "900", "Gamma", None), (104, 14, 11, "C*1", "unknown", "unknown", None), (105, 15, 28, "*****|**333", "55", "Box", None),
        (106, 16, 26, "*", "m2", "VOLKSWAGEN", None), (106, 17, 28, "AB", "60", "Polo", None), (106, 18, 18, "A***A", "ea211 ", "EA211", "2010-01-01"),
        (106, 19, 18, "A****", "EA888", "EA888", "2010-01-01"), (107, 20, 28, "*****|*W", "70", "Octavia", None),
    ]
    return [(*r, wildcard_to_regex(r[3]), *capture_of(r[3]), r[0] % 256) for r in rows]


# name: (columns with Spark types, rows)
TABLES: dict[str, tuple[str, list[tuple]]] = {
    "manufacturers": ("id string, name string, country string", [("m1", "ALPHA MOTOR", "US"), ("m2", "VOLKSWAGEN AG", "DE"), ("m3", "TESLA", None), ("m4", "SKODA AUTO", "CZ"), ("m5", "DELTA GROUP", "US"), ("m6", "TRAILER WORKS", "US"), ("m7", "UPSILON", None)]),
    "assignments": (
        "id string, wmi string, manufacturer_id string, brand string, category string, markets array<string>, from_year int, to_year int, ambiguity_group string",
        [
            ("a01", "1HG", "m1", "ALPHA", "PASSENGER_CAR", [], None, None, None), ("a02", "WVW", "m2", "VOLKSWAGEN", "PASSENGER_CAR", ["DE", "CH"], None, None, None),
            ("a03", "XP7", "m3", "TESLA", "PASSENGER_CAR", [], 2021, None, None), ("a04", "TMB", "m4", "SKODA", "PASSENGER_CAR", [], None, None, None),
            ("a05", "1C4", "m5", "DELTA", "MPV", [], None, None, "g1"), ("a06", "1C4", "m5", "DELTA TRUCKS", "MPV", [], None, None, "g1"), ("a07", "1C4", "m5", None, "MPV", ["US"], None, None, "g1"),
            ("a08", "1H9333", "m6", "TRAILEX", "TRAILER", [], None, None, None), ("a09", "5UP", "m7", None, "TRUCK", [], None, None, None), ("a10", "TMB", "m4", "SKODA", "PASSENGER_CAR", ["AT", "DE"], 2000, 2009, None),
        ],
    ),
    "types": (
        "hsn string, tsn string, manufacturer string, trade_name string, registered_count bigint, source_object_id bigint",
        [("0005", "AMQ", "ALPHA", "Alpha", 12, 1), ("0005", "AMR", "ALPHA", "Beta", None, 2), ("0003", "AMQ", "VOLKSWAGEN AG", "Golf", 7, 3), ("0004", "AMR", "SKODA", "Octavia", 9, 4), ("0004", "AMR", "SKODA", "Octavia II", 9, 5), ("0007", "AMS", "NOBODY", None, 1, 6), ("0008", "AMS", "ALPHA", "Unlisted", 2, 7)],
    ),
    "elements": ("element_id int, code string, label string", [(26, "Make", "Make"), (28, "Model", "Model"), (29, "ModelYear", "Model Year"), (18, "EngineModel", "Engine Model"), (13, "DisplacementL", "Displacement (L)"), (11, "DisplacementCC", "Displacement (CC)"), (12, "DisplacementCI", "Displacement (CI)"), (5, "BodyClass", "Body Class"), (121, "Equipment", "Equipment"), (24, "FuelType", "Fuel Type"), (75, "PlantCountry", "Plant Country"), (10001, "ProductionYear", "Production Year"), (20001, "PlantCity", "Plant City"), (20002, "Series", "Series")]),
    "rich_wmis": ("wmi string, vehicle_type int, truck_type string", [("1HG", 2, None), ("WVW", 2, None), ("5UP", 6, None), ("1C4", 7, None), ("1H9333", 10, None), ("XP7", 2, None), ("TMB", 3, "1")]),
    "schemas": ("wmi string, schema_id int, year_from int, year_to int", [("1HG", 101, 1980, 2009), ("1HG", 102, 2003, None), ("5UP", 103, 2010, None), ("1C4", 104, 1980, 2040), ("1H9333", 105, 1980, None), ("WVW", 106, 1980, 2030), ("TMB", 107, 1995, 2020)]),
    "patterns": ("schema_id int, pattern_id int, element_id int, keys string, attribute_id string, value string, changed string, regex string, capture int, capture_length int, schema_bucket int", _patterns()),
    "engines": ("engine_key string, id int, element_id int, attribute_id string, value string, changed string", [("j30", 1, 24, "4", "Gasoline", None), ("j30", 2, 11, "2997.5", "2997.5", "2014-01-01"), ("ea211", 3, 24, "4", "Gasoline", None), ("ea888", 4, 24, "5", "Hybrid", None)]),
    "models": ("model_id string, make_id string, make_name string", [("1861", "474", "ALPHA"), ("1862", "474", "ALPHA"), ("900", "480", "DELTA"), ("60", "482", "VOLKSWAGEN")]),
    "conversions": ("id string, from_element int, to_element int, operator string, factor decimal(18,12)", [("1", 11, 12, "*", "0.061023744095"), ("2", 11, 13, "*", "0.001000000000"), ("3", 12, 13, "*", "0.016387064000")]),
    "rules": (
        "id string, pattern string, exclude string, scope string, markets array<string>, model_year int, stage string, warning string, conflict_warning string",
        [("golf-mosel", "WVWZZZ1KZ5P[0-9]{6}", None, "EUROPE", ["DE", "AT", "CH"], 2005, "golf-layout", "Plant by serial layout.", "Year differs."), ("golf-wolfsburg", "WVWZZZ1KZ5W[0-9]{6}", None, "EUROPE", ["DE", "AT", "CH"], 2005, "golf-layout", "Plant by serial layout.", "Year differs."), ("model-y", "XP7Y[A-Z]{3}.{2}TB[0-9]{5}.", ".{11}000000", "EUROPE", [], None, "model-y-layout", "Production year is a calendar year.", "c"), ("dir-tmb", "TMB.{14}", None, "DE", [], None, "directory", "", "c"), ("dir-1h9", "1H9.{8}333.{3}", None, "DE", [], None, "directory", "", "c"), ("old-tmb", "TMBA.{13}", ".{9}[1-9].{7}", "EUROPE", ["CH"], 1999, "old-layout", "Older layout.", "Only 1999.")],
    ),
    "rule_claims": (
        "rule_id string, position int, characters string, code string, value string, source_id string, kind string, claim_rule_id string, keys string",
        [
            *[(f"golf-{p}", -1, "", c, v, "vw", "OEM_RULE", f"golf-{p}", "") for p, city in (("mosel", "MOSEL"), ("wolfsburg", "WOLFSBURG")) for c, v in (("Make", "VOLKSWAGEN"), ("Model", "Golf"), ("ModelYear", "2005"), ("Series", "V (Typ 1K)"), ("PlantCity", city))],
            ("model-y", -1, "", "Make", "TESLA", "tesla", "OEM_RULE", "model-y", ""), ("model-y", 3, "Y", "Model", "Model Y", "tesla", "OEM_RULE", "model-y", "Y"), ("model-y", 9, "T", "ProductionYear", "2026", "tesla", "OEM_RULE", "model-y", "T"), ("model-y", 9, "S", "ProductionYear", "2025", "tesla", "OEM_RULE", "model-y", "S"), ("model-y", 10, "B", "PlantCity", "BERLIN", "tesla", "OEM_RULE", "model-y", "B"),
            ("dir-tmb", -1, "", "Make", "SKODA", "kba", "MANUFACTURER_DIRECTORY", "r1", ""), ("dir-1h9", -1, "", "Make", "TRAILEX", "kba", "MANUFACTURER_DIRECTORY", "r2", ""), ("old-tmb", -1, "", "Make", "SKODA", "kba", "OEM_RULE", "old", ""), ("old-tmb", 4, "A", "Model", "Felicia", "kba", "OEM_RULE", "old", "A"), ("old-tmb", 4, "AB", "Model", "Favorit", "kba", "OEM_RULE", "old", "AB"),
        ],
    ),
    "approvals": (
        "wmi string, approval_id string, source_row int, masks array<string>, fields map<string,string>",
        [
            ("TMB", "t1", 1, ["TMBA............."], {"make": "SKODA", "type": "5E", "remarks": "x"}), ("TMB", "t2", 2, ["TMBA.1...........", "TMB.A............"], {"make": "Skoda", "type": "Octavia", "fuel": ""}),
            ("TMB", "t3", 3, ["TMBB............."], {"make": "SKODA", "type": "Octavia", "fuel": "petrol"}), ("WVW", "t4", 4, ["WVWZZZ1K........."], {"make": "VW", "type": "Golf"}), ("5UP", "t5", 5, ["5UPA............."], {"make": "ALPHA", "type": "Beta"}), ("1HG", "t6", 6, ["1HGA.1..........."], {"make": "UNMAPPED", "type": "?"}),
        ],
    ),
    "make_aliases": ("alias string, make_id string, name string, source_id string", [("ALPHA", "mk1", "Alpha", "id"), ("VOLKSWAGEN", "mk2", "Volkswagen", "id"), ("VOLKSWAGEN AG", "mk2", "Volkswagen", "id"), ("VW", "mk2", "Volkswagen", "id"), ("TESLA", "mk3", "Tesla", "id"), ("SKODA", "mk4", "Skoda", "id"), ("DELTA", "mk5", "Delta", "id"), ("TRAILEX", "mk6", "Trailex", "id")]),
    "model_aliases": ("make_id string, alias string, model_id string, name string, source_id string", [("mk1", "ALPHA", "md1", "Alpha", "id"), ("mk1", "BETA", "md2", "Beta", "id"), ("mk2", "GOLF", "md3", "Golf", "id"), ("mk3", "MODEL Y", "md4", "Model Y", "id"), ("mk4", "OCTAVIA", "md5", "Octavia", "id"), ("mk5", "GAMMA", "md6", "Gamma", "id"), ("mk2", "POLO", "md7", "Polo", "id")]),
    "sources": ("id string, publisher string, title string, url string, edition string, terms_url string, license_url string, reuse_url string", [("vw", "Maker", "Layout", "https://example.org/vw", "2009", None, "https://example.org/l", None), ("tesla", "Maker", "Layout", "https://example.org/t", None, "https://example.org/terms", None, None), ("kba", "Office", "Directory", "https://example.org/k", "3.1", None, None, "https://example.org/r"), ("patterns", "Agency", "Patterns", "https://example.org/p", "2026-09", None, None, None)]),
    "accepted_aliases": ("make string, observed string, decoded string", [("Make 2", "Golf VII", "golf"), ("make 1", "GOLF", "GOLF")]),
    "targets": (
        "target string, makes array<string>, include string, case_sensitive boolean, exclude string",
        [("t1", ["Brand#11", "Brand#23"], "A", False, "RED|blue"), ("t2", ["Brand#11"], "A", True, None), ("t3", ["Brand#34", "Brand#55", "Brand#12"], "e.*e", True, ""), ("t4", ["none"], ".", False, None)],
    ),
    "masks": ("row int, category string, template string", [(1, "M1", "TMB...5E........."), (2, "M1", "TMB.............."), (3, "M1G", "TMBA5E........... / TMBB5E..........."), (4, "M1", "TMBA5E........... / T.BB5E..........."), (5, "N1", "WVWZZZ1K........."), (6, None, "WVWZZZ1K........."), (7, "M1", "WVWZZZ1K"), (8, "M1", " WVWZZZ1K......... / WVWZZZ1K.........")]),
    "wmi_rows": ("wmi_id int, wmi string, available string, manufacturer_id int, type_id int", [(1, "1HG", "2015-03-02 00:00:00", 1, 2), (2, "WVW", "2014-01-01", 2, 2), (3, "1IO", "2014-01-01", 2, 2), (4, "XP7", None, 3, 2), (5, "ZZ1", "2999-01-01", 3, 2), (6, "1H9333", "2016-06-06", 4, 9), (7, "O", None, 4, 9)]),
    "wmi_makes": ("wmi_id int, make_id int", [(1, 10), (1, 11), (2, 12), (4, 13)]),
    "makes": ("make_id int, make_name string", [(10, " alpha  motor "), (11, "Beta"), (12, "Volkswagen"), (13, "Tesla")]),
    "dump_manufacturers": ("manufacturer_id int, manufacturer_name string", [(1, "ALPHA MOTOR"), (2, "VOLKSWAGEN AG"), (3, "TESLA"), (4, "TRAILER WORKS")]),
    "vehicle_types": ("type_id int, type_name string", [(2, "Passenger Car"), (9, "Trailer")]),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    from decimal import Decimal

    schema, rows = TABLES[name]
    if name == "conversions":
        rows = [(*r[:-1], Decimal(r[-1])) for r in rows]
    return spark.createDataFrame(rows, schema)


def _literal(value, kind: str) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, list):
        return "[" + ", ".join(_literal(x, "") for x in value) + "]"
    if isinstance(value, dict):
        return "MAP {" + ", ".join(f"{_literal(k, '')}: {_literal(v, '')}" for k, v in value.items()) + "}"
    return str(value) if isinstance(value, int) or kind.startswith("decimal") else "'" + str(value).replace("'", "''") + "'"


def values_sql(name: str) -> str:
    """A table as a SELECT from VALUES, typed."""
    schema, rows = TABLES[name]
    import re

    columns = [c.split(" ", 1) for c in re.split(r", (?=\w+ )", schema)]
    kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "array<string>": "VARCHAR[]", "map<string,string>": "MAP(VARCHAR, VARCHAR)", "boolean": "BOOLEAN"}
    names = ", ".join(f"CAST(c{i} AS {kinds.get(k, k.upper())}) AS {n}" for i, (n, k) in enumerate(columns))
    body = ", ".join("(" + ", ".join(_literal(v, k) for v, (_, k) in zip(r, columns)) + ")" for r in rows)
    return f"SELECT {names} FROM (VALUES {body}) t({', '.join(f'c{i}' for i in range(len(columns)))})"
