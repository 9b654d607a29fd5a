import datetime

import pytest
from pyspark.sql import functions as F

from motorlode import policy
from motorlode.functions import etl
from motorlode.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int' if isinstance(v, int) else 'array<string>'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [(" 1hg ", "1HG"), ("\t1hg", "\t1HG"), ("ſß", "ſß"), ("", ""), (None, None)])
def test_normalized(spark, raw, want):
    assert one(spark, T.normalized(F.col("v")), v=raw) == want


@pytest.mark.parametrize("raw, want", [("1HGCM82603A000000", "MODERN_FORMAT"), ("1HGIAAAAAAAAAAAAA", "INVALID_CHARACTERS"), ("1HG", "UNSUPPORTED_LENGTH"), ("1HGCM82603A00000\n", "INVALID_CHARACTERS"), ("1HGCM82603A0000😀", "INVALID_CHARACTERS"), ("", "UNSUPPORTED_LENGTH")])
def test_structure_counts_utf16_units(spark, raw, want):
    assert one(spark, T.structure(F.col("v")), v=raw) == want


@pytest.mark.parametrize("h, t, want", [("0005", "AMQ", "VALID"), ("5", "AMQ", "INVALID_HSN"), ("0005\n", "AMQ", "INVALID_HSN"), ("0005", "A", "INVALID_TSN"), ("", "", "INVALID_HSN_AND_TSN")])
def test_type_code_status(spark, h, t, want):
    assert one(spark, T.type_code_status(F.col("h"), F.col("t")), h=h, t=t) == want


def test_years(spark):
    c = T.year_candidates(F.col("v"), F.col("y").cast("int"), F.col("k"), F.col("t"))
    vin = "5UPAA2420AA000001"
    assert one(spark, c, v=vin, y=None, k=6, t="") == [1980, 2010]
    assert one(spark, c, v=vin, y=2010, k=6, t="") == [2010]
    assert one(spark, c, v=vin, y=2011, k=6, t="") == []
    assert one(spark, c, v=vin, y=None, k=2, t="") == [1980]  # position 7 is a digit
    assert one(spark, c, v="5UPAA2420UA000001", y=None, k=6, t="") == []  # no year code


@pytest.mark.parametrize("v, op, f, want", [("183", "*", "0.016387064", "2.998833"), ("10", "/", "4", "2.5"), ("x", "*", "2", None), ("NaN", "*", "2", None), ("100", "*", "1", "100"), ("0", "*", "5", "0"), (None, "*", "2", None), ("1000000000000", "*", "61.023744095", "61023744095000"), ("0.0000005", "*", "1", "0.000001"), ("9" * 30, "*", "2", None), ("1", "/", "0", None)])
def test_conversion_rounds_half_up_without_trailing_zeros(spark, v, op, f, want):
    assert one(spark, T.converted(F.col("v"), F.col("op"), F.col("f")), v=v, op=op, f=f) == want


def test_templates_reject_a_row_with_one_bad_alternative(spark):
    assert one(spark, T.templates(F.col("v")), v="TMB...5E.........") == ["TMB...5E........."]
    assert one(spark, T.templates(F.col("v")), v="TMB..............") is None
    assert one(spark, T.templates(F.col("v")), v="TMBA5E........... / T.BB5E...........") is None
    assert one(spark, T.templates(F.col("v")), v="TMBB5E........... / TMBA5E...........") == ["TMBA5E...........", "TMBB5E..........."]


def test_small_texts(spark):
    assert one(spark, T.identity_key(F.col("v")), v=" vw ag ") == "VW AG"
    assert one(spark, T.identity_key(F.col("v")), v=None) == ""
    assert one(spark, T.text_cell(F.col("v")), v="  a \t b ") == "a b"
    assert one(spark, T.text_cell(F.col("v")), v="  ") is None
    assert one(spark, T.directory_identifier(F.col("a"), F.col("b")), a="1H9", b="333") == "1H9333"
    assert one(spark, T.directory_identifier(F.col("a"), F.col("b")), a="1H9", b=None) is None
    assert one(spark, T.directory_identifier(F.col("a"), F.col("b")), a="1HG", b="333") is None
    assert one(spark, T.directory_pattern(F.col("v")), v="1H9333") == "1H9.{8}333.{3}"
    assert one(spark, T.row_locator(F.col("p"), F.col("r")), p=3, r=12) == "sv31-p003-r012"
    assert one(spark, T.source_date(F.col("v")), v="02.01.2026") == datetime.date(2026, 1, 2)
    assert one(spark, T.source_date(F.col("v")), v="soon") is None
    assert one(spark, T.safe_year(F.col("v")), v="2005") == 2005
    assert one(spark, T.safe_year(F.col("v")), v="2005.0") is None
    assert one(spark, T.urls(F.col("v")), v="see https://a.b/c. and http://d/e, ok") == ["https://a.b/c", "http://d/e"]
    assert one(spark, T.filled(policy.FALLBACK_MESSAGE, F.lit("US"), F.col("v")), v=None).endswith("an unspecified market is unverified.")
    assert one(spark, T.decoded_cell(T.encoded_cell(F.col("v"))), v="tab\tü") == "tab\tü"
    assert one(spark, T.context_problem(F.col("y"), F.col("m")), y=1800, m="US") == "INVALID_YEAR"
    assert one(spark, T.context_problem(F.col("y"), F.col("m")), y=2000, m="us") == "INVALID_MARKET"


@pytest.mark.parametrize("key, want", [("**##", r"\A..[0-9][0-9]"), ("A_%", r"\AA..*"), ("[A-C]*", r"\A[A-C]."), ("[1-A]", r"\A[1A]"), ("[*]_", r"\A[.]_"), ("[A]#", None), ("A|B", r"\AA\|B"), ("", r"\A"), ("[A.]", r"\A[A\.]"), ("#*%", r"\A[0-9]..*")])
def test_wildcards(key, want):
    assert etl.wildcard_to_regex(key) == want


def test_wildcards_reject():
    for bad in ("[A", "a b", "é", "A-B", "[A]-", "[A]%", "[é]", "a[b][", "a]b"):
        with pytest.raises(ValueError):
            etl.wildcard_to_regex(bad)
    assert etl.capture_of("**##*#") == (2, 4)


def test_copy_cells():
    assert etl.unescape_copy(r"\N") is None
    assert etl.unescape_copy(r"a\tb\\c\303\251\x41") == "a\tb\\cé" + "A"
    assert etl.unescape_copy("") == ""
    assert etl.unescape_copy(r"\8\x\é\1011") == "8xéA1" and etl.unescape_copy("\\") == "\\"


def test_ids_and_json():
    assert etl.canonical_id({"b": None, "a": "é"}) == etl.canonical_id({"a": "é", "b": None})
    assert etl.slug("Ä b") == "~c3~84~20b"
    assert etl.strict_json('{"a": 1}') == {"a": 1}
    with pytest.raises(ValueError):
        etl.strict_json('{"a": 1, "a": 2}')
    assert etl.slug("AZaz09_é") == "azaz09~5f~c3~a9"
    assert all(map(etl.bounded_grammar, ("WVW[A-C]{3}.", ".{11}000000", "A{1}", "[A-Z]{10}")))
    assert not any(map(etl.bounded_grammar, ("A+", "I", "WVO", "[AQ]", "{3}", "A{1}{2}", "A{123}", "A{}", "", "[]", "a")))
    with pytest.raises(ValueError):
        etl.literal_prefixes("A|B")


def test_literal_prefixes():
    assert etl.literal_prefixes("WVWZZZ") == ["WVW"]
    assert sorted(etl.literal_prefixes("A[BC]D.{4}")) == ["ABD", "ACD"]
    assert len(etl.literal_prefixes(".{17}")) == 33**2  # three characters would be too many
    assert len(etl.literal_prefixes("A[0-9]{16}")) == 100


def test_settings_survive_flattening():
    nested = {"a": {"b": [1, {"c": True}]}, "d": "x"}
    rows = policy.flatten(nested)
    assert policy.unflatten(rows) == {"a.b.length": 2, "a.b.0": 1, "a.b.1.c": True, "d": "x"}
