import json

import pytest

from motorlode import __main__ as cli
from motorlode import api


def test_one_identifier_from_the_command_line(spark, capsys):
    assert cli.main(["vin", "wvwzzz1kz5p000001", "--market", "DE", "--long"], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert (found["vehicle"]["make"], found["vehicle"]["model"], found["inputStatus"]) == ("Volkswagen", "Golf", "SUPPORTED_FORMAT") and "decisions" in found["details"]
    assert cli.main(["vin", "WVWZZZ1KZ5P000001", "--market", "de"], spark) == 2 and "INVALID_MARKET" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.main(["vin"], spark)


def test_type_codes_from_the_command_line(spark, capsys):
    assert cli.main(["codes", "0005", "amq"], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert (found["hsn"], found["tsn"], found["vehicle"]["make"], found["vehicle"]["model"], found["fieldStatus"]["modelYear"]) == ("0005", "AMQ", "Alpha", "Alpha", "UNKNOWN")
    assert cli.main(["codes", "5", "amq"], spark) == 2


def test_requests_in_bulk(spark):
    r = spark.createDataFrame([(1, "1HGAAAAAAAAAAAAAA", None, None), (2, "WVW", None, "DE"), (3, "1HG", 1500, None)], api.REQUEST)
    good, bad = api.valid_context(r)
    assert [x["problem"] for x in bad.collect()] == ["INVALID_YEAR"] and good.count() == 2
    assert {x["req_id"]: x["status"] for x in api.lookup(spark, good).collect()} == {1: "RECOGNIZED", 2: "UNSUPPORTED_FORMAT"}
