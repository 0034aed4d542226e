"""Energy answers of every kind: typed fields, periods of every precision, default ranges, and lines that do not fit."""

import json

import pytest

from zephyrgrid.sources import kinds


@pytest.fixture
def parsed(spark):
    rows = [
        ("D", {"respondent": "FPL", "period": "2024-05-01T07", "value": "12.5", "more": [1]}), ("D", {"respondent": "FPL", "period": "2024-05-02", "value": 3}),
        ("TI", {"respondent": "FPL", "period": "2024-05-02T00", "fromba": "FPL", "toba": "SOCO", "value": -7}),
        ("NG", {"respondent": "FPL", "period": "2024-05-02T00", "fueltype": "SUN", "value": 1.25}),
        ("retail", {"stateid": "FL", "period": "2024-05", "price": "10.1", "revenue": 5, "sales": "x"}),
        ("capacity", {"stateid": "FL", "plantprimaryFuel": "gas", "capacity": 900}),
        ("LMP", {"respondent": "FPL", "period": "2024-05-02 03:15:00", "value": None}), ("D", {"period": "2024-05-02", "value": 1}),
        ("D", {"respondent": "FPL", "period": "yesterday", "value": 1}), ("what", {"respondent": "FPL"}), (None, {"respondent": "FPL"}),
    ]
    lines = [(k, json.dumps(v)) for k, v in rows] + [("D", "{not json"), ("D", None), ("D", "[1, 2]")]
    return kinds.parse(spark.createDataFrame(lines, "kind string, payload string"))


def test_every_kind_has_its_fields(parsed):
    good = sorted((r["kind"], r["respondent"], str(r["period"]), r["item"], r["value"]) for r in kinds.series(parsed).collect())
    assert good == [
        ("D", "FPL", "2024-05-01 07:00:00", "", 12.5), ("D", "FPL", "2024-05-02 00:00:00", "", 3.0), ("NG", "FPL", "2024-05-02 00:00:00", "SUN", 1.25),
        ("TI", "FPL", "2024-05-02 00:00:00", "FPL>SOCO", -7.0), ("capacity", "FL", "None", "gas", 900.0),
        ("retail", "FL", "2024-05-01 00:00:00", "price", 10.1), ("retail", "FL", "2024-05-01 00:00:00", "revenue", 5.0)]


def test_what_does_not_fit_is_counted(parsed):
    bad = {(r["kind"], r["problem"]): r["n"] for r in kinds.report(parsed).collect() if r["problem"]}
    assert bad == {("retail", "no value"): 1, ("LMP", "no value"): 1, ("D", "no respondent"): 2, ("D", "no period"): 1, ("what", "unknown kind"): 1,
                   (None, "unknown kind"): 1, ("D", "broken payload"): 2}


def test_ranges(parsed):
    recent = kinds.series(parsed, now="2024-05-02 12:00:00").collect()
    # A day back for loads; retail prices and capacities have no default range.
    assert sorted((r["kind"], str(r["period"])) for r in recent if r["kind"] in ("D", "capacity")) == [("D", "2024-05-02 00:00:00"), ("capacity", "None")]
    some = kinds.series(parsed, ["D", "NG"], ["FPL"], "2024-05-01 00:00:00", "2024-05-01 23:00:00").collect()
    assert [(r["kind"], r["value"]) for r in some] == [("D", 12.5)]
