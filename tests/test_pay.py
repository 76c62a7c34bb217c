"""The unit graph and the pay parser, on hand-worked cases."""

from decimal import Decimal

import pytest

from loamworks.functions.pay import parse_pay
from loamworks.operators import units


@pytest.mark.parametrize(
    "raw, description, market, expected",
    [
        ("$25.50 per hour", None, "AU", (25.5, 25.5, "AUD", "hourly")),
        ("$80k - $95k p.a. + 11.5% super", None, "AU", (80_000, 95_000, "AUD", "annual")),
        ("A$120 – 130K per year", None, "AU", (120_000, 130_000, "AUD", "annual")),
        ("Rp 6,8 jt sebulan", None, "ID", (6_800_000, 6_800_000, "IDR", "monthly")),
        ("Rp. 13.000.000 - 15.000.000 per bulan", None, "ID", (13_000_000, 15_000_000, "IDR", "monthly")),
        ("1 800 / 2 300 pcm", None, "NZ", (1_800, 2_300, "NZD", "monthly")),
        ("EUR 9.500", None, "SG", (9_500, 9_500, "EUR", "annual")),
        ("4 800 every two weeks", None, "AU", (4_800, 4_800, "AUD", "fortnightly")),
        ("30.75 dollars/h (38 hrs a week)", None, "AU", (30.75, 30.75, "AUD", "hourly")),
        ("270.00 SGD day rate, Grade 6", None, "AU", (270, 270, "SGD", "daily")),
        ("85 - 110", "Salary figures on this page are in thousands of dollars a year.", "AU", (85_000, 110_000, "AUD", "annual")),
        ("4,200", "Salary is stated by the month.", "SG", (4_200, 4_200, "SGD", "monthly")),
        ("88K pa", "All pay is quoted in US dollars.", "NZ", (88_000, 88_000, "USD", "annual")),
        ("from 6300 AUD", "In return we offer paid parking and a yearly boot allowance. The pay figure above is monthly.", "AU", (6_300, 6_300, "AUD", "monthly")),
        ("$90,000", "", None, (90_000, 90_000, "AUD", "annual")),
    ],
)
def test_amounts(raw, description, market, expected):
    assert parse_pay(raw, description, market) == expected


@pytest.mark.parametrize("raw", [None, "", "Competitive + 11% super", "Award rate, Level 3", "See 2025 pay guide", "10% bonus on offer", "DOE", "$$$", "38 hours a week"])
def test_no_amount(raw):
    assert parse_pay(raw, None, "AU") is None


def test_shortest_composition_and_offsets():
    edges = [("c", "k", 1, Decimal("273.15")), ("f", "c", Decimal(5) / 9, Decimal(-160) / 9), ("f", "k", Decimal(5) / 9, Decimal("273.15") - Decimal(160) / 9)]
    found = {u: (float(a), float(b), n) for u, t, a, b, n in units.shortest_conversions(edges, ["k"])}
    assert found["f"][2] == 1 and found["f"][0] == pytest.approx(5 / 9)
    assert found["c"] == (1.0, 273.15, 1)


def test_contradicting_cycle_is_refused():
    with pytest.raises(units.UnitCycleError):
        units.shortest_conversions([("a", "b", 2, 0), ("b", "c", 3, 0), ("a", "c", 7, 0)], ["c"])
    with pytest.raises(ValueError):
        units.shortest_conversions([("a", "b", 0, 0)], ["b"])


def test_convert_rounds_half_up_and_keeps_rows(spark):
    table = units.conversion_table(spark, [("x", "y", Decimal("0.5"), 0)], ["y"])
    rows = spark.createDataFrame([(1, "x", Decimal(1), "a"), (2, "x", Decimal(3), "b"), (3, "unknown", Decimal(3), "c"), (4, None, None, "d")], "id int, unit string, v decimal(14,3), scale string")
    out = {r.id: (r.w, r.scale) for r in units.convert(rows, table, "unit", "y", {"w": "v"}, 2).collect()}
    assert out == {1: (1, "a"), 2: (2, "b"), 3: (None, "c"), 4: (None, "d")}


def test_convert_empty(spark):
    table = units.conversion_table(spark, [("x", "y", 2, 0)], ["y"])
    assert units.convert(spark.createDataFrame([], "unit string, v decimal(14,3)"), table, "unit", "y", {"w": "v"}, 1).count() == 0
