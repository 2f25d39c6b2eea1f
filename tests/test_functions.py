"""Expressions on single values."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import attributes as A
from ledgerloom.functions import entities as E
from ledgerloom.functions import periods as P
from ledgerloom.functions import text as X
from ledgerloom.functions import units as U
from ledgerloom.functions.similarity import common_subsequence, token_set_ratio


@pytest.fixture(scope="module")
def of(spark):
    def run(f, values):
        rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
        return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]

    return run


def test_values(of):
    got = of(U.parse_value, ["₹8,142 Cr", "₹5 lakh", "₹2 crore", "$3 billion", "(404)", "n/a", "", None, "3.5 per cent", "12 K", "6.5% crore"])
    assert [None if v is None else v["normalized_value"] for v in got] == [8.142e10, 5e5, 2e7, 3e9, -404.0, None, None, None, 3.5, 12_000.0, 6.5]
    assert [v["normalized_unit"] for v in got if v] == ["INR", "INR", "INR", "USD", "count", "percent", "count", "percent"]
    assert got[-1]["scale_word"] == "crore"


def test_long_plain_numbers_are_cut(of):
    assert [v["value"] for v in of(U.parse_value, ["2024", "81415.38", "81,415.38"])] == [202.0, 814.0, 81415.38]


@pytest.mark.parametrize(
    ("a", "b", "equal", "note"),
    [
        ("₹8,142 Cr", "₹81,415.38 million", True, "rounding"), ("₹81,415 million", "₹81,415.38 million", True, "rounding"), ("3.5 percent", "3.5 per cent", True, "rounding"),
        ("6.4 per cent", "6.5 per cent", False, "differ by"), ("8,142 Cr", "8,300 Cr", False, "differ by"), ("6.5 percent", "₹6.5 crore", False, "unit"), ("₹100.00 million", "₹100.40 million", True, "relative"),
    ],
)
def test_equivalence(spark, a, b, equal, note):
    rows = spark.createDataFrame([(a, b)], "a string, b string").select(U.parse_value(F.col("a")).alias("a"), U.parse_value(F.col("b")).alias("b"))
    got = rows.select(U.equivalent(F.col("a"), F.col("b")).alias("e"), U.equivalence_note(F.col("a"), F.col("b")).alias("n")).first()
    assert got["e"] is equal and note in got["n"]


def test_short_numbers(of):
    assert of(lambda c: U._short(c.cast("double")), ["0", "0.1", "12", "1234", "4620000", "0.00001234"]) == ["0", "0.1", "12", "1234", "4.62e+06", "1.234e-05"]


PERIODS = {
    "FY24": "FY2024", "FY2024": "FY2024", "Fiscal 2024": "FY2024", "2024-25": "FY2025", "FY2024/25": "FY2025", "FY25": "FY2025", "Q4 FY24": "Q4-FY2024", "1999-00": "FY2000",
    "year ended March 31, 2024": "FY2024", "as of December 31, 2021": "as_of:2021-12-31", "nine months ended December 31, 2021": "range:2021-12-31", "31 March 2024": "FY2024",
    "March 31, 2024": "FY2024", "5 June 2020": "as_of:2020-06-05", "in 2019": "CY2019", "no period here": "unknown", "": "unknown", "as of February 31, 2024": "CY2024", "10-12": "FY2012", "FY98": "FY2098",
}


def test_periods(of):
    assert dict(zip(PERIODS, of(lambda c: P.period_key(P.parse_period(c)), list(PERIODS)), strict=True)) == PERIODS
    assert of(lambda c: P.parse_period(c)["kind"], [None]) == ["unknown"]


def test_entities(of):
    assert of(E.normalize_entity, ["Acmery Limited", "Acmery", "The A & B Co. Ltd.", "", None]) == ["acmery", "acmery", "a b", "", ""]
    assert of(E.display_entity, ["Acmery Limited", "Foo Group Inc.", "Limited"]) == ["Acmery", "Foo", "Limited"]
    assert of(lambda c: E.resolve_entity(c, F.lit("Acme Ltd")), ["the Company", "", None, "Other Corp"]) == ["Acme", "Acme", "Acme", "Other"]
    assert of(E.sentence_entity, ["India's growth", "Real GDP grew", "we grew"]) == ["India", "Real GDP", None]


def test_families(of):
    phrases = {"Revenue from operations": "revenue", "Revenues from services": "revenue", "Revenue from Express Parcel services": "revenue from express parcel services", "real GDP growth": "gdp growth",
               "nominal GDP growth": "nominal gdp growth", "GDP": "gdp", "Consolidated revenue from operations": "revenue", "the overall mood": "mood", "Total income": "total income"}
    assert dict(zip(phrases, of(A.family, list(phrases)), strict=True)) == phrases
    assert of(A.family_kind, ["revenue", "team size", "gdp growth", "mood"]) == ["monetary", "count", "percent", "unknown"]
    assert of(A.is_junk, ["total of the", "net worth", ""]) == [True, False, True]


def test_text(of):
    assert of(X.status, ["is estimated to grow", "stood at 3", "the be word", "plain", None]) == ["estimate", "actual", "budget", None, None]
    assert of(X.scope, ["standalone and consolidated", "Stand-alone", "x"]) == ["consolidated", "standalone", None]
    assert of(X.printed_page, ["a\nPage 3 of 9", "12\nfoo\nbar", "x", None]) == ["3", "12", None, None]
    assert of(X.is_scanned, ["   short  ", "long enough to be read", None]) == [True, False, True]
    assert of(X.sentences, ["One is 6.4. Two;  Three\nwrapped Rs. Five.\n\nNext."]) == [["One is 6.4.", "Two;", "Three wrapped Rs.", "Five.", "Next."]]
    assert of(X.is_numeric_cell, ["81,415.38", "(348.01)", "12.7%", "220+", "(1)", "n/a", "₹ 5"]) == [True, True, True, True, False, False, True]
    assert of(U.page_scale, ["Amounts are in ₹ Crores", "nothing", "(₹ lakhs)"]) == ["crore", None, "lakh"]
    assert of(U.label_scale, ["Revenue (₹ in million)", "Cost (crore)", "Cost"]) == ["million", "crore", None]
    assert of(U.label_currency, ["Active customers", "Cost $", "Cost", "₹ x"]) == ["INR", "USD", None, "INR"]


def test_similarity():
    assert common_subsequence("kitten", "sitting") == 4 and common_subsequence("", "a") == 0
    assert token_set_ratio("net worth", "net worth restated") == 100 and token_set_ratio("", "a") == 0 and token_set_ratio(None, "a") == 0
    assert token_set_ratio("other income", "total income") == pytest.approx(75.0)
    assert token_set_ratio("abc", "abd") == pytest.approx(100 * (1 - 2 / 6))
