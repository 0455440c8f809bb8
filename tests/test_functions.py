"""Cleaning and numeric expressions on edge cells."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendlens.functions import cleaning as cl
from spendlens.functions import headers, numeric


def one(spark, value, expr, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "cell, pipeline, agreed, grader, alert",
    [
        ("$1,200.50", 1200.5, 1200.5, 1200.5, None),
        ("USD 5", None, None, 5.0, None),
        ("-", None, None, None, None),
        ("N/A", None, None, None, None),
        ("Not Entered", None, None, None, None),
        ("", None, None, None, None),
        ("None", None, None, None, None),
        (None, None, None, None, None),
        ("1.2.3", None, None, None, None),
        ('"42"', None, 42.0, 42.0, 42.0),
        ('""', None, None, None, None),
        (" 7 ", 7.0, 7.0, 7.0, 7.0),
        ("NaN", None, None, None, None),
    ],
)
def test_clean_number(spark, cell, pipeline, agreed, grader, alert):
    rules = (cl.PIPELINE_CELLS, cl.AGREED_CPL_CELLS, cl.GRADER_CELLS, cl.ALERT_CELLS)
    assert [one(spark, cell, lambda c, r=r: cl.clean_number(c, r)) for r in rules] == [pipeline, agreed, grader, alert]


@pytest.mark.parametrize("cell, loose, strict", [("3.0", 3, None), ("-3.9", -3, None), ("12", 12, 12), ("x", None, None), ("", None, None)])
def test_clean_integer(spark, cell, loose, strict):
    assert one(spark, cell, cl.clean_integer) == loose
    assert one(spark, cell, lambda c: cl.clean_integer(c, cl.ALERT_CELLS)) == strict


@pytest.mark.parametrize(
    "cell, day",
    [("2025-09-01", dt.date(2025, 9, 1)), ("9/1/2025", dt.date(2025, 9, 1)), ("2025-09-01 10:00:00", dt.date(2025, 9, 1)), ("soon", None), ("", None)],
)
def test_clean_date(spark, cell, day):
    assert one(spark, cell, cl.clean_date) == day


@pytest.mark.parametrize(
    "text, compat, collapse",
    [
        ("Joe Pizza Shop", "JoePizzaShop", "Joe Pizza Shop"),
        ("a b c", "ab c", "a b c"),
        ("﻿ x  - y ", "x - y", "x - y"),
        ("é ö", "éö", "é ö"),
        (None, "", ""),
    ],
)
def test_unicode_text(spark, text, compat, collapse):
    assert one(spark, text, cl.unicode_text) == compat
    assert one(spark, text, lambda c: cl.unicode_text(c, "collapse")) == collapse


def test_headers():
    assert headers.numbered(["Type", "Type", "x", "Type"]) == ["Type", "Type_1", "x", "Type_2"]
    assert headers.normalize("Mo. Offer Amt") == "mo__offer_amt"
    assert headers.normalize("Spend %") == "spend__pct"
    assert headers.normalize("CPL (30-day)", "pct") == "cpl_30_day"
    got = headers.clean_headers(["﻿Account", "Type", "Type", "Mo. Offer Amt"], headers.PIPELINE_RENAMES)
    assert got == ["account", "type_1", "type_2", "mo_offer_amt"]


def test_headers_as_written():
    assert headers.as_written(["Id", "Type1", "Type2", "x9", "Q4"]) == ["Id", "Type", "Type", "x9", "Q4"]


@pytest.mark.parametrize("value, digits, want", [(0.5, 0, 0.0), (1.5, 0, 2.0), (2.5, 0, 2.0), (0.25, 1, 0.2), (3.05, 1, 3.0), (None, 1, None)])
def test_half_even(spark, value, digits, want):
    assert one(spark, value, lambda c: numeric.half_even(c, digits), "double") == want


def test_safe_numbers(spark):
    assert one(spark, "abc", lambda c: numeric.number(c, 1.0)) == 1.0
    assert one(spark, 0.0, lambda c: numeric.ratio(F.lit(1.0), c, 9.0), "double") == 9.0
    assert one(spark, float("inf"), lambda c: numeric.ratio(c, F.lit(2.0), 9.0), "double") == 9.0
    assert one(spark, None, lambda c: numeric.clip(c, 0.0, 1.0), "double") is None
    assert one(spark, 5.0, lambda c: numeric.clip(c, 0.0, 1.0), "double") == 1.0
    assert one(spark, -2.5, numeric.half_up, "double") == -2
    assert one(spark, 0.0, numeric.zero_as_null, "double") is None


@pytest.mark.parametrize("util, want", [(99.71, 0.9971), (0.0, None), (None, None), (400.0, 1.0)])
def test_utilization(spark, util, want):
    got = one(spark, util, lambda c: cl.percent_to_fraction(c, F.lit(500.0), F.lit(3000.0), F.lit(30.0)), "double")
    assert got == (pytest.approx(want) if want is not None else None)
