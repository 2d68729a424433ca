"""Column helpers on literal rows: headcount parsing, bands, imputation, day keys, safe ratios."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rackpulse.functions import (
    BANDS_COARSE, BANDS_DETAIL, BANDS_FINE, IMPUTE_COARSE, IMPUTE_FINE, band, cut_length, day_key,
    impute_headcount, iso_week, iso_year, month_key, month_of_day_key, monday, parse_headcount, ratio,
)


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def test_parse_headcount_cases(spark):
    texts = [None, "", " ", "+", "50+", "+50", "50人", "30~50", "unknown", "300"]
    rows = one_col(spark, texts).select("x", cut_length("x").alias("n"), parse_headcount("x").alias("p")).collect()
    got = {r.x: (r.n, r.p) for r in rows}
    assert got[None] == (None, "")
    assert got[""] == (0, "")
    assert got[" "] == (1, "")          # kept, but no digit
    assert got["+"] == (0, "")          # nothing left after dropping '+'
    assert got["50+"] == (2, "50")
    assert got["+50"] == (2, "5")       # the cut length ignores '+', so the leading '+' eats a digit
    assert got["50人"] == (3, "50")
    assert got["30~50"] == (5, "30")    # first digit run
    assert got["unknown"] == (7, "")
    assert got["300"] == (3, "300")


def test_coarse_band_edges_and_text(spark):
    vals = [None, "", "29", "30", "49", "50", "99", "100", "299", "300", "abc"]
    rows = one_col(spark, vals).select("x", band("x", BANDS_COARSE).alias("b")).collect()
    got = {r.x: r.b for r in rows}
    assert got[None] == "empty" and got[""] == "empty"
    assert got["29"] == "30-" and got["30"] == "30-50" and got["49"] == "30-50"
    assert got["50"] == "50-100" and got["99"] == "50-100" and got["100"] == "100-300"
    assert got["299"] == "100-300" and got["300"] == "300+"
    assert got["abc"] == "other"        # not a number: no error under ANSI, falls to ELSE


@pytest.mark.parametrize("spec,expect", [
    (BANDS_FINE, {"24": "1~24", "25": "25~49", "49": "25~49", "50": "50~99", "99": "50~99", "100": "100~299",
                  "299": "100~299", "300": "300~499", "499": "300~499", "500": "500+", "30~50": "30~50",
                  "": ""}),
    (BANDS_DETAIL, {"29": "30-", "30": "30~49", "49": "30~49", "50": "50~99", "100": "100~299", "300": "300+",
                    "unknown": "unknown"}),
])
def test_fine_and_detail_bands_keep_text(spark, spec, expect):
    rows = one_col(spark, list(expect)).select("x", band("x", spec).alias("b")).collect()
    assert {r.x: r.b for r in rows} == expect


def test_impute_null_takes_first_rule_as_written(spark):
    df = spark.createDataFrame([(None, 99), ("", 1), ("", 3), ("", 11), ("", 17), ("120", 50)], "t string, n long")
    got = [r.v for r in df.select(impute_headcount("t", "n", IMPUTE_COARSE).alias("v")).collect()]
    assert got == ["30~50", "30~50", "30~50", "300+", "300+", "120"]
    got = [r.v for r in df.select(impute_headcount("t", "n", IMPUTE_FINE).alias("v")).collect()]
    assert got == ["30", "30", "50", "300", "500", "120"]
    # the evident intent: null treated like '' (99 racks -> largest label)
    got = [r.v for r in df.select(impute_headcount("t", "n", IMPUTE_FINE, null_as_empty=True).alias("v")).collect()]
    assert got == ["500", "30", "50", "300", "500", "120"]


def test_day_key_uses_months_not_minutes(spark):
    df = spark.createDataFrame([(dt.datetime(2017, 12, 31, 10, 5),)], "t timestamp_ntz")
    r = df.select(day_key("t").alias("d"), month_key("t").alias("m"), month_key("t", "MM").alias("mm"),
                  F.date_format("t", "yyyymmdd").alias("wrong")).first()
    assert r.d == "20171231" and r.m == "201712" and r.mm == "12"
    assert r.wrong == "20170531"  # the pitfall the helpers avoid


def test_month_of_day_key_formats(spark):
    df = one_col(spark, ["20171231"])
    r = df.select(month_of_day_key("x").alias("a"), month_of_day_key("x", "MM").alias("b"),
                  month_of_day_key("x", "yyyy-MM").alias("c")).first()
    assert (r.a, r.b, r.c) == ("201712", "12", "2017-12")


def test_iso_weeks_across_new_year(spark):
    days = [dt.datetime(2016, 12, 31), dt.datetime(2017, 1, 1), dt.datetime(2017, 12, 31),
            dt.datetime(2018, 1, 1), dt.datetime(2018, 12, 31)]
    df = spark.createDataFrame([(d,) for d in days], "t timestamp_ntz")
    rows = df.select(iso_year("t").alias("y"), iso_week("t").alias("w"), monday("t").alias("m")).collect()
    assert [(r.y, r.w) for r in rows] == [(2016, 52), (2016, 52), (2017, 52), (2018, 1), (2019, 1)]
    assert rows[1].m == dt.date(2016, 12, 26) and rows[3].m == dt.date(2018, 1, 1)


def test_ratio_zero_and_null_denominator(spark):
    df = spark.createDataFrame([(1, 0), (1, None), (7, 2)], "a long, b long")
    assert [r.v for r in df.select(ratio("a", "b").alias("v")).collect()] == [None, None, 3.5]
