from __future__ import annotations

import datetime as dt
import difflib
import html

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weekpanel.functions import dates as D
from weekpanel.functions import numeric as N
from weekpanel.functions import text as X
from weekpanel.functions import windows as W
from weekpanel.operators.regression import f_upper_tail


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize("day,friday", [("2024-01-05", "2024-01-05"), ("2024-01-06", "2024-01-12"), ("2024-01-07", "2024-01-12"), ("2024-01-11", "2024-01-12")])
def test_week_ends_on_friday(spark, day, friday):
    assert str(value(spark, D.week_ending_friday(F.lit(day).cast("date")))) == friday


@pytest.mark.parametrize("utc,reference,next_friday", [
    ("2024-01-05 20:59:00", "2024-01-05", "2024-01-05"),  # Friday 15:59 New York
    ("2024-01-05 21:00:00", "2024-01-12", "2024-01-12"),  # Friday 16:00
    ("2024-01-06 15:00:00", "2024-01-19", "2024-01-12"),  # Saturday
    ("2024-01-08 03:00:00", "2024-01-19", "2024-01-12"),  # Sunday night
    ("2024-03-08 20:59:59", "2024-03-08", "2024-03-08"),  # before the clock change: 15:59
    ("2024-03-15 20:00:00", "2024-03-22", "2024-03-22"),  # after it: 16:00
])
def test_market_week(spark, utc, reference, next_friday):
    t = F.lit(utc).cast("timestamp_ntz")
    assert str(value(spark, D.market_week(t))) == reference
    assert str(value(spark, D.market_week(t, "next_friday"))) == next_friday


def test_market_week_ignores_session_zone(spark):
    t = F.lit("2024-01-05 21:00:00").cast("timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert str(value(spark, D.market_week(t))) == "2024-01-12"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("d,f,a,expected", [
    ("2024-03-31", "2024-04-20", "2024-04-22", "2024-04-22"), ("2024-03-31", "2024-04-20", None, "2024-04-20"),
    ("2024-03-31", "2024-04-20", "2024-03-01", "2024-04-20"), ("2024-03-31", None, "2024-03-01", "2024-03-31"),
    (None, "2024-04-20", "2024-03-01", "2024-03-01"), (None, None, None, None),
])
def test_public_date(spark, d, f, a, expected):
    got = value(spark, D.public_date(*[F.lit(x).cast("date") for x in (d, f, a)]))
    assert (str(got) if got else None) == expected


@pytest.mark.parametrize("text,expected", [
    ("2024-01-05T21:00:00Z", "2024-01-05 21:00:00"), ("2024-01-05T21:00:00-05:00", "2024-01-06 02:00:00"),
    ("2024-01-05 21:00:00", "2024-01-05 21:00:00"), ("nonsense", None),
])
def test_parse_utc(spark, text, expected):
    got = value(spark, D.parse_utc(F.lit(text)))
    assert (str(got) if got else None) == expected


def test_safe_arithmetic(spark):
    assert value(spark, N.safe_divide(F.lit(1.0), F.lit(0.0))) is None
    assert value(spark, N.to_double(F.lit("NaN"))) is None and value(spark, N.to_double(F.lit("x"))) is None
    assert value(spark, N.as_flag(F.lit(None).cast("boolean"))) == 0
    assert value(spark, N.direction(F.lit(None).cast("double"), F.lit(1.0))) == 0
    assert value(spark, N.null_where(F.lit(3.0), F.lit(1))) is None and value(spark, N.null_where(F.lit(3.0), F.lit(None).cast("int"))) == 3.0


def test_text_forms(spark):
    raw = "  Tom &amp; Jerry  at http://x.y/z #win @you 3.5%\n up "
    assert value(spark, X.normalize_text(F.lit(raw))) == "Tom & Jerry at http://x.y/z #win @you 3.5% up"
    assert value(spark, X.canonical(X.normalize_text(F.lit(raw)))) == "tom jerry at win up"
    assert value(spark, X.normalize_text(F.lit(None).cast("string"))) == ""
    assert value(spark, X.normalize_id(F.lit(" NaN "))) == "" and value(spark, X.normalize_id(F.lit(" 7 "))) == "7"
    assert value(spark, X.text_or_headline(F.lit("nan"), F.lit(" h "))) == "h"
    assert value(spark, X.label_column("EMO", F.lit("very HAPPY"))) == "EMO_Very_happy"
    assert value(spark, X.collapse(F.lit("a b  c\t\nd \n e"))) == "a b c d e"


@settings(max_examples=60, deadline=None)
@given(st.text("abcd ", max_size=60), st.text("abcd ", max_size=60))
def test_similarity_bounds_are_exact(a, b):
    assert X._similar(a, b, 0.92) == (difflib.SequenceMatcher(None, a, b).ratio() >= 0.92 if a or b else True)


@settings(max_examples=60, deadline=None)
@given(st.text("abcdefgh ", min_size=250, max_size=400), st.integers(0, 30), st.randoms())
def test_similarity_of_long_near_copies(a, n, rnd):
    b = list(a)
    for _ in range(n):
        b.pop(rnd.randrange(len(b)))
    b = "".join(b)
    assert X._similar(a, b, 0.92) == (difflib.SequenceMatcher(None, a, b).ratio() >= 0.92)


def test_similar_column_and_unescape(spark):
    df = spark.createDataFrame([("strong growth this year", "strong growth this year."), ("a", "completely different"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(X.similar(F.col("a"), F.col("b"), 0.92)).collect()] == [True, False, False]
    text = "&lt;b&gt; &amp;amp; &#39;x&#39; &nbsp;&eacute;"
    assert value(spark, X.unescape_html(F.lit(text))) == html.unescape(text)


def test_windows(spark):
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate([1.0, 2.0, None, 4.0, 0.0, 6.0])], "t string, i int, v double")
    w = W.entity_window("t", "i")
    out = df.select(
        "i", W.forward_fill("v", w).alias("f"), W.rolling_sum("v", 2, w).alias("s"), W.moving_average("v", 3, w).alias("m"),
        W.zero_between_positive("v", w).alias("z"), W.pct_change("v", 1, w).alias("p"), W.zscore("v", "t").alias("q"),
    ).orderBy("i").collect()
    assert [r["f"] for r in out] == [1.0, 2.0, 2.0, 4.0, 0.0, 6.0]
    assert [r["s"] for r in out] == [None, 3.0, None, None, 4.0, 6.0]
    assert out[0]["m"] == 1.0 and out[2]["m"] == 1.5
    assert [r["z"] for r in out] == [0, 0, 0, 0, 1, 0]
    assert out[1]["p"] == 1.0 and out[5]["p"] is None
    assert out[2]["q"] is None and abs(sum(r["q"] for r in out if r["q"] is not None)) < 1e-9
    flat = spark.createDataFrame([("A", 1.0), ("A", 1.0), ("B", None), ("C", 5.0)], "t string, v double").select("t", W.zscore("v", "t").alias("q"))
    assert sorted((r["t"], r["q"]) for r in flat.filter("t <> 'B'").collect()) == [("A", 0.0), ("A", 0.0), ("C", 0.0)]


@pytest.mark.parametrize("f,d1,d2,p", [(1.0, 1, 1, 0.5), (4.0, 2, 4, 1 / 9), (3.0, 2, 10, (1 + 6 / 10) ** -5), (0.0, 3, 5, 1.0)])
def test_f_distribution(f, d1, d2, p):
    assert abs(f_upper_tail(f, d1, d2) - p) < 1e-12


def test_mixed_dates(spark):
    assert value(spark, D.parse_mixed_date(F.lit("03/31/2024"))) == dt.date(2024, 3, 31)
    assert value(spark, D.parse_mixed_date(F.lit("soon"))) is None
