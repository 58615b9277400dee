import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.functions import calendar as cal
from quotemill.functions import formula as fo
from quotemill.functions import scalars as sc


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_round2_rounds_halves_upward(spark):
    assert one(spark, sc.round2(F.lit(-0.125))) == -0.12
    assert one(spark, sc.round2(F.lit(0.125))) == 0.13
    assert one(spark, sc.round2(F.lit(2.344))) == 2.34


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1761185959000", dt.datetime(2025, 10, 23, 2, 19, 19)),
        ("1761185959", dt.datetime(2025, 10, 23, 2, 19, 19)),
        ("2025-10-23T02:19:19Z", dt.datetime(2025, 10, 23, 2, 19, 19)),
        ("2025-10-23T02:19:19.5", dt.datetime(2025, 10, 23, 2, 19, 19, 500000)),
        ("junk", None),
        ("99999999999999999999999", None),
        (None, None),
    ],
)
def test_parse_tick_ts(spark, text, expected):
    assert one(spark, sc.parse_tick_ts(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-05-06 07:08:09.123+0700", dt.datetime(2024, 5, 6, 0, 8, 9, 123000)),
        ("2024-05-06 07:08:09+07:00", dt.datetime(2024, 5, 6, 0, 8, 9)),
        ("2024-05-06 07:08:09Z", dt.datetime(2024, 5, 6, 7, 8, 9)),
        ("2024-05-06 07:08:09.123456", dt.datetime(2024, 5, 6, 7, 8, 9, 123456)),
        (" 2024-05-06 07:08:09 ", dt.datetime(2024, 5, 6, 7, 8, 9)),
        ("2024-05-06", dt.datetime(2024, 5, 6)),
        ("06/05/2024", None),
    ],
)
def test_parse_ts_multi(spark, text, expected):
    assert one(spark, sc.parse_ts_multi(F.lit(text))) == expected


def test_codes_and_words(spark):
    assert one(spark, sc.strip_suffix(F.lit("A.VN.VN"))) == "A.VN"
    assert one(spark, sc.strip_suffix(F.lit("AXVN"))) == "AXVN"
    assert one(spark, sc.base_symbol(F.lit("FPT.VN"))) == "FPT"
    assert one(spark, sc.parse_bool(F.lit(" YES "))) is True
    assert one(spark, sc.parse_bool(F.lit("0"))) is False
    assert one(spark, sc.parse_bool(F.lit(None).cast("string"))) is False
    assert one(spark, sc.sector_label(F.lit("real_estate"))) == "Real Estate"
    assert one(spark, sc.article_key(F.lit("A"), F.lit("2024-01-02"), F.lit(7))) == "A|2024-01-02|7"


def test_prices_and_ratios(spark):
    up, down = sc.price_limits(F.lit(100.5))
    assert (one(spark, up), one(spark, down)) == (107.5, 93.5)
    assert one(spark, sc.price_limits(F.lit(0.0))[0]) == 0
    assert one(spark, sc.range_position(F.lit(15.0), F.lit(10.0), F.lit(20.0))) == 50
    assert one(spark, sc.range_position(F.lit(15.0), F.lit(10.0), F.lit(10.0))) is None
    assert one(spark, sc.latency_ms(F.lit(10), F.lit(0))) is None
    assert one(spark, sc.latency_ms(F.lit(10), F.lit(4))) == 6
    assert one(spark, sc.confidence(F.lit(1.0))) == 0.5
    assert [one(spark, sc.trend(F.lit(a), F.lit(2))) for a in (3, 1, 2)] == ["up", "down", "neutral"]
    assert [one(spark, sc.is_finite(F.lit(x))) for x in (1.0, float("nan"), float("inf"), float("-inf"))] == [True, False, False, False]


def test_lists_and_names(spark):
    assert one(spark, sc.decode_list(sc.encode_list(F.array(F.lit("a"), F.lit('b"'))))) == ["a", 'b"']
    assert sc.clean_column_names(spark.createDataFrame([(1, 2)], ["a b(c)", "d-é"])).columns == ["a_bc", "d"]


def local(day, hour, minute=0):
    """Market wall-clock time as a UTC timestamp column."""
    return F.lit(dt.datetime(2024, 1, day, hour, minute) - dt.timedelta(hours=7)).cast("timestamp")


# January 2024: the 5th is a Friday, the 8th a Monday
@pytest.mark.parametrize("day, hour, minute, expected", [(5, 8, 59, False), (5, 9, 0, True), (5, 14, 59, True), (5, 15, 0, False), (6, 10, 0, False), (7, 10, 0, False), (8, 9, 0, True)])
def test_trading_hours(spark, day, hour, minute, expected):
    assert one(spark, cal.in_trading_hours(local(day, hour, minute))) is expected


@pytest.mark.parametrize(
    "day, hour, edge",
    [(4, 8, (4, 9)), (4, 10, (4, 15)), (4, 15, (5, 9)), (6, 12, (8, 9)), (7, 12, (8, 9))],
)
def test_next_session_edge(spark, day, hour, edge):
    expected = dt.datetime(2024, 1, *edge) - dt.timedelta(hours=7)
    assert one(spark, cal.next_session_edge(local(day, hour))) == expected


@pytest.mark.parametrize(
    "day, hour, latest, reference",
    [
        (4, 8, 3, 3), (4, 9, 4, 3), (5, 8, 4, 4), (5, 9, 5, 4), (6, 8, 5, 4), (6, 9, 5, 4),
        (7, 8, 5, 4), (7, 9, 5, 4), (8, 8, 5, 4), (8, 9, 8, 5), (9, 8, 8, 8), (9, 9, 9, 8),
    ],
)
def test_trading_and_reference_date(spark, day, hour, latest, reference):
    assert one(spark, cal.latest_trading_date(local(day, hour))) == dt.date(2024, 1, latest)
    assert one(spark, cal.reference_date(local(day, hour))) == dt.date(2024, 1, reference)


def test_weekday_steps(spark):
    for day, before, after in ((5, 4, 8), (6, 5, 8), (7, 5, 8), (8, 5, 9), (9, 8, 10)):
        d = F.lit(dt.date(2024, 1, day))
        assert one(spark, cal.prev_weekday(d)) == dt.date(2024, 1, before)
        assert one(spark, cal.next_weekday(d)) == dt.date(2024, 1, after)


def test_trading_days_and_features(spark, rows):
    df = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (5, 6, 8)], "trade_date date")
    off = spark.createDataFrame([(dt.date(2024, 1, 8),)], "holiday date")
    assert rows(cal.trading_days(df, "trade_date", off)) == [(dt.date(2024, 1, 5),)]
    assert rows(cal.calendar_features(df).filter("day = 7"), "day", "week", "month") == [(7, 0, 0)]


COLUMNS = ("open", "high", "low", "close", "volume", "SMA_5")


@pytest.mark.parametrize(
    "text, cleaned, problem",
    [
        ("Alpha1 = (close - SMA_5) / SMA_5", "(close - SMA_5) / SMA_5", None),
        ('"close × 2";', "close * 2", None),
        ("close >= open", "close >= open", None),
        ("close ≥ open", "close >= open", None),
        ("close == open", "close == open", "Eq not allowed"),
        ("a/0", "a/0", "unknown name a"),
        ("close.shift(1)", "close.shift(1)", "forbidden call .shift("),
        ("((close)", "((close)", "unbalanced brackets"),
        ("close +", "close +", "syntax error"),
        ("close ** 2", "close ** 2", "Pow not allowed"),
        ("abs(close)", "abs(close)", None),
        ("log(close, open)", "log(close, open)", "call not allowed"),
        ("close if open else low", "close if open else low", "IfExp not allowed"),
        ("", "", "empty"),
        ("fpt_polarity - close", "fpt_polarity - close", None),
        ("FPT_Polarity - close", "FPT_Polarity - close", None),
        ("close - max", "close - max", "unknown name max"),
        ("close - log", "close - log", "unknown name log"),
        ("close + é", "close + é", "unknown name é"),
        ("close + 1e999", "close + 1e999", "number too large"),
        ("close + " + "9" * 400, "close + " + "9" * 400, "number too large"),
        (" + ".join(["close"] * 2000), " + ".join(["close"] * 2000), "nested too deeply"),
    ],
)
def test_formula_cleaning_and_checking(spark, text, cleaned, problem):
    df = spark.createDataFrame([(text,)], "f string").select(fo.clean_formula("f").alias("c"))
    got = df.select("c", fo.formula_problem("c", COLUMNS).alias("p")).first()
    assert tuple(got) == (cleaned, problem)


def test_polarity_names_need_a_partner(spark):
    df = spark.createDataFrame([("fpt_polarity", ["FPT"]), ("vcb_polarity", ["FPT"])], "f string, codes array<string>")
    got = df.select(fo.formula_problem("f", COLUMNS, F.col("codes"))).collect()
    assert [r[0] for r in got] == [None, "unknown name vcb_polarity"]


@pytest.mark.parametrize(
    "text, expected",
    [("1 + 2 * 3 - 4 / 8", 6.5), ("-(close - open)", -2.0), ("close / (open - 3)", None), ("close > open", 1.0), ("2 <= 1", 0.0), ("sqrt(close - 1) * abs(-3)", 6.0), ("log(0)", None)],
)
def test_formula_values(spark, text, expected):
    df = spark.createDataFrame([(5.0, 3.0)], "close double, open double")
    assert df.select(fo.formula_column(text)).first()[0] == expected


@pytest.mark.parametrize("text", ["__import__('os')", "close.__class__", "'a'", "[close]", "lambda: 1", "1 < 2 < 3", "True"])
def test_formula_language_is_closed(text):
    with pytest.raises(fo.FormulaError):
        fo.parse(text)
