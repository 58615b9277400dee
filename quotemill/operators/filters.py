"""Row filters. Each is a plain predicate, so Catalyst pushes it to the scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions import calendar as cal
from quotemill.functions.scalars import base_symbol

# The plausibility limits of a tick.
MAX_PRICE = 1_000_000
MAX_CHANGE_PERCENT = 50


def valid_ticks(df: DataFrame) -> DataFrame:
    """Positive, plausible prices and volumes with a change under the limit; NULL drops the row."""
    return df.filter(
        (F.col("price") > 0)
        & (F.col("day_volume") > 0)
        & (F.col("price") < MAX_PRICE)
        & (F.abs("change_percent") < MAX_CHANGE_PERCENT)
    )


def in_session(df: DataFrame) -> DataFrame:
    return df.filter(F.col("market_hours") == 1)


def in_basket(df: DataFrame, codes: list[str] | DataFrame, column: str = "symbol") -> DataFrame:
    """Members of a basket, given as a short list or as a table with the same column."""
    if isinstance(codes, DataFrame):
        return df.join(codes.select(column).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(codes))


def _millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def _day(day: Column | dt.date | str) -> Column:
    return day if isinstance(day, Column) else F.lit(str(day)).cast("date")


def session_ticks(df: DataFrame, symbol: str, day: Column | dt.date | str, zone: str = cal.MARKET_ZONE) -> DataFrame:
    """Ticks of one symbol from 9 to 15 o'clock market time, both ends included."""
    start, end = cal.at_hour(_day(day), cal.OPEN_HOUR, zone), cal.at_hour(_day(day), cal.CLOSE_HOUR, zone)
    return df.filter(
        (F.col("symbol") == symbol) & F.col("timestamp").cast("bigint").between(_millis(start), _millis(end))
    )


def week_ticks(df: DataFrame, symbol: str, today: Column | dt.date | str, zone: str = "UTC") -> DataFrame:
    """Ticks from seven days ago to the last second of today; a Sunday ends on Saturday."""
    day = _day(today)
    start = F.to_utc_timestamp(F.date_sub(day, 7).cast("timestamp"), zone)
    last = F.date_sub(day, F.when(F.weekday(day) == 6, 1).otherwise(0))
    end = F.to_utc_timestamp(F.date_add(last, 1).cast("timestamp"), zone) - F.expr("interval 1 second")
    return df.filter(
        (F.col("symbol") == symbol) & F.col("timestamp").cast("bigint").between(_millis(start), _millis(end))
    )


def daily_range(
    df: DataFrame, symbol: str, from_date: str | None = None, to_date: str | None = None
) -> DataFrame:
    """Daily rows of a symbol; the closed date range counts only when both ends are given."""
    out = df.filter(F.col("symbol") == symbol)
    if from_date and to_date:
        out = out.filter(F.col("trade_date").between(F.lit(from_date).cast("date"), F.lit(to_date).cast("date")))
    return out


def bars_on(df: DataFrame, day: Column | dt.date | str) -> DataFrame:
    """All symbols of one date, without the market suffix, in symbol order."""
    return df.filter(F.col("trade_date") == _day(day)).withColumn("symbol", base_symbol("symbol")).orderBy("symbol")


def text_search(df: DataFrame, query: str) -> DataFrame:
    """Case-sensitive search in title or content; % and _ keep their wildcard meaning."""
    pattern = f"%{query}%"
    return df.filter(F.col("title").like(pattern) | F.col("content").like(pattern))


def news_filter(
    news: DataFrame,
    now: dt.datetime,
    codes: list[str] | DataFrame | None = None,
    time_filter: str = "all",
    search: str | None = None,
    from_date: str | None = None,
    to_date: str | None = None,
) -> DataFrame:
    """Sector codes, time span and text together. Given dates win over the named span."""
    at = F.lit(now).cast("timestamp")
    date = F.col("date")
    out = news if codes is None else in_basket(news, codes, "stock_code")
    if from_date or to_date:
        if from_date:
            out = out.filter(date >= F.lit(from_date).cast("timestamp"))
        if to_date:
            out = out.filter(date < F.lit(to_date).cast("timestamp") + F.expr("interval 1 day"))
    elif time_filter == "today":
        start = F.date_trunc("day", at)
        out = out.filter((date >= start) & (date < start + F.expr("interval 1 day")))
    elif time_filter == "week":
        out = out.filter(date >= at - F.expr("interval 7 days"))
    elif time_filter == "month":
        start = F.date_trunc("month", at)
        out = out.filter((date >= start) & (date < start + F.expr("interval 1 month")))
    else:
        out = out.filter(date >= at - F.expr("interval 365 days"))
    return text_search(out, search) if search else out


def news_recent_filter(
    news: DataFrame, mode: str, now: dt.datetime, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Second variant: today, the last 7 or 30 days, or a custom span whose last day counts fully."""
    at = F.lit(now).cast("timestamp")
    date = F.col("date")
    if mode == "today":
        return news.filter(date >= F.date_trunc("day", at))
    if mode == "week":
        return news.filter(date >= at - F.expr("interval 7 days"))
    if mode == "month":
        return news.filter(date >= at - F.expr("interval 30 days"))
    if mode == "custom":
        out = news
        if start:
            out = out.filter(date >= F.lit(start).cast("timestamp"))
        if end:
            out = out.filter(date < F.lit(end).cast("timestamp") + F.expr("interval 1 day"))
        return out
    return news


def high_sentiment(news: DataFrame, threshold: float = 0.5, n: int = 10) -> DataFrame:
    """The newest ``n`` articles above a sentiment score."""
    return (
        news.filter(F.col("sentiment_score") > threshold)
        .orderBy(F.desc("news_date"), "stock_code", "article_id")
        .limit(n)
    )


def future_predictions(predictions: DataFrame, today: Column | dt.date | str) -> DataFrame:
    return predictions.filter(F.col("prediction_date") > _day(today)).orderBy("prediction_date", "stock_code")
