"""Market calendar on columns. Timestamps are UTC instants; the market zone is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The market's zone and session hours.
MARKET_ZONE = "Asia/Ho_Chi_Minh"
OPEN_HOUR = 9
CLOSE_HOUR = 15


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_time(ts: Column | str, zone: str = MARKET_ZONE) -> Column:
    return F.from_utc_timestamp(_col(ts), zone)


def at_hour(day: Column, hour: int, zone: str = MARKET_ZONE) -> Column:
    """The instant of ``hour`` o'clock market time on a date."""
    return F.to_utc_timestamp(F.make_timestamp(F.year(day), F.month(day), F.day(day), F.lit(hour), F.lit(0), F.lit(0)), zone)


def in_trading_hours(ts: Column | str, zone: str = MARKET_ZONE) -> Column:
    local = local_time(ts, zone)
    return (F.weekday(local) < 5) & (F.hour(local) >= OPEN_HOUR) & (F.hour(local) < CLOSE_HOUR)


def next_session_edge(ts: Column | str, zone: str = MARKET_ZONE) -> Column:
    """The next instant to look at the session: its close while open, else the next 9 o'clock."""
    local = local_time(ts, zone)
    day, wd = F.to_date(local), F.weekday(local)
    return (
        F.when(in_trading_hours(ts, zone), at_hour(day, CLOSE_HOUR, zone))
        .when(wd >= 5, at_hour(F.date_add(day, 7 - wd), OPEN_HOUR, zone))
        .when(F.hour(local) < OPEN_HOUR, at_hour(day, OPEN_HOUR, zone))
        .otherwise(at_hour(F.date_add(day, 1), OPEN_HOUR, zone))
    )


def latest_trading_date(now: Column | str, zone: str = MARKET_ZONE) -> Column:
    """Today once the session has started, else the weekday before; weekends give Friday."""
    local = local_time(now, zone)
    day, wd = F.to_date(local), F.weekday(local)
    before_open = F.when(wd == 0, 3).otherwise(1)
    back = F.when(wd >= 5, wd - 4).when(F.hour(local) < OPEN_HOUR, before_open).otherwise(0)
    return F.date_sub(day, back)


def reference_date(now: Column | str, zone: str = MARKET_ZONE) -> Column:
    """The date whose close is the reference price.

    From 9 o'clock on: the weekday before, and Thursday at weekends. Before 9 o'clock the day
    before counts, which falls back to Thursday when it is a Friday or a weekend day.
    """
    local = local_time(now, zone)
    day, wd = F.to_date(local), F.weekday(local)
    yesterday = F.date_sub(day, 1)
    early = F.date_sub(yesterday, F.greatest(F.weekday(yesterday) - 3, F.lit(0)))
    back = F.when(wd >= 5, wd - 3).when(wd == 0, 3).otherwise(1)
    return F.when(F.hour(local) < OPEN_HOUR, early).otherwise(F.date_sub(day, back))


def prev_weekday(day: Column | str) -> Column:
    day = _col(day)
    return F.date_sub(day, F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1))


def next_weekday(day: Column | str) -> Column:
    day = _col(day)
    return F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))


def trading_days(df: DataFrame, day: str, holidays: DataFrame | None = None) -> DataFrame:
    """Rows on a weekday that is not in ``holidays(holiday date)``."""
    kept = df.filter(F.weekday(day) < 5)
    if holidays is None:
        return kept
    off = holidays.select(F.col("holiday").alias(day)).distinct()
    return kept.join(off, day, "left_anti")


def calendar_features(df: DataFrame, day: str = "trade_date") -> DataFrame:
    """Zero-based day of month, weekday (Monday 0) and month."""
    return df.withColumns(
        {"day": F.dayofmonth(day) - 1, "week": F.weekday(day), "month": F.month(day) - 1}
    )
