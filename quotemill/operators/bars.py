"""Ticks to bars. Every bar is one aggregate, so a hot symbol is combined before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.ordering import one_row, order_key
from quotemill.functions.scalars import round2
from quotemill.operators.filters import in_session

TICK_ORDER = ("event_ts", "seq")
PRICE_COLUMNS = ("open", "high", "low", "close", "vwap")
# What the finished daily row says about venue and session, and the bar widths.
VENUE = {"exchange": "NASDAQ", "quote_type": 1, "market_hours": 1}
INTERVALS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}


def latest_by_symbol(ticks: DataFrame, order: Sequence[str] = TICK_ORDER, key: str = "symbol") -> DataFrame:
    """The newest row per symbol."""
    return one_row(ticks, [key], order)


def _ohlc() -> list[Column]:
    """Over rows with their order key in ``_at``."""
    return [
        F.min_by("price", "_at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "_at").alias("close"),
    ]


def _traded_vwap() -> Column:
    return F.coalesce(
        F.try_divide(F.sum(F.col("price") * F.col("last_size")), F.sum("last_size").cast("double")),
        F.max_by("price", "_at"),
    )


def _rounded(bars: DataFrame, rounded: bool) -> DataFrame:
    return bars.withColumns({c: round2(c) for c in PRICE_COLUMNS}) if rounded else bars


def daily_bars(
    ticks: DataFrame,
    vwap_mode: str = "cumulative",
    order: Sequence[str] = TICK_ORDER,
    rounded: bool = True,
) -> DataFrame:
    """One bar per symbol and date from the ticks of the session.

    ``cumulative``: volume is the last cumulative day volume and divides the traded value; a single
    tick's vwap is its price. ``traded``: volume and divisor are the summed trade sizes.
    """
    rows = in_session(ticks).withColumn("_at", order_key(ticks, order))
    value = F.sum(F.col("price") * F.col("last_size"))
    close = F.max_by("price", "_at")
    if vwap_mode == "cumulative":
        volume = F.max_by("day_volume", "_at")
        vwap = F.when((F.count(F.lit(1)) > 1) & (volume > 0), value / volume.cast("double")).otherwise(close)
    else:
        volume, vwap = F.sum("last_size"), _traded_vwap()
    # a one-day window, not the plain date, so that a stream's watermark can retire old days
    day = F.window("event_ts", "1 day").alias("_w")
    out = rows.groupBy("symbol", day).agg(
        F.count(F.lit(1)).alias("ticks"), *_ohlc(), volume.alias("volume"), vwap.alias("vwap")
    )
    out = out.withColumn("trade_date", F.to_date("_w.start")).select(
        "symbol", "trade_date", "ticks", "open", "high", "low", "close", "volume", "vwap"
    )
    return _rounded(out, rounded)


def finalize_daily(bars: DataFrame) -> DataFrame:
    """Clamp the prices, add the change against the day's own open and the venue columns."""
    open_, close = F.greatest(F.lit(0.0), F.col("open")), F.greatest(F.lit(0.0), F.col("close"))
    low_side = F.least(open_, close)
    clamped = bars.withColumns(
        {
            "open": open_,
            "close": close,
            "high": F.greatest(F.col("high"), open_, close),
            "low": F.when(F.col("low") > 0, F.least(F.col("low"), low_side)).otherwise(low_side),
        }
    )
    change = F.when(F.col("open") > 0, F.col("close") - F.col("open")).otherwise(0.0)
    percent = F.when(F.col("open") > 0, (F.col("close") - F.col("open")) / F.col("open") * 100).otherwise(0.0)
    out = clamped.withColumns({"change": round2(change), "change_percent": round2(percent)})
    out = out.withColumns({c: round2(c) for c in PRICE_COLUMNS} | {c: F.lit(v) for c, v in VENUE.items()})
    return out.select(
        "symbol", "trade_date", "open", "high", "low", "close", "volume", "change", "change_percent", "vwap",
        "exchange", "quote_type", "market_hours",
    )


def bars(
    ticks: DataFrame, interval: str = "1m", order: Sequence[str] = TICK_ORDER, rounded: bool = True
) -> DataFrame:
    """Tumbling bars of the session ticks; volume is the summed trade size."""
    rows = in_session(ticks).withColumn("_at", order_key(ticks, order))
    out = (
        rows.groupBy("symbol", F.window("event_ts", INTERVALS[interval]).alias("_w"))
        .agg(*_ohlc(), F.sum("last_size").alias("volume"), _traded_vwap().alias("vwap"))
        .select(
            "symbol",
            F.to_date("_w.start").alias("bucket_date"),
            F.lit(interval).alias("interval"),
            F.col("_w.start").alias("ts"),
            "open", "high", "low", "close", "volume", "vwap",
        )
    )
    return _rounded(out, rounded)


def minute_bars(ticks: DataFrame, order: Sequence[str] = TICK_ORDER, rounded: bool = True) -> DataFrame:
    return bars(ticks, "1m", order, rounded)


def rollup_bars(fine: DataFrame, interval: str) -> DataFrame:
    """Coarser bars from finer ones; the vwap is weighted by volume."""
    rows = fine.groupBy("symbol", F.window("ts", INTERVALS[interval]).alias("_w")).agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
        F.coalesce(
            F.try_divide(F.sum(F.col("vwap") * F.col("volume")), F.sum("volume").cast("double")),
            F.max_by("vwap", "ts"),
        ).alias("vwap"),
    )
    return rows.select(
        "symbol", F.to_date("_w.start").alias("bucket_date"), F.lit(interval).alias("interval"),
        F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume", "vwap",
    )


def session_summary(ticks: DataFrame, order: Sequence[str] = TICK_ORDER) -> DataFrame:
    """Open, high, low and close of each symbol's given ticks."""
    return ticks.withColumn("_at", order_key(ticks, order)).groupBy("symbol").agg(*_ohlc())


def collapse_by_second(ticks: DataFrame, order: Sequence[str] = TICK_ORDER) -> DataFrame:
    """The last tick of every second. In event order the ticks of a second are neighbours."""
    shown = ("price", "day_volume", "change", "change_percent")
    rows = ticks.select("symbol", F.date_trunc("second", "event_ts").alias("second"), *shown, order_key(ticks, order).alias("_at"))
    return rows.groupBy("symbol", "second").agg(*[F.max_by(c, "_at").alias(c) for c in shown])


def candle_change(bars: DataFrame) -> DataFrame:
    change = F.col("close") - F.col("open")
    percent = F.when(F.col("open") > 0, change / F.col("open") * 100).otherwise(0.0)
    return bars.withColumns({"candle_change": change, "candle_percent": percent})
