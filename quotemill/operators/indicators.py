"""Technical indicators over daily bars.

Input holds one row per stock and date, so a stock has at most as many rows as the history has
days. That bound is what allows whole-stock windows and the one Python pass here.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.joins import join_sentiment, related_sentiment_map
from quotemill.operators.news import related_companies

FEATURES = (
    "SMA_5", "SMA_20", "EMA_10", "Momentum_3", "Momentum_10", "RSI_14", "MACD", "MACD_Signal",
    "BB_Upper", "BB_Lower", "OBV",
)
BASE_COLUMNS = ("open", "high", "low", "close", "volume")

def by_stock():
    return Window.partitionBy("stock_code").orderBy("trade_date")


def _last(n: int):
    return by_stock().rowsBetween(-(n - 1), 0)


def _full(n: int, value: Column) -> Column:
    """NULL until ``n`` rows are there."""
    return F.when(F.count("close").over(_last(n)) >= n, value)


def sma(n: int) -> Column:
    return _full(n, F.avg("close").over(_last(n)))


def roc(n: int) -> Column:
    before = F.lag("close", n).over(by_stock())
    return F.try_divide(F.col("close") - before, before) * 100.0


def bollinger(n: int = 20, width: float = 2.0) -> tuple[Column, Column]:
    middle, spread = F.avg("close").over(_last(n)), F.stddev_pop("close").over(_last(n)) * width
    return _full(n, middle + spread), _full(n, middle - spread)


def obv(df: DataFrame, name: str = "OBV") -> DataFrame:
    """Running volume: minus the day's volume when the close fell, else plus."""
    fell = F.col("close") < F.lag("close").over(by_stock())
    signed = F.when(fell, -F.col("volume")).otherwise(F.col("volume"))
    total = F.sum("_signed").over(by_stock().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_signed", signed).withColumn(name, total.cast("double")).drop("_signed")


def forward_return(h: int = 1) -> Column:
    """Return in percent to the close ``h`` rows later."""
    later = F.lead("close", h).over(by_stock())
    return F.try_divide(later - F.col("close"), F.col("close")) * 100.0


def window_indicators(bars: DataFrame) -> DataFrame:
    upper, lower = bollinger()
    out = bars.withColumns(
        {
            "SMA_5": sma(5),
            "SMA_20": sma(20),
            "Momentum_3": roc(3),
            "Momentum_10": roc(10),
            "BB_Upper": upper,
            "BB_Lower": lower,
        }
    )
    return obv(out)


def _smoothed(values: pd.Series, ready: int, **how) -> pd.Series:
    return values.ewm(adjust=False, min_periods=ready, **how).mean()


def ema(close: pd.Series, n: int) -> pd.Series:
    """Exponential mean with alpha 2/(n+1), started at the first value, shown from row n on."""
    return _smoothed(close, n, span=n)


def rsi(close: pd.Series, n: int = 14) -> pd.Series:
    """Wilder-smoothed gains over losses; 100 where there is no loss."""
    step = close.diff()
    gain = _smoothed(step.clip(lower=0).fillna(0.0), n, alpha=1 / n)
    loss = _smoothed((-step).clip(lower=0).fillna(0.0), n, alpha=1 / n)
    value = 100.0 - 100.0 / (1.0 + gain / loss.where(loss != 0))
    return value.where(loss != 0, 100.0).where(gain.notna())


def macd(close: pd.Series, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[pd.Series, pd.Series]:
    line = ema(close, fast) - ema(close, slow)
    return line, ema(line, signal)


def recursive_indicators(bars: DataFrame) -> DataFrame:
    """EMA, RSI and MACD. Each value needs the one before, so one ordered pass per stock adds all."""

    def one_stock(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trade_date", ignore_index=True)
        close = pdf["close"].astype("float64")
        line, signal = macd(close)
        return pdf.assign(EMA_10=ema(close, 10), RSI_14=rsi(close), MACD=line, MACD_Signal=signal)

    added = "".join(f", `{c}` double" for c in ("EMA_10", "RSI_14", "MACD", "MACD_Signal"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields) + added
    out = bars.groupBy("stock_code").applyInPandas(one_stock, schema)
    nulls = {c: F.nanvl(c, F.lit(None)) for c in ("EMA_10", "RSI_14", "MACD", "MACD_Signal")}
    return out.withColumns(nulls)


def indicators(bars: DataFrame) -> DataFrame:
    """All indicators. The windows and the Python pass share one shuffle by stock."""
    return recursive_indicators(window_indicators(bars.select("stock_code", "trade_date", *BASE_COLUMNS)))


def feature_frame(
    prices: DataFrame, news: DataFrame, dim: DataFrame, end_date: str | None = None, partners: int = 5
) -> DataFrame:
    """Bars with indicators, own polarity and the polarities of related stocks.

    ``end_date`` cuts prices and articles alike. Missing polarity is 0; rows in which an indicator
    is not ready yet are dropped.
    """
    bars = prices.select("stock_code", "trade_date", *BASE_COLUMNS)
    if end_date is not None:
        day = F.lit(end_date).cast("date")
        bars, news = bars.filter(F.col("trade_date") < day), news.filter(F.col("news_date") < day)
    related = related_companies(news, dim, partners)
    polarity = join_sentiment(bars.select("stock_code", "trade_date"), news)
    keys = ["stock_code", "trade_date"]
    empty = F.create_map().cast("map<string,double>")
    return (
        indicators(bars)
        .join(polarity, keys, "left")
        .join(related_sentiment_map(bars, news, related), keys, "left")
        .withColumns(
            {"polarity": F.coalesce("polarity", F.lit(0.0)), "related_polarity": F.coalesce("related_polarity", empty)}
        )
        .dropna(subset=[*BASE_COLUMNS, *FEATURES])
    )


def fill_gaps(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ("stock_code",), order: str = "trade_date") -> DataFrame:
    """Infinite and NaN to NULL, then the last value, then the next one, then 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    clean = df.withColumns(
        {c: F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.col(c)) for c in columns}
    )
    filled = {
        c: F.coalesce(
            F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
            F.lit(0.0),
        )
        for c in columns
    }
    return clean.withColumns(filled)
