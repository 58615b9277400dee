"""Scalar column functions: rounding, parsing, codes, small ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted words and time formats of the CSV feeds.
TRUE_WORDS = ("true", "1", "yes", "y")
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss.SSSSSSXX",
    "yyyy-MM-dd HH:mm:ss.SSSXX",
    "yyyy-MM-dd HH:mm:ssXX",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
)
# The daily price band of the exchange and the epoch-millisecond threshold.
PRICE_BAND = 0.07
MILLIS_FROM = 10_000_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round2(x: Column | str) -> Column:
    """Two decimals, halves upward (so -0.125 gives -0.12)."""
    return F.floor(_col(x) * 100.0 + 0.5) / 100.0


def round_half_up(x: Column | str) -> Column:
    return F.floor(_col(x) + 0.5)


def parse_tick_ts(s: Column | str) -> Column:
    """Epoch seconds, epoch milliseconds or ISO text to a timestamp; anything else is NULL."""
    s = _col(s)
    number = F.when(s.rlike("^[0-9]+$"), s.try_cast("bigint"))
    iso = F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T"), F.regexp_replace(s, "Z", "").try_cast("timestamp"))
    return (
        F.when(number > MILLIS_FROM, F.timestamp_millis(number))
        .when(number.isNotNull(), F.timestamp_seconds(number))
        .otherwise(iso)
    )


def trade_date(ts: Column | str) -> Column:
    return F.to_date(_col(ts))


def minute_bucket(ts: Column | str) -> Column:
    return F.date_trunc("minute", _col(ts))


def parse_ts_multi(s: Column | str) -> Column:
    """First format that fits; zones (Z, +HH:MM, +HHMM) are turned to UTC; else NULL."""
    text = F.regexp_replace(F.trim(_col(s)), "Z$", "+0000")
    text = F.regexp_replace(text, "([+-][0-9]{2}):?([0-9]{2})$", "$1$2")
    # a bare date such as 2024-05-0612 must not be read as a zone: only text with a time keeps one
    plain = F.trim(_col(s))
    text = F.when(plain.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), plain).otherwise(text)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(fmt)) for fmt in TIME_FORMATS])


def strip_suffix(s: Column | str, suffix: str = ".VN") -> Column:
    return F.regexp_replace(_col(s), suffix.replace(".", r"\.") + "$", "")


def base_symbol(s: Column | str) -> Column:
    return F.substring_index(_col(s), ".", 1)


def market_symbol(s: Column | str, suffix: str = ".VN") -> Column:
    return F.concat(_col(s), F.lit(suffix))


def parse_bool(s: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(_col(s))).isin(*TRUE_WORDS), F.lit(False))


def null_if_zero(x: Column | str) -> Column:
    x = _col(x)
    return F.when(x != 0, x)


def price_limits(ref: Column | str) -> tuple[Column, Column]:
    """Ceiling and floor: the reference price plus / minus the rounded band; 0 stays 0."""
    ref = _col(ref)
    band = round_half_up(ref * PRICE_BAND)
    return ref + band, ref - band


def price_limits_scaled(ref: Column | str) -> tuple[Column, Column]:
    """Variant: the scaled reference is rounded as a whole."""
    ref = _col(ref)
    return round_half_up(ref * 1.07), round_half_up(ref * 0.93)


def trend(value: Column | str, base: Column | str) -> Column:
    value, base = _col(value), _col(base)
    return F.when(value > base, "up").when(value < base, "down").otherwise("neutral")


def trend_sign(value: Column | str, base: Column | str) -> Column:
    value, base = _col(value), _col(base)
    return F.when(value > base, 1).when(value < base, -1).otherwise(0)


def confidence(mse: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + _col(mse))


def range_position(price: Column | str, low: Column | str, high: Column | str) -> Column:
    """Where a price lies between low and high, in percent; NULL for an empty range."""
    price, low, high = _col(price), _col(low), _col(high)
    return F.try_divide(price - low, high - low) * 100.0


def latency_ms(now_ms: Column | str, producer_ms: Column | str) -> Column:
    now_ms, producer_ms = _col(now_ms), _col(producer_ms)
    return F.when(producer_ms > 0, now_ms - producer_ms)


def article_key(code: Column | str, date: Column | str, article_id: Column | str) -> Column:
    return F.concat_ws("|", _col(code), _col(date).cast("string"), _col(article_id))


def sector_label(s: Column | str) -> Column:
    return F.initcap(F.replace(_col(s), F.lit("_"), F.lit(" ")))


def is_finite(x: Column | str) -> Column:
    x = _col(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def finite_or_null(x: Column | str) -> Column:
    x = _col(x)
    return F.when(is_finite(x), x)


def encode_list(values: Column | str) -> Column:
    return F.to_json(_col(values))


def decode_list(text: Column | str) -> Column:
    return F.from_json(_col(text), "array<string>")


def clean_column_names(df: DataFrame) -> DataFrame:
    """Blanks become underscores, every other character outside letters, digits, _ is dropped."""
    names = ["".join(ch for ch in c.replace(" ", "_") if ch.isascii() and (ch.isalnum() or ch == "_")) for c in df.columns]
    return df.toDF(*names)


def in_codes(c: Column | str, codes: Sequence[str]) -> Column:
    return _col(c).isin(*codes)
