"""Declared schemas. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def columns(text: str) -> T.StructType:
    """A schema from "name type, ..." that needs no running session."""
    pairs = (part.split() for part in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_QUOTE = columns(
    "id string, price double, time string, exchange string, quote_type int, market_hours int, "
    "change_percent double, day_volume bigint, change double, last_size bigint, price_hint string"
)

TICK = columns(
    "symbol string, price double, timestamp string, exchange string, quote_type int, market_hours int, "
    "change_percent double, day_volume bigint, change double, last_size bigint, price_hint string, "
    "producer_timestamp bigint"
)

TIMED_TICK = T.StructType([*TICK.fields, T.StructField("event_ts", T.TimestampType()), T.StructField("seq", T.LongType())])

DAILY = columns(
    "symbol string, trade_date date, open double, high double, low double, close double, volume bigint, "
    "change double, change_percent double, vwap double, exchange string, quote_type int, market_hours int"
)

BARS = columns(
    "symbol string, bucket_date date, interval string, ts timestamp, open double, high double, low double, "
    "close double, volume bigint, vwap double"
)

NEWS = columns(
    "article_id string, stock_code string, title string, link string, date timestamp, is_pdf boolean, "
    "content string, sentiment_score double, pdf_link string, crawled_at timestamp"
)

DIM_STOCK = columns(
    "stock_code string, exchange string, quote_type int, created_at timestamp, updated_at timestamp"
)

FACT_DAILY = columns(
    "stock_code string, trade_date date, open double, high double, low double, close double, volume bigint, "
    "change double, change_percent double, vwap double, market_hours int"
)

FACT_NEWS = columns(
    "stock_code string, news_date date, content string, article_id string, sentiment_score double"
)

FACT_PREDICTIONS = columns(
    "stock_code string, prediction_date date, predicted_price double, model_version string, "
    "confidence_score double, created_at timestamp"
)

MODEL_RUNS = columns("model_name string, date_train string, mse_loss double, alphas string")

ALPHA_METRICS = columns(
    "stock_code string, alpha_formula string, rank_ic double, pvalue double, n_samples bigint, "
    "date_calculated string"
)

RESULT_ROWS = columns(
    "stock_code string, predicted_price double, model_name string, confidence double, "
    "new_model_used boolean, saved boolean, error string, total_time double"
)
