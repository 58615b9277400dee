"""The generated benchmark tables as domain tables. Only this module knows their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions.calendar import next_weekday
from quotemill.operators.bars import daily_bars
from quotemill.operators.news import WORD_BREAK
from quotemill.operators.runs import before_row, carry_in, run_end, so_far, with_runs
from quotemill.session import use_utc

TICK_SYMBOLS = 20
BAR_SYMBOLS = 10
MENTION_CODES = 30
TRADE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

# The formulas the factor queries score; a parameter of the queries, as a user would pass it.
FORMULAS = (
    "(close - SMA_20) / SMA_20",
    "Alpha2 = (RSI_14 - 50) / 50",
    "Momentum_3 - Momentum_10",
    "(BB_Upper - close) / (BB_Upper - BB_Lower)",
    "MACD - MACD_Signal",
    "(high - low) / open * volume",
)
CHECKED_FORMULAS = (*FORMULAS, "close.shift(1)", "close / missing", "((close)", "close >= open", "a = ", "close ×2")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades: symbol, price, size and session flag, without running values."""
    n = F.pmod("user_id", F.lit(TICK_SYMBOLS))
    return events(spark, sf_dir).select(
        F.concat(F.lit("S"), n.cast("string"), F.lit(".VN")).alias("symbol"),
        F.col("value").alias("price"),
        F.unix_millis("ts").cast("string").alias("timestamp"),
        F.concat(F.lit("E"), (n % 3).cast("string")).alias("exchange"),
        F.lit(1).alias("quote_type"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("market_hours"),
        F.get_json_object("props", "$.k").cast("bigint").alias("last_size"),
        F.lit("2").alias("price_hint"),
        F.unix_millis("ts").alias("producer_timestamp"),
        F.col("ts").alias("event_ts"),
        F.col("event_id").alias("seq"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with day volume and change against the tick before, for symbols of any size."""
    keys, order = ["symbol", "trade_date"], ("event_ts", "seq")
    rows = with_runs(raw_ticks(spark, sf_dir).withColumn("trade_date", F.to_date("event_ts")), keys, order)
    rows = carry_in(
        rows,
        keys,
        {"_size": F.sum("last_size"), "_end": run_end(rows, "price", order)},
        {"_size_in": (F.sum("_size"), keys), "_price_in": (F.last("_end"), ["symbol"])},
    )
    rows = rows.withColumn("_prev", before_row("price", "_price_in", keys, order))
    change = F.col("price") - F.col("_prev")
    return rows.select(
        "symbol",
        "price",
        "timestamp",
        "exchange",
        "quote_type",
        "market_hours",
        (F.try_divide(change, F.col("_prev")) * 100.0).alias("change_percent"),
        (F.sum("last_size").over(so_far(keys, order)) + F.coalesce("_size_in", F.lit(0))).alias("day_volume"),
        change.alias("change"),
        "last_size",
        "price_hint",
        "producer_timestamp",
        "event_ts",
        "seq",
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trades of ten stocks."""
    return load(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.pmod("l_partkey", F.lit(BAR_SYMBOLS)).cast("string")).alias("symbol"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("bigint").alias("last_size"),
        F.lit(1).alias("market_hours"),
        F.col("l_shipdate").cast("timestamp").alias("event_ts"),
        *TRADE_ORDER,
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars, one per stock and date, unrounded."""
    out = daily_bars(trades(spark, sf_dir), vwap_mode="traded", order=TRADE_ORDER, rounded=False)
    return out.withColumnRenamed("symbol", "stock_code")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    day = F.date_add(F.lit("1995-01-02").cast("date"), F.pmod("doc_id", F.lit(365)).cast("int"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("article_id"),
        F.concat(F.lit("S"), F.pmod("doc_id", F.lit(BAR_SYMBOLS)).cast("string")).alias("stock_code"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string")).alias("link"),
        day.cast("timestamp").alias("date"),
        day.alias("news_date"),
        (F.pmod("doc_id", F.lit(4)) == 0).alias("is_pdf"),
        F.col("text").alias("content"),
        (F.col("quality") - F.col("toxic")).cast("double").alias("sentiment_score"),
        F.when(F.pmod("doc_id", F.lit(4)) == 0, F.concat(F.lit("https://files.example/"), F.col("doc_id").cast("string"))).alias("pdf_link"),
        F.col("doc_id"),
    )


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stock_code, n) of every stock that trades or has ticks."""
    ticked = events(spark, sf_dir).select(F.pmod("user_id", F.lit(TICK_SYMBOLS)).alias("n"))
    traded = load(spark, sf_dir, "lineitem").select(F.pmod("l_partkey", F.lit(BAR_SYMBOLS)).alias("n"))
    both = ticked.distinct().union(traded.distinct()).distinct()
    return both.select(F.concat(F.lit("S"), F.col("n").cast("string")).alias("stock_code"), "n")


def dim_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(spark, sf_dir).select(
        "stock_code", F.concat(F.lit("E"), (F.col("n") % 3).cast("string")).alias("exchange"), F.lit(1).alias("quote_type")
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock n belongs to the sector named after region n mod 5."""
    regions = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("_k"), F.col("r_name").alias("sector"))
    return codes(spark, sf_dir).withColumn("_k", (F.col("n") % 5).cast("int")).join(regions, "_k").select("stock_code", "sector")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each weekday bar a price for the next weekday, up to 3 % off the close."""
    rows = bars(spark, sf_dir).filter(F.weekday("trade_date") < 5)
    n = F.row_number().over(Window.partitionBy("stock_code").orderBy("trade_date"))
    rows = rows.withColumn("n", n)
    return rows.select(
        "stock_code",
        next_weekday("trade_date").alias("prediction_date"),
        (F.col("close") * (1.0 + (F.col("n") % 7 - 3) / 100.0)).alias("predicted_price"),
        F.lit("shifted_close").alias("model_version"),
        (1.0 / (1.0 + F.col("n") % 5)).alias("confidence_score"),
    )


def mention_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words found in most documents, numbered, as the list of codes."""
    words = F.explode(F.array_distinct(F.split(F.lower("text"), WORD_BREAK))).alias("stock_code")
    tokens = load(spark, sf_dir, "documents").select(words).filter(F.col("stock_code").rlike(r"^\p{L}{2,}$"))
    counts = tokens.groupBy("stock_code").agg(F.count(F.lit(1)).alias("df"))
    top = counts.orderBy(F.desc("df"), "stock_code").limit(MENTION_CODES)
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("df"), "stock_code")) - 1
    return top.select("stock_code", number.alias("n"))


def mention_news(spark: SparkSession, sf_dir: str, own: DataFrame | None = None) -> DataFrame:
    """Documents as articles of the mention codes (``own``, where they are known already)."""
    docs = load(spark, sf_dir, "documents").withColumn("n", F.pmod("doc_id", F.lit(MENTION_CODES)).cast("int"))
    own = F.broadcast(own if own is not None else mention_codes(spark, sf_dir))  # 30 rows
    day = F.date_add(F.lit("1995-01-02").cast("date"), F.pmod("doc_id", F.lit(365)).cast("int"))
    return docs.join(own, "n").select(
        F.col("doc_id").cast("string").alias("article_id"),
        "stock_code",
        F.col("text").alias("content"),
        day.alias("news_date"),
        F.lit(None).cast("double").alias("sentiment_score"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages")


def samples(ticked: DataFrame) -> DataFrame:
    """The day volume of each symbol as a counter that restarts every day."""
    return ticked.select(
        F.col("symbol"), F.col("event_ts").alias("ts"), "seq", F.col("day_volume").cast("double").alias("value")
    )


def change_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events with their latency."""
    n = F.pmod("user_id", F.lit(TICK_SYMBOLS)).cast("string")
    return events(spark, sf_dir).select(
        F.concat(F.lit("S"), n).alias("symbol"),
        "ts",
        F.col("event_id").alias("seq"),
        (F.col("value") * 10.0).alias("latency_ms"),
        F.col("event_type").alias("module"),
    )


def catalog(spark: SparkSession, sf_dir: str, formulas: tuple[str, ...] = FORMULAS) -> DataFrame:
    """Every stock with every formula."""
    texts = F.posexplode(F.array(*[F.lit(f) for f in formulas])).alias("pos", "formula")
    return bars(spark, sf_dir).select("stock_code").distinct().select("stock_code", texts)
