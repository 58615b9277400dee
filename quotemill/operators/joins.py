"""Joins of prices, news and predictions.

Bars hold one row per code and date, so news is aggregated to that grain before it is joined.
Where articles themselves are joined, those of a crowded day are spread over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions.calendar import prev_weekday
from quotemill.functions.scalars import article_key
from quotemill.operators.news import BROADCAST_KEYS, daily_sentiment, sized_broadcast

# A key with more rows than this is split over several tasks.
ROWS_PER_TASK = 1_000_000


def salted_join(
    many: DataFrame, one: DataFrame, keys: list[str], spread: list[str], per_key: DataFrame, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Inner join of a side with hot keys to a side with one row per key.

    ``per_key`` holds the row count ``n`` of each key of ``many``. Only keys over ``limit`` are
    salted: their rows are spread by their own ``spread`` columns over n / limit parts, and the one
    matching row is repeated for each part. There are at most (all rows / limit) such keys.
    """
    hot = per_key.filter(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("_parts"))
    hot = sized_broadcast(hot, BROADCAST_KEYS)
    salt = F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int")
    left = many.join(hot, keys, "left").withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_parts")
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    right = one.join(hot, keys, "left").withColumn("_salt", F.explode(parts)).drop("_parts")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def join_sentiment(prices: DataFrame, news: DataFrame) -> DataFrame:
    """Bars with the average sentiment of the day's articles, NULL without any."""
    return prices.join(daily_sentiment(news), ["stock_code", "trade_date"], "left")


def training_view(prices: DataFrame, dim: DataFrame, news: DataFrame, since: str) -> DataFrame:
    """Bars of known stocks, one row per article of the day, or one row without an article."""
    bars = (
        prices.filter(F.col("trade_date") >= F.lit(since).cast("date"))
        .join(dim.select("stock_code", "exchange"), "stock_code")
        .select("stock_code", "trade_date", "open", "high", "low", "close", "volume", "exchange")
    )
    keys = ["stock_code", "trade_date"]
    articles = news.select("stock_code", F.col("news_date").alias("trade_date"), "sentiment_score", "article_id")
    per_day = articles.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    with_news = salted_join(articles, bars, keys, ["article_id"], per_day)
    without = bars.join(per_day, keys, "left_anti").withColumns(
        {"sentiment_score": F.lit(None).cast("double"), "article_id": F.lit(None).cast("string")}
    )
    columns = [*bars.columns, "sentiment_score", "article_id"]
    return with_news.select(*columns).unionByName(without.select(*columns))


def join_related_sentiment(prices: DataFrame, news: DataFrame, related: DataFrame) -> DataFrame:
    """For each bar and partner of its stock: the partner's average sentiment that day (long form)."""
    pairs = related.select("stock_code", "partner")
    partner_news = daily_sentiment(news).select(
        F.col("stock_code").alias("partner"), "trade_date", F.col("polarity").alias("partner_polarity")
    )
    return (
        prices.select("stock_code", "trade_date")
        .join(pairs, "stock_code")
        .join(partner_news, ["partner", "trade_date"], "left")
        .select("stock_code", "trade_date", "partner", "partner_polarity")
    )


def related_sentiment_map(prices: DataFrame, news: DataFrame, related: DataFrame) -> DataFrame:
    """The same as one map per bar: {partner code in lower case: polarity, 0 where missing}."""
    long = join_related_sentiment(prices, news, related)
    entry = F.struct(F.lower("partner").alias("k"), F.coalesce("partner_polarity", F.lit(0.0)).alias("v"))
    # a stock has at most its k partners, so the list is short
    return long.groupBy("stock_code", "trade_date").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("related_polarity")
    )


def join_actuals(predictions: DataFrame, daily: DataFrame, how: str = "inner") -> DataFrame:
    """Predictions with the close of their date and of the weekday before; inner drops incomplete ones."""
    close = daily.select("stock_code", F.col("trade_date").alias("prediction_date"), F.col("close").alias("actual_close"))
    before = daily.select("stock_code", F.col("trade_date").alias("prev_date"), F.col("close").alias("prev_close"))
    return (
        predictions.withColumn("prev_date", prev_weekday("prediction_date"))
        .join(close, ["stock_code", "prediction_date"], how)
        .join(before, ["stock_code", "prev_date"], how)
    )


def new_articles(crawled: DataFrame, stored: DataFrame) -> DataFrame:
    return crawled.join(stored.select("article_id").distinct(), "article_id", "left_anti")


def unprocessed(news: DataFrame, done: DataFrame, n: int | None = None) -> DataFrame:
    """PDF articles with a link that are not in ``done``; optionally the first ``n`` by key."""
    keys = ["stock_code", "date", "article_id"]
    rows = news.filter(F.col("is_pdf") & (F.coalesce("pdf_link", F.lit("")) != ""))
    rows = rows.withColumn("article_key", article_key(*keys)).join(done.select(*keys).distinct(), keys, "left_anti")
    return rows if n is None else rows.orderBy("article_key").limit(n)


def attach_formulas(features: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every bar with each formula of its own stock."""
    return features.join(catalog.select("stock_code", "formula").distinct(), "stock_code")
