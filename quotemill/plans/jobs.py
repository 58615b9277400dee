"""Jobs a user schedules: warehouse loads, news ingestion, the prediction run, the serving report."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill import schemas
from quotemill.functions.calendar import latest_trading_date, reference_date
from quotemill.functions.scalars import encode_list, null_if_zero, strip_suffix
from quotemill.operators import alphas as al
from quotemill.operators import market as mk
from quotemill.operators import predict as pr
from quotemill.operators.filters import bars_on
from quotemill.operators.indicators import feature_frame, fill_gaps
from quotemill.operators.joins import new_articles
from quotemill.operators.news import score_articles
from quotemill.session import settle
from quotemill.sources.articles import Layout, extract_articles
from quotemill.sources.tables import Table, high_water_mark, last_per_key, replace_by_key, upsert

ALPHAS = tuple(f"Alpha{i}" for i in range(1, al.FORMULAS_PER_STOCK + 1))
PRICE_FIELDS = ("open", "high", "low", "close", "volume", "change", "change_percent", "vwap", "market_hours")


def warehouse_tables(path: str) -> dict[str, Table]:
    return {
        "dim_stock": Table(f"{path}/dim_stock", schemas.DIM_STOCK, ("stock_code",)),
        "fact_daily_prices": Table(
            f"{path}/fact_daily_prices", schemas.FACT_DAILY, ("stock_code", "trade_date"), "trade_date"
        ),
        "fact_news": Table(
            f"{path}/fact_news", schemas.FACT_NEWS, ("stock_code", "news_date", "article_id"), "news_date"
        ),
        "fact_predictions": Table(
            f"{path}/fact_predictions", schemas.FACT_PREDICTIONS, ("stock_code", "prediction_date"), "prediction_date"
        ),
        "model_runs": Table(f"{path}/train_stock_model", schemas.MODEL_RUNS, ("model_name",)),
        "alpha_metrics": Table(f"{path}/stock_alpha_metrics", schemas.ALPHA_METRICS, ("stock_code", "alpha_formula")),
        "news": Table(f"{path}/stock_news", schemas.NEWS, ("stock_code", "date", "article_id"), "news_day", day_of="date"),
    }


def _since(source: DataFrame, column: str, loaded: Table, loaded_column: str, lookback_days: int) -> DataFrame:
    """Everything for an empty table, else rows from the day after the newest loaded one."""
    newest = high_water_mark(loaded.read(source.sparkSession), loaded_column).first()[0]
    if newest is None:
        return source
    start = newest + dt.timedelta(days=1 - lookback_days)
    return source.filter(F.col(column) >= F.lit(start).cast("date"))


def _upsert_dim(dim: Table, stocks: DataFrame) -> None:
    stamped = stocks.withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
    upsert(dim, stamped, update_cols=["exchange", "quote_type", "updated_at"])


def load_daily(
    summary: DataFrame, warehouse: dict[str, Table], lookback_days: int = 0, zero_as_null: bool = False
) -> None:
    """Daily summary rows into the star schema, from the day after the newest loaded one.

    A stock's venue is taken from its newest row.
    """
    fact = warehouse["fact_daily_prices"]
    rows = _since(summary, "trade_date", fact, "trade_date", lookback_days)
    rows = rows.withColumn("stock_code", strip_suffix("symbol"))
    if zero_as_null:
        rows = rows.withColumns({c: null_if_zero(c) for c in PRICE_FIELDS})
    venues = rows.select("stock_code", "exchange", "quote_type", "trade_date")
    _upsert_dim(warehouse["dim_stock"], last_per_key(venues, ["stock_code"], ["trade_date", "exchange"]))
    upsert(fact, rows.select("stock_code", "trade_date", *PRICE_FIELDS))


def load_news(news: DataFrame, warehouse: dict[str, Table], lookback_days: int = 0) -> None:
    """Articles into the star schema; a missing content is empty text, the time becomes its date.

    Articles that arrive later for a loaded day are only seen with ``lookback_days``.
    """
    fact = warehouse["fact_news"]
    rows = _since(news, "date", fact, "news_date", lookback_days).select(
        strip_suffix("stock_code").alias("stock_code"),
        F.to_date("date").alias("news_date"),
        F.coalesce("content", F.lit("")).alias("content"),
        "article_id",
        "sentiment_score",
    )
    dims = rows.select("stock_code").distinct()
    _upsert_dim(warehouse["dim_stock"], dims.select("stock_code", F.lit("NASDAQ").alias("exchange"), F.lit(1).alias("quote_type")))
    upsert(fact, rows, update_cols=["content", "sentiment_score"])


def news_ingest(pages: DataFrame, stored: Table, now: dt.datetime, layout: Layout | None = None, **scorers) -> None:
    """Article pages to scored news rows: extract, keep unknown ids, score, upsert.

    ``pages`` has article_id, stock_code, link and html. A PDF keeps no text; articles without any
    readable PDF link fall back to their own link.
    """
    crawled = extract_articles(pages, layout)
    fresh = new_articles(crawled, stored.read(pages.sparkSession))
    at = F.lit(now).cast("timestamp")
    rows = score_articles(fresh, **scorers).select(
        "article_id",
        "stock_code",
        "title",
        "link",
        at.alias("date"),
        "is_pdf",
        F.when(F.col("is_pdf"), F.lit("")).otherwise(F.coalesce("content", F.lit(""))).alias("content"),
        "sentiment_score",
        F.when(F.col("is_pdf"), F.coalesce("pdf_link", "link")).alias("pdf_link"),
        at.alias("crawled_at"),
    )
    upsert(stored, rows)


# --- prediction run -----------------------------------------------------------------------------


def alpha_frame(features: DataFrame, values: DataFrame, chosen: DataFrame) -> DataFrame:
    """Close and the chosen formulas' values as columns Alpha1.., gaps filled per stock."""
    picked = values.join(chosen.select("stock_code", "formula", "position"), ["stock_code", "formula"])
    wide = picked.groupBy("stock_code", "trade_date").agg(
        *[F.max(F.when(F.col("position") == i + 1, F.col("value"))).alias(a) for i, a in enumerate(ALPHAS)]
    )
    rows = features.select("stock_code", "trade_date", "close").join(wide, ["stock_code", "trade_date"])
    return fill_gaps(rows, list(ALPHAS))


@dataclass
class ModelStore:
    """Saved models of earlier runs, one folder per run stamp."""

    path: str

    def save(self, stamp: str, trained: pr.Trained) -> None:
        for kind, model in trained.models.items():
            model.write().overwrite().save(f"{self.path}/{stamp}/{kind}")
        trained.scaling.write.mode("overwrite").parquet(f"{self.path}/{stamp}/scaling")

    def load(self, spark: SparkSession, stamp: str) -> pr.Trained:
        kinds = {"Linear": LinearRegressionModel, "Trees": GBTRegressionModel}
        models = {k: c.load(f"{self.path}/{stamp}/{k}") for k, c in kinds.items()}
        scaling = spark.read.parquet(f"{self.path}/{stamp}/scaling")
        return pr.Trained(models, scaling.limit(0), scaling, ALPHAS)


def predict_all(
    prices: DataFrame,
    news: DataFrame,
    dim: DataFrame,
    catalog: DataFrame,
    warehouse: dict[str, Table],
    store: ModelStore,
    day: dt.date,
    stamp: str,
    trees: int = 20,
) -> DataFrame:
    """The whole run for one prediction date; returns one row per stock, good or failed.

    Features, formula scores, training and prediction are jobs over all stocks together. The steps
    are settled one after the other, so a lost executor costs one step and plans stay short.
    """
    spark = prices.sparkSession
    features = settle(feature_frame(prices, news, dim, day.isoformat()))
    pool = settle(al.formula_pool(catalog, warehouse["alpha_metrics"].read(spark)))
    values = settle(al.apply_alphas(features, pool))
    best = settle(al.select_best_alphas(al.rank_ic(values, al.next_returns(features))))
    frame = settle(alpha_frame(features, values, best))
    trained = pr.train_and_validate(frame, ALPHAS, trees=trees)

    formulas = best.groupBy("stock_code").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "formula"))), lambda r: r["formula"]).alias("f")
    )  # FORMULAS_PER_STOCK rows per stock
    new = trained.best().withColumn("model_name", pr.model_name("stock_code", F.lit(stamp), "model_type"))
    new = settle(new)
    today = day.strftime("%d/%m/%Y")
    yesterday = (day - dt.timedelta(days=1)).isoformat()
    runs = warehouse["model_runs"].read(spark)
    chosen = settle(pr.champion(new, pr.best_model(runs, day=yesterday)))

    registered = (
        new.join(chosen.filter("new_model_used").select("stock_code"), "stock_code", "left_semi")
        .join(formulas, "stock_code")
        .select("model_name", F.lit(today).alias("date_train"), "mse_loss", encode_list("f").alias("alphas"))
    )
    fresh = chosen.filter("new_model_used").join(new.select("stock_code", "model_type"), "stock_code")
    predicted = pr.predict_next_close(trained, frame, fresh)
    kept = _predict_with_old(spark, store, features, runs, chosen.filter("NOT new_model_used"))
    for part in kept:
        predicted = predicted.unionByName(part)

    done = chosen.join(predicted.select("stock_code", "predicted_price"), "stock_code").select(
        "stock_code", "predicted_price", "model_name", "confidence", "new_model_used"
    )
    ok = settle(pr.saveable(done.withColumn("confidence_score", F.col("confidence"))))
    store.save(stamp, trained)
    replace_by_key(warehouse["alpha_metrics"], al.alpha_metrics(best, today), ["stock_code"])
    upsert(warehouse["model_runs"], registered)
    upsert(
        warehouse["fact_predictions"],
        ok.select(
            "stock_code",
            F.lit(day).alias("prediction_date"),
            "predicted_price",
            F.col("model_name").alias("model_version"),
            "confidence_score",
            F.current_timestamp().alias("created_at"),
        ),
        update_cols=["predicted_price", "model_version", "confidence_score"],
    )
    return _result_rows(prices.select("stock_code").distinct(), features, best, ok)


def _predict_with_old(spark, store: ModelStore, features, runs, kept: DataFrame) -> list[DataFrame]:
    """Predictions of stocks that keep an earlier model, one pass per run stamp (at most a few)."""
    named = kept.join(runs.select("model_name", "alphas"), "model_name")
    parts = F.split("model_name", "_")
    named = named.select(
        "stock_code",
        F.concat_ws("_", F.element_at(parts, 3), F.element_at(parts, 4)).alias("stamp"),
        F.element_at(parts, 5).alias("model_type"),
        F.from_json("alphas", "array<string>").alias("f"),
    )
    named = settle(named)
    out = []
    for row in named.select("stamp").distinct().collect():
        part = named.filter(F.col("stamp") == row["stamp"])
        chosen = part.select("stock_code", F.posexplode("f").alias("pos", "formula"))
        chosen = chosen.withColumn("position", F.col("pos") + 1)
        values = al.apply_alphas(features, chosen)
        frame = alpha_frame(features, values, chosen)
        out.append(pr.predict_next_close(store.load(spark, row["stamp"]), frame, part))
    return out


def _result_rows(stocks: DataFrame, features: DataFrame, best: DataFrame, ok: DataFrame) -> DataFrame:
    """One row per stock; a stock without a prediction tells at which step it failed."""
    has_data = features.select("stock_code").distinct().withColumn("_data", F.lit(True))
    has_best = best.select("stock_code").distinct().withColumn("_best", F.lit(True))
    rows = stocks.join(has_data, "stock_code", "left").join(has_best, "stock_code", "left").join(
        ok.drop("confidence_score"), "stock_code", "left"
    )
    error = (
        F.when(F.col("_data").isNull(), "not enough prices")
        .when(F.col("_best").isNull(), "not enough usable formulas")
        .when(F.col("predicted_price").isNull(), "not enough windows or no finite prediction")
    )
    return rows.select(
        "stock_code",
        "predicted_price",
        "model_name",
        "confidence",
        "new_model_used",
        F.col("predicted_price").isNotNull().alias("saved"),
        error.alias("error"),
    )


# --- serving report -----------------------------------------------------------------------------


def serving_report(
    latest: DataFrame,
    daily: DataFrame,
    predictions: DataFrame,
    sectors: DataFrame,
    now: dt.datetime,
    whitelist: list[str] | DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Board, breadth, movers, sectors and prediction quality at one time.

    ``daily`` are finished bars with market symbols, ``predictions`` carry plain codes.
    """
    at = F.lit(now).cast("timestamp")
    reference = bars_on(daily, reference_date(at))
    today = bars_on(daily, latest_trading_date(at))
    board = mk.market_board(latest, reference, today, whitelist)
    closes = daily.select(strip_suffix("symbol").alias("stock_code"), "trade_date", "close")
    newest = pr.latest_predictions(predictions)
    return {
        "board": board,
        "breadth": mk.market_breadth(board),
        "gainers_losers": mk.gainers_losers(latest),
        "signed_movers": mk.signed_movers(board),
        "top_volume": mk.top_volume(board),
        "sector_volume": mk.sector_volume(board, sectors),
        "sector_leaders": mk.sector_top_volume(board, sectors),
        "prediction_trend": mk.prediction_trend(newest, reference),
        "accuracy": pr.prediction_accuracy(predictions, closes),
    }
