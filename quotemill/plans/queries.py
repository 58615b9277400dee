"""Every operator as a query over the benchmark tables, whole tables each time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill import schemas
from quotemill.functions import calendar as cal
from quotemill.functions import scalars as sc
from quotemill.functions.formula import formula_column
from quotemill.operators import alphas as al
from quotemill.operators import bars as br
from quotemill.operators import filters as fl
from quotemill.operators import indicators as ind
from quotemill.operators import joins as jn
from quotemill.operators import market as mk
from quotemill.operators import metrics as mt
from quotemill.operators import news as nw
from quotemill.operators import predict as pr
from quotemill.plans import jobs
from quotemill.session import scratch, settle, ship_package, stored
from quotemill.sources import adapters as ad
from quotemill.sources import articles as ar
from quotemill.sources import files as fs
from quotemill.sources import tables as tb
from quotemill.streaming import pipeline as sp

NOW = dt.datetime(2024, 1, 30, 2, 30)
NEWS_NOW = dt.datetime(1995, 12, 20, 12, 0)
VALID_FROM = "1995-06-01"


class Domain:
    """Domain tables of one data folder, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship_package(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        table = getattr(ad, name, None)
        if table is None or name.startswith("_"):
            raise AttributeError(name)
        made = table(self.spark, self.sf_dir)
        setattr(self, name, made)
        return made

    @cached_property
    def ticks(self) -> DataFrame:
        """The ticks as a stored table, as the stream leaves them; most queries scan it more than once."""
        return stored(ad.ticks(self.spark, self.sf_dir), "ticks")

    @cached_property
    def daily(self) -> DataFrame:
        """Finished daily bars of the valid ticks, with market symbols."""
        return br.finalize_daily(br.daily_bars(fl.valid_ticks(self.ticks)))

    @cached_property
    def samples(self) -> DataFrame:
        return ad.samples(self.ticks)

    @cached_property
    def latest(self) -> DataFrame:
        return br.latest_by_symbol(self.ticks)

    @cached_property
    def board(self) -> DataFrame:
        at = F.lit(NOW).cast("timestamp")
        reference = fl.bars_on(self.daily, cal.reference_date(at))
        today = fl.bars_on(self.daily, cal.latest_trading_date(at))
        return mk.market_board(self.latest, reference, today)

    @cached_property
    def daily_codes(self) -> DataFrame:
        return self.daily.select(sc.strip_suffix("symbol").alias("stock_code"), "trade_date", "close")

    @cached_property
    def mention_codes(self) -> DataFrame:
        """The 30 codes; found once, as the articles and the look-up both need them."""
        return settle(ad.mention_codes(self.spark, self.sf_dir))

    @cached_property
    def mention_news(self) -> DataFrame:
        return ad.mention_news(self.spark, self.sf_dir, self.mention_codes)

    @cached_property
    def features(self) -> DataFrame:
        return ind.feature_frame(self.bars, self.news, self.dim_stock)


def r(x: Column | str, digits: int = 4, nudge: float = 0.0) -> Column:
    """Rounded for comparison, without negative zero; ``nudge`` settles values that end in a half."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x + nudge if nudge else x, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Domain(spark, sf_dir))
    return build


# --- sources and sinks --------------------------------------------------------------------------

TICK_COLUMNS = ["symbol", "price", "change", "change_percent", "day_volume", "last_size", "market_hours", "event_ts", "seq"]


@query
def ticks(t):
    return ad.ticks(t.spark, t.sf_dir).select(*TICK_COLUMNS, "timestamp", "exchange", "producer_timestamp")


@query
def normalized_quotes(t):
    quotes = t.raw_ticks.select(
        F.col("symbol").alias("id"),
        F.when(F.col("last_size") > 10, F.col("price").cast("string")).alias("price"),
        F.col("timestamp").alias("time"),
        F.when(F.col("market_hours") == 1, F.col("exchange")).alias("exchange"),
        F.col("last_size").cast("string").alias("last_size"),
        "seq",
    )
    out = fs.normalize_quotes(quotes, produced_at=F.col("seq"))
    return out.withColumnRenamed("producer_timestamp", "seq")


@query
def daily_csv_round_trip(t):
    path = scratch(t.spark, "csv")
    rows = t.bars.withColumn("symbol", F.col("stock_code")).select(
        *[F.col(f.name) if f.name in (*t.bars.columns, "symbol") else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.DAILY]
    )
    fs.export_csv(rows, path)
    good, _ = fs.load_daily_csv(t.spark, path)
    return good.select("symbol", "trade_date", "open", "high", "low", "close", "volume", "change")


@query
def bars_csv_round_trip(t):
    path = scratch(t.spark, "csv")
    rows = br.minute_bars(t.ticks).withColumns(
        {"ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSSXX"), "interval": F.lit(None).cast("string")}
    )
    fs.export_csv(rows, path)
    good, _ = fs.load_bars_csv(t.spark, path)
    return good.select("symbol", "bucket_date", "interval", "ts", "open", "high", "low", "close", "volume")


@query
def news_csv_round_trip(t):
    path = scratch(t.spark, "csv")
    rows = t.news.select(
        *[F.col(f.name) if f.name in t.news.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.NEWS]
    ).withColumns({"date": F.date_format("date", "yyyy-MM-dd HH:mm:ss"), "is_pdf": F.when(F.col("is_pdf"), "Yes").otherwise("no")})
    fs.export_csv(rows, path)
    good, _ = fs.load_news_csv(t.spark, path)
    return good.select("article_id", "stock_code", "date", "is_pdf", F.length("content").cast("bigint").alias("content_chars"))


@query
def upsert_daily(t):
    """Stored bars up to a day, then changed and new bars on top."""
    month = F.trunc("trade_date", "month").alias("month")
    monthly = t.bars.groupBy("stock_code", month).agg(F.max("high").alias("high"), F.sum("volume").alias("volume"))
    table = tb.Table(scratch(t.spark, "table") + "/bars", monthly.schema, ("stock_code", "month"), "month")
    tb.upsert(table, monthly.filter(F.col("month") < F.lit("1999-01-01").cast("date")))
    changed = monthly.filter(F.col("month") >= F.lit("1998-06-01").cast("date")).withColumn("volume", F.col("volume") + 1)
    tb.upsert(table, changed, update_cols=["volume"])
    return table.read(t.spark)


@query
def upsert_keep_stored(t):
    base = t.bars.groupBy("stock_code").agg(F.sum("volume").alias("volume"))
    fresh = t.codes.select("stock_code", F.lit(-1).cast("bigint").alias("volume"))
    return tb.merge(base, fresh, ["stock_code"], do_nothing=True)


@query
def replace_formulas(t):
    """A stock's stored formulas are deleted and its new ones inserted."""
    table = tb.Table(scratch(t.spark, "table") + "/alphas", schemas.ALPHA_METRICS, ("stock_code", "alpha_formula"))
    base = t.catalog.select(
        "stock_code", F.col("formula").alias("alpha_formula"), (F.col("pos") / 10.0).alias("rank_ic"),
        F.lit("01/01/2024").alias("date_calculated"),
    )
    tb.upsert(table, base)
    fresh = base.filter((F.col("rank_ic") < 0.2) & (F.col("stock_code") < "S5")).withColumn("date_calculated", F.lit("02/01/2024"))
    tb.replace_by_key(table, fresh, ["stock_code"])
    return table.read(t.spark).select("stock_code", "alpha_formula", "rank_ic", "date_calculated")


@query
def delete_formulas(t):
    """Stored formulas of some stocks are deleted; a list that names others too changes nothing for them."""
    table = tb.Table(scratch(t.spark, "table") + "/alphas", schemas.ALPHA_METRICS, ("stock_code", "alpha_formula"))
    tb.upsert(table, t.catalog.select("stock_code", F.col("formula").alias("alpha_formula"), (F.col("pos") / 10.0).alias("rank_ic")))
    gone = t.codes.filter(F.col("stock_code") >= "S6").select("stock_code")
    tb.delete_by_key(table, gone.unionByName(gone.select(F.concat(F.lit("no"), "stock_code").alias("stock_code"))), ["stock_code"])
    return table.read(t.spark).select("stock_code", "alpha_formula", "rank_ic")


@query
def article_links(t):
    out = ar.article_links(t.pages, "page_id")
    return out.select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")


@query
def extracted_articles(t):
    layout = ar.Layout(body_id=None, paragraph_class=None)
    return ar.extract_articles(t.pages.select("page_id", "html"), layout).select(
        "page_id", "title", F.size("links").alias("n_links"), "is_pdf", "content"
    )


@query
def page_titles(t):
    layout = ar.Layout(body_id=None, paragraph_class=None)
    out = ar.extract_articles(t.pages.select("page_id", "html"), layout)
    return out.select("page_id", "title", F.size("links").cast("bigint").alias("n_links"), "is_pdf")


@query
def alpha_catalog(t):
    """A file for each stock, {stock: [formulas]}, read back as rows."""
    path = scratch(t.spark, "catalog")
    listed = t.catalog.groupBy("stock_code").agg(F.array_sort(F.collect_list(F.struct("pos", "formula"))).alias("f"))
    # a stock has a short list of formulas
    text = F.to_json(F.create_map("stock_code", F.col("f.formula")))
    listed.select("stock_code", text.alias("value")).write.partitionBy("stock_code").text(path)
    good, _ = fs.read_alpha_catalog(t.spark, path)
    return good.select("stock_code", F.col("pos").cast("bigint").alias("pos"), "formula")


@query
def result_rows(t):
    """Result files of several batches, one for each stock and year, read as one table."""
    path = scratch(t.spark, "results")
    rows = _results(t.bars, "trade_date").withColumn("batch", F.concat_ws("-", "stock_code", F.year("trade_date")))
    # a batch holds a year's days at most
    listed = rows.groupBy("batch").agg(F.collect_list(F.struct("stock_code", "predicted_price", "error")).alias("r"))
    listed.select("batch", F.to_json("r").alias("value")).write.partitionBy("batch").text(path)
    return fs.read_results(t.spark, path).select("stock_code", "predicted_price", "error")


@query
def cleaned_columns(t):
    odd = t.bars.select("stock_code", F.col("trade_date").alias("trade date"), F.col("close").alias("close price (VND)"))
    return sc.clean_column_names(odd)


# --- filters ------------------------------------------------------------------------------------


@query
def valid_ticks(t):
    return fl.valid_ticks(t.ticks).select(*TICK_COLUMNS)


@query
def session_flag_ticks(t):
    return fl.in_session(t.ticks).select(*TICK_COLUMNS)


@query
def basket_latest(t):
    basket = t.codes.filter(F.col("n") < 5).select(sc.market_symbol("stock_code").alias("symbol"))
    return fl.in_basket(t.latest, basket).select("symbol", "price", "seq")


@query
def session_ticks(t):
    return fl.session_ticks(t.ticks, "S3.VN", "2024-01-16").select(*TICK_COLUMNS)


@query
def week_ticks(t):
    return fl.week_ticks(t.ticks, "S3.VN", "2024-01-21").select(*TICK_COLUMNS)


@query
def daily_range(t):
    out = fl.daily_range(t.daily, "S3.VN", "2024-01-08", "2024-01-19")
    return out.select("symbol", "trade_date", "open", "high", "low", "close", "volume")


@query
def bars_on_date(t):
    day = cal.latest_trading_date(F.lit(NOW).cast("timestamp"))
    return fl.bars_on(t.daily, day).select("symbol", "trade_date", "open", "high", "low", "close", "volume")


NEWS_COLUMNS = ("article_id", "stock_code", "date", "is_pdf")


@query
def news_filtered(t):
    codes = t.sectors.filter(F.col("sector") == "ASIA").select("stock_code")
    parts = {
        "dates": fl.news_filter(t.news, NEWS_NOW, from_date="1995-03-01", to_date="1995-03-31"),
        "today": fl.news_filter(t.news, NEWS_NOW, time_filter="today"),
        "week": fl.news_filter(t.news, NEWS_NOW, time_filter="week"),
        "month": fl.news_filter(t.news, NEWS_NOW, codes=codes, time_filter="month"),
        "year": fl.news_filter(t.news, NEWS_NOW, codes=codes, search="the"),
    }
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("filter_name"), *NEWS_COLUMNS)
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def news_text_search(t):
    return fl.text_search(t.news, "the%and").select(*NEWS_COLUMNS)


@query
def news_recent(t):
    out = None
    for mode, span in {"today": {}, "week": {}, "month": {}, "custom": {"start": "1995-02-01", "end": "1995-02-10"}}.items():
        rows = fl.news_recent_filter(t.news, mode, NEWS_NOW, **span).select(F.lit(mode).alias("filter_name"), *NEWS_COLUMNS)
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def high_sentiment(t):
    return fl.high_sentiment(t.news, 0.5, 10).select("stock_code", "news_date", "sentiment_score", "article_id")


@query
def future_predictions(t):
    return fl.future_predictions(t.predictions, "2000-01-01").select("stock_code", "prediction_date", "predicted_price")


# --- joins --------------------------------------------------------------------------------------


@query
def prices_with_sentiment(t):
    out = jn.join_sentiment(t.bars, t.news).select("stock_code", "trade_date", "close", "volume", "polarity")
    return rounded(out, "polarity")


@query
def training_view(t):
    out = jn.training_view(t.bars, t.dim_stock, t.news, "1995-01-01")
    return out.select("stock_code", "trade_date", "open", "close", "volume", "exchange", "sentiment_score", "article_id")


@query
def related_sentiment(t):
    related = t.sectors.alias("a").join(t.sectors.alias("b"), "sector")
    pairs = related.select(F.col("a.stock_code").alias("stock_code"), F.col("b.stock_code").alias("partner")).filter("stock_code <> partner")
    return rounded(jn.join_related_sentiment(t.bars, t.news, pairs), "partner_polarity")


@query
def partner_sentiment(t):
    """On each day with news of a stock: the sentiment of the five companies named most often with it."""
    scored = t.mention_news.drop("sentiment_score").join(t.news.select("article_id", "sentiment_score"), "article_id")
    days = t.mention_news.select("stock_code", F.col("news_date").alias("trade_date")).distinct()
    partners = nw.related_companies(t.mention_news, t.mention_codes, k=5)
    return rounded(jn.join_related_sentiment(days, scored, partners), "partner_polarity")


@query
def prediction_actuals(t):
    return jn.join_actuals(t.predictions, t.bars).select(
        "stock_code", "prediction_date", "predicted_price", "prev_date", "prev_close", "actual_close"
    )


@query
def prediction_trends(t):
    at = F.lit(NOW).cast("timestamp")
    out = mk.prediction_trend(pr.latest_predictions(t.predictions), fl.bars_on(t.daily, cal.reference_date(at)))
    return out.select("stock_code", "prediction_trend", "confidence_score")


@query
def market_board(t):
    return t.board


@query
def new_articles(t):
    return jn.new_articles(t.news, t.news.filter(F.col("sentiment_score").isNotNull())).select("article_id", "stock_code")


@query
def unprocessed_pdfs(t):
    done = t.news.filter(F.col("sentiment_score") > 0)
    return jn.unprocessed(t.news, done).select("article_id", "stock_code", "pdf_link")


@query
def news_with_sector(t):
    return nw.with_sector(t.news, t.sectors).select("article_id", "stock_code", "sector")


@query
def mention_pairs(t):
    return nw.mention_pairs(t.mention_news, t.mention_codes)


@query
def attached_formulas(t):
    out = jn.attach_formulas(t.bars.select("stock_code", "trade_date"), t.catalog)
    return out.groupBy("stock_code", "formula").agg(F.count(F.lit(1)).alias("n_rows"), F.max("trade_date").alias("last_date"))


# --- aggregations -------------------------------------------------------------------------------


@query
def latest_by_symbol(t):
    return t.latest.select(*TICK_COLUMNS)


@query
def daily_bars(t):
    out = br.daily_bars(fl.valid_ticks(t.ticks), rounded=False)
    return out.withColumn("vwap", r("vwap", nudge=1e-9))


@query
def daily_bars_traded(t):
    return t.bars.withColumn("vwap", r("vwap", nudge=1e-9))


@query
def finalized_daily(t):
    return t.daily.drop("vwap")


@query
def minute_bars(t):
    return br.minute_bars(t.raw_ticks, rounded=False).withColumn("vwap", r("vwap", nudge=1e-9))


@query
def hourly_bars(t):
    return br.bars(t.raw_ticks, "1h", rounded=False).withColumn("vwap", r("vwap", nudge=1e-9))


@query
def five_minute_rollup(t):
    out = br.rollup_bars(br.minute_bars(t.raw_ticks, rounded=False), "5m")
    return out.withColumn("vwap", r("vwap", nudge=1e-9))


@query
def daily_rollup(t):
    out = br.rollup_bars(br.minute_bars(t.raw_ticks, rounded=False), "1d")
    return out.withColumn("vwap", r("vwap", nudge=1e-9))


@query
def daily_sentiment(t):
    return rounded(nw.daily_sentiment(t.news), "polarity")


@query
def related_companies(t):
    out = nw.related_companies(t.mention_news, t.mention_codes)
    return out.select("stock_code", "partner", "n_articles", F.col("position").cast("bigint").alias("position"))


@query
def distinct_symbols(t):
    return tb.distinct_symbols(t.raw_ticks)


@query
def high_water_marks(t):
    empty = tb.high_water_mark(t.bars.filter(F.col("stock_code") == ""), "trade_date")
    full = tb.high_water_mark(t.bars, "trade_date")
    return full.select(F.lit("bars").alias("table_name"), "high_water_mark").unionByName(
        empty.select(F.lit("none").alias("table_name"), "high_water_mark")
    )


@query
def dedupe_first(t):
    rows = t.raw_ticks.select("symbol", "exchange", "quote_type", "seq", F.col("price"))
    return tb.dedupe_first(rows, ["symbol"], ["seq"])


@query
def sector_counts(t):
    return nw.sector_counts(t.news, t.sectors)


@query
def news_by_sector(t):
    out = nw.news_by_sector(t.news, t.sectors)
    return rounded(out, "share_percent").withColumn("position", F.col("position").cast("bigint"))


@query
def market_breadth(t):
    return rounded(mk.market_breadth(t.board), "avg_change_percent")


@query
def sector_volume(t):
    return rounded(mk.sector_volume(t.board, t.sectors), "share_percent")


@query
def prediction_accuracy(t):
    return pr.prediction_accuracy(t.predictions, t.bars)


@query
def period_summary(t):
    return rounded(pr.period_summary(t.bars, 180), "avg_volume")


@query
def session_summary(t):
    return br.session_summary(fl.valid_ticks(t.ticks))


@query
def table_counts(t):
    return tb.table_counts({"bars": t.bars, "news": t.news, "dim_stock": t.dim_stock, "predictions": t.predictions})


def _results(bars, *more):
    """Prediction results: bars with a high close count as failed."""
    failed = F.when(F.col("close") > 2000, F.concat(F.lit("price "), F.col("stock_code")))
    return bars.select("stock_code", F.col("close").alias("predicted_price"), failed.alias("error"), *more)


@query
def run_summary(t):
    path = scratch(t.spark, "results")
    _results(t.bars).write.json(path)
    rows = t.spark.read.schema(schemas.RESULT_ROWS).json(path)
    return pr.run_summary(rows)


@query
def formula_audit(t):
    return al.audit_formulas(ad.catalog(t.spark, t.sf_dir, ad.CHECKED_FORMULAS))


# --- windows and time series --------------------------------------------------------------------


@query
def moving_averages(t):
    out = t.bars.select("stock_code", "trade_date", ind.sma(5).alias("sma_5"), ind.sma(20).alias("sma_20"))
    return out.withColumns({c: r(c, nudge=1e-9) for c in ("sma_5", "sma_20")})


@query
def rate_of_change(t):
    return t.bars.select("stock_code", "trade_date", ind.roc(3).alias("roc_3"), ind.roc(10).alias("roc_10"))


@query
def bollinger_bands(t):
    upper, lower = ind.bollinger()
    out = t.bars.select("stock_code", "trade_date", upper.alias("bb_upper"), lower.alias("bb_lower"))
    return rounded(out, "bb_upper", "bb_lower", digits=3)


@query
def on_balance_volume(t):
    return ind.obv(t.bars, "obv").select("stock_code", "trade_date", "obv")


@query
def recursive_indicators(t):
    out = ind.recursive_indicators(t.bars.select("stock_code", "trade_date", "close"))
    out = out.select(
        "stock_code", "trade_date", F.col("EMA_10").alias("ema_10"), F.col("RSI_14").alias("rsi_14"),
        F.col("MACD").alias("macd"), F.col("MACD_Signal").alias("macd_signal"),
    )
    return rounded(out, "ema_10", "rsi_14", "macd", "macd_signal")


@query
def feature_frame(t):
    out = t.features.select(
        "stock_code", "trade_date", "close", F.col("SMA_20").alias("sma_20"), F.col("EMA_10").alias("ema_10"),
        F.col("MACD_Signal").alias("macd_signal"), F.col("OBV").alias("obv"), "polarity",
    )
    return rounded(out, "ema_10", "macd_signal", "polarity").withColumn("sma_20", r("sma_20", nudge=1e-9))


@query
def forward_returns(t):
    return t.bars.select("stock_code", "trade_date", ind.forward_return(1).alias("future_return"))


@query
def training_sequences(t):
    out = pr.sequences(t.bars, ["open", "volume"])
    return out.select(
        "stock_code", "first_date", "last_date", "target_date", "target",
        F.element_at("closes", 1).alias("first_close"),
        F.element_at(F.element_at("inputs", -1), 2).alias("last_volume"),
        F.element_at(F.element_at("calendar", -1), 2).alias("last_weekday"),
    )


@query
def minmax_scaling(t):
    fitted = pr.minmax_fit(t.bars, ["close", "volume"])
    scaled = pr.minmax_apply(t.bars, fitted, ["close", "volume"])
    back = pr.minmax_invert(scaled, fitted, "close_scaled", "close", "close_again")
    out = back.select("stock_code", "trade_date", "close_scaled", "volume_scaled", "close_again")
    return rounded(out, "close_scaled", "volume_scaled").withColumn("close_again", r("close_again", nudge=1e-9))


@query
def running_high_low(t):
    return mk.running_high_low(t.raw_ticks).select("symbol", "event_ts", "seq", "price", "running_high", "running_low")


@query
def session_high_low(t):
    out = mk.running_high_low(t.raw_ticks, trading_hours=True)
    return out.select("symbol", "event_ts", "seq", "price", "running_high", "running_low")


def _quiet(t):
    """Ticks in which two thirds of the changes count as unchanged."""
    moved = F.col("seq") % 3 == 0
    return t.ticks.withColumns({c: F.when(moved, F.col(c)).otherwise(0.0) for c in ("change", "change_percent")})


@query
def carried_change(t):
    out = mk.carry_change(_quiet(t), ttl="6 hours")
    return out.select("symbol", "event_ts", "seq", "shown_change", "shown_change_percent")


@query
def carried_apart(t):
    """Changes and percents that pause on different ticks."""
    pause = {"change": F.col("seq") % 3 != 0, "change_percent": F.col("seq") % 5 != 0}
    rows = t.ticks.withColumns({c: F.when(p, 0.0).otherwise(F.col(c)) for c, p in pause.items()})
    return mk.carry_change(rows, ttl="6 hours").select("symbol", "event_ts", "seq", "shown_change", "shown_change_percent")


@query
def tick_direction(t):
    rows = t.ticks.withColumn("price", F.floor(F.col("price") / 20) * 1.0)
    out = mk.tick_direction(rows)
    return out.select("symbol", "seq", "price_direction", "volume_direction", "change_direction", "change_percent_direction")


@query
def collapsed_seconds(t):
    rows = t.ticks.withColumn("event_ts", F.date_trunc("hour", "event_ts"))
    return br.collapse_by_second(rows)


@query
def last_bars(t):
    return pr.tail_by_key(t.bars, 50).select("stock_code", "trade_date", "close")


@query
def filled_gaps(t):
    holes = t.bars.withColumns(
        {
            "a": F.when(F.day("trade_date") > 20, F.lit(float("inf"))).when(F.day("trade_date") > 5, F.col("close")),
            "b": F.lit(None).cast("double"),
        }
    )
    return ind.fill_gaps(holes.select("stock_code", "trade_date", "a", "b"), ["a", "b"])


@query
def calendar_features(t):
    return cal.calendar_features(t.bars.select("stock_code", "trade_date"))


@query
def prediction_history(t):
    return pr.prediction_history(t.predictions, t.bars, 30)


@query
def next_day_outlook(t):
    return pr.next_day_outlook(t.predictions, t.bars).select("stock_code", "last_date", "last_close", "prediction_date", "trend")


@query
def candle_changes(t):
    return br.candle_change(t.bars).select("stock_code", "trade_date", "candle_change", "candle_percent")


# --- sort, limit, top-k -------------------------------------------------------------------------


@query
def gainers_losers(t):
    out = mk.gainers_losers(t.latest)
    return out.select("side", F.col("position").cast("bigint").alias("position"), "symbol", "price", "change_percent")


@query
def signed_movers(t):
    return mk.signed_movers(t.board)


@query
def top_volume(t):
    out = mk.top_volume(t.board, 10)
    return out.select("symbol", "volume", "volume_millions", "direction", F.col("position").cast("bigint").alias("position"))


@query
def sector_top_volume(t):
    out = mk.sector_top_volume(t.board, t.sectors, k=3)
    return out.select("sector", "symbol", "volume", F.col("position").cast("bigint").alias("position"))


@query
def sector_ranking(t):
    by_price = mk.sector_ranking(t.board, t.sectors, "ASIA", "price").withColumn("mode", F.lit("price"))
    by_change = mk.sector_ranking(t.board, t.sectors, "ASIA", "percentage").withColumn("mode", F.lit("percentage"))
    return by_price.unionByName(by_change)


@query
def recent_news(t):
    return nw.recent_news(t.news, NEWS_NOW, 30, 20).select(*NEWS_COLUMNS)


@query
def latest_predictions(t):
    return pr.latest_predictions(t.predictions)


@query
def predictions_history(t):
    return pr.predictions_history(t.predictions, "S4")


@query
def latest_snapshot(t):
    return mk.latest_snapshot(t.latest)


@query
def news_of_symbol(t):
    text_dates = t.news.withColumn("date", F.date_format("date", "dd-MM-yyyy"))
    return nw.sort_news(nw.news_by_symbol(text_dates, "S4")).select("article_id", "stock_code", "date")


@query
def news_page(t):
    order = [F.desc("date"), F.col("doc_id")]
    return nw.page(t.news, 3, order).select("article_id", "stock_code", "date", "total_pages")


def _model_runs(t):
    """One training run per stock, month and model type, with a loss from the bars."""
    month = F.trunc("trade_date", "month")
    loss = t.bars.groupBy("stock_code", month.alias("m")).agg((1.0 / F.max("high")).alias("mse_loss"), F.max("volume").alias("v"))
    kind = F.when(F.col("v") % 2 == 0, "Linear").otherwise("Trees")
    return loss.select(
        pr.model_name("stock_code", F.concat(F.date_format("m", "yyyyMMdd"), F.lit("_000000")), kind).alias("model_name"),
        F.date_format("m", "dd/MM/yyyy").alias("date_train"),
        "mse_loss",
        sc.encode_list(F.array("stock_code")).alias("alphas"),
    )


@query
def best_models(t):
    return pr.best_model(_model_runs(t), day="1996-03-01").select("stock_code", "trained_on", "model_name", "mse_loss", "alphas")


@query
def training_history(t):
    out = pr.training_history(_model_runs(t)).select("model_name", "trained_on", "stock_code", "model_type", "formulas")
    return out.withColumn("formulas", F.array_join("formulas", ","))


@query
def trade_tape(t):
    return mk.trade_tape(t.ticks, "S3.VN", cal.MARKET_ZONE)


# --- scalar functions ---------------------------------------------------------------------------


@query
def scalar_functions(t):
    price = F.col("price")
    ceiling, floor = sc.price_limits(price)
    ceiling2, floor2 = sc.price_limits_scaled(price)
    return t.raw_ticks.select(
        "seq",
        sc.round2(price / 7).alias("rounded"),
        sc.round2(-price / 8).alias("rounded_negative"),
        sc.strip_suffix("symbol").alias("code"),
        sc.base_symbol("symbol").alias("base"),
        sc.null_if_zero("last_size").alias("size_or_null"),
        ceiling.cast("double").alias("ceiling"),
        floor.cast("double").alias("floor"),
        ceiling2.cast("double").alias("ceiling_scaled"),
        floor2.cast("double").alias("floor_scaled"),
        sc.trend(price, F.lit(20.0)).alias("trend"),
        sc.trend_sign(price, F.lit(20.0)).alias("trend_sign"),
        sc.confidence(price).alias("confidence"),
        sc.range_position(price, F.col("last_size").cast("double"), F.lit(50.0)).alias("range_position"),
        sc.latency_ms(F.col("producer_timestamp") + F.col("last_size"), F.when(F.col("last_size") > 50, F.col("producer_timestamp")).otherwise(0)).alias("latency_ms"),
        sc.parse_bool(F.element_at(F.array(*[F.lit(w) for w in ("TRUE", "no", " Yes ", "1", "n")]), (F.col("seq") % 5 + 1).cast("int"))).alias("flag"),
        sc.article_key("symbol", F.to_date("event_ts"), "seq").alias("article_key"),
        sc.sector_label(F.lit("real_estate")).alias("label"),
        sc.is_finite(F.when(F.col("last_size") > 50, F.lit(float("nan"))).otherwise(price)).alias("finite"),
    )


@query
def parsed_times(t):
    """Tick times in several spellings, read back."""
    form = F.col("seq") % 6
    whole = F.date_trunc("second", "event_ts")
    text = (
        F.when(form == 0, F.unix_millis("event_ts").cast("string"))
        .when(form == 1, F.unix_seconds("event_ts").cast("string"))
        .when(form == 2, F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 3, F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise("junk")
    )
    csv = (
        F.when(form == 0, F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.SSS'+0700'"))
        .when(form == 1, F.date_format(whole, "yyyy-MM-dd HH:mm:ss'+07:00'"))
        .when(form == 2, F.date_format(whole, "yyyy-MM-dd HH:mm:ss'Z'"))
        .when(form == 3, F.date_format(whole, "yyyy-MM-dd HH:mm:ss"))
        .when(form == 4, F.date_format("event_ts", "yyyy-MM-dd"))
        .otherwise("12/31/2024")
    )
    return t.raw_ticks.select(
        "seq",
        sc.parse_tick_ts(text).alias("tick_time"),
        sc.parse_ts_multi(csv).alias("csv_time"),
        sc.trade_date("event_ts").alias("trade_date"),
        sc.minute_bucket("event_ts").alias("minute"),
    )


@query
def calendar_functions(t):
    day = F.to_date("event_ts")
    return t.raw_ticks.select(
        "seq",
        cal.in_trading_hours("event_ts").alias("trading"),
        cal.next_session_edge("event_ts").alias("next_edge"),
        cal.latest_trading_date("event_ts").alias("latest_trading_date"),
        cal.reference_date("event_ts").alias("reference_date"),
        cal.prev_weekday(day).alias("prev_weekday"),
        cal.next_weekday(day).alias("next_weekday"),
    )


@query
def trading_days(t):
    holidays = t.bars.filter(F.day("trade_date") == 1).select(F.col("trade_date").alias("holiday"))
    return cal.trading_days(t.bars.select("stock_code", "trade_date"), "trade_date", holidays)


@query
def formula_checks(t):
    out = al.checked_formulas(ad.catalog(t.spark, t.sf_dir, ad.CHECKED_FORMULAS))
    return out.select("stock_code", "formula", "expression", "problem")


@query
def evaluated_formula(t):
    text = "(high - low) / (close - open) * volume - -2.5 + (close >= open)"
    return t.bars.select("stock_code", "trade_date", formula_column(text).alias("value"))


# --- factors and prediction ---------------------------------------------------------------------


@query
def alpha_values(t):
    out = al.apply_alphas(settle(t.features), t.catalog)
    return rounded(out, "value", digits=3)


@query
def many_formulas(t):
    """More formulas than one pass over the features computes."""
    listed = F.explode(F.transform(F.sequence(F.lit(1), F.lit(150)), lambda k: F.format_string("close * %d - open", k)))
    values = al.apply_alphas(settle(t.features), t.codes.select("stock_code", listed.alias("formula")))
    out = values.groupBy("stock_code", "formula").agg(F.count("value").alias("n_values"), F.max("value").alias("highest"))
    return rounded(out, "highest", digits=2)


@query
def alpha_scores(t):
    out = al.score_formulas(t.features, t.catalog).select("stock_code", "formula", "rank_ic", "n_samples")
    return rounded(out, "rank_ic")


@query
def alpha_pvalues(t):
    return rounded(al.score_formulas(t.features, t.catalog).select("stock_code", "formula", "pvalue"), "pvalue", digits=6)


@query
def best_alphas(t):
    best = al.select_best_alphas(al.score_formulas(t.features, t.catalog))
    return best.select("stock_code", "formula", F.col("position").cast("bigint").alias("position"))


@query
def validated_models(t):
    columns = ["open", "high", "low", "volume"]
    trained = pr.train_and_validate(t.bars.select("stock_code", "trade_date", "close", *columns), columns)
    return trained.best()


def _linear(t):
    return pr.linear_validation(t.bars.select("stock_code", "trade_date", "close"), [], w=1)


@query
def linear_predictions(t):
    """A least-squares fit on one lag of each stock, in prices, on the windows that it was not fitted on."""
    return _linear(t)[0].withColumns({c: r(c, 2, nudge=1e-6) for c in ("target", "predicted")})


@query
def linear_losses(t):
    slope, intercept = F.col("weights")[0].alias("slope"), F.col("weights")[1].alias("intercept")
    out = _linear(t)[1].select("stock_code", "mse_loss", "n_windows", slope, intercept)
    return rounded(out, "mse_loss", "slope", "intercept", digits=6)


@query
def champions(t):
    runs = pr.read_model_runs(_model_runs(t))
    new = runs.filter(F.col("trained_on") == F.lit("1996-03-01").cast("date"))
    old = runs.filter(F.col("trained_on") == F.lit("1996-02-01").cast("date"))
    out = pr.champion(new.select("stock_code", "model_name", "mse_loss"), old.select("stock_code", "model_name", "mse_loss"))
    return out.select("stock_code", "model_name", "new_model_used", "mse_loss", "confidence")


@query
def saveable_predictions(t):
    broken = F.when(F.day("prediction_date") == 1, F.lit(float("nan"))).otherwise(F.col("predicted_price"))
    out = pr.saveable(t.predictions.withColumn("predicted_price", broken))
    return out.select("stock_code", "prediction_date", "predicted_price")


@query
def scored_articles(t):
    good, bad = ("the", "and", "de", "la", "der"), ("of", "in", "le", "el", "und")
    # a PDF is read by its own scorer, here one that knows no text and leaves every third to the article's
    read = lambda links, codes: links.str.len() % 3 - 1.0 + 0.0 * codes.str.len()
    unread = F.col("article_id").cast("int") % 3 == 0
    rows = t.news.withColumn("pdf_link", F.when(F.col("is_pdf") & ~unread, F.concat(F.lit("f/"), "article_id"))).withColumn("link", F.lit(None).cast("string"))
    out = nw.score_articles(rows, pdf_scorer=read, code_col="stock_code", good=good, bad=bad)
    return rounded(out.select("article_id", "is_pdf", F.col("sentiment_score").alias("score")), "score")


# --- streaming ----------------------------------------------------------------------------------


def _streamed(t, *sinks: str) -> str:
    """The ticks written as files and put through the stream once; returns the output folder."""
    source, out = scratch(t.spark, "stream-in"), scratch(t.spark, "stream-out")
    t.ticks.select(*schemas.TIMED_TICK.names).write.mode("overwrite").parquet(source)
    sp.run_available(sp.tick_pipeline(t.spark, source, out, sinks, schema=schemas.TIMED_TICK, once=True, change_seconds=None))
    return out


@query
def stream_daily(t):
    out = sp.serving_tables(_streamed(t, "daily"))["daily"].read(t.spark)
    return out.drop("vwap")


@query
def stream_minute(t):
    out = sp.serving_tables(_streamed(t, "minute"))["minute"].read(t.spark)
    return out.drop("vwap")


@query
def stream_latest(t):
    out = sp.serving_tables(_streamed(t, "latest"))["latest"].read(t.spark)
    return out.select("symbol", "price", "change_percent", "day_volume", "event_ts", "seq")


@query
def stream_ticks(t):
    out = sp.stored_ticks(t.spark, _streamed(t, "ticks"))
    return out.select("symbol", "timestamp", "price", "change", "day_volume", "seq")


@query
def stream_changes(t):
    out = sp.serving_tables(_streamed(t, "changes"))["changes"].read(t.spark)
    return out.select("symbol", "seq", "price", "change", "day_volume", "last_size", "latency_ms")


def _streamed_in_two(t, *sinks: str):
    """Three quarters of the ticks as a first batch, the others as a second one; returns the tables."""
    source, out = scratch(t.spark, "stream-in"), scratch(t.spark, "stream-out")
    for part in (F.col("seq") % 4 != 0, F.col("seq") % 4 == 0):
        t.ticks.select(*schemas.TIMED_TICK.names).filter(part).write.mode("append").parquet(source)
        sp.run_available(sp.tick_pipeline(t.spark, source, out, sinks, schema=schemas.TIMED_TICK, once=True))
    return sp.serving_tables(out)


@query
def late_ticks(t):
    """A quarter of the ticks arrive in a second batch: which of them find their bars closed."""
    return _streamed_in_two(t, "late")["late"].read(t.spark).select("sink", "symbol", "event_ts", "seq", "price")


RUNNING_COLUMNS = ("symbol", "bucket_date", "ts", "event_ts", "seq", "ticks", "open", "close", "high", "low", "volume")


@query
def stream_running_daily(t):
    """Each tick's day so far; those of the second batch go on from what the first one left."""
    return _streamed_in_two(t, "running_daily")["running_daily"].read(t.spark).select(*RUNNING_COLUMNS)


@query
def stream_running_minute(t):
    return _streamed_in_two(t, "running_minute")["running_minute"].read(t.spark).select(*RUNNING_COLUMNS)


@query
def gated_ticks(t):
    return sp.trading_gate(t.raw_ticks).select("symbol", "seq", "price")


@query
def live_movers(t):
    out = sp.live_movers(t.latest)
    return out.select("side", F.col("position").cast("bigint").alias("position"), "symbol", "price", "day_volume")


# --- metrics ------------------------------------------------------------------------------------

ORDER = ("ts", "seq")


@query
def latency_histogram(t):
    out = mt.latency_histogram(t.change_samples)
    bound = F.when(F.col("le") == mt.INF, "+Inf").otherwise(F.col("le").cast("int").cast("string"))
    return out.withColumn("le", bound).select("symbol", "le", "bucket_count", "events", r("latency_sum").alias("latency_sum"))


@query
def counter_rates(t):
    out = mt.counter_rate(t.samples, ["symbol"], window=3600, step=1800, order=ORDER)
    return rounded(out, "rate", digits=6)


@query
def total_rate(t):
    out = mt.sum_by(mt.counter_rate(t.samples, ["symbol"], window=3600, step=3600, order=ORDER), [])
    return rounded(out, "rate", digits=6)


@query
def latency_quantiles(t):
    buckets = mt.latency_histogram(t.change_samples)
    out = None
    for q in (0.5, 0.95, 0.99):
        rows = mt.histogram_quantile(buckets, q, ["symbol"]).withColumn("q", F.lit(q))
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, "quantile")


@query
def mean_latency(t):
    at = mt._grid_up("ts", 3600).alias("at_time")
    sums = t.change_samples.groupBy("symbol", at).agg(F.sum("latency_ms").alias("rate"))
    counts = t.change_samples.groupBy("symbol", at).agg(F.count(F.lit(1)).cast("double").alias("rate"))
    return rounded(mt.mean_from_sum_count(sums, counts, ["symbol", "at_time"]), "mean")


@query
def guarded_ratios(t):
    at = mt._grid_up("ts", 86400).alias("at_time")
    rows = t.change_samples.groupBy("symbol", at).agg(
        F.count(F.lit(1)).cast("double").alias("total"), F.count_if(F.col("latency_ms") > 200).cast("double").alias("part")
    )
    return rows.select("symbol", "at_time", r(mt.guarded_ratio("total", "part", "total", 10)).alias("ratio"))


@query
def counter_changes(t):
    out = mt.windowed_steps(t.samples, ["symbol"], window=7200, step=3600, order=ORDER)
    return out.select("symbol", "at_time", "changes", "resets")


@query
def outliers(t):
    rates = mt.counter_rate(t.samples, ["symbol"], window=3600, step=3600, order=ORDER)
    out = mt.outlier_z(rates.withColumn("rate", F.col("rate") * 3600), k=1.5, damping=10.0)
    return rounded(out, "rate", "z")


@query
def offset_deltas(t):
    return mt.offset_delta(t.samples, ["symbol"], offset=3600, step=1800, order=ORDER, lookback=7200)


@query
def held_alerts(t):
    return mt.alert_hold(t.samples, ["symbol"], F.col("value") < 400, 7200, order=ORDER).select(
        "symbol", "started_at", "ended_at", "n_samples", "fired_at"
    )


@query
def absent_instances(t):
    up = t.samples.select(F.col("symbol").alias("instance"))
    seen = t.samples.filter(F.col("value") > 1000).select(F.col("symbol").alias("instance"))
    return mt.absent_instances(up, seen)


@query
def per_unit(t):
    many = br.latest_by_symbol(t.samples, ORDER).select(F.col("symbol").alias("instance"), "value")
    units = t.samples.groupBy(F.col("symbol").alias("instance")).agg(F.count(F.lit(1)).alias("units"))
    return mt.per_unit(many, units, ["instance"])


@query
def log_rates(t):
    out = mt.log_rate(t.change_samples, F.col("module").isin("error", "click"), ["module"], 3600)
    return rounded(out, "rate", digits=6)


@query
def last_event_times(t):
    rows = t.samples.withColumn("value", F.floor(F.col("value") / 500) * 1.0)
    return mt.last_event_time(rows, ["symbol"], ["symbol"], window=3600, step=1800, order=ORDER)


@query
def run_progress(t):
    rows = t.change_samples.select(
        "symbol",
        F.to_date("ts").alias("day"),
        F.when(F.col("module") == "error", 0).otherwise(1).alias("running"),
        (F.col("seq") % 50).alias("total"),
        (F.col("seq") % 7).alias("done"),
    )
    return rounded(mt.progress_pct(rows, ["symbol", "day"]), "progress", digits=6)


# --- jobs ---------------------------------------------------------------------------------------


@query
def warehouse_daily(t):
    """A first load up to a day, then an incremental load of everything."""
    wh = jobs.warehouse_tables(scratch(t.spark, "warehouse"))
    summary = stored(t.daily, "daily")
    jobs.load_daily(summary.filter(F.col("trade_date") <= F.lit("2024-01-15").cast("date")), wh)
    jobs.load_daily(summary, wh)
    return wh["fact_daily_prices"].read(t.spark).select("stock_code", "trade_date", "open", "high", "low", "close", "volume", "change")


@query
def warehouse_news(t):
    wh = jobs.warehouse_tables(scratch(t.spark, "warehouse"))
    source = t.news.select("article_id", "stock_code", "date", "content", "sentiment_score")
    jobs.load_news(source.filter(F.col("date") <= F.lit("1995-06-30").cast("timestamp")), wh)
    jobs.load_news(source, wh)
    fact = wh["fact_news"].read(t.spark)
    return fact.select("stock_code", "news_date", "article_id", F.length("content").cast("bigint").alias("content_chars"), "sentiment_score")


@query
def warehouse_dim(t):
    wh = jobs.warehouse_tables(scratch(t.spark, "warehouse"))
    jobs.load_daily(t.daily, wh)
    jobs.load_news(t.news.select("article_id", "stock_code", "date", "content", "sentiment_score"), wh)
    return wh["dim_stock"].read(t.spark).select("stock_code", "exchange", "quote_type")


@query
def ingested_news(t):
    """Every page as an article; ingested twice, the second run finds nothing new."""
    table = jobs.warehouse_tables(scratch(t.spark, "warehouse"))["news"]
    code = F.concat(F.lit("S"), F.pmod("page_id", F.lit(10)).cast("string"))
    crawled = t.pages.select(F.col("page_id").cast("string").alias("article_id"), code.alias("stock_code"), F.col("url").alias("link"), "html")
    layout = ar.Layout(body_id=None, paragraph_class=None)
    jobs.news_ingest(crawled, table, NEWS_NOW, layout)
    jobs.news_ingest(crawled, table, NEWS_NOW + dt.timedelta(days=1), layout)
    return table.read(t.spark).select("article_id", "stock_code", "link", "date", "is_pdf", "crawled_at")


@query
def prediction_run(t):
    root = scratch(t.spark, "warehouse")
    return jobs.predict_all(
        t.bars, t.news, t.dim_stock, t.catalog, jobs.warehouse_tables(root), jobs.ModelStore(f"{root}/models"),
        dt.date(2001, 1, 2), "20010101_230000",
    ).select("stock_code", "predicted_price", "model_name", "confidence", "saved", "error")


@query
def serving_report_breadth(t):
    report = jobs.serving_report(t.latest, t.daily, t.predictions, t.sectors, NOW)
    return rounded(report["breadth"], "avg_change_percent")


#: The other tables of the report, and their columns where not all are compared.
REPORT = {
    "board": (),
    "gainers_losers": ("side", "position", "symbol", "price", "change_percent"),
    "signed_movers": (),
    "top_volume": ("symbol", "volume", "volume_millions", "direction", "position"),
    "sector_volume": (),
    "sector_leaders": ("sector", "symbol", "volume", "position"),
    "prediction_trend": ("stock_code", "prediction_trend", "confidence_score"),
    "accuracy": (),
}


def _report_table(name: str, columns: tuple[str, ...]) -> Callable[[Domain], DataFrame]:
    def build(t: Domain) -> DataFrame:
        # the older bars are those that the predictions were made for
        kept = ("trade_date", "open", "high", "low", "close")
        older = t.bars.select(F.concat("stock_code", F.lit(".VN")).alias("symbol"), *kept)
        daily = t.daily.select("symbol", *kept).unionByName(older)
        table = jobs.serving_report(t.latest, daily, t.predictions, t.sectors, NOW)[name]
        table = table.select(*columns) if columns else table
        if "position" in columns:
            table = table.withColumn("position", F.col("position").cast("bigint"))
        return rounded(table, "share_percent") if name == "sector_volume" else table

    build.__name__ = f"serving_report_{name}"
    return build


for _name, _columns in REPORT.items():
    query(_report_table(_name, _columns))
