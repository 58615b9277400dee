import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from quotemill import schemas
from quotemill.operators import bars as br
from quotemill.plans import jobs
from quotemill.sources import articles as ar
from quotemill.streaming import pipeline as sp

D = dt.date
UTC = dt.timezone.utc


def many_ticks(make_ticks, n=120):
    at = dt.datetime(2024, 1, 2, 2, 0)
    items = []
    for i in range(n):
        price = 20 + 5 * math.sin(i / 3) + i % 4
        when = (at + dt.timedelta(minutes=13 * i, seconds=i % 50)).isoformat(sep=" ")
        items.append((f"{'ABC'[i % 3]}.VN", when, round(price, 2), i % 6, i + 1, int(i % 10 != 0), round(math.cos(i), 2)))
    return make_ticks(*items)


def feed(ticks, folder, parts):
    """The ticks in time order as files, one after the other."""
    rows = ticks.orderBy("event_ts").collect()
    size = -(-len(rows) // parts)
    for p in range(parts):
        part = ticks.sparkSession.createDataFrame(rows[p * size : (p + 1) * size], ticks.schema)
        part.coalesce(1).write.mode("append").parquet(folder)


DAILY = ("symbol", "trade_date", "open", "high", "low", "close", "volume", "vwap", "change")


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_equals_batch(spark, make_ticks, tmp_path, rows, parts):
    ticks = many_ticks(make_ticks)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed(ticks, source, parts)
    sinks = ("daily", "minute", "latest") if parts == 1 else ("ticks", "daily", "latest", "changes")
    started = sp.tick_pipeline(spark, source, out, sinks, schema=schemas.TIMED_TICK, once=True, change_seconds=None, maxFilesPerTrigger=1)
    sp.run_available(started)
    clean = sp.clean_ticks(ticks)
    tables = sp.serving_tables(out)
    assert rows(tables["daily"].read(spark), *DAILY) == rows(br.finalize_daily(br.daily_bars(clean)), *DAILY)
    newest = br.latest_by_symbol(sp.serving_rounded(clean))
    assert rows(tables["latest"].read(spark), "symbol", "price", "seq") == rows(newest, "symbol", "price", "seq")
    assert rows(tables["movers"].read(spark)) == rows(sp.live_movers(newest))
    if "minute" in sinks:
        assert rows(tables["minute"].read(spark)) == rows(br.minute_bars(clean))
    if "ticks" in sinks:
        assert rows(sp.stored_ticks(spark, out), "symbol", "seq") == rows(clean, "symbol", "seq")
    if "changes" in sinks:
        got = tables["changes"].read(spark).drop("slot")
        assert rows(got) == rows(sp.latest_changes(clean.select(*schemas.TIMED_TICK.names)))


def test_restart_continues_the_state(spark, make_ticks, tmp_path, rows):
    ticks = many_ticks(make_ticks, 60)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    middle = dt.datetime(2024, 1, 2, 8, 30)
    for part in (F.col("event_ts") < middle, F.col("event_ts") >= middle):
        feed(ticks.filter(part), source, 1)
        sp.run_available(sp.tick_pipeline(spark, source, out, ("daily",), schema=schemas.TIMED_TICK, once=True))
    expected = br.finalize_daily(br.daily_bars(sp.clean_ticks(ticks)))
    assert rows(sp.serving_tables(out)["daily"].read(spark), *DAILY) == rows(expected, *DAILY)


def test_late_ticks_are_set_aside(spark, make_ticks, tmp_path, rows):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed(make_ticks(("A", "2024-01-02 03:00:00", 1, 1)), source, 1)
    start = lambda: sp.run_available(sp.tick_pipeline(spark, source, out, ("late",), schema=schemas.TIMED_TICK, once=True))
    start()
    feed(make_ticks(("A", "2024-01-02 02:55:00", 2, 1), ("A", "2024-01-02 02:40:00", 3, 1)), source, 1)
    start()
    assert rows(sp.serving_tables(out)["late"].read(spark), "sink", "price") == [("minute", 3.0)]


def test_changes_only_show_what_differs(make_ticks, rows):
    t = make_ticks(
        ("A.VN", "2024-01-02 02:00:00", 10, 1, 5), ("A.VN", "2024-01-02 02:00:01", 10, 1, 5), ("A.VN", "2024-01-02 02:00:02", 11, 1, 5)
    )
    got = rows(sp.latest_changes(t), "symbol", "seq", "price", "day_volume")
    assert got == [("A", 0, 10.0, 5), ("A", 2, 11.0, None)]
    before = t.filter("seq = 0")
    after = t.filter("seq > 0")
    assert rows(sp.latest_changes(after, before), "seq", "price") == [(2, 11.0)]
    recent = sp.recent_changes(sp.latest_changes(t), dt.datetime(2024, 1, 2, 2, 2, 1))
    assert rows(recent, "seq") == [(2,)]
    assert sp.trading_gate(t).count() == 3 and sp.trading_gate(t, "UTC").count() == 0


def summary(spark, *items):
    """(symbol, date, close, exchange)"""
    rows = [(s, d, c, c, c, c, 10, 0.0, 0.0, c, e, 1, 1) for s, d, c, e in items]
    return spark.createDataFrame(rows, schemas.DAILY)


def test_load_daily(spark, tmp_path, rows):
    wh = jobs.warehouse_tables(str(tmp_path))
    first = summary(spark, ("A.VN", D(2024, 1, 1), 0.0, "HSX"), ("A.VN", D(2024, 1, 2), 2.0, "HNX"))
    jobs.load_daily(first, wh)
    assert rows(wh["fact_daily_prices"].read(spark), "stock_code", "close") == [("A", 0.0), ("A", 2.0)]
    more = summary(spark, ("A.VN", D(2024, 1, 2), 99.0, "HSX"), ("A.VN", D(2024, 1, 3), 3.0, "HSX"), ("B.VN", D(2024, 1, 3), 4.0, "HSX"))
    jobs.load_daily(more, wh)
    assert rows(wh["fact_daily_prices"].read(spark), "stock_code", "trade_date", "close")[1:] == [
        ("A", D(2024, 1, 2), 2.0), ("A", D(2024, 1, 3), 3.0), ("B", D(2024, 1, 3), 4.0),
    ]
    dim = wh["dim_stock"].read(spark)
    assert rows(dim, "stock_code", "exchange") == [("A", "HSX"), ("B", "HSX")]
    assert rows(dim.filter("updated_at > created_at"), "stock_code") == [("A",)]
    jobs.load_daily(more, wh, lookback_days=5)
    assert rows(wh["fact_daily_prices"].read(spark).filter("trade_date = '2024-01-02'"), "close") == [(99.0,)]
    jobs.load_daily(first, wh, lookback_days=5, zero_as_null=True)
    assert rows(wh["fact_daily_prices"].read(spark).filter("trade_date = '2024-01-01'"), "close", "volume") == [(None, 10)]


def test_load_news(spark, tmp_path, rows):
    wh = jobs.warehouse_tables(str(tmp_path))
    make = lambda *r: spark.createDataFrame(list(r), "article_id string, stock_code string, date timestamp, content string, sentiment_score double")
    jobs.load_news(make(("1", "A.VN", dt.datetime(2024, 1, 2, 8), None, 0.5)), wh)
    late = make(("2", "A", dt.datetime(2024, 1, 2, 9), "late", 0.1), ("3", "B", dt.datetime(2024, 1, 3), "new", None))
    jobs.load_news(late, wh)
    fact = wh["fact_news"]
    assert rows(fact.read(spark), "article_id", "stock_code", "content") == [("1", "A", ""), ("3", "B", "new")]
    jobs.load_news(late, wh, lookback_days=2)
    assert rows(fact.read(spark), "article_id") == [("1",), ("2",), ("3",)]
    assert rows(wh["dim_stock"].read(spark), "stock_code", "exchange", "quote_type") == [("A", "NASDAQ", 1), ("B", "NASDAQ", 1)]


def test_news_ingest(spark, tmp_path, rows):
    table = jobs.warehouse_tables(str(tmp_path))["news"]
    html = "<title>T</title><p>profit growth loss</p>"
    pages = spark.createDataFrame([("1", "A", "l1", html), ("2", "A", "l2", "<p></p>")], "article_id string, stock_code string, link string, html string")
    layout = ar.Layout(body_id=None, paragraph_class=None)
    jobs.news_ingest(pages, table, dt.datetime(2024, 1, 2), layout)
    jobs.news_ingest(pages, table, dt.datetime(2024, 1, 3), layout)
    got = rows(table.read(spark), "article_id", "title", "content", "date")
    assert got == [("1", "T", "profit growth loss", dt.datetime(2024, 1, 2)), ("2", "", "", dt.datetime(2024, 1, 2))]
    assert [round(r[0], 4) for r in rows(table.read(spark), "sentiment_score")] == [0.0, 0.3333]


FORMULAS = ["close - open", "SMA_5 - close", "RSI_14", "MACD", "Momentum_3", "close.shift(1)"]


def test_prediction_run_and_champion(spark, tmp_path, rows):
    wh = jobs.warehouse_tables(str(tmp_path / "wh"))
    store = jobs.ModelStore(str(tmp_path / "models"))
    start = D(2024, 1, 1)
    data = []
    for code, shift in (("A", 0), ("B", 2)):
        for i in range(130):
            close = 100 + 10 * math.sin((i + shift) / 5) + i / 10
            data.append((code, start + dt.timedelta(days=i), close - math.cos(i), close + 2, close - 2, close, 100 + i % 9))
    data += [("S", start + dt.timedelta(days=i), 1.0, 1.0, 1.0, 1.0, 1) for i in range(10)]
    prices = spark.createDataFrame(data, "stock_code string, trade_date date, open double, high double, low double, close double, volume bigint")
    news = spark.createDataFrame([("1", "A", start, "A and B", 1.0)], "article_id string, stock_code string, news_date date, content string, sentiment_score double")
    dim = spark.createDataFrame([("A",), ("B",), ("S",)], "stock_code string")
    catalog = spark.createDataFrame([(c, f) for c in "AB" for f in FORMULAS], "stock_code string, formula string")
    day = start + dt.timedelta(days=130)
    got = {r["stock_code"]: r for r in jobs.predict_all(prices, news, dim, catalog, wh, store, day, "20240510_010000", 3).collect()}
    assert got["S"]["error"] == "not enough prices" and got["S"]["saved"] is False
    assert got["A"]["new_model_used"] and got["A"]["error"] is None and 80 < got["A"]["predicted_price"] < 140
    assert wh["fact_predictions"].read(spark).count() == 2
    assert wh["alpha_metrics"].read(spark).count() == 10
    run = wh["model_runs"].read(spark).orderBy("model_name").first()
    assert len(json.loads(run["alphas"])) == 5 and run["date_train"] == "10/05/2024"
    # the next day yesterday's model of A is much better than anything new, so it is kept
    better = wh["model_runs"].read(spark).filter("model_name like '%_A_%'").withColumn("mse_loss", F.lit(1e-12))
    from quotemill.sources.tables import upsert

    upsert(wh["model_runs"], better)
    again = jobs.predict_all(prices, news, dim, catalog, wh, store, day + dt.timedelta(days=1), "20240511_010000", 3)
    kept = {r["stock_code"]: r for r in again.collect()}
    assert kept["A"]["new_model_used"] is False and kept["A"]["model_name"] == got["A"]["model_name"]
    assert kept["A"]["predicted_price"] == pytest.approx(got["A"]["predicted_price"])
    assert kept["B"]["predicted_price"] is not None


def test_serving_report(spark, make_ticks, rows):
    latest = make_ticks(("A.VN", "2024-01-09 03:00:00", 12, 1, 5, 1, 2.0), ("B.VN", "2024-01-09 03:00:00", 8, 1, 7, 1, -1.0))
    daily = summary(spark, ("A.VN", D(2024, 1, 8), 10.0, "X"), ("A.VN", D(2024, 1, 9), 12.0, "X"), ("B.VN", D(2024, 1, 9), 8.0, "X"))
    pred = spark.createDataFrame([("A", D(2024, 1, 9), 11.0, 0.9)], "stock_code string, prediction_date date, predicted_price double, confidence_score double")
    sectors = spark.createDataFrame([("A", "x"), ("B", "y")], "stock_code string, sector string")
    report = jobs.serving_report(latest, daily, pred, sectors, dt.datetime(2024, 1, 9, 3, 0))
    assert rows(report["board"], "symbol", "reference", "ceiling") == [("A", 10.0, 11.0), ("B", 0.0, 0.0)]
    assert rows(report["breadth"], "advancing", "declining") == [(1, 1)]
    assert rows(report["accuracy"], "stock_code", "accuracy") == [("A", 100.0)]
    assert rows(report["prediction_trend"], "prediction_trend") == [("up",)]
    assert all(df.count() >= 1 for df in report.values())
