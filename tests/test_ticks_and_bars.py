import datetime as dt

import pytest
from pyspark.sql import functions as F

from quotemill.operators import bars as br
from quotemill.operators import filters as fl
from quotemill.operators import market as mk
from quotemill.operators import runs as rn
from quotemill.sources import tables as tb

DAY = "2024-01-02"


def test_valid_ticks_limits(spark, make_ticks, rows):
    base = make_ticks(("A", f"{DAY} 02:00:00", 10, 1))
    cases = [(0.0, 1, 1.0), (1e6, 1, 1.0), (999999.0, 1, 49.9), (5.0, 0, 1.0), (5.0, 1, -50.0), (5.0, 1, None), (5.0, 1, -49.0)]
    df = spark.createDataFrame(cases, "price double, day_volume bigint, change_percent double")
    df = df.crossJoin(base.drop("price", "day_volume", "change_percent"))
    assert rows(fl.valid_ticks(df), "price", "change_percent") == [(5.0, -49.0), (999999.0, 49.9)]


def test_session_and_week_filters(make_ticks, rows):
    t = make_ticks(
        ("A", f"{DAY} 01:59:59", 1, 1), ("A", f"{DAY} 02:00:00", 2, 1), ("A", f"{DAY} 08:00:00", 3, 1),
        ("A", f"{DAY} 08:00:01", 4, 1), ("B", f"{DAY} 03:00:00", 5, 1),
    )
    assert rows(fl.session_ticks(t, "A", DAY), "price") == [(2.0,), (3.0,)]
    w = make_ticks(("A", "2023-12-31 00:00:00", 1, 1), ("A", "2024-01-06 23:59:59", 2, 1), ("A", "2024-01-07 00:00:00", 3, 1))
    # the 7th is a Sunday: the span ends on Saturday
    assert rows(fl.week_ticks(w, "A", "2024-01-07"), "price") == [(1.0,), (2.0,)]
    assert rows(fl.week_ticks(w, "A", "2024-01-08"), "price") == [(2.0,), (3.0,)]


def test_daily_bars_quirks(make_ticks, rows):
    t = make_ticks(
        ("A", f"{DAY} 02:00:00", 10, 5, 100),
        ("A", f"{DAY} 02:01:00", 12, 0, 110),
        ("A", f"{DAY} 02:00:30", 8, 5, 105),  # arrives late, counts by its time
        ("A", f"{DAY} 02:02:00", 50, 9, 120, 0),  # outside the session
        ("B", f"{DAY} 02:00:00", 2.345, 0, 7),
    )
    got = rows(br.daily_bars(t), "symbol", "ticks", "open", "high", "low", "close", "volume", "vwap")
    assert got == [("A", 3, 10.0, 12.0, 8.0, 12.0, 110, 0.82), ("B", 1, 2.35, 2.35, 2.35, 2.35, 7, 2.35)]
    traded = rows(br.daily_bars(t, "traded"), "symbol", "volume", "vwap")
    assert traded == [("A", 10, 9.0), ("B", 0, 2.35)]


def test_equal_times_are_ordered_by_seq(make_ticks, rows):
    t = make_ticks(*[("A", f"{DAY} 02:00:00", p, 1) for p in (3, 1, 2)])
    assert rows(br.daily_bars(t), "open", "close") == [(3.0, 2.0)]
    assert rows(br.latest_by_symbol(t), "price", "seq") == [(2.0, 2)]
    assert rows(br.session_summary(t)) == [("A", 3.0, 3.0, 1.0, 2.0)]


def test_finalize_clamps_and_compares_with_open(spark, rows):
    bars = spark.createDataFrame(
        [("A", dt.date(2024, 1, 2), 10.0, 9.0, 11.0, 12.0, 5, 11.0), ("B", dt.date(2024, 1, 2), 0.0, -1.0, -2.0, -3.0, 5, 1.0)],
        "symbol string, trade_date date, open double, high double, low double, close double, volume bigint, vwap double",
    )
    got = rows(br.finalize_daily(bars), "symbol", "open", "high", "low", "close", "change", "change_percent", "exchange", "market_hours")
    assert got == [("A", 10.0, 12.0, 10.0, 12.0, 2.0, 20.0, "NASDAQ", 1), ("B", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "NASDAQ", 1)]


def test_minute_bars_sum_to_traded_volume(make_ticks, rows):
    t = make_ticks(
        ("A", f"{DAY} 02:00:10", 10, 2), ("A", f"{DAY} 02:00:50", 20, 2), ("A", f"{DAY} 02:01:00", 30, 0), ("A", f"{DAY} 02:06:00", 40, 3)
    )
    minute = br.minute_bars(t)
    assert rows(minute, "ts", "open", "close", "volume", "vwap") == [
        (dt.datetime(2024, 1, 2, 2, 0), 10.0, 20.0, 4, 15.0),
        (dt.datetime(2024, 1, 2, 2, 1), 30.0, 30.0, 0, 30.0),
        (dt.datetime(2024, 1, 2, 2, 6), 40.0, 40.0, 3, 40.0),
    ]
    assert rows(br.rollup_bars(minute, "5m")) == rows(br.bars(t, "5m"))
    assert rows(br.rollup_bars(minute, "1d"), "volume") == [(7,)]
    ok = br.bars(t, "1h").filter("low > open OR low > close OR high < open OR high < close")
    assert ok.count() == 0


def test_collapse_and_candles(make_ticks, spark, rows):
    t = make_ticks(("A", f"{DAY} 02:00:00.100", 1, 1), ("A", f"{DAY} 02:00:00.900", 2, 1), ("A", f"{DAY} 02:00:01", 3, 1))
    assert rows(br.collapse_by_second(t), "price") == [(2.0,), (3.0,)]
    bars = spark.createDataFrame([(10.0, 12.0), (0.0, 1.0)], "open double, close double")
    assert rows(br.candle_change(bars), "candle_change", "candle_percent") == [(1.0, 0.0), (2.0, 20.0)]


def walk(make_ticks, n=60):
    prices = [10, 12, 12, 9, 0, 15, 15, 11]
    at = dt.datetime(2024, 1, 2, 23, 40)
    items = []
    for i in range(n):
        for j, s in enumerate(("A", "B")):
            change = [0.0, 1.5, 0.0, -2.0][(i + j) % 4]
            items.append((s, (at + dt.timedelta(seconds=37 * i)).isoformat(sep=" "), prices[(i * (j + 1)) % 8], i % 5, i % 7 + 1, 1, change))
    return make_ticks(*items)


def plain(df, order=("event_ts", "seq")):
    """What the running operators give with one window per symbol."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy(*order)
    day = Window.partitionBy("symbol", F.to_date("event_ts")).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    price = F.when(F.col("price") > 0, F.col("price"))
    step = F.when(F.col("price") > F.lag("price").over(w), "up").when(F.col("price") < F.lag("price").over(w), "down")
    out = df.withColumn("_step", step)
    return out.select(
        "symbol", "seq", F.max(price).over(day).alias("hi"), F.min(price).over(day).alias("lo"),
        F.last("_step", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("dir"),
        F.lag("price").over(w).alias("prev"),
    )


@pytest.mark.parametrize("forced", [False, True])
def test_running_values_cross_runs(make_ticks, rows, monkeypatch, forced):
    """Also when a time bucket counts as too full, which cuts the range evenly instead."""
    if forced:
        small = rn.with_runs
        monkeypatch.setattr(mk, "with_runs", lambda df, keys, order, **k: small(df, keys, order, max_run_rows=1))
    t = walk(make_ticks)
    expected = plain(t)
    assert rows(mk.running_high_low(t), "symbol", "seq", "running_high", "running_low") == rows(expected, "symbol", "seq", "hi", "lo")
    assert rows(mk.tick_direction(t), "symbol", "seq", "price_direction") == rows(expected, "symbol", "seq", "dir")


def test_previous_with_balanced_runs(make_ticks, rows):
    t = walk(make_ticks)
    runs = rn.balanced_runs(t, ["symbol"], ["event_ts", "seq"], 7)
    assert runs.select("_run").distinct().count() > 4
    got = rn.previous(runs, ["symbol"], ["event_ts", "seq"], {"prev": "price"}, runs=runs)
    assert rows(got, "symbol", "seq", "prev") == rows(plain(t), "symbol", "seq", "prev")


def test_equal_times_are_cut_too(make_ticks):
    t = make_ticks(*[("A", f"{DAY} 02:00:00", p, 1) for p in range(200)])
    runs = rn.with_runs(t, ["symbol"], ["event_ts", "seq"], max_run_rows=50)
    assert runs.groupBy("_run").count().agg(F.max("count")).first()[0] < 200


def test_carry_change_expires(make_ticks, rows):
    t = make_ticks(
        ("A", "2024-01-02 02:00:00", 1, 1, 1, 1, 0.0),
        ("A", "2024-01-02 02:10:00", 1, 1, 1, 1, 1.5),
        ("A", "2024-01-02 02:20:00", 1, 1, 1, 1, 0.0),
        ("A", "2024-01-03 02:09:59", 1, 1, 1, 1, 0.0),
        ("A", "2024-01-03 02:10:00", 1, 1, 1, 1, 0.0),
    )
    assert rows(mk.carry_change(t), "seq", "shown_change") == [(0, 0.0), (1, 1.5), (2, 1.5), (3, 1.5), (4, 0.0)]


def board(spark):
    return spark.createDataFrame(
        [("A", 10.0, 9.0, 5, 1.0, 11.0), ("B", 8.0, 0.0, 7, -1.0, -9.0), ("C", 3.0, 3.0, 0, 0.0, 0.0), ("D", 4.0, 2.0, 7, 2.0, 100.0)],
        "symbol string, price double, reference double, volume bigint, change double, change_percent double",
    )


def test_board_rankings(spark, rows):
    b = board(spark)
    sectors = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y"), ("D", "x")], "stock_code string, sector string")
    assert rows(mk.market_breadth(b)) == [(2, 1, 1, 19, 25.5)]
    assert [r["symbol"] for r in mk.top_volume(b, 2).orderBy("position").collect()] == ["B", "D"]
    assert rows(mk.signed_movers(b, 1)) == [("B", -9.0, "loss"), ("D", 100.0, "gain")]
    assert rows(mk.sector_volume(b, sectors)) == [("x", 19, 3, 100.0)]
    assert [r["symbol"] for r in mk.sector_ranking(b, sectors, "x", "percentage").collect()] == ["D", "A", "B"]
    assert rows(mk.sector_top_volume(b, sectors, k=1), "sector", "symbol") == [("x", "B"), ("y", "C")]
    latest = b.select("symbol", F.when(F.col("symbol") != "C", F.col("change_percent")).alias("change_percent"))
    got = mk.gainers_losers(latest, 2).orderBy("side", "position").collect()
    assert [(r["side"], r["symbol"]) for r in got] == [("gainer", "D"), ("gainer", "A"), ("loser", "B"), ("loser", "C")]


def test_market_board_fills_missing(spark, make_ticks, rows):
    latest = make_ticks(("A.VN", f"{DAY} 02:00:00", 10, 1), ("B.VN", f"{DAY} 02:00:00", 5, 1), ("X.VN", f"{DAY} 02:00:00", 5, 1))
    ref = spark.createDataFrame([("A.VN", 10.0)], "symbol string, close double")
    day = spark.createDataFrame([("A", 11.0, 9.0)], "symbol string, high double, low double")
    got = rows(mk.market_board(latest, ref, day, ["A", "B"]), "symbol", "ceiling", "floor", "high", "low")
    assert got == [("A", 11.0, 9.0, 11.0, 9.0), ("B", 0.0, 0.0, 0.0, 0.0)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("build", [
    lambda t: br.latest_by_symbol(t), lambda t: br.daily_bars(t), lambda t: br.daily_bars(t, "traded"), lambda t: br.minute_bars(t),
    lambda t: br.rollup_bars(br.minute_bars(t), "1h"), lambda t: br.session_summary(t), lambda t: br.collapse_by_second(t),
    lambda t: tb.dedupe_first(t.select("symbol", "exchange", "seq"), ["symbol"], ["seq"]), lambda t: mk.tick_direction(t), lambda t: mk.carry_change(t),
])
def test_first_and_last_need_no_sort(make_ticks, build):
    t = make_ticks(("A", f"{DAY} 02:00:00", 1, 1))
    fixed = t.withColumn("seq", F.coalesce("seq", F.lit(0)))
    assert "SortAggregate" not in plan_of(build(fixed)) and "HashAggregate" in plan_of(build(fixed))


def test_directions_shuffle_ticks_once(make_ticks):
    plan = plan_of(mk.tick_direction(walk(make_ticks)))
    assert plan.count(" Exchange ") + plan.count("-Exchange ") <= 4


@pytest.mark.parametrize("order, want", [
    ([(None, 5), (None, None), ("2024-01-02", -3), ("1901-05-06", 2**63 - 1), ("2024-01-02", -(2**63)), ("9999-12-31", 0), ("2024-01-02", None)], None),
])
def test_order_key_sorts_like_its_columns(spark, order, want):
    from quotemill.functions.ordering import order_key

    rows = [(dt.datetime.fromisoformat(a) if a else None, s, i) for i, (a, s) in enumerate(order)]
    df = spark.createDataFrame(rows, "at timestamp, seq long, i int")
    by_key = [r["i"] for r in df.orderBy(order_key(df, ["at", "seq"]), "i").collect()]
    by_columns = [r["i"] for r in df.orderBy(F.coalesce("at", F.timestamp_micros(F.lit(-(10**17)))), F.coalesce("seq", F.lit(-(2**63))), "i").collect()]
    assert by_key == by_columns
    assert "struct" in str(df.select(order_key(df, ["i", "seq"]).alias("k")).schema["k"].dataType.simpleString())


def test_one_row_of_each_key(make_ticks, spark, rows):
    from quotemill.functions.ordering import one_row

    t = make_ticks(*[("AB"[i % 2], f"{DAY} 02:00:0{i // 4}", i, 1) for i in range(12)])
    t = t.withColumn("symbol", F.when(F.col("symbol") == "A", "A"))  # a NULL key
    assert rows(one_row(t, ["symbol"], ["event_ts", "seq"]), "symbol", "seq") == [("A", 10), (None, 11)]
    assert rows(one_row(t, ["symbol"], ["event_ts", "seq"], first=True), "symbol", "seq") == [("A", 0), (None, 1)]
    alike = t.withColumn("seq", F.lit(7).cast("long"))
    got = one_row(alike, ["symbol"], ["event_ts", "seq"])
    assert got.count() == 2 and got.columns == alike.columns and got.filter(F.second("event_ts") == 2).count() == 2


@pytest.mark.parametrize("limit, width", [(10**6, "day"), (40, "hour"), (10, "minute"), (2, None)])
def test_all_runs_give_the_same(make_ticks, rows, monkeypatch, limit, width):
    """Ties in time, and every width of a run, against plain windows."""
    start = dt.datetime(2024, 1, 2, 22)
    t = make_ticks(*[(s, (start + dt.timedelta(minutes=7 * (i // 3))).isoformat(sep=" "), (i * k) % 5, 1, 1, 1, [0.0, 2.0, 0.0][i % 3]) for i in range(90) for k, s in ((3, "A"), (7, "B"))])
    assert rn._widest(t, ["symbol"], "event_ts", limit) == width
    real = rn.with_runs
    monkeypatch.setattr(mk, "with_runs", lambda df, keys, order: real(df, keys, order, max_run_rows=limit))
    expected = plain(t)
    assert rows(mk.running_high_low(t), "symbol", "seq", "running_high", "running_low") == rows(expected, "symbol", "seq", "hi", "lo")
    assert rows(mk.tick_direction(t), "symbol", "seq", "price_direction") == rows(expected, "symbol", "seq", "dir")
    carried = rows(mk.carry_change(t, ttl="20 minutes"), "symbol", "seq", "shown_change")
    monkeypatch.setattr(mk, "with_runs", lambda df, keys, order: real(df, keys, order))
    assert carried == rows(mk.carry_change(t, ttl="20 minutes"), "symbol", "seq", "shown_change")


def test_change_and_percent_are_carried_apart(make_ticks, rows):
    t = make_ticks(*[("A", f"2024-01-02 02:{m:02d}:00", 1, 1, 1, 1, c) for m, c in ((0, 1.5), (1, 0.0), (2, 2.5), (3, 0.0))])
    t = t.withColumn("change_percent", F.when(F.col("seq") == 1, 9.0).when(F.col("seq") == 3, F.lit(None)).otherwise(0.0))
    got = rows(mk.carry_change(t), "seq", "shown_change", "shown_change_percent")
    assert got == [(0, 1.5, 0.0), (1, 1.5, 9.0), (2, 2.5, 9.0), (3, 2.5, 9.0)]


def test_high_and_low_of_the_session_only(make_ticks, rows):
    # the market opens at 02:00 and closes at 08:00
    t = make_ticks(*[("A", f"2024-01-02 {h}", p, 1) for h, p in (("01:59:59", 99), ("02:00:00", 5), ("07:59:59", 7), ("08:00:00", 1))])
    got = rows(mk.running_high_low(t, trading_hours=True), "seq", "running_high", "running_low")
    assert got == [(0, None, None), (1, 5.0, 5.0), (2, 7.0, 5.0), (3, 7.0, 5.0)]
    weekend = make_ticks(("A", "2024-01-06 03:00:00", 5, 1))
    assert rows(mk.running_high_low(weekend, trading_hours=True), "running_high") == [(None,)]
