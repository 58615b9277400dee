import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators import alphas as al
from quotemill.operators import indicators as ind
from quotemill.operators import predict as pr

D = dt.date
START = D(2024, 1, 1)


def bars(spark, closes, code="A", volume=10):
    rows = [(code, START + dt.timedelta(days=i), float(c), float(c), float(c), float(c), volume) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "stock_code string, trade_date date, open double, high double, low double, close double, volume bigint")


def test_indicators_on_rising_bars(spark):
    got = ind.indicators(bars(spark, range(1, 41))).orderBy("trade_date").toPandas()
    assert got["SMA_5"].isna().sum() == 4 and got["SMA_5"].iloc[4] == 3.0
    assert got["SMA_20"].first_valid_index() == 19 and got["EMA_10"].first_valid_index() == 9
    assert got["RSI_14"].first_valid_index() == 13 and (got["RSI_14"].dropna() == 100).all()
    assert got["MACD"].first_valid_index() == 25 and got["MACD_Signal"].first_valid_index() == 33
    assert got["Momentum_3"].iloc[3] == 300.0
    assert got["OBV"].iloc[-1] == 400.0
    spread = np.std(np.arange(21, 41)) * 2
    assert got["BB_Upper"].iloc[-1] == pytest.approx(30.5 + spread) and got["BB_Lower"].iloc[-1] == pytest.approx(30.5 - spread)


def test_indicators_match_a_loop(spark):
    rng = np.random.default_rng(3)
    close = np.round(50 + rng.normal(size=80).cumsum(), 2)
    got = ind.indicators(bars(spark, close)).orderBy("trade_date").toPandas()
    ema, gain, loss = close[0], 0.0, 0.0
    for i in range(1, len(close)):
        ema += (close[i] - ema) * 2 / 11
        step = close[i] - close[i - 1]
        gain, loss = gain + (max(step, 0) - gain) / 14, loss + (max(-step, 0) - loss) / 14
    assert got["EMA_10"].iloc[-1] == pytest.approx(ema)
    assert got["RSI_14"].iloc[-1] == pytest.approx(100 - 100 / (1 + gain / loss))


def test_constant_and_single_bars(spark):
    flat = ind.indicators(bars(spark, [5] * 40)).orderBy("trade_date").toPandas().iloc[-1]
    assert (flat["RSI_14"], flat["MACD"], flat["BB_Upper"], flat["Momentum_3"]) == (100.0, 0.0, 5.0, 0.0)
    single = ind.indicators(bars(spark, [5])).first()
    assert single["EMA_10"] is None and single["OBV"] == 10.0


def news_frame(spark, *items):
    return spark.createDataFrame(list(items), "article_id string, stock_code string, news_date date, content string, sentiment_score double")


def test_feature_frame_cuts_news_at_the_end_date(spark):
    prices = bars(spark, range(1, 51))
    day = START + dt.timedelta(days=40)
    news = news_frame(spark, ("1", "A", day, "A and B", 1.0), ("2", "A", START + dt.timedelta(days=60), "A and C", 1.0), ("3", "B", day, "x", -1.0))
    dim = spark.createDataFrame([(c,) for c in "ABC"], "stock_code string")
    cut = START + dt.timedelta(days=45)
    got = {r["trade_date"]: r for r in ind.feature_frame(prices, news, dim, cut.isoformat()).collect()}
    assert max(got) == cut - dt.timedelta(days=1) and min(got) == START + dt.timedelta(days=33)
    assert got[day]["polarity"] == 1.0 and got[day]["related_polarity"] == {"b": -1.0}
    assert got[min(got)]["polarity"] == 0.0 and got[min(got)]["related_polarity"] == {"b": 0.0}


def test_fill_gaps(spark):
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate([None, float("inf"), 2.0, float("nan"), 3.0])] + [("B", 0, None)], "stock_code string, trade_date int, x double")
    got = ind.fill_gaps(df, ["x"]).orderBy("stock_code", "trade_date").collect()
    assert [r["x"] for r in got] == [2.0, 2.0, 2.0, 2.0, 3.0, 0.0]


def features(spark, n=30, code="A", seed=1):
    rng = np.random.default_rng(seed)
    data = {c: rng.normal(size=n).round(3) + 10 for c in al.NUMERIC}
    pdf = pd.DataFrame({"stock_code": code, "trade_date": [START + dt.timedelta(days=i) for i in range(n)], **data, "polarity": 0.5})
    pdf["volume"] = 100
    df = spark.createDataFrame(pdf)
    return df.withColumns({"volume": F.col("volume").cast("bigint"), "related_polarity": F.create_map(F.lit("vcb"), F.lit(0.25))})


CATALOG = [
    ("A", "Alpha1 = close - open"), ("A", "a_polarity + vcb_polarity"), ("A", "fpt_polarity"), ("A", "close.shift(1)"),
    ("A", "close / (volume - 100)"), ("A", "close >= open"), ("B", "close"),
]


def test_apply_alphas(spark, rows):
    f = features(spark).unionByName(features(spark, code="B", seed=2))
    catalog = spark.createDataFrame(CATALOG, "stock_code string, formula string")
    by_column = al.apply_alphas(f, catalog)
    many = spark.createDataFrame([("B", f"close + {i}") for i in range(120)] + [("B", "(open / (volume - 100) > 0) + 1"), ("B", "A_Polarity")], catalog.schema)
    of_many = al.apply_alphas(f, catalog.unionByName(many))
    assert rows(of_many.filter("stock_code = 'A'")) == rows(by_column.filter("stock_code = 'A'"))
    assert of_many.filter("stock_code = 'B'").select("formula").distinct().count() == 122
    assert of_many.filter("formula like '%> 0%' and value is not null").count() == 0
    kinds = {(r["stock_code"], r["formula"]) for r in by_column.select("stock_code", "formula").distinct().collect()}
    assert kinds == {("A", "Alpha1 = close - open"), ("A", "a_polarity + vcb_polarity"), ("A", "close / (volume - 100)"), ("A", "close >= open"), ("B", "close")}
    polar = by_column.filter("formula like '%vcb%'").agg(F.min("value"), F.max("value")).first()
    assert tuple(polar) == (0.75, 0.75)
    assert by_column.filter("formula like '%volume%' and value is not null").count() == 0


def spearman(a, b):
    return pd.Series(a).rank().corr(pd.Series(b).rank())


def pairs(spark, values, returns):
    n = len(values)
    days = [START + dt.timedelta(days=i) for i in range(n)]
    a = spark.createDataFrame([("A", d, "f", None if v is None else float(v)) for d, v in zip(days, values)], "stock_code string, trade_date date, formula string, value double")
    r = spark.createDataFrame([("A", d, float(x)) for d, x in zip(days, returns)], "stock_code string, trade_date date, future_return double")
    return a, r


def test_rank_ic(spark):
    a, b = [1, 2, 2, 3, 5, 4, 4, 4, 9, 7], [3, 1, 2, 2, 6, 8, 7, 7, 5, 9]
    got = al.rank_ic(*pairs(spark, a, b)).first()
    assert got["rank_ic"] == pytest.approx(spearman(a, b)) and got["n_samples"] == 10
    t = got["rank_ic"] * math.sqrt(8 / (1 - got["rank_ic"] ** 2))
    grid = np.linspace(abs(t), 400, 4_000_001)
    density = math.gamma(4.5) / math.sqrt(8 * math.pi) / math.gamma(4) * (1 + grid**2 / 8) ** -4.5
    tail = float(np.sum((density[1:] + density[:-1]) / 2) * (grid[1] - grid[0]))
    assert got["pvalue"] == pytest.approx(2 * tail, rel=1e-4)
    mono = al.rank_ic(*pairs(spark, np.exp(a), b)).first()
    assert mono["rank_ic"] == pytest.approx(got["rank_ic"])
    assert tuple(al.rank_ic(*pairs(spark, a[:9], b[:9])).first())[2:] == (None, None, 0)
    assert al.rank_ic(*pairs(spark, [1] * 10, b)).first()["rank_ic"] is None
    assert al.rank_ic(*pairs(spark, [None, *a[1:]], b)).first()["n_samples"] == 0
    perfect = al.rank_ic(*pairs(spark, range(12), range(12))).first()
    assert perfect["rank_ic"] == pytest.approx(1.0) and perfect["pvalue"] == pytest.approx(0.0, abs=1e-12)


@pytest.mark.parametrize("r, n, p", [(0.0, 10, 1.0), (0.632, 10, 0.0500), (0.5, 3, 2 / 3), (-0.3, 100, 0.00243), (0.5, 4, 0.5), (1.0, 7, 0.0), (None, 9, None), (0.5, 2, None)])
def test_pvalue(spark, r, n, p):
    row = spark.createDataFrame([(r, n)], "r double, n long").select(al.correlation_pvalue("r", "n")).first()
    assert row[0] == (p if p is None else pytest.approx(p, rel=0.01, abs=1e-12))


@pytest.mark.parametrize("n", [3, 4, 5, 6, 9, 10, 31, 200, 1001])
def test_pvalue_is_the_tail_of_t(spark, n):
    """Against the density of t, summed over a fine grid of angles."""
    df = n - 2
    rs = [0.01, 0.2, -0.6, 0.9]
    got = [x[0] for x in spark.createDataFrame([(r, n) for r in rs], "r double, n int").select(al.correlation_pvalue("r", "n")).collect()]
    # with t = sqrt(df) tan(a), the density of a is cos(a)^(df - 1), and sin(a) = r
    angle = (np.arange(2_000_000) + 0.5) * (math.pi / 2 / 2_000_000)
    weight = np.cos(angle) ** (df - 1)
    for r, p in zip(rs, got):
        assert p == pytest.approx(weight[angle > math.asin(abs(r))].sum() / weight.sum(), rel=1e-4, abs=1e-9)


def test_selection_and_audit(spark, rows):
    scores = spark.createDataFrame([("A", f"f{i}", x) for i, x in enumerate([0.1, None, -0.5, 0.9, 0.1, 0.2])] + [("B", "f", 0.5)], "stock_code string, formula string, rank_ic double")
    got = al.select_best_alphas(scores).orderBy("position").collect()
    assert [r["formula"] for r in got] == ["f3", "f5", "f0", "f4", "f2"]
    catalog = spark.createDataFrame([("A", "close"), ("A", " "), ("B", "x.max()"), ("B", "x.max(")] + [("C", f"f{i}") for i in range(5)], "stock_code string, formula string")
    assert rows(al.audit_formulas(catalog), "stock_code", "issue") == [
        ("A", "empty"), ("A", "wrong number of formulas"), ("B", "forbidden call"), ("B", "forbidden call"), ("B", "wrong number of formulas"),
    ]
    pool = al.formula_pool(catalog, spark.createDataFrame([("A", "close"), ("A", "old")], "stock_code string, alpha_formula string"))
    assert rows(pool.filter("stock_code = 'A'"), "formula") == [(" ",), ("close",), ("old",)]


def test_sequences_and_windows(spark):
    df = bars(spark, range(10, 18))
    got = pr.sequences(df, ["open", "volume"], w=5).orderBy("first_date").collect()
    assert len(got) == 3
    assert got[0]["closes"] == [10, 11, 12, 13, 14] and got[0]["target"] == 15
    assert got[0]["inputs"][4] == [14.0, 10.0] and got[0]["calendar"][0] == [0.0, 0.0, 0.0]
    last = pr.last_windows(df, ["open"], w=5).first()
    assert last["closes"] == [13, 14, 15, 16, 17] and last["last_date"] == START + dt.timedelta(days=7)
    assert pr.last_windows(df.limit(3), ["open"], w=5).count() == 0


def test_scaling(spark):
    df = bars(spark, [1, 3, 5])
    fitted = pr.minmax_fit(df, ["close", "volume"])
    scaled = pr.minmax_apply(df, fitted, ["close", "volume"])
    assert sorted((r["close_scaled"], r["volume_scaled"]) for r in scaled.collect()) == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]
    back = pr.minmax_invert(scaled, fitted, "close_scaled", "close", "again")
    assert sorted(r["again"] for r in back.collect()) == [1, 3, 5]


def test_training_picks_per_stock_and_predicts(spark):
    line = bars(spark, [100 + i for i in range(80)], "UP").unionByName(bars(spark, [50 + 10 * math.sin(i / 4) for i in range(80)], "WAVE"))
    short = bars(spark, range(20), "SHORT")
    trained = pr.train_and_validate(line.unionByName(short), ["open"], trees=5)
    best = trained.best()
    got = {r["stock_code"]: r for r in best.collect()}
    assert set(got) == {"UP", "WAVE"} and got["UP"]["n_windows"] == 75
    assert got["UP"]["mse_loss"] < 0.01
    predicted = {r["stock_code"]: r["predicted_price"] for r in pr.predict_next_close(trained, line, best).collect()}
    assert predicted["UP"] == pytest.approx(180, abs=5)


def test_champion_and_registry(spark, rows):
    new = spark.createDataFrame([("A", "n_A", 0.3), ("B", "n_B", 0.1)], "stock_code string, model_name string, mse_loss double")
    old = spark.createDataFrame([("A", "o_A", 0.2), ("B", "o_B", 0.1)], "stock_code string, model_name string, mse_loss double")
    assert rows(pr.champion(new, old), "model_name", "new_model_used") == [("n_B", True), ("o_A", False)]
    runs = spark.createDataFrame(
        [("StockModel_A_20240101_1_X", "01/01/2024", 0.5, "[]"), ("StockModel_A_20240101_2_Y", "01/01/2024", 0.2, "[]"), ("StockModel_AB_20240101_2_Y", "01/01/2024", 0.1, "[]"), ("StockModel_A_20231231_2_Y", "31/12/2023", 0.1, "[]")],
        "model_name string, date_train string, mse_loss double, alphas string",
    )
    assert rows(pr.best_model(runs, "A", "2024-01-01"), "model_name") == [("StockModel_A_20240101_2_Y",)]
    history = pr.training_history(runs).collect()
    assert [r["date_train"] for r in history] == ["01/01/2024"] * 3 + ["31/12/2023"]
    ok = spark.createDataFrame([(1.0, 1.0), (float("nan"), 1.0), (1.0, float("inf")), (None, 1.0)], "predicted_price double, confidence_score double")
    assert pr.saveable(ok).count() == 1


def predictions(spark, *items):
    return spark.createDataFrame([("A", d, float(p), 0.5) for d, p in items], "stock_code string, prediction_date date, predicted_price double, confidence_score double")


def test_evaluation(spark, rows):
    # Monday 1st to Friday 5th, then Monday 8th
    closes = {1: 10, 2: 12, 3: 11, 4: 11, 5: 13, 8: 9}
    daily = spark.createDataFrame([("A", D(2024, 1, d), float(c)) for d, c in closes.items()], "stock_code string, trade_date date, close double")
    pred = predictions(spark, (D(2024, 1, 2), 11), (D(2024, 1, 3), 13), (D(2024, 1, 4), 11), (D(2024, 1, 8), 20), (D(2024, 1, 9), 10))
    assert rows(pr.prediction_accuracy(pred, daily), "correct", "total", "accuracy") == [(2, 4, 50.0)]
    history = rows(pr.prediction_history(pred, daily, 3), "prediction_date", "predicted_value", "actual_value", "is_correct")
    assert history == [(D(2024, 1, 4), 0, 0, True), (D(2024, 1, 5), 0, 1, None), (D(2024, 1, 8), 1, -1, False)]
    assert rows(pr.next_day_outlook(pred, daily), "prediction_date", "trend") == [(D(2024, 1, 9), "up")]
    assert rows(pr.latest_predictions(pred), "prediction_date") == [(D(2024, 1, 9),)]
    assert [r["prediction_date"].day for r in pr.predictions_history(pred, "A").collect()] == [9, 8, 4, 3, 2]


def test_tail_and_period(spark, rows):
    df = bars(spark, range(1, 11))
    assert rows(pr.tail_by_key(df, 2), "close") == [(10.0,), (9.0,)]
    assert rows(pr.period_summary(df, 3)) == [("A", 10.0, 8.0, 10.0)]
    plan = pr.tail_by_key(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_least_squares_by_stock(spark):
    import numpy as np

    from quotemill.operators import predict as pr

    rng = np.random.default_rng(5)
    rows, want = [], {}
    for code, n in (("A", 40), ("B", 300), ("C", 2)):
        x = rng.normal(size=(n, 3))
        x[:, 2] = 2 * x[:, 1] if code == "B" else x[:, 2]  # features that depend on each other
        y = x @ [1.5, -2.0, 0.5] + 3 + rng.normal(size=n) / 10
        want[code] = (x, np.c_[x, np.ones(n)] @ np.linalg.lstsq(np.c_[x, np.ones(n)], y, rcond=None)[0])
        rows += [(code, i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "stock_code string, i int, features array<double>, target double").repartition(5)
    fitted = pr.least_squares(df)
    got = df.join(fitted, "stock_code").withColumn("v", pr.linear_value("weights", "features")).collect()
    assert len(got) == 342
    assert all(abs(r["v"] - want[r["stock_code"]][1][r["i"]]) < 1e-6 for r in got)
    narrow = {r["stock_code"]: r["weights"] for r in pr.least_squares(df, ridge=1e6).collect()}
    assert all(abs(w) < 1e-4 for w in narrow["A"][:3]) and abs(narrow["A"][3] - 3) < 1
