import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from quotemill.operators import filters as fl
from quotemill.operators import joins as jn
from quotemill.operators import news as nw

D = dt.date
NOW = dt.datetime(2024, 3, 15, 12, 0)


def news(spark, *items):
    """(article_id, code, day, content, score)"""
    schema = "article_id string, stock_code string, news_date date, content string, sentiment_score double"
    return spark.createDataFrame(list(items), schema).withColumns({"date": F.col("news_date").cast("timestamp"), "title": F.lit("t")})


def prices(spark, *items):
    schema = "stock_code string, trade_date date, open double, high double, low double, close double, volume bigint"
    return spark.createDataFrame([(c, d, x, x, x, x, 1) for c, d, x in items], schema)


def test_mentions_are_whole_words(spark, rows):
    n = news(
        spark,
        ("1", "FPT", D(2024, 1, 1), "fpt rises, VCB_x and VCB! éSSI SSIé ssi", None),
        ("2", "FPT", D(2024, 1, 1), "FPTS only", None),
        ("3", "VCB", D(2024, 1, 1), None, None),
    )
    dim = spark.createDataFrame([("FPT",), ("VCB",), ("SSI",)], "stock_code string")
    assert rows(nw.mention_pairs(n, dim), "article_id", "mentioned") == [("1", "FPT"), ("1", "SSI"), ("1", "VCB")]


def test_related_companies_need_the_own_code(spark, rows):
    n = news(
        spark,
        ("1", "A", D(2024, 1, 1), "A with B and C", None),
        ("2", "A", D(2024, 1, 1), "a and C, C again", None),
        ("3", "A", D(2024, 1, 1), "only D and B", None),
        ("4", "A", D(2024, 6, 1), "A D", None),
    )
    dim = spark.createDataFrame([(c,) for c in "ABCD"], "stock_code string")
    got = rows(nw.related_companies(n, dim), "stock_code", "partner", "n_articles", "position")
    assert got == [("A", "B", 1, 2), ("A", "C", 2, 1), ("A", "D", 1, 3)]
    assert rows(nw.related_companies(n, dim, k=1, end_date="2024-06-01"), "partner") == [("C",)]


def test_sentiment_joins(spark, rows):
    n = news(spark, ("1", "A", D(2024, 1, 1), "x", 0.5), ("2", "A", D(2024, 1, 1), "x", -1.0), ("3", "B", D(2024, 1, 1), "x", 1.0))
    p = prices(spark, ("A", D(2024, 1, 1), 1.0), ("A", D(2024, 1, 2), 2.0))
    assert rows(jn.join_sentiment(p, n), "trade_date", "polarity") == [(D(2024, 1, 1), -0.25), (D(2024, 1, 2), None)]
    pairs = spark.createDataFrame([("A", "B")], "stock_code string, partner string")
    got = jn.related_sentiment_map(p, n, pairs).orderBy("trade_date").collect()
    assert [r["related_polarity"] for r in got] == [{"b": 1.0}, {"b": 0.0}]


def test_training_view_and_hot_days(spark, rows):
    n = news(spark, *[(str(i), "A", D(2024, 1, 1), "x", float(i)) for i in range(50)], ("x", "B", D(2024, 1, 1), "x", None))
    p = prices(spark, ("A", D(2024, 1, 1), 1.0), ("A", D(2024, 1, 2), 2.0), ("B", D(2024, 1, 1), 3.0), ("Z", D(2024, 1, 1), 3.0))
    dim = spark.createDataFrame([("A", "HSX"), ("B", "HNX")], "stock_code string, exchange string")
    got = jn.training_view(p, dim, n, "2024-01-01")
    assert got.count() == 52
    assert rows(got.filter("article_id is null"), "stock_code", "trade_date") == [("A", D(2024, 1, 2))]
    keys = ["stock_code", "trade_date"]
    articles = n.withColumn("trade_date", F.col("news_date"))
    counts = articles.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    split = jn.salted_join(articles, p, keys, ["article_id"], counts, limit=4)
    assert rows(split, "article_id", "close") == rows(articles.join(p, keys), "article_id", "close")


def test_join_actuals_uses_the_weekday_before(spark, rows):
    pred = spark.createDataFrame([("A", D(2024, 1, 8), 5.0), ("A", D(2024, 1, 9), 5.0)], "stock_code string, prediction_date date, predicted_price double")
    daily = prices(spark, ("A", D(2024, 1, 5), 4.0), ("A", D(2024, 1, 8), 6.0))
    assert rows(jn.join_actuals(pred, daily), "prediction_date", "prev_close", "actual_close") == [(D(2024, 1, 8), 4.0, 6.0)]


def test_new_and_unprocessed(spark, rows):
    schema = "stock_code string, date timestamp, article_id string, is_pdf boolean, pdf_link string"
    at = dt.datetime(2024, 1, 1)
    all_rows = spark.createDataFrame([("A", at, "1", True, "l"), ("A", at, "2", True, ""), ("A", at, "3", False, "l"), ("A", at, "4", True, "l"), ("A", at, "5", True, "l")], schema)
    done = all_rows.filter("article_id = '1'")
    assert rows(jn.unprocessed(all_rows, done), "article_id") == [("4",), ("5",)]
    assert rows(jn.unprocessed(all_rows, done, 1), "article_key") == [("A|2024-01-01 00:00:00|4",)]
    assert rows(jn.new_articles(all_rows, done), "article_id") == [("2",), ("3",), ("4",), ("5",)]


def test_news_filters(spark, rows):
    n = news(spark, *[(str(i), "A", d, c, None) for i, (d, c) in enumerate([
        (D(2024, 3, 15), "Profit 50%"), (D(2024, 3, 9), "loss"), (D(2024, 3, 1), "Profit"), (D(2023, 4, 1), "Profit"), (D(2023, 3, 1), "Profit"),
    ])])
    ids = lambda df: "".join(r[0] for r in rows(df, "article_id"))
    assert ids(fl.news_filter(n, NOW)) == "0123"
    assert ids(fl.news_filter(n, NOW, time_filter="today")) == "0"
    assert ids(fl.news_filter(n, NOW, time_filter="week")) == "01"
    assert ids(fl.news_filter(n, NOW, time_filter="month")) == "012"
    assert ids(fl.news_filter(n, NOW, time_filter="today", from_date="2023-03-01", to_date="2023-04-01")) == "34"
    assert ids(fl.news_filter(n, NOW, search="Pro_it")) == "023"
    assert ids(fl.news_filter(n, NOW, codes=["B"])) == ""
    assert ids(fl.text_search(n, "profit")) == ""
    assert ids(fl.news_recent_filter(n, "month", NOW)) == "012"
    assert ids(fl.news_recent_filter(n, "custom", NOW, end="2024-03-01")) == "234"
    assert ids(fl.news_recent_filter(n, "custom", NOW)) == "01234"
    assert ids(nw.recent_news(n, NOW, 3, 5)) == "0"


def test_sector_reports(spark, rows):
    n = news(spark, *[(str(i), c, D(2024, 1, 1), "x", None) for i, c in enumerate(["A.VN", "A", "A", "B", "Q"])])
    sectors = spark.createDataFrame([("A", "real_estate"), ("B", "energy"), ("C", "energy")], "stock_code string, sector string")
    assert rows(nw.sector_counts(n, sectors)) == [("all", "All", 3), ("energy", "Energy", 1), ("real_estate", "Real Estate", 1)]
    plain = n.filter("stock_code <> 'A.VN'")
    assert rows(nw.news_by_sector(plain, sectors), "sector", "sector_total", "n_news", "stock_code", "share_percent") == [
        ("energy", 1, 4, "B", 25.0), ("real_estate", 2, 4, "A", 50.0),
    ]


def test_sorting_and_pages(spark):
    df = spark.createDataFrame([("1", "02-01-2024"), ("2", "x"), ("3", "01-02-2024 08:00:00+0700"), ("4", None)], "article_id string, date string")
    assert [r["article_id"] for r in nw.sort_news(df).collect()] == ["3", "1", "2", "4"]
    got = nw.page(spark.range(45), 3, ["id"]).collect()
    assert ([r["id"] for r in got], got[0]["total_pages"]) == (list(range(40, 45)), 3)


def test_scoring(spark):
    schema = "article_id string, is_pdf boolean, content string, link string, pdf_link string"
    df = spark.createDataFrame(
        [("1", False, "Profit profit LOSS", "l", None), ("2", False, None, "l", None), ("3", True, "profit", "l", "p"), ("4", False, "bad", "l", None), ("5", False, "x" * 1000 + "profit", "l", None)],
        schema,
    )
    got = {r["article_id"]: r["sentiment_score"] for r in nw.score_articles(df).collect()}
    assert {k: round(v, 4) for k, v in got.items()} == {"1": 0.3333, "2": 0.0, "3": 1.0, "4": 0.0, "5": 0.0}

    def scorer(texts: pd.Series) -> pd.Series:
        if (texts == "bad").any():
            raise ValueError("cannot score")
        return texts.str.len().astype(float)

    got = {r["article_id"]: r["sentiment_score"] for r in nw.score_articles(df, scorer, lambda links: links.map({"p": -7.0})).collect()}
    assert got == {"1": 1.0, "2": 0.0, "3": -1.0, "4": 0.0, "5": 1.0}


def test_pdf_bytes_then_text_then_nothing(spark, tmp_path):
    """The scorer gets the file's bytes and the stock's code; what it can't read goes by the text."""
    for name, text in (("a.pdf", b"+1"), ("b.pdf", b"broken"), ("c.pdf", b"-1")):
        (tmp_path / name).write_bytes(text)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    link = lambda n: f"file:{tmp_path}/{n}"
    rows = [
        (1, "FPT", True, link("a.pdf"), "loss"), (2, "FPT", True, link("b.pdf"), "profit"), (3, "VCB", True, link("c.pdf"), None),
        (4, "VCB", True, link("none.pdf"), "loss"), (5, "VCB", True, None, None), (6, "VCB", False, link("a.pdf"), "profit loss gain"),
    ]
    news = spark.createDataFrame([(*r[:4], None, r[4]) for r in rows], "id int, stock_code string, is_pdf boolean, pdf_link string, link string, content string")

    def read(files, codes):
        return pd.Series([float(bytes(f)) / (2 if c == "VCB" else 1) for f, c in zip(files, codes)])

    got = nw.score_articles(news, pdf_scorer=read, code_col="stock_code", pdfs=files)
    assert got.columns == [*news.columns, "sentiment_score"]
    assert {r["id"]: round(r["sentiment_score"], 3) for r in got.collect()} == {1: 1.0, 2: 1.0, 3: -0.5, 4: -1.0, 5: 0.0, 6: 0.333}

    def of_stock(texts, codes):
        return pd.Series([1.0 if c in t else 0.5 for t, c in zip(texts, codes)])

    named = news.filter("NOT is_pdf").withColumn("content", F.lit("VCB rises"))
    assert nw.score_articles(named, of_stock, code_col="stock_code").first()["sentiment_score"] == 1.0
