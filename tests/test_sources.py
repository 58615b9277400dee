import datetime as dt
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill import schemas
from quotemill.sources import articles as ar
from quotemill.sources import files as fs
from quotemill.sources import tables as tb

D = dt.date


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_normalize_quotes_defaults(spark):
    raw = spark.createDataFrame([("FPT.VN", "12.5", None), (None, "x", "17")], "id string, price string, last_size string")
    got = fs.normalize_quotes(raw, F.lit(99)).collect()
    assert [(r["symbol"], r["price"], r["last_size"], r["timestamp"], r["day_volume"], r["producer_timestamp"]) for r in got] == [
        ("FPT.VN", 12.5, 0, "", 0, 99), ("", 0.0, 17, "", 0, 99),
    ]
    assert got and fs.normalize_quotes(raw).schema.names == schemas.TICK.names


def test_read_ticks_and_rejects(spark, tmp_path):
    path = write(tmp_path / "t.json", '{"symbol":"A","price":1.5,"timestamp":"1761185959000"}\n{"symbol":"A","price":2.5,"timestamp":"junk"}\n')
    ok, bad = fs.split_unparsed(fs.read_ticks(spark, path, fmt="json"))
    assert [r["price"] for r in ok.collect()] == [1.5]
    assert [r["price"] for r in bad.collect()] == [2.5]


def test_daily_csv(spark, tmp_path):
    head = ",".join(schemas.DAILY.names)
    path = write(tmp_path / "d.csv", f"{head}\nA,2024-01-02,1.5,,0,2,10,,,,HSX,1,1\n,2024-01-02,1,1,1,1,1,,,,,,\nB,02/01/2024,1,1,1,1,x,,,,,,\n")
    good, bad = fs.load_daily_csv(spark, path)
    row = good.collect()
    assert [(r["symbol"], r["trade_date"], r["open"], r["high"], r["low"], r["volume"]) for r in row] == [("A", D(2024, 1, 2), 1.5, None, 0.0, 10)]
    assert sorted(tuple(r["reject_reasons"]) for r in bad.collect()) == [("symbol missing",), ("trade_date unreadable", "volume unreadable")]


def test_bars_csv_defaults_interval(spark, tmp_path):
    head = ",".join(schemas.BARS.names)
    path = write(tmp_path / "b.csv", f"{head}\nA,2024-01-02,,2024-01-02 09:00:00.000000+0700,1,1,1,1,5,1\nA,2024-01-02,5m,2024-01-02 02:05:00Z,1,1,1,1,5,1\n")
    good, _ = fs.load_bars_csv(spark, path)
    assert sorted((r["interval"], r["ts"]) for r in good.collect()) == [("1m", dt.datetime(2024, 1, 2, 2)), ("5m", dt.datetime(2024, 1, 2, 2, 5))]


def test_news_csv_long_quoted_content(spark, tmp_path):
    head = ",".join(schemas.NEWS.names)
    text = 'line one\nsays ""buy"", ' + "x" * 200_000
    path = write(tmp_path / "n.csv", f'{head}\n7,A,T,l,2024-01-02 03:04:05.678+0000,Yes,"{text}",0.5,,\n8,A,T,l,never,no,c,,,\n,A,T,l,2024-01-02,no,c,,,\n')
    good, bad = fs.load_news_csv(spark, path)
    row = good.collect()[0]
    assert (row["article_id"], row["is_pdf"], row["date"]) == ("7", True, dt.datetime(2024, 1, 2, 3, 4, 5, 678000))
    assert row["content"].startswith('line one\nsays "buy", x') and len(row["content"]) == len(text) - 2
    assert good.count() == 1 and bad.count() == 2


def test_catalog_reports_broken_files(spark, tmp_path, rows):
    write(tmp_path / "ok.json", '{"FPT": ["close", "open / close"], "VCB": []}')
    write(tmp_path / "cut.json", '{"FPT": ["close", "op')
    good, bad = fs.read_alpha_catalog(spark, str(tmp_path))
    assert rows(good) == [("FPT", 0, "close"), ("FPT", 1, "open / close")]
    assert [os.path.basename(r["file"]) for r in bad.collect()] == ["cut.json"]


def test_results_and_export(spark, tmp_path):
    from quotemill.operators.predict import run_summary

    a = write(tmp_path / "a.json", '[{"stock_code":"A","predicted_price":1.5,"saved":true},\n {"stock_code":"B","error":"no data"}]')
    b = write(tmp_path / "b.json", '[{"stock_code":"C","error":"x","total_time":2.5}]')
    got = fs.read_results(spark, [a, b])
    assert tuple(run_summary(got).first()) == (3, 1, 2)
    fs.export_csv(got.select("stock_code", "error"), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert sorted((r[0], r[1]) for r in back.collect()) == [("A", None), ("B", "no data"), ("C", "x")]


def test_model_runs_are_parsed(spark):
    runs = spark.createDataFrame([("StockModel_FPT_20251115_010203_LSTM", "15/11/2025", 0.1, '["a"]')], schemas.MODEL_RUNS)
    r = fs.read_model_runs(runs).first()
    assert (r["stock_code"], r["model_type"], r["trained_on"], r["formulas"]) == ("FPT", "LSTM", D(2025, 11, 15), ["a"])


def daily_table(path):
    return tb.Table(str(path), schemas.columns("code string, day date, a bigint, b string"), ("code", "day"), "day")


def test_upsert_by_date(spark, tmp_path, rows):
    table = daily_table(tmp_path / "t")
    assert table.read(spark).count() == 0
    make = lambda *r: spark.createDataFrame(list(r), table.schema)
    tb.upsert(table, make(("A", D(2024, 1, 1), 1, "x"), ("B", D(2024, 1, 1), 2, "y"), ("A", D(2024, 1, 2), 3, "z")))
    first = tb.Versions(spark, table.path).latest().folders["day=2024-01-01"]
    changes = make(("A", D(2024, 1, 2), 30, "new"), ("A", D(2024, 1, 2), 20, "old"), ("C", D(2024, 1, 2), 5, "w"))
    for _ in range(2):  # a replay changes nothing
        tb.upsert(table, changes, update_cols=["a"], order=["a"])
        assert rows(table.read(spark), "code", "day", "a", "b") == [
            ("A", D(2024, 1, 1), 1, "x"), ("A", D(2024, 1, 2), 30, "z"), ("B", D(2024, 1, 1), 2, "y"), ("C", D(2024, 1, 2), 5, "w"),
        ]
    assert tb.Versions(spark, table.path).latest().folders["day=2024-01-01"] == first
    tb.upsert(table, make(("A", D(2024, 1, 1), 9, "q"), ("D", D(2024, 1, 1), 9, "q")), do_nothing=True)
    assert rows(table.read(spark).filter("day = '2024-01-01'"), "code", "a") == [("A", 1), ("B", 2), ("D", 9)]


def test_replace_and_delete(spark, tmp_path, rows):
    schema = schemas.columns("code string, formula string, ic double")
    table = tb.Table(str(tmp_path / "t"), schema, ("code", "formula"), buckets=4)
    make = lambda *r: spark.createDataFrame(list(r), schema)
    tb.upsert(table, make(("A", "f1", 0.1), ("A", "f2", 0.2), ("B", "f1", 0.3)))
    tb.replace_by_key(table, make(("A", "f3", 0.9)), ["code"])
    assert rows(table.read(spark)) == [("A", "f3", 0.9), ("B", "f1", 0.3)]
    tb.delete_by_key(table, spark.createDataFrame([("A",)], "code string"), ["code"])
    assert rows(table.read(spark)) == [("B", "f1", 0.3)]
    tb.delete_by_key(table, spark.createDataFrame([("B",)], "code string"), ["code"])
    assert table.read(spark).count() == 0


def test_small_reads(spark, rows):
    df = spark.createDataFrame([("A", 2, "late"), ("A", 1, "first"), ("B", 1, "only")], "k string, n int, v string")
    assert rows(tb.dedupe_first(df, ["k"], ["n"])) == [("A", 1, "first"), ("B", 1, "only")]
    assert rows(tb.last_per_key(df, ["k"], ["n"])) == [("A", 2, "late"), ("B", 1, "only")]
    assert rows(tb.distinct_symbols(df, "k")) == [("A",), ("B",)]
    assert rows(tb.high_water_mark(df, "n")) == [(2,)]
    assert rows(tb.high_water_mark(df.filter("n > 5"), "n")) == [(None,)]
    assert rows(tb.table_counts({"x": df, "y": df.limit(1)})) == [("x", 3), ("y", 1)]
    dim = spark.createDataFrame([("A",)], "k string")
    assert rows(tb.missing_parents(df, dim, "k"), "k") == [("B",)]


PAGE = """<html><head><title>Up &amp; away</title><script>var p = "<p class='pBody'>no</p>";</script></head><body>
<a href="/one">1</a><span class="datenew"> 02-01-2024 </span><span class="datenew">later</span>
<div id="vst_detail"><p class="pBody">First <b>bold</b> text</p><p>skip</p><p class="x pBody">Second</p></div>
<p class="pBody">outside</p></body></html>"""
PDF = """<title>Report</title><div id="vst_detail"><table><tr><td>Tài liệu đính kèm:</td><td><a href="f.pdf">x</a></td></tr></table>
<p class="pBody">ignored</p></div>"""


def test_extract_articles(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, PDF), (3, None), (4, "<p class='pBody'>open <b>")], "page_id int, html string")
    got = {r["page_id"]: r for r in ar.extract_articles(pages).collect()}
    assert (got[1]["title"], got[1]["date"], got[1]["is_pdf"], got[1]["content"]) == ("Up & away", "02-01-2024", False, "First bold text Second")
    assert got[1]["links"] == ["/one"] and got[1]["pdf_link"] is None
    assert (got[2]["is_pdf"], got[2]["pdf_link"], got[2]["content"]) == (True, "f.pdf", None)
    assert (got[3]["title"], got[3]["content"], got[3]["date"]) == ("", "", None)
    whole = ar.extract_articles(pages, ar.Layout(body_id=None, paragraph_class=None))
    assert {r["page_id"]: r["content"] for r in whole.collect()}[4] == "open"
    links = ar.article_links(pages, "page_id").collect()
    assert sorted((r["page_id"], r["link"]) for r in links) == [(1, "/one"), (2, "f.pdf")]


def test_rows_without_a_date_stay(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("d", T.DateType()), T.StructField("v", T.IntegerType())])
    table = tb.Table(str(tmp_path / "t"), schema, ("k", "d"), "d")
    for k in ("a", "b", "a"):
        tb.upsert(table, spark.createDataFrame([(k, None, 1)], schema))
    assert sorted(r["k"] for r in table.read(spark).collect()) == ["a", "b"]
    tb.delete_by_key(table, spark.createDataFrame([("a",), ("b",)], "k string"), ["k"])
    assert table.read(spark).count() == 0


def test_broken_page_keeps_what_was_read(spark):
    pages = spark.createDataFrame([(1, "<title>x</title><![foo bar"), (2, "<title>y</title>")], "id int, html string")
    got = {r["id"]: r for r in ar.extract_articles(pages).collect()}
    assert (got[1]["title"], got[2]["title"], got[2]["problem"]) == ("x", "y", None) and got[1]["problem"]


def crashing(monkeypatch, at):
    """The ``at``-th step of a write that changes the table's folder fails, as if the job were killed there."""
    from pyspark.sql import DataFrameWriter

    steps = []

    def watched(real):
        def step(*args, **kwargs):
            steps.append(real.__name__)
            if len(steps) > at:
                raise KeyboardInterrupt
            return real(*args, **kwargs)

        return step

    monkeypatch.setattr(DataFrameWriter, "parquet", watched(DataFrameWriter.parquet))
    for name in ("publish", "expire", "drop"):
        monkeypatch.setattr(tb.Versions, name, watched(getattr(tb.Versions, name)))
    return steps


def test_a_killed_write_leaves_the_old_or_the_new_table(spark, tmp_path, rows, monkeypatch):
    table = daily_table(tmp_path / "t")
    make = lambda *r: spark.createDataFrame(list(r), table.schema)
    old = [("A", D(2024, 1, 1), 1, "x"), ("B", D(2024, 1, 2), 2, "y")]
    tb.replace_by_key(table, make(*old), ["code"])
    change = make(("A", D(2024, 1, 1), 9, "x"), ("C", D(2024, 1, 3), 3, "z"))
    new = sorted([("A", D(2024, 1, 1), 9, "x"), old[1], ("C", D(2024, 1, 3), 3, "z")])
    seen = []
    for at in range(6):
        with monkeypatch.context() as patch:
            steps = crashing(patch, at)
            try:
                tb.upsert(table, change)
            except KeyboardInterrupt:
                pass
        left = rows(table.read(spark))
        assert left in (old, new), (at, steps)
        seen.append((left == new, len(steps) <= at))
        tb.replace_by_key(table, make(*old), ["code"])
        tb.delete_by_key(table, spark.createDataFrame([("C",)], "code string"), ["code"])
        assert rows(table.read(spark)) == old
    assert (False, False) in seen and (True, False) in seen and (True, True) in seen


def test_writers_that_meet_both_count(spark, tmp_path, rows, monkeypatch):
    table = daily_table(tmp_path / "t")
    make = lambda *r: spark.createDataFrame(list(r), table.schema)
    tb.upsert(table, make(("A", D(2024, 1, 1), 1, "x")))
    real, other = tb.Versions.publish, []

    def late(self, version):
        if not other:
            other.append(True)
            tb.upsert(table, make(("B", D(2024, 1, 1), 2, "y")))
        return real(self, version)

    monkeypatch.setattr(tb.Versions, "publish", late)
    tb.upsert(table, make(("C", D(2024, 1, 1), 3, "z")))
    assert rows(table.read(spark), "code") == [("A",), ("B",), ("C",)]


def test_old_versions_expire(spark, tmp_path, rows):
    table = daily_table(tmp_path / "t")
    make = lambda *r: spark.createDataFrame(list(r), table.schema)
    tb.upsert(table, make(("A", D(2024, 1, 1), 0, "x")))
    for i in range(8):
        tb.upsert(table, make(("B", D(2024, 1, 2), i, "y")))
        earlier = table.read(spark)
        tb.upsert(table, make(("B", D(2024, 1, 2), i + 100, "y")))
        assert rows(earlier, "code", "a") == [("A", 0), ("B", i)]
    assert len(os.listdir(tmp_path / "t" / "_versions")) <= 2 * table.keep
    held = [f for v in os.listdir(tmp_path / "t" / "data") for f in os.listdir(tmp_path / "t" / "data" / v) if f.startswith("day=")]
    assert held.count("day=2024-01-01") == 1 and held.count("day=2024-01-02") <= table.keep + 1


def test_news_of_a_day_touches_one_partition(spark, tmp_path):
    from quotemill.plans.jobs import warehouse_tables

    table = warehouse_tables(str(tmp_path))["news"]
    at = lambda day, i: (f"a{i}", "FPT", "t", "l", dt.datetime(2024, 1, day, i), False, "c", 0.5, None, None)
    tb.upsert(table, spark.createDataFrame([at(d, d) for d in range(1, 6)], table.schema))
    before = tb.Versions(spark, table.path).latest().folders
    tb.upsert(table, spark.createDataFrame([at(3, 7)], table.schema))
    after = tb.Versions(spark, table.path).latest().folders
    assert {name for name in after if after[name] != before[name]} == {"news_day=2024-01-03"}
    assert table.read(spark).count() == 6 and table.read(spark).columns == table.schema.names


def test_large_csv_is_split(spark, tmp_path):
    names = schemas.DAILY.names
    line = lambda i: f"S{i % 7},2024-01-{1 + i % 28:02d},1.5,2,1,2,{i}" + "," * (len(names) - 7)
    lines = [line(i) for i in range(5000)]
    lines[100] = 'S1,2024-01-02,"1.5'
    lines[200] += ",one,too,many"
    lines[300] = "S1,2024-01-02,1.5,2,1,2,300"
    path = write(tmp_path / "big.csv", "\n".join([",".join(names), *lines]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        good, bad = fs.load_daily_csv(spark, path)
        whole, _ = fs.load_daily_csv(spark, path, multi_line=True)
        assert good.rdd.getNumPartitions() > 3 and whole.rdd.getNumPartitions() == 1
        assert sorted(r["volume"] for r in good.collect()) == [i for i in range(5000) if i not in (100, 200)]
        assert [r["reject_reasons"][0] for r in bad.collect()] == ["broken line"] * 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
