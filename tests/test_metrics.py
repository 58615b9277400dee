import datetime as dt

from pyspark.sql import functions as F

from quotemill.operators import metrics as mt

T0 = dt.datetime(2024, 1, 2, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def samples(spark, *items):
    """(instance, seconds, value)"""
    return spark.createDataFrame([(i, at(s), float(v)) for i, s, v in items], "instance string, ts timestamp, value double")


def test_histogram_counts_are_cumulative(spark, rows):
    df = spark.createDataFrame([("A", 5.0), ("A", 10.0), ("A", 700.0), ("A", 9000.0), ("A", None)], "symbol string, latency_ms double")
    got = {r["le"]: r["bucket_count"] for r in mt.latency_histogram(df).collect()}
    assert (got[10.0], got[50.0], got[1000.0], got[5000.0], got[mt.INF]) == (2, 2, 3, 3, 4)
    assert rows(mt.latency_histogram(df), "events", "latency_sum")[0] == (5, 9715.0)


def buckets(spark, **series):
    out = [(s, float(le), float(n)) for s, counts in series.items() for le, n in counts.items()]
    return spark.createDataFrame(out, "symbol string, le double, bucket_count double")


def test_quantile(spark):
    df = buckets(
        spark,
        a={10: 2, 20: 4, mt.INF: 4},
        over={10: 1, 20: 1, mt.INF: 4},
        empty={10: 0, mt.INF: 0},
        first={10: 4, 20: 4, mt.INF: 4},
    )
    half = {r["symbol"]: r["quantile"] for r in mt.histogram_quantile(df, 0.75, ["symbol"]).collect()}
    assert half == {"a": 15.0, "over": 20.0, "empty": None, "first": 7.5}
    last = 0.0
    for q in (0.1, 0.3, 0.5, 0.9, 1.0):
        value = mt.histogram_quantile(df.filter("symbol = 'a'"), q, ["symbol"]).first()["quantile"]
        assert value >= last
        last = value


def test_rate_with_restart(spark, rows):
    df = samples(spark, ("a", 10, 100), ("a", 40, 130), ("a", 70, 10), ("a", 100, 40), ("b", 10, 5))
    assert rows(mt.counter_rate(df, ["instance"], 60, 60), "instance", "at_time", "rate") == [
        ("a", at(60), 0.5), ("a", at(120), 40 / 60), ("b", at(60), 0.0),
    ]
    wide = rows(mt.windowed_steps(df, ["instance"], 120, 60).filter("instance = 'a'"), "at_time", "increase", "changes", "resets")
    assert wide == [(at(60), 30.0, 1, 0), (at(120), 70.0, 3, 1), (at(180), 40.0, 2, 1)]
    assert rows(mt.resets(df, ["instance"], 60).filter("resets > 0"), "at_time") == [(at(120),)]
    assert rows(mt.changes(df, ["instance"], 60).filter("instance = 'b'"), "changes") == [(0,)]
    total = mt.sum_by(mt.counter_rate(df, ["instance"], 60, 60), [])
    assert rows(total, "at_time", "rate")[0] == (at(60), 0.5)


def test_mean_and_guarded_ratio(spark, rows):
    s = spark.createDataFrame([("a", 10.0), ("b", 1.0)], "k string, rate double")
    c = spark.createDataFrame([("a", 4.0), ("b", 0.0)], "k string, rate double")
    assert rows(mt.mean_from_sum_count(s, c, ["k"])) == [("a", 2.5), ("b", None)]
    df = spark.createDataFrame([(200.0, 25.0, 100.0), (100.0, 25.0, 100.0), (200.0, 150.0, 100.0), (200.0, 1.0, 0.0)], "t double, p double, w double")
    assert [r[0] for r in df.select(mt.guarded_ratio("t", "p", "w")).collect()] == [0.75, 0.0, 0.0, None]


def test_outliers(spark, rows):
    df = spark.createDataFrame([(str(i), T0, 10.0) for i in range(9)] + [("x", T0, 5000.0)], "instance string, at_time timestamp, rate double")
    assert rows(mt.outlier_z(df), "instance") == [("x",)]
    assert mt.outlier_z(df, damping=10_000.0).count() == 0


def test_offset_delta(spark, rows):
    df = samples(spark, ("a", 60, 5), ("a", 240, 8), ("a", 900, 9))
    got = {r["at_time"]: r["delta"] for r in mt.offset_delta(df, ["instance"]).collect()}
    assert got == {at(60): 5.0, at(240): 3.0, at(900): 9.0}


def test_alert_hold(spark, rows):
    df = samples(spark, *[("a", 60 * i, v) for i, v in enumerate([1, 1, 0, 1, 1, 1, 1, 0, 1])], ("b", 0, 1), ("b", 600, 1))
    got = rows(mt.alert_hold(df, ["instance"], F.col("value") > 0, 180), "instance", "started_at", "ended_at", "fired_at", "n_samples")
    assert got == [("a", at(180), at(360), at(360), 4), ("b", at(0), at(600), at(180), 2)]


def test_sets_units_and_logs(spark, rows):
    up = spark.createDataFrame([("a",), ("b",), ("b",)], "instance string")
    assert rows(mt.absent_instances(up, up.filter("instance = 'a'"))) == [("b",)]
    many = spark.createDataFrame([("a", 10.0), ("b", 1.0)], "instance string, value double")
    one = spark.createDataFrame([("a", 4), ("b", 0)], "instance string, units int")
    assert rows(mt.per_unit(many, one, ["instance"]), "instance", "per_unit") == [("a", 2.5), ("b", None)]
    logs = spark.createDataFrame([(at(1), "m", "warning"), (at(2), "m", "info"), (at(3601), "m", "warning")], "ts timestamp, module string, severity string")
    got = mt.log_rate(logs, F.col("severity") == "warning", ["module"])
    assert rows(got, "at_time", "rate") == [(at(3600), 1 / 3600), (at(7200), 1 / 3600)]


def test_last_event_and_progress(spark, rows):
    df = samples(spark, ("a", 10, 1), ("a", 70, 1), ("a", 130, 2), ("a", 190, 2))
    got = rows(mt.last_event_time(df, ["instance"], ["instance"], 60, 60), "at_time", "last_event")
    assert got == [(at(60), None), (at(120), None), (at(180), at(180)), (at(240), at(180))]
    runs = spark.createDataFrame([("c", 1, 10, 5), ("c", 1, 10, 2), ("idle", 0, 10, 5), ("none", 1, 0, 0)], "cluster string, running int, total int, done int")
    assert rows(mt.progress_pct(runs, ["cluster"])) == [("c", 0.35), ("idle", 0.0), ("none", 0.0)]
