"""Batches of a stream against one batch over everything: late ticks, replays, and what is kept."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from quotemill import schemas
from quotemill.operators import bars as br
from quotemill.streaming import pipeline as sp
from quotemill.streaming.sinks import DELAYS, TickSinks

START = dt.datetime(2024, 1, 2, 2)


def shuffled_ticks(make_ticks, seed, n=80):
    """(ticks, batch of each by seq): most arrive in order, some much later."""
    rng = random.Random(seed)
    items, batch_of = [], {}
    for i in range(n):
        at = START + dt.timedelta(minutes=40 * i + rng.randrange(40), seconds=rng.randrange(60))
        items.append((f"{'AB'[i % 2]}.VN", at.isoformat(sep=" "), 10 + rng.randrange(40) / 4, rng.randrange(5), i + 1, int(i % 7 != 0), rng.random() - 0.5))
        batch_of[i] = min(3, i * 4 // n + (rng.randrange(1, 4) if rng.random() < 0.3 else 0))
    return make_ticks(*items), batch_of


def batches(ticks, batch_of):
    number = F.create_map(*[F.lit(x) for kv in batch_of.items() for x in kv])[F.col("seq").cast("int")]
    numbered = ticks.withColumn("b", number).cache()
    return [numbered.filter(F.col("b") == b).drop("b") for b in range(4)]


@pytest.mark.parametrize("seed", [0])
def test_a_tick_is_in_its_bar_or_late_never_both(spark, make_ticks, tmp_path, rows, seed):
    ticks, batch_of = shuffled_ticks(make_ticks, seed)
    sinks = TickSinks(str(tmp_path), ("daily", "minute", "late"), 120)
    for number, batch in enumerate(batches(ticks, batch_of)):
        sinks.write(batch, number)
        if number == 2:  # a crash after the batch, before the stream noted it
            sinks.write(batch, number)
    plain = [r for r in ticks.collect()]
    times = {b: max((r.event_ts for r in plain if batch_of[r.seq] < b), default=None) for b in range(4)}
    width = {"minute": dt.timedelta(minutes=1), "daily": dt.timedelta(days=1)}
    late = {(r.sink, r.seq) for r in sinks.tables["late"].read(spark).collect()}
    want = set()
    for sink, w in width.items():
        for r in plain:
            seen = times[batch_of[r.seq]]
            begin = r.event_ts.replace(second=0, microsecond=0) if sink == "minute" else r.event_ts.replace(hour=0, minute=0, second=0, microsecond=0)
            if r.market_hours and seen is not None and begin + w <= seen - DELAYS[sink]:
                want.add((sink, r.seq))
    assert late == want and {s for s, _ in late} >= {"minute"}
    # the bars hold exactly the others
    gone = {sink: [seq for s, seq in late if s == sink] or [-1] for sink in width}
    minute = br.minute_bars(ticks.filter(~F.col("seq").isin(gone["minute"])))
    assert rows(sinks.tables["minute"].read(spark)) == rows(minute)
    daily = br.finalize_daily(br.daily_bars(ticks.filter(~F.col("seq").isin(gone["daily"]))))
    assert rows(sinks.tables["daily"].read(spark)) == rows(daily)


def test_a_replay_finishes_what_is_missing(spark, make_ticks, tmp_path, rows, monkeypatch):
    """The batch dies after each of its commits in turn; replayed, it leaves what it would have left at once."""
    from quotemill.sources.versions import Versions

    ticks, batch_of = shuffled_ticks(make_ticks, 3, 40)
    first, second = batches(ticks, {k: int(v > 1) for k, v in batch_of.items()})[:2]
    names = ("latest", "movers", "minute", "changes", "change_state", "late")
    real = Versions.publish

    def run(folder, die_at):
        sinks, done = TickSinks(str(tmp_path / folder), ("latest", "minute", "changes", "late"), None), []

        def counted(self, version):
            if len(done) == die_at:
                raise KeyboardInterrupt
            done.append(self.path)
            return real(self, version)

        sinks.write(first, 0)
        with monkeypatch.context() as patch:
            patch.setattr(Versions, "publish", counted)
            try:
                sinks.write(second, 1)
            except KeyboardInterrupt:
                pass
        sinks.write(second, 1)
        return [rows(sinks.tables[n].read(spark)) for n in names], len(done)

    whole, commits = run("whole", -1)
    for die_at in (1, commits - 2):
        assert run(f"at{die_at}", die_at)[0] == whole, die_at


def test_nothing_grows_with_the_batches(spark, make_ticks, tmp_path, rows):
    """Batches of the change feed: folders stay few, changes expire, the feed goes on across batches."""
    sinks = TickSinks(str(tmp_path), ("changes",), 120)
    folders = []
    for number in range(8):
        at = START + dt.timedelta(seconds=20 * number)
        sinks.write(make_ticks(("A.VN", at.isoformat(sep=" "), 10 + number // 2, 1, 5)).withColumn("seq", F.lit(number).cast("long")), number)
        folders.append(sum(len(d) for _, d, _ in os.walk(tmp_path)))
    left = rows(sinks.tables["changes"].read(spark), "seq", "price", "day_volume")
    # a price changes with every second batch; the minutes that are older than 120 s are gone
    assert left and left[-1] == (6, 13.0, None) and all(seq % 2 == 0 for seq, _, _ in left)
    newest = START + dt.timedelta(seconds=20 * 7)
    assert len(left) <= 120 // 40 + 2
    assert rows(sp.recent_changes(sinks.tables["changes"].read(spark), newest), "seq") == [(seq,) for seq, _, _ in left if seq > 7 - 6]
    assert max(folders[6:]) <= max(folders[:6]) + 2
    assert sinks.tables["marks"].read(spark).count() <= 4


def test_stored_schemas(spark, make_ticks, tmp_path):
    sinks = TickSinks(str(tmp_path), ("latest", "daily", "minute", "changes", "late"), 120)
    sinks.write(make_ticks(("A.VN", "2024-01-02 03:00:00", 1, 1)).filter("false"), 0)
    assert not any(t.exists(spark) for t in sinks.tables.values())
    sinks.write(make_ticks(("A.VN", "2024-01-02 03:00:00", 1, 1)), 1)
    assert sinks.tables["daily"].read(spark).schema.names == schemas.DAILY.names
    assert sinks.tables["minute"].read(spark).schema.names == schemas.BARS.names


@pytest.mark.parametrize("sink", ["daily", "minute"])
def test_each_tick_has_its_bar_so_far(spark, make_ticks, tmp_path, rows, sink):
    """Against a walk over the ticks; the third batch is replayed, and the last rows are the bars."""
    ticks, batch_of = shuffled_ticks(make_ticks, 5)
    ticks = ticks.withColumn("event_ts", F.to_timestamp(F.from_unixtime(F.unix_timestamp("event_ts") - F.pmod("seq", F.lit(3)) * 600)))
    ticks = spark.createDataFrame(ticks.collect(), ticks.schema)
    sinks = TickSinks(str(tmp_path), (sink, f"running_{sink}"), None)
    for number, batch in enumerate(batches(ticks, batch_of)):
        sinks.write(batch, number)
        if number == 2:
            sinks.write(batch, number)
    plain = sorted(ticks.filter("market_hours = 1").collect(), key=lambda r: (batch_of[r.seq], r.event_ts, r.seq))
    times = {b: max((r.event_ts for r in ticks.collect() if batch_of[r.seq] < b), default=None) for b in range(4)}
    width = dt.timedelta(days=1) if sink == "daily" else dt.timedelta(minutes=1)
    cents = lambda x: int(x * 100 + 0.5) / 100
    held, want = {}, []
    for r in plain:
        begin = r.event_ts.replace(second=0, microsecond=0) if sink == "minute" else r.event_ts.replace(hour=0, minute=0, second=0, microsecond=0)
        if times[batch_of[r.seq]] is not None and begin + width <= times[batch_of[r.seq]] - DELAYS[sink]:
            continue
        seen = held.setdefault((r.symbol, begin), [])
        seen.append(r)
        in_order = sorted(seen, key=lambda x: (x.event_ts, x.seq))
        volume = in_order[-1].day_volume if sink == "daily" else sum(x.last_size for x in seen)
        value = sum(x.price * x.last_size for x in seen)
        vwap = value / volume if len(seen) > 1 and volume > 0 else in_order[-1].price
        prices = [x.price for x in seen]
        want.append((r.seq, len(seen), in_order[0].price, in_order[-1].price, max(prices), min(prices), volume, cents(vwap)))
    got = rows(sinks.tables[f"running_{sink}"].read(spark), "seq", "ticks", "open", "close", "high", "low", "volume", "vwap")
    assert got == sorted(want, key=repr) and max(w[1] for w in want) > (5 if sink == "daily" else 0)
    closes = {(r.symbol, r.ts): (r.ticks, r.close) for r in sorted(sinks.tables[f"running_{sink}"].read(spark).collect(), key=lambda r: r.ticks)}
    day = "trade_date" if sink == "daily" else "ts"
    assert {c for _, c in closes.values()} == {r.close for r in sinks.tables[sink].read(spark).select("symbol", day, "close").collect()}


def test_running_bars_expire_by_batch(spark, make_ticks, tmp_path, rows):
    sinks = TickSinks(str(tmp_path), ("running_daily",), None, running_batches=2)
    for number in range(4):
        at = START + dt.timedelta(seconds=number)
        sinks.write(make_ticks(("A.VN", at.isoformat(sep=" "), 10 + number, 1, 5 + number)), number)
    assert rows(sinks.tables["running_daily"].read(spark), "ticks", "open", "close", "volume") == [(3, 10.0, 12.0, 7), (4, 10.0, 13.0, 8)]
    assert not sinks.tables["daily"].exists(spark)
