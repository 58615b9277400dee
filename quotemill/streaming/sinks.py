"""What a batch of ticks does to the tables: one read of the batch, one commit per table.

Every table keeps the number of the last batch in it and takes a batch once, so a replay after a
crash between two tables only finishes what is missing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill import schemas
from quotemill.functions.ordering import one_row, order_key
from quotemill.operators.bars import PRICE_COLUMNS, TICK_ORDER, finalize_daily
from quotemill.operators.filters import in_session
from quotemill.functions.scalars import round2
from quotemill.sources.tables import Table, replace_all, upsert
from quotemill.streaming.changes import latest_changes, live_movers, serving_rounded

#: How long after the newest tick a bar still takes ticks: as text for Spark, and as a duration.
DELAYS = {"minute": dt.timedelta(minutes=10), "daily": dt.timedelta(days=1)}
WIDTHS = {"minute": "1 minute", "daily": "1 day"}
_AT = T.DecimalType(38, 0)

_MOVERS = schemas.columns(
    "side string, position int, symbol string, price double, change double, change_percent double, day_volume bigint"
)
_MARKS = schemas.columns("batch bigint, seen_until timestamp")
#: A bar that can still be merged: first and last tick by their order, sums, nothing rounded.
_PARTIAL = T.StructType(
    [
        *schemas.columns("symbol string, bucket_date date, ts timestamp, open double, high double, low double, close double, last_volume bigint, n bigint, value double, size bigint"),
        T.StructField("first_at", _AT),
        T.StructField("last_at", _AT),
    ]
)
_CHANGES = schemas.columns(
    "symbol string, event_ts timestamp, seq bigint, price double, change double, change_percent double, day_volume bigint, "
    "last_size bigint, producer_timestamp bigint, latency_ms bigint, slot string"
)
_RUNNING = schemas.columns(
    "symbol string, bucket_date date, ts timestamp, event_ts timestamp, seq bigint, ticks bigint, open double, close double, "
    "high double, low double, volume bigint, vwap double, slot string"
)
_LATE = T.StructType([T.StructField("sink", T.StringType()), *schemas.TIMED_TICK.fields, T.StructField("trade_date", T.DateType())])


def serving_tables(out: str) -> dict[str, Table]:
    """The keyed tables below a folder: what is served, and the state that the next batch needs."""
    bar = ("symbol", "bucket_date", "ts")
    # a batch's rows are a partition of their own, so taking in a batch rewrites nothing
    running = {f"running_{sink}": Table(f"{out}/running_{sink}", _RUNNING, (*bar, "ticks", "slot"), "slot") for sink in DELAYS}
    return {
        **running,
        "latest": Table(f"{out}/stock_latest_prices", schemas.TIMED_TICK, ("symbol",)),
        "daily": Table(f"{out}/stock_daily_summary", schemas.DAILY, ("symbol", "trade_date"), "trade_date"),
        "minute": Table(
            f"{out}/stock_prices_agg", schemas.BARS, ("symbol", "bucket_date", "interval", "ts"), "bucket_date"
        ),
        "movers": Table(f"{out}/movers", _MOVERS, ("side", "position"), buckets=1),
        "changes": Table(f"{out}/changes", _CHANGES, ("symbol", "slot", "event_ts", "seq"), "slot"),
        "late": Table(f"{out}/late", _LATE, ("sink", "symbol", "trade_date", "event_ts", "seq"), "trade_date"),
        "minute_state": Table(f"{out}/_state/minute", _PARTIAL, bar, "bucket_date"),
        "daily_state": Table(f"{out}/_state/daily", _PARTIAL, bar, "bucket_date"),
        "change_state": Table(f"{out}/_state/changes", schemas.TIMED_TICK, ("symbol",)),
        "marks": Table(f"{out}/_state/marks", _MARKS, ("batch",), buckets=1),
    }


def split_late(ticks: DataFrame, seen_until: dt.datetime | None, sink: str) -> tuple[DataFrame, DataFrame]:
    """Ticks whose bar is still open, and those whose bar ended ``DELAYS[sink]`` or longer before the newest time of earlier batches."""
    if seen_until is None:
        return ticks, ticks.filter(F.lit(False))
    late = F.window("event_ts", WIDTHS[sink])["end"] <= F.lit(seen_until - DELAYS[sink]).cast("timestamp")
    return ticks.filter(~late), ticks.filter(late)


def partial_bars(ticks: DataFrame, width: str) -> DataFrame:
    """Unfinished bars of session ticks, one per symbol and bucket."""
    rows = in_session(ticks).withColumn("_at", order_key(ticks, TICK_ORDER).cast(_AT))
    bars = rows.groupBy("symbol", F.window("event_ts", width).alias("_w")).agg(
        F.min_by("price", "_at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "_at").alias("close"),
        F.max_by("day_volume", "_at").alias("last_volume"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("price") * F.col("last_size")).alias("value"),
        F.sum("last_size").alias("size"),
        F.min("_at").alias("first_at"),
        F.max("_at").alias("last_at"),
    )
    return bars.withColumns({"ts": F.col("_w.start"), "bucket_date": F.to_date("_w.start")}).select(*_PARTIAL.names)


def merged_bars(parts: DataFrame) -> DataFrame:
    """One unfinished bar of all parts of a bucket, in whatever order they came."""
    return parts.groupBy("symbol", "bucket_date", "ts").agg(
        F.min_by("open", "first_at").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "last_at").alias("close"),
        F.max_by("last_volume", "last_at").alias("last_volume"),
        F.sum("n").alias("n"),
        F.sum("value").alias("value"),
        F.sum("size").alias("size"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    )


def running_bars(ticks: DataFrame, held: DataFrame, sink: str) -> DataFrame:
    """For each session tick of a batch its bar so far, in the order of time and sequence.

    ``held``: the unfinished bars that earlier batches left. Volume is the day's cumulative one for
    daily bars and the summed trade size for minutes. A tick that is older than what is held counts
    in the sums but is neither the bar's last one nor, unless it is the very first, its open.
    """
    before = held.select("symbol", "bucket_date", "ts", *[F.col(c).alias(f"_{c}") for c in _PARTIAL.names[3:]])
    rows = in_session(ticks).withColumns({"_at": order_key(ticks, TICK_ORDER).cast(_AT), "ts": F.window("event_ts", WIDTHS[sink])["start"]})
    rows = rows.withColumn("bucket_date", F.to_date("ts")).join(before, ["symbol", "bucket_date", "ts"], "left")
    # a day or a minute of one symbol: rows are read in order and the frame holds sums alone
    so_far = Window.partitionBy("symbol", "bucket_date", "ts").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    newer = F.coalesce(F.col("_at") >= F.col("_last_at"), F.lit(True))
    opened = F.coalesce(F.col("_first_at") <= F.first("_at").over(so_far), F.lit(False))
    added = lambda own, x: F.coalesce(own, F.lit(0)) + F.coalesce(F.sum(x).over(so_far), F.lit(0))
    bars = rows.withColumns(
        {
            "ticks": F.coalesce("_n", F.lit(0)) + F.count(F.lit(1)).over(so_far),
            "open": F.when(opened, F.col("_open")).otherwise(F.first("price").over(so_far)),
            "close": F.when(newer, F.col("price")).otherwise(F.col("_close")),
            "high": F.greatest("_high", F.max("price").over(so_far)),
            "low": F.least("_low", F.min("price").over(so_far)),
            "volume": F.when(newer, F.col("day_volume")).otherwise(F.col("_last_volume")) if sink == "daily" else added(F.col("_size"), F.col("last_size")),
            "_traded": added(F.col("_value"), F.col("price") * F.col("last_size")),
        }
    )
    vwap = F.when((F.col("ticks") > 1) & (F.col("volume") > 0), F.col("_traded") / F.col("volume").cast("double")).otherwise(F.col("close"))
    return bars.withColumn("vwap", vwap).withColumns({c: round2(c) for c in PRICE_COLUMNS}).select(*_RUNNING.names[:-1])


def finished_bars(parts: DataFrame, sink: str) -> DataFrame:
    """The bars as they are served."""
    if sink == "minute":
        vwap = F.coalesce(F.try_divide("value", F.col("size").cast("double")), F.col("close"))
        rows = parts.withColumns({"interval": F.lit("1m"), "volume": F.col("size"), "vwap": vwap})
        return rows.withColumns({c: round2(c) for c in PRICE_COLUMNS}).select(*schemas.BARS.names)
    volume = F.col("last_volume")
    vwap = F.when((F.col("n") > 1) & (volume > 0), F.col("value") / volume.cast("double")).otherwise(F.col("close"))
    rows = parts.withColumns({"trade_date": F.col("bucket_date"), "volume": volume, "vwap": vwap})
    return finalize_daily(rows.withColumns({c: round2(c) for c in PRICE_COLUMNS}))


@dataclass
class TickSinks:
    """The tables that a stream of clean ticks keeps up to date.

    ``change_seconds``: how long a change stays in the change feed, by event time (None: for ever).
    ``running_batches``: the running bars of how many batches stay readable (None: of all).
    """

    out: str
    wanted: Sequence[str]
    change_seconds: int | None
    running_batches: int | None = 1000

    def __post_init__(self) -> None:
        self.tables = serving_tables(self.out)

    def write(self, batch: DataFrame, number: int) -> None:
        """Take in one batch. Tables that hold it already, or aren't wanted, stay as they are."""
        spark = batch.sparkSession
        ticks = batch.select(*schemas.TIMED_TICK.names).persist()
        try:
            newest = ticks.agg(F.max("event_ts")).first()[0]
            if newest is None:
                return
            before = self._seen_until(spark, number)
            if "latest" in self.wanted:
                self._latest(ticks, number)
            for sink in DELAYS:
                self._bars(ticks, number, sink, before)
            if "changes" in self.wanted:
                self._changes(ticks, number, max(newest, before or newest))
            self._mark(spark, number, max(newest, before or newest))
        finally:
            ticks.unpersist()

    def _seen_until(self, spark: SparkSession, number: int) -> dt.datetime | None:
        """The newest event time of all batches before this one."""
        marks = self.tables["marks"].read(spark)
        return marks.filter(F.col("batch") < number).agg(F.max("seen_until")).first()[0]

    def _mark(self, spark: SparkSession, number: int, newest: dt.datetime) -> None:
        """The last marks are enough: a batch is only ever replayed before the next one starts."""
        table = self.tables["marks"]
        kept = table.read(spark).filter((F.col("batch") < number) & (F.col("batch") >= number - 3))
        now = spark.createDataFrame([(number, newest)], _MARKS)
        replace_all(table, spark.createDataFrame([*kept.collect(), *now.collect()], _MARKS), number)

    def _latest(self, ticks: DataFrame, number: int) -> None:
        latest = self.tables["latest"]
        known = latest.read(ticks.sparkSession).unionByName(serving_rounded(ticks))
        upsert(latest, one_row(known, ["symbol"], TICK_ORDER), batch=number)
        upsert(self.tables["movers"], live_movers(latest.read(ticks.sparkSession)), batch=number)

    def _bars(self, ticks: DataFrame, number: int, sink: str, before: dt.datetime | None) -> None:
        """Each session tick goes into its bar or, once that has closed, among the late ones."""
        spark = ticks.sparkSession
        in_time, late = split_late(in_session(ticks), before, sink)
        if sink in self.wanted or f"running_{sink}" in self.wanted:
            state = self.tables[f"{sink}_state"]
            parts = partial_bars(in_time, WIDTHS[sink]).persist()
            keys = parts.select("symbol", "bucket_date", "ts")
            same = ["symbol", "bucket_date", "ts"]
            held = state.read(spark).join(keys, same, "left_semi")
            if f"running_{sink}" in self.wanted:
                # before the state moves on, so that a replay that still has to write these finds the old one
                rows = running_bars(in_time, held, sink).withColumn("slot", F.lit(f"{number:012d}"))
                oldest = None if self.running_batches is None else f"{max(0, number + 1 - self.running_batches):012d}"
                upsert(self.tables[f"running_{sink}"], rows, batch=number, expire_below=oldest)
            closed = None if before is None else (before - DELAYS[sink]).date().isoformat()
            upsert(state, merged_bars(held.unionByName(parts)), batch=number, expire_below=closed)
            if sink in self.wanted:
                # from the stored state: a replay finds there what it merged the first time
                touched = state.read(spark).join(keys, same, "left_semi")
                upsert(self.tables[sink], finished_bars(touched, sink), batch=number)
            parts.unpersist()
        if "late" in self.wanted and before is not None:
            rows = late.withColumns({"sink": F.lit(sink), "trade_date": F.to_date("event_ts")})
            # two sinks share the table, so the rows' keys keep a replay from counting twice
            upsert(self.tables["late"], rows)

    def _changes(self, ticks: DataFrame, number: int, newest: dt.datetime) -> None:
        """Changes against the state before the batch, which is replaced after they are stored."""
        spark = ticks.sparkSession
        state, seconds = self.tables["change_state"], self.change_seconds
        before = state.read(spark)
        form, text = ("yyyyMMddHHmm", "%Y%m%d%H%M") if seconds is not None and seconds <= 3600 else ("yyyyMMdd", "%Y%m%d")
        rows = latest_changes(ticks, before).withColumn("slot", F.date_format("event_ts", form))
        oldest = None if seconds is None else (newest - dt.timedelta(seconds=seconds)).strftime(text)
        upsert(self.tables["changes"], rows, batch=number, expire_below=oldest)
        upsert(state, one_row(before.unionByName(ticks), ["symbol"], TICK_ORDER), batch=number)
