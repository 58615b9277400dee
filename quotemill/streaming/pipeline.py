"""The tick stream: cleaned ticks, latest prices, daily and minute bars, changes and late ticks, kept up to date.

Raw ticks are appended by the exactly-once file sink. Everything else comes from one stream whose
batches are read once and committed table by table (``sinks``). Bars are merged from partial bars,
which combine before the shuffle, so a hot symbol costs a batch one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quotemill import schemas
from quotemill.functions.calendar import MARKET_ZONE, in_trading_hours
from quotemill.operators.bars import bars, daily_bars, finalize_daily, latest_by_symbol
from quotemill.operators.filters import valid_ticks
from quotemill.sources.files import read_ticks, split_unparsed
from quotemill.sources.tables import last_per_key
from quotemill.streaming.changes import CHANGE_SECONDS, latest_changes, live_movers, recent_changes, serving_rounded
from quotemill.streaming.sinks import TickSinks, serving_tables, split_late

__all__ = [
    "clean_ticks", "late_policy", "latest_changes", "live_movers", "recent_changes", "run_available", "serving_rounded", "serving_tables",
    "split_late", "stateful_daily", "stateful_latest", "stateful_minute", "stored_ticks", "tick_pipeline", "trading_gate",
]

DAILY_DELAY = "1 day"
MINUTE_DELAY = "10 minutes"


def clean_ticks(ticks: DataFrame) -> DataFrame:
    """Valid ticks with a time, as batch or stream."""
    return split_unparsed(valid_ticks(ticks))[0]


def stateful_daily(ticks: DataFrame, delay: str = DAILY_DELAY) -> DataFrame:
    """Running daily bars of a stream; a day leaves the state once the watermark has passed it."""
    return finalize_daily(daily_bars(late_policy(ticks, delay)))


def stateful_minute(ticks: DataFrame, delay: str = MINUTE_DELAY) -> DataFrame:
    return bars(late_policy(ticks, delay), "1m")


def stateful_latest(ticks: DataFrame) -> DataFrame:
    """The newest tick per symbol; the state holds one row per symbol."""
    return latest_by_symbol(ticks)


def late_policy(ticks: DataFrame, delay: str) -> DataFrame:
    """Rows later than ``delay`` behind the newest event time no longer change a finished bar."""
    return ticks.withWatermark("event_ts", delay) if ticks.isStreaming else ticks


def trading_gate(ticks: DataFrame, zone: str = MARKET_ZONE) -> DataFrame:
    """Only changes that happened in trading hours."""
    return ticks.filter(in_trading_hours("event_ts", zone))


def stored_ticks(spark: SparkSession, out: str) -> DataFrame:
    """The appended ticks with one row per symbol and time, the last one written."""
    rows = spark.read.schema(T.StructType([*schemas.TIMED_TICK.fields, T.StructField("trade_date", T.DateType())]))
    return last_per_key(rows.parquet(f"{out}/stock_prices"), ["symbol", "timestamp"], ["event_ts", "seq"])


SINKS = ("ticks", "latest", "daily", "minute", "changes", "late")
#: Further sinks, on request: a row for each tick, with its bar so far.
RUNNING_SINKS = ("running_daily", "running_minute")


def tick_pipeline(
    spark: SparkSession,
    source: str,
    out: str,
    sinks: tuple[str, ...] = SINKS,
    fmt: str = "parquet",
    schema: T.StructType = schemas.TICK,
    once: bool = False,
    every: str = "5 seconds",
    change_seconds: int | None = CHANGE_SECONDS,
    **options,
) -> dict[str, StreamingQuery]:
    """Start the wanted sinks over one source: ``ticks`` on its own, all others as one stream, ``tables``.

    ``once`` works off what is there and stops; otherwise a batch starts every ``every``. The
    checkpoints lie below ``out``, as the tables know the batches they hold: a stream that starts
    without its checkpoint needs a new folder.
    """
    ticks = clean_ticks(read_ticks(spark, source, streaming=True, fmt=fmt, schema=schema, **options))
    trigger = {"availableNow": True} if once else {"processingTime": every}
    started = {}
    if "ticks" in sinks:
        # ticks only ever grow: they are appended by the exactly-once file sink, never rewritten
        started["ticks"] = (
            serving_rounded(ticks)
            .withColumn("trade_date", F.to_date("event_ts"))
            .writeStream.format("parquet")
            .partitionBy("trade_date")
            .option("path", f"{out}/stock_prices")
            .option("checkpointLocation", f"{out}/_checkpoints/ticks")
            .trigger(**trigger)
            .start()
        )
    wanted = tuple(s for s in sinks if s != "ticks")
    if wanted:
        started["tables"] = (
            ticks.writeStream.outputMode("append")
            .foreachBatch(TickSinks(out, wanted, change_seconds).write)
            .option("checkpointLocation", f"{out}/_checkpoints/tables")
            .trigger(**trigger)
            .start()
        )
    return started


def run_available(started: dict[str, StreamingQuery]) -> None:
    """Wait until started one-off queries are through; an error in one is raised."""
    for query in started.values():
        query.awaitTermination()
