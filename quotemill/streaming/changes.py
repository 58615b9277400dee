"""The change feed and the live movers: what differs from the row before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions.scalars import base_symbol, latency_ms, round2
from quotemill.operators.bars import TICK_ORDER
from quotemill.operators.market import gainers_losers
from quotemill.operators.runs import previous

# Fixed value: how many seconds a change stays readable.
CHANGE_SECONDS = 120
CHANGE_COLUMNS = ("price", "change", "change_percent", "day_volume", "last_size")
ROUNDED = ("price", "change", "change_percent")


def serving_rounded(ticks: DataFrame) -> DataFrame:
    return ticks.withColumns({c: round2(c) for c in ROUNDED})


def latest_changes(ticks: DataFrame, latest: DataFrame | None = None, now_ms=None) -> DataFrame:
    """One row per tick with the columns that differ from the symbol's row before, NULL elsewhere.

    ``latest`` is the stored state before these ticks. Ticks that change nothing give no row.
    """
    rows = previous(ticks, ["symbol"], TICK_ORDER, {f"_was_{c}": c for c in CHANGE_COLUMNS} | {"_was_known": "seq"})
    if latest is not None:
        stored = latest.select("symbol", *[F.col(c).alias(f"_old_{c}") for c in CHANGE_COLUMNS])
        rows = rows.join(stored, "symbol", "left")
        first = F.col("_was_known").isNull()
        rows = rows.withColumns(
            {f"_was_{c}": F.when(first, F.col(f"_old_{c}")).otherwise(F.col(f"_was_{c}")) for c in CHANGE_COLUMNS}
        )
    changed = {c: F.when(~F.equal_null(F.col(c), F.col(f"_was_{c}")), F.col(c)) for c in CHANGE_COLUMNS}
    any_changed = F.coalesce(*[changed[c].cast("string") for c in CHANGE_COLUMNS]).isNotNull()
    seen_at = now_ms if now_ms is not None else F.unix_millis("event_ts")
    return rows.filter(any_changed).select(
        base_symbol("symbol").alias("symbol"),
        "event_ts",
        "seq",
        *[changed[c].alias(c) for c in CHANGE_COLUMNS],
        "producer_timestamp",
        latency_ms(seen_at, "producer_timestamp").alias("latency_ms"),
    )


def recent_changes(changes: DataFrame, now, seconds: int = CHANGE_SECONDS) -> DataFrame:
    """Changes that have not expired yet."""
    at = F.lit(now).cast("timestamp")
    return changes.filter(F.col("event_ts") > at - F.make_interval(secs=F.lit(seconds)))


def live_movers(latest: DataFrame, k: int = 5) -> DataFrame:
    """Largest rises and falls of the current latest prices."""
    return gainers_losers(latest, k).select("side", "position", "symbol", "price", "change", "change_percent", "day_volume")
