"""The market board, its rankings, and running values over ticks of any volume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.calendar import MARKET_ZONE, in_trading_hours, local_time
from quotemill.functions.ordering import order_key
from quotemill.functions.scalars import base_symbol, price_limits, trend
from quotemill.operators.bars import TICK_ORDER
from quotemill.operators.news import with_sector
from quotemill.operators.runs import RUN, carry_in, in_run, so_far, starts_run, with_runs

# --- board --------------------------------------------------------------------------------------


def market_board(
    latest: DataFrame, reference: DataFrame, daily: DataFrame, whitelist: list[str] | DataFrame | None = None
) -> DataFrame:
    """Latest quote per symbol with reference close, price limits and the day's high and low.

    ``reference`` and ``daily`` are the bars of one date each; missing values count as 0.
    """
    rows = latest.withColumn("symbol", base_symbol("symbol"))
    if isinstance(whitelist, DataFrame):
        rows = rows.join(whitelist.select("symbol").distinct(), "symbol", "left_semi")
    elif whitelist is not None:
        rows = rows.filter(F.col("symbol").isin(whitelist))
    ref = reference.select(base_symbol("symbol").alias("symbol"), F.col("close").alias("reference"))
    day = daily.select(base_symbol("symbol").alias("symbol"), "high", "low")
    zero = F.lit(0.0)
    out = rows.join(ref, "symbol", "left").join(day, "symbol", "left")
    out = out.withColumn("reference", F.coalesce("reference", zero))
    ceiling, floor = price_limits("reference")
    return out.select(
        "symbol",
        ceiling.alias("ceiling"),
        floor.alias("floor"),
        "reference",
        F.coalesce("high", zero).alias("high"),
        F.coalesce("low", zero).alias("low"),
        F.coalesce("price", zero).alias("price"),
        F.coalesce("day_volume", F.lit(0)).alias("volume"),
        F.coalesce("change", zero).alias("change"),
        F.coalesce("change_percent", zero).alias("change_percent"),
        F.coalesce("last_size", F.lit(0)).alias("last_size"),
    )


def prediction_trend(predictions: DataFrame, reference: DataFrame) -> DataFrame:
    """Direction of each latest prediction against the reference close, 0 where there is none."""
    close = reference.select(base_symbol("symbol").alias("stock_code"), F.col("close").alias("reference"))
    rows = predictions.join(close, "stock_code", "left").withColumn("reference", F.coalesce("reference", F.lit(0.0)))
    return rows.select(
        "stock_code", trend("predicted_price", "reference").alias("prediction_trend"), "confidence_score"
    )


def market_breadth(board: DataFrame) -> DataFrame:
    return board.agg(
        F.count_if(F.col("change") > 0).alias("advancing"),
        F.count_if(F.col("change") < 0).alias("declining"),
        F.count_if(F.col("change") == 0).alias("unchanged"),
        F.sum("volume").alias("total_volume"),
        F.avg("change_percent").alias("avg_change_percent"),
    )


def sector_volume(board: DataFrame, sectors: DataFrame) -> DataFrame:
    """Volume, members and percent share per sector; sectors without volume are left out."""
    per_sector = (
        with_sector(board, sectors, "symbol")
        .groupBy("sector")
        .agg(F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_symbols"))
        .filter(F.col("volume") > 0)
    )
    total = per_sector.agg(F.sum("volume").alias("_total"))
    share = F.col("volume") * 100.0 / F.col("_total")
    return per_sector.join(F.broadcast(total)).withColumn("share_percent", share).drop("_total")  # one row


# --- rankings -----------------------------------------------------------------------------------


def _top(df: DataFrame, order: Sequence[Column | str], k: int, side: str | None = None) -> DataFrame:
    """The first ``k`` rows with their position. Only ``k`` rows per task reach the final sort."""
    rows = df.orderBy(*order).limit(k)
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return rows if side is None else rows.withColumn("side", F.lit(side))


def gainers_losers(latest: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` largest and smallest changes in percent (NULL as 0), losers worst first."""
    rows = latest.withColumns(
        {"symbol": base_symbol("symbol"), "_change": F.coalesce("change_percent", F.lit(0.0))}
    )
    up = _top(rows, [F.desc("_change"), F.asc("symbol")], k, "gainer")
    down = _top(rows, [F.asc("_change"), F.desc("symbol")], k, "loser")
    return up.unionByName(down).drop("_change")


def signed_movers(board: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` strongest rises and the ``k`` strongest falls, from the highest change down."""
    rows = board.select("symbol", "change_percent")
    up = _top(rows.filter(F.col("change_percent") > 0), [F.desc("change_percent"), "symbol"], k, "gain")
    down = _top(rows.filter(F.col("change_percent") < 0), [F.asc("change_percent"), "symbol"], k, "loss")
    return up.unionByName(down).drop("position").orderBy(F.desc("change_percent"), "symbol")


def top_volume(board: DataFrame, k: int = 10) -> DataFrame:
    rows = board.filter(F.col("volume") > 0).select(
        "symbol",
        "volume",
        (F.col("volume") / 1_000_000).alias("volume_millions"),
        F.sign("change").cast("int").alias("direction"),
    )
    return _top(rows, [F.desc("volume"), "symbol"], k)


def sector_top_volume(board: DataFrame, sectors: DataFrame, sector: str | None = None, k: int = 15) -> DataFrame:
    """The ``k`` largest volumes in one sector, or in each."""
    rows = with_sector(board, sectors, "symbol").select("sector", "symbol", "volume")
    if sector is not None:
        return _top(rows.filter(F.col("sector") == sector), [F.desc("volume"), "symbol"], k)
    position = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("volume"), "symbol"))
    return rows.withColumn("position", position).filter(F.col("position") <= k)


def sector_ranking(board: DataFrame, sectors: DataFrame, sector: str, mode: str = "price") -> DataFrame:
    """Members of a sector by price, or by percent against the reference (0 without one)."""
    change = (F.col("price") - F.col("reference")) / F.nullif(F.col("reference"), F.lit(0.0)) * 100
    value = F.col("price") if mode == "price" else F.when(F.col("reference") > 0, change).otherwise(0.0)
    rows = with_sector(board, sectors, "symbol").filter(F.col("sector") == sector)
    return rows.select("symbol", value.alias("value")).orderBy(F.desc("value"), "symbol")


def latest_snapshot(latest: DataFrame) -> DataFrame:
    columns = ("symbol", "price", "change", "change_percent", "day_volume", "last_size", "exchange", "event_ts")
    return latest.select(*columns).orderBy("symbol")


def trade_tape(ticks: DataFrame, symbol: str, zone: str = "UTC") -> DataFrame:
    """Time, price, size and change of one symbol's ticks, newest first."""
    rows = ticks.filter(F.col("symbol") == symbol).orderBy(F.desc("event_ts"), F.desc("seq"))
    return rows.select(
        F.date_format(local_time("event_ts", zone), "HH:mm:ss").alias("time"), "price", "last_size", "change", "seq"
    )


# --- running values over ticks ------------------------------------------------------------------


def running_high_low(
    ticks: DataFrame, order: Sequence[str] = TICK_ORDER, trading_hours: bool = False, zone: str = MARKET_ZONE
) -> DataFrame:
    """Highest and lowest price of the day so far at every tick; only positive prices count.

    With ``trading_hours`` only ticks within the market's hours count; others show what was reached
    before them, and NULL before the first that counts.
    """
    keys = ["symbol", "trade_date"]
    counts = F.col("price") > 0
    price = F.when(counts & in_trading_hours("event_ts", zone) if trading_hours else counts, F.col("price"))
    rows = with_runs(ticks.withColumn("trade_date", F.to_date("event_ts")), keys, order)
    rows = carry_in(
        rows,
        keys,
        {"_hi": F.max(price), "_lo": F.min(price)},
        {"_hi_in": (F.max("_hi"), keys), "_lo_in": (F.min("_lo"), keys)},
    )
    w = so_far(keys, order)
    return rows.withColumns(
        {
            "running_high": F.greatest(F.max(price).over(w), "_hi_in"),
            "running_low": F.least(F.min(price).over(w), "_lo_in"),
        }
    ).drop("_hi_in", "_lo_in", "_run")


def carry_change(ticks: DataFrame, ttl: str = "1 day", order: Sequence[str] = TICK_ORDER) -> DataFrame:
    """Replace a zero change by the symbol's last non-zero one, unless that is older than ``ttl``.

    Change and percent are carried each on its own, with its own age.
    """
    parts = ("change", "change_percent")
    rows = with_runs(ticks, ["symbol"], order)
    key = order_key(ticks, order)
    per_run, carried = {}, {}
    for c in parts:
        at = F.when(F.col(c) != 0, key)
        per_run |= {f"_v_{c}": F.max_by(c, at), f"_t_{c}": F.max_by("event_ts", at)}
        seen = F.when(F.col(f"_v_{c}").isNotNull(), F.struct(F.col(f"_v_{c}").alias("v"), F.col(f"_t_{c}").alias("t")))
        carried[f"_in_{c}"] = (F.last(seen, ignorenulls=True), ["symbol"])
    rows = carry_in(rows, ["symbol"], per_run, carried)
    w = so_far(["symbol"], order)
    out = {}
    for c in parts:
        moved = F.when(F.col(c) != 0, F.struct(F.col(c).alias("v"), F.col("event_ts").alias("t")))
        last = F.coalesce(F.last(moved, ignorenulls=True).over(w), f"_in_{c}")
        fresh = F.col("event_ts") < last["t"] + F.expr(f"interval {ttl}")
        out[f"shown_{c}"] = F.when(fresh, last["v"]).otherwise(F.coalesce(c, F.lit(0.0)))
    return rows.withColumns(out).drop(*carried, "_run")


DIRECTIONS = {"price": "price", "volume": "day_volume", "change": "change", "change_percent": "change_percent"}


def tick_direction(ticks: DataFrame, order: Sequence[str] = TICK_ORDER) -> DataFrame:
    """Up or down against the tick before, per measure; an unchanged value keeps the last direction."""
    keys = ["symbol"]
    measures = DIRECTIONS.items()
    step = lambda now, before: F.when(now > before, 1).when(now < before, -1)
    before = in_run(keys, order)
    rows = with_runs(ticks, keys, order).withColumn("_starts", starts_run(keys, order))
    # steps within each run; its rows lie together, so its summary needs no shuffle of its own
    rows = rows.withColumns({f"_step_{n}": step(F.col(c), F.lag(c).over(before)) for n, c in measures})
    rows = rows.withColumn("_at", order_key(ticks, order))
    runs = rows.groupBy(*keys, RUN).agg(
        *[F.min_by(c, "_at").alias(f"_first_{n}") for n, c in measures],
        *[F.max_by(c, "_at").alias(f"_end_{n}") for n, c in measures],
        *[F.max_by(f"_step_{n}", F.when(F.col(f"_step_{n}").isNotNull(), F.col("_at"))).alias(f"_turn_{n}") for n in DIRECTIONS],
    )
    # from run to run: the step onto a run's first row, and the direction it starts with
    through = Window.partitionBy(*keys).orderBy(RUN)
    runs = runs.withColumns({f"_onto_{n}": step(F.col(f"_first_{n}"), F.lag(f"_end_{n}").over(through)) for n in DIRECTIONS})
    earlier = through.rowsBetween(Window.unboundedPreceding, -1)
    left = {f"_in_{n}": F.last(F.coalesce(f"_turn_{n}", f"_onto_{n}"), ignorenulls=True).over(earlier) for n in DIRECTIONS}
    carries = runs.withColumns(left).select(*keys, RUN, *[f"_onto_{n}" for n in DIRECTIONS], *left)
    joined = rows.join(carries, [*keys, RUN], "left")
    w = so_far(keys, order)
    out = {}
    for name in DIRECTIONS:
        own = F.when(F.col("_starts"), F.col(f"_onto_{name}")).otherwise(F.col(f"_step_{name}"))
        sign = F.coalesce(F.last(own, ignorenulls=True).over(w), F.col(f"_in_{name}"))
        out[f"{name}_direction"] = F.when(sign > 0, "up").when(sign < 0, "down")
    return joined.withColumns(out).select(*ticks.columns, *out)
