"""Metric expressions over samples (ts, label columns, value).

Rates and counts are evaluated on a time grid: samples are first summed per series and grid step,
so what later windows and joins see is bounded by the number of steps, not of samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.ordering import order_key
from quotemill.operators.runs import carry_in, previous, so_far, with_runs

# Upper bounds of the latency histogram in milliseconds, and how long a sample stays valid.
LATENCY_BUCKETS = (10, 50, 100, 200, 500, 1000, 2000, 5000)
LOOKBACK_SECONDS = 300
INF = float("inf")


def latency_histogram(
    changes: DataFrame, labels: Sequence[str] = ("symbol",), latency: str = "latency_ms", buckets: Sequence[float] = LATENCY_BUCKETS
) -> DataFrame:
    """Cumulative bucket counts, sum of latencies and number of events per label set."""
    ms = F.col(latency)
    bounds = [*[float(b) for b in buckets], INF]
    counts = changes.groupBy(*labels).agg(
        *[F.count_if(ms <= b).alias(f"_le{i}") for i, b in enumerate(bounds)],
        F.sum(ms).alias("latency_sum"),
        F.count(F.lit(1)).alias("events"),
    )
    pairs = F.array(
        *[F.struct(F.lit(b).alias("le"), F.col(f"_le{i}").alias("n")) for i, b in enumerate(bounds)]
    )
    return counts.select(*labels, "latency_sum", "events", F.explode(pairs).alias("_b")).select(
        *labels, "_b.le", F.col("_b.n").alias("bucket_count"), "latency_sum", "events"
    )


def _grid_up(ts: Column | str, step: int) -> Column:
    """The first grid time at or after ``ts``."""
    return F.timestamp_seconds(F.ceil(F.unix_micros(ts) / (step * 1_000_000.0)) * step)


def _steps(
    samples: DataFrame, labels: Sequence[str], order: Sequence[str], step: int
) -> DataFrame:
    """Per series and grid step: increase (a drop counts as a restart from 0), changes and drops."""
    rows = previous(samples, labels, order, {"_before": "value"})
    before, now = F.col("_before"), F.col("value")
    return (
        rows.withColumn("at_time", _grid_up(order[0], step))
        .groupBy(*labels, "at_time")
        .agg(
            F.sum(F.when(now < before, now).when(now >= before, now - before)).alias("increase"),
            F.count_if(now != before).alias("changes"),
            F.count_if(now < before).alias("resets"),
        )
    )


def windowed_steps(
    samples: DataFrame,
    labels: Sequence[str],
    window: int = 60,
    step: int = 60,
    order: Sequence[str] = ("ts",),
) -> DataFrame:
    """Increase, changes and drops of each series in the ``window`` seconds before every grid time.

    ``window`` is a multiple of ``step``. A step's sums go to each of the window / step grid times
    that see it, so no ordered frame over a series is needed.
    """
    n = window // step
    sums = _steps(samples, labels, order, step)
    if n > 1:
        shift = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        sums = sums.withColumn("_k", shift).withColumn(
            "at_time", F.timestamp_seconds(F.unix_seconds("at_time") + F.col("_k") * step)
        )
        sums = sums.groupBy(*labels, "at_time").agg(
            F.sum("increase").alias("increase"), F.sum("changes").alias("changes"), F.sum("resets").alias("resets")
        )
    return sums


def counter_rate(
    samples: DataFrame, labels: Sequence[str], window: int = 60, step: int = 60, order: Sequence[str] = ("ts",)
) -> DataFrame:
    """Increase per second of a counter; restarts are handled, window edges are not extrapolated."""
    rows = windowed_steps(samples, labels, window, step, order)
    return rows.select(*labels, "at_time", (F.coalesce("increase", F.lit(0.0)) / window).alias("rate"))


def changes(samples: DataFrame, labels: Sequence[str], window: int, step: int = 60, order: Sequence[str] = ("ts",)) -> DataFrame:
    return windowed_steps(samples, labels, window, step, order).select(*labels, "at_time", "changes")


def resets(samples: DataFrame, labels: Sequence[str], window: int, step: int = 60, order: Sequence[str] = ("ts",)) -> DataFrame:
    return windowed_steps(samples, labels, window, step, order).select(*labels, "at_time", "resets")


def sum_by(rates: DataFrame, labels: Sequence[str], value: str = "rate") -> DataFrame:
    return rates.groupBy(*labels, "at_time").agg(F.sum(value).alias(value))


def histogram_quantile(
    buckets: DataFrame, q: float, by: Sequence[str], le: str = "le", count: str = "bucket_count"
) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that holds it.

    A quantile in the infinite bucket gives the last finite bound; an empty histogram gives NULL.
    """
    sums = buckets.groupBy(*by, le).agg(F.sum(count).cast("double").alias("_n"))
    order = Window.partitionBy(*by).orderBy(le)  # as many rows as there are bounds
    whole = Window.partitionBy(*by)
    rows = sums.withColumns(
        {
            "_total": F.max("_n").over(whole),
            "_n_before": F.coalesce(F.lag("_n").over(order), F.lit(0.0)),
            "_le_before": F.lag(le).over(order),
            "_last": F.max(F.when(F.col(le) < INF, F.col(le))).over(whole),
        }
    )
    rank = F.col("_total") * q
    start = F.coalesce("_le_before", F.lit(0.0))
    part = F.try_divide(rank - F.col("_n_before"), F.col("_n") - F.col("_n_before"))
    inside = start + (F.col(le) - start) * F.coalesce(part, F.lit(0.0))
    value = (
        F.when(F.col(le) == INF, F.col("_last"))
        .when(F.col("_le_before").isNull() & (F.col(le) <= 0), F.col(le))
        .otherwise(inside)
    )
    hit = (F.col("_n") >= rank) & (F.col("_total") > 0)
    picked = rows.groupBy(*by).agg(F.min_by(F.when(hit, value), F.when(hit, F.col(le))).alias("quantile"))
    return picked.select(*by, "quantile")


def mean_from_sum_count(sums: DataFrame, counts: DataFrame, keys: Sequence[str], value: str = "rate") -> DataFrame:
    joined = sums.select(*keys, F.col(value).alias("_s")).join(counts.select(*keys, F.col(value).alias("_c")), list(keys))
    return joined.select(*keys, F.try_divide("_s", "_c").alias("mean"))


def guarded_ratio(total: Column | str, part: Column | str, whole: Column | str, threshold: float = 100) -> Column:
    """1 - part / whole, not below 0, and 0 unless ``total`` is over the threshold."""
    total, part, whole = (F.col(c) if isinstance(c, str) else c for c in (total, part, whole))
    share = F.try_divide(part, whole)  # NULL where nothing was counted; greatest alone would hide that
    ratio = F.when(total > threshold, F.greatest(1.0 - share, F.lit(0.0))).otherwise(0.0)
    return F.when(share.isNotNull(), ratio)


def outlier_z(rates: DataFrame, k: float = 2.0, damping: float = 100.0, value: str = "rate") -> DataFrame:
    """Instances whose distance from the mean of the same time is over ``k`` damped deviations."""
    stats = rates.groupBy("at_time").agg(F.avg(value).alias("_avg"), F.stddev_pop(value).alias("_std"))
    z = F.abs(F.col(value) - F.col("_avg")) / (F.col("_std") + damping)
    return rates.join(stats, "at_time").withColumn("z", z).filter(F.col("z") > k).drop("_avg", "_std")


def last_per_step(samples: DataFrame, labels: Sequence[str], step: int, order: Sequence[str] = ("ts",)) -> DataFrame:
    """The newest value of each series in every grid step."""
    return samples.groupBy(*labels, _grid_up(order[0], step).alias("at_time")).agg(
        F.max_by("value", order_key(samples, order)).alias("value")
    )


def offset_delta(
    samples: DataFrame, labels: Sequence[str], offset: int = 180, step: int = 60, order: Sequence[str] = ("ts",), lookback: int = LOOKBACK_SECONDS
) -> DataFrame:
    """Value at each grid time minus the value ``offset`` seconds before; a missing one counts as 0.

    The earlier value is the newest one not older than ``lookback`` at that time.
    """
    grid = last_per_step(samples, labels, step, order).withColumn("_s", F.unix_seconds("at_time"))
    earlier = Window.partitionBy(*labels).orderBy("_s").rangeBetween(-offset - lookback, -offset)
    delta = F.coalesce("value", F.lit(0.0)) - F.coalesce(F.last("value").over(earlier), F.lit(0.0))
    return grid.select(*labels, "at_time", delta.alias("delta"))


def alert_hold(
    samples: DataFrame, labels: Sequence[str], holds: Column, seconds: int, order: Sequence[str] = ("ts",)
) -> DataFrame:
    """Spans in which the condition held at every sample for at least ``seconds``.

    ``fired_at`` is when the span reached that length. Spans are told apart by the last sample at
    which the condition failed, so a long series is not kept in one task.
    """
    ts = order[0]
    ok = F.coalesce(holds, F.lit(False))
    rows = with_runs(samples.withColumn("_ok", ok), labels, order)
    failed = F.when(~F.col("_ok"), order_key(samples, order))
    rows = carry_in(rows, labels, {"_fail": F.max(failed)}, {"_fail_in": (F.max("_fail"), labels)})
    rows = rows.withColumn("_span", F.coalesce(F.max(failed).over(so_far(labels, order)), "_fail_in"))
    spans = rows.filter("_ok").groupBy(*labels, "_span").agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count(F.lit(1)).alias("n_samples")
    )
    fired = F.timestamp_micros(F.unix_micros("started_at") + seconds * 1_000_000)
    return spans.withColumn("fired_at", fired).filter(F.col("fired_at") <= F.col("ended_at")).drop("_span")


def absent_instances(up: DataFrame, seen: DataFrame, key: str = "instance") -> DataFrame:
    return up.select(key).distinct().join(seen.select(key).distinct(), key, "left_anti")


def per_unit(many: DataFrame, one: DataFrame, on: Sequence[str], value: str = "value", units: str = "units") -> DataFrame:
    """Each value divided by the unit count of its instance."""
    return many.join(one.select(*on, units), list(on)).withColumn("per_unit", F.try_divide(F.col(value), F.col(units)))


def log_rate(logs: DataFrame, condition: Column, labels: Sequence[str], window: int = 3600) -> DataFrame:
    """Lines per second that meet a condition, per label set and tumbling window."""
    return (
        logs.filter(condition)
        .groupBy(*labels, F.window("ts", f"{window} seconds").alias("_w"))
        .agg((F.count(F.lit(1)) / float(window)).alias("rate"))
        .select(*labels, F.col("_w.end").alias("at_time"), "rate")
    )


def last_event_time(
    samples: DataFrame, labels: Sequence[str], by: Sequence[str], window: int = 120, step: int = 60, order: Sequence[str] = ("ts",)
) -> DataFrame:
    """At each grid time the newest grid time at which any counter of the group changed."""
    moved = changes(samples, labels, window, step, order).groupBy(*by, "at_time").agg(F.sum("changes").alias("_n"))
    w = Window.partitionBy(*by).orderBy("at_time").rowsBetween(Window.unboundedPreceding, 0)
    return moved.select(*by, "at_time", F.max(F.when(F.col("_n") > 0, F.col("at_time"))).over(w).alias("last_event"))


def progress_pct(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Done over total while a run is active; 0 when idle or the largest total is not positive.

    ``samples`` has the columns running, total, done (finished parts, good or bad).
    """
    total = F.sum(F.when(F.col("total") >= 0, F.col("total")))
    done = F.sum(F.when(F.col("done") >= 0, F.col("done")))
    share = F.when(F.max("total") <= 0, 0.0).otherwise(F.try_divide(done.cast("double"), total.cast("double")))
    active = F.when(F.max("running") > 0, 1.0).otherwise(0.0)
    return samples.groupBy(*by).agg((active * share).alias("progress"))
