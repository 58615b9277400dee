"""Ordered work on keys of any size.

A plain window over ``partitionBy(key)`` puts every row of a key into one task, which fails once
one symbol holds a large part of all ticks. Here a key is cut into runs of consecutive rows. Each
run is handled on its own, and what a run needs from earlier ones comes from one small row per
run, scanned in run order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.ordering import order_key
from quotemill.session import settle

RUN = "_run"
#: Time buckets that a run may be, coarsest first.
WIDTHS = ("day", "hour", "minute")


def with_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_run_rows: int = 2_000_000) -> DataFrame:
    """Add ``_run``: a time bucket of ``order[0]``, or a balanced piece where even minutes are too full.

    One job counts the fullest (key, bucket) of every width; counts are combined before the shuffle.
    The coarsest width within the limit is taken, so what is carried between runs is one row per day
    unless a key has very many rows. Beyond the limit rows are range-partitioned by key and order
    instead, which cuts even a bucket of equal timestamps, and the piece numbers are settled so that
    later reads agree on them.
    """
    width = _widest(df, keys, order[0], max_run_rows)
    if width is None:
        return balanced_runs(df, keys, order)
    return df.withColumn(RUN, F.date_trunc(width, F.col(order[0])))


def _widest(df: DataFrame, keys: Sequence[str], at: str, max_run_rows: int) -> str | None:
    finest = WIDTHS[-1]
    counts = df.groupBy(*keys, F.date_trunc(finest, F.col(at)).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    fullest = {}
    for finer, width in zip(reversed(WIDTHS), reversed(WIDTHS[:-1])):
        fullest = {f"_{finer}": F.max("_n"), **{c: F.max(c) for c in fullest}}
        bucket = F.date_trunc(width, F.col("_t")).alias("_t")
        counts = counts.groupBy(*keys, bucket).agg(F.sum("_n").alias("_n"), *[f.alias(c) for c, f in fullest.items()])
    most = counts.agg(F.max("_n").alias(f"_{WIDTHS[0]}"), *[F.max(c).alias(c) for c in fullest]).first()
    return next((w for w in WIDTHS if (most[f"_{w}"] or 0) <= max_run_rows), None)


def balanced_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int | None = None) -> DataFrame:
    """Add ``_run``: the number of an evenly filled piece of the (key, order) range."""
    n = pieces or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    return settle(df.repartitionByRange(n, *keys, *order).withColumn(RUN, F.spark_partition_id()))


def carry_in(
    rows: DataFrame,
    keys: Sequence[str],
    per_run: dict[str, Column],
    carried: dict[str, tuple[Column, Sequence[str]]],
) -> DataFrame:
    """Join to each row what earlier runs pass on.

    ``per_run`` are aggregates of one run (combined before the shuffle). ``carried`` maps an output
    name to an aggregate over the runs before this one and the keys within which it goes on; the
    other keys (a day, say) only order the runs.
    """
    totals = rows.groupBy(*keys, RUN).agg(*[c.alias(n) for n, c in per_run.items()])
    out = {}
    for name, (agg, within) in carried.items():
        order = [*[k for k in keys if k not in within], RUN]
        before = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        out[name] = agg.over(before)
    carries = totals.withColumns(out).select(*keys, RUN, *carried)
    return rows.join(carries, [*keys, RUN], "left")


def in_run(keys: Sequence[str], order: Sequence[str]):
    """The window of one run of a key, in order."""
    return Window.partitionBy(*keys, RUN).orderBy(*order)


def so_far(keys: Sequence[str], order: Sequence[str]):
    return in_run(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def run_end(df: DataFrame, column: str, order: Sequence[str]) -> Column:
    """Per-run aggregate: the column's value on the last row, NULL or not."""
    return F.max_by(column, order_key(df, order))


def starts_run(keys: Sequence[str], order: Sequence[str]) -> Column:
    """Whether a row is the first of its run."""
    return F.lag(F.lit(1)).over(in_run(keys, order)).isNull()


def before_row(column: str, carried: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    """The column's value one row earlier; on the first row of a run the carried run end."""
    return F.when(starts_run(keys, order), F.col(carried)).otherwise(F.lag(column).over(in_run(keys, order)))


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], runs: DataFrame | None = None
) -> DataFrame:
    """Add the value each column had on the row before, across run borders: {new name: column}."""
    rows = runs if runs is not None else with_runs(df, keys, order)
    ends = {f"_end_{new}": run_end(rows, old, order) for new, old in columns.items()}
    joined = carry_in(rows, keys, ends, {f"_in_{new}": (F.last(f"_end_{new}"), keys) for new in columns})
    out = {new: before_row(old, f"_in_{new}", keys, order) for new, old in columns.items()}
    return joined.withColumns(out).drop(*[f"_in_{new}" for new in columns])
