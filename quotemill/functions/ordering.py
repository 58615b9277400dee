"""First and last rows by an order of several columns, in aggregates that need no sort."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# More than all whole numbers of 64 bits are apart, and a time before all others.
_SPAN = Decimal(2 * 10**19)
_EARLIEST = -4 * 10**18
_LEAST = -(2**63)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FIXED = (*_WHOLE, T.FloatType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def order_key(df: DataFrame, order: Sequence[str]) -> Column:
    """One value that sorts like ``order``, NULL first.

    A time and a whole number become one decimal of fixed width, and a single column stays itself;
    aggregates that compare these keep their buffers in place and hash. Anything else is a struct,
    for which Spark sorts the rows first.
    """
    kinds = [df.schema[c].dataType for c in order]
    if len(order) == 2 and isinstance(kinds[0], T.TimestampType) and isinstance(kinds[1], _WHOLE):
        at = F.coalesce(F.unix_micros(order[0]), F.lit(_EARLIEST)).cast("decimal(19,0)")
        return at * F.lit(_SPAN) + F.coalesce(F.col(order[1]).cast("long"), F.lit(_LEAST)).cast("decimal(19,0)")
    if len(order) == 1 and isinstance(kinds[0], _FIXED) and not df.schema[order[0]].nullable:
        return F.col(order[0])
    return F.struct(*[F.col(c) for c in order])


def is_fixed(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether all columns have a width that an aggregate can update in place."""
    return all(isinstance(df.schema[c].dataType, _FIXED) for c in columns)


def one_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: bool = False) -> DataFrame:
    """The last row (or the first) of each key, NULL keys included; rows of one order count as any one of them.

    Where all columns have a fixed width, each is picked by one hash aggregate. Else the aggregate
    picks the order's extreme, and the rows that have it are joined back; streams, which can't read
    their rows twice, sort instead.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if first else F.max_by
    key = order_key(df, order)
    hashes = not isinstance(df.select(key.alias("k")).schema["k"].dataType, T.StructType)
    if hashes and is_fixed(df, rest):
        return df.withColumn("_at", key).groupBy(*keys).agg(*[pick(c, "_at").alias(c) for c in rest]).select(*df.columns)
    if not hashes or df.isStreaming:
        row = pick(F.struct(*rest), F.struct(*order))
        return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*").select(*df.columns)
    rows = df.withColumn("_at", key)
    ends = rows.groupBy(*keys).agg((F.min("_at") if first else F.max("_at")).alias("_end"))
    ends = ends.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = [F.col("_at") == F.col("_end"), *[F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]]
    alike = Window.partitionBy(*keys).orderBy(F.xxhash64(*df.columns))
    return rows.join(ends, same).withColumn("_n", F.row_number().over(alike)).filter("_n = 1").select(*df.columns)
