"""Keyed Parquet tables: upsert, replace and delete by key, and the small reads a load needs.

A table is a folder partitioned by a date, by the day of a time, or by ``key_bucket`` where it has
neither. A write touches only the partitions that hold changed keys: they are read, merged and
written anew, and one published list makes them the table's (``versions``). Readers see the table as
it was before a write or after it, whatever becomes of the writer. Writing the same rows again
changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.functions.ordering import one_row
from quotemill.sources.versions import DATA, Version, Versions

# Above this many touched partitions their list is joined instead of being written into the filter.
LISTED_PARTITIONS = 1000
# How often a write starts anew because another writer came first.
ATTEMPTS = 5


@dataclass(frozen=True)
class Table:
    """Where a table lies, its key, and what it is partitioned by.

    ``day_of`` names a time column whose date is the partition. ``keep`` is how many versions stay
    readable; a reader that is slower than that many writes must read again.
    """

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    partition: str = "key_bucket"
    buckets: int = field(default=16)
    day_of: str | None = None
    keep: int = 3

    @property
    def bucketed(self) -> bool:
        return self.partition == "key_bucket"

    def stored_schema(self) -> T.StructType:
        if self.partition in self.schema.names:
            return self.schema
        kind = T.IntegerType() if self.bucketed else T.DateType()
        return T.StructType([*self.schema.fields, T.StructField(self.partition, kind)])

    def shaped(self, df: DataFrame) -> DataFrame:
        """Declared columns and types; a missing column becomes NULL."""
        have = set(df.columns)
        out = df.select(
            *[
                (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in self.schema.fields
            ]
        )
        if self.bucketed:
            hashed = F.xxhash64(*[F.col(k).cast("string") for k in self.keys])
            out = out.withColumn("key_bucket", F.pmod(hashed, F.lit(self.buckets)).cast("int"))
        elif self.day_of is not None:
            out = out.withColumn(self.partition, F.to_date(self.day_of))
        return out

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark, Versions(spark, self.path).latest()).select(*self.schema.names)

    def _stored(self, spark: SparkSession, version: Version) -> DataFrame:
        schema = self.stored_schema()
        if not version.folders:
            return spark.createDataFrame([], schema)
        # each partition is read from the version that wrote it last
        read = spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.StringType())]))
        folders = [f"{self.path}/{f}" for f in version.folders.values()]
        return read.option("basePath", f"{self.path}/{DATA}").parquet(*folders).select(*schema.names)

    def exists(self, spark: SparkSession) -> bool:
        return bool(Versions(spark, self.path).numbers())


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the last in the given order, or in the order of all other columns."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    whole = F.struct(*rest)
    if order:
        return one_row(df, keys, order)
    row = F.max(whole)
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in an explicit order, combined before the shuffle."""
    return one_row(df, keys, order, first=True)


def _meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys`` where NULL meets NULL; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    joined = left.join(renamed, [left[k].eqNullSafe(renamed[f"_key_{k}"]) for k in keys], how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_key_{k}" for k in keys])


def merge(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str] | None = None,
    do_nothing: bool = False,
) -> DataFrame:
    """The table after INSERT .. ON CONFLICT, for updates with one row per key.

    ``update_cols`` are overwritten on a known key, the other columns keep their stored value. A NULL
    in a key is a value like any other.
    """
    if do_nothing:
        fresh = _meet(updates, target.select(*keys), keys, "left_anti")
        return target.unionByName(fresh)
    kept = _meet(target, updates.select(*keys), keys, "left_anti")
    if update_cols is None:
        return kept.unionByName(updates.select(*target.columns))
    stay = [c for c in target.columns if c not in keys and c not in update_cols]
    old = target.select(*keys, F.lit(True).alias("_known"), *[F.col(c).alias(f"_old_{c}") for c in stay])
    joined = _meet(updates, old, keys, "left")
    new = joined.select(
        *[
            F.when(F.col("_known"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) if c in stay else F.col(c)
            for c in target.columns
        ]
    )
    return kept.unionByName(new)


def _only(table: Table, stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored rows of the partitions listed in ``wanted``, that of NULL included."""
    listed = [r[0] for r in wanted.limit(LISTED_PARTITIONS + 1).collect()]
    if len(listed) > LISTED_PARTITIONS:
        return _meet(stored, wanted, [table.partition], "left_semi")
    named = F.col(table.partition).isin([v for v in listed if v is not None])
    return stored.filter(named | F.col(table.partition).isNull() if None in listed else named)


def _values(touched: DataFrame) -> list:
    """Partition values; as many as the table has partitions at most."""
    return [r[0] for r in touched.distinct().collect()]


def _commit(
    table: Table,
    spark: SparkSession,
    change: Callable[[DataFrame], tuple[DataFrame, list | None]],
    batch: int | None = None,
    expire_below: str | None = None,
) -> None:
    """Write a new version. ``change`` gives, for the stored rows, those of the partitions it touches and their values (None: all).

    A version that holds stream batch ``batch`` already stays as it is, so a replayed batch counts
    once. Partitions whose value sorts before ``expire_below`` are left out of the new version.

    Rebalancing cuts large partitions into several files and joins small ones. If another writer
    has published first, the change is made again on what that one left.
    """
    versions = Versions(spark, table.path)
    for _ in range(ATTEMPTS):
        before = versions.latest()
        if batch is not None and before.batch is not None and before.batch >= batch:
            return
        merged, touched = change(table._stored(spark, before))
        folder = versions.folder(before.number + 1)
        (
            merged.hint("rebalance", table.partition)
            .sortWithinPartitions(table.partition, *table.keys)
            .write.mode("overwrite")
            .partitionBy(table.partition)
            .parquet(f"{table.path}/{folder}")
        )
        gone = before.folders if touched is None else {versions.partition_name(table.partition, v) for v in touched}
        now = {name: f for name, f in before.folders.items() if name not in gone} | versions.partitions(folder)
        if expire_below is not None:
            now = {name: f for name, f in now.items() if name >= f"{table.partition}={expire_below}"}
        if versions.publish(Version(before.number + 1, now, before.batch if batch is None else batch)):
            versions.expire(table.keep)
            return
        versions.drop(folder)
    raise RuntimeError(f"{table.path}: other writers came first {ATTEMPTS} times")


def upsert(
    table: Table,
    updates: DataFrame,
    update_cols: Sequence[str] | None = None,
    order: Sequence[str] | None = None,
    do_nothing: bool = False,
    batch: int | None = None,
    expire_below: str | None = None,
) -> None:
    """Insert rows, or update the stored row of the same key.

    Several updates of one key count as the last one in ``order``. A key moves with its partition
    column, so that column must be part of the key or never change. ``batch`` and ``expire_below`` are
    for streams: rows of a batch that is in the table already change nothing, and partitions before
    the given value are dropped.
    """
    changes = table.shaped(last_per_key(updates, table.keys, order)).persist()

    def change(stored: DataFrame) -> tuple[DataFrame, list]:
        touched = _values(changes.select(table.partition))
        return merge(_only(table, stored, changes.select(table.partition).distinct()), changes, table.keys, update_cols, do_nothing), touched

    try:
        _commit(table, updates.sparkSession, change, batch, expire_below)
    finally:
        changes.unpersist()


def replace_all(table: Table, rows: DataFrame, batch: int | None = None) -> None:
    """Make ``rows`` the whole table."""
    _commit(table, rows.sparkSession, lambda stored: (table.shaped(rows), None), batch)


def without_keys(target: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _meet(target, gone.select(*keys).distinct(), keys, "left_anti")


def _rewrite(table: Table, keys: Sequence[str], gone: DataFrame, fresh: DataFrame | None) -> None:
    new_rows = None if fresh is None else table.shaped(last_per_key(fresh, table.keys)).persist()

    def change(stored: DataFrame) -> tuple[DataFrame, list]:
        hit = _meet(stored, gone.select(*keys).distinct(), keys, "left_semi").select(table.partition)
        hit = hit if new_rows is None else hit.union(new_rows.select(table.partition))
        touched = hit.distinct().persist()
        try:
            values = _values(touched)
            merged = without_keys(_only(table, stored, touched), gone, keys)
        finally:
            touched.unpersist()
        return merged if new_rows is None else merged.unionByName(new_rows), values

    try:
        _commit(table, gone.sparkSession, change)
    finally:
        if new_rows is not None:
            new_rows.unpersist()


def delete_by_key(table: Table, gone: DataFrame, keys: Sequence[str]) -> None:
    """Delete all rows whose ``keys`` (a part of the table's key is enough) are listed."""
    _rewrite(table, keys, gone, None)


def replace_by_key(table: Table, fresh: DataFrame, keys: Sequence[str]) -> None:
    """Delete the rows of every listed key, then insert the new set."""
    _rewrite(table, keys, fresh, fresh)


def distinct_symbols(df: DataFrame, column: str = "symbol") -> DataFrame:
    return df.select(column).distinct()


def high_water_mark(df: DataFrame, column: str) -> DataFrame:
    """One row with the newest value, NULL for an empty table."""
    return df.agg(F.max(column).alias("high_water_mark"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def missing_parents(facts: DataFrame, dim: DataFrame, key: str = "stock_code") -> DataFrame:
    """Fact rows whose code is absent from the dimension."""
    return facts.join(dim.select(key), key, "left_anti")
