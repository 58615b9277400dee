"""Sharding by a Feistel permutation over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.common import DIGEST, identified
from quotemill.session import stored

ROUNDS = 6
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Feistel:
    """A bijection of 0..total-1, the same for the same ``total`` and ``seed``.

    Values walk along their cycle on the next power of four until they fall below ``total``; that
    power is under four times ``total``, so a walk takes four steps on average at most.
    """

    def __init__(self, total: int, seed: int = 0):
        self.total = total
        self.half = np.uint64(max(1, (max(total - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        steps = [((seed + 1) * _STEP + i * _STEP * 3) & (2**64 - 1) for i in range(ROUNDS)]
        self.keys = _mix(np.array(steps, np.uint64))

    def _forward(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ (_mix(right ^ key) & self.mask)
        return (left << self.half) | right

    def _backward(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1]:
            left, right = right ^ (_mix(left ^ key) & self.mask), left
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(x).astype(np.uint64))
        while (outside := out >= np.uint64(self.total)).any():
            out[outside] = step(out[outside])
        return out.astype(np.int64)

    def position(self, row_number: np.ndarray) -> np.ndarray:
        return self._walk(row_number, self._forward)

    def row_number(self, position: np.ndarray) -> np.ndarray:
        return self._walk(position, self._backward)


def place(row_number: int, total: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a global row number, without any table."""
    position = int(Feistel(total, seed).position(np.array([row_number]))[0])
    return position % shards, position // shards


def row_at(shard: int, slot: int, total: int, shards: int, seed: int = 0) -> int:
    """The global row number that lies in a shard's slot."""
    return int(Feistel(total, seed).row_number(np.array([slot * shards + shard]))[0])


def shard_rows(
    docs: DataFrame,
    shards: int = 8,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 4096,
    span: int = 65_536,
) -> DataFrame:
    """Every row of ``docs`` with its global row number, its shuffled position, shard and slot.

    Row numbers follow (bucket of the row's hash, id, size, checksum, digest), so they depend on the
    set of rows only, not on files or partitions. Equal rows are counted first and numbered as one
    run, which is dealt out again afterwards: a row that makes up a third of the table stays small.
    Position p goes to shard p mod ``shards``, slot p div ``shards``; counts differ by one at most.

    Null text: size 1, checksum 0. Null ids are numbered like any other. An empty table gives none.
    Columns: doc_id, size, text_crc32, row_number, position, shard, slot.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = identified(docs, id_col, text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        DIGEST,
    )
    order = ["doc_id", "size", "text_crc32", DIGEST]
    counted = stored(
        rows.groupBy(*order).agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")),
        "shard-rows",
    )
    totals = {b: n for b, n in counted.groupBy("bucket").agg(F.sum("n")).collect()}  # one row a bucket
    starts, total = [], 0
    for bucket in range(buckets):
        starts.append((bucket, total))
        total += totals.get(bucket, 0)
    before = F.broadcast(spark.createDataFrame(starts, "bucket int, start long"))
    upto = F.sum("n").over(Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    runs = counted.withColumn("upto", upto).join(before, "bucket").withColumn("first", F.col("start") + F.col("upto") - F.col("n"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / span)))
    inside = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(span).cast("long"), F.col("n") - F.col("part") * span) - 1))
    numbered = runs.withColumn("part", part).withColumn("inside", inside).withColumn(
        "row_number", F.col("first") + F.col("part") * span + F.col("inside")
    )
    deal = Feistel(total, seed)

    @F.pandas_udf("long")
    def shuffled(row_number: pd.Series) -> pd.Series:
        return pd.Series(deal.position(row_number.to_numpy()))

    return numbered.select("doc_id", "size", "text_crc32", "row_number", shuffled("row_number").alias("position")).select(
        "*",
        (F.col("position") % shards).cast("int").alias("shard"),
        F.floor(F.col("position") / shards).cast("long").alias("slot"),
    )
