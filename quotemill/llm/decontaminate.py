"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.common import DIGEST, identified, null_safe
from quotemill.llm.words import WordHashes, ascii_words, rolling, window_minima
from quotemill.session import stored

#: Slots of the bit table that lets texts drop fingerprints no test item can have: 512 KiB, always.
SLOTS = 1 << 22


def _grams(length: int, k: int) -> tuple[int, int]:
    """k-gram size and grams per window, so that a window of ``length`` words holds one whole fingerprint."""
    k = min(k, length)
    return k, length - k + 1


def _windows(hashes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` words its fingerprint (smallest k-gram hash) and where that gram starts."""
    k, w = _grams(length, k)
    grams = rolling(hashes, k)
    return window_minima(grams, w) if len(grams) >= w else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _item_windows(benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """All windows of all items: item_id, length, fingerprint, window (its words)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch["item_id"], batch["text"].to_pylist()):
                words = ascii_words(text)
                if not words:
                    continue
                length = min(window, len(words))
                least, _ = _windows(seen.of(words), length, k)
                for start, value in enumerate(least.view(np.int64).tolist()):
                    out.append((item, length, value, b" ".join(words[start : start + length]).decode()))
            columns = list(zip(*out)) or [(), (), (), ()]
            types = [batch.schema.field("item_id").type, pa.int32(), pa.int64(), pa.string()]
            arrays = [pa.array([x.as_py() for x in columns[0]], types[0]), *(pa.array(c, t) for c, t in zip(columns[1:], types[1:]))]
            yield pa.RecordBatch.from_arrays(arrays, ["item_id", "length", "fingerprint", "window"])

    item_type = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.mapInArrow(cut, f"item_id {item_type}, length int, fingerprint long, window string")


def _document_windows(docs: DataFrame, lengths: list[int], k: int, table: bytes) -> DataFrame:
    """Per row: n_words and the windows whose fingerprint is in the bit table."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bits = WordHashes(), np.frombuffer(table, np.uint8)
        for batch in batches:
            counts, found = [], []
            for text in batch["text"]:
                words = ascii_words(text.as_py())
                counts.append(len(words))
                hashes, own = seen.of(words), []
                for length in lengths:
                    least, at = _windows(hashes, length, k)
                    slot = (least & np.uint64(SLOTS - 1)).astype(np.int64)
                    for start in np.nonzero((bits[slot >> 3] >> (slot & 7)) & 1)[0].tolist():
                        own.append((start, length, int(at[start]), int(least[start].view(np.int64)), b" ".join(words[start : start + length]).decode()))
                found.append([dict(zip(("start", "length", "gram", "fingerprint", "window"), x)) for x in own])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch[DIGEST], pa.array(counts, pa.int64()), pa.array(found, shape)],
                ["doc_id", DIGEST, "n_words", "windows"],
            )

    shape = pa.list_(
        pa.struct([("start", pa.int32()), ("length", pa.int32()), ("gram", pa.int32()), ("fingerprint", pa.int64()), ("window", pa.string())])
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    inner = "array<struct<start:int,length:int,gram:int,fingerprint:bigint,window:string>>"
    return docs.mapInArrow(scan, f"doc_id {kind}, {DIGEST} long, n_words long, windows {inner}")


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, spans, items)`` of texts that share ``window`` words in a row with a test item.

    Every window of ten words holds six 5-grams; the one with the smallest hash is its fingerprint,
    so a text and an item that share a window share its fingerprint. Fingerprints of both sides are
    joined, and each hit is extended: the words around the gram, out to every window it stands for,
    are compared with the item's. So no shared window is missed and none is taken by hash alone.
    An item of fewer words is one window; texts are then cut into windows of that length as well.

    Items' windows are made distinct first, so a row meets each of them once at most, however many
    items or texts share it. Only fingerprints found in a bit table of fixed size leave the scan.

    rows: doc_id, digest, n_words for every row of ``docs``. spans: doc_id, digest, start, length,
    distinct. items: doc_id, digest, item_id, distinct. Null texts and items have no words.
    """
    items = stored(_item_windows(benchmark.select(F.col("item_id"), F.col("text")), window, k), "item-windows")
    lengths = sorted(x[0] for x in items.select("length").distinct().collect())  # ten values at most
    taken = items.select(F.pmod("fingerprint", F.lit(SLOTS)).cast("int")).distinct().toPandas().to_numpy().ravel()
    flags = np.zeros(SLOTS, np.uint8)
    flags[taken] = 1
    table = np.packbits(flags, bitorder="little").tobytes()
    rows = stored(_document_windows(identified(docs, id_col, text_col), lengths, k, table), "document-windows")
    hits = rows.select("doc_id", DIGEST, F.explode("windows").alias("x")).select("doc_id", DIGEST, "x.*")
    known = items.select("length", "fingerprint", "window").distinct()
    matched = hits.join(known, ["fingerprint", "length", "window"]).select("doc_id", DIGEST, "start", "length", "window").distinct()
    matched = stored(matched, "shared-windows")
    of_item = items.select("length", "window", "item_id").distinct()
    pairs = matched.select("doc_id", DIGEST, "length", "window").distinct().join(of_item, ["length", "window"])
    return rows.drop("windows"), matched.select("doc_id", DIGEST, "start", "length"), pairs.select("doc_id", DIGEST, "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, digest, n_words, n_hit (words inside shared windows), items (sorted
    texts of item ids), contaminated. Rows without words, and all rows where there is no benchmark,
    have zeros and an empty list; equal rows get equal results."""
    rows, spans, items = contaminated_spans(docs, benchmark, window, k, id_col, text_col)
    by_row = Window.partitionBy("doc_id", DIGEST).orderBy("start", "length")
    covered = F.max(F.col("start") + F.col("length")).over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest(F.col("start"), F.coalesce(covered, F.lit(0))))
    hit = spans.withColumn("new", new).groupBy("doc_id", DIGEST).agg(F.sum("new").cast("long").alias("n_hit"))
    named = items.groupBy("doc_id", DIGEST).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    key = ["doc_id", DIGEST]
    joined = null_safe(null_safe(rows, hit, key), named, key)
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id", DIGEST, "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated")
    )
