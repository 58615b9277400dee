"""Packing documents into sequences of fixed size by the sum of squares of open gaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import identified
from quotemill.llm.tokens import RANKS, VOCABULARY, encoder
from quotemill.session import stored

END_ID = 0


def token_pieces(
    docs: DataFrame, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, vocabulary: str = VOCABULARY, ranks: str = RANKS
) -> DataFrame:
    """Every document as ids and an end id, cut where it is longer than ``size``.

    Only the first piece of a cut document may be shorter. Columns: doc_id, piece, start, length,
    ids_crc32, and ``ids`` on request. A null text is empty: its one piece is the end id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks).encode
        for batch in batches:
            rows, pieces, starts, lengths, sums, parts = [], [], [], [], [], []
            for row, text in enumerate(batch["text"]):
                ids = encode(text.as_py() or "")
                ids.append(END_ID)
                at, piece, end = 0, 0, len(ids) % size or size
                raw = memoryview(ids).cast("B")
                while at < len(ids):
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(at)
                    lengths.append(end - at)
                    sums.append(zlib.crc32(raw[4 * at : 4 * end]))
                    if with_ids:
                        parts.append(ids[at:end].tolist())
                    at, end, piece = end, end + size, piece + 1
            columns = [batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(parts, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return identified(docs, id_col, text_col).select("doc_id", "text").mapInArrow(cut, shape)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length (under ``size``), taken in decreasing order.

    Open sequences are counted by the gap they have left. Of the gaps that hold the next length,
    that one is filled which leaves the smallest sum of squared counts (ties: the tightest); only
    where none holds it a new sequence is opened.
    """
    order = np.argsort(-lengths, kind="stable")
    counts = np.zeros(size + 1, np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened, closed = 0, np.iinfo(np.int64).max
    for item in order.tolist():
        length = int(lengths[item])
        # by filling gap g its count goes down by one and that of g - length up by one
        change = 1 - 2 * counts[length:size]
        change[1:] += 2 * counts[1 : size - length] + 1
        change[counts[length:size] == 0] = closed
        best = int(change.argmin()) if len(change) else 0
        if len(change) and change[best] != closed:
            gap = length + best
            counts[gap] -= 1
            chosen = open_by_gap[gap].pop()
        else:
            gap, chosen = size, opened
            opened += 1
        if gap > length:
            counts[gap - length] += 1
            open_by_gap[gap - length].append(chosen)
        sequence[item], offset[item] = chosen, size - gap
    return sequence, offset


def pack(docs: DataFrame, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, group_rows: int = 200_000, **files: str) -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and ``offset``.

    Pieces of full size are a sequence each. The others are dealt evenly, whatever their ids, into
    groups of about ``group_rows``, and each group is packed by itself; a group leaves one open
    sequence or so, under one in ten thousand. Only lengths and row numbers travel to the groups.

    Null texts and ids, ties and repeated rows are packed like any other; an empty table gives none.
    """
    cut = token_pieces(docs, size, id_col, text_col, with_ids, **files)
    pieces = stored(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < size).select("row", "length")
    groups = max(1, -(-short.count() // group_rows))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        sequence, offset = sum_of_squares(group["length"].to_numpy(), size)
        return pd.DataFrame({"placed": group["row"], "sequence_id": group["part"].astype("int64") * 2**32 + sequence, "offset": offset})

    # the written row numbers count up within each file, so their remainders are spread evenly
    dealt = short.withColumn("part", F.pmod("row", F.lit(groups)))
    placed = dealt.groupBy("part").applyInPandas(fill, "placed long, sequence_id long, offset long")
    joined = pieces.join(placed, pieces["row"] == placed["placed"], "left")
    return joined.withColumns(
        {"sequence_id": F.coalesce("sequence_id", -1 - F.col("row")), "offset": F.coalesce("offset", F.lit(0).cast("long"))}
    ).drop("row", "placed")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences of ``pack(..., with_ids=True)``: sequence_id, ids."""
    part = F.struct("offset", "ids")
    return packed.groupBy("sequence_id").agg(F.flatten(F.array_sort(F.collect_list(part))["ids"]).alias("ids"))
