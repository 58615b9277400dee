"""Exact repeats across documents: anchored suffixes, common-prefix intervals, maximal repeats.

A suffix array over all bytes of a corpus can't be held anywhere, so suffixes are kept only where
two documents can share ``size`` bytes. Of the 24-byte grams inside any run of ``size`` bytes the
one with the smallest hash is an anchor; documents that share the run share the anchor. All
occurrences of an anchor gram meet in one place; their contexts on either side, as far as a run can
reach, are sorted as suffixes there, and the tree of common-prefix intervals gives the maximal
repeats with all their occurrences.

Texts stay where they are dealt, in batches. What travels is a hash of gram and context for each
different anchor of a batch, and the bytes of a context only where equal grams have different ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.llm.common import fresh
from quotemill.llm.words import mix

GRAM = 24
NO_ID = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_CHUNK = 1 << 20
#: Hashes travel as 48 bits; a gram's bucket and 96 bits of gram and context tell anchors apart.
_LOW48 = np.uint64((1 << 48) - 1)


def _byte_values() -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)


_VALUES = _byte_values()


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def powers(base: int) -> np.ndarray:
                return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]), dtype=np.uint64)

            self.up, self.down = powers(_BASE), powers(pow(_BASE, -1, 2**64))
        return self.up, self.down


_powers = _Powers()


def _running(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """Best value of each run of ``w``."""
    have = 1
    while have * 2 <= w:
        x, have = best(x[:-have], x[have:]), have * 2
    return best(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


class Anchors:
    """Anchors of one chunk of documents: document number, place, ends of the context, and hashes."""

    def __init__(self, texts: list[bytes], size: int):
        self.size, reach = size, size - GRAM
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.lengths)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.data)
        if n < size:
            self.at = self.low = self.high = self.doc = np.empty(0, np.int64)
            self.gram = self.context = np.empty(0, np.uint64)
            return
        up, down = _powers.upto(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[self.data] * up[:n], out=prefix[1:])
        grams = mix((prefix[GRAM:] - prefix[: n - GRAM + 1]) * down[: n - GRAM + 1]) | np.uint64(1)
        least = _running(grams, reach + 1, np.minimum)  # by the start of the run of ``size`` bytes
        whole = np.ones(len(least), bool)
        for end, length in zip(self.ends.tolist(), self.lengths.tolist()):
            whole[max(end - size + 1, end - length, 0) : end] = False  # runs that would cross the end of a document
        least[~whole] = 0
        padded = np.zeros(len(least) + 2 * reach, np.uint64)
        padded[reach : reach + len(least)] = least
        # a gram is an anchor if it is the least of some run that holds it
        self.at = np.nonzero(_running(padded, reach + 1, np.maximum)[: len(grams)] == grams)[0]
        self.doc = np.searchsorted(self.ends, self.at, side="right")
        self.low = np.maximum(self.at - reach, self.ends[self.doc] - self.lengths[self.doc])
        self.high = np.minimum(self.at + size, self.ends[self.doc])
        self.gram = grams[self.at]
        shape = ((self.at - self.low) * 64 + (self.high - self.at)).astype(np.uint64) * _STEP
        self.context = mix((prefix[self.high] - prefix[self.low]) * down[self.low] ^ shape) & _LOW48


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, held, size = 0, [], 0
    for number, text in enumerate(texts):
        if held and size + len(text) > _CHUNK:
            yield first, held
            first, held, size = number, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def _common(a: int, b: int, width: int, most: int) -> int:
    """Common leading bytes of two strings written as numbers of ``width`` bytes."""
    return min(most, width - ((a ^ b).bit_length() + 7) // 8)


def _intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """All common-prefix intervals ``(length, first, last)`` of a sorted list of suffixes, bottom up.

    ``common[i]``: length shared by suffixes i and i + 1. A stack holds the intervals still open.
    """
    stack: list[tuple[int, int]] = []
    for at, length in enumerate([*common, -1]):
        first = at
        while stack and stack[-1][0] > length:
            height, first = stack.pop()
            if height >= least:
                yield height, first, at
        if length >= 0 and (not stack or stack[-1][0] < length):
            stack.append((length, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], reach: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats around one gram: ``(left, right, members)`` with left + right >= ``reach``.

    ``rights`` are the suffixes after the gram, ``lefts`` the bytes before it. Each interval of the
    sorted suffixes is a right-maximal repeat. Inside it, the members are sorted by what precedes
    them: an interval there is a set that agrees on ``left`` bytes and, if its members differ in the
    byte before those, can't be extended to the left. All members are listed, not neighbours only.
    """
    n = len(rights)
    after = [int.from_bytes(r.ljust(reach, b"\0"), "big") for r in rights]
    before = [int.from_bytes(x[::-1].ljust(reach, b"\0"), "big") for x in lefts]
    order = sorted(range(n), key=lambda i: (after[i], len(rights[i])))
    shared = [_common(after[a], after[b], reach, min(len(rights[a]), len(rights[b]))) for a, b in zip(order, order[1:])]
    for right, first, last in _intervals(shared, 0):
        members = sorted(order[first : last + 1], key=lambda i: (before[i], len(lefts[i])))
        agree = [_common(before[a], before[b], reach, min(len(lefts[a]), len(lefts[b]))) for a, b in zip(members, members[1:])]
        if max(agree) + right >= reach:
            for left, a, b in _intervals(agree, reach - right):
                yield left, right, members[a : b + 1]


_BLOB = "batch int, bucket int, gram binary, context binary, least binary, several binary"
_ANSWER = "batch int, gram binary, context binary, span binary, least binary"
_ASK = "batch int, bucket int, gram long, context long, least long, batches array<int>"
_CONTEXT = "bucket int, gram long, context long, least long, batches array<int>, lead binary, trail binary"


def _arrow(shape: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(shape))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy()


def _texts(column: pa.ChunkedArray) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``wanted`` and the first place each has in the sorted ``keys``; rows without one are left out."""
    at = np.searchsorted(keys, wanted)
    hit = at < len(keys)
    hit[hit] = keys[at[hit]] == wanted[hit]
    return np.nonzero(hit)[0], at[hit]


def _key(gram: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix((gram & _LOW48) + context * _STEP)


def _packed(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(table: pa.Table, name: str) -> np.ndarray:
    low = _blobs(table, name, np.uint8).reshape(-1, 6)
    whole = np.zeros((len(low), 8), np.uint8)
    whole[:, :6] = low
    return whole.view("<u8").ravel().astype(np.uint64)


def _packed_ids(ids: np.ndarray) -> bytes:
    """Sorted ids as steps, by planes of equal bytes: the empty ones vanish when the shuffle compresses."""
    return np.diff(ids, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked_ids(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.cumsum(np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()) for x in table[name].to_pylist()])


def _blobs(table: pa.Table, name: str, kind: type | np.dtype) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in table[name].to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def remove_repeats(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text", result: str = "repeats", as_text: bool = False, batch_bytes: int = 8 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with a struct column: ``kept`` (what is left), n_bytes, n_removed, n_spans.

    ``kept`` is binary; ``as_text`` makes it a string, from which characters that a cut has split are
    left out.

    Removed is each byte covered by a run of ``size`` bytes that a document with a smaller id holds
    too, as the texts are given. Ids are whole numbers. Null ids come after all others, and count as
    one document with each other, as do equal ids. Null texts are empty. If ``docs`` has a column
    named ``result``, underscores are added to the name. Row order doesn't matter; an empty table
    gives an empty table.

    1. Each batch lists its anchors once per gram and context, with the smallest id that has them.
    2. By gram: contexts that all agree are answered at once; else one batch is asked for each.
    3. The bytes of those contexts go to their gram, where maximal repeats are found.
    4. Each batch gets, for its own anchors, how far to either side which smallest id reaches.
    A gram that very many documents share costs one row per batch that has it.
    """
    if size < 2 * GRAM or size > GRAM + 64:
        raise ValueError(f"size must be between {2 * GRAM} and {GRAM + 64}")
    reach = size - GRAM
    result = fresh(docs, result)
    batch_col = fresh(docs, "batch_of_row")
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    batches, buckets = max(1, -(-total // batch_bytes)), max(1, -(-total // bucket_bytes))
    # the partition is part of the key: equal rows, however many, are spread like others
    spread = F.pmod(F.xxhash64(F.col(id_col), F.spark_partition_id()), F.lit(batches)).cast("int")
    texts = docs.withColumn(batch_col, spread)
    by_batch = texts.groupBy(batch_col)
    blob, answer, ask, context = map(_arrow, (_BLOB, _ANSWER, _ASK, _CONTEXT))

    def bucket_of(gram: np.ndarray) -> np.ndarray:
        return ((gram >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)

    def listed(table: pa.Table) -> pa.Table:
        ids, grams, contexts, owners = _ids(table[id_col]), [], [], []
        for first, part in _chunks(_texts(table[text_col])):
            found = Anchors(part, size)
            grams.append(found.gram)
            contexts.append(found.context)
            owners.append(ids[first + found.doc])
        gram, context_, owner = map(np.concatenate, (grams, contexts, owners))
        order = np.lexsort((owner, _key(gram, context_)))
        gram, context_, owner = gram[order], context_[order], owner[order]
        starts = np.nonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (context_[1:] != context_[:-1])]))[0] if len(gram) else np.empty(0, np.int64)
        lasts = np.concatenate([starts[1:], [len(gram)]])[: len(starts)] - 1
        several = (owner[lasts] > owner[starts]).astype(np.uint8)
        gram, context_, owner = gram[starts], context_[starts], owner[starts]
        bucket = bucket_of(gram)
        order = np.lexsort((owner, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
        batch = table[batch_col][0].as_py()
        rows = []
        for b in range(buckets):
            own = order[cuts[b] : cuts[b + 1]]
            if len(own):
                rows.append((batch, b, _packed(gram[own]), _packed(context_[own]), _packed_ids(owner[own]), several[own].tobytes()))
        return _table(rows, blob)

    def decided(table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        """Rows of shared grams, sorted by gram, context, least id: gram, context, least, batch, class number, gram number."""
        gram, context_, least = _unpacked(table, "gram"), _unpacked(table, "context"), _unpacked_ids(table, "least")
        several = _blobs(table, "several", np.uint8)
        batch = np.repeat(table["batch"].to_numpy(), [len(x) // 6 for x in table["gram"].to_pylist()])
        order = np.argsort(gram, kind="stable")
        # grams of a single row and a single document go first: nearly all of them
        g = gram[order]
        alone = np.concatenate([[True], g[1:] != g[:-1]]) & np.concatenate([g[1:] != g[:-1], [True]])
        order = order[~alone | (several[order] > 0)]
        order = order[np.lexsort((least[order], context_[order], gram[order]))]
        gram, context_, least, several, batch = (x[order] for x in (gram, context_, least, several, batch))
        if not len(gram):
            return gram, context_, least, batch, np.empty(0, np.int64), np.empty(0, np.int64)
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        of_gram = np.cumsum(new_gram) - 1
        low, high = np.full(of_gram[-1] + 1, NO_ID), np.full(of_gram[-1] + 1, -NO_ID)
        np.minimum.at(low, of_gram, least)
        np.maximum.at(high, of_gram, np.where(several > 0, NO_ID, least))
        keep = (high > low)[of_gram] | (np.bincount(of_gram, several)[of_gram] > 0)
        gram, context_, least, batch, of_gram = (x[keep] for x in (gram, context_, least, batch, of_gram))
        new_class = np.concatenate([[True], (gram[1:] != gram[:-1]) | (context_[1:] != context_[:-1])]) if len(gram) else np.empty(0, bool)
        return gram, context_, least, batch, np.cumsum(new_class) - 1, of_gram

    def agreed(gram: np.ndarray, of_class: np.ndarray, of_gram: np.ndarray) -> np.ndarray:
        """Which rows belong to grams with one context only."""
        if not len(gram):
            return np.empty(0, bool)
        classes = np.bincount(of_gram, np.concatenate([[1], np.diff(of_class)]))
        return classes[of_gram] == 1

    def settled(table: pa.Table) -> pa.Table:
        gram, context_, least, batch, of_class, of_gram = decided(table)
        one = agreed(gram, of_class, of_gram)
        firsts = np.searchsorted(of_class, np.arange(of_class[-1] + 1)) if len(of_class) else of_class
        smallest = least[firsts][of_class] if len(of_class) else least
        rows = []
        order = np.nonzero(one)[0]
        order = order[np.argsort(batch[order], kind="stable")]
        for own in np.split(order, np.nonzero(np.diff(batch[order]))[0] + 1) if len(order) else []:
            whole = np.full((len(own), 2), reach, np.uint8)
            rows.append((int(batch[own[0]]), gram[own].tobytes(), context_[own].tobytes(), whole.tobytes(), smallest[own].tobytes()))
        return _table(rows, answer)

    def asked(table: pa.Table) -> pa.Table:
        gram, context_, least, batch, of_class, of_gram = decided(table)
        open_ = np.nonzero(~agreed(gram, of_class, of_gram))[0]
        rows, bucket = [], table["bucket"][0].as_py()
        for own in np.split(open_, np.nonzero(np.diff(of_class[open_]))[0] + 1) if len(open_) else []:
            first = own[0]
            rows.append((int(batch[first]), bucket, int(gram[first].view(np.int64)), int(context_[first].view(np.int64)), int(least[first]), batch[own].tolist()))
        return _table(rows, ask)

    def told(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _table([], context)
        wanted = _key(right["gram"].to_numpy().view(np.uint64), right["context"].to_numpy().view(np.uint64))
        order = np.argsort(wanted)
        wanted, leads, trails = wanted[order], [None] * len(order), [None] * len(order)
        for _, part in _chunks(_texts(left[text_col])):
            found, data = Anchors(part, size), b"".join(part)
            for anchor, at in zip(*(x.tolist() for x in _lookup(wanted, _key(found.gram, found.context)))):
                row = order[at]
                if leads[row] is None:
                    start = int(found.at[anchor])
                    leads[row], trails[row] = data[found.low[anchor] : start], data[start + GRAM : found.high[anchor]]
        out = [right[n] for n in ("bucket", "gram", "context", "least", "batches")]
        return pa.Table.from_arrays([*out, pa.array(leads, pa.binary()), pa.array(trails, pa.binary())], schema=context)

    def compared(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["gram"], r["context"]))
        by: dict[int, list[tuple]] = {}

        def say(row: dict, left: int, right: int, least: int) -> None:
            for batch in set(row["batches"]):
                by.setdefault(batch, []).append((row["gram"], row["context"], left, right, least))

        at = 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end]["gram"] == rows[at]["gram"]:
                end += 1
            own = rows[at:end]
            for row in own:
                say(row, reach, reach, row["least"])
            for left, right, members in maximal_repeats([r["lead"] for r in own], [r["trail"] for r in own], reach):
                least = min(own[m]["least"] for m in members)
                for m in members:
                    if own[m]["least"] > least:  # else its whole context is answered for already
                        say(own[m], left, right, least)
            at = end
        out = []
        for batch, said in by.items():
            gram, context_, left, right, least = map(np.array, zip(*said))
            span = np.stack([left, right], axis=1).astype(np.uint8)
            out.append((batch, gram.astype(np.int64).tobytes(), context_.astype(np.int64).tobytes(), span.tobytes(), least.astype(np.int64).tobytes()))
        return _table(out, answer)

    def cleaned(left: pa.Table, right: pa.Table) -> pa.Table:
        gram, context_ = _blobs(right, "gram", np.uint64), _blobs(right, "context", np.uint64)
        span, least = _blobs(right, "span", np.uint8).reshape(-1, 2).astype(np.int64), _blobs(right, "least", np.int64)
        keys = _key(gram, context_)
        order = np.argsort(keys, kind="stable")
        keys, span, least = keys[order], span[order], least[order]
        ids, kept, sizes, removed, spans = _ids(left[id_col]), [], [], [], []
        for first, part in _chunks(_texts(left[text_col])):
            found = Anchors(part, size)
            edge = np.zeros(len(found.data) + 1, np.int64)
            anchors, at = _lookup(keys, _key(found.gram, found.context))
            owner = ids[first + found.doc[anchors]]
            while len(anchors):  # an anchor may have several answers
                hit = least[at] < owner
                a = anchors[hit]
                low = np.maximum(found.at[a] - span[at[hit], 0], found.low[a])
                high = np.minimum(found.at[a] + GRAM + span[at[hit], 1], found.high[a])
                np.add.at(edge, low, 1)
                np.add.at(edge, high, -1)
                more = at + 1 < len(keys)
                more[more] = keys[at[more] + 1] == keys[at[more]]
                anchors, at, owner = anchors[more], at[more] + 1, owner[more]
            gone = np.cumsum(edge[:-1]) > 0
            for end, length in zip(found.ends.tolist(), found.lengths.tolist()):
                own = gone[end - length : end]
                count = int(own.sum())
                kept.append(found.data[end - length : end][~own].tobytes() if count else part[len(kept) - first])
                sizes.append(length)
                removed.append(count)
                spans.append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if count else 0)
        whole = pa.array([x.decode("utf-8", "ignore") for x in kept]) if as_text else pa.array(kept, pa.binary())
        columns = [whole, *(pa.array(x, pa.int64()) for x in (sizes, removed, spans))]
        made = pa.StructArray.from_arrays(columns, ["kept", "n_bytes", "n_removed", "n_spans"])
        return left.drop_columns([batch_col]).append_column(result, made)

    messages = by_batch.applyInArrow(listed, _BLOB).groupBy("bucket")
    at_once = messages.applyInArrow(settled, _ANSWER)
    contexts = by_batch.cogroup(messages.applyInArrow(asked, _ASK).groupBy("batch")).applyInArrow(told, _CONTEXT)
    answers = at_once.unionByName(contexts.groupBy("bucket").applyInArrow(compared, _ANSWER))
    inner = T.StructType([T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans"))])
    shape = T.StructType([*docs.schema.fields, T.StructField(result, inner)])
    return by_batch.cogroup(answers.groupBy("batch")).applyInArrow(cleaned, shape)


def without_repeats(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes taken out of their texts, and all columns as they were.

    Characters that a cut would split go whole. Texts may become empty; no row is dropped.
    """
    name = fresh(docs, "repeats")
    cut = remove_repeats(docs, size, id_col, text_col, name, as_text=True)
    clean = F.when(F.col(f"{name}.n_removed") > 0, F.col(f"{name}.kept")).otherwise(F.col(text_col))
    return cut.withColumn(text_col, clean).select(*docs.columns)
