"""Phrase collocations per language, by best-first branch and bound over prefix counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.session import scratch, stored

SCALE = 1_000_000
#: Bits of a membership filter: 4 MB, whatever the corpus. More members only let more through to the exact join.
BITS = 1 << 25
#: Tokens of a stored block, and of the blocks that a task counts together.
BLOCK, TOGETHER = 1 << 19, 1 << 20
#: Rows that a task hands over at once.
SLICE = 1 << 16
UNKNOWN = "und"

_BREAK = b"."
_TABLE = bytes(
    ord(_BREAK) if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


def word_hash(word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(word, seed)


# --- texts as blocks of numbered words ----------------------------------------------------------


class _Numbers(dict):
    """Words in the order of their first use; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def coded(docs: DataFrame, seed: int, hasher: Callable[[bytes, int], int], text_col: str, lang_col: str) -> DataFrame:
    """Blocks of whole texts of one language: their words, the words' hashes and counts, and the texts as word numbers."""

    def block(lang: str, numbers: _Numbers, parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate(parts)
        words = list(numbers)[1:]
        name = lang.encode()
        mark = b"%d:%s" % (len(name), name)  # one word of two languages is two
        hashes = np.array([hasher(mark + w, seed) for w in words], np.uint64).view(np.int64)
        counts = np.bincount(tokens, minlength=len(numbers))[1:]
        columns = [pa.array(words, pa.binary()).cast(pa.string()), pa.array(hashes), pa.array(counts, pa.int64()), pa.array(tokens)]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang])] + [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns],
            ["lang", "words", "hashes", "counts", "tokens"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        total = 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                words = (text.as_py() or "").encode().translate(_TABLE).replace(_BREAK, b" . ").split()
                numbers, parts = held.setdefault(lang, (_Numbers(), []))
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                parts.append(np.zeros(1, np.int32))
                total += len(words) + 1
                if total >= BLOCK:
                    for name, (numbers, parts) in held.items():
                        yield block(name, numbers, parts)
                    held, total = {}, 0
        for name, (numbers, parts) in held.items():
            yield block(name, numbers, parts)

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, "lang string, words array<string>, hashes array<long>, counts array<long>, tokens array<int>")


def _stored_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks are large rows: small row groups bound how many a reader holds at once."""
    path = scratch(blocks.sparkSession, "phrase-blocks")
    blocks.write.option("parquet.block.size", 16 << 20).parquet(path)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path)


# --- filters of a fixed size --------------------------------------------------------------------


def _pair_key(a, b):
    """One number of two hashes, as columns or arrays."""
    if isinstance(a, Column):
        return a.bitwiseXOR(F.shiftleft(b, 21).bitwiseOR(F.shiftrightunsigned(b, 43)))
    return a ^ (b << np.uint64(21) | b >> np.uint64(43))


def _filter(members: DataFrame, key: Column) -> np.ndarray:
    """A bit for every member's key; the driver gets one row for 64 bits at most."""
    at = key.bitwiseAND(BITS - 1)
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    rows = members.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _in(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


# --- counting -----------------------------------------------------------------------------------


def _merged(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and tokens of several blocks under one numbering; 0 stays the end of a piece."""
    known, places = np.unique(np.concatenate([h for h, _ in rows]), return_inverse=True)
    out, at = [], 0
    for hashes, tokens in rows:
        own = np.concatenate([[0], places[at : at + len(hashes)] + 1]).astype(np.int32)
        out.append(own[tokens])
        at += len(hashes)
    return np.concatenate([np.zeros(1, np.uint64), known]), np.concatenate(out)


def _counted(blocks: DataFrame, size: int, pick: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(h1 .. h``size``, a): how often each run of ``size`` words occurs whose start ``pick`` chooses."""
    names = [f"h{i + 1}" for i in range(size)]

    def tally(rows: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        hashes, tokens = _merged(rows)
        starts = np.nonzero(pick(hashes, tokens))[0]
        if len(hashes) ** size < 2**63:
            key = tokens[starts].astype(np.int64)
            for i in range(1, size):
                key = key * len(hashes) + tokens[starts + i]
            _, first, n = np.unique(key, return_index=True, return_counts=True)
        else:
            _, first, n = np.unique(np.stack([tokens[starts + i] for i in range(size)]), axis=1, return_index=True, return_counts=True)
        starts = starts[first]
        for at in range(0, len(n), SLICE):
            here = starts[at : at + SLICE]
            columns = [pa.array(hashes[tokens[here + i]].view(np.int64)) for i in range(size)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n[at : at + SLICE], pa.int64())], [*names, "a"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0
        for batch in batches:
            for hashes, tokens in zip(batch["hashes"], batch["tokens"]):
                row = (hashes.values.to_numpy().view(np.uint64), tokens.values.to_numpy())
                if held and total + len(row[1]) > TOGETHER:
                    yield from tally(held)
                    held, total = [], 0
                held.append(row)
                total += len(row[1])
        if held:
            yield from tally(held)

    found = blocks.select("hashes", "tokens").mapInArrow(scan, ", ".join(f"{n} long" for n in [*names, "a"]))
    return found.groupBy(*names).agg(F.sum("a").alias("a"))


def _runs(tokens: np.ndarray, size: int) -> np.ndarray:
    """Whether a run of ``size`` words of one piece starts at each token."""
    out = tokens != 0
    for i in range(1, size):
        out[: len(tokens) - i] &= tokens[i:] != 0
        out[max(0, len(tokens) - i) :] = False
    return out


def _ratio(a: str, top: str, low: str) -> Column:
    """floor(SCALE * a * top / low) in exact arithmetic; ``low`` may be a product."""
    dec = lambda x: " * ".join(f"cast({y.strip()} as decimal(18,0))" for y in x.split("*"))
    return F.expr(f"(cast({SCALE} as decimal(7,0)) * {dec(a)} * {dec(top)}) div ({dec(low)})")


# --- the search ---------------------------------------------------------------------------------


def collocations(
    docs: DataFrame,
    top: int = 2000,
    least: int = 10,
    margin: float = 0.5,
    text_col: str = "text",
    lang_col: str = "lang",
    hasher: Callable[[bytes, int], int] = word_hash,
) -> DataFrame:
    """The ``top`` phrases of 2 or 3 words per language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lowered; texts are split at ``[.,;:!?\\n\\v\\f\\r]`` into pieces and those at blanks and
    tabs into words. a: occurrences of the phrase (``least`` or more); l and r: those of the parts of
    its lowest-scoring cut (ties: the first); n: all words of the language; score: floor(10^6 a a / (l r)).
    A phrase is dropped if a longer candidate around it occurs at least half as often. Order: score,
    then a, descending, then phrase by bytes.

    Search: a pair (u, v) is a prefix whose extensions score at most floor(10^6 f(uv) / f(u)), because
    a phrase occurs no more often than its prefix or its last two words. The prefixes with the best
    bounds are expanded first, all of a round in one pass over the texts; each round settles anew
    the ``top``-th surviving score of each language. The search ends when no prefix that isn't
    expanded reaches that score, and none could still drop a pair that reaches it. A round takes
    prefixes down to ``margin`` times the score, which saves passes and changes no result.

    A word of a language is known by a 64-bit hash, under a seed for which no frequent one shares its hash. Filters
    sent to the tasks have a fixed size; what they let through too much is dropped by exact joins.

    A null language is ``und``, a null text is empty. Repeated rows count each time. Languages with
    fewer phrases give all of them; an empty table gives none.
    """
    # whole texts, cut into words once
    for seed in count():
        blocks = _stored_blocks(coded(docs, seed, hasher, text_col, lang_col))
        each = blocks.select("lang", F.explode(F.arrays_zip("words", "hashes", "counts")).alias("w"))
        words = stored(each.groupBy("lang", F.col("w.words").alias("word"), F.col("w.hashes").alias("h")).agg(F.sum("w.counts").alias("f")), "phrase-words")
        shared = words.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("f"))
        if shared.where((F.col("n") > 1) & (F.col("f") >= least)).isEmpty():
            break
    frequent = words.where(F.col("f") >= least)

    known_words = _filter(frequent, F.col("h"))

    def both_frequent(hashes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        ok = _in(known_words, hashes)
        ok[0] = False
        good = ok[tokens]
        return _runs(tokens, 2) & good & np.append(good[1:], False)

    count_of = lambda i, *more: frequent.select(*more, F.col("h").alias(f"h{i}"), F.col("f").alias(f"f{i}"))
    counted = _counted(blocks, 2, both_frequent).where(F.col("a") >= least)
    scored = counted.join(count_of(1, "lang"), "h1").join(count_of(2), "h2")
    scored = scored.withColumn("score", _ratio("a", "a", "f1 * f2")).withColumn("bound", _ratio("a", "1", "f1"))
    pairs = stored(scored.select("lang", "h1", "h2", "a", "f1", "f2", "score", "bound"), "phrase-pairs")
    known_pairs = _filter(pairs, _pair_key(F.col("h1"), F.col("h2")))

    expanded = triples = None
    while True:
        left, last = _survivors(pairs, triples, top)
        left = stored(left, "phrase-survivors")
        last = stored(last, "phrase-last-scores")
        open_ = pairs if expanded is None else pairs.join(expanded, ["h1", "h2"], "left_anti")
        if _to_expand(open_, left, last, 1.0).isEmpty():
            break
        now = stored(_to_expand(open_, left, last, margin), "phrase-prefixes")
        expanded = now if expanded is None else stored(expanded.unionByName(now), "phrase-expanded")
        found = _extended(blocks, now, known_pairs).where(F.col("a") >= least)
        found = found.join(now, ["h1", "h2"], "left_semi")
        first = pairs.select("lang", "h1", "h2", "f1", F.col("a").alias("f12"))
        second = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23"), F.col("f2").alias("f3"))
        found = found.join(first, ["h1", "h2"]).join(second, ["h2", "h3"])
        cuts = found.withColumn("cut1", _ratio("a", "a", "f1 * f23")).withColumn("cut2", _ratio("a", "a", "f12 * f3"))
        early = F.col("cut1") <= F.col("cut2")
        found = cuts.select(
            "lang", "h1", "h2", "h3", "a",
            F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
            F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"),
            F.least("cut1", "cut2").alias("score"),
        )
        triples = stored(found if triples is None else triples.unionByName(found), "phrase-triples")

    reached = left.join(last, "lang").where(F.col("score") >= F.col("last"))
    for i in (1, 2, 3):
        word = frequent.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"))
        reached = reached.join(word, f"h{i}", "left")
    named = reached.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    # any number of phrases may tie, so each of 256 parts gives its first ones before they meet
    best_first = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*best_first)
    first = named.withColumn("place", F.row_number().over(part)).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best_first))
    ranked = first.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).join(sizes, "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _survivors(pairs: DataFrame, triples: DataFrame | None, top: int) -> tuple[DataFrame, DataFrame]:
    """Known phrases that no known longer one drops, and per language the ``top``-th score (-1: fewer)."""
    plain = pairs.select("lang", "h1", "h2", F.lit(None).cast("long").alias("h3"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score")
    left = plain
    if triples is not None:
        inside = triples.select("h1", "h2", F.col("a").alias("longer")).unionByName(
            triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), F.col("a").alias("longer"))
        )
        most = inside.groupBy("h1", "h2").agg(F.max("longer").alias("longer"))
        kept = plain.join(most, ["h1", "h2"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * 50))
        left = kept.select(plain.columns).unionByName(triples.select(plain.columns))
    # scores are whole numbers up to SCALE, which bounds the rows a language sends to its window
    counts = left.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    reached = counts.withColumn("upto", upto).groupBy("lang").agg(F.max(F.when(F.col("upto") >= top, F.col("score"))).alias("last"))
    return left, reached.select("lang", F.coalesce("last", F.lit(-1)).alias("last"))


def _to_expand(open_: DataFrame, left: DataFrame, last: DataFrame, margin: float) -> DataFrame:
    """Prefixes whose extensions could reach the last score, or drop a pair that reaches it."""
    limit = F.when(F.col("last") > 0, F.floor(F.col("last") * margin)).otherwise(F.col("last"))
    goal = last.select("lang", limit.alias("goal"))
    reach = left.where("h3 IS NULL").join(goal, "lang").where(F.col("score") >= F.col("goal"))
    # (x, u) could be extended to a phrase around the pair (u, v)
    around = reach.groupBy(F.col("h1").alias("h2")).agg(F.min("a").alias("lowest"))
    own = reach.select("h1", "h2", F.lit(True).alias("own"))
    rows = open_.join(goal, "lang").join(around, "h2", "left").join(own, ["h1", "h2"], "left")
    wanted = (F.col("bound") >= F.col("goal")) | F.col("own") | (F.col("a") * 100 >= F.col("lowest") * 50)
    return rows.where(wanted).select("h1", "h2")


def _extended(blocks: DataFrame, prefixes: DataFrame, known_pairs: np.ndarray) -> DataFrame:
    """Counts of all runs of three words that begin with one of ``prefixes`` and end with a known pair."""
    chosen = _filter(prefixes, _pair_key(F.col("h1"), F.col("h2")))

    def picked(hashes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        of = hashes[tokens]
        key = _pair_key(of[:-1], of[1:])
        starts = np.append(_in(chosen, key), False)
        ends = np.append(_in(known_pairs, key), False)
        return _runs(tokens, 3) & starts & np.append(ends[1:], False)

    return _counted(blocks, 3, picked)
