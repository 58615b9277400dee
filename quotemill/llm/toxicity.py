"""Toxicity grades by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import DIGEST, identified
from quotemill.llm.words import ascii_words
from quotemill.session import stored

BINS = 1 << 20
#: Share of toxic-marked words from which a toxic text has the grades 2 and 3.
STEPS = (0.01, 0.03)
#: A word has a weight if this share of the sample's texts hold it, and if it tells toxic texts from
#: others: twice the log-likelihood ratio of its counts, which chance alone brings over 15 once in 10,000 words.
LEAST_SHARE, LEAST_EVIDENCE = 0.004, 15.0


def word_bins(text: str | None, bins: int = BINS) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashed words of a whole text, their counts, and the number of words."""
    counts = Counter(ascii_words(text))
    at = np.fromiter((zlib.crc32(w) % bins for w in counts), np.int64, len(counts))
    return at, np.fromiter(counts.values(), np.int64, len(counts)), sum(counts.values())


def damped(counts: np.ndarray) -> np.ndarray:
    """Feature values: a word counts by 1 + log of its count, however long the text around it is."""
    return 1 + np.log(counts)


class CumulativeLink:
    """P(grade > j) = sigmoid(w.x - cut[j]): one weight vector under ordered thresholds."""

    def __init__(self, at: np.ndarray, grades: int):
        self.at = at  # bins that have a weight, sorted
        self.weights = np.zeros(len(at))
        self.cuts = np.arange(grades - 1, dtype=float) + 1.0

    def place(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the bins' weights are, and which bins have one."""
        where = np.searchsorted(self.at, bins)
        known = np.zeros(len(bins), bool)
        inside = where < len(self.at)
        known[inside] = self.at[where[inside]] == bins[inside]
        return where[known], known

    def above(self, score: float | np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.asarray(score)[..., None] - self.cuts, -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, rounds: int = 400, rate: float = 0.1, decay: float = 1e-3) -> None:
        """Adam on the mean log-likelihood of all rows; cuts are a first one and positive gaps.

        With F(j) = P(grade > j), the likelihood of grade g is F(g - 1) - F(g).
        """
        index = np.concatenate([at for at, _ in rows])
        value = np.concatenate([v for _, v in rows])
        row = np.repeat(np.arange(len(rows)), [len(at) for at, _ in rows])
        levels, bins = len(self.cuts), len(self.at)
        theta = np.concatenate([self.weights, [self.cuts[0]], np.log(np.diff(self.cuts))])
        mean, spread = np.zeros_like(theta), np.zeros_like(theta)
        everyone = np.arange(len(rows))
        for turn in range(1, rounds + 1):
            self.weights = theta[:bins]
            self.cuts = np.cumsum(np.concatenate([theta[bins : bins + 1], np.exp(theta[bins + 1 :])]))
            above = self.above(np.bincount(row, self.weights[index] * value, len(rows)))
            edges = np.hstack([np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))])
            slopes = edges * (1 - edges)
            likelihood = np.maximum(edges[everyone, grades] - edges[everyone, grades + 1], 1e-12)
            over, under = slopes[everyone, grades] / likelihood, slopes[everyone, grades + 1] / likelihood
            pull = (over - under) / len(rows)
            of_cut = np.bincount(grades, over, levels + 1)[1:] - np.bincount(grades, under, levels + 1)[:levels]
            of_cut /= len(rows)
            later = np.cumsum(of_cut[::-1])[::-1]
            slope = np.concatenate([decay * self.weights - np.bincount(index, pull[row] * value, bins), later[:1], later[1:] * np.exp(theta[bins + 1 :])])
            mean = 0.9 * mean + 0.1 * slope
            spread = 0.999 * spread + 0.001 * slope**2
            theta = theta - rate * mean / (1 - 0.9**turn) / (np.sqrt(spread / (1 - 0.999**turn)) + 1e-8)

    def expected(self, score: np.ndarray) -> np.ndarray:
        """Expected grade: the sum of P(grade > j)."""
        return self.above(score).sum(axis=-1)


def telling_words(held: np.ndarray, toxic: np.ndarray, texts: int, bad_texts: int) -> np.ndarray:
    """Which bins tell toxic texts from others; held, toxic: how many (toxic) texts of the sample hold each bin."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / expected), 0.0)

    base = bad_texts / texts
    evidence = 2 * (part(toxic, held * base) + part(held - toxic, held * (1 - base)))
    return (held >= LEAST_SHARE * texts) & (evidence >= LEAST_EVIDENCE) & (toxic > 0.5 * held)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 8000,
    bins: int = BINS,
    threshold: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: doc_id, score, expected_severity (0 to 3), grade, toxic.

    ``labels`` (doc_id, toxic 0/1) say which texts are toxic, not how much. Grades for training: 0 not
    toxic; else 1, 2 or 3 by the share of words that nearly only toxic texts hold (``STEPS``). A
    cumulative-link model with one weight for each hashed word that tells the two apart is fitted on
    a bounded sample of labelled texts, the ``sample`` / 2 of either label with the smallest hashes. It scores all words
    of every text; ``toxic``: P(grade > 0) exceeds ``threshold`` (by default the share of toxic texts in
    the sample); ``grade``: the rounded expectation.

    Labels that are null, or of no text, are not used; of several labels of an id the largest holds.
    Without any toxic label the model is empty and all texts get severity 0; if all labels are toxic,
    all texts get severity 1, grade 1 and are toxic. Empty texts get severity 0. Equal texts get equal results; an empty table gives none.
    """
    rows = identified(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    # ids and hashes only; texts are read again for those that are drawn
    keyed = rows.select("doc_id", DIGEST).join(known, F.col("doc_id") == F.col("label_id")).groupBy(DIGEST).agg(F.max("toxic").alias("toxic"))
    keyed = stored(keyed, "labelled-hashes")
    first = [keyed.where(side).orderBy(DIGEST).limit(sample // 2) for side in ("toxic > 0", "toxic <= 0")]
    drawn = stored(first[0].unionByName(first[1]).select(F.col(DIGEST).alias("drawn"), F.sign("toxic").cast("int").alias("toxic")), "drawn-labels")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [word_bins(t.as_py(), bins) for t in batch["text"]]
            columns = [pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array([m[2] for m in made], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch[DIGEST], batch["toxic"], *columns], [DIGEST, "toxic", "at", "n", "words"])

    # as many rows as the sample has: the bound of the broadcast
    chosen = rows.join(F.broadcast(drawn), F.col(DIGEST) == F.col("drawn")).select(DIGEST, "text", "toxic")
    texts = stored(chosen.mapInArrow(read, f"{DIGEST} long, toxic int, at array<long>, n array<long>, words long").dropDuplicates([DIGEST]), "labelled-texts")
    by_bin = texts.select("toxic", F.explode("at").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("held"), F.sum("toxic").alias("bad"))
    held = by_bin.toPandas()  # as many as the sample has words, and bins at most
    fitted = texts.orderBy(DIGEST).limit(sample).toPandas()
    at_of, n_of = ([np.asarray(x) for x in fitted[c]] for c in ("at", "n"))
    bad_texts = int(fitted["toxic"].sum()) if len(fitted) else 0
    limit = bad_texts / max(len(fitted), 1) if threshold is None else threshold
    model = CumulativeLink(np.empty(0, np.int64), len(STEPS) + 2)
    if 0 < bad_texts < len(fitted):
        tells = telling_words(held["held"].to_numpy(float), held["bad"].to_numpy(float), len(fitted), bad_texts)
        of_toxic = tells & (held["bad"] > 0.9 * held["held"]).to_numpy()
        model = CumulativeLink(np.sort(held["bin"].to_numpy()[tells]), len(STEPS) + 2)
        marks = np.sort(held["bin"].to_numpy()[of_toxic])
        marked = np.array([n[np.isin(at, marks)].sum() / max(1, words) for at, n, words in zip(at_of, n_of, fitted["words"])])
        grades = np.where(fitted["toxic"] > 0, 1 + np.searchsorted(np.array(STEPS), marked, side="right"), 0)
        placed = ((model.place(at), n) for at, n in zip(at_of, n_of))
        model.fit([(where, damped(n[has])) for (where, has), n in placed], grades)
    else:
        # one label only: nothing to tell apart, so all texts have that label's lowest grade
        model.cuts += 30
        limit = 1.0
        if bad_texts:
            model.cuts[0], limit = -30.0, 0.5

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {int(b): float(w) for b, w in zip(model.at, model.weights)}
        for batch in batches:
            found = np.zeros(len(batch["text"]))
            for i, text in enumerate(batch["text"]):
                counts = Counter(ascii_words(text.as_py()))
                found[i] = sum(own.get(zlib.crc32(w) % bins, 0.0) * (1 + np.log(n) if n > 1 else 1.0) for w, n in counts.items())
            empty = np.array([not t.as_py() for t in batch["text"]], bool)
            expected = np.where(empty, 0.0, model.expected(found))
            toxic = ~empty & (model.above(found)[:, 0] > limit)
            grade = np.rint(expected).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found), pa.array(expected), pa.array(grade), pa.array(toxic)], ["doc_id", "score", "expected_severity", "grade", "toxic"])

    return rows.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double, expected_severity double, grade int, toxic boolean")
