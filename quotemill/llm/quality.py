"""Quality classifier from weak labels: expectation-maximisation over heuristic votes, then a hashed linear scorer."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import DIGEST, identified, keep_documents
from quotemill.session import stored

# Common words of four languages.
COMMON = frozenset(
    b"a and are as at be by for from in is it of on or that the this to was with "
    b"au avec ce dans de des du elle en est et il la le les leur par pas pour que qui se sur un une "
    b"aber auch auf das dem den der des die ein eine es f\xc3\xbcr ich ist mit nicht sich sie und von zu "
    b"al como con de del el en es la las lo los no para por que se su un una y".split()
)
#: Labellers that look for a fault, with the measure above which they vote BAD; then all, in the order of their votes.
FAULTS = (("symbols", 0.06), ("capitals", 0.5), ("repeats", 0.3), ("digits", 0.3), ("long_words", 0.3), ("shouts", 0.4))
LABELLERS = (*(name for name, _ in FAULTS), "common", "kinds")
GOOD, ABSTAIN, BAD = 1, 0, -1
BINS = 1 << 14

_LETTERS_ETC = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or b in b" \t\n\r\x0b\x0c")
_SENTENCE = b".,;:?'\"()-"
_SHAPES = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))


def _without(data: bytes, those: bytes) -> int:
    return len(data) - len(data.translate(None, those))


def examine(text: str | None, bins: int = BINS) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Votes of the labellers on a whole text, and its hashed features (bins and values of unit length).

    The labellers overlap on purpose. Those that look for a fault vote BAD or abstain; the last two
    look for running text and may vote GOOD. Features are the word shapes (letters, capitals and
    digits as classes, marks as they are) with the square roots of their shares, and the steps of the
    measures. A text without a word has no votes and no features.
    """
    data = text.encode() if text else b""
    lowered = data.lower().split()
    if not lowered:
        return [ABSTAIN] * len(LABELLERS), np.empty(0, np.int64), np.empty(0)
    size, count = len(data), len(lowered)
    plain = len(data.translate(None, _LETTERS_ETC))
    upper, lower = _without(data, _UPPER), _without(data, _LOWER)
    measures = {
        "symbols": (plain - _without(data, _SENTENCE)) / size,
        "capitals": upper / (upper + lower + 1),
        "repeats": sum(map(eq, lowered, islice(lowered, 1, None))) / count,
        "digits": _without(data, _DIGITS) / size,
        "long_words": size / count / 100,
        "shouts": max(data.count(b"!"), data.count(b"|")) / count,
        "common": sum(map(COMMON.__contains__, lowered)) / count,
        "kinds": min(1.0, len(set(lowered)) / count**0.75),
    }
    said = [BAD if measures[name] > bound else ABSTAIN for name, bound in FAULTS]
    said += [
        GOOD if measures[name] > high else BAD if measures[name] < low and count >= 20 else ABSTAIN
        for name, low, high in (("common", 0.02, 0.15), ("kinds", 0.25, 0.7))
    ]
    shapes = Counter(data.translate(_SHAPES).split())
    at = [zlib.crc32(shape) % bins for shape in shapes]
    value = [math.sqrt(n / count) for n in shapes.values()]
    for name, measure in measures.items():
        at.append(zlib.crc32(b"%s:%d" % (name.encode(), int(measure * 20))) % bins)
        value.append(0.5)
    values = np.array(value)
    return said, np.array(at, np.int64), values / np.sqrt((values**2).sum())


def fit_votes(patterns: np.ndarray, weights: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Prior and accuracies of the labellers by expectation-maximisation over counted vote patterns.

    Accuracies: P(vote | class), shape (labellers, class bad/good, vote bad/abstain/good). The start
    takes a BAD vote on a good text to be rare and each labeller to miss most faults, which fixes
    which class is the good one and lets a fault that a single labeller sees count.
    """
    kinds = patterns + 1
    labellers = patterns.shape[1]
    accuracy = np.tile(np.array([[0.35, 0.45, 0.2], [0.005, 0.495, 0.5]]), (labellers, 1, 1))
    prior = 0.5
    for _ in range(rounds):
        good = posterior(patterns, prior, accuracy)
        new = np.empty_like(accuracy)
        for j in range(labellers):
            for c, mass in enumerate((weights * (1 - good), weights * good)):
                new[j, c] = np.bincount(kinds[:, j], mass, 3) + 1.0
                new[j, c] /= new[j, c].sum()
        moved, accuracy = np.abs(new - accuracy).max(), new
        prior = float(np.clip((weights * good).sum() / weights.sum(), 0.01, 0.99))
        if moved < 1e-7:
            break
    return prior, accuracy


def posterior(patterns: np.ndarray, prior: float, accuracy: np.ndarray) -> np.ndarray:
    """P(good | votes) of each pattern."""
    log = np.log(accuracy)
    kinds = patterns + 1
    at = np.arange(patterns.shape[1])
    bad = np.log(1 - prior) + log[at, 0, kinds].sum(axis=1)
    good = np.log(prior) + log[at, 1, kinds].sum(axis=1)
    return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bins: int = BINS, epochs: int = 12, rate: float = 2.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic weights on soft labels by AdaGrad over a bounded sample, in a fixed order."""
    weights, bias = np.zeros(bins), 0.0
    squares, bias_square = np.full(bins, 1e-2), 1e-2
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value = rows[i]
            miss = 1 / (1 + np.exp(-np.clip(weights[at] @ value + bias, -30, 30))) - labels[i]
            step = miss * value + decay * weights[at]
            squares[at] += step**2
            weights[at] -= 0.3 * rate * step / np.sqrt(squares[at])
            bias_square += miss**2
            bias -= 0.1 * rate * miss / np.sqrt(bias_square)
    return weights, bias


def score_quality(docs: DataFrame, sample: int = 4000, threshold: float = 0.5, bins: int = BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, digest, votes, posterior, score, keep.

    Every labeller votes on every whole text. The accuracies are fitted on the counts of all vote
    patterns, of which there are 3^8 at most. The linear scorer is trained on the posteriors of a
    bounded sample, about ``sample`` texts with the smallest hashes (twice as many at most), and scores every row; ``keep``:
    its score reaches ``threshold``.

    Rows without a word have no votes and no features: they get the bare prior, score 0 and are not
    kept. Equal texts get equal results whatever their ids; an empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"v{i}" for i in range(len(LABELLERS))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [examine(t.as_py(), bins) for t in batch["text"]]
            said = np.array([m[0] for m in made], np.int32).reshape(-1, len(names))
            at = pa.array([m[1] for m in made], pa.list_(pa.int32()))
            value = pa.array([m[2].astype(np.float32) for m in made], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch[DIGEST], *(pa.array(c) for c in said.T), at, value], ["doc_id", DIGEST, *names, "at", "value"])

    shape = f"doc_id {kind}, {DIGEST} long, " + ", ".join(f"{n} int" for n in names) + ", at array<int>, value array<float>"
    rows = stored(identified(docs, id_col, text_col).mapInArrow(scan, shape), "examined")
    # one row a pattern, in an order of its own: sums don't depend on partitions
    counted = rows.groupBy(*names).count().toPandas().sort_values(names)
    patterns, weight = counted[names].to_numpy(int).reshape(-1, len(names)), counted["count"].to_numpy(float)
    told = (patterns != ABSTAIN).any(axis=1)
    prior, accuracy = fit_votes(patterns[told], weight[told]) if told.any() else (0.5, np.full((len(names), 2, 3), 1 / 3))

    # digests are spread evenly: those below a bound are about as many as asked for, copies included
    share = min(1.0, sample / max(weight.sum(), 1))
    some = rows.where(F.col(DIGEST) <= min(int(-(2**63) + share * 2**64), 2**63 - 1)).dropDuplicates([DIGEST])
    drawn = some.drop("doc_id").orderBy(DIGEST).limit(2 * sample).toPandas()
    weights, bias = np.zeros(bins), 0.0
    if len(drawn):
        soft = posterior(drawn[names].to_numpy(int), prior, accuracy)
        weights, bias = fit_scorer([(np.asarray(at), np.asarray(value)) for at, value in zip(drawn["at"], drawn["value"])], soft, bins)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = np.stack([batch[n].to_numpy() for n in names], axis=1).astype(int)
            found = np.zeros(len(said))
            for i, (at, value) in enumerate(zip(batch["at"], batch["value"])):
                if len(at):
                    found[i] = 1 / (1 + np.exp(-np.clip(weights[at.values.to_numpy()] @ value.values.to_numpy() + bias, -30, 30)))
            columns = [pa.array(said.tolist(), pa.list_(pa.int32())), pa.array(posterior(said, prior, accuracy)), pa.array(found), pa.array(found >= threshold)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch[DIGEST], *columns], ["doc_id", DIGEST, "votes", "posterior", "score", "keep"])

    return rows.mapInArrow(score, f"doc_id {kind}, {DIGEST} long, votes array<int>, posterior double, score double, keep boolean")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` less the rows that the scorer rejects."""
    scored = score_quality(docs, id_col=id_col, text_col=text_col, **options)
    return keep_documents(docs, stored(scored.where("keep").select("doc_id", DIGEST), "good-documents"), id_col, text_col)
