"""Repeated rows, one-sided labels, long word shapes and vectors of other lengths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.llm import neighbours, quality, simhash, toxicity

TEXT = "the quick brown fox jumps over the lazy dog"
DOC = "doc_id long, text string"


def test_one_of_each_keeps_one_of_repeated_rows(spark):
    rows = [(1, TEXT)] * 4 + [(2, TEXT), (None, "quite another text with words of its own"), (None, "a third text"), (None, "a third text"), (5, "b"), (5, "c d e f g")]
    docs = spark.createDataFrame([(*r, i, 0) for i, r in enumerate(rows)], DOC + ", component int, n int").repartition(3)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, TEXT), (0, rows[5][1]), (0, "a third text"), (5, "b"), (5, "c d e f g")])


def test_only_toxic_labels(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(30)] + [(99, None)], DOC)
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    got = {r.doc_id: (r.grade, r.toxic) for r in toxicity.score_toxicity(docs, labels).collect()}
    assert got == {**{i: (1, True) for i in range(30)}, 99: (0, False)}
    none = toxicity.score_toxicity(docs, labels.withColumn("toxic", F.lit(0)))
    assert none.where("toxic OR grade <> 0 OR expected_severity > 1e-6").count() == 0


def test_repeated_labels_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "bad"), (1, "bad bad"), (1, "bad bad"), (2, "good"), (2, "other")], DOC)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (7, 1)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == 5 and len({(r.score, r.grade) for r in rows if r.doc_id == 1}) == 1


def test_whole_word_shapes_count():
    one, other = (quality.examine("a" * 30 + end)[1].tolist() for end in ("1", "A"))
    assert one[0] != other[0]


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"{TEXT} number {i} " * (i % 9) + "!!! ###" * (i % 4)) for i in range(200)], DOC)
    first, second = ({r.doc_id: (r.posterior, r.score) for r in quality.score_quality(docs.repartition(n)).collect()} for n in (2, 7))
    assert first == second


def test_queries_of_another_length(spark):
    vectors = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(100 + i, [1.0, 2.0, 3.0]) for i in range(5)] + [(200, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(vectors, queries, k=3).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(200, 1, 29), (200, 2, 28), (200, 3, 27)]


def _found(rows) -> dict:
    found = {}
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    return found


@pytest.mark.parametrize("options", [{}, {"rerank_per_root": 0.0}, {"rerank_per_root": 0.0, "rerank_share": 1.0}])
def test_recall_of_random_vectors(spark, options):
    """20,000 vectors without any structure, with either bound on what is compared; all of it compared is exact."""
    vectors = np.random.default_rng(1).normal(size=(20_000, 64))
    frame = pd.DataFrame({"vec_id": np.arange(len(vectors)), "embedding": vectors.tolist()})
    table = spark.createDataFrame(frame, "vec_id long, embedding array<double>").repartition(4)
    found = _found(neighbours.nearest_neighbours(table, table.where("vec_id % 400 = 0"), **options).collect())
    assert sorted(found) == list(range(0, 20_000, 400)) and all(len(f) == 20 for f in found.values())
    hits = 0
    for query, near in found.items():
        score = vectors @ vectors[query]
        score[query] = -np.inf
        hits += len(near & set(np.argsort(-score)[:20].tolist()))
    recall = hits / (20 * len(found))
    print(options, "recall", recall)
    assert recall == 1.0 if options.get("rerank_share") == 1.0 else 0.9 <= recall < 1.0


def test_little_is_compared():
    """What the default share compares of a block, ties of the last distance included."""
    vectors = np.random.default_rng(2).normal(size=(8_192, 64))
    pivots = neighbours.Pivots(vectors[:400], float(np.sqrt((vectors**2).sum(axis=1).max())))
    near = [len(rows) for rows, _ in neighbours.search_block(vectors, vectors[:40], pivots, 64, round(0.09 * len(vectors)))]
    assert np.mean(near) < 0.1 * len(vectors)
    far = vectors[:9] @ pivots.points[:, :64].T
    assert (pivots._first(-far, 32) == np.argsort(-far, axis=1, kind="stable")[:, :32]).all()
