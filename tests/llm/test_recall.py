"""Recall of the inverted multi-index against brute force on tables that a query doesn't search whole."""

import numpy as np
import pytest

from tidecast.llm import multi_index


def table(spark, x):
    return spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)


@pytest.mark.parametrize("structured", [True, False])
def test_recall_at_the_registered_settings(spark, structured):
    rng = np.random.default_rng(structured)
    x = rng.normal(size=(12_000, 16))
    if structured:
        x = rng.normal(size=(60, 16))[rng.integers(0, 60, len(x))] * 3 + 0.3 * x
    queries = np.arange(0, len(x), 20)
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -np.inf
    want = np.argsort(-score, axis=1, kind="stable")[:, :20]
    got = {}
    for r in multi_index.search(table(spark, x)).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert set(got) == set(queries.tolist()) and all(len(g) == 20 for g in got.values())
    assert all(abs(s - x[q] @ x[v]) < 1e-9 for q, g in got.items() for v, s in g.items())
    caught = np.mean([v in got[q] for q, row in zip(queries.tolist(), want.tolist()) for v in row])
    assert caught >= 0.9, caught


def test_clustered_vectors_need_a_small_part(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 16))[rng.integers(0, 60, 6000)] * 3 + 0.3 * rng.normal(size=(6000, 16))
    books = multi_index.kmeans(x[:, :8], 38), multi_index.kmeans(x[:, 8:], 38)
    cell = multi_index.nearest(x[:, :8], books[0]) * len(books[1]) + multi_index.nearest(x[:, 8:], books[1])
    counts = dict(zip(*(a.tolist() for a in np.unique(cell, return_counts=True))))
    entries = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(cell, x)], "cell int, v array<double>")
    assert multi_index.reach(entries, x[:32], books, counts, 20, 0.96) < 0.2 * len(x)
    assert multi_index.reach(entries, x[:32], books, counts, 20, 1.0) <= len(x)


def test_search_ignores_other_columns_and_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist(), i, "c", [1]) for i in range(50)] + [(100, [1.0, 2.0], 0, "c", [1]), (None, [1.0] * 4, 0, "c", [1]), (40, rng.normal(size=4).tolist(), 0, "c", [1])]
    got = multi_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, cell string, ids array<int>")).collect()
    assert {r.query_id for r in got} == {0, 20, 40} and all(r.vec_id is not None and r.vec_id < 50 and r.vec_id != r.query_id for r in got)
