"""Pivot index against plain numpy: same rows, ties and all, with distances saved."""

import numpy as np
import pytest

from helpers import rows
from rxlake.operators import pivots as P
from rxlake.operators import vectors as V


def brute(queries, docs, k):
    out = []
    for qid, q in queries:
        d = sorted((float(((np.asarray(v) - np.asarray(q)) ** 2).sum()), i) for i, v in docs)
        out += [(qid, r + 1, i) for r, (_, i) in enumerate(d[:k])]
    return sorted(out)


def clustered(n, dim, groups, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 10, (groups, dim))
    return [(int(i), (centres[i % groups] + rng.normal(0, 0.3, dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("part", [4096, 5])
def test_equals_full_scan(spark, monkeypatch, part):
    monkeypatch.setattr(P, "PART", part)
    docs = clustered(600, 6, 12, 1)
    queries = [(i, [x + 0.1 for x in v]) for i, v in docs[:40]]
    d = spark.createDataFrame(docs, "vec_id long, embedding array<double>").repartition(4)
    q = spark.createDataFrame(queries, "qid long, qvec array<double>")
    index = P.build_index(d, ring_rows=16)
    out = P.search(index, q, 3).checkpoint()
    assert sorted(rows(out, "qid", "rank", "doc_id")) == brute(queries, docs, 3)
    assert sorted(rows(out, "qid", "rank", "doc_id")) == sorted(rows(V.knn_topk(q, d, 3), "qid", "rank", "doc_id"))
    share = np.mean([c for _, c in set(rows(out, "qid", "compared"))]) / index.rows
    assert share < 0.3                              # the rest was never compared


def test_copies_and_ties(spark):
    """One vector held by a third of the rows; string ids; the stored index opened again."""
    docs = [(f"k{i:03d}", [1.0, 1.0] if i % 3 == 0 else [float(i % 7), float(i % 5)]) for i in range(300)]
    queries = [(1, [1.0, 1.0]), (2, [3.0, 2.0]), (3, [100.0, -100.0])]
    d = spark.createDataFrame(docs, "vec_id string, embedding array<float>")
    q = spark.createDataFrame([*queries, (4, None)], "qid long, qvec array<double>")
    path = f"{P.ensure_checkpoint_dir(spark)}/pivot-test"
    P.build_index(d, path, ring_rows=20)
    index = P.open_index(spark, path)
    assert index.bounds["n"].max() <= 20 and index.rows == 300
    assert sorted(rows(P.search(index, q, 5), "qid", "rank", "doc_id")) == brute(queries, docs, 5)


def test_fewer_rows_than_k_and_empty(spark):
    d = spark.createDataFrame([(1, [1.0]), (2, [4.0]), (3, None)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [0.0])], "qid long, qvec array<double>")
    assert sorted(rows(P.search(P.build_index(d), q, 3), "rank", "doc_id", "dist")) == [(1, 1, 1.0), (2, 2, 16.0)]
    assert P.search(P.build_index(d.where("false")), q, 3).count() == 0
    assert P.search(P.build_index(d), q.where("false"), 3).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, q, p = rng.normal(0, 1, (200, 8)), rng.normal(0, 1, (20, 8)), rng.normal(0, 1, (5, 8))
    dist = P._distance(x, p)
    near = dist.argmin(1)
    own = dist[np.arange(200), near]
    bounds = {"ring": np.arange(5), "pivot": np.arange(5), "n": np.bincount(near, minlength=5),
              "lo": np.array([own[near == i].min(initial=np.inf) for i in range(5)]),
              "hi": np.array([own[near == i].max(initial=0) for i in range(5)])}
    low = P._lower_bounds(q, p, bounds)
    real = P._distance(q, x)
    for i in range(5):
        if (near == i).any():
            assert (low[:, i] <= real[:, near == i].min(1)).all()
