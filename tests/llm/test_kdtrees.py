import math
import random

import numpy as np
import pytest
from llm_helpers import SF001
from pyspark.sql import functions as F

from rxlake.llm import intvec as V
from rxlake.llm import kdtrees as K

SCHEMA = "vec_id long, embedding array<double>, label int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale):
    return [math.floor(scale * x) for x in v]


def brute(rows, every, k, scale=1024):
    """[(query_id, rank, vec_id, score)] by plain loops; rows: (id, vector)."""
    good = [(i, r[0], whole(r[1], scale)) for i, r in enumerate(rows) if usable(r[1])]
    out = []
    for i, q, a in good:
        if q is None or q % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(a, b)), c is None, c or 0, j) for j, c, b in good if j != i)[:k]
        out += [(q, n + 1, None if null else c, -s) for n, (s, null, c, _) in enumerate(found)]
    return sorted(out, key=str)


def run(spark, rows, every=3, k=4, schema=SCHEMA):
    df = spark.createDataFrame([(*r, 1) for r in rows], schema).repartition(3)
    out = K.search(df, F.col("vec_id") % every == 0, k=k)
    return sorted([tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()], key=str)


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(K, "SHARD_VALUES", 100)
    monkeypatch.setattr(K, "LEAST_SHARD", 8)
    monkeypatch.setattr(K, "LEAF_ROWS", 3)


@pytest.mark.parametrize("block", [32 << 20, 400])
def test_equals_brute_force(spark, small_shards, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK_BYTES", block)            # one block, and many
    rnd = random.Random(block)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(5)]) for i in range(150)]
    assert run(spark, rows) == brute(rows, 3, 4)


def test_ties_copies_and_odd_rows(spark, small_shards):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([0.0, 0.5, -0.25]) for _ in range(2)]) for i in range(60)]
    rows += [(i, [0.5, 0.5]) for i in range(100, 160)]                  # one vector held by half the rows
    rows += [(3, [0.5, 0.5]), (3, [0.5, 0.5]), (None, [0.5, 0.5]), (None, [2.0, 2.0])]      # repeated and null ids
    rows += [(6, None), (9, [None, 1.0]), (12, [float("nan"), 1.0]), (15, [float("inf"), 0.0]), (18, []), (21, [1.0]),
             (24, [0.0, 0.0, 3.0])]                                     # unusable; shorter and longer vectors
    assert run(spark, rows, 3, 5) == brute(rows, 3, 5)


def test_few_rows_and_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, [1.0])]) == []                               # no other row
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == []                   # no query
    assert run(spark, [(3, [1.0]), (4, [2.0])]) == [(3, 1, 4, 2 << 20)]
    assert run(spark, [(3, None)]) == []


def test_products_beyond_doubles(spark, small_shards):
    rnd = random.Random(5)
    rows = [(i, [float(rnd.randrange(-10 ** 5, 10 ** 5)) + rnd.random() for _ in range(4)]) for i in range(80)]
    assert run(spark, rows) == brute(rows, 3, 4)
    assert any(abs(r[3]) >= 1 << 53 for r in run(spark, rows))
    huge = [(3, [1e300, 1.0]), (4, [1e300, -1.0]), (5, [-1e300, 0.0])]  # clipped: still ordered, and a long
    assert [r[:3] for r in run(spark, huge)] == [(3, 1, 4), (3, 2, 5)]


def test_clashing_columns(spark):
    rows = [(i, [float(i)], i, "x") for i in range(6)]
    df = spark.createDataFrame(rows, "key long, v array<double>, rank long, score string")
    out = K.search(df, F.col("key") == 5, k=2, vec_id="key", vec="v", scale=1)
    assert [tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").orderBy("rank").collect()] == [(5, 1, 4, 20), (5, 2, 3, 15)]


def test_tree_bounds_and_order():
    rnd = np.random.default_rng(2)
    x = rnd.integers(-50, 50, (500, 4)).astype(np.float64)
    ids = V.Ids(np.arange(500), np.arange(500), np.zeros(500, np.int8))
    tree = K.Tree.build(x, ids, 10)
    shape = V.Shape(500, 4, 1, 50)
    tree = K.Tree.unpack(tree.pack(shape), shape)
    assert sorted(tree.ids.row) == list(range(500)) and (x[tree.ids.row] == tree.x).all()
    for level, (lo, hi) in enumerate(tree.levels):
        for node in range(1 << level):
            step = (len(tree.starts) - 1) >> level
            own = tree.x[tree.starts[node * step]:tree.starts[(node + 1) * step]]
            assert (own.min(0) == lo[node]).all() and (own.max(0) == hi[node]).all()       # tight
    # a query along one axis needs few leaves: bounds prune
    q = np.array([[40.0, 0, 0, 0]])
    best = V.Best(1, 3, np.float64)
    done = tree.search(q, np.array([-1]), best, np.array([0]))
    _, score, *_ = best.result()
    assert done < 500 and list(score) == sorted((x @ q[0]), reverse=True)[:3]


def test_propagated_score_skips_trees():
    x = np.ones((64, 2))
    ids = V.Ids(np.arange(64), np.arange(64), np.zeros(64, np.int8))
    tree = K.Tree.build(x, ids, 8)
    best = V.Best(1, 2, np.float64, np.array([[5.0, 9.0]]))
    assert tree.search(np.array([[1.0, 1.0]]), np.array([-1]), best, np.array([0])) == 0


def test_oracle(spark, duck):
    got = sorted(tuple(r) for r in K.report(spark.read.parquet(f"{SF001}/embeddings.parquet")).collect())
    assert got == sorted(duck.execute(K.ORACLE).fetchall()) and got
