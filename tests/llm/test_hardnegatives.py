import random

import pytest
from llm_helpers import SF001
from pyspark.sql import functions as F
from test_kdtrees import usable, whole

from rxlake.llm import hardnegatives as H
from rxlake.llm import intvec as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every, n_pos=5, n_neg=3, scale=256):
    """[(anchor, positive, rank, negative, scores)] by plain loops; rows: (id, vector, label)."""
    good = [(i, r[0], whole(r[1], scale), r[2]) for i, r in enumerate(rows) if usable(r[1]) and r[2] is not None]
    out = []
    for i, a, x, label in good:
        if a is None or a % every:
            continue
        ranked = sorted((-sum(p * q for p, q in zip(x, y)), c is None, c or 0, j, own) for j, c, y, own in good if j != i)
        for s, null, c, _, _ in [r for r in ranked if r[4] == label][:n_pos]:
            near = [r for r in ranked if r[4] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:n_neg]
            out += [(a, None if null else c, n + 1, None if r[1] else r[2], -s, -r[0]) for n, r in enumerate(near)]
    return sorted(out, key=str)


def run(spark, rows, every=4, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted([tuple(r) for r in H.mine(df, F.col("vec_id") % every == 0, F.col("label"), **kw).collect()], key=str)


@pytest.mark.parametrize("block", [32 << 20, 500])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK_BYTES", block)
    monkeypatch.setattr(H, "TILE", 64)
    rnd = random.Random(block)
    rows = [(i, [rnd.gauss(0.3, 1) for _ in range(4)], rnd.randrange(3)) for i in range(120)]
    got = run(spark, rows)
    assert got == brute(rows, 4) and len(got) > 100


def test_ties_copies_and_odd_rows(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([0.25, 0.5, 1.0]) for _ in range(2)], rnd.randrange(2)) for i in range(60)]
    rows += [(i, [1.0, 1.0], 0) for i in range(100, 150)]                    # one label and vector hold half the rows
    rows += [(4, [1.0, 1.0], 0), (4, [1.0, 1.0], 0), (None, [1.0, 0.75], 1), (None, [1.0, 1.0], 0)]
    rows += [(8, None, 0), (8, [1.0, 1.0], None), (12, [None, 1.0], 0), (16, [float("nan"), 1.0], 0), (20, [], 0),
             (24, [1.0], 1), (28, [0.0, 0.0], 1), (32, [-1.0, -1.0], 0)]
    assert run(spark, rows) == brute(rows, 4)


def test_overlapping_windows_share_slots(spark):
    """Positives 100, 90, 90, 60 and 0 of one anchor: windows 50-95, 45-85, 45-85, 30-57 and 0-0."""
    rows = [(0, [1.0], 1)] + [(i + 1, [s / 256], 1) for i, s in enumerate([100, 90, 90, 60, 0])]
    rows += [(100 + s, [s / 256], 2) for s in range(101)]
    got = run(spark, rows, 1000)
    assert got == brute(rows, 1000)
    top = {(p, r): n for _, p, r, n, _, _ in got}
    assert [top[1, 1], top[2, 1], top[3, 1], top[4, 1], top[5, 1]] == [195, 185, 185, 157, 100]
    assert (5, 2) not in top


def test_few_rows_and_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(4, [1.0], 1)]) == []                                 # no positive
    assert run(spark, [(4, [1.0], 1), (5, [1.0], 1)]) == []                  # no negative
    assert run(spark, [(1, [1.0], 1), (5, [1.0], 2)]) == []                  # no anchor
    assert run(spark, [(4, [-1.0], 1), (5, [1.0], 1), (6, [0.7], 2)]) == []  # a negative score admits nothing


def test_products_beyond_doubles(spark):
    rnd = random.Random(5)
    rows = [(i, [float(rnd.randrange(10 ** 5, 10 ** 6)) + rnd.random() for _ in range(4)], rnd.randrange(2)) for i in range(40)]
    got = run(spark, rows)
    assert got == brute(rows, 4) and any(r[4] >= 1 << 53 for r in got)


def test_limits():
    import numpy as np
    low, high = H.limits(np.array([100, 99, 1, 0, -3]))
    for p, a, b in zip([100, 99, 1, 0, -3], low, high):
        inside = [n for n in range(-10, 200) if 50 * p <= 100 * n <= 95 * p]
        assert inside == list(range(a, b + 1))


def test_oracle(spark, duck):
    got = sorted(tuple(r) for r in H.report(spark.read.parquet(f"{SF001}/embeddings.parquet")).collect())
    assert got == sorted(duck.execute(H.ORACLE).fetchall()) and got
