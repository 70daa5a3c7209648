"""Ranking, dedup, ids and frames."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import rows
from rxlake.operators import rank as R


def test_keep_first_newest_with_ties(spark):
    df = spark.createDataFrame([
        ("1", 2020, 0, "old"), ("1", 2025, 5, "new-b"), ("1", 2025, 3, "new-a"),
        (None, 2021, 1, "n1"), (None, 2022, 2, "n2"), ("2", 2020, 4, "only"),
    ], "k string, y int, ord long, v string")
    out = R.keep_first(df, ["k"], [F.col("y").desc(), F.col("ord").asc()])
    assert sorted(rows(out, "k", "v"), key=str) == sorted([("1", "new-a"), (None, "n2"), ("2", "only")], key=str)


def test_keep_first_by_ord(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 7)], "k string, ord long")
    assert sorted(rows(R.keep_first_by_ord(df, ["k"], "ord"), "ord", "k")) == [(1, "a"), (7, "b")]


def test_sequential_ids_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    out = R.sequential_ids(df, ["k"], start=100, id_col="new_id", num_partitions=7)
    got = sorted(rows(out, "k", "new_id"))
    assert got == [(k, 100 + k + 1) for k in range(1000)]


def test_last_n_oldest_first(spark):
    df = spark.createDataFrame([("u", t) for t in range(8)] + [("v", 0)], "u string, t int")
    out = R.last_n_oldest_first(df, ["u"], [F.col("t")], 6)
    assert sorted(rows(out, "u", "pos", "t")) == [("u", i + 1, t) for i, t in enumerate(range(2, 8))] + [("v", 1, 0)]


def test_rolling_list(spark):
    df = spark.createDataFrame([("c", t) for t in range(5)], "c string, t int")
    out = R.rolling_list(df, ["c"], [F.col("t")], 3, F.col("t"), "h")
    assert sorted(rows(out, "t", "h")) == [(0, [0]), (1, [0, 1]), (2, [0, 1, 2]), (3, [1, 2, 3]), (4, [2, 3, 4])]


def test_keep_valid_or_all(spark):
    df = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", False), (2, "d", False)],
                               "r int, n string, ok boolean")
    out = R.keep_valid_or_all(df, ["r"], "ok")
    assert sorted(rows(out, "r", "n", "validated")) == [(1, "a", True), (2, "c", False), (2, "d", False)]


def test_rolling_split_equals_window(spark):
    import random
    random.seed(3)
    data = [("hot", t, f"m{t}") for t in range(0, 300, 3)] + \
           [(f"c{i}", t, f"x{i}-{t}") for i in range(20) for t in random.sample(range(50), 5)]
    df = spark.createDataFrame(data, "c string, t int, v string")
    a = R.rolling_list(df, ["c"], [F.col("t")], 6, F.col("v"), "h")
    b = R.rolling_list_split(df, ["c"], [F.col("t")], 6, F.col("v"), "h")
    assert sorted(rows(a, "c", "t", "h")) == sorted(rows(b, "c", "t", "h"))


def test_rolling_frames_picks_split_for_hot_key(spark):
    df = spark.createDataFrame([("hot", t, t) for t in range(30)] + [("c", 0, 0)], "c string, t int, v int")
    a = R.rolling_frames(df, ["c"], [F.col("t")], 3, F.col("v"), "h", max_group_rows=10)   # split path
    b = R.rolling_frames(df, ["c"], [F.col("t")], 3, F.col("v"), "h")                      # window path
    assert sorted(rows(a, "c", "t", "h")) == sorted(rows(b, "c", "t", "h"))


_rows = st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(2020, 2023), st.booleans()),
                 min_size=1, max_size=30)
_prop = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@_prop
@given(_rows)
def test_keep_first_property(spark, data):
    """Exactly one row per key (null keys form one group), the
    brute-force first in (year desc, ord) and in ord order."""
    df = spark.createDataFrame([(k, y, i, ok) for i, (k, y, ok) in enumerate(data)],
                               "k string, y int, ord long, ok boolean")
    newest = rows(R.keep_first(df, ["k"], [F.col("y").desc(), F.col("ord").asc()]), "k", "ord")
    by_ord = rows(R.keep_first_by_ord(df, ["k"], "ord"), "k", "ord")
    keys = {k for k, _, _ in data}
    want_new = {k: min((-y, i) for i, (kk, y, _) in enumerate(data) if kk == k)[1] for k in keys}
    want_ord = {k: min(i for i, (kk, _, _) in enumerate(data) if kk == k) for k in keys}
    assert len(newest) == len(keys) and dict(newest) == want_new
    assert len(by_ord) == len(keys) and dict(by_ord) == want_ord


@_prop
@given(_rows)
def test_keep_valid_or_all_property(spark, data):
    """Output is a subset of the input, never empty for a request that
    had rows, and holds exactly the ok rows when any row is ok."""
    df = spark.createDataFrame([(k or "∅", i, ok) for i, (k, _, ok) in enumerate(data)],
                               "r string, i long, ok boolean")
    out = rows(R.keep_valid_or_all(df, ["r"], "ok"), "r", "i", "ok", "validated")
    got = {}
    for r, i, ok, v in out:
        got.setdefault(r, set()).add(i)
    groups = {}
    for i, (k, _, ok) in enumerate(data):
        groups.setdefault(k or "∅", []).append((i, ok))
    for r, members in groups.items():
        oks = {i for i, ok in members if ok}
        assert got[r] == (oks or {i for i, _ in members})
    assert all(v == any(ok for _, ok in groups[r]) for r, _, _, v in out)


def test_report_depth_cuts_long_histories(spark):
    """A conversation longer than the report depth keeps its last 20
    turns, numbered oldest first."""
    df = spark.createDataFrame([("u", t) for t in range(25)], "u string, t int")
    out = sorted(rows(R.last_n_oldest_first(df, ["u"], [F.col("t")], 20), "pos", "t"))
    assert out == [(i + 1, t) for i, t in enumerate(range(5, 25))]


def test_first_in_file_order_with_hot_key(spark):
    """T2 with one key holding a third of the rows: min(ord) per key combines
    map-side; the result is still the first row of every key."""
    data = [("hot", i) for i in range(0, 900, 3)] + [(f"k{i % 200}", i) for i in range(900) if i % 3]
    df = spark.createDataFrame(data, "k string, ord long").repartition(6)
    got = dict(rows(R.keep_first_by_ord(df, ["k"], "ord"), "k", "ord"))
    want = {}
    for k, o in data:
        want[k] = min(o, want.get(k, o))
    assert got == want
