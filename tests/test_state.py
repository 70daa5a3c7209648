"""Alarm log fold (M1/M2), appends with ids (S14/S15), history (T4)."""

import datetime as dt

from pyspark.sql import functions as F

from helpers import rows
from rxlake.operators import rank as R
from rxlake.operators import state as A
from rxlake.sources import io as IO

T0 = dt.datetime(2024, 1, 1, 8, 30)


def log(spark, entries):
    return spark.createDataFrame(
        [(a, T0 + dt.timedelta(minutes=m), s, act, u, "혈압약", "08:30", "매일") for a, m, s, act, u in entries],
        "alarm_id long, ts timestamp, event_id long, action string, user_id string, medication_name string, "
        "time_hhmm string, days_of_week string")


def test_register_disable_unknown(spark):
    entries = [(1, 0, 1, "register", "u1"), (2, 1, 2, "register", "u1"),
               (1, 5, 3, "disable", None), (99, 6, 4, "disable", None),   # unknown id: no row
               (3, 9, 6, "register", "u2"), (3, 8, 5, "disable", None)]  # disable before register
    st = A.fold_alarms(log(spark, entries))
    assert sorted(rows(st, "alarm_id", "is_enabled")) == [(1, False), (2, True), (3, True)]
    users = spark.createDataFrame([("u1",)], "user_id string")
    assert rows(A.active_alarms(st, users), "alarm_id") == [(2,)]


def test_append_with_ids(spark):
    existing = spark.createDataFrame([(5,), (9,)], "id long")
    new = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "name string, o int")
    out = IO.append_with_ids(existing, new, ["o"], defaults={"is_enabled": 1})
    assert sorted(rows(out, "id", "name", "is_enabled")) == [(10, "a", 1), (11, "b", 1), (12, "c", 1)]


def test_history_tie_by_id(spark):
    t = dt.datetime(2024, 1, 1)
    turns = [(i, "u", t + dt.timedelta(seconds=i // 2)) for i in range(8)]  # pairs share a second
    df = spark.createDataFrame(turns, "id long, user_id string, ts timestamp")
    out = R.last_n_oldest_first(df, ["user_id"], [F.col("ts"), F.col("id")], 6)
    assert [r[0] for r in sorted(rows(out, "pos", "id"))] == [1, 2, 3, 4, 5, 6]
    assert [r[1] for r in sorted(rows(out, "pos", "id"))] == [2, 3, 4, 5, 6, 7]


def test_fold_hot_alarm_matches_brute_force(spark):
    """One alarm id holding a third of the log (re-registered and disabled
    over and over): the map-side max_by fold still gives its last action."""
    entries = [(7, m, m, "register" if m % 2 == 0 else "disable", "u7") for m in range(300)]
    entries += [(i, i, 1000 + i, "register", f"u{i}") for i in range(8, 608)]
    df = log(spark, entries).repartition(5)
    got = dict(rows(A.fold_alarms(df), "alarm_id", "is_enabled"))
    assert got[7] is False                     # last event (m = 299) is a disable
    assert len(got) == 601 and all(got[i] for i in range(8, 608))
