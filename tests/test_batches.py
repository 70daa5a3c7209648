"""Idempotent batch append (S14, S15) and halo frames."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helpers import rows
from rxlake.operators import rank as R
from rxlake.plans import jobs as J
from rxlake.sources import io as IO


def test_batches_get_consecutive_ids_and_retries_change_nothing(spark, tmp_path):
    path = str(tmp_path / "turns")
    batch = lambda start, n: spark.createDataFrame([(start + i, f"t{start + i}") for i in range(n)], "k long, text string").repartition(3)
    assert IO.read_batches(spark, path, "id long").count() == 0
    assert IO.append_batch(batch(0, 5), path, "2024-01-01", ["k"]) == {"batch": "2024-01-01", "first_id": 1, "rows": 5, "retried": False}
    assert IO.append_batch(batch(10, 3), path, "2", ["k"])["first_id"] == 6
    before = sorted(rows(IO.read_batches(spark, path), "id", "k", "text", "batch"))
    assert [r[0] for r in before] == list(range(1, 9)) and {r[3] for r in before} == {"2024-01-01", "2"}
    assert IO.append_batch(batch(0, 5), path, "2024-01-01", ["k"])["retried"]           # the same batch once more
    assert sorted(rows(IO.read_batches(spark, path), "id", "k", "text", "batch")) == before
    assert IO.append_batch(batch(20, 2), path, "3", ["k"])["first_id"] == 9
    with pytest.raises(ValueError):
        IO.append_batch(batch(0, 4), path, "2024-01-01", ["k"])


def test_failed_attempt_is_replaced(spark, tmp_path):
    """Ids reserved, rows half written: the retry leaves the batch whole."""
    path = str(tmp_path / "turns")
    new = spark.createDataFrame([(i,) for i in range(6)], "k long")
    IO._reserve(spark, path, "a", 1, 6)
    new.limit(2).withColumns({"id": F.lit(99).cast("long"), "batch": F.lit("a")}).write.partitionBy("batch").parquet(f"{path}/rows")
    IO.append_batch(spark.createDataFrame([(9,)], "k long"), path, "b", ["k"])          # a later batch came through meanwhile
    assert IO.append_batch(new, path, "a", ["k"])["retried"]
    assert sorted(rows(IO.read_batches(spark, path), "id", "k")) == [(i + 1, i) for i in range(6)] + [(7, 9)]


def test_save_turns(spark, tmp_path):
    path = str(tmp_path / "chat")
    turns = spark.createDataFrame([("u1", "user", "hi", 2), ("u1", "assistant", None, 3), ("u0", "user", "", 1)],
                                  "user_id string, role string, content string, timestamp long")
    for _ in range(2):
        J.save_turns(turns, path, "b1", ["timestamp", "user_id"])
    got = sorted(rows(IO.read_batches(spark, path), "id", "user_id", "role", "content"))
    assert got == [(1, "u0", "user", ""), (2, "u1", "user", "hi"), (3, "u1", "assistant", "")]


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_halo_frames_equal_the_window(spark, chunk):
    rnd = random.Random(chunk)
    data = [("hot" if i % 3 == 0 else rnd.choice("abcd"), i, rnd.randrange(100)) for i in range(400)]
    data += [(None, 900 + i, i) for i in range(9)] + [("one", 999, None)]
    df = spark.createDataFrame(data, "c string, t int, x int").repartition(5)
    columns = {"n": lambda w: F.count(F.lit(1)).over(w), "s": lambda w: F.sum("x").over(w), "l": lambda w: F.collect_list("x").over(w)}
    w = W.partitionBy("c").orderBy("t").rowsBetween(-5, 0)
    key = lambda r: (str(r[0]), r[1])
    want = sorted(rows(df.withColumns({k: f(w) for k, f in columns.items()})), key=key)
    assert sorted(rows(R.halo_frames(df, ["c"], ["t"], 6, columns, chunk)), key=key) == want
    assert sorted(rows(R.frames(df, ["c"], ["t"], 6, columns, max_group_rows=50)), key=key) == want


def test_no_task_holds_a_hot_conversation(spark):
    """A conversation with a third of all rows: its chunks are window partitions of their own."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("c"), F.col("id").alias("t"))
    out = R.halo_frames(df, ["c"], ["t"], 6, {"n": lambda w: F.count(F.lit(1)).over(w)}, 100)
    most = out.where("c = -1").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert out.count() == 3000 and most < 1000


def test_prompt_usage_with_a_hot_conversation(spark):
    msgs = spark.createDataFrame([(1, i, "x" * (i % 9)) for i in range(300)] + [(2, i, "yy") for i in range(5)], "conv long, turn long, text string")
    ctx = msgs.select("conv", "turn", F.lit("token").alias("context_source"), F.lit("abc").alias("context"))
    plain = sorted(rows(J.prompt_usage(msgs, ctx, ["conv"], ["turn"])))
    assert sorted(rows(J.prompt_usage(msgs, ctx, ["conv"], ["turn"], max_group_rows=100))) == plain and len(plain) == 305
