"""Ranking, first-k, frames and ids (T1-T6, O1-O5, S15 ids).

"First" always has a total order here (SURVEY D2): callers pass order
columns that end in a unique key.  Top-k filters are written as
``row_number() <= k`` so Spark plans a *partial* WindowGroupLimit before the
shuffle: a key that holds a third of all rows is cut to k rows per input
partition map-side, and never arrives whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rxlake.session import shuffle_partitions

_RN = "_rn"


def _cols(cs):
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def first_k(df: DataFrame, keys: list, order: list, k: int, rank_col: str | None = None) -> DataFrame:
    """First ``k`` rows per key in ``order`` (partial + final group limit)."""
    w = W.partitionBy(*_cols(keys)).orderBy(*_cols(order))
    out = df.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) <= k)
    return out.withColumnRenamed(_RN, rank_col) if rank_col else out.drop(_RN)


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """One row per key, the first in ``order``.

    T1 (newest): ``order=[desc(year), asc(ord)]``; T2 (file order):
    ``order=[asc(ord)]``.  Null keys form one group, as in pandas.
    """
    return first_k(df, keys, order, 1)


def keep_first_by_ord(df: DataFrame, keys: list, ord_col: str) -> DataFrame:
    """T2 with an order column: the first row per key, in one pass over ``df``
    (the partial group limit keeps one row per key and input partition)."""
    return keep_first(df, keys, [F.col(ord_col).asc()])


def last_n_oldest_first(df: DataFrame, keys: list, time_order: list, n: int,
                        pos_col: str = "pos") -> DataFrame:
    """The latest ``n`` rows per key, numbered oldest first (1..n).

    ``time_order`` is ascending (oldest first), e.g. ``[ts, id]``.
    """
    desc = [c.desc() for c in _cols(time_order)]
    top = first_k(df, keys, desc, n, rank_col="_rev")
    cnt = F.count(F.lit(1)).over(W.partitionBy(*_cols(keys)))
    # position oldest-first = (#kept - rev + 1); #kept <= n, so the window is tiny
    return top.withColumn(pos_col, (cnt - F.col("_rev") + 1).cast("int")).drop("_rev")


def rolling_list(df: DataFrame, keys: list, order: list, n: int, value: Column,
                 out_col: str) -> DataFrame:
    """T5: for every row, the last ``n`` values of its key up to and including
    itself, oldest first.  The frame is bounded, so memory per row is O(n)."""
    w = W.partitionBy(*_cols(keys)).orderBy(*_cols(order)).rowsBetween(-(n - 1), 0)
    return df.withColumn(out_col, F.collect_list(value).over(w))


def halo_frames(df: DataFrame, keys: list, order: list, n: int, columns: dict, chunk_rows: int | None = None) -> DataFrame:
    """Bounded frames without a per-key window: the last ``n`` rows of the key up
    to and including each row, with a key that holds a third of all rows spread
    over many tasks.  ``columns`` maps a new column to a function of the frame
    (``lambda w: F.sum("x").over(w)``).

    1. dense global numbers in (keys, order) order (range partitioned, see
       ``sequential_ids``) cut the rows into chunks of ``chunk_rows``;
    2. the last ``n - 1`` rows of a chunk are sent to the next chunk as well, its
       halo: all that a frame there can need of earlier chunks;
    3. the window runs per (key, chunk); halo rows are dropped afterwards.

    Every row is shuffled once, and ``n - 1`` rows a chunk twice.
    """
    size = max(n, chunk_rows or CHUNK_ROWS)
    numbered = sequential_ids(df, [*_cols(keys), *_cols(order)], id_col="_g")
    own = F.floor((F.col("_g") - 1) / size)
    last = F.pmod(F.col("_g") - 1, F.lit(size)) >= size - (n - 1)
    sent = numbered.withColumn("_at", F.explode(
        F.when(last, F.array(F.struct(own.alias("chunk"), F.lit(False).alias("halo")),
                             F.struct((own + 1).alias("chunk"), F.lit(True).alias("halo"))))
         .otherwise(F.array(F.struct(own.alias("chunk"), F.lit(False).alias("halo"))))))
    frame = W.partitionBy(F.col("_at.chunk"), *_cols(keys)).orderBy("_g").rowsBetween(-(n - 1), 0)
    return sent.withColumns({c: f(frame) for c, f in columns.items()}).where(~F.col("_at.halo")).drop("_g", "_at")


def rolling_list_split(df: DataFrame, keys: list, order: list, n: int, value: Column,
                       out_col: str) -> DataFrame:
    """T5 without a per-key window: the same result as ``rolling_list``, by ``halo_frames``."""
    return halo_frames(df, keys, order, n, {out_col: lambda w: F.collect_list(value).over(w)})


CHUNK_ROWS = 100_000         # of a halo frame's window partition
MAX_GROUP_ROWS = 2_000_000   # a per-key window above this is split instead


def frames(df: DataFrame, keys: list, order: list, n: int, columns: dict, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """The columns of ``halo_frames``, choosing the plan per key (equal results): one
    grouped count (combined map-side) finds the keys above ``max_group_rows``;
    only their rows take the halo plan, all others the bounded-frame window."""
    def windowed(rows: DataFrame) -> DataFrame:
        w = W.partitionBy(*_cols(keys)).orderBy(*_cols(order)).rowsBetween(-(n - 1), 0)
        return rows.withColumns({c: f(w) for c, f in columns.items()})

    hot = df.groupBy(*keys).count().where(F.col("count") > max_group_rows).select(*keys)
    if hot.isEmpty():
        return windowed(df)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    cold = df.alias("a").join(hot.alias("h"), same, "left_anti")
    warm = df.alias("a").join(hot.alias("h"), same, "left_semi")
    return windowed(cold).unionByName(halo_frames(warm, keys, order, n, columns))


def rolling_frames(df: DataFrame, keys: list, order: list, n: int, value: Column, out_col: str,
                   max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """T5: ``rolling_list`` by ``frames``."""
    return frames(df, keys, order, n, {out_col: lambda w: F.collect_list(value).over(w)}, max_group_rows)


def keep_valid_or_all(df: DataFrame, keys: list, ok_col: str, out_flag: str = "validated") -> DataFrame:
    """Per request keep the rows with ``ok``; when none is ok keep all.

    The any-ok flag is a grouped aggregate (partial, skew-safe) joined back on
    the request key, instead of a window over a possibly huge group.
    """
    any_ok = df.groupBy(*keys).agg(F.max(F.col(ok_col).cast("int")).alias("_any_ok"))
    out = df.join(any_ok, on=keys, how="inner")
    return (out.where(F.col(ok_col) | (F.col("_any_ok") == 0))
               .withColumn(out_flag, F.col("_any_ok") == 1).drop("_any_ok"))


def sequential_ids(df: DataFrame, order: list, start: Column | int = 0,
                   id_col: str = "id", num_partitions: int | None = None) -> DataFrame:
    """Dense ids ``start+1, start+2, ...`` in ``order`` without a one-partition
    window (what ``zipWithIndex`` does, in DataFrame form).

    1. range-partition and sort by ``order`` (order must end in a unique key);
    2. position inside a partition = ``monotonically_increasing_id`` minus the
       partition's base (the id packs partition index and row position);
    3. partition offsets from a per-partition count (one row per partition,
       tiny, broadcast) summed over earlier partitions.
    """
    spark = df.sparkSession
    n = num_partitions or shuffle_partitions(spark)
    ordered = (df.repartitionByRange(n, *_cols(order))
                 .sortWithinPartitions(*_cols(order))
                 .withColumn("_pid", F.spark_partition_id())
                 .withColumn("_mid", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    # checkpoint pins the partitioning so both branches see the same rows
    ordered = ordered.checkpoint(eager=True)
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)),
                           F.lit(0)))
    start_c = F.lit(start) if isinstance(start, int) else start
    out = ordered.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
    return (out.withColumn(id_col, (start_c + F.col("_off") + F.col("_local") + 1).cast("long"))
               .drop("_pid", "_mid", "_local", "_off"))
