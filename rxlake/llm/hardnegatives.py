"""Hard negatives by slot-decomposed selection.

An anchor's positives are its best rows of the same label.  Each positive of
score p has a window of admissible scores, LOW % to HIGH % of p, and wants the
best rows of another label in it.  The windows of one anchor overlap, so they
are not searched one by one:

1. the positives' upper limits, sorted, split the scores into disjoint slots,
   one below each limit down to the next; a row of another label falls into at
   most one slot of an anchor (and into none below the slot's own lower limit);
2. each task is a combiner: it keeps the best k rows of every slot of the block's
   anchors, and returns no more; a grouped first-k merges the tasks;
3. the best k rows below a positive's upper limit are those of its slot and all
   lower ones: the slots' lists are merged from the lowest upwards, each step
   keeping k, which answers all windows at once.  The lower limit then cuts the
   list from its end.

Rows stream through two passes (positives, then slots), without a shuffle of
vectors, so a label that holds most rows stays spread.  Anchors are sent in
blocks of bounded size, with 2 numbers a slot; a block's positives and result
are written to the shared folder.

Defined results: rows with a null label, a null vector or a null or non-finite
component take no part; shorter vectors go on with zeros; equal scores are
ordered by id (null ids last), repeated rows stand for themselves; equal
positives share their slot; an anchor without positives, a positive with a
negative score or an empty window gives no row; very large components are
clipped (see ``intvec``); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rxlake.llm import intvec as V
from rxlake.llm.store import shared_folder, written

LOW, HIGH = 50, 95              # per cent of the positive's score
TILE = 1 << 21                  # scores computed at a time

_POSITIVES = "anchor long, anchor_id long, score long, row long, vec_id long"
_SLOTS = "anchor long, slot int, score long, row long, vec_id long"
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def limits(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) admissible whole score of a positive's score."""
    exact = positive.astype(object)             # a percentage of a long need not fit one
    return (-(-LOW * exact // 100)).astype(np.int64), (HIGH * exact // 100).astype(np.int64)


def _tiles(batches: Iterator[pa.RecordBatch], shape: V.Shape, anchors: int):
    """(ids, labels, matrix) of runs of rows, so that anchors x rows fit a tile."""
    rows = max(16, TILE // max(1, anchors))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield (V.Ids.of(part.column("rid"), part.column("vec_id")), part.column("label").to_numpy(),
                   V.unpacked(part.column("x"), shape))


def _positives(sent, shape: V.Shape, k: int):
    """Best k other rows of the anchor's label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, me, label = sent.value
        row = me.row
        x, best = x.astype(shape.work), V.Best(len(x), k, shape.work)
        anchors = {int(v): np.flatnonzero(label == v) for v in np.unique(label)}
        for ids, own, matrix in _tiles(batches, shape, len(x)):
            for v in np.unique(own):
                a, r = anchors.get(int(v)), np.flatnonzero(own == v)
                if a is not None:
                    best.offer(a, x[a] @ matrix[r].T, ids.take(r), row[a][:, None] != ids.row[r][None])
        q, score, found, number, null = best.result()
        yield V.as_batch({"anchor": (row[q], pa.int64()), "anchor_id": (pa.array(me.id[q], pa.int64(), mask=me.null[q].astype(bool)), pa.int64()),
                          "score": (score.astype(np.int64), pa.int64()), "row": (found, pa.int64()),
                          "vec_id": (pa.array(number, pa.int64(), mask=null.astype(bool)), pa.int64())})
    return run


def _slots(sent, shape: V.Shape, slots: int, k: int):
    """Best k rows of another label in each slot: slot i holds scores from low[i] to high[i]."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, row, label, low, high = sent.value
        x, best = x.astype(shape.work), V.Best(len(x) * slots, k, shape.work)
        numbers = np.arange(len(x))
        for ids, own, matrix in _tiles(batches, shape, len(x)):
            scores = x @ matrix.T
            other = label[:, None] != own[None]
            for s in range(slots):
                at = numbers * slots + s
                floor = np.maximum(low[:, s].astype(shape.work), best.kth[at])      # the combiner's own k-th score rises
                inside = other & (scores >= floor[:, None]) & (scores <= high[:, s, None])
                some = np.flatnonzero(inside.any(1))
                if len(some):
                    best.offer(at[some], scores[some], ids, inside[some])
        q, score, found, number, null = best.result()
        yield V.as_batch({"anchor": (row[q // slots], pa.int64()), "slot": (q % slots, pa.int32()),
                          "score": (score.astype(np.int64), pa.int64()), "row": (found, pa.int64()),
                          "vec_id": (pa.array(number, pa.int64(), mask=null.astype(bool)), pa.int64())})
    return run


def _first_k(hits: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def suffix_merges(slots: DataFrame, n: int, k: int) -> DataFrame:
    """(anchor, slot, found): the best k rows of the slot and all lower ones, for slots 0 to n-1."""
    entry = F.struct((-F.col("score")).alias("order"), F.col("vec_id").isNull().alias("null"), "vec_id", "row", "score")
    lists = slots.groupBy("anchor").agg(*[
        F.collect_list(F.when(F.col("slot") == s, entry)).alias(f"s{s}") for s in range(n)])      # at most k each
    upto = F.slice(F.array_sort(F.col(f"s{n - 1}")), 1, k)
    merged = {n - 1: upto}
    for s in range(n - 2, -1, -1):
        merged[s] = F.slice(F.array_sort(F.concat(F.col(f"s{s}"), F.col(f"m{s + 1}"))), 1, k)
    lists = lists.withColumn(f"m{n - 1}", merged[n - 1])
    for s in range(n - 2, -1, -1):
        lists = lists.withColumn(f"m{s}", merged[s])
    pairs = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"m{s}").alias("found")) for s in range(n)])
    return lists.select("anchor", F.explode(pairs).alias("p")).select("anchor", "p.slot", "p.found")


def _answers(positives: DataFrame, merged: DataFrame) -> DataFrame:
    """Each positive's list of its slot and the lower ones, cut at its lower limit."""
    wide = lambda c, times: c.cast("decimal(38,0)") * times
    p = positives.select("anchor", "anchor_id", (F.col("place") - 1).alias("slot"), F.col("vec_id").alias("positive_id"),
                         F.col("score").alias("positive_score"))
    kept = F.filter("found", lambda e: wide(e["score"], 100) >= wide(F.col("positive_score"), LOW))
    return p.join(merged, ["anchor", "slot"]).select("anchor_id", "positive_id", "positive_score", F.posexplode(kept).alias("at", "e")) \
        .select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("negative_id"),
                "positive_score", F.col("e.score").alias("negative_score"))


def mine(vectors: DataFrame, is_anchor: Column, label: Column, *, positives: int = 5, negatives: int = 3,
         vec_id: str = "vec_id", vec: str = "embedding", scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    src = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vec}`").alias("v"),
                         label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks")) \
        .where(V.usable(F.col("v")) & F.col("label").isNotNull())
    shape = V.measure(src, "v", scale)
    if not shape.rows:
        return spark.createDataFrame([], _RESULT)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ["rid", "vec_id", "label", "asks"]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), V.packed(V.integers(batch.column("v"), shape))],
                                             names=[*kept, "x"])

    rows = written(src.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "asks", "v")
                   .mapInArrow(whole, "rid long, vec_id long, label long, asks boolean, x binary"), "negatives-rows")
    anchors = written(rows.where("asks").select("rid", "vec_id", "label", "x"), "negatives-anchors")
    number = anchors.count()
    if not number:
        return spark.createDataFrame([], _RESULT)
    streamed = rows.select("rid", "vec_id", "label", "x")
    path = shared_folder(spark, "negatives-found")
    for i, block in V.blocks(anchors, number, 8 * (shape.dim + 3 * positives + 4)):
        ids = V.Ids.of(block.column("rid").combine_chunks(), block.column("vec_id").combine_chunks())
        x = V.unpacked(block.column("x").combine_chunks(), shape).astype(shape.store)
        labels = block.column("label").to_numpy()
        first = spark.sparkContext.broadcast((x, ids, labels))
        best = written(_first_k(streamed.mapInArrow(_positives(first, shape, positives), _POSITIVES), ["anchor"], positives),
                       "negatives-positives")
        found = best.select("anchor", "place", "score").toArrow()       # at most ``positives`` rows an anchor of the block
        order = np.argsort(ids.row)
        at = order[np.searchsorted(ids.row[order], found.column("anchor").to_numpy())]
        place = found.column("place").to_numpy() - 1
        low = np.ones((len(x), positives), np.int64)
        high = np.zeros((len(x), positives), np.int64)                  # no positive: an empty slot
        low[at, place], high[at, place] = limits(found.column("score").to_numpy())
        there = np.zeros((len(x), positives), bool)
        there[at, place] = True
        # a slot ends above the next limit; equal limits leave the upper slot empty
        low[:, :-1] = np.where(there[:, 1:], np.maximum(low[:, :-1], high[:, 1:] + 1), low[:, :-1])
        second = spark.sparkContext.broadcast((x, ids.row, labels, low, high))
        slots = _first_k(streamed.mapInArrow(_slots(second, shape, positives, negatives), _SLOTS), ["anchor", "slot"], negatives)
        _answers(best, suffix_merges(slots, positives, negatives)).write.parquet(f"{path}/block={i}")
        first.destroy()
        second.destroy()
    return spark.read.schema(_RESULT).parquet(path).select(*[c.split()[0] for c in _RESULT.split(", ")])


def report(vectors: DataFrame) -> DataFrame:
    """The contract's rows: anchors are the ids divisible by 50; the labels of ids divisible by 7 go up by one of ten."""
    label = F.col("label").cast("long")
    changed = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(vectors, F.col("vec_id") % 50 == 0, changed)


#: the same rows in DuckDB SQL, by all pairs of anchors and rows
ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a, v c
  WHERE a.vec_id % 50 = 0 AND a.r <> c.r),
p AS (
  SELECT a, r, anchor_id, vec_id, score,
         row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, r) AS place
  FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.vec_id NULLS LAST, s.r) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
  WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
