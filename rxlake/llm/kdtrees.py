"""Exact top-k inner product search with KD-trees per shard.

Shards.  A bounded sample (``SAMPLE_VALUES`` components) fixes coarse regions by
median splits; every row is routed to its region, and a region with more than a
shard's rows is dealt out by a hash over as many shards as it needs, so copies
of one vector, however many, stay spread.  Regions only decide how well bounds
prune; results do not depend on the sample.

Trees.  In each shard rows are split at the median of the widest side of their
tight bounding box, down to leaves of ``LEAF_ROWS``; every node keeps its tight
box.  A tree is one row of a table in the shared folder.

Search.  The largest inner product a box allows is the sum over the sides of the
better corner.  A node's bound is never below its children's, so a priority
queue would pop a tree's leaves by falling bound; here a whole block of queries
does so in step: bounds level by level drop the nodes below the query's k-th
score, the rest is visited best bound first, queries at the same leaf are
multiplied together, and a query leaves when its next bound is below its k-th
score (an equal bound is visited, for ties).

The k-th score is propagated: first each query searches the tree of its own
shard, these scores go out with the block, and a task carries its queries' best
scores from tree to tree.  Tasks return at most k rows a query, merged by a
grouped first-k.  Queries are sent in blocks of bounded size; each block's
result is written to the shared folder.

Defined results: vectors that are null or hold a null or non-finite component
take no part; shorter vectors go on with zeros; equal scores are ordered by id
(null ids last); repeated rows are candidates and queries of their own; very
large components are clipped (see ``intvec``); an empty table or one without
queries gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rxlake.llm import intvec as V
from rxlake.llm.store import shared_folder, written
from rxlake.session import shuffle_partitions

SHARD_VALUES = 1 << 17          # components in a shard, about
LEAST_SHARD = 256               # rows in a shard at least, however long the vectors
LEAF_ROWS = 64
SAMPLE_VALUES = 1 << 22         # components of the rows that fix the regions
MAX_REGIONS = 4096


# ------------------------------------------------------------------- regions ---
def fit_regions(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(side, cut) of each inner node of a complete binary tree, in heap order."""
    side, cut = np.zeros((1 << levels) - 1, np.int64), np.full((1 << levels) - 1, np.inf)
    rows = {0: np.arange(len(sample))}
    for node in range(len(side)):
        own = rows.pop(node, None)
        if own is None or len(own) < 2:
            continue
        x = sample[own]
        side[node] = int(np.argmax(x.var(0)))
        cut[node] = np.median(x[:, side[node]])
        right = x[:, side[node]] > cut[node]
        rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
    return side, cut


def region_of(x: np.ndarray, side: np.ndarray, cut: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for _ in range(len(side).bit_length()):
        node = 2 * node + 1 + (x[np.arange(len(x)), side[node]] > cut[node])
    return node - len(side)


# --------------------------------------------------------------------- trees ---
class Tree:
    """Rows in leaf order, the boxes of all levels, and where leaves start."""

    def __init__(self, x: np.ndarray, ids: V.Ids, levels: list[tuple[np.ndarray, np.ndarray]], starts: np.ndarray):
        self.x, self.ids, self.levels, self.starts = x, ids, levels, starts

    @staticmethod
    def build(x: np.ndarray, ids: V.Ids, leaf_rows: int = LEAF_ROWS) -> "Tree":
        height = max(0, math.ceil(math.log2(max(1, len(x) / leaf_rows))))
        order, starts, levels = np.arange(len(x)), np.array([0, len(x)]), []
        for level in range(height + 1):
            own = x[order]
            lo, hi = np.minimum.reduceat(own, starts[:-1]), np.maximum.reduceat(own, starts[:-1])
            levels.append((lo, hi))
            if level == height:
                break
            widest = (hi - lo).argmax(1)
            halves = [0]
            for node, (a, b) in enumerate(zip(starts, starts[1:])):
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[a:b, widest[node]], middle)]
                halves += [a + middle, b]
            starts = np.array(halves)
        return Tree(x[order], ids.take(order), levels, starts)

    def pack(self, shape: V.Shape) -> dict[str, bytes]:
        as_bytes = lambda a, t: np.ascontiguousarray(a.astype(t)).tobytes()
        return {"x": as_bytes(self.x, shape.store), "row": as_bytes(self.ids.row, np.int64), "id": as_bytes(self.ids.id, np.int64),
                "null": as_bytes(self.ids.null, np.int8), "starts": as_bytes(self.starts, np.int64),
                "lo": as_bytes(np.concatenate([lo for lo, _ in self.levels]), shape.store),
                "hi": as_bytes(np.concatenate([hi for _, hi in self.levels]), shape.store)}

    @staticmethod
    def unpack(row: dict[str, bytes], shape: V.Shape) -> "Tree":
        matrix = lambda b: np.frombuffer(b, shape.store).reshape(-1, shape.dim).astype(shape.work)
        starts = np.frombuffer(row["starts"], np.int64)
        lo, hi, at, levels = matrix(row["lo"]), matrix(row["hi"]), 0, []
        for level in range((len(starts) - 1).bit_length()):
            levels.append((lo[at:at + (1 << level)], hi[at:at + (1 << level)]))
            at += 1 << level
        ids = V.Ids(np.frombuffer(row["row"], np.int64), np.frombuffer(row["id"], np.int64), np.frombuffer(row["null"], np.int8))
        return Tree(matrix(row["x"]), ids, levels, starts)

    def search(self, queries: np.ndarray, rows: np.ndarray, best: V.Best, use: np.ndarray) -> int:
        """Offer to ``best`` all that the queries numbered ``use`` may need; ``rows``
        are the queries' own rows, which are no candidates.  Returns the number
        of inner products."""
        up, down = np.maximum(queries[use], 0), np.minimum(queries[use], 0)
        alive = np.ones((len(use), 1), bool)
        bound = None
        for level, (lo, hi) in enumerate(self.levels):
            bound = up @ hi.T + down @ lo.T
            alive = (np.repeat(alive, 2, 1) if level else alive) & (bound >= best.kth[use][:, None])
            left = alive.any(1)
            if not left.all():
                use, up, down, alive, bound = use[left], up[left], down[left], alive[left], bound[left]
            if not len(use):
                return 0
        bound = np.where(alive, bound, best.low)
        order = np.argsort(-bound, 1, kind="stable")
        done, here = 0, np.arange(len(use))
        for step in range(order.shape[1]):
            leaf = order[here, step]
            go = alive[here, leaf] & (bound[here, leaf] >= best.kth[use[here]])
            here, leaf = here[go], leaf[go]         # bounds fall and k-th scores rise: who stops stays out
            if not len(here):
                break
            by = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[by], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(by)]):
                own = use[here[by[a:b]]]
                lo, hi = self.starts[leaf[by[a]]], self.starts[leaf[by[a]] + 1]
                ids = self.ids.take(slice(lo, hi))
                best.offer(own, queries[own] @ self.x[lo:hi].T, ids, rows[own][:, None] != ids.row[None])
                done += (b - a) * (hi - lo)
        return int(done)


_TREE = "shard long, x binary, row binary, id binary, null binary, starts binary, lo binary, hi binary"
_HITS = "query long, query_id long, score long, row long, vec_id long"


def _searcher(sent, shape: V.Shape, k: int, at_home: bool):
    """Search the trees of a task for a block of queries: at home only, or everywhere else."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, ids, home, top = sent.value
        queries = queries.astype(shape.work)
        best = V.Best(len(queries), k, shape.work, top)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                use = np.flatnonzero((home == row["shard"]) == at_home)
                if len(use):
                    Tree.unpack(row, shape).search(queries, ids.row, best, use)
        q, score, row, number, null = best.result()
        yield V.as_batch({
            "query": (ids.row[q], pa.int64()), "query_id": (ids.id[q], pa.int64()), "score": (score.astype(np.int64), pa.int64()),
            "row": (row, pa.int64()), "vec_id": (pa.array(number, pa.int64(), mask=null.astype(bool)), pa.int64())})
    return run


def _first_k(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build(vectors: DataFrame, is_query: Column, *, vec_id: str, vec: str, scale: int) -> tuple[V.Shape, DataFrame, DataFrame] | None:
    """(shape, trees, queries) as tables in the shared folder, or None if no vector is usable."""
    spark = vectors.sparkSession
    src = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vec}`").alias("v"),
                         F.coalesce(is_query, F.lit(False)).alias("asks")).where(V.usable(F.col("v")))
    shape = V.measure(src, "v", scale)
    if not shape.rows:
        return None
    shard_rows = max(LEAST_SHARD, SHARD_VALUES // shape.dim)
    sample_rows = max(LEAST_SHARD, SAMPLE_VALUES // shape.dim)
    regions = min(MAX_REGIONS, 1 << math.ceil(math.log2(max(1, 2 * shape.rows / shard_rows))))
    sample = src.select("v").sample(min(1.0, sample_rows / shape.rows), seed=0).toArrow()
    levels = regions.bit_length() - 1
    side, cut = fit_regions(V.integers(sample.column("v"), shape).astype(np.float64), levels)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = V.integers(batch.column("v"), shape)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("rid", "vec_id", "asks")] + [pa.array(region_of(x, side, cut)), V.packed(x)],
                names=["rid", "vec_id", "asks", "region", "x"])

    routed = written(src.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "asks", "v")
                     .mapInArrow(route, "rid long, vec_id long, asks boolean, region long, x binary"), "kd-rows")
    counts = routed.groupBy("region").count().collect()             # at most MAX_REGIONS rows
    shards, first = [], 0
    for r in sorted(counts):
        n = math.ceil(r["count"] / shard_rows)
        shards.append((r["region"], first, n))
        first += n
    plan = spark.createDataFrame(shards, "region long, first long, n long")
    placed = routed.join(F.broadcast(plan), "region") \
        .withColumn("shard", F.col("first") + F.pmod(F.xxhash64("rid"), "n")).select("shard", "rid", "vec_id", "asks", "x")

    def grow(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = V.Ids.of(table.column("rid").combine_chunks(), table.column("vec_id").combine_chunks())
        tree = Tree.build(V.unpacked(table.column("x").combine_chunks(), shape), ids).pack(shape)
        return pa.table({"shard": table.column("shard").slice(0, 1), **{c: pa.array([b], pa.binary()) for c, b in tree.items()}})

    parts = min(first, 8 * shuffle_partitions(spark))
    trees = written(placed.drop("asks").repartition(max(1, parts), "shard").groupBy("shard").applyInArrow(grow, _TREE), "kd-trees")
    return shape, trees, written(placed.where("asks").select("rid", "vec_id", "shard", "x"), "kd-queries")


def search(vectors: DataFrame, is_query: Column, *, k: int = 10, vec_id: str = "vec_id", vec: str = "embedding",
           scale: int = 1024) -> DataFrame:
    """For every row that meets ``is_query`` the k other rows of highest inner product:
    query_id, rank, vec_id, score, query and row (the two rows' numbers)."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score long, query long, row long"
    made = build(vectors, is_query, vec_id=vec_id, vec=vec, scale=scale)
    if made is None:
        return spark.createDataFrame([], out)
    shape, trees, queries = made
    number = queries.count()
    if not number:
        return spark.createDataFrame([], out)
    path = shared_folder(spark, "kd-found")
    for i, block in V.blocks(queries, number, 8 * (shape.dim + k + 4)):
        ids = V.Ids.of(block.column("rid").combine_chunks(), block.column("vec_id").combine_chunks())
        home = block.column("shard").to_numpy()
        x = V.unpacked(block.column("x").combine_chunks(), shape).astype(shape.store)
        first = spark.sparkContext.broadcast((x, ids, home, None))
        own = written(trees.mapInArrow(_searcher(first, shape, k, True), _HITS), "kd-home")
        found = own.select("query", "score").toArrow()              # at most k rows a query of the block
        top = np.full((len(ids.row), k), V.lowest(shape.work), shape.work)
        order = np.argsort(ids.row)
        at = order[np.searchsorted(ids.row[order], found.column("query").to_numpy())]
        by = np.argsort(at, kind="stable")
        place = np.arange(len(at)) - np.searchsorted(at[by], at[by])
        top[at[by], place] = found.column("score").to_numpy()[by]
        second = spark.sparkContext.broadcast((x, ids, home, top))
        rest = trees.mapInArrow(_searcher(second, shape, k, False), _HITS)
        _first_k(own.unionByName(rest), k).write.parquet(f"{path}/block={i}")
        first.destroy()
        second.destroy()
    return spark.read.schema(out).parquet(path).select("query_id", "rank", "vec_id", "score", "query", "row")


def report(vectors: DataFrame, every: int = 100) -> DataFrame:
    """The contract's columns: queries are the rows whose id is divisible by ``every``."""
    return search(vectors, F.col("vec_id") % every == 0).select("query_id", "rank", "vec_id", "score")


#: the same rows in DuckDB SQL, by all pairs of queries and rows
ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
         row_number() OVER (PARTITION BY q.r ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id NULLS LAST, c.r) AS rank
  FROM v q, v c
  WHERE q.vec_id % 100 = 0 AND c.r <> q.r)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM s WHERE rank <= 10
"""
