"""Pivot (ball) index for exact vector search.

Every vector belongs to its nearest pivot.  Inside a pivot's ball the vectors are
sorted by their distance to the pivot and cut into rings, so a ring is a group of
vectors at distance ``lo`` to ``hi`` of one pivot.  For a query at distance ``d`` of that
pivot the triangle inequality bounds its distance to all of them from below:
``max(d - hi, lo - d, 0)``.  Rings whose bound exceeds the query's k-th distance so
far are skipped whole; the result equals the full scan's, ties included.

Stored tables (a folder, or the shared checkpoint folder):

* ``rings``: one row a ring with its vectors packed as bytes, at most about
  ``ring_rows`` of them;
* ``bounds``: (ring, pivot, lo, hi, n), at most ``MAX_RINGS`` rows whatever the size
  (rings grow instead), so it can be broadcast; and the pivots, at most ``MAX_PIVOTS``.

A search is two row-wise passes over the query table, no pass per query:
the ring of least bound gives each query a k-th distance, then each query is sent
to the rings that this does not exclude.  Queries and rings meet by a grouped
join on (ring, part), where a part holds about ``PART`` queries, so neither a ring
that every query needs nor a pivot with a third of all vectors is one task.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxlake import fixed_values as FV
from rxlake.operators import rank as R
from rxlake.operators.vectors import Collection
from rxlake.session import ensure_checkpoint_dir, shuffle_partitions

MAX_PIVOTS = 1024
SAMPLE_ROWS = 16_384        # rows of which the pivots are chosen
MAX_RINGS = 1 << 18
RING_ROWS = 256             # at least
PART = 4096                 # queries that meet one copy of a ring
TILE_CELLS = 1 << 22        # query x ring bounds computed at a time


class PivotIndex(NamedTuple):
    rings: DataFrame
    pivots: np.ndarray
    bounds: dict[str, np.ndarray]      # ring, pivot, lo, hi, n
    id_type: str
    rows: int


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different rows of the sample, each the one farthest from those before."""
    chosen = [0]
    far = np.full(len(sample), np.inf)
    while len(chosen) < n:
        diff = sample - sample[chosen[-1]]
        far = np.minimum(far, np.einsum("ij,ij->i", diff, diff))
        if far.max() == 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x and y, by differences."""
    out = np.empty((len(x), len(y)))
    for j, p in enumerate(y):
        diff = x - p
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def build_index(vectors: DataFrame, path: str | None = None, *, id_col: str = "vec_id", vec_col: str = "embedding",
                pivots: int | None = None, ring_rows: int = RING_ROWS) -> PivotIndex:
    """Index the rows whose vector is not null (all of one length); empty tables give an index without rings."""
    spark = vectors.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/pivots-{uuid.uuid4().hex}"
    d = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    if dict(d.dtypes)["id"] != "string":
        d = d.withColumn("id", F.col("id").cast("long"))
    n = d.count()
    wanted = pivots or max(1, math.isqrt(n))
    sample = d.select("v").sample(min(1.0, SAMPLE_ROWS / max(n, 1)), seed=0).toArrow().column("v")
    if n and not len(sample):
        sample = d.select("v").limit(1).toArrow().column("v")
    centres = choose_pivots(_matrix(sample), min(wanted, MAX_PIVOTS)) if n else np.zeros((0, 1))
    per_ring = max(ring_rows, math.ceil(2 * n / MAX_RINGS))
    id_type = dict(d.dtypes)["id"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dist = _distance(_matrix(batch.column("v")), centres)
            near = dist.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(near.astype(np.int32)),
                                              pa.array(dist[np.arange(len(near)), near])], names=["id", "v", "pivot", "d"])

    placed = d.mapInArrow(assign, f"id {id_type}, v array<double>, pivot int, d double")
    numbered = R.sequential_ids(placed, ["pivot", "d", "id"], id_col="g")
    # consecutive numbers of one pivot: about per_ring rows, sorted by distance
    ringed = numbered.withColumn("ring", F.struct("pivot", F.floor((F.col("g") - 1) / per_ring).alias("run")))

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ring, d_ = table.column("ring")[0].as_py(), table.column("d").to_numpy()
        return pa.table({"pivot": pa.array([ring["pivot"]], pa.int32()), "run": pa.array([ring["run"]], pa.int64()),
                         "lo": [float(d_.min())], "hi": [float(d_.max())], "n": pa.array([len(d_)], pa.int64()),
                         "ids": pa.array([table.column("id").to_pylist()], pa.list_(table.schema.field("id").type)),
                         "vectors": pa.array([_matrix(table.column("v")).tobytes()], pa.binary())})

    made = ringed.groupBy("ring").applyInArrow(
        pack, f"pivot int, run long, lo double, hi double, n long, ids array<{id_type}>, vectors binary")
    made.withColumn("ring", F.xxhash64("pivot", "run")).write.mode("overwrite").parquet(f"{path}/rings")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "pivot int, v array<double>") \
        .write.mode("overwrite").parquet(f"{path}/pivots")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> PivotIndex:
    """The index that ``build_index`` stored in ``path``."""
    rings = spark.read.parquet(f"{path}/rings")
    b = rings.select("ring", "pivot", "lo", "hi", "n").orderBy("ring").toArrow()      # at most about MAX_RINGS rows
    pivots = spark.read.parquet(f"{path}/pivots").orderBy("pivot").toArrow().column("v")
    bounds = {c: b.column(c).to_numpy() for c in b.column_names}
    id_type = dict(rings.dtypes)["ids"][6:-1]
    return PivotIndex(rings, _matrix(pivots) if len(pivots) else np.zeros((0, 1)), bounds, id_type, int(bounds["n"].sum()))


def _lower_bounds(q: np.ndarray, pivots: np.ndarray, bounds: dict[str, np.ndarray]) -> np.ndarray:
    """queries x rings: no vector of the ring is nearer, rounding allowed for."""
    d = _distance(q, pivots)[:, bounds["pivot"]]
    low = np.maximum(np.maximum(d - bounds["hi"], bounds["lo"] - d), 0.0)
    return np.maximum(low - 1e-9 * (1 + d + bounds["hi"]), 0.0)


def _routes(sent, first: bool):
    """(qid, qvec, ring) of the rings that a query needs: the one of least bound, or
    all others within its k-th distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, bounds = sent.value
        tile = max(1, TILE_CELLS // max(1, len(bounds["ring"])))
        for batch in batches:
            for at in range(0, batch.num_rows, tile):
                part = batch.slice(at, tile)
                low = _lower_bounds(_matrix(part.column("qvec")), pivots, bounds)
                if first:
                    q, r = np.arange(part.num_rows), low.argmin(1)
                else:
                    home, kth = part.column("home").to_numpy(), part.column("kth").to_numpy(zero_copy_only=False)
                    q, r = np.nonzero((low * low <= kth[:, None]) & (bounds["ring"] != home[:, None]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("qid").take(pa.array(q)), part.column("qvec").take(pa.array(q)), pa.array(bounds["ring"][r])],
                    names=["qid", "qvec", "ring"])
    return run


def _meet(index: PivotIndex, routes: DataFrame, k: int, parts: int) -> DataFrame:
    """(qid, doc_id, dist, compared): each query's k nearest rows of each of its rings."""
    def search(queries: pa.Table, rings: pa.Table) -> pa.Table:
        out = {"qid": [], "doc_id": [], "dist": [], "compared": []}
        if queries.num_rows and rings.num_rows:
            q, qids = _matrix(queries.column("qvec")), queries.column("qid").to_numpy()
            ids = np.array(rings.column("ids")[0].as_py())
            x = np.frombuffer(rings.column("vectors")[0].as_py()).reshape(len(ids), -1)
            found = Collection(ids, x).table(qids, q, k)
            out = {"qid": found["qid"], "doc_id": found["doc_id"], "dist": found["dist"],
                   "compared": np.where(found["rank"] == 1, len(ids), 0)}
        return pa.table({"qid": pa.array(out["qid"], pa.int64()), "doc_id": pa.array(out["doc_id"], kind),
                         "dist": pa.array(out["dist"], pa.float64()), "compared": pa.array(out["compared"], pa.int64())})

    kind = pa.string() if index.id_type == "string" else pa.int64()
    asked = routes.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int"))
    copies = index.rings.select("ring", "ids", "vectors", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return asked.groupBy("ring", "part").cogroup(copies.groupBy("ring", "part")).applyInArrow(
        search, f"qid long, doc_id {index.id_type}, dist double, compared long")


def search(index: PivotIndex, queries: DataFrame, k: int = FV.VECTOR_TOP_K, *, qid: str = "qid", qvec: str = "qvec") -> DataFrame:
    """Exact top-k by squared L2: ``(qid, rank, doc_id, dist, compared)``, ties by id.

    ``compared`` is the number of vectors whose distance to the query was
    computed (the same on every row of a query); against ``index.rows`` it gives
    the share saved.  Queries without a vector have no rows.
    """
    spark = queries.sparkSession
    if not index.rows:
        return spark.createDataFrame([], f"qid long, rank int, doc_id {index.id_type}, dist double, compared long")
    asked = queries.select(F.col(qid).cast("long").alias("qid"), F.col(qvec).cast("array<double>").alias("qvec")) \
        .where(F.col("qvec").isNotNull()).repartition(max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark))) \
        .checkpoint(eager=True)
    parts = max(1, math.ceil(asked.count() / PART))
    sent = spark.sparkContext.broadcast((index.pivots, index.bounds))       # at most MAX_PIVOTS and MAX_RINGS rows
    home = asked.mapInArrow(_routes(sent, True), "qid long, qvec array<double>, ring long").checkpoint(eager=True)
    near = _meet(index, home, k, parts).checkpoint(eager=True)
    # the k-th distance so far; without k rows nothing can be skipped
    kth = near.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).otherwise(float("inf")).alias("kth"))
    more = home.withColumnRenamed("ring", "home").join(kth, "qid")
    rest = _meet(index, more.mapInArrow(_routes(sent, False), "qid long, qvec array<double>, ring long"), k, parts)
    both = near.unionByName(rest).checkpoint(eager=True)
    work = both.groupBy("qid").agg(F.sum("compared").alias("compared"))
    top = R.first_k(both.drop("compared"), ["qid"], [F.col("dist").asc(), F.col("doc_id").asc()], k, rank_col="rank")
    return top.join(work, "qid").select("qid", "rank", "doc_id", "dist", "compared")
