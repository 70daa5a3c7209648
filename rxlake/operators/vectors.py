"""Document index and vector search.

* V1/V2 encoder plug-in: an iterator-style pandas UDF; the model object is
  created once per Python worker and fed Arrow batches, in inner batches of
  64 texts (``make_encoder``).  No model ships offline, so the default is a
  deterministic feature-hashing encoder in Arrow batches (``hash_vector``).
* V3 exact top-k (squared L2, the vector store's default; cosine optional):
  the query set, after a size check, is broadcast; each partition of the
  collection computes distances with numpy and keeps its local top-k per
  query; a final first-k per query merges ``k x partitions`` candidates.  A
  query set above the limit is processed in chunks, each one a distributed
  pass whose (final) top-k is written to the shared checkpoint folder, so
  the plan stays small however many chunks there are and a finished chunk
  survives a failure.  Results are exact in every case.  A collection that
  is derived rather than stored should be materialised by the caller: it is
  counted, read, and joined with its metadata.
"""

from __future__ import annotations

import copy
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from rxlake import fixed_values as FV
from rxlake.operators import rank as R
from rxlake.session import shuffle_partitions
from rxlake.sources import io as IO

QUERY_BROADCAST_BYTES = 64 << 20   # max bytes of query vectors shipped per pass
TILE_BYTES = 64 << 20              # max bytes of distances held by a worker
DIRECT_PAIRS = 1 << 30             # query x document pairs above which equal vectors are compared once
TOKENS_KEPT, TOKEN_KEPT_CHARS = 1 << 18, 64     # of a worker's memory of hashed tokens
COUNTED_ROWS, COUNTED_TOKENS = 256, 1 << 16     # texts (and, but for the last text, tokens) counted together
FIRST_ROWS = 256                   # of a partition searched without a k-th distance; later blocks are twice as long each
CLOSE_TILE_BYTES = 16 << 20        # distances held while rows below the k-th distance are looked for
MANY_CLOSE = 16                    # close rows a query and k, above which a tile is searched by ``nearest``


# ------------------------------------------------------------------ encoders ---
def _token_numbers(dim: int) -> Callable[[list], list]:
    """Numbers of a list of tokens: ``coordinate``, or ``dim + coordinate`` for the sign
    minus.  A worker keeps those of the last ``TOKENS_KEPT`` different tokens at most."""
    known: dict = {}

    def number(token: str) -> int:
        if token in known:      # repeated in the text that brought it
            return known[token]
        digest = hashlib.md5(token.encode()).hexdigest()
        n = int(digest[:2], 16) % dim + (0 if int(digest[2], 16) >= 8 else dim)
        if len(known) >= TOKENS_KEPT:
            known.clear()
        if len(token) <= TOKEN_KEPT_CHARS:
            known[token] = n
        return n

    def numbers(tokens: list) -> list:
        found = list(map(known.get, tokens))
        return [number(t) if n is None else n for t, n in zip(tokens, found)] if None in found else found
    return numbers


def _token_counts(numbers: Callable[[list], list], texts: list, dim: int) -> np.ndarray:
    """Vectors of texts given as their tokens, texts x dim, by one count for a block of texts."""
    out = np.zeros((len(texts), dim))
    at = 0
    while at < len(texts):
        end, tokens = at, []
        while end < len(texts) and (end == at or (end - at < COUNTED_ROWS and len(tokens) < COUNTED_TOKENS)):
            tokens += texts[end]
            end += 1
        row = np.repeat(np.arange(end - at), [len(t) for t in texts[at:end]])
        n = np.bincount(row * (2 * dim) + np.array(numbers(tokens), np.int64), minlength=(end - at) * 2 * dim).reshape(end - at, 2 * dim)
        out[at:end] = n[:, :dim] - n[:, dim:]
        at = end
    return out


def hash_vector(text: Column, dim: int = 64, unit: bool = True) -> Column:
    """Feature-hashing vector of a text (stand-in for a sentence model, which
    does not ship offline), from the row's own tokens: no shuffle.

    The first two hex digits of a token's MD5 pick the coordinate, the third the
    sign.  ``unit`` scales the vector to length 1; a text without tokens gets zeros.
    Python's ``str.split`` cuts at the characters of ``text.WS``; the text goes to the
    worker as bytes, so malformed UTF-8 is replaced instead of failing the task.
    """
    @F.arrow_udf(Ty.ArrayType(Ty.DoubleType()))
    def vectors(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        numbers = _token_numbers(dim)
        for texts in it:
            out = np.zeros((len(texts), dim))
            for i in range(0, len(texts), COUNTED_ROWS):
                out[i:i + COUNTED_ROWS] = _token_counts(numbers, [(t or b"").decode("utf-8", "replace").split() for t in
                                                                  texts.slice(i, COUNTED_ROWS).to_pylist()], dim)
            if unit:
                norm = np.sqrt(np.einsum("ij,ij->i", out, out))
                out /= np.where(norm > 0, norm, 1.0)[:, None]
            at = np.arange(0, out.size + 1, dim, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(at), pa.array(out.ravel()))
    return vectors(F.coalesce(text, F.lit("")).cast("binary"))


def hash_vectors(df: DataFrame, text: str, dim: int = 64, out: str = "embedding", unit: bool = True) -> DataFrame:
    """Rows of ``df`` with the hashing vector of a text column."""
    return df.withColumn(out, hash_vector(F.col(text), dim, unit))


def make_encoder(factory: Callable[[], object], batch: int = FV.EMBED_BATCH, max_chars: int = 1 << 20):
    """V1/V2: pandas UDF ``string -> array<float>`` around ``factory().encode``
    (a real sentence model).

    The model is built once per Python worker (iterator UDF).  The texts of an
    Arrow batch are encoded in order of their length, in micro-batches of up to
    ``batch`` texts (the original encodes 64 at a time) and ``max_chars`` characters
    (one text at least), so a model that pads to the longest text of a batch
    pads little; vectors go back to their rows.  A model whose vectors do not depend
    on the other texts gives the same result for any partitioning.
    """
    @F.pandas_udf(Ty.ArrayType(Ty.FloatType()))
    def encode(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in it:
            vals = texts.fillna("").tolist()
            order = sorted(range(len(vals)), key=lambda i: len(vals[i]))
            out: list = [None] * len(vals)
            at = 0
            while at < len(order):
                end, chars = at, 0
                while end < len(order) and end - at < batch and (end == at or chars + len(vals[order[end]]) <= max_chars):
                    chars += len(vals[order[end]])
                    end += 1
                for i, row in zip(order[at:end], model.encode([vals[i] for i in order[at:end]])):
                    out[i] = np.asarray(row, dtype=np.float32)
                at = end
            yield pd.Series(out)
    return encode


class HashingModel:
    """A deterministic stand-in for a sentence model, with its ``encode``: the
    whole-number vectors of ``hash_vector``, computed in Python."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._numbers = _token_numbers(dim)

    def encode(self, texts: list) -> np.ndarray:
        return _token_counts(self._numbers, [text.split() for text in texts], self.dim).astype(np.float32)


# ------------------------------------------------------------------- queries ---
def centroids(vectors: DataFrame, group: str, vec: str = "embedding", id_col: str = "qid") -> DataFrame:
    """Mean vector per group (used to derive query vectors from a table).

    Element-wise mean by ``Summarizer``, one vector buffer per group, combined
    map-side.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = array_to_vector(F.transform(vec, lambda x: x.cast("double")))
    means = vectors.select(F.col(group).alias(id_col), v.alias("_v")).groupBy(id_col).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return means.select(id_col, vector_to_array("_m").alias("qvec"))


def _ids(s: pd.Series, id_type: str) -> np.ndarray:
    return s.to_numpy().astype(str) if id_type == "string" else s.to_numpy()


def _rows_to_matrix(pdf: pd.DataFrame, col: str) -> np.ndarray:
    return np.vstack(pdf[col].map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())


class Collection:
    """Vectors in the order of their ids, ready for nearest-neighbour search of
    whole tiles of queries.

    Squared L2 distances come from one matrix product a tile, ``|x|^2 - 2xq +
    |q|^2``.  For whole-number vectors below 2^53 that is exact.  Otherwise it only
    preselects: rows within the rounding error of the k-th distance are computed
    anew by differences, so no digit is lost to cancellation.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, metric: str = "l2"):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.metric = ids[order], vectors[order], metric
        if metric == "cosine":
            self.x = self.x / np.maximum(np.linalg.norm(self.x, axis=1, keepdims=True), 1e-300)
        self.norms = np.einsum("ij,ij->i", self.x, self.x)
        self.whole = bool((self.x == np.rint(self.x)).all())

    def block(self, at: int, end: int) -> Collection:
        """Rows ``at`` to ``end`` in the order of ids."""
        part = copy.copy(self)
        part.ids, part.x, part.norms = self.ids[at:end], self.x[at:end], self.norms[at:end]
        return part

    def _distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances, how far each query's may be off)."""
        if self.metric == "cosine":
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            return 1.0 - q @ self.x.T, np.zeros(len(q))
        own = np.einsum("ij,ij->i", q, q)
        most = own + self.norms.max()
        exact = self.whole and bool((q == np.rint(q)).all()) and bool((4 * most < 2 ** 53).all())
        if exact and (4 * most < 2 ** 24).all():        # whole numbers that single precision holds
            small = np.float32
            return own.astype(small)[:, None] - 2 * (q.astype(small) @ self.x.astype(small).T) + self.norms.astype(small)[None], np.zeros(len(q))
        off = np.zeros(len(q)) if exact else 8 * (self.x.shape[1] + 4) * np.finfo(float).eps * most
        return own[:, None] - 2 * (q @ self.x.T) + self.norms[None], off

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, distances), both queries x min(k, rows); ties by id."""
        n = len(self.ids)
        kk = min(k, n)
        rows, dists = np.zeros((len(queries), kk), np.int64), np.zeros((len(queries), kk))
        size = max(1, TILE_BYTES // (8 * n))
        for at in range(0, len(queries), size):
            q = queries[at:at + size]
            d, off = self._distances(q)
            kth = np.partition(d, kk - 1, axis=1)[:, kk - 1]
            for j in range(len(q)):
                if off[j]:
                    near = np.flatnonzero(d[j] <= kth[j] + 2 * off[j])
                    diff = self.x[near] - q[j]
                    dist = np.einsum("ij,ij->i", diff, diff)
                else:       # of the rows at the k-th distance only the first in id order can be needed
                    near = np.concatenate([np.flatnonzero(d[j] < kth[j]), np.flatnonzero(d[j] == kth[j])[:kk]])
                    dist = d[j, near]
                best = np.lexsort((near, dist))[:kk]
                rows[at + j], dists[at + j] = near[best], dist[best]
        return rows, dists

    def closer(self, queries: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query numbers, row numbers, distances) of rows that can be among the first ``k`` when
        each query has ``k`` rows of lower ids already, the last at distance ``kth``; in the order
        of queries and rows, a tile of queries at a time.

        Only lower distances count, as a tie goes to the lower id.  So a tile costs one product
        and one comparison, without a selection; in single precision where that is exact.
        """
        n = len(self.ids)
        own = np.einsum("ij,ij->i", queries, queries)
        most = (own.max() + self.norms.max()) if len(queries) else 0.0
        exact = self.metric != "cosine" and self.whole and bool((queries == np.rint(queries)).all()) and bool(4 * most < 2 ** 53)
        if exact:       # |x|^2 - 2xq < kth - |q|^2
            kind = np.float32 if 4 * most < 2 ** 24 else np.float64
            x = np.concatenate([self.x, self.norms[:, None]], axis=1).astype(kind).T
            asked = np.concatenate([-2 * queries, np.ones((len(queries), 1))], axis=1).astype(kind)
            bound = (kth - own).astype(kind)
        size = max(1, CLOSE_TILE_BYTES // (8 * n))
        for at in range(0, len(queries), size):
            q, limit = queries[at:at + size], kth[at:at + size]
            if exact:
                d = asked[at:at + size] @ x
                near = np.flatnonzero(d < bound[at:at + size, None])
            else:
                d, off = self._distances(q)
                near = np.flatnonzero((d < limit[:, None]) | ((off > 0)[:, None] & (d <= (limit + 2 * off)[:, None])))
            if len(near) > MANY_CLOSE * k * len(q):
                rows, dists = self.nearest(q, k)
                who, rows, dists = np.repeat(np.arange(len(q)), rows.shape[1]), rows.ravel(), dists.ravel()
            else:
                who, rows = np.divmod(near, n)
                if exact:
                    dists = d.ravel()[near] + own[at + who]
                elif off.any():
                    diff = self.x[rows] - q[who]
                    dists = np.einsum("ij,ij->i", diff, diff)
                else:
                    dists = d.ravel()[near]
            kept = dists < limit[who]
            if kept.any():
                yield at + who[kept], rows[kept], dists[kept]

    def table(self, qids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
        """Rows (qid, rank, doc_id, dist)."""
        rows, dists = self.nearest(queries, k)
        kk = rows.shape[1]
        return pd.DataFrame({"qid": np.repeat(qids, kk), "rank": np.tile(np.arange(1, kk + 1, dtype=np.int32), len(qids)),
                             "doc_id": self.ids[rows.ravel()], "dist": dists.ravel()})


class _Nearest:
    """The first ``k`` rows of every query, of blocks of a collection in the order of their ids."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k, self.ids, self.dists = queries, k, None, None

    def add(self, block: Collection) -> None:
        if self.ids is None or self.ids.shape[1] < self.k:
            rows, d = block.nearest(self.queries, self.k)
            found = block.ids[rows]
            if self.ids is not None:
                found, d = np.concatenate([self.ids, found], axis=1), np.concatenate([self.dists, d], axis=1)
                best = np.argsort(d, axis=1, kind="stable")[:, :self.k]
                found, d = np.take_along_axis(found, best, 1), np.take_along_axis(d, best, 1)
            self.ids, self.dists = found, d
            return
        for who, rows, d in block.closer(self.queries, self.dists[:, -1].copy(), self.k):
            asked = np.unique(who)
            who = np.concatenate([np.repeat(asked, self.k), who])
            d = np.concatenate([self.dists[asked].ravel(), d])
            ids = np.concatenate([self.ids[asked].ravel(), block.ids[rows]])
            order = np.lexsort((d, who))            # stable: those found earlier have the lower ids
            best = order[np.searchsorted(who[order], asked)[:, None] + np.arange(self.k)]
            self.ids = self.ids.astype(ids.dtype, copy=False)
            self.ids[asked], self.dists[asked] = ids[best], d[best]


def _topk_partition(bc, k: int, metric: str, id_type: str):
    """mapInPandas over a collection in the order of its ids: the partition's top-k of
    every broadcast query, kept from block to block."""
    def run(it):
        qids, queries = bc.value
        top, size = _Nearest(queries, k), FIRST_ROWS
        for pdf in it:
            if len(pdf):
                part = Collection(_ids(pdf["_id"], id_type), _rows_to_matrix(pdf, "_v"), metric)
                at = 0
                while at < len(part.ids):
                    top.add(part.block(at, at + size))
                    at, size = at + size, min(2 * size, 1 << 20)
        if top.ids is not None:
            yield pd.DataFrame({"qid": np.repeat(qids, top.ids.shape[1]), "doc_id": top.ids.ravel(), "dist": top.dists.ravel()})
    return run


def _scan_queries(bc, k: int):
    """mapInPandas over query batches against a broadcast collection: the
    whole collection is here, so the top-k is final per query."""
    def run(it):
        for pdf in it:
            if len(pdf):
                yield bc.value.table(pdf["qid"].to_numpy(), _rows_to_matrix(pdf, "qvec"), k)
    return run


def _spread(df: DataFrame) -> DataFrame:
    """An explicit repartition: the search is CPU work, and a few megabytes of
    vectors would otherwise be coalesced into one task."""
    sc = df.sparkSession.sparkContext
    return df.repartition(max(sc.defaultParallelism, shuffle_partitions(df.sparkSession)))


def _first_of_equal(d: DataFrame, k: int) -> DataFrame:
    """The ``k`` lowest ids of every distinct vector.  Vectors are compared as text, written
    once a row, and by its hash first: a window on the array itself would take it apart
    anew for every comparison of the sort."""
    text = F.array_join(F.col("_v").cast("array<string>"), ",", "null")
    keyed = d.withColumn("_key", text).withColumn("_hash", F.xxhash64("_key"))
    return R.first_k(keyed, ["_hash", "_key"], ["_id"], k).drop("_hash", "_key")


def knn_topk(queries: DataFrame, docs: DataFrame, k: int = FV.VECTOR_TOP_K, qid: str = "qid",
             qvec: str = "qvec", doc_id: str = "vec_id", doc_vec: str = "embedding",
             metric: str = "l2", max_bytes: int = QUERY_BROADCAST_BYTES,
             direct_pairs: int = DIRECT_PAIRS) -> DataFrame:
    """V3: exact top-k documents per query; rows ``(qid, rank, doc_id, dist)``.

    Ties in distance break by the lower document id.  The smaller side is
    broadcast after a size check (rows x dim x 8 bytes within ``max_bytes``):

    * small collection (the catalogue case: tens of thousands of pills):
      broadcast it and stream the queries; each query's top-k is final;
    * small query set: broadcast the queries and stream the collection; each
      partition keeps a local top-k per query, merged by a partial+final
      group limit;
    * both large: the query set is cut into chunks that fit, each chunk one
      distributed pass over the collection, its final top-k written to the
      shared checkpoint folder (a small plan per chunk, not a union of all).

    Above ``direct_pairs`` comparisons a collection of copies is first cut to the ``k``
    lowest ids of every distinct vector: no other row of a vector can be among a
    query's first ``k``.  Where the vectors differ that would remove little, and
    is left out.  A collection read as a few files is spread over the cores.
    """
    spark = docs.sparkSession
    q = queries.select(F.col(qid).cast("long").alias("qid"), F.col(qvec).alias("qvec"))
    d = docs.select(F.col(doc_id).alias("_id"), F.col(doc_vec).alias("_v"))
    id_type = dict(d.dtypes)["_id"]
    if id_type not in ("string", "bigint"):
        d = d.withColumn("_id", F.col("_id").cast("long"))
        id_type = "bigint"
    qn = q.count()
    dn, dim, different = d.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("_v")), F.lit(1)),
                               F.approx_count_distinct(F.xxhash64("_v"))).first()
    if qn == 0 or dn == 0:
        return spark.createDataFrame([], f"qid long, rank int, doc_id {id_type}, dist double")
    dim = max(1, dim)
    per_pass = max(1, max_bytes // (8 * dim))
    if qn * dn > direct_pairs and 2 * k * different < dn:       # an estimate: it chooses the way, never the rows
        d = _first_of_equal(d, k).checkpoint(eager=True)
        dn = d.count()
    if dn <= per_pass and dn <= qn:
        pdf = d.toPandas()  # bounded: dn * dim * 8 <= max_bytes
        bc = spark.sparkContext.broadcast(Collection(_ids(pdf["_id"], id_type), _rows_to_matrix(pdf, "_v"), metric))
        return _spread(q).mapInPandas(_scan_queries(bc, k), f"qid long, rank int, doc_id {id_type}, dist double")
    schema = f"qid long, doc_id {id_type}, dist double"
    order = [F.col("dist").asc(), F.col("doc_id").asc()]

    sent: list = []

    def pass_over(chunk: DataFrame) -> DataFrame:
        pdf = chunk.toPandas()  # bounded by max_bytes, checked above
        bc = spark.sparkContext.broadcast((pdf["qid"].to_numpy(), _rows_to_matrix(pdf, "qvec")))
        sent.append(bc)
        by_id = F.coalesce("_id", F.lit("None")) if id_type == "string" else F.col("_id").asc_nulls_last()
        local = IO.spread(d).sortWithinPartitions(by_id).mapInPandas(_topk_partition(bc, k, metric, id_type), schema)
        return R.first_k(local, ["qid"], order, k, rank_col="rank").select("qid", "rank", "doc_id", "dist")

    if qn <= per_pass:
        return pass_over(q)
    # chunks hold disjoint queries, so each chunk's top-k is final: write
    # each to the shared checkpoint folder and read them back as one table
    from rxlake.session import ensure_checkpoint_dir
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/knn-{uuid.uuid4().hex}"
    qs = R.sequential_ids(q, ["qid"], id_col="_qseq")
    for i in range((qn + per_pass - 1) // per_pass):
        ch = qs.where((F.col("_qseq") > i * per_pass) & (F.col("_qseq") <= (i + 1) * per_pass)).drop("_qseq")
        pass_over(ch).write.mode("overwrite").parquet(f"{base}/chunk={i}")
        sent.pop().destroy()
    return spark.read.parquet(base).select("qid", "rank", "doc_id", "dist")


def two_collection_search(queries: DataFrame, first: DataFrame, second: DataFrame,
                          names=("medicines", "drug_info"), k: int = FV.VECTOR_TOP_K, **kw) -> DataFrame:
    """Top-k from each collection, tagged with its source; the first
    collection's hits come first (no global re-rank).  An empty collection
    contributes nothing."""
    a = knn_topk(queries, first, k, **kw).withColumn("source", F.lit(names[0])).withColumn("source_rank", F.lit(1))
    b = knn_topk(queries, second, k, **kw).withColumn("source", F.lit(names[1])).withColumn("source_rank", F.lit(2))
    return a.unionByName(b)
