"""Vector top-k against numpy brute force, encoder plug-in."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from helpers import SF001, rows
from rxlake.operators import vectors as V


def brute(qs, docs, k):
    out = {}
    for qid, qv in qs:
        d = sorted(((float(((np.asarray(v, dtype=np.float64) - qv) ** 2).sum()), i) for i, v in docs))
        out[qid] = [i for _, i in d[:k]]
    return out


def test_knn_matches_brute_force(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    q = V.centroids(emb, "label")
    got = {}
    for qid, rank, doc in rows(V.knn_topk(q, emb, 3), "qid", "rank", "doc_id"):
        got.setdefault(qid, {})[rank] = doc
    qs = [(r[0], np.asarray(r[1])) for r in rows(q, "qid", "qvec")]
    docs = rows(emb, "vec_id", "embedding")
    want = brute(qs, docs, 3)
    assert {k: [v[r] for r in sorted(v)] for k, v in got.items()} == want


def test_chunked_pass_equals_single(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    q = emb.where("vec_id < 40").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    a = sorted(rows(V.knn_topk(q, emb, 2), "qid", "rank", "doc_id"))
    b = sorted(rows(V.knn_topk(q, emb, 2, max_bytes=64 * 8 * 7), "qid", "rank", "doc_id"))
    assert a == b
    # a stored vector is its own nearest neighbour
    assert all(d == qid for qid, r, d in a if r == 1)


def test_empty_collection_contributes_nothing(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    q = V.centroids(emb, "label")
    out = V.two_collection_search(q, emb, emb.where("false"))
    assert {r[0] for r in rows(out, "source")} == {"medicines"}


def test_tie_breaks_by_id(spark):
    docs = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [5.0, 5.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, qvec array<double>")
    assert rows(V.knn_topk(q, docs, 2).orderBy("rank"), "doc_id") == [(1,), (3,)]


def test_encoder_plug_in(spark):
    class Lengths:
        """A model that encodes a text as its length and its batch's size."""

        def encode(self, texts):
            return np.array([[len(t), len(texts)] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([("a b c",), ("",), (None,), ("abcd",)], "t string").coalesce(1)
    out = [r[0] for r in rows(df.select(V.make_encoder(Lengths, batch=3)("t").alias("e")))]
    assert out == [[5.0, 1.0], [0.0, 3.0], [0.0, 3.0], [4.0, 3.0]]      # in order of length: "", null, "abcd" | "a b c"


def test_hash_vectors(spark):
    import hashlib
    texts = ["a b  c", "", None, "a b c", "x x x y", "é \u3000 9"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r[0]: r[1] for r in rows(V.hash_vectors(df, "t"), "id", "embedding")}
    for i, t in enumerate(texts):
        want = np.zeros(64)
        for w in (t or "").split():
            h = hashlib.md5(w.encode()).hexdigest()
            want[int(h[:2], 16) % 64] += 1 if int(h[2], 16) >= 8 else -1
        n = np.linalg.norm(want)
        assert np.allclose(got[i], want / n if n else want)
    assert got[0] == got[3]


def test_more_queries_than_a_tile(spark, monkeypatch):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    q = emb.where("vec_id < 40").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    want = sorted(rows(V.knn_topk(q, emb, 2), "qid", "rank", "doc_id"))
    bc = spark.sparkContext.broadcast((np.array([r[0] for r in rows(q, "qid")]), np.array([r[0] for r in rows(q, "qvec")], float)))
    monkeypatch.setattr(V, "TILE_BYTES", 8 * 300 * 7)
    pdf = emb.select(F.col("vec_id").alias("_id"), F.col("embedding").alias("_v")).toPandas()
    run = V._topk_partition(bc, 2, "l2", "bigint")
    got = []
    for out in run(iter([pdf])):
        for qid, part in out.groupby("qid"):
            part = part.sort_values(["dist", "doc_id"])
            got += [(int(qid), r + 1, int(d)) for r, d in enumerate(part["doc_id"])]
    assert sorted(got) == want


def test_broadcast_collection_path_equals_query_path(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    q = emb.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    small = emb.where("vec_id < 50")
    a = sorted(rows(V.knn_topk(q, small, 3), "qid", "rank", "doc_id"))            # collection broadcast
    qs = [(r[0], np.asarray(r[1])) for r in rows(q, "qid", "qvec")]
    want = brute(qs, rows(small, "vec_id", "embedding"), 3)
    assert {qid: [d for _, r, d in sorted(x for x in a if x[0] == qid)] for qid in want} == want


def test_distances_by_product_are_exact(monkeypatch):
    """Whole numbers, large offsets (cancellation) and many ties against plain differences."""
    monkeypatch.setattr(V, "TILE_BYTES", 8 * 200 * 3)
    rng = np.random.default_rng(4)
    for x, q in ((rng.integers(-3, 4, (200, 3)).astype(float), rng.integers(-3, 4, (20, 3)).astype(float)),
                 (1e7 + rng.normal(0, 1e-3, (200, 5)), 1e7 + rng.normal(0, 1e-3, (20, 5))),
                 (np.repeat(rng.normal(0, 1, (10, 4)), 20, axis=0), rng.normal(0, 1, (20, 4)))):
        ids = rng.permutation(200)
        rows_, dists = V.Collection(ids, x).nearest(q, 7)
        order = np.argsort(ids)
        for j in range(len(q)):
            diff = x[order] - q[j]
            d = np.einsum("ij,ij->i", diff, diff)
            want = np.lexsort((np.arange(200), d))[:7]
            assert list(rows_[j]) == list(want) and (dists[j] == d[want]).all()


def test_search_runs_in_as_many_tasks_as_cores(spark):
    """Neither a tiny collection nor a tiny query table puts the search into one task."""
    docs = spark.range(50).selectExpr("id AS vec_id", "array(CAST(id AS double)) AS embedding").coalesce(1)
    q = spark.range(100).selectExpr("id AS qid", "array(CAST(id AS double)) AS qvec").coalesce(1)
    used = V.knn_topk(q, docs, 1).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used >= spark.sparkContext.defaultParallelism


def test_equal_vectors_compared_once_and_batches_merged(spark):
    """A collection with many copies of few vectors, in many Arrow batches: the same
    result with and without the cut to k ids a vector, equal to brute force."""
    docs = spark.range(300).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("vec_id"), F.array(
        (F.col("id") % 3).cast("double"), (F.col("id") % 2).cast("double")).alias("embedding")).coalesce(1)
    q = spark.createDataFrame([(i, [float(i % 4), 0.25 * i]) for i in range(5)], "qid long, qvec array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cut = sorted(rows(V.knn_topk(q, docs, 4, direct_pairs=0), "qid", "rank", "doc_id", "dist"))
        whole = sorted(rows(V.knn_topk(q, docs, 4), "qid", "rank", "doc_id", "dist"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    every = [(f"d{i}", (i % 3, i % 2)) for i in range(300)]
    want = []
    for qid in range(5):
        near = sorted(((v[0] - qid % 4) ** 2 + (v[1] - 0.25 * qid) ** 2, d) for d, v in every)[:4]
        want += [(qid, r, d, dist) for r, (dist, d) in enumerate(near, 1)]
    assert cut == want and whole == want


def test_large_collection_loses_the_copies_before_the_search(spark):
    docs = spark.range(5000).select("id", F.array((F.col("id") % 2).cast("double")).alias("embedding"))
    q = spark.createDataFrame([(0, [0.0]), (1, [1.0])], "qid long, qvec array<double>")
    seen = []
    run = V._topk_partition
    V._topk_partition = lambda *a: (seen.append(1), run(*a))[1]
    try:       # 6 rows are left of 5000; with few queries they are streamed past them
        got = sorted(rows(V.knn_topk(q, docs, 3, doc_id="id", direct_pairs=1), "qid", "rank", "doc_id"))
    finally:
        V._topk_partition = run
    assert seen and got == [(0, 1, 0), (0, 2, 2), (0, 3, 4), (1, 1, 1), (1, 2, 3), (1, 3, 5)]


def test_hash_vector_remembers_tokens_and_equals_a_plain_version(spark, monkeypatch):
    import hashlib
    texts = ["a b a c d\x1ce", "", None, " x\ny ", "w" * 100, "약 a b", " ".join(f"t{i % 9}" for i in range(500))]

    def plain(text):
        out = [0] * 64
        for t in (text or "").split():
            d = hashlib.md5(t.encode()).hexdigest()
            out[int(d[:2], 16) % 64] += 1 if int(d[2], 16) >= 8 else -1
        return out
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(rows(V.hash_vectors(df, "t", unit=False), "i", "embedding"))
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    unit = dict(rows(V.hash_vectors(df, "t"), "i", "embedding"))
    for i, t in enumerate(texts):
        n = sum(x * x for x in plain(t)) ** 0.5
        assert unit[i] == [x / (n or 1.0) for x in plain(t)]
    # hashed once while it is remembered, and again when the memory was full
    calls, md5 = [], hashlib.md5
    monkeypatch.setattr(V.hashlib, "md5", lambda b: (calls.append(b), md5(b))[1])
    model = V.HashingModel()
    assert model.encode(["a b a", "b a"]).tolist() == [plain("a b a"), plain("b a")]
    assert set(calls) >= {b"a", b"b"}
    calls.clear()
    model.encode(["a b a b"])
    assert not calls
    monkeypatch.setattr(V, "TOKENS_KEPT", 2)
    assert model.encode(["c a", "b a"]).tolist() == [plain("c a"), plain("b a")]


def test_rows_after_the_first_block_are_found_by_one_comparison(spark, monkeypatch):
    """Blocks in the order of ids: selections run on the first block and on tiles with many
    close rows only; whole numbers, fractions, cosine, ties and rows that come ever closer."""
    rng = np.random.default_rng(7)
    monkeypatch.setattr(V, "FIRST_ROWS", 8)
    monkeypatch.setattr(V, "CLOSE_TILE_BYTES", 8 * 64 * 5)
    cases = [(rng.integers(-2, 3, (600, 4)).astype(float), rng.integers(-2, 3, (30, 4)).astype(float), "l2"),
             (rng.integers(-9000, 9000, (600, 4)).astype(float), rng.integers(-9000, 9000, (30, 4)).astype(float), "l2"),
             (1e7 + rng.normal(0, 1e-3, (600, 5)), 1e7 + rng.normal(0, 1e-3, (30, 5)), "l2"),
             (np.arange(600, 0, -1.0)[:, None], np.zeros((30, 1)), "l2"),
             (rng.normal(0, 1, (600, 4)), rng.normal(0, 1, (30, 4)), "cosine")]
    for x, q, metric in cases:
        ids = np.sort(np.array([f"d{i}" for i in range(600)]))
        bc = spark.sparkContext.broadcast((np.arange(30), q))
        chosen = []
        nearest = V.Collection.nearest
        monkeypatch.setattr(V.Collection, "nearest", lambda self, *a: (chosen.append(len(a[0]) * len(self.ids)), nearest(self, *a))[1])
        pdfs = [pd.DataFrame({"_id": ids[i:i + 90], "_v": list(x[i:i + 90])}) for i in range(0, 600, 90)]
        out, = V._topk_partition(bc, 3, metric, "string")(iter(pdfs))
        monkeypatch.setattr(V.Collection, "nearest", nearest)
        if metric == "cosine":
            d = 1 - (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
        else:
            d = ((x[None] - q[:, None]) ** 2).sum(axis=2)
        want = [np.lexsort((ids, row))[:3] for row in d]
        assert out["doc_id"].tolist() == [ids[i] for w in want for i in w]
        assert np.allclose(out["dist"], [row[i] for row, w in zip(d, want) for i in w])
        if len(x[0]) == 4:      # neither ever closer nor lost to cancellation
            assert sum(chosen) < 30 * 600 / 2


def test_cut_to_first_of_equal_vectors_reads_no_array_in_its_sort(spark):
    """Null and whole components, fractions, signs and NaN keep their vectors apart; the sort is by text."""
    vecs = [[1.0, None], [1.0], [None, 1.0], [0.1, 0.2], [float("nan"), 1.0], [-1.0, 1.0]]
    df = spark.createDataFrame([(i, vecs[i % 6]) for i in range(60)], "_id long, _v array<double>")
    cut = V._first_of_equal(df, 2)
    assert sorted(r[0] for r in rows(cut, "_id")) == list(range(12))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "_hash" in plan and "normalizenanandzero" not in plan


def test_different_vectors_are_not_cut(spark, monkeypatch):
    """Nothing to gain from a shuffle of all vectors when they differ."""
    docs = spark.range(2000).select("id", F.array(F.col("id").cast("double")).alias("embedding"))
    q = spark.createDataFrame([(0, [0.0]), (1, [1999.0])], "qid long, qvec array<double>")
    monkeypatch.setattr(V, "_first_of_equal", lambda *a: 1 / 0)
    got = sorted(rows(V.knn_topk(q, docs, 2, doc_id="id", direct_pairs=1), "qid", "rank", "doc_id"))
    assert got == [(0, 1, 0), (0, 2, 1), (1, 1, 1999), (1, 2, 1998)]
