"""Incremental, resumable index build."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from rxlake.operators import vectors as V
from rxlake.plans import incremental as I


def documents(spark, items):
    df = spark.createDataFrame(items, "id string, document string, name string")
    return df.select("id", "document", F.struct("name").alias("metadata"))


def content(spark, path):
    return sorted((r.id, r.document, r.metadata.name, tuple(r.embedding)) for r in spark.read.parquet(path).collect())


def full(spark, docs):
    kept = docs.where("trim(coalesce(document, '')) <> ''")
    return sorted((r.id, r.document, r.metadata.name, tuple(r.embedding)) for r in V.hash_vectors(kept, "document").collect())


BASE = [(f"d{i}", f"words {i} of text {i % 5}", "n") for i in range(40)] + [("blank", "  ", "n"), ("null", None, "n")]


def test_second_run_embeds_nothing_and_changes_are_followed(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = documents(spark, BASE)
    assert I.build(docs, path, parts=3) == {"kept": 0, "embedded": 40, "resumed": 0, "removed": 0}
    assert content(spark, path) == full(spark, docs)

    calls = []
    encode = lambda df: calls.append(1) or V.hash_vectors(df, "document")
    assert I.build(docs, path, encode, parts=3) == {"kept": 40, "embedded": 0, "resumed": 0, "removed": 0}
    assert not calls

    changed = documents(spark, [("d0", "another text", "n"), ("d1", "words 1 of text 1", "renamed"), *BASE[5:], ("new", "brand new", "n")])
    assert I.build(changed, path, parts=3) == {"kept": 35, "embedded": 3, "resumed": 0, "removed": 5}
    assert content(spark, path) == full(spark, changed)
    assert I.build(documents(spark, BASE), path, version="another model", parts=3)["embedded"] == 40


def test_interrupted_build_goes_on(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = documents(spark, BASE)

    def stop(i):
        if i == 1:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        I.build(docs, path, parts=4, on_part=stop)
    first = sum(d.count() for d in I._finished(spark, path + I.STAGE))
    assert 0 < first < 40
    # a part without its marker was being written: it is not used
    spark.createDataFrame([("d3", "wrong")], "id string, document string").write.parquet(f"{path}{I.STAGE}/part-00099-x")
    assert I.build(docs, path, parts=4) == {"kept": 0, "embedded": 40 - first, "resumed": first, "removed": 0}
    assert content(spark, path) == full(spark, docs)
    assert not I.IO._exists(spark, path + I.STAGE)


def test_bloom_filter_holds_all_known(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOOM_BITS", 256)
    known = spark.range(20).select(F.col("id").cast("string").alias("id"), F.lit("h").alias("content_hash"))
    others = spark.range(1000, 1400).select(F.col("id").cast("string").alias("id"), F.lit("h").alias("content_hash"))
    maybe = I.bloom_filter(known)
    assert known.where(maybe).count() == 20
    assert 0 < others.where(maybe).count() < 120
    assert I.bloom_filter(known.where("false")) is None


def test_empty_documents(spark, tmp_path):
    path = str(tmp_path / "index")
    assert I.build(documents(spark, [("a", "", "n")]), path) == {"kept": 0, "embedded": 0, "resumed": 0, "removed": 0}
    assert spark.read.parquet(path).count() == 0


def test_encoder_batches_by_length(spark):
    """Vectors do not depend on batching or partitioning; a micro-batch holds texts of like length."""
    texts = [("w%d " % i) * (i * 7 % 50) for i in range(120)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    want = {r[0]: r[1] for r in rows(V.hash_vectors(df, "t", unit=False), "id", "embedding")}
    for parts, batch, chars in ((1, 64, 1 << 20), (5, 3, 1 << 20), (2, 64, 40)):
        got = rows(df.repartition(parts).select("id", V.make_encoder(V.HashingModel, batch, chars)("t").alias("e")), "id", "e")
        assert {i: list(e) for i, e in got} == want

    class Spread:
        def encode(self, batch):
            return np.array([[max(map(len, batch)) - min(map(len, batch))]] * len(batch))

    spread = lambda n: max(r[0][0] for r in rows(df.coalesce(1).select(V.make_encoder(Spread, n)("t").alias("e"))))
    assert spread(8) < 40 < spread(1000)
