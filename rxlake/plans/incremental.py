"""Resumable, incremental build of a document index.

The index is a table ``(id, document, embedding, metadata, content_hash)``.  A build

1. hashes every current document (text and metadata);
2. finds the documents whose (id, hash) the index, or an interrupted build, already
   has.  A Bloom filter of the known hashes goes first: a document that it does
   not hold is certainly new and never enters the join, so with mostly new or
   changed documents their texts are not shuffled.  The rest is decided exactly;
3. embeds only the others, in parts; each part is a table of its own with a
   completeness marker, so an interrupted build loses at most the parts that
   were being written;
4. puts the current documents' rows together and swaps them in (staged write):
   unchanged rows keep their vectors, removed documents go; parts are deleted last.

The encoder is part of the hash (``version``): another model embeds everything anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxlake.functions import text as T
from rxlake.operators import vectors as V
from rxlake.sources import io as IO

PARTS = 16                      # parts of a build, each resumable on its own
BLOOM_BITS = 1 << 22            # of the filter: 512 KiB, whatever the number of documents
STAGE = "_parts"


def content_hash(version: str = "") -> Column:
    """Hash of what a vector depends on, and of the metadata stored beside it."""
    return F.sha2(F.concat_ws("\u001f", F.lit(version), F.coalesce("document", F.lit("")), F.to_json("metadata")), 256)


def _bit() -> Column:
    return F.pmod(F.xxhash64("id", "content_hash"), F.lit(BLOOM_BITS))


def bloom_filter(known: DataFrame) -> Column | None:
    """A condition that holds for every (id, content_hash) of ``known`` and for few
    others; None if nothing is known.  At most ``BLOOM_BITS`` bits reach the driver."""
    words = known.select(_bit().alias("bit")).groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits")).collect()
    if not words:
        return None
    of = dict(words)
    bitmap = F.split(F.lit(",".join(str(of.get(i, 0)) for i in range(BLOOM_BITS // 64))), ",").cast("array<bigint>")
    return F.getbit(F.get(bitmap, F.floor(_bit() / 64).cast("int")), (_bit() % 64).cast("int")) == 1


def build(docs: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame] | None = None, version: str = "hashing",
          parts: int = PARTS, on_part: Callable[[int], None] | None = None) -> dict:
    """Bring the index at ``path`` up to date with ``docs`` (unique ``id``, ``document``,
    ``metadata``; blank documents are skipped, P9).

    ``encode`` adds ``embedding``; without one the hashing vectors are used.
    ``on_part`` is called after each finished part.  Returns the counts
    ``{"kept", "embedded", "resumed", "removed"}``: rows taken over from the index, embedded
    now, taken over from an interrupted build, and index rows without a current document.
    """
    spark = docs.sparkSession
    encode = encode or (lambda df: V.hash_vectors(df, "document"))
    current = docs.where(T.ustrip(F.coalesce(F.col("document"), F.lit(""))) != "").select("id", "document", "metadata") \
        .withColumn("content_hash", content_hash(version))
    index = spark.read.parquet(path) if IO._exists(spark, path) and not IO.half_built(spark, path) else None
    stage = f"{path.rstrip('/')}{STAGE}"
    done = _finished(spark, stage)

    known = [d.select("id", "content_hash") for d in ([index] if index is not None else []) + done]
    todo = current
    if known:
        have = known[0]
        for d in known[1:]:
            have = have.unionByName(d)
        have = have.distinct()
        maybe = bloom_filter(have)
        if maybe is not None:
            todo = current.where(~maybe).unionByName(current.where(maybe).join(have, ["id", "content_hash"], "left_anti"))
    todo = todo.checkpoint(eager=True)          # read once per part
    first = len(done)
    embedded = 0
    for i in range(parts):
        part = todo.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i)
        if not part.isEmpty():
            embedded += IO.write_staged(encode(part).select("id", "document", "embedding", "metadata", "content_hash"),
                                        f"{stage}/part-{first + i:05d}-{uuid.uuid4().hex[:8]}")
        if on_part:
            on_part(i)

    fresh = _finished(spark, stage)
    rows = None
    for d in ([index.withColumn("_from", F.lit(0))] if index is not None else []) + [d.withColumn("_from", F.lit(1)) for d in fresh]:
        rows = d if rows is None else rows.unionByName(d)
    counts = {"kept": 0, "embedded": embedded, "resumed": 0, "removed": 0}
    if rows is None:
        IO.write_staged(current.withColumn("embedding", F.lit(None).cast("array<double>"))
                        .select("id", "document", "embedding", "metadata", "content_hash"), path)
        return counts
    # a document may be in the index and in a part (a build stopped after its swap): one row stays
    final = rows.join(current.select("id", "content_hash"), ["id", "content_hash"], "left_semi").dropDuplicates(["id", "content_hash"])
    had = index.count() if index is not None else 0
    seen = IO.observed_write_staged(final.select("id", "document", "embedding", "metadata", "content_hash", "_from"), path,
                                    {"kept": F.count_if(F.col("_from") == 0)}, leave_out=("_from",))
    counts.update(kept=seen["kept"], resumed=seen["rows"] - seen["kept"] - embedded, removed=had - seen["kept"])
    _delete(spark, stage)
    return counts


def _finished(spark: SparkSession, stage: str) -> list[DataFrame]:
    """The complete parts of an interrupted build."""
    if not IO._exists(spark, stage):
        return []
    fs, jpath = IO._fs(spark, stage)
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folders = sorted(f.getPath().toString() for f in fs.listStatus(jpath) if f.isDirectory())
    return [spark.read.parquet(f) for f in folders
            if ".staging-" not in f and ".old-" not in f and fs.exists(marker(f"{f}/{IO.COMPLETE}"))]


def _delete(spark: SparkSession, folder: str) -> None:
    fs, jpath = IO._fs(spark, folder)
    if fs.exists(jpath):
        fs.delete(jpath, True)
