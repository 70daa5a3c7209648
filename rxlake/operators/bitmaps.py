"""Bitmap attribute index (Q2, P11): which catalogue items hold which value.

Items get dense numbers in the catalogue's order, so "the first k matches" are
the k lowest set bits.  The index has one bitmap of 32,768 bits per (kind of
attribute, value, bucket of item numbers), made with Spark's bitmap aggregates,
which combine map-side: a value that a third of the catalogue holds is a few
kilobytes per bucket in every task, not a list of its items.

A request's term is matched with the distinct values (few), their bitmaps are
or-ed once per term, and a request for several kinds and-s the bitmaps of its
own terms alone.  Rows in between are (request, bucket) pairs; pairs of terms that
nobody asked for are never built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rxlake.functions import text as T
from rxlake.operators import lookup as L
from rxlake.operators import rank as R

BITS = 32_768           # of one bitmap of Spark's aggregates


def number_items(items: DataFrame, order: list) -> DataFrame:
    """``items`` with a dense number ``_no`` from 1 in ``order`` (which ends in a unique key)."""
    return R.sequential_ids(items, order, id_col="_no")


def build_index(numbered: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """Rows ``(kind, value_fold, bucket, bits)``; ``kinds`` names the columns of each
    kind of attribute (an item with one value in two columns counts once)."""
    def of(kind: str, columns: list[str]) -> Column:
        values = F.array_distinct(F.array_compact(F.array(*[T.fold_ascii(c) for c in columns])))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value_fold")))

    held = numbered.select("_no", F.explode(F.flatten(F.array(*[of(k, c) for k, c in kinds.items()]))).alias("a"))
    return held.groupBy("a.kind", "a.value_fold", F.bitmap_bucket_number("_no").alias("bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_no")).alias("bits"))


def term_bitmaps(terms: DataFrame, index: DataFrame) -> DataFrame:
    """Rows ``(kind, term, bucket, bits)``: the items with a value of the kind that is
    ``LIKE '%term%'``; ``terms`` has the columns ``kind`` and ``term``.  Values of all
    kinds are matched in one pass, and joined by kind afterwards."""
    pairs = L.name_matches(terms, index.select("value_fold").distinct(), "term", "value_fold")
    return terms.distinct().join(pairs, "term").join(index, ["kind", "value_fold"]) \
        .groupBy("kind", "term", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


PIECE = 64              # bytes that are skipped at once where no bit is set


def lowest_bits(bits: Column, k: int) -> Column:
    """The first ``k`` set positions of a bitmap, ascending (from 0): pieces with a
    bit, then their bytes, then the bits, each cut to the first ``k``."""
    def part(size: int, i: Column) -> Column:
        return F.substr(bits, i * size + 1, F.lit(size))

    def first(size: int, numbers: Column) -> Column:
        return F.slice(F.filter(numbers, lambda i: part(size, i) != F.lit(bytearray(size))), 1, k)

    def inside(numbers: Column, n: int) -> Column:
        return F.flatten(F.transform(numbers, lambda i: F.sequence(i * n, i * n + (n - 1))))

    used = first(1, inside(first(PIECE, F.sequence(F.lit(0), F.lit(BITS // 8 // PIECE - 1))), PIECE))
    each = F.transform(used, lambda i: F.struct(i.alias("at"), F.conv(F.hex(part(1, i)), 16, 10).cast("int").alias("byte")))
    found = F.transform(each, lambda e: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.getbit(e["byte"], b) == 1), lambda b: e["at"] * 8 + b))
    return F.slice(F.flatten(found), 1, k)


def first_items(requests: DataFrame, index: DataFrame, kinds: list[str], key: str, k: int) -> DataFrame:
    """Rows ``(key, rank, _no)``: the first ``k`` items of every request.

    ``requests`` has a unique ``key`` and a term column per kind; an absent term
    (null or empty) adds no condition, and a request without any has no rows.
    """
    terms = F.filter(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("term")) for c in kinds]),
                     lambda t: F.coalesce(t["term"] != "", F.lit(False)))
    asked = requests.select(key, terms.alias("_terms")).select(key, F.size("_terms").alias("_asked"), F.explode("_terms").alias("_t")) \
        .select(key, "_asked", "_t.*")
    both = asked.join(term_bitmaps(asked.select("kind", "term"), index), ["kind", "term"]).groupBy(key, "_asked", "bucket") \
        .agg(F.count(F.lit(1)).alias("_n"), F.bitmap_and_agg("bits").alias("bits")) \
        .where(F.col("_n") == F.col("_asked")).withColumn("_held", F.bitmap_count("bits")).where("_held > 0")
    before = W.partitionBy(key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    near = both.withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0))).where(F.col("_before") < k)
    hits = near.select(key, "bucket", "_before", F.posexplode(lowest_bits(F.col("bits"), k)).alias("_at", "_bit"))
    return hits.select(key, (F.col("_before") + F.col("_at") + 1).cast("int").alias("rank"),
                       ((F.col("bucket") - 1) * BITS + F.col("_bit") + 1).alias("_no")).where(F.col("rank") <= k)
