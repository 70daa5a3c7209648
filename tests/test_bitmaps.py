"""Bitmap attribute index against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from rxlake.operators import bitmaps as B


def test_lowest_bits(spark):
    rnd = random.Random(1)
    sets = [sorted(rnd.sample(range(B.BITS), n)) for n in (1, 3, 40)] + [[0], [B.BITS - 1], list(range(100)), [7, 8, 511, 512, 32767]]
    df = spark.createDataFrame([(i, p + 1) for i, s in enumerate(sets) for p in s], "i int, n long") \
        .groupBy("i").agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("b"))
    got = dict(rows(df.select("i", B.lowest_bits(F.col("b"), 5))))
    assert got == {i: s[:5] for i, s in enumerate(sets)}


@pytest.mark.parametrize("bits", [B.BITS])
def test_first_items_equal_plain_loops(spark, bits):
    rnd = random.Random(2)
    shapes, colours = ["Round", "ROUND flat", "oval", None, ""], ["red", "Reddish", "blue", "", None]
    items = [(i, f"n{rnd.randrange(500):03d}", rnd.choice(shapes) if i % 3 else "Round", rnd.choice(colours), rnd.choice(colours))
             for i in range(700)]                                  # one shape holds a third of the items
    asked = [(f"{s}|{c}", s, c) for s in ("round", "OVAL", "flat", "none", "r_und", "", None) for c in ("red", "blue", "%", "", None)]
    df = spark.createDataFrame(items, "id int, name string, shape string, c1 string, c2 string").repartition(5)
    numbered = B.number_items(df, ["name", "id"])
    index = B.build_index(numbered, {"shape": ["shape"], "color": ["c1", "c2"]})
    req = spark.createDataFrame(asked, "key string, shape string, color string")
    top = B.first_items(req, index, ["shape", "color"], "key", 4).join(numbered.select("_no", "id"), "_no")
    got = sorted(rows(top, "key", "rank", "id"))

    def like(value, term):
        import re
        pattern = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in term.lower())
        return value is not None and re.search(f"(?s){pattern}", value.lower()) is not None

    want = []
    for key, s, c in asked:
        if not s and not c:
            continue
        ok = [i for i in sorted(items, key=lambda r: (r[1], r[0]))
              if (not s or like(i[2], s)) and (not c or like(i[3], c) or like(i[4], c))]
        want += [(key, n + 1, i[0]) for n, i in enumerate(ok[:4])]
    assert got == sorted(want)


def test_items_beyond_one_bitmap(spark):
    """Matches lie in several buckets; the first k span two of them."""
    n = 3 * B.BITS
    df = spark.range(n).select("id", F.when(F.col("id") % 20_000 == 19_999, "rare").otherwise("common").alias("shape"),
                               F.lit("x").alias("color"))
    numbered = B.number_items(df, ["id"])
    index = B.build_index(numbered, {"shape": ["shape"], "color": ["color"]})
    req = spark.createDataFrame([("a", "rare", None), ("b", "rare", "x"), ("c", "common", "x")], "key string, shape string, color string")
    top = B.first_items(req, index, ["shape", "color"], "key", 3)
    got = {k: [n for _, n in sorted((r, n) for q, r, n in rows(top, "key", "rank", "_no") if q == k)] for k in "abc"}
    assert got == {"a": [20_000, 40_000, 60_000], "b": [20_000, 40_000, 60_000], "c": [1, 2, 3]}


def test_rows_between_follow_the_requests(spark):
    """Requests for few of the pairs: no row for a pair that nobody asked for."""
    df = spark.range(2000).select("id", (F.col("id") % 10).cast("string").alias("shape"), (F.col("id") % 7).cast("string").alias("color"))
    numbered = B.number_items(df, ["id"])
    index = B.build_index(numbered, {"shape": ["shape"], "color": ["color"]})
    assert index.count() == 17                      # one bitmap a value, however many items hold it
    req = spark.createDataFrame([("a", "1", "2"), ("b", "3", "4")], "key string, shape string, color string")
    assert B.term_bitmaps(req.selectExpr("'shape' AS kind", "shape AS term"), index).count() == 2
    assert B.first_items(req, index, ["shape", "color"], "key", 2).count() == 4
