"""Near-duplicate classes by DartMinHash and banded joining.

A text is a weighted set: its five-word shingles, weighted by their counts.
Similarity of two texts is the weighted Jaccard index, the sum of smaller
weights over the sum of larger ones.

Signatures.  An element of weight w owns the region [0, w) x [0, inf) of weight
and rank.  Hashing throws darts at each unit box of weight: their ranks are a
Poisson process of rate 1, the same in every document.  A document looks at
darts inside its regions up to rank ``(k ln k + 2k) / total weight``, so about
that many darts whatever its length, hashes each dart to one of k coordinates
and keeps the earliest per coordinate; documents with an empty coordinate look
twice as far again.  Two documents agree in a coordinate with probability equal
to their similarity.

Classes.

1. Texts of equal word sequence (with no words: of equal bytes) share a node.
2. Nodes that agree in all rows of a band share a bucket.  Each member meets the
   bucket's ``LEADERS`` most central nodes (those with most company over all
   bands; a bucket of four meets in full).
3. A pair is a link if its weighted Jaccard index, computed from the shingles
   themselves, is ``threshold`` or more.
4. Members of larger buckets that no leader links are put in finer buckets by
   further coordinates and meet new leaders (``LATER_LEADERS``), until none is
   left.
5. Members of one bucket that these links leave in different components
   (star contraction) may still be links.  Their shingles are put in one order,
   the rarest first; two sets of similarity ``threshold`` share one of each
   other's first ones (prefix filter), and what follows the first shared one bounds
   what they share (positional filter).  So members of different components meet by
   equal rare shingles, and only pairs that are in one class anyway or cannot be
   links are left out.
6. Connected components of all links are the classes, no fewer joined than if
   every bucket had met in full; a class is named by its smallest document id.  A node's
   number of links is a lower bound: pairs inside a component that the leaders
   joined are not counted unless they met.  It is 0 only for nodes without a link.

All joins are on hashed keys with inner semantics, which Spark splits when a
key is hot; the leader choice is a limited window, cut on the map side.

Defined results: null and empty texts are equal; texts of fewer than five words
have one shingle, the whole text; rows without an id have a null class unless
their class has an id; repeated rows are members each.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from rxlake.llm.store import drop, recorded, written
from rxlake.llm.words import mix, small_batches, text_buffer, word_bounds, word_spans

SHINGLE = 5
K, BANDS, ROWS = 128, 20, 5             # coordinates BANDS * ROWS .. K - 1 refine buckets
LEADERS, LATER_LEADERS = 3, 8          # in the first round and in those of the leftovers
FINER = 2                               # further coordinates for each round of leftovers

_U32 = np.uint64(32)


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int = K) -> np.ndarray:
    """docs x k array of dart ids (32 bits); 0 in rows without elements.

    ``element`` holds 64-bit hashes, unique within a document; weights are
    positive reals.
    """
    boxes = np.ceil(weight).astype(np.int64)
    total = np.bincount(doc, weight, docs)
    box = np.arange(boxes.sum()) - np.repeat(np.cumsum(boxes) - boxes, boxes)
    doc, room = np.repeat(doc, boxes), np.repeat(weight, boxes) - box       # room: part of the box below the weight
    seed = mix(np.repeat(element, boxes) + box.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    best = np.full(docs * k, np.iinfo(np.uint64).max, np.uint64)
    reach = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    while todo.any():
        use = todo[doc]
        d, s, r, limit = doc[use], seed[use], room[use], reach[doc[use]]
        rank = np.zeros(len(d))
        throw = 0
        while len(d):
            h = mix(s + np.uint64((2 * throw + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            u = (h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
            near = u >= np.exp(rank - limit)                # rank - ln(u) <= limit
            d, s, r, limit, h = d[near], s[near], r[near], limit[near], h[near]
            rank = rank[near] - np.log(np.maximum(u[near], 2.0 ** -53))
            dart = mix(h)
            inside = (dart & np.uint64(0xFFFF)).astype(np.float64) / 65536 < r
            at = d[inside] * k + ((dart[inside] >> np.uint64(16)) % np.uint64(k)).astype(np.int64)
            early = rank[inside].astype(np.float32).view(np.uint32).astype(np.uint64) << _U32
            np.minimum.at(best, at, early | (dart[inside] >> _U32))
            throw += 1
        todo &= (best == np.iinfo(np.uint64).max).reshape(docs, k).any(axis=1)
        reach = reach * 2
    sig = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(docs, k)
    sig[total <= 0] = 0
    return sig


def shingle_sets(offsets: np.ndarray, raw: np.ndarray, size: int = SHINGLE):
    """(doc, element, count) of distinct shingles, and each text's node hash."""
    n = len(offsets) - 1
    starts, _, h = word_spans(offsets, raw)
    bounds = word_bounds(offsets, starts)
    words = np.diff(bounds)
    # node: order-dependent hash of all words
    place = (np.arange(len(h)) - np.repeat(bounds[:-1], words)).astype(np.uint64)
    run = np.concatenate([[np.uint64(0)], np.cumsum(mix(h + place * np.uint64(0xA24BAED4963EE407)))])
    node = mix(run[bounds[1:]] - run[bounds[:-1]] + words.astype(np.uint64))
    for i in np.flatnonzero(words == 0):
        rest = raw[offsets[i]:offsets[i + 1]].astype(np.uint64)
        node[i] = mix(np.array([mix(rest + np.arange(len(rest), dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).sum()
                                + np.uint64(7 + len(rest))], np.uint64))[0]
    count = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    first = np.repeat(bounds[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    doc = np.repeat(np.arange(n), count)
    width = np.minimum(words, size)[doc]
    hash_ = np.zeros(len(first), np.uint64)
    for j in range(size):
        inside = width > j
        if inside.all():
            hash_ = mix(hash_ + h[first + j])
        else:
            hash_[inside] = mix(hash_[inside] + h[first[inside] + j])
    # one sort of (document, 48 bits of hash) gives distinct shingles and counts;
    # small_batches keeps documents below 2^16
    keys = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (hash_ >> np.uint64(16)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    return (keys >> np.uint64(48)).astype(np.int64), mix(keys & np.uint64((1 << 48) - 1)), times, node


def expanded(doc: np.ndarray, element: np.ndarray, times: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and 32-bit values of each text's multiset as a set: (shingle, occurrence) hashed."""
    d = np.repeat(doc, times)
    turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    e = mix(np.repeat(element, times) + turn.astype(np.uint64)) >> _U32
    keys = np.unique((d.astype(np.uint64) << _U32) | e)
    d = (keys >> _U32).astype(np.int64)
    return np.searchsorted(d, np.arange(docs + 1)), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def signatures(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, node, buckets (one hash per band), finer (further coordinates), shingles."""
    names = [f"_k{i}" for i in range(len(keys))]
    src = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keys, names)], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType(src.select(*names).schema.fields + T._parse_datatype_string(
        "_node bigint, _buckets array<bigint>, _finer array<int>, _shingles array<int>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text", 1 << 20):
            n = batch.num_rows
            offsets, raw = text_buffer(batch.column(batch.schema.get_field_index("_text")))
            doc, element, times, node = shingle_sets(offsets, raw)
            sig = dart_signatures(doc, element, times.astype(np.float64), n)
            some = np.bincount(doc, minlength=n) > 0
            band = np.zeros((n, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
            for r in range(ROWS):
                band = mix(band + sig[:, r:BANDS * ROWS:ROWS].astype(np.uint64))
            own = np.where(some, BANDS, 0)
            ends = np.concatenate([[0], np.cumsum(own)]).astype(np.int32)
            finer = sig[:, BANDS * ROWS:]
            size, values = expanded(doc, element, times, n)
            cols = {k: batch.column(k) for k in names} | {
                "_node": pa.array(node.view(np.int64)),
                "_buckets": pa.ListArray.from_arrays(ends, pa.array(band[some].ravel().view(np.int64))),
                "_finer": pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * finer.shape[1],
                                                   pa.array(np.ascontiguousarray(finer).ravel().view(np.int32))),
                "_shingles": pa.ListArray.from_arrays(size.astype(np.int32), pa.array(values.view(np.int32)))}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    out = src.mapInArrow(run, schema)
    return out.withColumnsRenamed(dict(zip(names, keys)) | {"_node": "node", "_buckets": "buckets", "_finer": "finer",
                                                             "_shingles": "shingles"})


def _candidates(members: DataFrame, leaders: int) -> DataFrame:
    """(bucket, node, leader) of members (bucket, node, company)."""
    central = W.partitionBy("bucket").orderBy(F.desc("company"), "node")
    lead = members.withColumn("place", F.row_number().over(central)).where(F.col("place") <= leaders) \
        .select("bucket", F.col("node").alias("leader"))
    return members.select("bucket", "node").join(lead, "bucket").where("node != leader")


def _similar(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """The distinct pairs (a < b) whose weighted Jaccard index reaches the threshold."""
    found = pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    s = shingles
    full = found.join(s.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a") \
        .join(s.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    na, nb = F.size("sa"), F.size("sb")
    # of two sets the smaller must have at least threshold times the larger's size
    close = full.where(F.least(na, nb) >= threshold * F.greatest(na, nb))
    common = F.size(F.array_intersect("sa", "sb"))
    return close.withColumn("common", common).where(F.col("common") >= threshold * (na + nb - F.col("common"))) \
        .select("a", "b")


def _rarest(sets: DataFrame, threshold: float) -> DataFrame:
    """(s, node, root, n, at): of each set (node, root, n, shingles) the rarest shingles that another set has too.

    All sets are put in one order, by how many sets hold a shingle and then by its
    hash.  Two sets of which each must hold ``threshold`` of the other have one of
    the first ``n - threshold * n + 1`` in common; ``at`` is the place, from 0.
    """
    one = sets.select("node", "root", F.explode("shingles").alias("s"))
    have = one.groupBy("s").agg(F.count("*").alias("have"))
    ordered = one.join(have, "s").groupBy("node").agg(
        F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("have", "s"))).alias("all"))
    n = F.size("all")
    reach = F.floor(n - threshold * n + 1e-6).cast("int") + 1
    return ordered.select("node", "root", n.alias("n"), F.posexplode(F.slice("all", F.lit(1), reach)).alias("at", "e")) \
        .where("e.have > 1").select("e.s", "node", "root", "n", "at")


def _apart(members: DataFrame, roots: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """(node, leader): pairs of members (bucket, node) of split buckets, in different components, that may be links.

    Components are ``roots`` (node, root), nodes without a row their own.  Every
    link between such members of a bucket is among the pairs.
    """
    placed = members.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed, "dart-placed")
    split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    here = placed.join(split.select("bucket"), "bucket", "left_semi").select("node", "root").distinct()
    rare = written(_rarest(shingles.select("node", "shingles").join(here, "node"), threshold), "dart-apart-rarest")
    # a shingle's members outside its largest component meet those of other components
    parts = rare.groupBy("s", "root").agg(F.count("*").alias("members"))
    main = parts.groupBy("s").agg(F.max_by("root", F.struct("members", "root")).alias("main"), F.count("*").alias("parts")) \
        .where("parts > 1").drop("parts")
    met = written(rare.join(main, "s"), "dart-apart-met")
    rest = met.where("root != main").select("s", F.col("node").alias("leader"), F.col("root").alias("root2"),
                                            F.col("n").alias("n2"), F.col("at").alias("at2"))
    # at the first shingle in common, what follows in each set bounds all that is in common
    common = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    return met.join(rest, "s").where("root != root2 and (root = main or node < leader)") \
        .where(common >= threshold * (F.col("n") + F.col("n2") - common)).select("node", "leader")


def links(sig: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Verified pairs (a, b) of different nodes, a < b, of signatures with a row id ``rid``."""
    return linked_components(sig, threshold)[0]


def linked_components(sig: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The pairs of ``links`` and the (node, root) of their components."""
    # one row stands for a node, however many copies it has
    first = written(sig.groupBy("node").agg(F.min("rid").alias("rid")), "dart-first")
    rows = sig.select("node", "buckets").distinct().select("node", F.explode("buckets").alias("bucket"))
    company = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(rows.join(company, "bucket"), "dart-buckets")
    weight = shared.groupBy("node").agg(F.sum("size").alias("company"))
    members = written(shared.join(weight, "node"), "dart-members")
    # shingles only of nodes that share a bucket; the join's key is the row, so no key is hot
    shingles = written(sig.select("rid", "node", "shingles").join(
        first.join(weight.select("node"), "node").select("rid"), "rid", "left_semi").drop("rid")
        .withColumn("n", F.size("shingles")), "dart-shingles")
    large = members.where(F.col("size") > LEADERS + 1)
    finer = None
    out, level = [], 0
    while True:
        leaders = LEADERS if level == 0 else LATER_LEADERS
        pairs = written(_candidates(members, leaders), f"dart-pairs-{level}")
        found = written(_similar(pairs, shingles, threshold), f"dart-links-{level}")
        out.append(found)
        # members of buckets too large to have met in full, linked to none of the leaders there
        linked = pairs.withColumns({"a": F.least("node", "leader"), "b": F.greatest("node", "leader")}) \
            .join(found, ["a", "b"], "left_semi").select("bucket", "node")
        met = linked.union(pairs.select("bucket", F.col("leader").alias("node"))).distinct()
        rest = members.where(F.col("size") > leaders + 1).join(met, ["bucket", "node"], "left_anti")
        if finer is None:
            finer = written(sig.select("rid", "node", "finer").join(
                first.join(rest.select("node").distinct(), "node").select("rid"), "rid", "left_semi").drop("rid"), "dart-finer")
        used = [F.get("finer", F.lit(level * FINER + j)) for j in range(FINER)]
        parts = rest.join(finer, "node").select(F.xxhash64("bucket", *used).alias("bucket"), "node", "company")
        parts = written(parts, f"dart-rest-{level}")
        sizes = parts.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        members = written(parts.join(sizes, "bucket"), f"dart-members-{level}")
        level += 1
        if members.isEmpty():
            break
    near = written(functools.reduce(DataFrame.union, out).distinct(), "dart-near")
    roots = written(components(near), "dart-near-roots")
    pairs = written(_apart(large, roots, shingles, threshold).distinct(), "dart-apart-pairs")
    far = written(_similar(pairs, shingles, threshold), "dart-far")
    if far.isEmpty():
        return near, roots
    # the links between components join these, not their nodes anew
    over = lambda c: F.coalesce(F.col(f"root_{c}"), F.col(c)).alias(c)
    ends = far
    for c in "ab":
        ends = ends.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    joined = written(components(ends.select(over("a"), over("b"))), "dart-far-roots")
    nodes = near.union(far).select(F.explode(F.array("a", "b")).alias("node")).distinct()
    full = nodes.join(roots, "node", "left").withColumn("near", F.coalesce("root", "node")).drop("root") \
        .join(joined.withColumnRenamed("node", "near"), "near", "left").select("node", F.coalesce("root", "near").alias("root"))
    return near.union(far), full


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes with an edge.

    Alternating star contraction: every node hands its larger neighbours, then
    its smaller ones, to the smallest of them; the edges become stars in about
    as many rounds as the logarithm of the longest path.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "stars")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "stars-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                            F.col("m").alias("v")).where("u != v").distinct()
        e = written(small, "stars-small")
        now = e.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8,
            keys: list[str] | None = None) -> DataFrame:
    """Every row's ``keys`` (default: its id) with node, root (the same for all of a class), class_id and n_links.

    n_links counts the node's verified links to other texts: at least one if it
    has any, but a lower bound (see 6. above).
    """
    keys = [doc_id] if keys is None else keys
    sig = written(signatures(docs, keys, text).withColumn("rid", F.monotonically_increasing_id()), "dart-signatures")
    with recorded() as temporary:
        found, stars = linked_components(sig, threshold)
    pairs, roots = written(found, "dart-links"), written(stars, "dart-roots")
    drop(docs.sparkSession, temporary)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    nodes = sig.groupBy("node").agg(F.min(doc_id).alias("first"))
    nodes = nodes.join(roots, "node", "left").join(degree, "node", "left") \
        .select("node", F.coalesce("root", "node").alias("root"), "first", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    nodes = written(nodes, "dart-nodes")
    named = nodes.join(nodes.groupBy("root").agg(F.min("first").alias("class_id")), "root") \
        .select("node", "root", "class_id", "n_links")
    return sig.select(*keys, "node").join(named, "node")


def report(docs: DataFrame) -> DataFrame:
    return classes(docs.select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class: that with the smallest id, rows without an id last (of identical rows, one)."""
    keyed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col("doc_id").alias("_id"),
                        F.xxhash64("text").alias("_text"), F.coalesce("text", F.lit("")).alias("_t"))
    with recorded() as temporary:
        found = classes(keyed, doc_id="_id", text="_t", keys=["_id", "_text"])
    table = written(found, "dart-classes")
    drop(docs.sparkSession, temporary)
    # first of a class: smallest id, null last, then smallest text hash; one key (id, text hash) each
    first = table.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_text")).alias("k"))
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_text") == F.col("_text2"))
    lost = table.select("_id", "_text", "root").distinct().join(first, "root") \
        .where(~F.col("k._id").eqNullSafe(F.col("_id")) | (F.col("k._text") != F.col("_text"))) \
        .select(F.col("_id").alias("_id2"), F.col("_text").alias("_text2"))
    twice = table.groupBy("_id", "_text").count().where("count > 1")
    twice = written(twice.select(F.col("_id").alias("_id2"), F.col("_text").alias("_text2")), "dart-twice")
    # both sides grow with the data: no broadcast, whatever the size now
    kept = keyed.drop("_t").join(lost.hint("merge"), same, "left_anti")
    if not twice.isEmpty():
        kept = kept.join(twice, same, "left_anti").unionByName(
            kept.join(twice, same, "left_semi").dropDuplicates(["_id", "_text"]))
    return kept.select("row.*")
