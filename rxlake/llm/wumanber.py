"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of each benchmark
item (an item with fewer words, but at least one, is one shorter pattern).
Patterns of one length m form a group with

* a shift table: for a hashed block of ``B`` words ending at a position, how
  far the search may advance without missing an occurrence;
* suffix buckets: the patterns whose last block hashes to an entry with
  shift 0, sorted by block hash;
* direct comparison: word hashes of the whole window, then the words
  themselves as bytes.

The texts of a batch are cut into overlapping segments and searched in step,
so every numpy step advances thousands of positions; a text's words are all
searched whatever its length.

The pattern set is read from the benchmark table in blocks of at most
``max_pattern_bytes`` of text; each block is one pass over the documents
(one pass for any benchmark below that bound).  Only one block is broadcast
at a time, and with several the partial result is checkpointed in between.

Defined results: null and empty texts have no words (``contaminated`` false);
an empty benchmark finds nothing; repeated benchmark rows count as one item;
an item with a null id still marks words but is not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rxlake.llm.words import LOWER, mix, small_batches, text_buffer, word_bounds, word_spans

TABLE_BITS = 18
SEGMENT = 512


def block_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, indexed by the run's first word."""
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        out = mix(out + words[k:k + max(n, 0)] * np.uint64(2 * k + 3))
    return out


class PatternGroup:
    """Tables for the distinct patterns of one length."""

    def __init__(self, length: int, hashes: np.ndarray, texts: list[bytes], owners: list[list[int]]):
        self.length = length
        self.block = min(3, length)
        self.hashes = hashes                                  # patterns x length
        self.texts, self.owners = texts, owners
        entries = 1 << TABLE_BITS
        self.shift = np.full(entries, length - self.block + 1, np.int32)
        for end in range(self.block, length + 1):
            at = self._slot(self._blocks_at(end))
            np.minimum.at(self.shift, at, length - end)
        suffix = self._blocks_at(length)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def _blocks_at(self, end: int) -> np.ndarray:
        out = np.zeros(len(self.hashes), np.uint64)
        for k in range(self.block):
            out = mix(out + self.hashes[:, end - self.block + k] * np.uint64(2 * k + 3))
        return out

    @staticmethod
    def _slot(blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence inside one text."""
        m, b = self.length, self.block
        first, last = bounds[:-1], bounds[1:]
        long = last - first >= m
        first, last = first[long], last[long]
        none = np.empty(0, np.int64)
        if not len(first):
            return none, none
        # segments of end positions: a text's ends are first+m .. last
        count = -(-(last - first - m + 1) // SEGMENT)
        begin = np.repeat(first + m, count) + SEGMENT * (
            np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        stop = np.minimum(begin + SEGMENT, np.repeat(last, count) + 1)
        blocks = block_hash(words, b)
        at, stop, where, which = begin, stop, [], []
        while len(at):
            here = blocks[at - b]
            step = self.shift[self._slot(here)]
            check = step == 0
            if check.any():
                ends, keys = at[check], here[check]
                lo, hi = np.searchsorted(self.suffix, keys), np.searchsorted(self.suffix, keys, "right")
                n = hi - lo
                ends = np.repeat(ends, n)
                cand = self.order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                for k in range(m):                            # direct comparison, word by word
                    if not len(ends):
                        break
                    same = words[ends - m + k] == self.hashes[cand, k]
                    ends, cand = ends[same], cand[same]
                where.append(ends - m)
                which.append(cand)
            at = at + np.maximum(step, 1)
            keep = at < stop
            at, stop = at[keep], stop[keep]
        if not where:
            return none, none
        return np.concatenate(where), np.concatenate(which)


def words_of(text: str | None) -> tuple[np.ndarray, list[bytes]]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    s, e, h = word_spans(np.array([0, len(raw)]), raw)
    low = LOWER[raw].tobytes()
    return h, [low[i:j] for i, j in zip(s, e)]


def pattern_groups(items: list[tuple], window: int) -> list[PatternGroup]:
    """Tables for one block of benchmark items [(item key, text)]."""
    by_length: dict[int, dict[bytes, tuple[np.ndarray, list[int]]]] = {}
    for key, text in items:
        h, w = words_of(text)
        if not w:
            continue
        m = min(window, len(w))
        for i in range(len(w) - m + 1):
            found = by_length.setdefault(m, {}).setdefault(b" ".join(w[i:i + m]), (h[i:i + m], []))
            if not found[1] or found[1][-1] != key:
                found[1].append(key)
    return [PatternGroup(m, np.stack([v[0] for v in pats.values()]), list(pats), [v[1] for v in pats.values()])
            for m, pats in sorted(by_length.items())]


def find_hits(offsets: np.ndarray, raw: np.ndarray, groups: list[PatternGroup]):
    """(word bounds, [(text, first word in it, length, owners)]) of all occurrences."""
    s, e, h = word_spans(offsets, raw)
    bounds = word_bounds(offsets, s)
    hits = []
    for g in groups:
        first, which = g.search(h, bounds)
        if not len(first):
            continue
        doc = np.searchsorted(bounds, first, side="right") - 1
        for d, f, p in zip(doc.tolist(), first.tolist(), which.tolist()):
            low = b" ".join(LOWER[raw[s[k]:e[k]]].tobytes() for k in range(f, f + g.length))
            if low == g.texts[p]:
                hits.append((d, f - int(bounds[d]), g.length, g.owners[p]))
    return bounds, hits


_OUT = "n_words bigint, _hits array<struct<start:bigint,stop:bigint>>, _items array<bigint>"


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def scan(df: DataFrame, text: str, keys: list[str], groups_of, first_pass: bool) -> DataFrame:
    """One pass: adds the hit word spans and item numbers of one pattern block."""
    schema = T.StructType(df.select(*keys).schema.fields
                          + T._parse_datatype_string(_OUT).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = groups_of.value
        for batch in small_batches(batches, text):
            offsets, raw = text_buffer(batch.column(batch.schema.get_field_index(text)))
            bounds, hits = find_hits(offsets, raw, groups)
            spans = [[] for _ in range(batch.num_rows)]
            items = [set() for _ in range(batch.num_rows)]
            for d, start, length, owners in hits:
                spans[d].append((start, start + length))
                items[d].update(owners)
            if not first_pass:
                for i, (old, ids) in enumerate(zip(batch.column("_hits").to_pylist(), batch.column("_items").to_pylist())):
                    spans[i] += [(x["start"], x["stop"]) for x in old]
                    items[i].update(ids)
            cols = {k: batch.column(k) for k in keys}
            cols["n_words"] = pa.array(np.diff(bounds), pa.int64())
            cols["_hits"] = pa.array([[{"start": a, "stop": b} for a, b in _merge(x)] for x in spans],
                                     pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            cols["_items"] = pa.array([sorted(x) for x in items], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return df.mapInArrow(run, schema)


def item_blocks(benchmark: DataFrame, item_id: str, text: str, max_pattern_bytes: int) -> Iterator[list[tuple]]:
    """Benchmark items in blocks of bounded text size, with dense item numbers."""
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).distinct().toLocalIterator()
    numbers: dict = {}
    block, size = [], 0
    for r in rows:
        if not r.t:
            continue
        block.append((numbers.setdefault(r.i, len(numbers)), r.i, r.t))
        size += len(r.t)
        if size >= max_pattern_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 13, keep: list[str] | None = None,
                  max_pattern_bytes: int = 16 << 20, share: int = 20) -> DataFrame:
    """Every document with its contamination report.

    Returns the columns ``keep`` (default: all of ``docs``) plus n_words,
    hit_spans (word spans covered by benchmark windows, merged, end
    exclusive), n_hit, item_ids (ids of the items found, as sorted strings) and
    contaminated (``n_hit > 0 and share * n_hit >= n_words``); these replace
    input columns of the same names.
    """
    out_names = {"n_words", "hit_spans", "n_hit", "item_ids", "contaminated"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in out_names]
    spark = docs.sparkSession
    base = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)],
                       F.col(f"`{text}`").alias("_text"))
    keys = [f"_k{i}" for i in range(len(keep))]
    out, found_ids, several = None, [], None
    blocks = item_blocks(benchmark, item_id, item_text, max_pattern_bytes)
    ahead = next(blocks, [])
    while ahead or out is None:
        block, ahead = ahead, next(blocks, [])
        several = several or bool(ahead)
        found_ids += [(n, str(i) if i is not None else None) for n, i, _ in block]
        groups = spark.sparkContext.broadcast(pattern_groups([(n, t) for n, _, t in block], window))
        carry = keys + (["_text"] if several else [])
        src = base if out is None else out
        out = scan(src, "_text", carry, groups, first_pass=out is None)
        if several:
            out = out.checkpoint()
    names = spark.sparkContext.broadcast({n: i for n, i in found_ids})

    @F.udf("array<string>")
    def ids_of(numbers):
        return sorted({names.value[n] for n in numbers} - {None})

    # few documents have items: the others never reach the Python function
    out = out.withColumn("item_ids", F.when(F.size("_items") > 0, ids_of("_items"))
                         .otherwise(F.array().cast("array<string>")))
    n_hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "n_words",
                      F.col("_hits").alias("hit_spans"), n_hit.alias("n_hit"), "item_ids",
                      ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest of ``decontaminate`` for documents and benchmark."""
    r = decontaminate(docs, benchmark, keep=["doc_id"])
    return r.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS p
    FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m)),
hit AS (SELECT rid, item_id, m, i FROM dw JOIN pat USING (m, p)),
words AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS k FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids
    FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
