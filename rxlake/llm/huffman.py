"""Token ids as canonical length-limited Huffman code, in independent blocks.

Writing:

1. documents are range-partitioned and sorted by id, tokenised, and written as
   raw blocks: runs of whole documents of about ``BLOCK`` ids (a longer
   document is a block of its own), compressed by the worker;
2. ids are counted over all blocks; the counts (one per vocabulary entry, a
   bounded table) give code lengths of at most ``LIMIT`` bits by package-merge,
   and the lengths alone give the canonical codes;
3. every raw block is coded on its own, with the bit offset of each
   ``STEP``-th id as a checkpoint.

Format: a folder with ``codebook`` (id, bits) and ``blocks`` (part, block,
doc_ids, n_tokens, start: ids of all documents before the block, n_ids,
checkpoints, payload: big-endian 32-bit words, first bit highest) as Parquet.

Reading looks ``LIMIT`` bits up in a table (id, bits) at every checkpoint of a
block at once, so one numpy step decodes one id of each run of ``STEP``.  A block
needs nothing but the codebook.

Defined results: a null or empty text is a document of the end id alone;
documents of equal id keep a fixed order (by their texts' hashes), a null id
comes first; an empty table gives an empty folder that reads as no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rxlake.llm.store import shared_folder, written
from rxlake.llm.tokens import encoder
from rxlake.llm.words import small_batches
from rxlake.session import shuffle_partitions

BLOCK = 1 << 18
STEP = 128
LIMIT = 16
#: blocks of a Parquet row group, which writers and readers hold whole
GROUP = {"parquet.block.row.count.limit": "4"}


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for the positive counts (package-merge).

    The limit is raised where the symbols would not fit it.
    """
    used = np.flatnonzero(counts)
    n = len(used)
    out = np.zeros(len(counts), np.int64)
    if n <= 2:
        out[used] = 1
        return out
    limit = max(limit, int(n - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    levels, items = [], leaves
    for _ in range(limit):
        if not levels:
            is_leaf = np.ones(n, bool)
        else:
            m = len(items) // 2 * 2
            both = np.concatenate([leaves, items[0:m:2] + items[1:m:2]])
            order = np.argsort(both, kind="stable")
            items, is_leaf = both[order], order < n
        levels.append(is_leaf)
    take = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[used] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes from lengths: ascending by (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        bits = int(lengths[i])
        if bits:
            code <<= bits - last
            codes[i], last = code, bits
            code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, bits) for every value of the next ``width`` bits, and width."""
    width = max(int(lengths.max(initial=1)), 1)
    ids, bits = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    codes = canonical_codes(lengths)
    for i in np.flatnonzero(lengths).tolist():
        lo = int(codes[i]) << (width - int(lengths[i]))
        hi = lo + (1 << (width - int(lengths[i])))
        ids[lo:hi], bits[lo:hi] = i, lengths[i]
    return ids, bits, width


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(payload, bit offset of each STEP-th id)."""
    size = lengths[ids]
    ends = np.cumsum(size)
    at = ends - size
    words = np.zeros((int(ends[-1]) + 31 >> 5) + 2, np.uint64)
    shifted = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
    word = at >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    joined = np.bitwise_or.reduceat(shifted, first)
    word = word[first]
    words[word] |= joined >> np.uint64(32)
    words[word + 1] |= joined & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes(), at[::STEP]


def decode_block(payload: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    ids, bits, width = table
    words = np.frombuffer(payload, ">u4").astype(np.uint64)
    window = (words[:-1] << np.uint64(32)) | words[1:]
    at = checkpoints.astype(np.int64)
    out = np.zeros((STEP, len(at)), np.uint32)
    mask = np.uint64((1 << width) - 1)
    full = n - STEP * (len(at) - 1)            # ids in the last run
    for step in range(STEP):
        if step == full:
            at = at[:-1]
        if not len(at):
            break
        peek = (window[at >> 5] >> (64 - width - (at & 31)).astype(np.uint64)) & mask
        out[step, :len(at)] = ids[peek]
        at = at + bits[peek]
    return out.T.ravel()[:n] if full == STEP else np.concatenate([out.T[:-1].ravel(), out[:full, -1]])


def raw_blocks(docs: DataFrame, tokenizer: str, doc_id: str, text: str, end_id: int) -> DataFrame:
    """Blocks of uncoded ids of the documents in id order."""
    n = shuffle_partitions(docs.sparkSession)
    src = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")) \
        .withColumn("_tie", F.xxhash64("_text"))
    src = src.repartitionByRange(n, "_id", "_tie").sortWithinPartitions("_id", "_tie").select("_id", "_text")
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
                           T.StructField("doc_ids", T.ArrayType(src.schema["_id"].dataType)),
                           T.StructField("n_tokens", T.ArrayType(T.IntegerType())),
                           T.StructField("start", T.LongType()), T.StructField("n_ids", T.LongType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("wide", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        keys, parts, block, start, size = [], [], 0, 0, 0

        def finished() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            wide = bool(ids.max() > 0xFFFF)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()),
                pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), pa.concat_arrays(keys)),
                pa.array([[len(p) // 4 for p in parts]], pa.list_(pa.int32())), pa.array([start], pa.int64()),
                pa.array([len(ids)], pa.int64()),
                pa.array([pa.compress(ids if wide else ids.astype("<u2"), "zstd", asbytes=True)], pa.binary()),
                pa.array([wide])], names=schema.names)

        for batch in small_batches(batches, "_text", 1 << 20):
            own = batch.column("_id")
            for i, raw in enumerate(enc.encode(batch.column("_text").to_pylist())):
                keys.append(own.slice(i, 1))
                parts.append(raw + end)
                size += len(raw) // 4 + 1
                if size >= BLOCK:
                    yield finished()
                    block, start = block + 1, start + size
                    keys, parts, size = [], [], 0
        if parts:
            yield finished()

    return src.mapInArrow(run, schema)


def _raw_ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for ids, n, wide in zip(batch.column("ids"), batch.column("n_ids").to_pylist(), batch.column("wide").to_pylist()):
        kind = np.dtype("<u4" if wide else "<u2")
        yield np.frombuffer(pa.decompress(ids.as_buffer(), n * kind.itemsize, "zstd"), kind)


def write(docs: DataFrame, path: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Writes the coded ids of all documents to the folder ``path`` (on any shared store)."""
    spark = docs.sparkSession
    raw = written(raw_blocks(docs, tokenizer, doc_id, text, end_id), "huffman-raw", "uncompressed", GROUP)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for ids in _raw_ids(batch):
                own = np.bincount(ids)
                if len(own) > len(total):
                    own, total = total, own.astype(np.int64)
                total[:len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    # one row per vocabulary entry, one per partition: bounded whatever the corpus
    rows = raw.select("ids", "n_ids", "wide").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    counts[[r.id for r in rows]] = [r.n for r in rows]
    lengths = code_lengths(counts)
    totals = dict(map(tuple, raw.groupBy("part").agg(F.sum("n_ids")).collect()))
    before, base = 0, {}
    for part in sorted(totals):
        base[part] = before
        before += totals[part]
    book = spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id bigint, bits int")
    book.coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((canonical_codes(lengths), lengths, base))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sizes, offset = shared.value
        for batch in batches:
            for i, ids in enumerate(_raw_ids(batch)):
                row = batch.slice(i, 1)
                payload, at = encode_block(ids, codes, sizes)
                start = row.column("start")[0].as_py() + offset[row.column("part")[0].as_py()]
                yield pa.RecordBatch.from_arrays(
                    [row.column(c) for c in ("part", "block", "doc_ids", "n_tokens")] + [
                        pa.array([start], pa.int64()), row.column("n_ids"),
                        pa.array([at], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                    names=["part", "block", "doc_ids", "n_tokens", "start", "n_ids", "checkpoints", "payload"])

    kind = raw.schema["doc_ids"].dataType.simpleString()
    raw.mapInArrow(code, f"part int, block int, doc_ids {kind}, n_tokens array<int>, start bigint, n_ids bigint, "
                         "checkpoints array<bigint>, payload binary").write.options(**GROUP).parquet(f"{path}/blocks", compression="uncompressed")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids (little-endian 32-bit)."""
    book = spark.read.parquet(f"{path}/codebook").collect()         # one row per vocabulary entry
    lengths = np.zeros(max((r.id for r in book), default=0) + 1, np.int64)
    for r in book:
        lengths[r.id] = r.bits
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda c: batch.column(c)[i]  # noqa: E731, B023
                ids = decode_block(at("payload").as_buffer(), at("checkpoints").values.to_numpy(), at("n_ids").as_py(), table)
                n = at("n_tokens").values.to_numpy()
                ends = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays([
                    at("doc_ids").values, pa.array(ends[:-1] + at("start").as_py(), pa.int64()), pa.array(n, pa.int64()),
                    pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * ends).astype(np.int32)),
                                                                pa.py_buffer(ids.astype("<u4").tobytes())])],
                    names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.select("doc_ids", "n_tokens", "start", "n_ids", "checkpoints", "payload").mapInArrow(
        run, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's columns, from the files."""
    path = shared_folder(docs.sparkSession, "huffman")
    write(docs.select("doc_id", "text"), path, tokenizer)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
