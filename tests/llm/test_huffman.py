import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from rxlake.llm import huffman as H

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def best_limited(counts, limit):
    """Least total length by trying all length multisets (small inputs)."""
    counts = sorted((c for c in counts if c), reverse=True)

    def go(i, room, least):
        if i == len(counts):
            return 0 if room >= 0 else float("inf")
        return min((counts[i] * n + go(i + 1, room - (1 << (limit - n)), n) for n in range(least, limit + 1)
                    if room >= (1 << (limit - n))), default=float("inf"))
    return go(0, 1 << limit, 1)


def test_lengths_are_optimal():
    rnd = random.Random(1)
    for _ in range(60):
        counts = np.array([rnd.choice([0, 1, 2, 5, 40, 1000]) for _ in range(rnd.randrange(3, 9))])
        if (counts > 0).sum() < 3:
            continue
        n = H.code_lengths(counts, 4)
        assert n.max() <= 4 and (n * counts).sum() == best_limited(counts.tolist(), 4)
        free = H.code_lengths(counts, 30)
        assert (free * counts).sum() == huffman_cost(counts.tolist())
    assert H.code_lengths(np.array([0, 7]), 4).tolist() == [0, 1]
    assert H.code_lengths(2 ** np.arange(40), 16).max() == 16


@pytest.mark.parametrize("n", [1, 127, 128, 129, 5000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(.02, n), 900)
    lengths = H.code_lengths(np.bincount(ids, minlength=1000))
    payload, at = H.encode_block(ids, H.canonical_codes(lengths), lengths)
    assert (H.decode_block(payload, at, n, H.decode_table(lengths)) == ids).all()


def test_write_and_read(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    docs = [(rnd.randrange(10**6), " ".join(rnd.choice(["alpha", "Beta,", "ü", "中", "9\n"]) for _ in range(rnd.choice([0, 1, 50, 3000]))))
            for _ in range(80)] + [(-5, None), (3, "dup"), (3, "dup"), (4, "one"), (4, "two"), (7, "x " * 40_000), (None, "no id")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, start int").repartition(3)
    t = Tokenizer.from_file(BYTE)
    want = sorted((i if i is not None else -10**9, np.array(t.encode(x or "").ids + [0], "<u4").tobytes()) for i, x in docs)
    got = H.report(df, BYTE).collect()
    got = sorted((r.start, r.doc_id if r.doc_id is not None else -10**9, r.n_tokens, r.ids_crc32) for r in got)
    assert [g[0] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1]]
    assert [g[1] for g in got] == [w[0] for w in want]
    assert sorted(g[1:] for g in got) == sorted((i, len(b) // 4, zlib.crc32(b)) for i, b in want)


def test_empty(spark):
    assert H.report(spark.createDataFrame([], "doc_id long, text string"), BYTE).count() == 0


def test_few_blocks_a_row_group(spark, tmp_path):
    words = [f"w{i}" for i in range(500)]
    text = " ".join(random.Random(3).choice(words) for _ in range(60_000))
    df = spark.createDataFrame([(1, text)] * 24, "doc_id long, text string")
    raw = H.raw_blocks(df, BYTE, "doc_id", "text", 0).selectExpr("sum(length(ids)) / sum(n_ids) AS width").first()
    assert raw.width < 1.7                                          # two bytes an id before they are compressed
    H.write(df, f"{tmp_path}/out", BYTE)
    groups = [pq.read_metadata(f) for f in (tmp_path / "out/blocks").glob("*.parquet")]
    assert max(m.num_row_groups for m in groups) > 1
    assert all(m.row_group(i).num_rows <= 4 for m in groups for i in range(m.num_row_groups))
