"""Order-preserving packing of documents into fixed windows of tokens.

The documents of a partition form one token stream in their order.  Windows of
at most ``window`` tokens are cut from it by dynamic programming over the
stream's possible cuts:

* after a document: free;
* after a sentence mark: ``SENTENCE_CUT`` tokens' worth;
* every ``STRIDE`` tokens inside a longer sentence: ``HARD_CUT`` tokens' worth.

``best[i] = min(best[j] + window - (at[i] - at[j])) + penalty[i]`` over the cuts j
at most one window before i: padding plus truncation penalties.  As
``best[j] + at[j]`` does not depend on i, its sliding-window minimum comes from
a monotone queue, so the work is linear in the number of cuts.

The stream is walked in segments of about ``SEGMENT`` tokens (one document at
least).  A segment ends at its best cut within the last window and the rest
opens the next segment, so memory is bounded by a segment and the longest
document.  The last window of a partition is cut into powers of two, which
need no padding.  Partitions are packed independently, without a shuffle;
sequence ids hold the partition's number in their upper bits.

Defined results: a null or empty text is a document of the end id alone;
repeated rows are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from rxlake.llm.tokens import encoder, ends_sentence
from rxlake.llm.words import small_batches

WINDOW = 2048
SEGMENT = 1 << 17
STRIDE = 64
SENTENCE_CUT, HARD_CUT = 2, 24

PIECE = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, `offset` bigint"


def possible_cuts(ids: np.ndarray, doc_ends: np.ndarray, marks: np.ndarray, window: int
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Positions (0 first, ascending) and penalties of the stream's cuts."""
    ends = marks[np.minimum(ids, len(marks) - 1)]
    ends[:-1] &= ~ends[1:]
    sentence = np.flatnonzero(ends) + 1
    soft = np.union1d(np.union1d(sentence, doc_ends), [0])
    soft = soft[soft <= len(ids)]
    stride = min(STRIDE, window)
    gaps = np.diff(soft)
    extra = np.maximum(-(-gaps // stride) - 1, 0)
    hard = np.repeat(soft[:-1], extra) + stride * (1 + np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra))
    at = np.sort(np.concatenate([soft, hard]))
    penalty = np.full(len(at), float(HARD_CUT))
    penalty[np.searchsorted(at, soft)] = SENTENCE_CUT
    penalty[np.searchsorted(at, doc_ends)] = 0
    penalty[0] = 0
    return at, penalty


def choose_windows(at: np.ndarray, penalty: np.ndarray, window: int, to_end: bool) -> list[int]:
    """Window ends of least padding plus penalty.

    ``to_end``: the last window ends with the stream; else at the best cut
    within the stream's last window.
    """
    at_l, pen = at.tolist(), penalty.tolist()
    n = len(at_l)
    best, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])        # (best + at, cut), ascending in both
    for i in range(1, n):
        p = at_l[i]
        low = p - window
        while at_l[queue[0][1]] < low:
            queue.popleft()
        key, j = queue[0]
        cost = key + window - p + pen[i]
        best[i], back[i] = cost, j
        key = cost + p
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, i))
    i = n - 1
    if not to_end:
        lo = int(np.searchsorted(at, at_l[-1] - window, side="right"))
        i = max(range(max(lo, 1), n), key=lambda k: (-best[k], k), default=0)
    ends = []
    while i:
        ends.append(at_l[i])
        i = back[i]
    return ends[::-1]


def powers_of_two(length: int) -> list[int]:
    """``length`` as falling powers of two."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class Packer:
    """Packs one partition's documents; ``flush`` returns finished pieces."""

    def __init__(self, marks: np.ndarray, window: int, base: int):
        self.marks, self.window, self.next = marks, window, base
        self.docs: list[tuple[int, int, np.ndarray]] = []      # (row, ids before, ids not yet packed)
        self.tokens = 0

    def add(self, row: int, ids: np.ndarray) -> None:
        self.docs.append((row, 0, ids))
        self.tokens += len(ids)

    def flush(self, last: bool):
        """(rows, starts, lengths, ids, cuts, sequence ids, offsets) of the finished windows."""
        if not self.docs:
            return None
        ids = np.concatenate([d[2] for d in self.docs])
        ends = np.cumsum([len(d[2]) for d in self.docs])
        at, penalty = possible_cuts(ids, ends, self.marks, self.window)
        windows = choose_windows(at, penalty, self.window, last)
        if not windows:
            return None
        if last:
            begin = windows[-2] if len(windows) > 1 else 0
            size = windows.pop() - begin
            windows += (begin + np.cumsum(powers_of_two(size))).tolist() if size < self.window else [begin + size]
        w = np.array([0, *windows])
        doc_starts = ends - [len(d[2]) for d in self.docs]
        cuts = np.union1d(w, ends[ends < w[-1]])
        begin, length = cuts[:-1], np.diff(cuts)
        doc = np.searchsorted(ends, begin, side="right")
        win = np.searchsorted(w, begin, side="right") - 1
        before = np.array([d[1] for d in self.docs])
        rows = np.array([d[0] for d in self.docs])
        out = (rows[doc], begin - doc_starts[doc] + before[doc], length, ids, cuts, win + self.next, begin - w[win])
        self.next += len(windows)
        k = int(np.searchsorted(ends, w[-1], side="right"))
        rest = self.docs[k:]
        if rest:
            row, was, left = rest[0]
            done = int(w[-1] - doc_starts[k])
            rest[0] = (row, was + done, left[done:])
        self.docs, self.tokens = rest, int(ends[-1] - w[-1])
        return out


def pack(docs: DataFrame, tokenizer: str, *, text: str = "text", keep: list[str] | None = None, end_id: int = 1,
         window: int = WINDOW) -> DataFrame:
    """One row per piece of a document inside a window.

    Columns: ``keep`` (default: all but the text), start (the document's ids
    before the piece), length, ids (little-endian 32-bit), doc_tokens (with the
    end id), sequence_id, offset (in the sequence); these replace input columns
    of the same names.
    """
    fields = T._parse_datatype_string(PIECE).fields
    own = {f.name for f in fields}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own and c != text]
    names = [f"_k{i}" for i in range(len(keep))]
    src = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType(src.select(*names).schema.fields + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, marks = encoder(tokenizer), ends_sentence(tokenizer)
        packer = Packer(marks, window, TaskContext.get().partitionId() << 40)
        keys: dict[int, pa.RecordBatch] = {}
        totals: dict[int, int] = {}
        end = np.array([end_id], "<u4").tobytes()
        row = 0

        def pieces(found) -> Iterator[pa.RecordBatch]:
            if found is None:
                return
            rows, start, length, ids, cuts, seq, offset = found
            used = np.unique(rows)
            table = pa.Table.from_batches([keys[r] for r in used.tolist()]) if names else None
            where = pa.array(np.searchsorted(used, rows))
            cols = {k: table.column(k).take(where).combine_chunks() for k in names}
            data = pa.py_buffer(ids.astype("<u4").tobytes())
            cols |= {"start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                     "ids": pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((cuts * 4).astype(np.int32)), data]),
                     "doc_tokens": pa.array([totals[r] for r in rows.tolist()], pa.int64()),
                     "sequence_id": pa.array(seq, pa.int64()), "offset": pa.array(offset, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
            open_rows = {d[0] for d in packer.docs}
            for r in [r for r in totals if r not in open_rows]:
                keys.pop(r, None)
                del totals[r]

        for batch in small_batches(batches, "_text", 1 << 20):
            texts = batch.column("_text").to_pylist()
            own_keys = batch.select(names) if names else None
            for i, raw in enumerate(enc.encode(texts)):
                ids = np.frombuffer(raw + end, "<u4")
                if names:
                    keys[row] = own_keys.slice(i, 1)
                totals[row] = len(ids)
                packer.add(row, ids)
                row += 1
                if packer.tokens >= SEGMENT:
                    yield from pieces(packer.flush(False))
        while packer.docs:
            yield from pieces(packer.flush(True))

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, names)], *[f.name for f in fields])


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's columns of every piece."""
    return pack(docs.select("doc_id", "text"), tokenizer).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
