"""Vectors scaled to whole numbers, their exact inner products, and the best k of many.

A component x becomes floor(scale * x), x as double.  Products are exact: in
float64 while no sum can reach 2^53, else in int64; a component is clipped at
the size from which a sum of ``dim`` products might not fit a long.  Vectors of a
table are filled up with zeros to the longest one's length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BYTES = 32 << 20          # of query vectors sent to the workers at a time
BUFFER = 1 << 21                # candidates held before they are cut to the best k


class Shape(NamedTuple):
    rows: int
    dim: int
    scale: int
    largest: int                # no component is larger

    @property
    def work(self) -> type:
        """The type in which inner products are exact."""
        return np.float64 if self.largest ** 2 * max(self.dim, 1) < 1 << 53 else np.int64

    @property
    def store(self) -> type:
        return next(t for t in (np.int16, np.int32, np.int64) if self.largest <= np.iinfo(t).max)


def usable(vec: Column) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def measure(vectors: DataFrame, vec: str, scale: int) -> Shape:
    """Rows, length and largest component of the usable vectors: one pass, one row."""
    v = F.col(vec)
    r = vectors.where(usable(v)).agg(
        F.count(F.lit(1)), F.max(F.size(v)), F.max(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))))).first()
    dim = max(1, r[1] or 1)
    most = math.isqrt(((1 << 63) - 1) // dim)
    high = (r[2] or 0.0) * scale
    return Shape(r[0], dim, scale, most if high >= most else min(most, math.floor(high) + 1))


def integers(column: pa.Array, shape: Shape) -> np.ndarray:
    """rows x dim matrix of the stored type of an array column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(flat * shape.scale), -float(shape.largest), float(shape.largest))
    if (size == shape.dim).all():
        return flat.reshape(-1, shape.dim).astype(shape.store)
    out = np.zeros((len(size), shape.dim), shape.store)
    out[np.arange(shape.dim) < size[:, None]] = flat
    return out


def packed(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in matrix], pa.binary())


def unpacked(column: pa.Array, shape: Shape) -> np.ndarray:
    """The matrix behind a column of ``packed`` rows, in the exact working type."""
    flat = np.frombuffer(b"".join(column.to_pylist()), shape.store)
    return flat.reshape(-1, shape.dim).astype(shape.work)


def lowest(dtype: type):
    """No score is below it, and its negative exists."""
    return -np.inf if dtype is np.float64 else np.iinfo(np.int64).min + 1


class Ids(NamedTuple):
    """The rows of a matrix: a unique number each, and their id (with a mark where it is null)."""
    row: np.ndarray
    id: np.ndarray
    null: np.ndarray

    @staticmethod
    def of(row: pa.Array, ids: pa.Array) -> "Ids":
        return Ids(row.to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False),
                   np.asarray(ids.is_null()).astype(np.int8))

    def take(self, at) -> "Ids":
        return Ids(self.row[at], self.id[at], self.null[at])


class Best:
    """The k best rows of each of n queries: higher scores first, then smaller ids, null ids last.

    ``kth`` is the k-th best score so far (the lowest number while there are
    fewer); a row below it can be skipped, one equal to it cannot.
    """

    def __init__(self, n: int, k: int, dtype: type, top: np.ndarray | None = None):
        self.k, self.low = k, lowest(dtype)
        self.top = np.full((n, k), self.low, dtype) if top is None else top.astype(dtype)
        self.kth = self.top.min(1)
        self.held: list[tuple] = []
        self.size = 0

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: Ids, allowed: np.ndarray) -> None:
        """scores, allowed: queries x rows; each query at most once."""
        hit = allowed & (scores >= self.kth[queries, None])
        q, c = np.nonzero(hit)
        if not len(q):
            return
        some = np.flatnonzero(hit.any(1))
        merged = np.concatenate([self.top[queries[some]], np.where(hit[some], scores[some], self.low)], 1)
        self.top[queries[some]] = np.partition(merged, merged.shape[1] - self.k, axis=1)[:, -self.k:]
        self.kth[queries[some]] = self.top[queries[some]].min(1)
        self.held.append((queries[q], scores[q, c], *ids.take(c)))
        self.size += len(q)
        if self.size > BUFFER:
            self._cut()

    def _cut(self) -> None:
        if self.held:
            q, s, row, number, null = (np.concatenate(x) for x in zip(*self.held))
            near = s >= self.kth[q]
            q, s, row, number, null = q[near], s[near], row[near], number[near], null[near]
            order = np.lexsort((row, number, null, -s, q))
            q, s, row, number, null = q[order], s[order], row[order], number[order], null[order]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            keep = place < self.k
            self.held = [(q[keep], s[keep], row[keep], number[keep], null[keep])]
            self.size = int(keep.sum())

    def result(self) -> tuple:
        """(query, score, row, id, null) arrays, at most k a query."""
        self._cut()
        return self.held[0] if self.held else (np.empty(0, np.int64),) * 5


def as_batch(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def blocks(queries: DataFrame, number: int, row_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """The ``number`` query rows in blocks of about ``BLOCK_BYTES``, dealt by the hash of ``rid``."""
    n = max(1, math.ceil(number * row_bytes / BLOCK_BYTES))
    for i in range(n):
        block = queries.where(F.pmod(F.xxhash64("rid"), F.lit(n)) == i).toArrow()
        if block.num_rows:
            yield i, block
