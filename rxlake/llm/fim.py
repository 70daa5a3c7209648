"""Fill-in-the-middle documents by in-place block rotation.

A text is cut into units, ``[A-Za-z]+`` or one other code point.  Two cuts
between units, drawn from a hash of the document's id, make prefix, middle and
suffix.

1. Scan: unit starts are found on the UTF-8 bytes of a whole batch at once
   (numpy); a text's two cuts are two entries of that list.
2. The text goes into a bytearray with room for the sentinels, which are
   inserted from the back: ``<P>`` prefix ``<M>`` middle ``<S>`` suffix.
3. A rotation exchanges two neighbouring blocks of the bytearray in place by
   three reversals (the first block, the second, both together).  ``psm`` rotates
   the last two blocks, ``spm`` the suffix to the front.

``restore`` needs the output and its form alone: it finds the sentinels, applies
the inverse rotations, and deletes the sentinels from the back.  A text that
contains a sentinel stays plain, and no sentinel can arise across a seam (each
begins with ``<`` and ends with ``>``), so the first occurrence is the inserted one.

Rows are worked on alone, without a shuffle; memory follows the longest text.

Defined results: null and empty texts are plain with 0 units; a null id counts
as empty text in the hash; repeated rows give equal outputs; an empty table
gives an empty result; columns of the input may have any name, results that
clash with one are told apart by ``prefix_columns``.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rxlake.llm.words import small_batches, text_buffer

SENTINELS = (b"<P>", b"<S>", b"<M>")
SEED = "1:"
PLAIN_PERCENT = 10              # of the documents, these stay as they are
SPM_PERCENT = 20                # of the others
BATCH = 4 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FOLLOWS = np.zeros(256, bool)  # bytes inside a character
_FOLLOWS[128:192] = True


def unit_starts(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Byte positions at which a unit starts, over all texts of a buffer."""
    letter = _LETTER[raw]
    starts = ~_FOLLOWS[raw]
    inside = letter[1:] & letter[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]         # a run of letters ends with its text
    starts[1:] &= ~inside
    starts[begins] = True
    return np.flatnonzero(starts)


def draws(doc_id: str) -> tuple[int, int, int, int]:
    """The first four 32-bit numbers of the hash of a document's id."""
    return struct.unpack(">4I", hashlib.sha256((SEED + doc_id).encode()).digest()[:16])


def rotate(buf: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange ``buf[start:cut]`` and ``buf[cut:end]`` in place by three reversals."""
    view = np.frombuffer(buf, np.uint8)
    for a, b in ((start, cut), (cut, end), (start, end)):
        half = (b - a) // 2
        left, right = view[a:a + half], view[b - half:b][::-1]
        kept = left.copy()
        left[:] = right
        right[:] = kept


def insert(buf: bytearray, at: int, what: bytes) -> None:
    buf[at:at] = what


def transform_text(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The output for cuts at the byte positions first <= second; form psm or spm."""
    p, s, m = SENTINELS
    buf = bytearray(text)
    for at, mark in ((second, s), (first, m), (0, p)):  # from the back, so earlier cuts stay where they are
        insert(buf, at, mark)
    middle = len(p) + first
    suffix = middle + len(m) + second - first
    rotate(buf, middle if form == "psm" else 0, suffix, len(buf))
    return buf


def restore_text(output: bytes, form: str) -> bytearray:
    """The text behind an output of the given form."""
    buf = bytearray(output)
    if form == "plain":
        return buf
    p, s, m = SENTINELS
    start, end = (buf.index(s), buf.index(m)) if form == "psm" else (0, buf.index(p))
    size = end - start                                  # of the suffix block
    rotate(buf, start, end, len(buf))                   # undoes the exchange: the suffix goes to the end
    suffix = len(buf) - size
    for at, mark in ((suffix, s), (buf.index(m), m), (0, p)):
        assert buf[at:at + len(mark)] == mark
        del buf[at:at + len(mark)]
    return buf


def _transformed(columns: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text", BATCH):
            offsets, raw = text_buffer(batch.column("_text"))
            starts = unit_starts(offsets, raw)
            first = np.searchsorted(starts, offsets)
            char = np.cumsum(np.concatenate([[0], ~_FOLLOWS[raw]]))     # code points before each byte
            ids = batch.column("_key").to_pylist()
            out = {k: [] for k in ("n_units", "form", "prefix_chars", "middle_chars", "output")}
            for i, doc_id in enumerate(ids):
                lo, hi = int(offsets[i]), int(offsets[i + 1])
                n = int(first[i + 1] - first[i])
                text = raw[lo:hi].tobytes()
                h1, h2, h3, h4 = draws(doc_id or "")
                if n == 0 or any(x in text for x in SENTINELS) or h3 % 100 >= 100 - PLAIN_PERCENT:
                    values = n, "plain", None, None, text
                else:
                    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                    x, y = (int(starts[first[i] + c]) if c < n else hi for c in (a, b))
                    form = "spm" if h4 % 100 < SPM_PERCENT else "psm"
                    values = (n, form, int(char[x] - char[lo]), int(char[y] - char[x]),
                              transform_text(text, x - lo, y - lo, form))
                for k, v in zip(out, values):
                    out[k].append(bytes(v) if k == "output" else v)
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(out[f.name], f.type) for f in schema], names=columns + schema.names)
    return run


_RESULT = pa.schema([("n_units", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                     ("middle_chars", pa.int64()), ("output", pa.binary())])


def transform(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None,
              prefix_columns: str = "") -> DataFrame:
    """Every row's ``keep`` columns (the id, unless named) with ``n_units``, ``form``
    (plain, psm, spm), ``prefix_chars``, ``middle_chars`` (code points, null if
    plain) and ``output`` (UTF-8 bytes).

    ``prefix_columns`` is put before the new names, for inputs that have such
    columns.
    """
    keep = [doc_id] if keep is None else keep
    names = [f"_k{i}" for i in range(len(keep))]
    src = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)],
                      F.col(f"`{doc_id}`").cast("string").alias("_key"), F.col(f"`{text}`").alias("_text"))
    new = T.StructType([T.StructField("n_units", T.LongType()), T.StructField("form", T.StringType()),
                        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                        T.StructField("output", T.BinaryType())])
    out = src.mapInArrow(_transformed(names, _RESULT), T.StructType([src.schema[k] for k in names] + new.fields))
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, names)], *[F.col(f).alias(prefix_columns + f) for f in new.names])


def restore(outputs: DataFrame, *, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """``outputs`` with the exact text (UTF-8 bytes) rebuilt from ``output`` and ``form``."""
    schema = T.StructType([*outputs.schema.fields, T.StructField(restored, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, output, BATCH):
            at = {c: batch.schema.get_field_index(c) for c in (output, form)}
            texts = pa.array((None if o is None or f is None else bytes(restore_text(o, f)) for o, f in zip(
                batch.column(at[output]).to_pylist(), batch.column(at[form]).to_pylist())), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, restored])

    return outputs.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    full = restore(transform(docs))
    return full.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: the same rows in DuckDB SQL, from lists of units
ORACLE = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s,
         regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS u
  FROM documents),
d AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || s[1:8])::BIGINT % (len(u) + 1) AS c1,
         ('0x' || s[9:16])::BIGINT % (len(u) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR ('0x' || s[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || s[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(c1, c2)], '') AS pre,
         array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS mid,
         array_to_string(u[greatest(c1, c2) + 1:], '') AS suf
  FROM d)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
