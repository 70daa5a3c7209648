"""Language identification with error-correcting output codes.

Every language has a codeword of bits.  For each bit a binary classifier tells
the languages with 1 from those with 0: the log-ratio of two mixtures of hashed
byte n-gram distributions, one mean per side.  A text's margins on all bits are
compared with every codeword by weighted logistic loss (loss-weighted
decoding); the codeword of least loss is the language.  The result is flagged
as ambiguous if another codeword's loss is close, or if as many bits disagree
with the winner as the code can correct.

Texts are lower-cased in A-Z; other ASCII that is not a letter counts as a
blank; n-grams of 2 to 4 bytes stay inside their text.  Whole texts are used.

The n-gram distributions come from a sample of the labelled rows, about
``TRAIN_ROWS`` per language, chosen by the hash of their ids (all rows of a
language with fewer); whole texts of these rows are counted.

Defined results: null texts and texts without a letter are ``und`` with score 0;
rows of unknown language are not learned from; with one known language every
text with a letter is that language; with none all are ``und``; repeated rows
are judged alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rxlake.llm.store import fold
from rxlake.llm.words import mix, small_batches, text_buffer

TRAIN_ROWS = 4000
ORDERS = (2, 3, 4)
BITS = 16                       # n-grams are hashed to 2^BITS features
SMOOTH = 0.5
AMBIGUOUS = 0.1                 # least difference of the mean loss of the best two

_BYTE = np.full(256, 32, np.uint64)
_BYTE[128:] = np.arange(128, 256)
_BYTE[97:123] = np.arange(97, 123)
_BYTE[65:91] = np.arange(97, 123)


def ngrams(offsets: np.ndarray, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) of every n-gram, one order after the other."""
    values = _BYTE[raw]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    packed = values
    for n in range(2, max(ORDERS) + 1):
        if len(values) < n:
            return
        packed = (packed[:-1] << np.uint64(8)) | values[n - 1:]
        if n in ORDERS:
            inside = text[:len(packed)] == text[n - 1:]
            h = mix(packed[inside] * np.uint64(2 * n + 1)) >> np.uint64(64 - BITS)
            yield text[:len(packed)][inside], h.astype(np.int64)


def codewords(languages: int) -> np.ndarray:
    """languages x bits matrix of -1 and 1, no constant or repeated bit.

    Up to 6 languages: all splits.  More: greedily the codeword farthest from
    those chosen, of a fixed pseudo-random pool.
    """
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= 6:
        splits = [[1] + [1 if s >> i & 1 else -1 for i in range(languages - 1)] for s in range(2 ** (languages - 1) - 1)]
        return np.array(splits, float).T
    bits = 15 + 4 * int(languages).bit_length()
    pool = mix(np.arange(64 * languages * bits, dtype=np.uint64)).reshape(-1, bits) >> np.uint64(63)
    pool = np.where(pool > 0, 1.0, -1.0)
    chosen = [pool[0]]
    far = (pool != pool[0]).sum(1)
    while len(chosen) < languages:
        i = int(far.argmax())
        chosen.append(pool[i])
        far = np.minimum(far, (pool != pool[i]).sum(1))
    code = np.array(chosen)
    return code[:, np.abs(code.sum(0)) < languages]


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: languages x 2^BITS."""
        self.languages = languages
        self.code = codewords(len(languages))
        p = (counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * counts.shape[1])
        side = lambda sign: np.array([p[self.code[:, b] == sign].mean(0) for b in range(self.code.shape[1])])
        if self.code.shape[1]:
            self.weights = np.log(side(1) / side(-1)).astype(np.float32)
            # mean margin of a language's own n-grams, in the direction of its code: how reliable a bit is
            reliable = np.maximum((p @ self.weights.T.astype(float)) * self.code, 0).mean(0)
            self.trust = reliable / max(reliable.sum(), 1e-12)
        else:
            self.weights, self.trust = np.zeros((0, counts.shape[1] if len(languages) else 1), np.float32), np.zeros(0)
        self.correctable = (min((int((a != b).sum()) for i, a in enumerate(self.code) for b in self.code[:i]), default=1) - 1) // 2

    def margins(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """texts x bits: evidence for each bit, summed over n-grams (orders averaged)."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.weights)))
        for text, feature in ngrams(offsets, raw):
            first = np.flatnonzero(np.diff(text, prepend=-1))
            if len(first):
                for b, w in enumerate(self.weights):
                    out[text[first], b] += np.add.reduceat(w[feature], first, dtype=float)
        return out / len(ORDERS)

    def decode(self, margins: np.ndarray):
        """(language number, score, bits that disagree, ambiguous) of each text."""
        n = len(margins)
        if not self.code.shape[1]:
            return np.zeros(n, int), np.ones(n), np.zeros(n, int), np.zeros(n, bool)
        agree = margins[:, None, :] * self.code[None]
        loss = (np.logaddexp(0, -agree) * self.trust).sum(2)
        best = loss.argmin(1)
        order = np.sort(loss, 1)
        score = 1 / np.exp(np.minimum(order[:, :1] - loss, 0) * len(self.trust)).sum(1)
        wrong = (agree[np.arange(n), best] <= 0).sum(1)
        return best, score, wrong, (order[:, 1] - order[:, 0] < AMBIGUOUS) | (wrong > self.correctable)


def train(labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          rows: int = TRAIN_ROWS) -> Model:
    """A model from about ``rows`` labelled rows per language."""
    known = labelled.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    names = known.groupBy(F.col(f"`{lang}`").alias("lang")).count().orderBy("lang").collect()    # one row per language
    if not names:
        return Model([], np.zeros((0, 1)))
    place = F.pmod(F.xxhash64(F.col(f"`{doc_id}`").cast("string")), F.lit(1_000_000))
    limit = F.create_map(*[F.lit(x) for r in names for x in (r["lang"], min(1_000_000, math.ceil(1e6 * rows / r["count"])))])
    number = F.create_map(*[F.lit(x) for i, r in enumerate(names) for x in (r["lang"], i)])
    sample = known.where(place < limit[F.col(f"`{lang}`")]) \
        .select(number[F.col(f"`{lang}`")].alias("number"), F.col(f"`{text}`").alias("text")).repartition(16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), 1 << BITS), np.int64)
        for batch in small_batches(batches, "text", 1 << 20):
            own = batch.column("number").to_numpy().astype(np.int64) << BITS
            for at, feature in ngrams(*text_buffer(batch.column("text"))):
                total += np.bincount(own[at] | feature, minlength=total.size).reshape(total.shape)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used])], names=["cell", "n"])

    # at most languages x 2^BITS cells
    cells = sample.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(names) << BITS)
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(float)
    return Model([r["lang"] for r in names], counts.reshape(len(names), -1))


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) with lang_pred, score, bits_wrong and ambiguous; these replace columns of their names."""
    own = {"lang_pred", "score", "bits_wrong", "ambiguous"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    names = [f"_k{i}" for i in range(len(keep))]
    src = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)], F.col(f"`{text}`").alias("_text"),
                      F.coalesce(F.col(f"`{text}`").rlike("\\p{L}"), F.lit(False)).alias("_letter"))
    schema = T.StructType(src.select(*names).schema.fields + T._parse_datatype_string(
        "lang_pred string, score double, bits_wrong int, ambiguous boolean").fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in small_batches(batches, "_text", 1 << 20):
            letter = np.asarray(batch.column("_letter")) & bool(m.languages)
            best, score, wrong, unsure = m.decode(m.margins(*text_buffer(batch.column("_text"))))
            cols = [batch.column(k) for k in names] + [
                pa.array([m.languages[b] if ok else "und" for b, ok in zip(best, letter)], pa.string()),
                pa.array(np.where(letter, np.clip(score, 0, 1), 0.0)), pa.array(np.where(letter, wrong, 0), pa.int32()),
                pa.array(unsure | ~letter)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "lang_pred", "score", "bits_wrong", "ambiguous"])

    return src.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keep)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns: learned from the rows that are not held out."""
    model = train(docs.where(~held_out()))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(rows, model, keep=["doc_id", "held_out"])
