"""Toxicity by a weighted finite-state grammar over clauses.

Lexicon.  From labelled rows: words, and word beginnings of 3 to 8 letters, that
are much more frequent in toxic documents (document frequencies, log-odds of
at least ``MIN_ODDS``, in ``MIN_DOCS`` toxic documents or more).  A beginning that
nearly all its documents continue alike is replaced by the continuation, so a
lone word stays a word and only a true stem, shared by many words, stays open.
The learned entries are insults; threats, targets, negations and verbs of
reported speech are short fixed lists.

Grammar.  Transducers over the token classes of a clause:

* insult: emits the weight of each insult or threat;
* negation: marks what follows a negation within ``REACH`` tokens;
* reported speech: marks what follows such a verb, or stands between quotes;
* target: decides at the clause's end whether anybody was addressed.

Their composition is one machine whose states are pairs of their states; it is
built as a table and run over each clause that has an insult or threat.  A
clause's emissions come out as plain, targeted, negated or reported weight.

Score.  The highest weight of each sort over the clauses and the number of hits
are the features of a logistic regression, fitted to labelled rows.  Documents
without a match all get its intercept.

Both fits use a sample of at most about ``TRAIN_TOXIC`` toxic and ``TRAIN_CLEAN``
other labelled rows, chosen by the hash of their ids; whole texts are used.

Defined results: null and empty texts have no clause and get the intercept's
score; rows without a label or with contradicting ones are not learned from;
with labels of one kind, or none, the lexicon is empty and every score is the
share of toxic labels (0 without any); repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rxlake.llm.langid import held_out
from rxlake.llm.store import written
from rxlake.llm.words import small_batches, text_buffer, word_spans

TRAIN_TOXIC, TRAIN_CLEAN = 3000, 6000
MIN_DOCS, MIN_ODDS = 5, 3.0
SAME = 0.9                      # share of a beginning's documents that its continuation must keep
REACH = 3
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

OTHER, HIT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
FIXED = {
    THREAT: "kill hurt beat burn shoot destroy töten schlagen verletzen vernichten tuer frapper blesser détruire matar "
            "golpear herir destruir",
    TARGET: "you your yours u he she him her they them du dich dir ihr euch sie tu te toi vous usted ustedes vosotros",
    NEGATION: "not no never nor nicht kein keine nie niemals pas jamais aucun nunca jamás",
    REPORT: "said says wrote writes called calls quoted told sagte schrieb nannte dit écrit appelé dijo escribió llamó",
}
CLASS = {w: k for k, words in FIXED.items() for w in words.split()}
SORTS = ["plain", "targeted", "negated", "reported"]
FEATURES = [*SORTS, "threat", "hits"]


class Transducer:
    """States 0.., a move per (state, class), and a mark that a state puts on what it reads."""

    def __init__(self, moves: dict[tuple[int, int], int], states: int, marks: list[int], default: dict[int, int]):
        self.states, self.marks = states, marks
        self.table = np.array([[moves.get((s, c), default[s]) for c in range(7)] for s in range(states)])


#: counts down REACH tokens after a negation
NEGATION_T = Transducer({(s, NEGATION): REACH for s in range(REACH + 1)}, REACH + 1, [0] + [1] * REACH,
                        {s: max(s - 1, 0) for s in range(REACH + 1)})
#: 1 after a verb of speech, 2 inside quotes
REPORT_T = Transducer({(0, REPORT): 1, (0, QUOTE): 2, (1, QUOTE): 2, (2, QUOTE): 0}, 3, [0, 1, 1], {0: 0, 1: 1, 2: 2})
#: 1 once somebody is addressed
TARGET_T = Transducer({(0, TARGET): 1}, 2, [0, 1], {0: 0, 1: 1})


def compose(*parts: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """(moves: product state x class, marks: product state x part) of machines run side by side."""
    sizes = [p.states for p in parts]
    states = np.array(np.unravel_index(np.arange(math.prod(sizes)), sizes)).T
    moves = np.stack([np.ravel_multi_index([p.table[s, c] for p, s in zip(parts, states.T)], sizes) for c in range(7)], 1)
    return moves, np.stack([np.array(p.marks)[s] for p, s in zip(parts, states.T)], 1)


MOVES, MARKS = (x.tolist() for x in compose(NEGATION_T, REPORT_T, TARGET_T))


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    intercept: float = -math.inf

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in range(3, min(len(word), 9)):
            best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def starts(self) -> np.ndarray:
        """Table over hashes of a word's first three bytes: may it be a hit or a threat?"""
        out = np.zeros(1 << 16, bool)
        for w in [*self.words, *self.stems, *(w for w, k in CLASS.items() if k == THREAT)]:
            out[_start(np.frombuffer(w.encode()[:3], np.uint8).astype(np.int64)[:, None])] = True
        return out


def _start(b: np.ndarray) -> np.ndarray:
    return (b[0] * 40_503 + b[1] * 2_654_435 + b[2] * 97) & 0xFFFF


def clause_weights(tokens: list[tuple[int, float]]) -> tuple[dict[str, float], float, int]:
    """(highest weight of each sort, threat, hits) of one clause of (class, weight)."""
    state, found, threat = 0, [], 0.0
    for kind, weight in tokens:
        negated, reported, _ = MARKS[state]
        if kind == HIT:
            found.append(("reported" if reported else "negated" if negated else "", weight))
        elif kind == THREAT and not negated and not reported:
            threat = 1.0
        state = MOVES[state][kind]
    target = MARKS[state][2]
    out: dict[str, float] = defaultdict(float)
    for sort, weight in found:
        sort = sort or ("targeted" if target else "plain")
        out[sort] = max(out[sort], weight)
    return out, threat if target else 0.0, len(found)


_TOKEN = re.compile('["“”«»]|' + WORD)


def features(texts: pa.Array, model: Model, starts: np.ndarray) -> np.ndarray:
    """texts x FEATURES of lower-cased texts."""
    offsets, raw = text_buffer(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    s, e, _ = word_spans(offsets, raw)
    long = e - s >= 3
    s, e = s[long], e[long]
    if not len(s):
        return out
    maybe = starts[_start(np.stack([raw[s], raw[s + 1], raw[s + 2]]).astype(np.int64))]
    ends_clause = np.flatnonzero((raw == 46) | (raw == 33) | (raw == 63) | (raw == 59) | (raw == 10))
    done = -1
    for a, b in zip(s[maybe].tolist(), e[maybe].tolist()):
        if a < done:
            continue                # its clause is read already
        word = raw[a:b].tobytes().decode()
        if not model.weight(word) and CLASS.get(word) != THREAT:
            continue
        doc = int(np.searchsorted(offsets, a, side="right")) - 1
        k = int(np.searchsorted(ends_clause, a))
        lo = max(int(ends_clause[k - 1]) + 1 if k else 0, int(offsets[doc]))
        hi = min(int(ends_clause[k]) if k < len(ends_clause) else len(raw), int(offsets[doc + 1]))
        done = hi
        tokens = []
        for t in _TOKEN.findall(raw[lo:hi].tobytes().decode()):
            w = model.weight(t)
            tokens.append((HIT, w) if w else (QUOTE if t in '"“”«»' else CLASS.get(t, OTHER), 0.0))
        best, threat, hits = clause_weights(tokens)
        row = out[doc]
        for i, sort in enumerate(SORTS):
            row[i] = max(row[i], best.get(sort, 0.0))
        row[4] = max(row[4], threat)
        row[5] += hits
    out[:, 5] = np.log1p(out[:, 5])
    return out


def lexicon(sample: DataFrame) -> Model:
    """Insult words and stems from a sample (text lower-cased, toxic 0/1)."""
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Model()
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    begins = lambda w: F.transform(F.sequence(F.lit(3), F.lit(8)), lambda k: F.when(
        F.length(w) > k, F.substr(w, F.lit(1), k)))
    entries = F.array_distinct(F.array_compact(F.concat(
        F.transform("words", lambda w: F.when(F.length(w) >= 3, F.concat(w, F.lit("$")))),
        F.flatten(F.transform("words", begins)))))
    df = sample.select("toxic", words.alias("words")).select("toxic", F.explode(entries).alias("entry")) \
        .groupBy("entry").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    odds = F.log((F.col("a") + 0.5) / (n[1] + 1)) - F.log((F.col("n") - F.col("a") + 0.5) / (n[0] + 1))
    # bounded by the sample
    rows = df.where(F.col("a") >= MIN_DOCS).select("entry", "a", odds.alias("odds")).where(F.col("odds") >= MIN_ODDS).collect()
    return compact({r.entry: (r.a, r.odds) for r in rows})


def compact(entries: dict[str, tuple[int, float]]) -> Model:
    """Words and open stems from entries ("stem" or "word$") with (documents, weight)."""
    children = defaultdict(list)
    for e in entries:
        children[e[:-1]].append(e)                       # "abc" -> "abcd", "abc$"
    for e in entries:                                    # whole words longer than the longest beginning
        if e.endswith("$") and len(e) > 9:
            children[e[:8]].append(e)
    model = Model()
    todo = [e for e in entries if e[:-1] not in entries and not (len(e) > 9 and e[:8] in entries)]
    while todo:
        e = todo.pop()
        docs, weight = entries[e]
        if e.endswith("$"):
            model.words[e[:-1]] = weight
            continue
        follow = [c for c in children[e] if entries[c][0] >= SAME * docs]
        if follow:
            todo.append(max(follow, key=lambda c: (entries[c][0], c)))
        else:
            model.stems[e] = weight
    return model


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[list[float], float]:
    """Logistic regression by Newton steps with a small ridge penalty."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge * len(x)] * x.shape[1] + [1e-6]) / 100
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1].tolist(), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the rows of ``docs`` that ``labels`` (doc_id, 0/1) covers."""
    clear = labels.groupBy("doc_id").agg(F.min(label).alias("lo"), F.max(label).alias("toxic")) \
        .where("lo = toxic and toxic in (0, 1)").select(F.col("doc_id").alias("_id"), "toxic")
    ids = written(docs.select(F.col(f"`{doc_id}`").alias("_id")).join(clear, "_id"), "toxic-labels")
    n = {r.toxic: r["count"] for r in ids.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1_000_000))
    limit = lambda k, most: math.ceil(1e6 * min(1.0, most / max(n.get(k, 0), 1)))
    chosen = ids.where(place < F.when(F.col("toxic") == 1, limit(1, TRAIN_TOXIC)).otherwise(limit(0, TRAIN_CLEAN))).distinct()
    sample = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text")) \
        .join(F.broadcast(chosen), "_id").select("text", "toxic")       # ids: bounded by the sample's size
    sample = written(sample.repartition(16), "toxic-sample")
    model = lexicon(sample)
    if not model.words and not model.stems:
        share = n.get(1, 0) / max(sum(n.values()), 1)
        model.intercept = math.log(share / (1 - share)) if 0 < share < 1 else math.inf if share else -math.inf
        return model
    # bounded by the sample: one small row per document
    rows = _with_features(sample, model, ["toxic"]).toPandas()
    model.weights, model.intercept = fit(np.array(rows["features"].tolist()), rows["toxic"].to_numpy(float))
    return model


def _with_features(df: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """names and features of (names, text lower-cased)."""
    schema = T.StructType(df.select(*names).schema.fields + [T.StructField("features", T.ArrayType(T.DoubleType()))])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        starts = m.starts()
        for batch in small_batches(batches, "text", 1 << 20):
            x = features(batch.column(batch.schema.get_field_index("text")), m, starts)
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.ListArray.from_arrays(at, pa.array(x.ravel()))],
                                             names=[*names, "features"])

    return df.select(*names, "text").mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) with score, predicted and clause weights by sort; these replace columns of their names."""
    own = {"score", "predicted", "clauses"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    names = [f"_k{i}" for i in range(len(keep))]
    src = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)],
                      F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text"))
    x = _with_features(src, model, names)
    z = F.lit(model.intercept)
    for i, w in enumerate(model.weights):
        z = z + F.get("features", F.lit(i)) * float(w)
    value = (1 / (1 + F.exp(-z))) if math.isfinite(model.intercept) else F.lit(1.0 if model.intercept > 0 else 0.0)
    parts = F.struct(*[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(FEATURES)])
    return x.withColumn("score", value).select(*[F.col(k).alias(c) for c, k in zip(keep, names)], "score",
                                               (F.col("score") >= 0.5).cast("int").alias("predicted"), parts.alias("clauses"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: learned from the rows that are not held out."""
    learn = ~held_out()
    model = train(docs.where(learn).select("doc_id", "text"), labels.where(learn))
    return score(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep=["doc_id", "held_out"]) \
        .select("doc_id", "held_out", "score", "predicted")
