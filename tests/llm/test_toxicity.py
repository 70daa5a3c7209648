import random
import zlib

import numpy as np

from rxlake.llm import toxicity as X


def test_grammar():
    H, O = (X.HIT, 4.0), (X.OTHER, 0.0)  # noqa: E741
    sorts = lambda *t: {k: v for k, v in X.clause_weights(list(t))[0].items() if v}
    you, no, said, quote, kill = ((k, 0.0) for k in (X.TARGET, X.NEGATION, X.REPORT, X.QUOTE, X.THREAT))
    assert sorts(O, H) == {"plain": 4.0}
    assert sorts(you, O, H) == sorts(H, O, you) == {"targeted": 4.0}
    assert sorts(no, O, O, H) == {"negated": 4.0} and sorts(no, O, O, O, H) == {"plain": 4.0}
    assert sorts(said, O, O, O, O, H) == {"reported": 4.0}
    assert sorts(quote, H, quote, O) == {"reported": 4.0} and sorts(quote, O, quote, H) == {"plain": 4.0}
    assert sorts(H, said, H) == {"plain": 4.0, "reported": 4.0}
    assert X.clause_weights([kill, you])[1] == 1 and X.clause_weights([kill])[1] == X.clause_weights([no, kill, you])[1] == 0


def test_composition_runs_like_its_parts():
    rnd = random.Random(0)
    parts = (X.NEGATION_T, X.REPORT_T, X.TARGET_T)
    moves, marks = X.compose(*parts)
    for _ in range(50):
        state, own = 0, [0, 0, 0]
        for _ in range(20):
            c = rnd.randrange(7)
            state, own = moves[state][c], [p.table[s][c] for p, s in zip(parts, own)]
            assert marks[state].tolist() == [p.marks[s] for p, s in zip(parts, own)]


def test_compact_keeps_words_and_open_stems():
    m = X.compact({"mor": (50, 4.), "moro": (50, 4.), "moron": (50, 5.), "moron$": (49, 5.), "veq": (90, 4.), "vequ": (90, 4.5),
                   "vequa": (30, 4.), "vequi": (40, 4.), "longestwo$": (8, 3.), "zzz$": (7, 3.)})
    assert m.words == {"moron": 5., "longestwo": 3., "zzz": 3.} and m.stems == {"vequ": 4.5}
    assert m.weight("vequxyz") == 4.5 and m.weight("vequ") == 0 and m.weight("morons") == 0


def corpus():
    rnd = random.Random(7)
    syll = ["an", "ber", "ti", "lo", "é", "mu", "sha", "ro"]
    word = lambda: "".join(rnd.choice(syll) for _ in range(rnd.randrange(1, 4)))
    docs, labels = [], []
    for i in range(900):
        w = [word() for _ in range(rnd.choice([5, 30, 200]))]
        toxic = i % 6 == 0
        if toxic:
            w[rnd.randrange(len(w))] = rnd.choice(["Grumpf", "vex" + word(), "vex" + word()])
        docs.append((i, rnd.choice([" ", ". "]).join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    extra = [(5000, None), (5001, ""), (5002, "no words. grumpf!"), (5003, "ti " * 60_000 + "vexlolo"), docs[0]]
    df = spark.createDataFrame([(*d, "x") for d in docs + extra], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + labels[:3] + [(6, 1), (12, None), (18, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in X.report(df, lab).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert all(r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.98
    assert [got[i].predicted for i in range(5000, 5004)] == [0, 0, 1, 1]
    assert X.report(df.limit(0), lab).count() == 0
    assert {r.score for r in X.report(df, lab.limit(0)).collect()} == {0.0}
