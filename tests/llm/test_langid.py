import math
import zlib

import numpy as np
import pytest

from rxlake.llm import langid as L


def texts():
    words = {"en": "the and of to in is that for with this are on not have from".split(),
             "de": "der die und das nicht ein ist mit auf für dem sich des auch werden".split(),
             "fr": "le la les des et est dans pour que une sur pas plus par avec".split(),
             "es": "el los las que del una por con para está como más pero sus este".split()}
    rng = np.random.default_rng(1)
    return [(i, " ".join(rng.choice(words[k], rng.integers(3, 60))), k) for i in range(800) for k in [list(words)[i % 4]]]


def test_codewords():
    for n in (2, 3, 4, 6, 7, 40):
        code = L.codewords(n)
        assert code.shape[0] == n and (np.abs(code.sum(0)) < n).all()
        d = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert min(d) >= (1 if n == 2 else 2 ** (n - 2) if n <= 6 else 5)


def test_ngrams_by_hand():
    raw = np.frombuffer(b"aBcd1x", np.uint8)
    got = [(int(n), t.tolist()) for n, (t, _) in zip((2, 3, 4), L.ngrams(np.array([0, 4, 4, 6]), raw))]
    assert got == [(2, [0, 0, 0, 2]), (3, [0, 0]), (4, [0])]
    a, b = (next(L.ngrams(np.array([0, 3]), np.frombuffer(x, np.uint8)))[1].tolist() for x in (b"AB!", b"ab?"))
    assert a == b


def test_held_out_accuracy(spark):
    docs = texts()
    docs += [(9000, None, "en"), (9001, "", "fr"), (9002, "12 !? 3", None), (9003, "der die das und nicht", None), docs[0]]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in L.report(df).collect()}
    assert len(got) == len(docs) - 1
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].lang_pred, k) for i, _, k in docs if i < 9000 and got[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert [got[i].lang_pred for i in range(9000, 9004)] == ["und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[9003].score > 0.5


def test_decoding_corrects_bits():
    counts = np.ones((4, 1 << L.BITS))
    for i in range(4):
        counts[i, 1000 * i:1000 * i + 900] = 50
    m = L.Model(list("abcd"), counts)
    good = m.code * 30
    assert m.decode(good)[0].tolist() == [0, 1, 2, 3] and not m.decode(good)[3].any()
    bad = good.copy()
    bad[:, 2] *= -.2
    assert m.decode(bad)[0].tolist() == [0, 1, 2, 3]
    assert m.decode(np.zeros((1, m.code.shape[1])))[3].all()


@pytest.mark.parametrize("rows", [[], [(1, "abc def", "xx"), (2, "ghi", None), (6, None, None)]])
def test_few_languages(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in L.predict(df, L.train(df)).collect()}
    assert got == ({1: "xx", 2: "xx", 6: "und"} if rows else {})
    none = L.predict(df, L.train(df.limit(0))).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in none)


def plain_predictions(train, asked):
    """(language, score, wrong bits) of every asked text, one n-gram at a time in plain Python."""
    def features(text):
        data = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
        for n in L.ORDERS:
            for i in range(len(data) - n + 1):
                packed = 0
                for b in data[i:i + n]:
                    packed = packed << 8 | b
                yield int(L.mix(np.array([packed * (2 * n + 1)], np.uint64))[0]) >> (64 - L.BITS)

    names, size = sorted({k for _, k in train}), 1 << L.BITS
    code = L.codewords(len(names)).tolist()
    counts = {k: {} for k in names}
    for text, k in train:
        for f in features(text):
            counts[k][f] = counts[k].get(f, 0) + 1
    share = []
    for k in names:
        total = sum(counts[k].values()) + L.SMOOTH * size
        share.append([(counts[k].get(f, 0) + L.SMOOTH) / total for f in range(size)])
    weights, trust = [], []
    for b in range(len(code[0])):
        plus, minus = ([p for p, c in zip(share, code) if c[b] == s] for s in (1, -1))
        w = [math.log((sum(p[f] for p in plus) / len(plus)) / (sum(p[f] for p in minus) / len(minus))) for f in range(size)]
        weights.append(w)
        trust.append(sum(max(0.0, sum(x * y for x, y in zip(p, w)) * c[b]) for p, c in zip(share, code)) / len(names))
    trust = [t / sum(trust) for t in trust]
    out = []
    for text in asked:
        found = list(features(text))
        margin = [sum(w[f] for f in found) / len(L.ORDERS) for w in weights]
        loss = [sum(t * (max(0.0, -m * x) + math.log1p(math.exp(-abs(m * x)))) for t, m, x in zip(trust, margin, c)) for c in code]
        best = min(range(len(names)), key=loss.__getitem__)
        score = 1 / sum(math.exp((loss[best] - x) * len(trust)) for x in loss)
        out.append((names[best], score, sum(m * x <= 0 for m, x in zip(margin, code[best]))))
    return out


def test_predictions_equal_plain_python(spark):
    docs = [(t, k) for _, t, k in texts()]
    mixed = [a[0][:40] + " " + b[0][:40] for a, b in zip(docs[200:230], docs[231:261])]     # two languages in one text
    asked = [t for t, _ in docs[160:220]] + mixed + ["x", "Ünïcode À la carte", "der the le el", "Que DAS is"]
    labelled = spark.createDataFrame([(i, *d) for i, d in enumerate(docs[:160])], "doc_id long, text string, lang string").repartition(3)
    src = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").repartition(4)
    got = sorted(L.predict(src, L.train(labelled)).collect(), key=lambda r: r.doc_id)
    want = plain_predictions(docs[:160], asked)
    assert [r.lang_pred for r in got] == [w[0] for w in want]
    assert [r.bits_wrong for r in got if r.text != "x"] == [w[2] for t, w in zip(asked, want) if t != "x"]
    assert np.allclose([r.score for r in got], [w[1] for w in want], rtol=1e-4, atol=1e-6)
