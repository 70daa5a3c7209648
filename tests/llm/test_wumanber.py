import random
import re

import pytest

from rxlake.llm import wumanber as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return WORD.findall(t)


def brute(docs, items, window=13):
    out = []
    for _, t in docs:
        w, hit, ids = words(t), set(), set()
        for key, it in items:
            p = words(it)
            m = min(window, len(p))
            for i in range(len(p) - m + 1) if p else ():
                for j in range(len(w) - m + 1):
                    if w[j:j + m] == p[i:i + m]:
                        hit.update(range(j, j + m))
                        if key is not None:
                            ids.add(str(key))
        out.append((len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_ids string")
    b = spark.createDataFrame(items, "item_id long, text string")
    r = W.decontaminate(d, b, **kw)          # d has a column that clashes with a result's
    return sorted((x.doc_id, x.n_words, x.n_hit, list(x["item_ids"]), x.contaminated) for x in r.collect())


@pytest.mark.parametrize("size", [16 << 20, 60])
def test_equals_brute_force(spark, size):
    rnd = random.Random(3)
    vocab = ["a", "bb", "É", "Zeta", "9", "ñu"]
    text = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rnd.choice([1, 3, 4, 9]))) for i in range(9)] + [(None, text(5)), (3, None), (4, ""), (5, "...")]
    docs = [(i, text(rnd.choice([0, 1, 5, 30, 700])), "x") for i in range(40)] + [(99, None, "x"), (100, "", None)]
    docs += docs[:2]
    got = run(spark, docs, items, window=4, max_pattern_bytes=size)
    want = sorted((d[0], *r) for d, r in zip(docs, brute([d[:2] for d in docs], items, 4)))
    assert got == want


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    assert run(spark, [(1, "a b c", None)], []) == [(1, 3, 0, [], False)]


def test_oracle(spark, duck):
    from llm_helpers import SF001
    r = W.report(spark.read.parquet(f"{SF001}/documents.parquet"), spark.read.parquet(f"{SF001}/benchmark.parquet"))
    got = sorted(map(tuple, r.collect()))
    assert got == sorted(duck.execute(W.ORACLE).fetchall())
    assert sum(x[2] > 0 for x in got) > 0
