import random
import re
from collections import Counter

import numpy as np
import pytest

from rxlake.llm import dartminhash as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(t):
    w = WORD.findall((t or "").lower())
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    lo, hi = sum((a & b).values()), sum((a | b).values())
    return lo / hi if hi else 0.0


def brute(docs, threshold=0.8):
    s = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            same = (docs[i][1] or "") == (docs[j][1] or "")
            if same or similarity(s[i], s[j]) >= threshold:
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(docs):
        low[find(i)] = min(k, low.get(find(i), k))
    return sorted((k, low[find(i)]) for i, (k, _) in enumerate(docs))


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    element = rng.integers(0, 2**63, 300).astype(np.uint64)
    wa, wb = rng.uniform(.2, 4, 300), rng.uniform(.2, 4, 300)
    wb[:150] = wa[:150]
    sig = D.dart_signatures(np.repeat([0, 1], 300), np.tile(element, 2), np.concatenate([wa, wb]), 3, 4096)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03
    assert (sig[2] == 0).all()


def corpus(seed, families=12, size=14):
    rnd = random.Random(seed)
    vocab = ["w%d" % i for i in range(4000)]
    docs = []
    for _ in range(families):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([4, 9, 60, 300]))]
        for _ in range(size):
            rate = rnd.choice([0, 0, .002, .01, .02, .05, .2])
            docs.append(" ".join(rnd.choice(vocab) if rnd.random() < rate else w for w in base))
    line = " ".join(rnd.choice(vocab) for _ in range(8)) + "\n"
    docs += [line * 30, line * 27, line * 10, "", None, "...", "a b", "A  b!", "a c", "x " * 50_000]
    rnd.shuffle(docs)
    return [(i * 3, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    docs = corpus(seed)
    docs += docs[:4]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, node int").repartition(5)
    got = sorted((r.doc_id, r.class_id) for r in D.report(df).collect())
    assert got == brute(docs)
    kept = D.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got})


def test_large_group_of_near_copies(spark):
    rnd = random.Random(9)
    base = ["t%d" % rnd.randrange(10**6) for _ in range(150)]
    docs = [(0, " ".join(base))]
    for i in range(1, 400):
        rate = rnd.choice([.005, .01, .02, .03])
        docs.append((i, " ".join("r%d" % rnd.randrange(10**6) if rnd.random() < rate else w for w in base)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = dict((r.doc_id, r.class_id) for r in D.report(df).collect())
    assert sorted(got.items()) == brute(docs)


def test_edited_versions_of_a_large_group(spark):
    """Versions at 0.82 of a version at 0.95 of a large group, themselves below 0.8 of it."""
    rnd = random.Random(4)
    base = ["t%d" % i for i in range(400)]

    def edited(words, places):
        return ["r%d" % rnd.randrange(10**9) if i in places else w for i, w in enumerate(words)]

    texts = [edited(base, {rnd.randrange(10, 390)}) for _ in range(12)]
    for _ in range(60):
        places = rnd.sample(range(10, 390, 10), 10)
        once = edited(base, set(places[:2]))
        texts += [once, edited(once, set(places[2:]))]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = D.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute(docs)
    s = [shingles(t) for _, t in docs]
    degree = [sum(similarity(a, b) >= 0.8 for b in s) - 1 for a in s]
    # a lower bound, 0 only without a link; a version with one link has it
    assert all(min(1, degree[r.doc_id]) <= r.n_links <= degree[r.doc_id] for r in got)
    assert {degree[i] for i in range(13, len(docs), 2)} == {1}


@pytest.mark.parametrize("seed", [1, 2])
def test_apart_members_meet_by_rare_shingles(spark, seed):
    """Every link between components is among the pairs; pairs that share only what is common do not meet."""
    rnd = random.Random(seed)
    sets = []
    for _ in range(12):
        base = list(range(rnd.choice([9, 45, 100])))                        # held by all
        own = rnd.sample(range(1000, 1400), max(1, len(base) // rnd.choice([3, 8])))
        for _ in range(8):
            kept = [x for x in base + own if rnd.random() > rnd.choice([0, .02, .1, .2])] or [0]
            sets.append(sorted(set(kept + rnd.sample(range(5000, 5200), rnd.randrange(3)))))
    roots = [(i, rnd.randrange(i + 1) if rnd.random() < .3 else i) for i in range(len(sets))]
    buckets = [(b, i) for i in range(len(sets)) for b in {rnd.randrange(3), 7}]
    pairs = D._apart(spark.createDataFrame(buckets, "bucket long, node long"),
                     spark.createDataFrame(roots, "node long, root long"),
                     spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "node long, n int, shingles array<int>"), 0.8)
    got = {(min(r), max(r)) for r in map(tuple, pairs.collect())}
    apart = [(i, j) for j in range(len(sets)) for i in range(j) if roots[i][1] != roots[j][1]]
    links = {(i, j) for i, j in apart if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
    assert links and links <= got <= set(apart)
    assert len(got) < len(apart) / 2


def test_keep_first_without_ids(spark):
    long = " ".join("a%d" % i for i in range(100))
    near = long.replace("a50", "b")
    docs = [(None, long), (7, long), (5, long), (None, near), (8, near),      # a class with ids: 5
            (None, "x y z"), (None, "x y z"),                                  # without ids: one
            (None, long[::-1]), (None, long[::-1] + " end"), (9, "else")]     # without ids, near copies: one
    kept = D.keep_first(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [5, 9]
    assert sorted(r.text[:3] for r in kept if r.doc_id is None) == sorted(["x y", long[::-1][:3]])


def test_components_of_a_path(spark):
    n = 60
    ids = random.Random(0).sample(range(-1000, 1000), n)
    e = spark.createDataFrame(list(zip(ids, ids[1:])) + [(5000, 6000)], "a long, b long")
    got = dict(map(tuple, D.components(e).collect()))
    assert all(got.get(i, i) == min(ids) for i in ids) and got[6000] == 5000


def test_empty(spark):
    assert D.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
