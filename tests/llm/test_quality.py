import math
import random
import re

from pyspark.sql import functions as F

from rxlake.llm import quality as Q


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i:i + 3]), []).append(i)
    hit = {j for v in grams.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_metrics_equal_brute_force(spark):
    rnd = random.Random(5)
    docs = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r"), (3, "a"), (4, "a b"), (5, "a a a a a"), (6, "𝒳é || <é>\n\n\n"),
            (7, "x y z x y z"), (8, "a b a b a b a"), (9, "q\nq\n q\nq"), (10, "w " * 30_000), (11, " ".join(map(str, range(60_000))))]
    for i in range(12, 90):
        docs.append((i, "".join(rnd.choice(["a", "b", "cc", "$", "Ü"]) + rnd.choice([" ", "  ", "\n", "\t"])
                                for _ in range(rnd.choice([4, 40, 160])))))
    docs += docs[:3]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, n_words int")
    got = sorted(map(tuple, Q.with_metrics(df).select("doc_id", *Q.METRICS, "base_failed").collect()))
    assert got == sorted((i, *brute(t)) for i, t in docs)


def test_binomial_bound(spark):
    cases = [(0, 10, .01), (3, 400, .02), (19, 1000, .02), (0, 5000, .0125), (150, 20_000, .01)]
    for k, n, p in cases:
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1)
                                  + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
        got = spark.range(1).select(Q.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert math.isclose(got, want, rel_tol=1e-8)


def labelled(spark, n=3000, lang="en"):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = ["w%d" % rnd.randrange(10**6) + ("***" if bad else "") for _ in range(60)]
        rows.append((i, lang if i % 40 else None, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    return (spark.createDataFrame(rows, "doc_id long, lang string, text string"),
            spark.createDataFrame(labels + labels[:5] + [(7, 0), (8, None)], "doc_id long, quality int"))


def test_cutoffs_reject_bad_and_keep_good(spark):
    docs, labels = labelled(spark)
    r = {x.doc_id: x.kept for x in Q.report(docs, labels).collect()}
    assert all(r[i] for i in r if i % 5)
    assert not any(r[i] for i in r if i % 5 == 0 and i % 40)
    assert all(r[i] for i in r if i % 40 == 0)          # 75 rows of null language: nothing certified
    docs = docs.withColumn("n_words", F.lit("clash"))
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.values())


def plain_verdicts(rows, good, alpha, delta, path):
    """kept by id, and the step by stratum: exact binomial sums in plain Python."""
    of = {}
    for i, stratum, shares, base in rows:
        if not base and i in good:
            of.setdefault(stratum, []).append((shares, good[i]))
    steps = {}
    for stratum, members in of.items():
        best = None
        n, bad = sum(g for _, g in members), sum(not g for _, g in members)
        for at, p in enumerate(path):
            out = [g for shares, g in members if any(shares[r] > p[r] for r in Q.RULES)]
            k = sum(out)
            risk = sum(math.comb(n, j) * alpha**j * (1 - alpha)**(n - j) for j in range(k + 1))
            if not n or k > n * alpha or risk > delta / len(of):
                break
            gain = (len(out) - k) / max(bad, 1) - k / n
            if best is None or gain > best[0]:
                best = (gain, at)
        if best:
            steps[stratum] = best[1]
    kept = {i: not base and (stratum not in steps or not any(shares[r] > path[steps[stratum]][r] for r in Q.RULES))
            for i, stratum, shares, base in rows}
    return kept, steps


def test_cutoffs_and_verdicts_equal_plain_python(spark):
    rnd = random.Random(11)
    rows, good, i = [], {}, 0
    for stratum, n, noise in (("en", 700, .01), ("fr", 300, .03), ("de", 160, 0), ("es", 60, 0), (None, 200, .3)):
        for _ in range(n):
            bad = rnd.random() < .25
            top = .9 if bad or rnd.random() < noise else .05
            rows.append((i, stratum, {r: rnd.choice([0.0, rnd.random() * top]) for r in Q.RULES}, rnd.random() < .05))
            if rnd.random() < .95:
                good[i] = int(not bad)
            i += 1
    measured = spark.createDataFrame([(i, s, *(x[r] for r in Q.RULES), b) for i, s, x, b in rows],
                                     "doc_id long, lang string, " + ", ".join(f"{r} double" for r in Q.RULES)
                                     + ", base_failed boolean")
    labels = spark.createDataFrame(list(good.items()), "doc_id long, quality int")
    want, steps = plain_verdicts(rows, good, .05, .05, Q.joint_path())
    limits = Q.cutoffs(measured, labels).cache()
    assert {r.stratum: r.step for r in limits.collect()} == {s or "\0": k for s, k in steps.items()}
    assert {"en", "de"} <= set(steps) and not {"es", None} & set(steps)
    assert {r.doc_id: r.kept for r in Q.judge(measured, limits).collect()} == want


def test_path_never_turns_lenient():
    path = Q.joint_path()
    assert all(a[r] > b[r] for a, b in zip(path, path[1:]) for r in Q.RULES)


def test_no_labels_keeps_all_that_pass_the_base(spark):
    docs, labels = labelled(spark, 50)
    assert Q.report(docs, labels.limit(0)).where("kept").count() == 50
    assert Q.report(docs.limit(0), labels).count() == 0
