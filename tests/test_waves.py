"""Top-k gram table (Q1, T3) and first token by waves (Q8) against plain loops."""

import random

from helpers import rows
from rxlake.functions import text as T
from rxlake.operators import lookup as L
from rxlake.plans import jobs as J

MED = "item_seq string, item_name string, entp_name string, drug_shape string, color_class1 string, color_class2 string, " \
      "etc_otc_code string, chartn string"


def medicines(spark, names):
    data = [(str(i), n, "co", "round", "red", "", "OTC", "d") for i, n in enumerate(names)]
    return spark.createDataFrame(data, MED).withColumn("name_fold", T.fold_ascii("item_name")).repartition(4)


def like(name, term):
    import re
    pattern = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in term.lower())
    return re.search(f"(?s){pattern}", name.lower()) is not None


def brute(names, term, k):
    ok = sorted((n, str(i)) for i, n in enumerate(names) if n is not None and like(n, term))
    return [s for _, s in ok[:k]]


def test_gram_table_equals_plain_loops(spark):
    rnd = random.Random(3)
    names = ["".join(rnd.choice("abcAB 약") for _ in range(rnd.randrange(0, 9))) for _ in range(150)] + [None] + ["aaaa"] * 60
    terms = sorted({"".join(rnd.choice("abcB 약%_") for _ in range(rnd.randrange(0, 8))) for _ in range(120)} | {"a", "", "abcabcab"})
    med = medicines(spark, names)
    req = spark.createDataFrame([(t,) for t in terms], "term string")
    grams = L.build_gram_topk(med, ["item_seq", "item_name"], ["item_name", "item_seq"], 5).checkpoint()
    for given in (None, grams):         # a table of 5 rows a gram answers k = 3 too
        out = L.first_matches(req, med, "term", ["item_seq", "item_name"], ["item_name", "item_seq"], 3, strategy="ngram", grams=given)
        got = {}
        for t, r, s in sorted(rows(out, "term", "rank", "item_seq")):
            got.setdefault(t, []).append(s)
            assert r == len(got[t])
        assert got == {t: b for t in terms if (b := brute(names, t, 3))}


def test_short_term_makes_k_rows(spark):
    """A one-character term that most names contain: k rows of the gram table, no list of names."""
    med = medicines(spark, [f"a{i:04d}" for i in range(3000)])
    grams = L.build_gram_topk(med, ["item_seq", "item_name"], ["item_name", "item_seq"], 5).checkpoint()
    assert grams.where("gram = 'a'").count() == 5
    assert grams.groupBy("gram").count().where("count > 5").isEmpty()
    req = spark.createDataFrame([("a",), ("A",), ("00",)], "term string")
    out = L.first_matches(req, med, "term", ["item_seq", "item_name"], ["item_name", "item_seq"], 5, strategy="ngram", grams=grams)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 15 and "Generate" not in plan         # no posting list is built or read


def test_waves_equal_plain_loops(spark):
    rnd = random.Random(4)
    names = ["alpha", "beta gamma", "al", "약국", "Beta", "zz top"]
    vocab = ["alp", "BETA", "x", "qq", "약국", "gamma", "nothing", "top", "%a", "ww", "vv", "uu", "tt"]
    texts = [" ".join(rnd.choice(vocab[3:] if i % 3 else ["qq", "ww", "vv", "uu", "tt"]) for _ in range(rnd.randrange(0, 60)))
             for i in range(80)] + [None, "", "qq " * 500 + "alp"]
    msgs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    report = []
    out = J.token_context(msgs, medicines(spark, names), ["id"], "text", 2, report)
    got = {i: (t, n) for i, t, n in rows(out, "id", "matched_token", "n_hits")}
    want = {}
    for i, t in enumerate(texts):
        for w in (t or "").split():
            if len(w) >= 2 and (b := brute(names, w, 2)):
                want[i] = (w, len(b))
                break
    assert got == want
    # matched messages leave, every token is searched once, and late tokens of matched messages never
    assert [r["messages"] for r in report] == sorted((r["messages"] for r in report), reverse=True)
    assert sum(r["matched"] for r in report) == len(want)
    assert sum(r["searched"] for r in report) <= len({w for t in texts for w in (t or "").split()})
    assert sum(r["tokens"] for r in report) < sum(len((t or "").split()) for t in texts)


def test_waves_without_tokens(spark):
    msgs = spark.createDataFrame([(1, None), (2, "a b")], "id long, text string")
    out = J.token_context(msgs, medicines(spark, ["a"]), ["id"], "text")
    assert out.columns == ["id", "matched_token", "n_hits", "context"] and out.count() == 0
