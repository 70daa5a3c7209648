"""Substring lookups: golden rows, strategy equivalence, brute force."""

import fnmatch
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import SF001, rows
from rxlake.functions import text as T
from rxlake.operators import lookup as L
from rxlake.plans import catalog as C


def catalogue(spark, names):
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "item_seq string, item_name string")
    return df.withColumn("name_fold", T.fold_ascii("item_name"))


def sqlite_like(name, term):
    """Brute force of SQLite ``name LIKE '%term%'`` (ASCII case folding)."""
    if name is None:
        return False
    fold = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    pat = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in fold(term))
    return re.search(pat, fold(name), re.S) is not None


NAMES = ["Aspirin", "ÄB", "a_b", None, "타이레놀정", "aspirin protect", "axb", "Zz", "ring gear", "RED plate"]
TERMS = ["aspirin", "äb", "_", "a_b", "레놀", "%", "__", "x", "in", "Ring", "a%b", "zz", "nothing", "정"]


@pytest.mark.parametrize("strategy", ["broadcast", "broadcast_names", "ngram"])
def test_like_semantics_match_brute_force(spark, strategy):
    cat = catalogue(spark, NAMES)
    req = spark.createDataFrame([(t,) for t in TERMS], "term string")
    got = set(rows(L.substring_matches(req, cat, "term", ["item_seq"], strategy=strategy), "term", "item_seq"))
    want = {(t, str(i)) for t in TERMS for i, n in enumerate(NAMES) if sqlite_like(n, t)}
    assert got == want


def test_golden_name_search(spark):
    cat = catalogue(spark, ["Aspirin", "ÄB", "a_b", None])
    req = spark.createDataFrame([("aspirin",), ("äb",), ("_",)], "term string")
    got = set(rows(L.substring_matches(req, cat, "term", ["item_name"]), "term", "item_name"))
    assert ("aspirin", "Aspirin") in got            # ASCII case folds
    assert ("äb", "ÄB") not in got                   # non-ASCII does not
    assert ("_", "a_b") in got                       # wildcard
    assert all(n is not None for _, n in got)        # null name never matches


@pytest.mark.parametrize("strategy", ["auto", "broadcast", "ngram"])
def test_blank_terms(spark, strategy):
    """The empty term matches every named row, blanks match names that hold them; null matches nothing."""
    cat = catalogue(spark, ["abc", "a  c", None, "b"])
    req = spark.createDataFrame([("",), ("",), ("  ",), (None,)], "term string")
    got = L.substring_matches(req, cat, "term", ["item_name"], strategy=strategy)
    assert sorted(rows(got, "term", "item_name")) == [("", "a  c"), ("", "abc"), ("", "b"), ("  ", "a  c")]
    first = L.first_matches(req, cat, "term", ["item_name", "item_seq"], ["item_name", "item_seq"], 2, strategy=strategy)
    assert sorted(rows(first, "term", "rank", "item_name")) == [("", 1, "a  c"), ("", 2, "abc"), ("  ", 1, "a  c")]


def test_first_matches_top_k_order(spark):
    cat = catalogue(spark, ["b x", "a x", "c x", "a x"])
    req = spark.createDataFrame([("x",)], "term string")
    out = L.first_matches(req, cat, "term", ["item_seq", "item_name"], ["item_name", "item_seq"], 3)
    assert rows(out.orderBy("rank"), "rank", "item_name", "item_seq") == [(1, "a x", "1"), (2, "a x", "3"), (3, "b x", "0")]


def test_ngram_equals_broadcast_on_data(spark):
    med = C.medicines_from_part(C.table(spark, SF001, "part"))
    kws = C.keywords(spark, SF001)
    a = L.first_matches(kws, med, "keyword", C.CAT_COLS, C.CAT_ORDER, 5, strategy="broadcast")
    b = L.first_matches(kws, med, "keyword", C.CAT_COLS, C.CAT_ORDER, 5, strategy="ngram")
    cols = ["term", "rank", "item_seq"]
    assert sorted(rows(a, *cols)) == sorted(rows(b, *cols))


def test_identify_optional_predicates(spark):
    med = spark.createDataFrame([
        ("1", "a", "원형", "하양", ""), ("2", "b", "원형", "", "하양"), ("3", "c", "타원형", "노랑", ""),
        ("4", "d", "장방형", "하양", "")],
        "item_seq string, item_name string, drug_shape string, color_class1 string, color_class2 string")
    for c in ["entp_name", "chartn", "etc_otc_code"]:
        med = med.withColumn(c, F.lit(""))
    req = spark.createDataFrame([("s", "원형", None), ("c", None, "하양"), ("b", "원형", "하양"),
                                 ("n", None, None), ("e", "", "")], "request_id string, shape string, color string")
    out = C.attribute_matches(req, med, 10)
    got = {(r, s) for r, s in rows(out, "request_id", "item_seq")}
    assert got == {("s", "1"), ("s", "2"), ("s", "3"), ("c", "1"), ("c", "2"), ("c", "4"), ("b", "1"), ("b", "2")}


def test_token_context_first_token_wins(spark):
    med = spark.createDataFrame([("1", "타이레놀", "회사", "원형", "하양", "", "OTC", "해열")],
                                "item_seq string, item_name string, entp_name string, drug_shape string, "
                                "color_class1 string, color_class2 string, etc_otc_code string, chartn string") \
        .withColumn("name_fold", T.fold_ascii("item_name"))
    msgs = spark.createDataFrame([(1, 0, "오늘 타이레놀 먹었어요"), (2, 0, "a 없음"), (3, 0, "x 레놀")],
                                 "conv_id long, turn long, text string")
    out = {r[0]: r for r in rows(C.token_context(msgs, med, ["conv_id", "turn"], "text"),
                                 "conv_id", "matched_token", "context")}
    assert set(out) == {1, 3}
    assert out[1][1] == "타이레놀"
    assert out[1][2] == "\n\n[의약품 DB 검색 결과]\n- 타이레놀 (회사) | 원형 | 하양 | OTC\n  설명: 해열\n"
    assert out[3][1] == "레놀"


def test_like_regex_escapes(spark):
    df = spark.createDataFrame([("a.c",), ("abc",)], "n string")
    t = F.lit("a.c")
    m = L.like_match(F.col("n"), t, F.lit(True), L.like_regex(t))
    assert rows(df.where(m)) == [("a.c",)]


def test_choose_strategy_bounded_checks(spark):
    cat = catalogue(spark, [f"name {i}" for i in range(2000)])
    names = L.distinct_names(cat)
    terms = L.prepare_terms(spark.createDataFrame([(f"{i}",) for i in range(50)], "term string"), "term")
    # both sides fit: the smaller one (the terms) is broadcast
    assert L.choose_strategy(terms, names, "name_fold", pair_budget=10**9)[0] == "broadcast"
    # over the comparison budget: the n-gram index
    assert L.choose_strategy(terms, names, "name_fold", pair_budget=10_000)[0] == "ngram"
    # the names above the broadcast limit are recounted against the budget,
    # not taken as the capped count
    assert L.choose_strategy(terms, names, "name_fold", broadcast_limit=100, pair_budget=60_000)[0] == "ngram"
    assert L.choose_strategy(terms, names, "name_fold", broadcast_limit=100, pair_budget=200_000)[0] == "broadcast"


_ALPHA = list("abAB1_% 가")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=_ALPHA, min_size=1, max_size=9), min_size=1, max_size=12),
       st.lists(st.text(alphabet=_ALPHA, min_size=1, max_size=7), min_size=1, max_size=8))
def test_ngram_index_matches_brute_force_property(spark, names, terms):
    """The n-gram plan (rarest gram routing, wildcard runs, all-wildcard
    terms by length) equals SQLite LIKE on random names and terms."""
    cat = catalogue(spark, names)
    req = spark.createDataFrame([(t,) for t in terms], "term string")
    got = set(rows(L.substring_matches(req, cat, "term", ["item_seq"], strategy="ngram"), "term", "item_seq"))
    want = {(t, str(i)) for t in set(terms) for i, n in enumerate(names) if sqlite_like(n, t)}
    assert got == want


def test_hot_name_first_k_equals_brute_force(spark):
    """A name copied across a third of the catalogue: only its first k rows
    are expanded, and the first k per term stay exact."""
    names = ["hot ring"] * 300 + [f"part {i} ring" for i in range(600)]
    cat = catalogue(spark, names)
    req = spark.createDataFrame([("ring",), ("hot",), ("part 1",)], "term string")
    order = ["item_name", "item_seq"]
    got = rows(L.first_matches(req, cat, "term", ["item_seq", "item_name"], order, 5), "term", "rank", "item_seq")
    want = []
    for t in ("ring", "hot", "part 1"):
        m = sorted((n, str(i)) for i, n in enumerate(names) if sqlite_like(n, t))[:5]
        want += [(t, r + 1, seq) for r, (_, seq) in enumerate(m)]
    assert sorted(got) == sorted(want)


def test_single_keyword_search_semantics(spark):
    names = ["Aspirin", "aspirin protect", "a_b", "axb", "a\\b", None, "RED plate", "a%b"]
    cat = catalogue(spark, names)
    for kw in ["aspirin", "ASPIRIN", "_", "a_b", "a%b", "a\\b", "", "zz", "%"]:
        got = [r[0] for r in L.search_by_name(cat, kw, ["item_name", "item_seq"], 5).select("item_seq").collect()]
        want = [str(i) for n, i in sorted((n, i) for i, n in enumerate(names) if n is not None and sqlite_like(n, kw))][:5]
        assert got == want, kw


def test_single_keyword_search_pushdown_and_top_k(spark, tmp_path):
    path = str(tmp_path / "med")
    C.medicines_from_part(C.table(spark, SF001, "part")).write.parquet(path)
    med = spark.read.parquet(path)
    out = L.search_by_name(med, "Ring", C.CAT_ORDER, 5)
    p = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in p
    assert "StringContains(name_fold,ring)" in out._jdf.queryExecution().toString()
    assert out.count() <= 5


def test_single_attribute_search(spark):
    med = spark.createDataFrame([
        ("1", "a", "원형", "하양", ""), ("2", "b", "원형", "", "하양"), ("3", "c", "타원형", "노랑", ""),
        ("4", "d", "장방형", "하양", "")],
        "item_seq string, item_name string, drug_shape string, color_class1 string, color_class2 string")
    seqs = lambda df: [r[0] for r in df.select("item_seq").collect()]
    assert seqs(L.search_by_attributes(med, "원형", None, ["item_name"])) == ["1", "2", "3"]
    assert seqs(L.search_by_attributes(med, "원형", "하양", ["item_name"])) == ["1", "2"]
    assert seqs(L.search_by_attributes(med, "", "하양", ["item_name"])) == ["1", "2", "4"]
    with pytest.raises(ValueError):
        L.search_by_attributes(med, "", None, ["item_name"])


def test_exploded_tables_are_not_broadcast(spark):
    """The gram tables are far larger than Spark's estimate, which is that of their source."""
    cat = catalogue(spark, ["alpha beta gamma", "beta delta", "gamma ray"])
    req = spark.createDataFrame([("beta",), ("a_r",), ("gamma r",)], "term string")
    hits = L.substring_matches(req, cat, "term", ["item_seq"], strategy="ngram")
    first = L.first_matches(req, cat, "term", ["item_seq", "item_name"], ["item_name", "item_seq"], 1, strategy="ngram")
    for df in (hits, first):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin [n" not in plan and "BroadcastHashJoin [gram" not in plan
        assert "BroadcastHashJoin [name_fold" not in plan
    assert {t for t, _ in rows(hits, "term", "item_seq")} == {"beta", "a_r", "gamma r"}


def test_grams_lose_their_copies_as_strings(spark):
    """One hash set a name: Spark compares structs pair by pair, the square of a name's grams."""
    names = ["abab", "", None, "a", "약약정", "x" * 40]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    out = df.select("i", L.all_ngrams(F.col("name"), 3).alias("g"))
    for i, grams in rows(out, "i", "g"):
        s = names[i] or ""
        want = dict.fromkeys((n, s[j:j + n]) for n in (1, 2, 3) for j in range(len(s) - n + 1))
        assert [(g["n"], g["gram"]) for g in grams] == list(want)
    plan = out._jdf.queryExecution().analyzed().toString()
    inside = plan[plan.index("array_distinct("):]
    assert "struct" not in inside[:inside.index(" ELSE ")]


def test_only_asked_grams_are_ranked(spark, monkeypatch):
    """Grams nobody asked for leave before the sort; too many for a broadcast, and all are ranked: equal rows."""
    cat = spark.createDataFrame([(i, n) for i, n in enumerate(["abcab", "Xab", None, "zzz", "abcab", "b_a"])], "i int, name string") \
        .withColumn("name_fold", T.fold_ascii("name"))
    asked = spark.createDataFrame([("AB",), ("b",), ("zz",), ("none",), (None,), ("",), ("_",), ("abcab",)], "t string")
    build, only = L.build_gram_topk, []
    monkeypatch.setattr(L, "build_gram_topk", lambda *a, **kw: (only.append(kw["only"]), build(*a, **kw))[1])
    found = lambda: sorted(rows(L.first_matches(asked, cat, "t", ["i"], ["i"], 2, strategy="ngram"), "term", "rank", "i"))
    few = found()
    assert sorted(r[0] for r in rows(only[0], "gram")) == ["ab", "abcab", "b", "none", "zz"]
    monkeypatch.setattr(L, "BROADCAST_TERMS_LIMIT", 2)
    assert found() == few and only[1] is None
    assert few == [("", 1, 0), ("", 2, 1), ("AB", 1, 0), ("AB", 2, 1), ("_", 1, 0), ("_", 2, 1), ("abcab", 1, 0), ("abcab", 2, 4),
                   ("b", 1, 0), ("b", 2, 1), ("zz", 1, 3)]
