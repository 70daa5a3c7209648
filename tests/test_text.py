"""Golden edge rows for the text functions (FIXTURES §3) and properties."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import rows
from rxlake.functions import text as T


def one_col(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_clean_text_golden(spark):
    vals = [None, "  <b>두통</b>&nbsp;완화 ", "해당없음", "NaN", "-", "a&#39;b", "　본문　",
            "해당사항없음", "None", "x  y", "<p>a</p>\n\n<p>b</p>"]
    assert one_col(spark, vals, T.clean_text) == [
        "", "두통 완화", "", "", "", "a&#39;b", "본문", "", "", "x y", "a b"]


def test_blank_nan_exact(spark):
    assert one_col(spark, ["nan", "NaN", None, "  x  ", "　y"], T.blank_nan) == ["", "NaN", "", "x", "y"]


def test_na_words(spark):
    out = one_col(spark, ["NA", "N/A", "null", "ok", ""], T.na_words_to_null)
    assert out == [None, None, None, "ok", None]


def test_to_number_golden(spark):
    vals = ["12.5", " 2 ", "1e3", "abc", "", "nan", "1.0d", "1_000", "1,000", None, ".5", "-3.", "+4"]
    assert one_col(spark, vals, T.to_number) == [12.5, 2.0, 1000.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0,
                                                  0.5, -3.0, 4.0]


def test_ustrip_unicode_space(spark):
    assert one_col(spark, ["  a b　\x1f", "\t\n", "x"], T.ustrip) == ["a b", "", "x"]


def test_tokens_python_split(spark):
    vals = ["  오늘 혈압약　먹었어요 ", "", None, "a b\x1cc"]
    out = one_col(spark, vals, T.tokens)
    assert out == [v.split() if v else [] for v in ["  오늘 혈압약　먹었어요 ", "", "", "a b\x1cc"]]


def test_long_tokens_drop_short(spark):
    assert one_col(spark, ["a 약 두통약 ab"], T.long_tokens) == [["두통약", "ab"]]


def test_speech_text_golden(spark):
    # emoji dropped, superscript two kept, jamo kept, parentheses dropped, ?!.,~ kept
    vals = ["안녕😀", "x²", "ㅋㅋ", "(주)", "?!.,~", "a_b-c"]
    assert one_col(spark, vals, T.speech_text) == ["안녕", "x²", "ㅋㅋ", "주", "?!.,~", "a_bc"]


def test_fold_ascii_only(spark):
    assert one_col(spark, ["Aspirin", "ÄB"], T.fold_ascii) == ["aspirin", "Äb"]


def test_catalogue_document(spark):
    df = spark.createDataFrame([
        ("타이레놀", "", "", "", "", "", "", "", ""),
        ("A", "제약", "원형", "하양", "", "", "X", "일반", "흰색 정제"),
        ("B", "", "", "", "노랑", "", "", "", ""),
    ], "n string, c string, s string, c1 string, c2 string, pf string, pb string, o string, ch string")
    out = rows(df.select(T.catalogue_document("n", "c", "s", "c1", "c2", "pf", "pb", "o", "ch")))
    assert [r[0] for r in out] == [
        "타이레놀",
        "A | 제조사: 제약 | 모양: 원형 | 색상: 하양 | 각인: X | 일반 | 흰색 정제",
        "B | 색상: 노랑",
    ]


def test_contains_any_case_sensitive(spark):
    assert one_col(spark, ["오늘 약 먹었어요", "hello", None],
                   lambda c: T.contains_any(c, ["약", "Hello"])) == [True, False, False]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab <>&;x　 \nNn-")), max_size=12),
                min_size=1, max_size=8))
def test_clean_text_idempotent(spark, vals):
    once = one_col(spark, vals, T.clean_text)
    twice = one_col(spark, once, T.clean_text)
    assert once == twice
