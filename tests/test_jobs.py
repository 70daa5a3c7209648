"""Composite jobs on literal fixtures (FIXTURES §3)."""

from helpers import rows
from pyspark.sql import functions as F

from rxlake.plans import jobs as J


def test_catalogue_newest_year_and_blank_names(spark):
    y2020 = spark.createDataFrame([("1", "가", "nan", "3.5"), ("2", "나", "회사", "x"), (None, "무키", "", "")],
                                  "ITEM_SEQ string, ITEM_NAME string, ENTP_NAME string, LENG_LONG string")
    y2025 = spark.createDataFrame([(" 1", "1", "가2", "원형"), ("3", "2", "", ""), ("4", "1", "가3", ""),
                                   ("5", None, "널키", "")],
                                  "ord string, item_seq string, item_name string, drug_shape string")
    out = J.catalogue_pipeline([(2020, y2020.withColumn("ord", y2020["ITEM_SEQ"])), (2025, y2025)], ord_col="ord")
    got = {r[0]: r[1:] for r in rows(out, "ITEM_SEQ", "ITEM_NAME", "SOURCE_YEAR", "ENTP_NAME", "LENG_LONG", "RAG_TEXT")}
    # key 1: two 2025 rows, the lower ord wins; key 2: 2025 name blank -> 2020 row kept
    assert got["1"] == ("가2", 2025, "", 0.0, "가2 | 모양: 원형")
    assert got["2"] == ("나", 2020, "회사", 0.0, "나 | 제조사: 회사")
    assert got[None][0] in ("널키", "무키") and got[None][1] == 2025   # nulls form one group


def test_serving_table(spark):
    cat = spark.createDataFrame([("1", "가", 1.5)], "ITEM_SEQ string, ITEM_NAME string, LENG_LONG double")
    out = J.serving_table(cat)
    r = rows(out)[0]
    assert out.columns[:3] == ["item_seq", "item_name", "entp_name"]
    assert r[0] == "1" and r[1] == "가" and r[2] == "" and "item_image" in out.columns


def test_leaflet_documents_length_gate(spark):
    def row(key, name, eff):
        return (key, name, "회사", eff, "", "", "", "", "", "", "", "", None, "")
    raw = spark.createDataFrame([row("1", "가", "짧음"), row("2", "나나나나나", "효능이 긴 설명입니다"),
                                 row("2", "중복", "x" * 30), row(" 3 ", "<b>다</b>", "해당없음")],
                                ", ".join(f"c{i} string" for i in range(14)))
    out = J.leaflet_documents(raw.withColumn("ord", F.monotonically_increasing_id()), ord_col="ord")
    got = {r[0]: r[1] for r in rows(out, "id", "document")}
    # "약품명: 가 | 효능: 짧음" is 15 characters: dropped; key 2 keeps its first row
    assert set(got) == {"easy_2"}
    assert got["easy_2"] == "약품명: 나나나나나 | 효능: 효능이 긴 설명입니다"
    meta = rows(out, "metadata")[0][0]
    assert meta["image_url"] == "" and meta["source"] == "e약은요"


def test_document_index_skips_blank(spark):
    docs = spark.createDataFrame([("a", "hello world", None), ("b", "  ", None)],
                                 "id string, document string, metadata struct<name:string>")
    out = J.document_index(docs)
    assert [r[0] for r in rows(out, "id")] == ["a"]


def _med(spark):
    from rxlake.functions import text as T
    return spark.createDataFrame(
        [("1", "타이레놀정", "한국", "해열", "원형", "하양", "", "일반"),
         ("2", "게보린정", "삼진", "두통", "원형", "분홍", "", "일반")],
        "item_seq string, item_name string, entp_name string, chartn string, drug_shape string, "
        "color_class1 string, color_class2 string, etc_otc_code string").withColumn("name_fold", T.fold_ascii("item_name"))


def test_message_context_token_path_and_gate(spark):
    msgs = spark.createDataFrame([(1, "오늘 타이레놀정 먹었어요"), (2, "안녕하세요"), (3, "게보린 복용 중")],
                                 "mid long, text string")
    out = {r[0]: r[1:] for r in rows(J.message_context(msgs, _med(spark), ["mid"]),
                                     "mid", "gated", "context_source", "context")}
    assert out[1][0] and out[1][1] == "token" and "- 타이레놀정 (한국) | 원형 | 하양 | 일반\n  설명: 해열\n" in out[1][2]
    assert out[2] == (False, "none", "")          # no drug keyword: gated out
    assert out[3][1] == "token" and "게보린정" in out[3][2]


def test_message_context_vector_path(spark):
    from pyspark.sql import functions as F
    cat = spark.createDataFrame([("1", "타이레놀정 | 제조사: 한국", "타이레놀정", "한국", "원형", "하양", "해열")],
                                "ITEM_SEQ string, RAG_TEXT string, ITEM_NAME string, ENTP_NAME string, "
                                "DRUG_SHAPE string, COLOR_CLASS1 string, CHARTN string")
    coll1 = J.document_index(J.catalogue_documents(cat))
    coll2 = coll1.where(F.lit(False))             # empty second collection contributes nothing
    msgs = spark.createDataFrame([(1, "타이레놀정 먹었어요")], "mid long, text string")
    r = rows(J.message_context(msgs, _med(spark), ["mid"], collections=(coll1, coll2)),
             "context_source", "context")[0]
    assert r[0] == "vector"
    assert r[1] == "\n\n[의약품 DB 검색 결과]\n- 타이레놀정 (한국) | 원형 | 하양\n  설명: 해열\n"


def test_import_drug_data_end_to_end(spark, tmp_path):
    import pandas as pd
    d = tmp_path
    cols14 = ["품목일련번호", "제품명", "업체명", "효능", "사용법", "경고주의사항", "주의사항", "상호작용",
              "부작용", "보관법", "공개일자", "수정일자", "낱알이미지", "사업자번호"]
    leaflet = pd.DataFrame([["1", "타이레놀정", "한국", "해열 진통에 쓰입니다", "", "", "", "", "", "", "", "", "", ""]],
                           columns=cols14)
    leaflet.to_csv(d / "easy.csv", index=False)
    pd.DataFrame({"품목일련번호": ["1"], "품목명": ["타이레놀정"], "Dur성분명": ["아세트아미노펜"]}).to_csv(d / "eld.csv", index=False)
    age = ["DUR일련번호", "DUR성분코드", "DUR성분명", "금기내용", "제형", "연령기준", "고시일자"]
    pd.DataFrame([["a1", "c", "성분", "금기", "정", "65세 이상", "2024"]], columns=age).to_csv(d / "age.csv", index=False)
    dur = ["DUR일련번호", "DUR성분코드", "DUR성분명", "제형", "최대투여기간", "고시일자", "비고"]
    pd.DataFrame([["z1", "c", "졸피뎀", "정", "28일", "2024", ""], ["k1", "c", "케토롤락", "정", "7일", "2024", ""]],
                 columns=dur).to_csv(d / "dur.csv", index=False)
    add = ["DUR일련번호", "DUR성분코드", "DUR성분명", "금기내용", "비고"]
    pd.DataFrame([["x1", "c", "첨가제", "주의", ""]], columns=add).to_csv(d / "add.csv", index=False)
    pd.DataFrame({"품목일련번호": ["1"], "품목명": ["타이레놀정"], "큰제품이미지": ["img"]}).to_csv(d / "pill.csv", index=False)
    inputs = {"drug_info": "easy", "dur_elderly_warning": "eld", "dur_age_taboo": "age", "dur_duration_warning": "dur",
              "dur_additive_warning": "add", "pill_identification": "pill"}
    inputs = {t: str(d / f"{f}.csv") for t, f in inputs.items()}
    out = str(d / "out")
    written = J.import_drug_data(spark, inputs, out)
    assert written["drug_info"] == 1 and written["dur_duration_warning"] == 2
    # golden lookups from the original's docstrings: 졸피뎀 -> 28일, 케토롤락 -> 7일
    from rxlake.operators import lookup as L
    from rxlake.functions import text as T
    dur_t = spark.read.parquet(f"{out}/dur_duration_warning").withColumn("name_fold", T.fold_ascii("DUR성분명"))
    terms = spark.createDataFrame([("졸피뎀",), ("케토롤락",)], "term string")
    hits = rows(L.substring_matches(terms, dur_t, "term", ["최대투여기간"]), "term", "최대투여기간")
    assert sorted(hits) == [("졸피뎀", "28일"), ("케토롤락", "7일")]
    assert "drug_info" not in J.import_drug_data(spark, inputs, out)         # complete: skipped
    again = J.import_drug_data(spark, inputs, out, half_built_threshold=4000)  # the original's rule: 0 < 1 < 4000
    assert again["drug_info"] == 1


def test_message_context_order_with_many_hits(spark):
    """All hits of the first collection come before the second's, for any k."""
    from pyspark.sql import functions as F
    n = 150
    md = "struct<name:string,company:string,shape:string,color1:string,description:string>"
    coll = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("").alias("document"),
                                 F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"),
                                 F.lit(None).cast(md).alias("metadata"))
    first, second = (coll.withColumn("metadata", F.struct(F.concat(F.lit(t), F.lpad("id", 3, "0")).alias("name"), *[
        F.lit("").alias(c) for c in ("company", "shape", "color1", "description")])) for t in ("A", "B"))
    msgs = spark.createDataFrame([(1, "약")], "mid long, text string")
    enc = F.pandas_udf(lambda s: s.map(lambda _: [0.0, 1.0]), "array<float>")
    text = rows(J.message_context(msgs, _med(spark), ["mid"], gate_terms=["약"], collections=(first, second), encoder=enc, k=n),
                "context")[0][0]
    import re
    assert re.findall(r"([AB]\d{3})", text) == [f"{t}{i:03d}" for t in "AB" for i in range(n)]
