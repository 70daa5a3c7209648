"""Sources and sinks: CSV quirks (cp949, BOM, quoting), multi-file load,
table refresh, upsert, staged overwrite, build gates."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from helpers import rows
from rxlake import fixed_values as FV
from rxlake.plans import jobs as J
from rxlake.sources import io as IO


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="rxlake-test-")


def write(path, text, enc):
    with open(path, "wb") as f:
        f.write(text.encode(enc))


def test_cp949_csv_quoting(spark, tmp):
    p = os.path.join(tmp, "y2024.csv")
    write(p, 'item_name ,ITEM_SEQ,CHARTN\n타이레놀,1,"큰 ""따옴표"", 정"\n"두 줄\n이름",2,\n', "cp949")
    df = IO.read_table(spark, p, "cp949")
    from rxlake.operators.shape import normalize_headers
    df = normalize_headers(df)
    assert df.columns == ["ITEM_NAME", "ITEM_SEQ", "CHARTN"]
    got = sorted(rows(df, "ITEM_SEQ", "ITEM_NAME", "CHARTN"))
    assert got == [("1", "타이레놀", '큰 "따옴표", 정'), ("2", "두 줄\n이름", None)]


def test_utf8_bom_header(spark, tmp):
    p = os.path.join(tmp, "m.csv")
    write(p, "﻿ITEM_SEQ,ITEM_NAME\n1,NA\n2,ok\n", "utf-8")
    df = IO.read_csv_text(spark, p)
    assert df.columns == ["ITEM_SEQ", "ITEM_NAME"]
    assert sorted(rows(df)) == [("1", None), ("2", "ok")]   # NA is missing, as pandas reads it


def test_load_sources_swapped_columns_and_missing(spark, tmp):
    a = os.path.join(tmp, "a.csv")
    b = os.path.join(tmp, "b.csv")
    write(a, "ITEM_SEQ,ITEM_NAME,LENG_LONG\n1,가,1.5\n", "cp949")
    write(b, "item_name,item_seq\n나,1\n다,2\n", "cp949")
    files = [(2021, a, "cp949"), (2022, b, "cp949"), (2023, os.path.join(tmp, "none.csv"), "cp949")]
    sources, report = IO.load_sources(spark, files)
    assert [y for y, _ in sources] == [2021, 2022]
    assert {r[0]: r[1] for r in rows(report, "year", "status")} == {2021: "loaded", 2022: "loaded", 2023: "missing"}
    cat = J.catalogue_pipeline(sources, ord_col="ORD")
    got = sorted(rows(cat, "ITEM_SEQ", "ITEM_NAME", "SOURCE_YEAR", "LENG_LONG"))
    assert got == [("1", "나", 2022, 0.0), ("2", "다", 2022, 0.0)]


def test_load_nothing_raises(spark, tmp):
    with pytest.raises(ValueError):
        IO.load_sources(spark, [(2020, os.path.join(tmp, "x.csv"), "csv")])


def test_require_inputs(spark, tmp):
    with pytest.raises(FileNotFoundError, match="pillId"):
        IO.require_inputs(spark, {"pillId": os.path.join(tmp, "nope.xlsx")})


def test_refresh_safety_table_alternative_header(spark):
    raw = spark.createDataFrame([
        ("1", "<b>약A</b>", "업소", "성분", "분류", "2024", "금기", "C1", "이름1", 0),
        ("1", "약A-dup", "", "", "", "", "", "", "", 1),
        ("", "키없음", "", "", "", "", "", "", "", 2),
        ("2", "약B", "업소", "", "", "", "해당없음", "C2", "", 3)],
        "`품목일련번호` string, `품목명` string, `업소명` string, `주성분` string, `약효분류` string, "
        "`고시일자` string, `금기내용` string, `DUR성분코드` string, `Dur성분명` string, ord long")
    key, cols, strict = FV.SAFETY_TABLES["dur_elderly_warning"]
    out = IO.refresh_table(raw, key, cols, strict=strict, ord_col="ord")
    got = sorted(rows(out, "품목일련번호", "품목명", "금기내용", "DUR성분명"))
    assert got == [("1", "약A", "금기", "이름1"), ("2", "약B", "", "")]


def test_refresh_strict_missing_column_errors(spark):
    raw = spark.createDataFrame([("1", "x")], "`DUR일련번호` string, `DUR성분명` string")
    key, cols, strict = FV.SAFETY_TABLES["dur_age_taboo"]
    with pytest.raises(Exception):
        IO.refresh_table(raw, key, cols, strict=strict, ord_col=key).collect()


def test_pill_table_mapping(spark):
    t, key, cols = FV.PILL_TABLE
    raw = spark.createDataFrame([("7", "알약", "http://img", "정제")],
                                "`품목일련번호` string, `품목명` string, `큰제품이미지` string, `의약품제형` string")
    out = IO.refresh_table(raw, key, cols, name_col=FV.PILL_NAME_COL, ord_col=key)
    r = rows(out, "품목일련번호", "이미지URL", "제형", "전문일반")[0]
    assert r == ("7", "http://img", "정제", "")


def test_upsert_last_wins(spark):
    old = spark.createDataFrame([(1, "a", 0, 0), (2, "b", 0, 1)], "k int, v string, batch int, ord int")
    new = spark.createDataFrame([(1, "x", 1, 0), (1, "y", 1, 1), (3, "z", 1, 2)], "k int, v string, batch int, ord int")
    out = IO.upsert(old, new, ["k"], ["batch", "ord"])
    assert sorted(rows(out, "k", "v")) == [(1, "y"), (2, "b"), (3, "z")]


def test_staged_overwrite_while_reading(spark, tmp):
    p = os.path.join(tmp, "t")
    IO.write_table(spark.range(5), p)
    df = spark.read.parquet(p).withColumn("id", F.col("id") + 10)
    IO.write_staged(df, p)
    assert sorted(r[0] for r in spark.read.parquet(p).collect()) == [10, 11, 12, 13, 14]


def test_build_gates(spark, tmp):
    p = os.path.join(tmp, "idx")
    assert not IO.is_built(spark, p)
    IO.write_table(spark.range(10), p)
    assert IO.is_built(spark, p)
    assert IO.half_built(spark, p)                 # no completeness marker
    assert IO.half_built(spark, p, threshold=FV.HALF_BUILT_THRESHOLD)      # the original's rule: 0 < 10 < 4000
    assert not IO.half_built(spark, p, threshold=5)
    assert IO.write_staged(spark.range(10), p) == 10
    assert not IO.half_built(spark, p) and spark.read.parquet(p).count() == 10
    assert not [n for n in os.listdir(tmp) if "staging" in n or "old" in n]


def test_undecodable_source_is_skipped(spark, tmp):
    a, b = os.path.join(tmp, "a.csv"), os.path.join(tmp, "b.csv")
    write(a, "ITEM_SEQ,ITEM_NAME\n1,가\n2,나\n", "cp949")
    with open(b, "wb") as f:
        f.write("ITEM_SEQ,ITEM_NAME\n1,".encode() + b"\xff\xfe\x81\n")
    sources, report = IO.load_sources(spark, [(2021, a, "cp949"), (2022, b, "cp949")])
    assert [y for y, _ in sources] == [2021]
    assert {r[0]: r[1:] for r in rows(report, "year", "status", "rows_in")} == {2021: ("loaded", 2), 2022: ("failed", 1)}


def test_file_order_over_unequal_files(spark, tmp):
    """The first row is that of the first file, however Spark packs the files."""
    p = os.path.join(tmp, "t")
    small = [("k", "first", 0)] + [(f"s{i}", "x", i) for i in range(5)]
    large = [("k", "second", 0)] + [(f"l{i}", "y" * 200, i) for i in range(20_000)]
    schema = "key string, v string, n int"
    for name, part in (("a", small), ("b", large)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(os.path.join(tmp, name))
        os.makedirs(p, exist_ok=True)
        src = next(f for f in os.listdir(os.path.join(tmp, name)) if f.endswith(".parquet"))
        os.rename(os.path.join(tmp, name, src), os.path.join(p, f"{name}.parquet"))
    raw = spark.read.parquet(p)
    out = IO.refresh_table(raw, "key", [("key", "key"), ("v", "v")])
    assert dict(rows(out.where("key = 'k'"), "key", "v")) == {"k": "first"}
    with pytest.raises(ValueError, match="no file order"):
        IO.refresh_table(spark.createDataFrame(small, schema), "key", [("key", "key")])


def test_file_order_within_a_split_file(spark, tmp):
    p = os.path.join(tmp, "t")
    n = 30_000
    spark.range(n).selectExpr("cast(id % 10 as string) as key", "concat(id, repeat('z', 40)) as v").coalesce(1) \
        .write.option("parquet.block.size", 64 * 1024).parquet(p)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        raw = spark.read.parquet(p)
        assert raw.rdd.getNumPartitions() > 1
        out = rows(IO.refresh_table(raw, "key", [("key", "key"), ("v", "v")]), "key", "v")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(out) == [(str(i), f"{i}" + "z" * 40) for i in range(10)]


def test_observed_write_counts_what_it_writes(spark, tmp):
    df = spark.range(0, 1000, 1, 7).where("id % 3 = 0").withColumn("g", F.col("id") % 5)
    seen = IO.observed_write(df, os.path.join(tmp, "a"), {"high": F.max("id"), "odd": F.sum(F.col("id") % 2)})
    assert seen == {"rows": 334, "high": 999, "odd": 167}
    assert IO.observed_write(df.groupBy("g").count(), os.path.join(tmp, "b"))["rows"] == 5      # behind a shuffle
    assert IO.observed_write(df.limit(0), os.path.join(tmp, "c"))["rows"] == 0
    p = os.path.join(tmp, "e")
    assert IO.observed_write_staged(df, p, {"g0": F.count_if(F.col("g") == 0)}, leave_out=("g",)) == {"rows": 334, "g0": 67}
    assert spark.read.parquet(p).columns == ["id"]
    assert IO.write_staged(spark.createDataFrame([], "a int"), os.path.join(tmp, "d")) == 0


def test_landed_sources_give_the_same_report_and_rows(spark, tmp):
    a, b, c = (os.path.join(tmp, f"{n}.csv") for n in "abc")
    write(a, 'ITEM_SEQ,ITEM_NAME\n1,"가\n나"\n2,다\n2,다\n', "cp949")
    write(b, "item_name,item_seq\nmark \ufffd here,3\nlast,4\n", "utf-8")      # a genuine U+FFFD decodes
    with open(c, "wb") as f:
        f.write("ITEM_SEQ,ITEM_NAME\n5,".encode() + b"\xff\xfe\x81\n")
    d = os.path.join(tmp, "d.parquet")
    spark.createDataFrame([("6", "sechs \ufffd")], "ITEM_SEQ string, ITEM_NAME string").write.parquet(d)
    files = [(2020, a, "cp949"), (2021, b, "csv"), (2022, c, "csv"), (2023, d, "parquet"),
             (2024, os.path.join(tmp, "none.csv"), "csv")]
    plain, report = IO.load_sources(spark, files)
    landed, again = IO.load_sources(spark, files, landing=os.path.join(tmp, "landing"))
    assert sorted(rows(report)) == sorted(rows(again))
    assert {r[0]: r[1:] for r in rows(again, "year", "status", "rows_in")} == {
        2020: ("loaded", 3), 2021: ("loaded", 2), 2022: ("failed", 1), 2023: ("loaded", 1), 2024: ("missing", 0)}
    for (y, x), (z, w) in zip(plain, landed, strict=True):
        assert y == z and x.columns == w.columns
        order = [r[0] for r in rows(x.orderBy("ORD"), "ITEM_NAME")]
        assert order == [r[0] for r in rows(w.orderBy("ORD"), "ITEM_NAME")]
    assert all(f"{tmp}/landing" in f for f in landed[0][1].inputFiles())


def test_catalogue_from_a_folder_end_to_end(spark, tmp):
    src, out = os.path.join(tmp, "in"), os.path.join(tmp, "out", "catalogue")
    os.makedirs(src)
    write(os.path.join(src, "pills (2021).csv"), "ITEM_SEQ,ITEM_NAME,LENG_LONG\n1,old,1.5\n2,kept,2\n3,,1\n", "cp949")
    write(os.path.join(src, "pills_2022_.csv"), "item_name,item_seq\nnew,1\n", "cp949")
    write(os.path.join(src, "notes.csv"), "x\n1\n", "cp949")                 # no year
    write(os.path.join(src, "2020 to 2021.csv"), "x\n1\n", "cp949")         # two years
    write(os.path.join(src, "code 120219.csv"), "x\n1\n", "cp949")          # no year of its own
    files = IO.find_sources(spark, src)
    assert [(y, os.path.basename(p), f) for y, p, f in files] == [(2021, "pills (2021).csv", "cp949"), (2022, "pills_2022_.csv", "cp949")]
    csv = os.path.join(tmp, "out", "export")
    for _ in range(2):      # a second build replaces the first
        report = J.build_catalogue(spark, files, out, csv_export=csv)
    assert sorted(rows(report, "year", "status", "rows_in")) == [(2021, "loaded", 3), (2022, "loaded", 1)]
    got = sorted(rows(spark.read.parquet(out), "ITEM_SEQ", "ITEM_NAME", "SOURCE_YEAR", "LENG_LONG"))
    assert got == [("1", "new", 2022, 0.0), ("2", "kept", 2021, 2.0)]
    assert sorted(os.listdir(os.path.join(tmp, "out"))) == ["catalogue", "export"]      # no copies are left
    assert [r[0] for r in rows(IO.read_csv_text(spark, csv), "ITEM_NAME")] == ["kept", "new"]
    served = os.path.join(tmp, "serving")
    assert J.load_serving_table(spark, out, served) and not J.load_serving_table(spark, out, served)
    assert spark.read.parquet(served).count() == 2
