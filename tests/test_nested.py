"""JSON reply parsing (N1-N3), OCR response (N4), prompt assembly."""

import json
import re

from hypothesis import HealthCheck, given, settings, strategies as st_
from pyspark.sql import functions as F

from helpers import rows
from rxlake.functions import nested as N


def parse(spark, replies):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    st, names = N.parse_name_list(F.col("r"))
    return [(s, n) for _, s, n in rows(df.orderBy("i").select("i", st, names))]


def test_reply_golden(spark):
    out = parse(spark, [
        'Sure:\n{"medicines": ["타이레놀", "게보린"]}\nthanks',   # text around object
        "no braces here",                                        # no json
        '{"medicines": ["a", }',                                 # broken
        "{'medicines': ['a']}",                                  # single quotes
        '{"other": 1}',                                          # no medicines key
        '{"medicines": ["a"]} {"b": 1}',                         # two objects
        '{"medicines": [1, "b"]}',                               # non-string element
        '{"medicines": []}',
    ])
    assert out == [("ok", ["타이레놀", "게보린"]), ("no_json", []), ("error", []), ("error", []),
                   ("ok", []), ("error", []), ("error", []), ("ok", [])]


def test_ocr_text(spark):
    df = spark.createDataFrame([
        ('{"IsErroredOnProcessing": true, "ParsedResults": [{"ParsedText": "x"}]}',),
        ('{"IsErroredOnProcessing": false, "ParsedResults": [{"ParsedText": "약 봉투"}]}',),
        ('{"IsErroredOnProcessing": false, "ParsedResults": []}',),
        ('{"IsErroredOnProcessing": false}',)], "r string")
    assert [r[0] for r in rows(df.select(N.ocr_text("r")))] == ["", "약 봉투", "", ""]


def test_prompt_messages(spark):
    df = spark.createDataFrame([("ctx", "hi")], "c string, u string")
    hist = F.array(F.struct(F.lit("user").alias("role"), F.lit("old").alias("content")))
    out = rows(df.select(N.prompt_messages(F.col("c"), hist, F.col("u")).alias("m")))[0][0]
    assert [(m["role"], m["content"]) for m in out] == [("system", "ctx"), ("user", "old"), ("user", "hi")]


def test_staged_name_list_equals_column_form(spark):
    replies = ['Result: {"medicines": ["a", "b"]} done', '{"medicines": [1, "b"]}', "no json here",
               '{"medicines": ["a", }', "{'medicines': ['x']}", '{"other": 1}', '{"medicines": ["a"]} and {"x": 1}',
               None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    st, names = N.parse_name_list(F.col("r"))
    a = sorted(rows(df.select("i", st.alias("status"), names.alias("names"))))
    b = sorted(rows(N.with_name_list(df, F.col("r"), keep=["i"]), "i", "status", "names"))
    assert a == b


def plain(reply):
    """N1-N3 with ``json.loads``."""
    if reply is None:       # nothing to search: re.search raises
        return "error", []
    m = re.search(r"\{.*\}", reply, re.S)
    if not m:
        return "no_json", []
    try:
        names = json.loads(m.group()).get("medicines", [])
    except json.JSONDecodeError:
        return "error", []
    good = isinstance(names, list) and all(isinstance(n, str) for n in names)
    return ("ok", names) if good else ("error", [])


EDGES = [
    None, "", "{}", '{"medicines": ["a"], "medicines": ["b"]}', '{"medicines": null}', '{"medicines": "s"}',
    '{"x": {"a": 1, "a": 2}, "medicines": ["q"]}', '{"x": NaN, "medicines": ["q"]}', '{"x": -Infinity, "medicines": ["q"]}',
    '{"x": Infinity, "medicines": ["q"]}', '{"x": +INF, "medicines": ["q"]}', '{"x": INF, "medicines": ["q"]}',
    '{"x": +Infinity, "medicines": ["q"]}', '{"x": "INF +I", "medicines": ["INF", "+I"]}', '{"medicines": [NaN]}',
    '{"x": "\\"INF", "medicines": ["q"]}', '{"medicines": ["a"]}}', '{"medicines": ["a"]}, "w": {}', '{"medicines": ["a"]}], "w": [{}',
    '{"medicines": ["a"]}, {"medicines": ["b"]}', '{"medicines": ["a"]}], "v": [{"medicines": ["b"]}',
    '{"medicines": ["a"]}, "v": {"medicines": ["b"]}', '{"x": 01, "medicines": ["q"]}', '{"x": "a\tb", "medicines": ["q"]}',
    '{"x": "\\q", "medicines": ["q"]}', '{"medicines": ["x"] /* c */}', '{"medicines": [["q"]]}', '{"medicines": [null]}',
    '{"medicines": ["x"], "y": "}"}', '{"y": {"medicines": ["inner"]}}', '{"medicines": ["\\uac00", "\\n"]}', "{medicines: []}",
    '{"medicines": ["a",]}', '{"medicines": ["a"]', 'x {"medicines": []} y } z', '{"x": 1e999, "medicines": ["q"]}',
    '{"x": 123456789012345678901234567890123456789012345678, "medicines": ["q"]}', '{"Medicines": ["a"]}', '{"medicines": ["' + "a" * 100_000 + '"]}',
]


def test_replies_equal_json_loads(spark):
    assert parse(spark, EDGES) == [plain(r) for r in EDGES]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st_.lists(st_.lists(st_.sampled_from(['{', '}', '[', ']', ',', ':', ' ', '"medicines"', '"a"', '"v"', "1", "NaN", "null", '\\', '"',
                                             '{"medicines":', '["a","b"]', '}, {']), max_size=9).map("".join), min_size=40, max_size=40))
def test_any_reply_equals_json_loads(spark, replies):
    replies = ['{"medicines": ["a"]' + r + "}" if i % 2 else r for i, r in enumerate(replies)]
    assert parse(spark, replies) == [plain(r) for r in replies]
