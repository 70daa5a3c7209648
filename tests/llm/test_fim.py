import hashlib
import random
import re

import pytest
from llm_helpers import SF001
from pyspark.sql import functions as F

from rxlake.llm import fim as X


def brute(doc_id, text):
    """(n, form, prefix chars, middle chars, output) by plain string slices."""
    text = text or ""
    units = re.findall(r"(?s)[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(n):
    rnd = random.Random(n)
    pieces = ["ab", "Zeta", " ", "\n", "é", "日本", "😀", "1", "<", ">", "<P", "S>", "M", "_", "\x00", "ß"]
    some = ["".join(rnd.choice(pieces) for _ in range(rnd.choice([0, 1, 2, 5, 40]))) for _ in range(n)]
    return [None, "", "x", "é", "<P>", "a<M>b", "<S", " " * 50, "a" * 1000, "ab" + "é" * 20000 + "z", *some]


def test_equals_brute_force(spark):
    docs = [(i, t, "psm", 7) for i, t in enumerate(texts(300))]
    docs += docs[:20] + [(None, "no id here", "", 1), (None, None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, form string, n long").repartition(3)    # clashing names
    full = X.restore(X.transform(df))
    got = sorted((str(r.doc_id), r.n_units, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode(), bytes(r.restored).decode())
                 for r in full.collect())
    assert got == sorted((str(d[0]), *brute(d[0], d[1]), d[1] or "") for d in docs)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    report = {str(r.doc_id): r for r in X.report(df.where("doc_id is not null")).collect()}
    for key, _, form, _, _, output, restored in got:
        if key != "None":
            assert report[key].output_sha256 == hashlib.sha256(output.encode()).hexdigest()
            assert report[key].restored_sha256 == hashlib.sha256(restored.encode()).hexdigest()


def test_kept_columns_and_names(spark):
    df = spark.createDataFrame([(1, "some words here", "mine")], "doc_id long, text string, form string")
    out = X.transform(df, keep=["doc_id", "form", "text"], prefix_columns="fim_")
    assert out.columns == ["doc_id", "form", "text", "fim_n_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output"]
    back = X.restore(out, output="fim_output", form="fim_form", restored="fim_restored").first()
    assert back.form == "mine" and bytes(back.fim_restored).decode() == back.text
    nulls = X.restore(out.withColumn("fim_form", F.lit(None).cast("string")), output="fim_output", form="fim_form")
    assert nulls.first().restored is None


def test_empty_table(spark):
    assert X.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("sizes", [(0, 0), (0, 5), (1, 1), (3, 8), (7, 2), (100, 33)])
def test_rotation_is_in_place_and_inverts(sizes):
    a, b = sizes
    buf = bytearray(b"<" + bytes(range(65, 65 + 26)) * 6)[:1 + a + b] + b">"
    whole = bytes(buf)
    X.rotate(buf, 1, 1 + a, 1 + a + b)
    assert bytes(buf) == b"<" + whole[1 + a:1 + a + b] + whole[1:1 + a] + b">"
    X.rotate(buf, 1, 1 + b, 1 + a + b)
    assert bytes(buf) == whole


def test_oracle(spark, duck):
    got = sorted(tuple(r) for r in X.report(spark.read.parquet(f"{SF001}/documents.parquet")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect())
    assert got == sorted(duck.execute(X.ORACLE).fetchall()) and got
