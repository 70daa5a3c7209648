import glob
import gzip
import hashlib
import os
import random

from llm_helpers import SF001
from rxlake.llm import warc as X


def pages():
    rnd = random.Random(2)
    big = ["<p>" + "é" * rnd.randrange(40, 400) + str(i) for i in range(12)]
    rows = [(rnd.randrange(1000), f"http://a/{i}", rnd.choice(big + ["", "short", None, "x" * 99, "x" * 100])) for i in range(300)]
    rows += rows[:3] + [(None, "http://n", big[0]), (None, None, "y" * 200), (-7, "bad\r\nurl: x", "z" * 30_000), (5000, None, "\r\n\r\n" * 40)]
    return rows


def brute(rows):
    low = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            low[b] = min(i, low.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = b in low and low[b] != i
        out.append((i if i is not None else -99, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response",
                    low[b] if again else -99))
    return sorted(out)


def rows_of(df):
    return sorted((r.page_id if r.page_id is not None else -99, r.payload_bytes, r.payload_digest, r.record_type,
                   r.refers_to if r.refers_to is not None else -99) for r in df.collect())


def frame(spark, rows, n=3):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(n)


def test_equals_brute_force(spark):
    assert rows_of(X.report(frame(spark, pages()))) == brute(pages())


def test_files_are_deterministic_and_rolled(spark, tmp_path):
    seen = []
    for run, n in enumerate((2, 5)):
        X.write(frame(spark, pages(), n), f"file://{tmp_path}/{run}", shards=3, roll_bytes=2000)
        files = sorted(glob.glob(f"{tmp_path}/{run}/data/*"))
        seen.append({os.path.basename(f): open(f, "rb").read() for f in files})
    assert seen[0] == seen[1] and len(seen[0]) > 6
    assert not glob.glob(f"{tmp_path}/*/data/.*tmp")
    one = gzip.decompress(seen[0][min(seen[0])])
    assert one.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    listed = {r.file: r.bytes for r in spark.read.parquet(f"{tmp_path}/0/manifest").collect()}
    assert listed == {k: len(v) for k, v in seen[0].items()}
    # a file of a lost attempt is not read
    with open(f"{tmp_path}/0/data/stray.warc.gz", "wb") as f:
        f.write(seen[0][min(seen[0])])
    back = X.read(spark, f"file://{tmp_path}/0")
    assert rows_of(back) == brute(pages())
    texts = {r.page_id: bytes(r.payload) for r in back.where("record_type = 'response' and page_id in (-7, 5000)").collect()}
    assert texts == {-7: b"z" * 30_000, 5000: b"\r\n\r\n" * 40}


def test_empty(spark):
    assert X.report(frame(spark, [], 1)).count() == 0


def test_oracle(spark, duck):
    got = X.report(spark.read.parquet(f"{SF001}/pages.parquet"))
    want = duck.execute(X.ORACLE).fetchall()
    assert rows_of(got) == sorted((*r[:4], r[4] if r[4] is not None else -99) for r in want)
