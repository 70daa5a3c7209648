"""Driver contract: entry(), queries()/oracle_sql() coverage, and every
query against its DuckDB oracle on sf0.001 (the driver repeats it at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from helpers import SF001
from tools.compare import TABLES, fingerprint

QUERIES, ORACLES = E.QUERIES, E.ORACLE   # the training-data queries have tests of their own


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "RAG_TEXT" in df.columns


def test_every_query_has_oracle():
    assert set(ORACLES) == set(QUERIES) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sp = E.queries()[name](spark, SF001).toPandas()
    dd = duck.execute(E.oracle_sql()[name]).df()
    c1, r1, h1 = fingerprint(sp)
    c2, r2, h2 = fingerprint(dd)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert h1 == h2, (sorted(set(r1) - set(r2))[:3], sorted(set(r2) - set(r1))[:3])


@pytest.mark.parametrize("name", ["catalogue_pipeline", "name_search_top5", "validate_extractions",
                                  "alarm_state", "append_with_ids", "rolling_context"])
def test_result_independent_of_partitioning(spark, name):
    """Property: the same rows whatever the shuffle partition count."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = fingerprint(E.queries()[name](spark, SF001).toPandas())[2]
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        b = fingerprint(E.queries()[name](spark, SF001).toPandas())[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_every_document_is_embedded(spark, duck):
    n, lengths = duck.execute("SELECT count(*), count(DISTINCT n_chars) FROM documents").fetchone()
    out = E.queries()["embed_every_document"](spark, SF001)
    assert lengths < n == out.select("id").distinct().count() == out.count()
