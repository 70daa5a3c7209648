"""Plan shape: pushdown, pruning, partial top-k, no row-at-a-time Python."""

import contextlib
import io

import __spark_entry__ as E
from helpers import SF001, SF01
from pyspark.sql import functions as F


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_top_k_is_partial_before_shuffle(spark):
    for name in ["dedup_newest", "recent_history", "catalogue_pipeline"]:
        p = plan(E.queries()[name](spark, SF01))
        assert "WindowGroupLimit" in p and "Partial" in p, name
    # the name search's first-k (its hits are checkpointed inside the query)
    from rxlake.operators import lookup as L
    from rxlake.plans import catalog as C
    med = C.medicines_from_part(C.table(spark, SF01, "part"))
    hits = L.first_matches(C.keywords(spark, SF01), med, "keyword", C.CAT_COLS, C.CAT_ORDER, 5,
                           strategy="ngram")
    p = plan(hits)
    assert "WindowGroupLimit" in p and "Partial" in p


def test_no_row_at_a_time_python(spark):
    for name, fn in E.QUERIES.items():
        p = plan(fn(spark, SF001))
        assert "BatchEvalPython" not in p, name


def test_contains_pushdown_on_stored_fold(spark, tmp_path):
    # A stored folded name keeps StringContains pushdown to Parquet
    part = spark.read.parquet(f"{SF001}/part.parquet")
    path = str(tmp_path / "med")
    part.withColumn("name_fold", F.lower("p_name")).write.parquet(path)
    p = plan(spark.read.parquet(path).where(F.col("name_fold").contains("widget")).select("p_partkey"))
    assert "StringContains(name_fold,widget)" in p
    assert "ReadSchema: struct<p_partkey:bigint,name_fold:string>" in p


def test_column_pruning_in_catalogue_pipeline(spark):
    p = plan(E.queries()["catalogue_pipeline"](spark, SF001))
    assert "p_retailprice" in p and "ReadSchema" in p


def test_vector_search_is_vectorised(spark):
    p = plan(E.queries()["vector_topk"](spark, SF001))
    assert "MapInPandas" in p


def test_envelope_hot_term_inner_join(spark):
    """A term matching a third of the catalogue: its hits sit on an inner
    join (AQE can split that partition), never on the non-preserved side of
    a left join; requests without hits come from an anti join."""
    from rxlake.operators import lookup as L
    hits = spark.createDataFrame([("hot", str(i)) for i in range(300)] + [("cold", "x")],
                                 "term string, item_seq string")
    req = spark.createDataFrame([("hot",), ("cold",), ("none",)], "term string")
    out = L.envelope(req, hits, "term")
    p = plan(out)
    assert "LeftOuter" not in p and "LeftAnti" in p
    got = {r.term: (r.found, r.n_found) for r in out.select("term", "found", "n_found").distinct().collect()}
    assert got == {"hot": (True, 300), "cold": (True, 1), "none": (False, 0)}
    assert out.count() == 302


def test_per_key_folds_combine_map_side(spark):
    """Upsert and the alarm fold are grouped max_by aggregates with a partial
    (map-side) step, so a key with millions of versions is combined in every
    input partition before the shuffle."""
    for name in ["upsert_last_wins", "alarm_state"]:
        p = plan(E.queries()[name](spark, SF001))
        assert "partial_max_by" in p, name


def test_dedup_reads_texts_once(spark):
    """dedup_first_seen takes the first row's short columns and the copy count
    from one scan and one aggregate."""
    import re
    p = plan(E.queries()["dedup_first_seen"](spark, SF001))
    schemas = re.findall(r"ReadSchema: struct<([^\n]*)>", p)
    assert len(schemas) == 1 and "text:string" in schemas[0] and "Join" not in p
