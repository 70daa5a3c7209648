"""The query catalogue: each operator of the survey run on the driver's tables.

Every entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
tables.  Stand-in mappings (which test column plays which catalogue column)
are defined once in ``catalogue_from_part`` and friends.  Arrays and structs
are rendered as ordered strings so results hash the same as the oracle's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxlake import fixed_values as FV
from rxlake.functions import nested as N
from rxlake.functions import text as T
from rxlake.operators import bitmaps as B
from rxlake.operators import lookup as L
from rxlake.operators import pivots as P
from rxlake.operators import state as A
from rxlake.operators import vectors as V
from rxlake.operators import rank as R
from rxlake.operators import shape as S
from rxlake.plans import incremental as I
from rxlake.plans import jobs as J
from rxlake.session import ensure_checkpoint_dir
from rxlake.sources import io as IO

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# tables whose rows carry whole texts worked on by regexes or the encoder
TEXT_TABLES = {"documents", "pages", "conversations", "benchmark"}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A test table; text tables are spread over the cores for row work on
    whole texts (``spread=False`` for key-only work such as counts)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return IO.spread(df) if spread and name in TEXT_TABLES else df


def word(c: str, i: int) -> Column:
    return F.split_part(F.col(c), F.lit(" "), F.lit(i))


# ------------------------------------------------------- stand-in mappings ---
def part_year_slices(part: DataFrame) -> list:
    """Three yearly catalogue files cut from ``part``: messy headers, columns
    missing per year, blank names, bad numbers, and overlapping keys so the
    newest-year rule has work to do."""
    seq = F.col("p_partkey").cast("string")
    y2023 = part.select(
        seq.alias("item_seq "), F.col("p_name").alias("item_name"),
        F.col("p_brand").alias(" entp_name"), F.col("p_type").alias("drug_shape"),
        word("p_name", 1).alias("color_class1"), F.col("p_size").cast("string").alias("print_front"),
        F.col("p_retailprice").cast("string").alias("leng_long"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("chartn"),
        F.col("p_partkey").alias("ord"))
    y2024 = part.where(F.col("p_size") > 25).select(
        seq.alias("ITEM_SEQ"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("ITEM_NAME"),
        F.col("p_brand").alias("ENTP_NAME"), F.col("p_type").alias("DRUG_SHAPE"),
        word("p_name", 1).alias("COLOR_CLASS1"), word("p_name", 2).alias("COLOR_CLASS2"),
        F.when(F.col("p_size") > 45, F.lit("abc")).otherwise(F.col("p_size").cast("string")).alias("LENG_SHORT"),
        F.when(F.col("p_type") == "PROMO", F.lit("nan")).otherwise(F.lit("ETC")).alias("ETC_OTC_CODE"),
        F.col("p_partkey").alias("ORD"))
    y2025 = part.where(F.col("p_type").isin("PROMO", "ECONOMY")).select(
        seq.alias("Item_Seq"),
        F.when(F.col("p_size") < 10, F.lit("")).otherwise(F.upper("p_name")).alias("Item_Name"),
        F.concat(F.col("p_brand"), F.lit(" Co")).alias("Entp_Name"),
        F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 ")).alias("Thick"),
        F.when(F.col("p_size") > 40, F.lit("NA")).alias("Print_Back"),
        F.col("p_partkey").alias("Ord"))
    return [(2023, y2023), (2024, y2024), (2025, y2025)]


# ------------------------------------------------------------------ queries ---
@register("catalogue_pipeline")
def q_catalogue_pipeline(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return J.catalogue_pipeline(part_year_slices(part), ord_col="ord")


@register("catalogue_sample")
def q_catalogue_sample(spark, sf_dir):
    """The first three documents of the catalogue in its written order
    (name, then key), as the build prints them.  The limit is the feature; a
    global top-3 is a per-partition top-3 merged on one node."""
    part = table(spark, sf_dir, "part")
    cat = J.catalogue_pipeline(part_year_slices(part), ord_col="ord")
    return cat.orderBy("ITEM_NAME", "ITEM_SEQ").limit(3).select("ITEM_SEQ", "ITEM_NAME", "RAG_TEXT")


ORDER_YEARS = list(range(1995, 2002))      # the stand-in's yearly files
ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"]
ORDER_KEEP = ["O_ORDERKEY", "O_CUSTKEY", "O_ORDERSTATUS", "O_TOTALPRICE", "O_ORDERPRIORITY",
              "O_ORDERDATE", "O_CLERK"]


def order_year_slices(orders: DataFrame) -> list:
    """One text slice of ``orders`` per year: headers in varying case and with
    blanks, one column (other than the key) missing per year."""
    out = []
    for i, y in enumerate(ORDER_YEARS):
        sl = orders.where((F.col("o_orderdate") >= F.lit(f"{y}-01-01").cast("timestamp_ntz")) &
                          (F.col("o_orderdate") < F.lit(f"{y + 1}-01-01").cast("timestamp_ntz")))
        dropped = ORDER_COLS[1 + i % (len(ORDER_COLS) - 1)]
        cols = []
        for c in ORDER_COLS:
            if c == dropped:
                continue
            v = (F.date_format(c, "yyyy-MM-dd") if c == "o_orderdate" else F.col(c).cast("string"))
            header = c.upper() if i % 2 else f" {c} "
            cols.append(v.alias(header))
        out.append((y, sl.select(*cols)))
    # orders without a date or outside these years are a slice of their own
    date = F.col("o_orderdate")
    rest = orders.where(date.isNull() | (date < F.lit(f"{ORDER_YEARS[0]}-01-01").cast("timestamp_ntz")) |
                        (date >= F.lit(f"{ORDER_YEARS[-1] + 1}-01-01").cast("timestamp_ntz")))
    out.append((0, rest.select(*[(F.date_format(c, "yyyy-MM-dd") if c == "o_orderdate" else F.col(c).cast("string")).alias(c)
                                 for c in ORDER_COLS])))
    return out


@register("union_by_name_years")
def q_union_by_name_years(spark, sf_dir):
    """Yearly files with drifting headers -> one table by name."""
    orders = table(spark, sf_dir, "orders")
    tagged = [S.normalize_headers(df).withColumn("SOURCE_YEAR", F.lit(y))
              for y, df in order_year_slices(orders)]
    kept = S.keep_columns(S.union_by_name(tagged), ORDER_KEEP, extra=["SOURCE_YEAR"])
    return kept.select(*[T.blank_nan(c).alias(c) for c in ORDER_KEEP], "SOURCE_YEAR")


SUPPLIER_MAP = [("supp_id", "S_SUPPKEY"), ("supp_name", "S_NAME"), ("nation_key", "S_NATIONKEY"),
                ("acctbal", "S_ACCTBAL"), ("phone", "S_PHONE"), ("comment", "S_COMMENT")]


@register("keep_cols_rename")
def q_keep_cols_rename(spark, sf_dir):
    """Map to target names, absent -> "", constant columns."""
    sup = S.normalize_headers(table(spark, sf_dir, "supplier"))
    out = S.map_columns(sup, SUPPLIER_MAP)
    return S.with_constants(out, {"item_image": "", "edi_code": ""})


@register("first_nonempty")
def q_first_nonempty(spark, sf_dir):
    """P5 F2: first non-empty of two alternative columns (here: language,
    blanked for English rows, else the source)."""
    docs = table(spark, sf_dir, "documents", spread=False)    # short columns only
    a = T.blank_nan(F.when(F.col("lang") != "en", F.col("lang")))
    b = T.blank_nan(F.col("source"))
    return docs.select("doc_id", S.first_nonempty(a, b).alias("lang_or_source"))


@register("text_normalize")
def q_text_normalize(spark, sf_dir):
    """F1 (a-d) F3: markup -> clean text."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.clean_text("html").alias("text"))


@register("numeric_coerce")
def q_numeric_coerce(spark, sf_dir):
    """text -> double, anything else -> 0.0."""
    ev = table(spark, sf_dir, "events").select(
        F.lit("events_k").alias("source"), F.col("event_id").alias("id"),
        F.get_json_object("props", "$.k").alias("raw"))
    part = table(spark, sf_dir, "part")
    names = part.select(F.lit("part_name").alias("source"), F.col("p_partkey").alias("id"),
                        F.col("p_name").alias("raw"))
    sizes = part.select(F.lit("part_size").alias("source"), F.col("p_partkey").alias("id"),
                        F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")).alias("raw"))
    suffixed = part.select(F.lit("part_size_d").alias("source"), F.col("p_partkey").alias("id"),
                           F.concat(F.col("p_size").cast("string"), F.lit(".0d")).alias("raw"))
    raw = ev.unionByName(names).unionByName(sizes).unionByName(suffixed)
    return raw.select("source", "id", "raw", T.to_number("raw").alias("value"))


@register("blank_key_filter")
def q_blank_key_filter(spark, sf_dir):
    """Drop blank keys/texts, keep documents longer than 20 chars."""
    docs = table(spark, sf_dir, "documents")
    d = S.drop_blank(docs.withColumn("lang", T.blank_nan("lang")), "lang")
    d = S.drop_blank_text(d, "text")
    d = S.longer_than(d, "text", FV.LEAFLET_MIN_CHARS)
    return d.select("doc_id", "lang", F.length("text").cast("long").alias("text_len"))


@register("dedup_newest")
def q_dedup_newest(spark, sf_dir):
    """Newest event per user (ties: lower event id)."""
    ev = table(spark, sf_dir, "events")
    top = R.keep_first(ev, ["user_id"], [F.col("ts").desc(), F.col("event_id").asc()])
    return top.select("user_id", "event_id", "event_type", "value",
                      F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


@register("dedup_first_seen")
def q_dedup_first_seen(spark, sf_dir):
    """One document per distinct text, the first by doc_id, with the
    number of copies.  One scan and one grouped aggregate per text hash give
    the first document's short columns (``min`` of a struct led by the id) and
    the copy count, combined map-side, so a text copied across a third of the
    table is reduced in every partition."""
    docs = table(spark, sf_dir, "documents")
    per_text = docs.select(F.md5("text").alias("text_md5"), F.struct("doc_id", "lang", "source", "n_chars").alias("d")) \
        .groupBy("text_md5").agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("copies"))
    return per_text.select("d.doc_id", "text_md5", "copies", "d.lang", "d.source", "d.n_chars")


def _part_words(part: DataFrame) -> DataFrame:
    return part.withColumn("w1", word("p_name", 1)).withColumn("w2", word("p_name", 2))


@register("document_build")
def q_document_build(spark, sf_dir):
    """Catalogue and leaflet documents with their ids."""
    p = _part_words(table(spark, sf_dir, "part"))
    size = F.col("p_size").cast("string")
    otc = F.when(F.col("p_size") > 25, F.lit("ETC")).otherwise(F.lit(""))
    cat = T.catalogue_document("p_name", "p_brand", "p_type", "w1", "w2", size, F.lit(""), otc,
                               F.concat(F.lit("size "), size))
    leaflet = T.leaflet_document("p_name", [F.col("p_type"), F.col("p_brand"), F.lit(""), F.col("w1"),
                                            F.lit(""), F.col("w2"), otc])
    return p.select(T.leaflet_id(F.col("p_partkey").cast("string")).alias("doc_id"),
                    cat.alias("catalogue_text"), leaflet.alias("leaflet_text"),
                    (F.length(leaflet) > FV.LEAFLET_MIN_CHARS).alias("leaflet_kept"))


@register("upsert_last_wins")
def q_upsert_last_wins(spark, sf_dir):
    """Keyed upsert of a changed batch (two versions of some keys inside
    the batch, plus new keys); the last version wins."""
    cust = table(spark, sf_dir, "customer")
    cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    old = cust.select(*cols, F.lit(0).alias("batch"), F.col("c_custkey").alias("ord"))
    auto = cust.where(F.col("c_mktsegment") == "AUTOMOBILE")
    v1 = auto.select("c_custkey", F.lower("c_name").alias("c_name"), "c_nationkey",
                     (F.col("c_acctbal") + 100).alias("c_acctbal"), "c_mktsegment",
                     F.lit(1).alias("batch"), (F.col("c_custkey") * 2).alias("ord"))
    v2 = auto.where(F.col("c_nationkey") < 5).select(
        "c_custkey", F.upper("c_name").alias("c_name"), "c_nationkey",
        (F.col("c_acctbal") + 200).alias("c_acctbal"), "c_mktsegment",
        F.lit(1).alias("batch"), (F.col("c_custkey") * 2 + 1).alias("ord"))
    fresh = cust.where(F.col("c_mktsegment") == "MACHINERY").select(
        (F.col("c_custkey") + 1_000_000_000).alias("c_custkey"), "c_name", "c_nationkey", "c_acctbal",
        F.lit("NEW").alias("c_mktsegment"), F.lit(1).alias("batch"), F.col("c_custkey").alias("ord"))
    merged = IO.upsert(old, v1.unionByName(v2).unionByName(fresh), ["c_custkey"], ["batch", "ord"])
    return merged.select(*cols, "batch")


TABLE_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
    "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"],
    "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}


@register("table_refresh_report")
def q_table_refresh_report(spark, sf_dir):
    """Per table rows in, rows out after blank-key drop and key
    dedup, and whether all of them are left."""
    parts = []
    for name, keys in TABLE_KEYS.items():
        t = table(spark, sf_dir, name, spread=False)     # keys only: no text work
        # count(distinct k1, k2) skips rows with a null key part, as P7 does
        parts.append(t.agg(F.count(F.lit(1)).alias("rows_in"),
                           F.count_distinct(*[F.col(k) for k in keys]).alias("rows_out"))
                      .select(F.lit(name).alias("table_name"), "rows_in", "rows_out"))
    rep = S.union_by_name(parts)
    return rep.withColumn("complete", F.col("rows_out") == F.col("rows_in"))


SAFETY_STANDIN_COLS = [("host", "HOST"), ("page", "ID"), ("text", "NAME"), ("text_or_url", ("NAME", "SITE"))]


@register("safety_refresh")
def q_safety_refresh(spark, sf_dir):
    """C3/C4 (S10 F1 F5 P7 T2 P4 P5): one safety list refreshed from a raw
    file, played by ``pages``: every column cleaned (markup text through F1,
    the numeric id through F5), rows with a blank name or key dropped, the
    first row per key (the site) in file order, mapped to the output columns
    with a first-non-empty pair."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    raw = pages.select(F.col("page_id").alias("ID"), F.split_part("url", F.lit("/"), F.lit(3)).alias("HOST"),
                       F.col("url").alias("SITE"), F.col("html").alias("NAME"), IO.file_order(pages).alias("ORD"))
    return IO.refresh_table(IO.spread(raw), "HOST", SAFETY_STANDIN_COLS, name_col="NAME", ord_col="ORD")


# ------------------------------------------------------------ lookups (Q*) ---
CAT_ORDER = ["item_name", "item_seq"]   # the catalogue's "first" order (ascending)
CAT_COLS = ["item_seq", "item_name", "entp_name", "chartn", "drug_shape", "color_class1",
            "color_class2", "etc_otc_code"]


def medicines_from_part(part: DataFrame) -> DataFrame:
    """The serving table ``medicines`` played by ``part`` (stored fold column)."""
    size = F.col("p_size").cast("string")
    return part.select(
        F.col("p_partkey").cast("string").alias("item_seq"), F.col("p_name").alias("item_name"),
        F.col("p_brand").alias("entp_name"), F.concat(F.lit("size "), size).alias("chartn"),
        F.col("p_type").alias("drug_shape"), word("p_name", 1).alias("color_class1"),
        word("p_name", 2).alias("color_class2"),
        F.when(F.col("p_size") > 25, F.lit("ETC")).otherwise(F.lit("OTC")).alias("etc_otc_code"),
        F.concat(F.lit("img/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("image_url"),
        T.fold_ascii("p_name").alias("name_fold"))


def keywords(spark, sf_dir) -> DataFrame:
    """Search keywords: the long tokens of all conversation turns, and terms
    with LIKE wildcards made from the catalogue's names."""
    conv = table(spark, sf_dir, "conversations")
    name = table(spark, sf_dir, "part").select("p_name").distinct()
    wild = name.select(F.explode(F.array(
        F.concat(F.substring("p_name", 1, 2), F.lit("%"), F.substring("p_name", -2, 2)),
        F.concat(F.lit("_"), F.substring("p_name", 2, 3), F.lit("_")))).alias("keyword"))
    # explode_outer + null filter: keeps the optimizer from inferring a
    # size(tokens) > 0 filter and pushing the tokenising into the scan task
    return conv.select(F.explode_outer(T.long_tokens("text")).alias("keyword")) \
        .where(F.col("keyword").isNotNull()).unionByName(wild).distinct()


def _name_search(spark, sf_dir, strategy, **kw):
    med = medicines_from_part(table(spark, sf_dir, "part"))
    # the keywords come from tokenising every turn and feed the match and
    # both sides of the envelope: tokenise once
    kws = keywords(spark, sf_dir).checkpoint(eager=True)
    hits = L.first_matches(kws, med, "keyword", CAT_COLS, CAT_ORDER, FV.NAME_SEARCH_LIMIT,
                           strategy=strategy, **kw)
    out = L.envelope(kws, hits, "keyword")
    # rank 0 = no hit (keeps the column a plain integer)
    return out.select("keyword", "found", "n_found", F.coalesce("rank", F.lit(0)).alias("rank"), *CAT_COLS)


@register("name_search_top5")
def q_name_search_top5(spark, sf_dir):
    """Every keyword against the catalogue, first 5 by name.
    ``auto``: broadcast the terms when few, else the n-gram index."""
    return _name_search(spark, sf_dir, "auto")


@register("name_search_indexed")
def q_name_search_indexed(spark, sf_dir):
    """Q1 T3 through stored tables: the top-k gram table for terms that are grams
    themselves, the n-gram index for the others (same result as the theta join
    by construction)."""
    med = medicines_from_part(table(spark, sf_dir, "part"))
    index = L.names_index(med).checkpoint()
    grams = L.build_gram_topk(med, CAT_COLS, CAT_ORDER, FV.NAME_SEARCH_LIMIT).checkpoint()
    return _name_search(spark, sf_dir, "ngram", index=index, grams=grams)


def attribute_requests(part: DataFrame) -> DataFrame:
    """(shape, color) requests derived from the catalogue's own values: both,
    shape only (lower case: LIKE folds ASCII case), color only (shape ""
    counts as absent)."""
    p = _part_words(part)
    both = p.select(F.lower("p_type").alias("shape"), F.col("w1").alias("color"))
    shape_only = p.select(F.lower("p_type").alias("shape"), F.lit(None).cast("string").alias("color"))
    color_only = p.select(F.lit("").alias("shape"), F.col("w2").alias("color"))
    none = F.lit(None).cast("string")
    rejected = p.select(F.lit("").alias("shape"), none.alias("color")).unionByName(
        p.select(none.alias("shape"), F.lit("").alias("color")))
    unknown = p.select(F.concat(F.lit("no "), F.lower("p_type")).alias("shape"), none.alias("color"))
    req = both.unionByName(shape_only).unionByName(color_only).unionByName(rejected).unionByName(unknown).distinct()
    return req.withColumn("request_id", F.concat_ws("|", F.coalesce("shape", F.lit("∅")),
                                                    F.coalesce("color", F.lit("∅"))))


def attribute_matches(requests: DataFrame, med: DataFrame, k: int) -> DataFrame:
    """Shape LIKE and (color1 LIKE or color2 LIKE), absent
    arguments add no condition; first ``k`` per request in catalogue order, by
    the bitmap index (``operators.bitmaps``)."""
    items = B.number_items(med.select(*CAT_COLS), CAT_ORDER)
    index = B.build_index(items, {"shape": ["drug_shape"], "color": ["color_class1", "color_class2"]}).checkpoint(eager=True)
    valid = requests.where(S.has_any_argument("shape", "color"))
    top = B.first_items(valid, index, ["shape", "color"], "request_id", k)
    return top.join(items, "_no").drop("_no")


@register("identify_by_attributes")
def q_identify_by_attributes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    med = medicines_from_part(part)
    req = attribute_requests(part).checkpoint(eager=True)      # read by both kinds and both sides of the envelope
    hits = attribute_matches(req, med, FV.SHAPE_SEARCH_LIMIT)
    out = L.envelope(req, hits, "request_id", "request_id")
    return out.withColumn("rejected", ~S.has_any_argument("shape", "color")).select(
        "request_id", "shape", "color", "rejected", "found", "n_found",
        F.coalesce("rank", F.lit(0)).alias("rank"), *CAT_COLS)


def warning_tables(spark, sf_dir) -> dict:
    """The three safety lists played by part / supplier / customer:
    (table, name column matched, key, detail columns)."""
    part = table(spark, sf_dir, "part")
    elderly = part.select(F.col("p_partkey").cast("string").alias("item_key"),
                          F.col("p_name").alias("item_name"),
                          F.concat(F.lit("caution "), F.col("p_brand")).alias("detail1"),
                          F.col("p_type").alias("detail2"))
    sup = table(spark, sf_dir, "supplier")
    duration = sup.select(F.col("s_suppkey").cast("string").alias("item_key"), F.col("s_name").alias("item_name"),
                          F.concat((F.col("s_nationkey") + 1).cast("string"), F.lit("일")).alias("detail1"),
                          F.lit("").alias("detail2"))
    cust = table(spark, sf_dir, "customer")
    age = cust.select(F.col("c_custkey").cast("string").alias("item_key"), F.col("c_name").alias("item_name"),
                      F.concat(F.lit("age "), F.col("c_nationkey").cast("string")).alias("detail1"),
                      F.col("c_mktsegment").alias("detail2"))
    return {"elderly": elderly, "duration": duration, "age_taboo": age}


def warning_terms(spark, sf_dir) -> DataFrame:
    """One drug list: catalogue nouns plus the number part of every supplier
    and customer name (each such term names one entry of both lists)."""
    part = _part_words(table(spark, sf_dir, "part")).select(F.col("w2").alias("term"))
    sup = table(spark, sf_dir, "supplier").select(F.split_part("s_name", F.lit("#"), F.lit(2)).alias("term"))
    cust = table(spark, sf_dir, "customer").select(F.split_part("c_name", F.lit("#"), F.lit(2)).alias("term"))
    return part.unionByName(sup).unionByName(cust).distinct()


@register("warning_lookup")
def q_warning_lookup(spark, sf_dir):
    """One drug list against every warning table, all
    matches, with found/count per (term, table).  The three lists are matched
    as one catalogue tagged with its list (one size check, one index or
    nested loop, one pass), then split per (term, list) by the envelope."""
    terms = warning_terms(spark, sf_dir)
    tables = warning_tables(spark, sf_dir)
    cat = S.union_by_name([tbl.withColumn("warning_type", F.lit(w)) for w, tbl in tables.items()]) \
        .withColumn("name_fold", T.fold_ascii("item_name"))
    hits = L.substring_matches(terms, cat, "term", ["warning_type", "item_key", "item_name", "detail1", "detail2"])
    req = S.union_by_name([terms.select("term", F.lit(w).alias("warning_type")) for w in tables])
    env = L.envelope(req, hits.drop("name_fold"), ["term", "warning_type"])
    return env.select("term", "warning_type", "found", "n_found", "item_key",
                      "item_name", "detail1", "detail2")


@register("first_match_or_null")
def q_first_match_or_null(spark, sf_dir):
    """Q6 Q7: first match per term (pill image and details) or nulls."""
    med = medicines_from_part(table(spark, sf_dir, "part"))
    bench = table(spark, sf_dir, "benchmark")
    terms = bench.select(F.explode_outer(T.long_tokens("text")).alias("term")) \
        .where(F.col("term").isNotNull()).distinct()
    hits = L.first_matches(terms, med, "term", ["item_seq", "item_name", "drug_shape", "entp_name", "image_url"],
                           CAT_ORDER, 1)
    out = terms.join(hits.drop("name_fold", "rank"), "term", "left")
    return out.select("term", F.col("item_seq").isNotNull().alias("found"), "item_name",
                      F.col("drug_shape").alias("appearance"), F.col("entp_name").alias("class_name"),
                      "image_url")


token_context = J.token_context


@register("first_token_match")
def q_first_token_match(spark, sf_dir):
    """First-matching-token lookup for every user message."""
    med = medicines_from_part(table(spark, sf_dir, "part"))
    msgs = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    ctx = token_context(msgs, med, ["conv_id", "turn"], "text")
    out = msgs.select("conv_id", "turn").join(ctx, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "matched_token", F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
                      F.coalesce("context", F.lit("")).alias("context"))


# Latin gate terms for the stand-in text (the Korean list is DRUG_KEYWORDS).
GATE_TERMS = ["the", "que", "und", "les"]


@register("keyword_gate")
def q_keyword_gate(spark, sf_dir):
    """Does the message contain any gate term (case-sensitive)."""
    conv = table(spark, sf_dir, "conversations")
    return conv.select("conv_id", "turn", T.contains_any("text", GATE_TERMS).alias("gated"))


def extracted_names(text: Column) -> Column:
    """Names a model might extract from a text: its distinct capitalised
    tokens, with odd-length ones made unrecognisable ("Zq" prefix) to play
    hallucinated names."""
    caps = F.array_distinct(T.capitalised_tokens(text))
    return F.transform(caps, lambda w: F.when(F.length(w) % 2 == 0, w).otherwise(F.concat(F.lit("Zq"), w)))


@register("validate_extractions")
def q_validate_extractions(spark, sf_dir):
    """Keep names whose first 4 characters occur in the text;
    when none does, keep them all."""
    docs = table(spark, sf_dir, "documents")
    names = extracted_names(F.col("text"))
    checked = F.transform(names, lambda n: F.struct(n.alias("name"),
                                                    T.contains_text(F.col("text"), T.prefix(n)).alias("ok")))
    d = docs.select("doc_id", checked.alias("c"))
    d = d.withColumn("any_ok", F.exists("c", lambda s: s["ok"]))
    # posexplode_outer + a null filter: a plain posexplode makes the optimizer
    # infer size(c) > 0 and push that (the whole extraction) below the
    # repartition, into the scan task
    ex = d.select("doc_id", "any_ok", F.posexplode_outer("c").alias("pos", "x")).where(F.col("x").isNotNull())
    ex = ex.select("doc_id", "pos", F.col("x.name").alias("name"), F.col("x.ok").alias("ok"),
                   F.col("any_ok").alias("validated"))
    return ex.where(F.col("ok") | ~F.col("validated"))


@register("fuzzy_prefix_match")
def q_fuzzy_prefix_match(spark, sf_dir):
    """Q9: first 4 characters of each name -> first catalogue hit, or the
    name itself with empty fields and ``db_matched = false``."""
    med = medicines_from_part(table(spark, sf_dir, "part"))
    names = keywords(spark, sf_dir).withColumnRenamed("keyword", "original") \
        .withColumn("short", T.prefix("original"))
    return prefix_match(names, med)


prefix_match = J.prefix_match


def model_replies(events: DataFrame) -> Column:
    """Model replies around JSON, one shape per event type (stand-in)."""
    et, uid = F.col("event_type"), F.col("user_id").cast("string")
    good = F.concat(F.lit('Result: {"medicines": ["'), et, F.lit('", "u'), uid, F.lit('"]} done'))
    return (F.when((et == "purchase") & (F.col("value") > 50),
                   F.concat(F.lit('{"medicines": ["a"]} and {"x": '), uid, F.lit("}")))
             .when((et == "purchase") & (F.col("value") < 2), F.lit('{"medicines": [1, "b"]}'))
             .when((et == "purchase") & (F.col("value") < 4), F.lit('{"medicines": ["a"]}] trailing {x}'))
             .when((et == "purchase") & (F.col("value") < 6), F.lit('{"medicines": ["a"]}], [{"b":1}'))
             .when((et == "purchase") & (F.col("value") < 8), F.lit('{"medicines": ["a"]}, "w": {"b":1}'))
             .when(et == "purchase", good)
             .when(et == "signup", F.concat(F.lit('{"other": '), F.col("props"), F.lit("}")))
             .when(et == "view", F.concat(F.lit("no json here ("), uid, F.lit(")")))
             .when(et == "error", F.lit('{"medicines": ["a", }'))
             .otherwise(F.concat(F.lit("{'medicines': ['"), et, F.lit("']}"))))


@register("json_extract_list")
def q_json_extract_list(spark, sf_dir):
    """Outermost object -> strict parse -> list of names, one
    row per name in order (or one row with no name)."""
    ev = IO.spread(table(spark, sf_dir, "events"))     # JSON parsing per row: use every core
    d = N.with_name_list(ev.select("event_id", model_replies(ev).alias("reply")), F.col("reply"),
                         keep=["event_id"])
    out = d.select("event_id", "status", F.posexplode_outer("names").alias("pos", "name"))
    return out.withColumn("pos", F.coalesce("pos", F.lit(-1)))   # -1 = no name


@register("ocr_response_text")
def q_ocr_response_text(spark, sf_dir):
    """Recogniser response JSON -> text ("" when errored or empty)."""
    docs = table(spark, sf_dir, "documents")
    results = F.when(F.col("source") == "src3", F.array().cast("array<struct<ParsedText:string>>")) \
        .otherwise(F.array(F.struct(F.col("text").alias("ParsedText"))))
    resp = F.to_json(F.struct((F.col("lang") == "de").alias("IsErroredOnProcessing"),
                              results.alias("ParsedResults")))
    txt = N.ocr_text(resp)
    return docs.select("doc_id", F.length(txt).cast("long").alias("text_len"), F.md5(txt).alias("text_md5"))


@register("extraction_match")
def q_extraction_match(spark, sf_dir):
    """Model reply -> names -> validation against the text -> prefix
    match in the catalogue, one row per kept name."""
    docs = table(spark, sf_dir, "documents")
    part = table(spark, sf_dir, "part")
    med = medicines_from_part(part)
    withp = docs.join(part.select(F.col("p_partkey").alias("doc_id"), "p_name"), "doc_id", "left")
    reply = F.to_json(F.struct(F.filter(F.array(F.col("p_name"), F.concat(F.lit("Zq"), F.col("lang"))),
                                        lambda x: x.isNotNull()).alias("medicines")))
    return J.extraction_match(withp.select("doc_id", "text", reply.alias("reply")), med, ["doc_id"])


@register("recent_history")
def q_recent_history(spark, sf_dir):
    """Last 6 turns per conversation, oldest first."""
    conv = table(spark, sf_dir, "conversations", spread=False)   # the top-k shuffles by key anyway
    last = R.last_n_oldest_first(conv, ["conv_id"], [F.col("turn")], FV.PROMPT_HISTORY)
    return last.select("conv_id", "pos", "turn", "role", F.col("text").alias("content"))


@register("history_report")
def q_history_report(spark, sf_dir):
    """C10 (T4 O3 O4 P14 N6): per conversation (the user) the last 20 turns,
    oldest first, collected into one report row.  The group is at most 20
    rows after the top-k, so collecting it is bounded."""
    conv = table(spark, sf_dir, "conversations", spread=False)   # the top-k shuffles by key anyway
    rep = J.history_report(conv, None, "conv_id", [F.col("turn")], content_col="text")
    joined = lambda field, sep: F.concat_ws(sep, F.transform("turns", lambda t: t[field]))
    return rep.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), joined("role", ",").alias("roles"),
                      F.md5(joined("content", "␞")).alias("content_md5"),
                      F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + F.coalesce(F.length(t["content"]), F.lit(0))).alias("chars"))


@register("rolling_context")
def q_rolling_context(spark, sf_dir):
    """For every turn the last 6 turns up to it, and the prompt sizes."""
    conv = table(spark, sf_dir, "conversations", spread=False)   # the window shuffles by key anyway
    msg = F.struct(F.col("role").alias("role"), F.col("text").alias("content"))
    r = R.rolling_frames(conv, ["conv_id"], [F.col("turn")], FV.PROMPT_HISTORY, msg, "history")
    prompt = N.prompt_messages(F.lit(""), F.col("history"), F.col("text"))
    return r.select("conv_id", "turn", F.size("history").alias("n_history"),
                    F.concat_ws(",", F.transform("history", lambda m: m["role"])).alias("roles"),
                    F.aggregate("history", F.lit(0).cast("long"),
                                lambda acc, m: acc + F.length(m["content"])).alias("history_chars"),
                    F.size(prompt).alias("n_prompt"))


def vector_collections(spark, sf_dir) -> tuple:
    """Two collections with whole-number hashing vectors (exact distances on
    both engines): the catalogue's documents and the suppliers as leaflets."""
    med = medicines_from_part(table(spark, sf_dir, "part"))
    meta = ["name", "company", "shape", "color1", "description"]
    first = med.select(F.col("item_seq").alias("id"), F.concat_ws(" ", "item_name", "drug_shape").alias("document"),
                       F.struct(*[F.col(c).alias(m) for c, m in zip(
                           ["item_name", "entp_name", "drug_shape", "color_class1", "chartn"], meta)]).alias("metadata"))
    sup = table(spark, sf_dir, "supplier")
    second = sup.select(F.col("s_suppkey").cast("string").alias("id"), F.translate("s_name", "#0", "  ").alias("document"),
                        F.struct(F.col("s_name").alias("name"), *[F.lit(None).cast("string").alias(m) for m in meta[1:]]).alias("metadata"))
    # stored tables in real use: built once, not once per reader
    return tuple(V.hash_vectors(IO.spread(c), "document", unit=False).checkpoint(eager=True) for c in (first, second))


def chat_context(spark, sf_dir, gate_terms: list) -> DataFrame:
    """C6 over all turns: those of users with the vector collections at hand,
    the others without (the token path)."""
    med = medicines_from_part(table(spark, sf_dir, "part"))
    conv = table(spark, sf_dir, "conversations")
    keys = ["conv_id", "turn"]
    is_user = F.col("role") == "user"
    return J.message_context(conv.where(is_user), med, keys, gate_terms=gate_terms,
                             collections=vector_collections(spark, sf_dir), unit=False) \
        .unionByName(J.message_context(conv.where(~is_user), med, keys, gate_terms=gate_terms))


@register("message_context")
def q_message_context(spark, sf_dir):
    """Per message the context block and where it comes from."""
    return chat_context(spark, sf_dir, GATE_TERMS)


@register("prompt_usage_flags")
def q_prompt_usage_flags(spark, sf_dir):
    """Prompt size and usage flags per message."""
    conv = table(spark, sf_dir, "conversations", spread=False)
    return J.prompt_usage(conv, chat_context(spark, sf_dir, GATE_TERMS), ["conv_id"], ["turn"])


def alarm_log(events: DataFrame) -> DataFrame:
    """Alarm event log from ``events``: non-error events register an alarm
    (id = event id), error events disable the alarm named in ``props.k``."""
    reg = events.where(F.col("event_type") != "error").select(
        F.col("event_id").alias("alarm_id"), "ts", "event_id", F.lit("register").alias("action"),
        F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("medication_name"),
        F.date_format("ts", "HH:mm").alias("time_hhmm"), F.date_format("ts", "EEE").alias("days_of_week"))
    dis = events.where(F.col("event_type") == "error").select(
        F.get_json_object("props", "$.k").try_cast("long").alias("alarm_id"), "ts", "event_id",
        F.lit("disable").alias("action"))
    return reg.unionByName(dis, allowMissingColumns=True)


@register("alarm_state")
def q_alarm_state(spark, sf_dir):
    """Fold the log into the current alarm table (soft delete;
    disabling an unknown id changes nothing)."""
    log = alarm_log(table(spark, sf_dir, "events"))
    st = A.fold_alarms(log)
    return st.select("alarm_id", "user_id", "medication_name", "time_hhmm", "days_of_week", "is_enabled")


@register("active_alarms")
def q_active_alarms(spark, sf_dir):
    """The enabled alarms of a given table of users (those who
    bought something), folded from the log."""
    ev = table(spark, sf_dir, "events")
    users = ev.where(F.col("event_type") == "purchase").select(F.col("user_id").cast("string").alias("user_id")).distinct()
    st = A.active_alarms(A.fold_alarms(alarm_log(ev)), users)
    return st.select("alarm_id", "user_id", "medication_name", "time_hhmm", "days_of_week")


@register("append_with_ids")
def q_append_with_ids(spark, sf_dir):
    """New registrations get ids above the current maximum, in
    request order, with the default flag and the confirmation text."""
    ev = table(spark, sf_dir, "events")
    existing = ev.where(F.col("event_type") != "signup").select(F.col("event_id").alias("id"))
    new = ev.where(F.col("event_type") == "signup").select(
        "ts", "event_id", F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("med-"), F.get_json_object("props", "$.k")).alias("medication_name"),
        F.date_format("ts", "HH:mm").alias("time_hhmm"), F.lit("daily").alias("days_of_week"))
    out = IO.append_with_ids(existing, new, ["ts", "event_id"], defaults={"is_enabled": 1})
    return out.select("id", "event_id", "user_id", "medication_name", "time_hhmm", "days_of_week",
                      "is_enabled", T.alarm_message("medication_name", "time_hhmm").alias("message"))


@register("speech_text")
def q_speech_text(spark, sf_dir):
    """Strip, reject blank, drop characters speech cannot say."""
    docs = J.speech_preparation(table(spark, sf_dir, "documents")).where(~F.col("rejected"))
    return docs.select("doc_id", F.length("speech").cast("long").alias("clean_len"), F.md5("speech").alias("clean_md5"))


# --------------------------------------------------------------- vectors (V*) ---
@register("vector_topk")
def q_vector_topk(spark, sf_dir):
    """The 3 nearest vectors (squared L2) to each label's centroid."""
    emb = table(spark, sf_dir, "embeddings")
    q = V.centroids(emb, "label")
    out = V.knn_topk(q, emb, FV.VECTOR_TOP_K)
    return out.select(F.col("qid").alias("label"), "rank", F.col("doc_id").alias("vec_id"),
                      F.round("dist", 6).alias("dist"))


@register("vector_topk_indexed")
def q_vector_topk_indexed(spark, sf_dir):
    """V3 O7 through the pivot index: the 3 nearest vectors to the centroid of every
    (label, last digit of the id), equal to the full scan."""
    emb = table(spark, sf_dir, "embeddings")
    q = V.centroids(emb.withColumn("group", F.col("label") * 10 + F.col("vec_id") % 10), "group")
    out = P.search(P.build_index(emb), q, FV.VECTOR_TOP_K)
    return out.select("qid", "rank", F.col("doc_id").alias("vec_id"), F.round("dist", 6).alias("dist"))


@register("two_collection_search")
def q_two_collection_search(spark, sf_dir):
    """The same queries against two collections (even / odd labels)."""
    emb = table(spark, sf_dir, "embeddings")
    q = V.centroids(emb, "label")
    even, odd = emb.where(F.col("label") % 2 == 0), emb.where(F.col("label") % 2 == 1)
    out = V.two_collection_search(q, even, odd)
    return out.select(F.col("qid").alias("label"), "source", "source_rank", "rank",
                      F.col("doc_id").alias("vec_id"), F.round("dist", 6).alias("dist"))


def leaflet_rows(docs: DataFrame, key: Column, order: Column) -> DataFrame:
    """Raw leaflets, 14 columns and their order, played by ``documents``."""
    empty = [F.lit("").alias(f"c{i}") for i in range(4, 14)]
    return docs.select(key.cast("string").alias("c0"), F.concat_ws(" ", "source", "lang").alias("c1"),
                       F.col("source").alias("c2"), F.col("text").alias("c3"), *empty, order.alias("ord"))


@register("leaflet_first_per_key")
def q_leaflet_first_per_key(spark, sf_dir):
    """C5 before encoding (F1 F6 F9 F10 P2 P7 P8 T2): leaflets whose key repeats (the
    text's length), the first per key in file order; nothing is embedded."""
    docs = J.leaflet_documents(leaflet_rows(table(spark, sf_dir, "documents"), F.col("n_chars"), F.col("doc_id")), ord_col="ord")
    return docs.select("id", F.length("document").cast("long").alias("doc_chars"), F.md5("document").alias("document_md5"),
                       F.col("metadata.name").alias("name"))


@register("embed_documents")
def q_embed_documents(spark, sf_dir):
    """C5 V4 V5 N9 (F1 F6 F9 F10 P2 P7 P8 T2): raw leaflets, played by ``documents``
    (key: the document), to the vector index; every text is embedded."""
    docs = table(spark, sf_dir, "documents")
    idx = J.document_index(J.leaflet_documents(leaflet_rows(docs, F.col("doc_id"), F.col("doc_id")), ord_col="ord"))
    whole = F.transform("embedding", lambda x: F.round(x * 10000).cast("long").cast("string"))
    return idx.select("id", F.length("document").cast("long").alias("doc_chars"), F.array_join(whole, ",").alias("vector"),
                      F.col("metadata.name").alias("name"))


def whole_vector(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",")


@register("encode_documents")
def q_encode_documents(spark, sf_dir):
    """V1 V2: every leaflet through the encoder plug-in (length-bucketed
    micro-batches) with the deterministic hashing model."""
    docs = J.leaflet_documents(leaflet_rows(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("doc_id")), ord_col="ord")
    idx = J.document_index(docs, V.make_encoder(V.HashingModel))
    return idx.select("id", F.length("document").cast("long").alias("doc_chars"), whole_vector("embedding").alias("vector"))


def work_folder(spark, name: str) -> str:
    """A new folder for a table that a query writes and reads back."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("incremental_index")
def q_incremental_index(spark, sf_dir):
    """An index built over an earlier state of the documents (a tenth is
    missing, a tenth has another text, and some were removed since), then brought
    up to date: unchanged rows keep their vectors."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document"), F.struct(F.col("source").alias("name")).alias("metadata"),
        (F.col("doc_id") % 10).alias("_d"))
    gone = docs.where("_d = 2").withColumn("id", F.concat(F.lit("old-"), "id"))
    earlier = docs.where("_d <> 0").withColumn("document", F.when(F.col("_d") == 1, F.concat(F.lit("old "), "document"))
                                               .otherwise(F.col("document"))).unionByName(gone)
    path = work_folder(spark, "incremental-index")
    encode = lambda df: V.hash_vectors(df, "document", unit=False)
    I.build(earlier.drop("_d"), path, encode, parts=2)
    I.build(docs.drop("_d"), path, encode, parts=2)
    return spark.read.parquet(path).select("id", F.length("document").cast("long").alias("doc_chars"),
                                           whole_vector("embedding").alias("vector"), F.col("metadata.name").alias("name"))


@register("append_batches")
def q_append_batches(spark, sf_dir):
    """All chat turns appended in three batches, the second one twice (a
    retry); ids continue from batch to batch."""
    conv = table(spark, sf_dir, "conversations", spread=False)
    turns = conv.select("conv_id", "turn", F.col("conv_id").cast("string").alias("user_id"), "role", F.col("text").alias("content"),
                        F.pmod("conv_id", F.lit(3)).alias("_b"))
    path = work_folder(spark, "chat-turns")
    for b in (0, 1, 1, 2):
        J.save_turns(turns.where(F.col("_b") == b).drop("_b"), path, f"batch-{b}", ["conv_id", "turn"])
    return IO.read_batches(spark, path).select("id", "batch", "conv_id", "turn", "user_id", "role", F.md5("content").alias("content_md5"))


@register("embed_every_document")
def q_embed_every_document(spark, sf_dir):
    """C5 V1 V2 V4 V5 N9 (F1 F6 F9 F10 P2 P7 P8 T2): as ``embed_documents``, but
    keyed by the document, so every text is embedded; every hundredth comes again
    later with another text, so keys repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    again = docs.where("doc_id % 100 = 0").withColumns({"text": F.concat(F.lit("again "), "text"), "ord": F.col("doc_id") * 2 + 1})
    docs = docs.withColumn("ord", F.col("doc_id") * 2).unionByName(again)
    empty = [F.lit("").alias(f"c{i}") for i in range(4, 14)]
    raw = docs.select(F.col("doc_id").cast("string").alias("c0"), F.concat_ws(" ", "source", "lang").alias("c1"),
                      F.col("source").alias("c2"), F.col("text").alias("c3"), *empty, "ord")
    idx = J.document_index(J.leaflet_documents(raw, ord_col="ord"))
    whole = F.transform("embedding", lambda x: F.round(x * 10000).cast("long").cast("string"))
    return idx.select("id", F.length("document").cast("long").alias("doc_chars"), F.array_join(whole, ",").alias("vector"),
                      F.col("metadata.name").alias("name"))
