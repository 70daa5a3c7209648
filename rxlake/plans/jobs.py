"""Composite jobs (C1-C11) built from the operators.

Every job takes DataFrames and returns a DataFrame; reading and writing is
left to ``rxlake.sources``.  Parameters carry the application's defaults
(``rxlake.fixed_values``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxlake import fixed_values as FV
from rxlake.functions import nested as N
from rxlake.functions import text as T
from rxlake.operators import lookup as L
from rxlake.operators import rank as R
from rxlake.operators import shape as S
from rxlake.operators import vectors as V
from rxlake.sources import io as IO


# --------------------------------------------------------------------- C1 ---
def catalogue_pipeline(sources: list, ord_col: str | None = None,
                       sort_output: bool = False) -> DataFrame:
    """Yearly catalogue slices -> one cleaned, deduplicated catalogue.

    ``sources`` is a list of ``(year, DataFrame)`` with raw (string) columns.
    S5 tag -> P1 headers -> U1 union by name -> P3 keep list -> F2/F4 clean ->
    P7 drop nameless -> T1 newest per ITEM_SEQ (ties: lower ``ord``) -> F8.

    ``ord_col`` names a per-source order column; without one every source must
    be a file scan, whose order is used (``io.file_order``).
    """
    tagged = []
    for year, df in sources:
        ordc = F.col(f"`{ord_col}`") if ord_col else IO.file_order(df)
        df = S.normalize_headers(df.withColumn("_ORD", ordc))
        tagged.append(df.withColumn("SOURCE_YEAR", F.lit(int(year))).withColumnRenamed("_ORD", "_ord"))
    combined = S.union_by_name(tagged)
    kept = S.keep_columns(combined, FV.KEEP_COLS, extra=["SOURCE_YEAR", "_ord"])
    cleaned = kept.select(
        F.col("ITEM_SEQ").cast("string").alias("ITEM_SEQ"),
        *[T.blank_nan(c).alias(c) for c in FV.CATALOGUE_TEXT_COLS],
        *[T.to_number(c).alias(c) for c in FV.CATALOGUE_NUM_COLS],
        F.col("SOURCE_YEAR").cast("int").alias("SOURCE_YEAR"),
        "_ord",
    )
    named = S.drop_blank(cleaned, "ITEM_NAME")
    newest = R.keep_first(named, ["ITEM_SEQ"], [F.col("SOURCE_YEAR").desc(), F.col("_ord").asc()])
    out = newest.withColumn("RAG_TEXT", T.catalogue_document(
        "ITEM_NAME", "ENTP_NAME", "DRUG_SHAPE", "COLOR_CLASS1", "COLOR_CLASS2",
        "PRINT_FRONT", "PRINT_BACK", "ETC_OTC_CODE", "CHARTN")).drop("_ord")
    out = out.select(*FV.KEEP_COLS, "SOURCE_YEAR", "RAG_TEXT")
    if sort_output:  # O2: the order the written file carries
        out = out.orderBy("ITEM_NAME", "ITEM_SEQ")
    return out


# --------------------------------------------------------------------- C2 ---
def serving_table(catalogue: DataFrame) -> DataFrame:
    """Catalogue -> serving table ``medicines`` (P1 upper, P4 map, P6)."""
    df = S.normalize_headers(catalogue, strip=False)
    out = S.map_columns(df, FV.MEDICINES_COL_MAP)
    out = S.with_constants(out, {c: "" for c in FV.MEDICINES_CONST_COLS})
    # Text columns read back from CSV carry "" not NULL
    text_cols = [c for c in FV.MEDICINES_COL_MAP if c not in ("leng_long", "leng_short", "thick")]
    return out.select(*[T.blank_nan(c).alias(c) if c in text_cols else F.col(c) for c in out.columns])


def with_name_fold(medicines: DataFrame, name_col: str = "item_name") -> DataFrame:
    """Store the ASCII-folded name next to the name so substring filters
    on it push down to Parquet as ``StringContains``."""
    return medicines.withColumn("name_fold", T.fold_ascii(name_col))


# ----------------------------------------------------------------- V4/V5 ---
def document_index(docs: DataFrame, encoder=None) -> DataFrame:
    """V4: ``(id, document, metadata)`` -> + ``embedding``; blank documents
    are skipped (P9).  ``encoder`` is a pandas UDF from ``make_encoder``;
    without one the hashing vectors are used."""
    kept = docs.where(T.ustrip(F.coalesce(F.col("document"), F.lit(""))) != "")
    if encoder is None:
        kept = V.hash_vectors(kept, "document")
    else:
        kept = kept.withColumn("embedding", encoder(F.col("document")))
    return kept.select("id", "document", "embedding", "metadata")


def catalogue_documents(catalogue: DataFrame) -> DataFrame:
    """V4 input from the cleaned catalogue: id = ITEM_SEQ (stable, SURVEY D7),
    metadata {name, company, shape, color1, description}."""
    return catalogue.select(
        F.col("ITEM_SEQ").alias("id"), F.col("RAG_TEXT").alias("document"),
        F.struct(F.col("ITEM_NAME").alias("name"), F.col("ENTP_NAME").alias("company"),
                 F.col("DRUG_SHAPE").alias("shape"), F.col("COLOR_CLASS1").alias("color1"),
                 F.col("CHARTN").alias("description"), F.lit(None).cast("string").alias("image_url"),
                 F.lit("medicines").alias("source")).alias("metadata"))


def leaflet_documents(raw: DataFrame, ord_col: str | None = None) -> DataFrame:
    """C5/V5 before encoding: 14 columns by position (P2) -> clean 9 text
    columns (F1) -> key to text (F6) -> drop nameless (P7) -> first row per
    key in file order (T2) -> document (F9) -> keep > 20 chars (P8) ->
    id ``easy_<key>`` (F10) + metadata (N9)."""
    body = [c for c in raw.columns if c != ord_col]
    if len(body) != len(FV.LEAFLET_COLUMNS):
        raise ValueError(f"expected {len(FV.LEAFLET_COLUMNS)} columns, found {len(body)}")
    ordc = F.col(f"`{ord_col}`") if ord_col else IO.file_order(raw)
    df = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(body, FV.LEAFLET_COLUMNS)], ordc.alias("_ord"))
    key = FV.LEAFLET_COLUMNS[0]
    df = df.select(*[T.clean_text(c).alias(c) if c in FV.LEAFLET_CLEAN_COLS else F.col(c)
                     for c in FV.LEAFLET_COLUMNS], "_ord")
    df = df.withColumn(key, T.to_text(key))
    df = S.drop_blank(df, "제품명")
    df = R.keep_first_by_ord(df, [key], "_ord")
    text = T.leaflet_document("제품명", [F.col(c) for c, _ in FV.LEAFLET_PARTS])
    df = df.withColumn("RAG_TEXT", text)
    df = S.longer_than(df, "RAG_TEXT", FV.LEAFLET_MIN_CHARS)
    return df.select(
        T.leaflet_id(key).alias("id"), F.col("RAG_TEXT").alias("document"),
        F.struct(F.col("제품명").alias("name"), F.col("업체명").alias("company"),
                 F.lit(None).cast("string").alias("shape"), F.lit(None).cast("string").alias("color1"),
                 F.lit(None).cast("string").alias("description"),
                 F.coalesce(F.col("낱알이미지").cast("string"), F.lit("")).alias("image_url"),
                 F.lit(FV.LEAFLET_SOURCE).alias("source")).alias("metadata"))


# ------------------------------------------------------------ C3/C4 tables ---
def safety_tables(sources: dict, ord_col: str | None = None) -> dict:
    """Table name -> raw DataFrame, refreshed per the fixed table list.

    Returns table name -> cleaned DataFrame (write each with overwrite)."""
    out = {}
    for name, (key, cols, strict) in FV.SAFETY_TABLES.items():
        if name in sources:
            out[name] = IO.refresh_table(sources[name], key, cols, strict=strict, ord_col=ord_col)
    pname, pkey, pcols = FV.PILL_TABLE
    if pname in sources:
        out[pname] = IO.refresh_table(sources[pname], pkey, pcols, name_col=FV.PILL_NAME_COL, ord_col=ord_col)
    return out


# ------------------------------------------------------ C6 message context ---
def message_context(msgs: DataFrame, medicines: DataFrame, keys: list, text_col: str = "text",
                    gate_terms: list = FV.DRUG_KEYWORDS, collections: tuple | None = None,
                    encoder=None, k: int = FV.VECTOR_TOP_K, unit: bool = True) -> DataFrame:
    """C6 for a table of messages: gate (P13) -> vector search over two
    collections when they are given (V6, search layout) -> else, or when the
    search finds nothing, first-token catalogue lookup (Q8, table layout).

    ``medicines`` carries ``name_fold``; ``collections`` is a pair of
    ``(id, document, embedding, metadata)`` tables.  Returns ``keys`` +
    ``gated``, ``context_source`` in {vector, token, none} and ``context``.
    """
    m = msgs.select(*keys, text_col).withColumn("gated", T.contains_any(text_col, gate_terms))
    gated = m.where("gated")
    parts = []
    remaining = gated
    if collections is not None:
        q = R.sequential_ids(gated.select(*keys, text_col), [F.col(c) for c in keys], id_col="qid")
        qv = V.hash_vectors(q, text_col, out="qvec", unit=unit) if encoder is None else \
            q.withColumn("qvec", encoder(F.col(text_col)))
        qv = qv.select("qid", "qvec").checkpoint(eager=True)      # read by both searches
        hits = []
        for number, coll in enumerate(collections):          # first collection's hits come first
            h = V.knn_topk(qv.select("qid", "qvec"), coll.select("id", "embedding"), k, doc_id="id")
            # merge: a stored collection is larger than Spark's estimate, and would be broadcast
            h = h.join(coll.select(F.col("id").alias("doc_id"), "metadata").hint("merge"), "doc_id") \
                 .withColumn("ord", F.struct(F.lit(number).alias("collection"), "rank"))
            hits.append(h)
        allh = hits[0].unionByName(hits[1])
        md = F.col("metadata")
        line = T.context_line_search(md["name"], md["company"], md["shape"], md["color1"], md["description"])
        vec = allh.groupBy("qid").agg(F.concat(F.lit(FV.CONTEXT_HEADER), N.ordered_concat(
            F.collect_list(F.struct(F.col("ord").alias("pos"), line.alias("value"))), sep="")).alias("context"))
        vec = vec.join(q.select("qid", *keys), "qid").drop("qid").withColumn("context_source", F.lit("vector")) \
            .checkpoint(eager=True)                 # read by the result and by the choice of what remains
        parts.append(vec)
        remaining = gated.join(vec.select(*keys), keys, "left_anti")
    tok = token_context(remaining, medicines, keys, text_col, FV.TOKEN_CONTEXT_HITS) \
        .select(*keys, "context").withColumn("context_source", F.lit("token"))
    parts.append(tok)
    ctx = parts[0]
    for p in parts[1:]:
        ctx = ctx.unionByName(p)
    out = m.join(ctx, keys, "left")
    return out.select(*keys, "gated", F.coalesce("context_source", F.lit("none")).alias("context_source"),
                      F.coalesce("context", F.lit("")).alias("context"))


def prompt_usage(messages: DataFrame, context: DataFrame, keys: list, time_order: list, text_col: str = "text",
                 n: int = FV.PROMPT_HISTORY, max_group_rows: int = R.MAX_GROUP_ROWS) -> DataFrame:
    """Size of each message's prompt and its usage flags.

    ``messages`` are all turns; ``context`` is the result of ``message_context``
    for those to be answered, with ``keys + time_order`` as its key.  The history
    is read after the message is saved, so the message is in it and once more
    the user turn.  Only lengths enter the frames and the join, no text; a
    conversation above ``max_group_rows`` turns takes halo frames.
    """
    size = F.coalesce(F.length(text_col), F.lit(0))
    hist = R.frames(messages.select(*keys, *time_order, size.alias("_own")), keys, time_order, n,
                    {"_n": lambda w: F.count(F.lit(1)).over(w), "_chars": lambda w: F.sum("_own").over(w)}, max_group_rows)
    ctx = context.select(*keys, *time_order, "context_source", F.length("context").alias("_ctx"))
    used = F.col("_ctx") > 0
    return ctx.join(hist, [*keys, *time_order]).select(
        *keys, *time_order, (F.col("_n") + 2).cast("int").alias("n_prompt"),
        (F.col("_ctx") + F.col("_chars") + F.col("_own")).cast("long").alias("prompt_chars"),
        used.alias("med_context_used"), (used & (F.col("context_source") == "vector")).alias("rag_used"))


#: tokens of a message that the first wave searches; each later wave takes WAVE_GROWTH times as many
FIRST_WAVE, WAVE_GROWTH = 32, 16


def first_token_waves(msgs: DataFrame, med: DataFrame, msg_keys: list, text_col: str, cols: list, k: int,
                      report: list | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Q8 by waves over token positions: ``(chosen, hits)`` with ``chosen`` one row
    ``(*msg_keys, pos, token)`` per message with a hit and ``hits`` the first ``k``
    catalogue rows of every searched token; None if no message has a token.

    A wave searches the tokens of its positions that no earlier wave has
    searched; messages with a hit leave (anti join), so their later tokens are
    never looked up.  Waves grow geometrically, so their number is the logarithm
    of the longest message.  ``report``, if given, gets one
    dict a wave: messages, tokens (rows), searched (distinct new tokens), matched.
    """
    tokens = T.long_tokens(text_col)
    todo = msgs.select(*msg_keys, tokens.alias("_tokens")).where(F.size("_tokens") > 0) \
        .withColumn("_m", F.monotonically_increasing_id()).checkpoint(eager=True)
    searched, hits, chosen, at, width = None, None, None, 0, FIRST_WAVE
    while not todo.isEmpty():
        wave = todo.select("_m", *msg_keys, F.posexplode(F.slice("_tokens", at + 1, width)).alias("pos", "token")) \
            .withColumn("pos", F.col("pos") + at)
        new = wave.select("token").distinct()
        if searched is not None:
            new = new.join(searched, "token", "left_anti")
        new = new.checkpoint(eager=True)
        found = L.first_matches(new, med, "token", cols, ["item_name", "item_seq"], k) \
            .withColumnRenamed("term", "token").checkpoint(eager=True)     # at most k rows a token
        searched = new if searched is None else searched.unionByName(new)
        hits = found if hits is None else hits.unionByName(found)
        first = wave.join(hits.select("token").distinct(), "token", "left_semi").groupBy("_m") \
            .agg(F.min_by(F.struct(*msg_keys, "pos", "token"), "pos").alias("_c")).checkpoint(eager=True)
        if report is not None:
            report.append({"messages": todo.count(), "tokens": wave.count(), "searched": new.count(), "matched": first.count()})
        own = first.select("_c.*")
        chosen = own if chosen is None else chosen.unionByName(own)
        at, width = at + width, width * WAVE_GROWTH
        todo = todo.where(F.size("_tokens") > at).join(first, "_m", "left_anti").checkpoint(eager=True)
    return None if chosen is None else (chosen, hits)


def token_context(msgs: DataFrame, med: DataFrame, msg_keys: list, text_col: str,
                  k: int = FV.TOKEN_CONTEXT_HITS, report: list | None = None) -> DataFrame:
    """Q8 + F15: per message, the first token (in order, length >= 2) with any
    catalogue hit; its first ``k`` hits formatted as the context block.
    Messages without a hit are absent (callers left-join)."""
    cat_cols = ["item_seq", "item_name", "entp_name", "chartn", "drug_shape", "color_class1",
                "color_class2", "etc_otc_code"]
    made = first_token_waves(msgs, med, msg_keys, text_col, cat_cols, k, report)
    if made is None:
        return msgs.where(F.lit(False)).select(*msg_keys, F.lit("").alias("matched_token"), F.lit(0).cast("long").alias("n_hits"),
                                               F.lit("").alias("context"))
    chosen, hits = made
    line = T.context_line_table("item_name", "entp_name", "drug_shape", "color_class1",
                                "etc_otc_code", "chartn")
    return chosen.join(hits, "token").groupBy(*msg_keys).agg(
        F.min("token").alias("matched_token"), F.count(F.lit(1)).alias("n_hits"),
        F.concat(F.lit(FV.CONTEXT_HEADER),
                 N.ordered_concat(F.collect_list(F.struct(F.col("rank").alias("pos"), line.alias("value"))),
                                  sep="")).alias("context"))


# ------------------------------------------------------------ S14, C8, C10, C11 ---
def save_turns(turns: DataFrame, path: str, batch: str, order: list) -> dict:
    """S14 as a batch job: chat turns ``(user_id, role, content, timestamp)`` appended
    under one batch name; a retry leaves equal rows and ids (``io.append_batch``)."""
    text = turns.withColumn("content", F.coalesce("content", F.lit("")))
    return IO.append_batch(text, path, batch, order)


def extraction_match(requests: DataFrame, medicines: DataFrame, keys: list, text_col: str = "text",
                     reply_col: str = "reply") -> DataFrame:
    """Model replies validated against the recognised text and matched with the catalogue.

    Per request: the reply's name list (N1-N3), names whose 4-character prefix
    occurs in the text or else all (T6), each with its first catalogue hit by that
    prefix (Q9).  One row per kept name: ``keys``, ``status``, ``validated``, ``pos``
    and the fields of ``prefix_match``; a request without names has no row.
    """
    parsed = N.with_name_list(requests.select(*keys, text_col, F.col(reply_col).alias("_reply")), F.col("_reply"),
                              keep=[*keys, text_col])
    checked = F.transform("names", lambda n: F.struct(n.alias("name"), T.contains_text(F.col(text_col), T.prefix(n)).alias("ok")))
    d = parsed.select(*keys, "status", checked.alias("c")).withColumn("validated", F.exists("c", lambda s: s["ok"]))
    # posexplode_outer + a null filter: no inferred size() > 0 filter pushed below a repartition of the texts
    ex = d.select(*keys, "status", "validated", F.posexplode_outer("c").alias("pos", "x")).where(F.col("x").isNotNull())
    ex = ex.select(*keys, "status", "validated", "pos", F.col("x.name").alias("original"), F.col("x.ok").alias("ok")) \
        .where(F.col("ok") | ~F.col("validated"))
    return prefix_match(ex.drop("ok").withColumn("short", T.prefix("original")), medicines)


#: catalogue columns that a match carries, and the order that "first" means
MATCH_COLS = ["item_seq", "item_name", "entp_name", "chartn", "drug_shape", "color_class1", "color_class2", "etc_otc_code"]
MATCH_ORDER = ["item_name", "item_seq"]


def prefix_match(names: DataFrame, med: DataFrame) -> DataFrame:
    """Q9: rows with ``original`` and ``short`` and their first catalogue hit by ``short``, or the
    name itself with empty fields and ``db_matched = false``."""
    hits = L.first_matches(names.select("short"), med, "short", MATCH_COLS, MATCH_ORDER, 1)
    out = names.join(hits.withColumnRenamed("term", "short").drop("rank", "name_fold"), "short", "left")
    m = F.col("item_seq").isNotNull()
    e = lambda c: F.when(m, F.col(c)).otherwise(F.lit(""))
    return out.select(*[c for c in names.columns if c not in ("short",)], "short",
                      m.alias("db_matched"),
                      F.when(m, F.col("item_name")).otherwise(F.col("original")).alias("name"),
                      e("entp_name").alias("company"), e("chartn").alias("description"),
                      e("drug_shape").alias("shape"), e("color_class1").alias("color1"),
                      e("color_class2").alias("color2"), e("etc_otc_code").alias("otc_type"))


def history_report(turns: DataFrame, users: DataFrame | None, key: str, time_order: list, role_col: str = "role",
                   content_col: str = "content", n: int = FV.REPORT_HISTORY) -> DataFrame:
    """Per user the latest ``n`` turns, oldest first, as one row
    ``(key, n_turns, turns array<struct<role, content>>)``.  With ``users``, exactly
    these (P14), those without a turn with an empty list.  At most ``n`` turns
    are collected per user, whatever the length of the history."""
    mine = turns if users is None else turns.join(users.select(key).distinct(), key, "left_semi")
    last = R.last_n_oldest_first(mine, [key], time_order, n)
    item = F.struct(F.col("pos"), F.col(role_col).alias("role"), F.col(content_col).alias("content"))
    rep = last.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_t")).select(
        key, F.size("_t").alias("n_turns"), F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns"))
    if users is None:
        return rep
    none = F.array().cast("array<struct<role:string,content:string>>")
    return users.select(key).distinct().join(rep, key, "left").select(
        key, F.coalesce("n_turns", F.lit(0)).alias("n_turns"), F.coalesce("turns", none).alias("turns"))


def speech_preparation(requests: DataFrame, text_col: str = "text") -> DataFrame:
    """C11: every request with ``rejected`` (P16: blank text) and ``speech``, its text
    stripped and without what speech cannot say (null if rejected)."""
    t = T.ustrip(F.coalesce(F.col(text_col), F.lit("")))
    return requests.withColumn("_t", t).withColumns({
        "rejected": F.col("_t") == "", "speech": F.when(F.col("_t") != "", T.speech_text("_t"))}).drop("_t")


# ------------------------------------------------- entry points (section 3) ---
def build_catalogue(spark, files: list, out_path: str, csv_export: str | None = None) -> DataFrame:
    """The catalogue build: S4 load -> C1 -> S6 write (Parquet; CSV optional).
    Returns the load report.  Every text source is parsed once, into a copy that
    goes when the catalogue is written (``io.find_sources`` lists a folder's files)."""
    landing = f"{out_path.rstrip('/')}.landing-{uuid.uuid4().hex}"
    try:
        sources, report = IO.load_sources(spark, files, landing=landing)
        IO.write_staged(catalogue_pipeline(sources, ord_col="ORD"), out_path)
    finally:
        IO.delete(spark, landing)
    if csv_export:
        IO.write_table(spark.read.parquet(out_path).orderBy("ITEM_NAME", "ITEM_SEQ"), csv_export, fmt="csv")
    return report


def load_serving_table(spark, catalogue_path: str, out_path: str) -> bool:
    """C2 with the build-once guard (S8): returns False when already loaded."""
    if IO.is_built(spark, out_path):
        return False
    IO.write_staged(with_name_fold(serving_table(spark.read.parquet(catalogue_path))), out_path)
    return True


#: the leaflet index among the tables that ``import_drug_data`` writes
LEAFLET_INDEX = "drug_info"


def import_drug_data(spark, inputs: dict, out_dir: str, encoder=None,
                     half_built_threshold: int | None = None) -> dict:
    """The leaflet/safety import: S13 inputs present -> S9 rebuild a half-built
    index -> C5 index (skipped when built, S8) -> C3/C4 tables (staged overwrite).

    ``inputs`` maps the names of the tables to be written (``drug_info`` and
    those of ``safety_tables``) to landed CSV/Parquet paths.  A table is half
    built if its completeness marker is missing; ``half_built_threshold`` is the
    original's row-count rule (``io.half_built``).  Returns table name -> rows
    written.
    """
    IO.require_inputs(spark, inputs)
    index_path = f"{out_dir}/{LEAFLET_INDEX}"
    written = {}
    if IO.half_built(spark, index_path, half_built_threshold) or not IO.is_built(spark, index_path):
        raw = _read_landed(spark, inputs[LEAFLET_INDEX])
        written[LEAFLET_INDEX] = IO.write_staged(document_index(leaflet_documents(raw), encoder), index_path)
    landed = {t: _read_landed(spark, p) for t, p in inputs.items() if t != LEAFLET_INDEX}
    for t, df in safety_tables(landed).items():
        written[t] = IO.write_staged(df, f"{out_dir}/{t}")
    return written


def _read_landed(spark, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return IO.read_csv_text(spark, path)
    return spark.read.parquet(path)
