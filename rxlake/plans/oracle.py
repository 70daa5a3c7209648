"""DuckDB oracle SQL for every catalogue query that SQL can express.

Same names, same columns, same values as ``rxlake.plans.catalog``.  Lists and
patterns are written out here and in ``rxlake.plans.sqltext``, not imported.
"""

from __future__ import annotations

from rxlake import fixed_values as FV
from rxlake.plans import sqltext as X

ORACLE: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


# ------------------------------------------------------- catalogue_pipeline ---
_text = FV.CATALOGUE_TEXT_COLS
_nums = FV.CATALOGUE_NUM_COLS

PART_SLICES = f"""
s23 AS (SELECT CAST(p_partkey AS VARCHAR) AS ITEM_SEQ, p_name AS ITEM_NAME, p_brand AS ENTP_NAME,
               p_type AS DRUG_SHAPE, split_part(p_name, ' ', 1) AS COLOR_CLASS1,
               CAST(p_size AS VARCHAR) AS PRINT_FRONT, CAST(p_retailprice AS VARCHAR) AS LENG_LONG,
               'size ' || CAST(p_size AS VARCHAR) AS CHARTN, 2023 AS SOURCE_YEAR, p_partkey AS _ord
        FROM part),
s24 AS (SELECT CAST(p_partkey AS VARCHAR) AS ITEM_SEQ, p_name || ' ' || lower(p_type) AS ITEM_NAME,
               p_brand AS ENTP_NAME, p_type AS DRUG_SHAPE, split_part(p_name, ' ', 1) AS COLOR_CLASS1,
               split_part(p_name, ' ', 2) AS COLOR_CLASS2,
               CASE WHEN p_size > 45 THEN 'abc' ELSE CAST(p_size AS VARCHAR) END AS LENG_SHORT,
               CASE WHEN p_type = 'PROMO' THEN 'nan' ELSE 'ETC' END AS ETC_OTC_CODE,
               2024 AS SOURCE_YEAR, p_partkey AS _ord
        FROM part WHERE p_size > 25),
s25 AS (SELECT CAST(p_partkey AS VARCHAR) AS ITEM_SEQ,
               CASE WHEN p_size < 10 THEN '' ELSE upper(p_name) END AS ITEM_NAME,
               p_brand || ' Co' AS ENTP_NAME, ' ' || CAST(p_size AS VARCHAR) || '.5 ' AS THICK,
               CASE WHEN p_size > 40 THEN 'NA' END AS PRINT_BACK, 2025 AS SOURCE_YEAR, p_partkey AS _ord
        FROM part WHERE p_type IN ('PROMO', 'ECONOMY')),
u AS (SELECT * FROM s23 UNION ALL BY NAME SELECT * FROM s24 UNION ALL BY NAME SELECT * FROM s25),
u2 AS (SELECT *, NULL::VARCHAR AS ITEM_ENG_NAME, NULL::VARCHAR AS CLASS_NO FROM u)"""

register("catalogue_pipeline", f"""
WITH {PART_SLICES},
c AS (SELECT ITEM_SEQ, {", ".join(f"{X.blank_nan(c)} AS {c}" for c in _text)},
             {", ".join(f"{X.to_number(c)} AS {c}" for c in _nums)}, SOURCE_YEAR, _ord FROM u2),
d AS (SELECT * FROM c WHERE ITEM_NAME <> ''
      QUALIFY row_number() OVER (PARTITION BY ITEM_SEQ ORDER BY SOURCE_YEAR DESC, _ord) = 1)
SELECT {", ".join(FV.KEEP_COLS)}, SOURCE_YEAR,
       {X.catalogue_document("ITEM_NAME", "ENTP_NAME", "DRUG_SHAPE", "COLOR_CLASS1", "COLOR_CLASS2",
                             "PRINT_FRONT", "PRINT_BACK", "ETC_OTC_CODE", "CHARTN")} AS RAG_TEXT
FROM d""")


register("catalogue_sample", f"""
WITH {PART_SLICES},
c AS (SELECT ITEM_SEQ, {", ".join(f"{X.blank_nan(c)} AS {c}" for c in _text)}, SOURCE_YEAR, _ord FROM u2),
d AS (SELECT * FROM c WHERE ITEM_NAME <> ''
      QUALIFY row_number() OVER (PARTITION BY ITEM_SEQ ORDER BY SOURCE_YEAR DESC, _ord) = 1)
SELECT ITEM_SEQ, ITEM_NAME,
       {X.catalogue_document("ITEM_NAME", "ENTP_NAME", "DRUG_SHAPE", "COLOR_CLASS1", "COLOR_CLASS2",
                             "PRINT_FRONT", "PRINT_BACK", "ETC_OTC_CODE", "CHARTN")} AS RAG_TEXT
FROM d ORDER BY ITEM_NAME, ITEM_SEQ LIMIT 3""")


# ------------------------------------------------------ union_by_name_years ---
ORDER_YEARS = range(1995, 2002)
ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"]
ORDER_KEEP = ["O_ORDERKEY", "O_CUSTKEY", "O_ORDERSTATUS", "O_TOTALPRICE", "O_ORDERPRIORITY", "O_ORDERDATE", "O_CLERK"]


def _order_slices() -> str:
    sels = []
    for i, y in enumerate(ORDER_YEARS):
        dropped = ORDER_COLS[1 + i % (len(ORDER_COLS) - 1)]
        cols = []
        for c in ORDER_COLS:
            if c == dropped:
                continue
            v = f"strftime({c}, '%Y-%m-%d')" if c == "o_orderdate" else f"CAST({c} AS VARCHAR)"
            cols.append(f"{v} AS {c.upper()}")
        sels.append(f"SELECT {', '.join(cols)}, {y} AS SOURCE_YEAR FROM orders "
                    f"WHERE o_orderdate >= TIMESTAMP '{y}-01-01' AND o_orderdate < TIMESTAMP '{y + 1}-01-01'")
    every = ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c.upper()}" if c == "o_orderdate" else f"CAST({c} AS VARCHAR) AS {c.upper()}"
                      for c in ORDER_COLS)
    sels.append(f"SELECT {every}, 0 AS SOURCE_YEAR FROM orders WHERE o_orderdate IS NULL "
                "OR o_orderdate < TIMESTAMP '1995-01-01' OR o_orderdate >= TIMESTAMP '2002-01-01'")
    return "\nUNION ALL BY NAME\n".join(sels)


def _union_by_name_years() -> str:
    return f"""
WITH u AS ({_order_slices()}),
u2 AS (SELECT *, NULL::VARCHAR AS O_CLERK FROM u)
SELECT {", ".join(f"{X.blank_nan(c)} AS {c}" for c in ORDER_KEEP)}, SOURCE_YEAR FROM u2"""


register("union_by_name_years", _union_by_name_years())

register("keep_cols_rename", """
SELECT s_suppkey AS supp_id, s_name AS supp_name, s_nationkey AS nation_key, s_acctbal AS acctbal,
       '' AS phone, '' AS comment, '' AS item_image, '' AS edi_code
FROM supplier""")

_a = X.blank_nan("CASE WHEN lang <> 'en' THEN lang END")
_b = X.blank_nan("source")
register("first_nonempty", f"""
SELECT doc_id, CASE WHEN {_a} <> '' THEN {_a} ELSE coalesce({_b}, '') END AS lang_or_source
FROM documents""")

register("safety_refresh", f"""
WITH raw AS (
  SELECT page_id AS ord, {X.ustrip("coalesce(CAST(page_id AS VARCHAR), '')")} AS ID,
         {X.clean_text("split_part(url, '/', 3)")} AS HOST, {X.clean_text('url')} AS SITE,
         {X.clean_text('html')} AS NAME
  FROM pages),
kept AS (SELECT * FROM raw WHERE NAME <> '' AND HOST <> ''
         QUALIFY row_number() OVER (PARTITION BY HOST ORDER BY ord) = 1)
SELECT HOST AS host, ID AS page, NAME AS text, coalesce({X.nonempty('NAME')}, coalesce(SITE, '')) AS text_or_url
FROM kept""")

register("text_normalize", f"SELECT page_id, {X.clean_text('html')} AS text FROM pages")

register("numeric_coerce", f"""
WITH raw AS (
  SELECT 'events_k' AS source, event_id AS id, json_extract_string(props, '$.k') AS raw FROM events
  UNION ALL SELECT 'part_name', p_partkey, p_name FROM part
  UNION ALL SELECT 'part_size', p_partkey, ' ' || CAST(p_size AS VARCHAR) || ' ' FROM part
  UNION ALL SELECT 'part_size_d', p_partkey, CAST(p_size AS VARCHAR) || '.0d' FROM part)
SELECT source, id, raw, {X.to_number('raw')} AS value FROM raw""")

register("blank_key_filter", f"""
WITH d AS (SELECT doc_id, {X.blank_nan('lang')} AS lang, text FROM documents)
SELECT doc_id, lang, length(text) AS text_len FROM d
WHERE lang <> '' AND {X.ustrip("coalesce(text, '')")} <> '' AND length(text) > {FV.LEAFLET_MIN_CHARS}""")

register("dedup_newest", """
SELECT user_id, event_id, event_type, value, epoch_us(ts) AS ts_us FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""")

register("dedup_first_seen", """
WITH d AS (SELECT *, md5(text) AS text_md5 FROM documents)
SELECT doc_id, text_md5, count(*) OVER (PARTITION BY text_md5) AS copies, lang, source, n_chars FROM d
QUALIFY row_number() OVER (PARTITION BY text_md5 ORDER BY doc_id) = 1""")

_size = "CAST(p_size AS VARCHAR)"
_otc = "CASE WHEN p_size > 25 THEN 'ETC' ELSE '' END"
_w1, _w2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_leaf = X.leaflet_document("p_name", ["p_type", "p_brand", "''", _w1, "''", _w2, _otc])
register("document_build", f"""
SELECT '{FV.LEAFLET_ID_PREFIX}' || CAST(p_partkey AS VARCHAR) AS doc_id,
       {X.catalogue_document("p_name", "p_brand", "p_type", _w1, _w2, _size, "''", _otc, "'size ' || " + _size)} AS catalogue_text,
       {_leaf} AS leaflet_text, length({_leaf}) > {FV.LEAFLET_MIN_CHARS} AS leaflet_kept
FROM part""")

register("upsert_last_wins", """
WITH old AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, 0 AS batch, c_custkey AS ord FROM customer),
v1 AS (SELECT c_custkey, lower(c_name) AS c_name, c_nationkey, c_acctbal + 100 AS c_acctbal, c_mktsegment,
              1 AS batch, c_custkey * 2 AS ord FROM customer WHERE c_mktsegment = 'AUTOMOBILE'),
v2 AS (SELECT c_custkey, upper(c_name) AS c_name, c_nationkey, c_acctbal + 200 AS c_acctbal, c_mktsegment,
              1 AS batch, c_custkey * 2 + 1 AS ord FROM customer WHERE c_mktsegment = 'AUTOMOBILE' AND c_nationkey < 5),
fresh AS (SELECT c_custkey + 1000000000 AS c_custkey, c_name, c_nationkey, c_acctbal, 'NEW' AS c_mktsegment,
                 1 AS batch, c_custkey AS ord FROM customer WHERE c_mktsegment = 'MACHINERY'),
a AS (SELECT * FROM old UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM fresh)
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, batch FROM a
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY batch DESC, ord DESC) = 1""")


TABLE_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"],
    "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}


def _table_refresh_report() -> str:
    sels = []
    for name, keys in TABLE_KEYS.items():
        nn = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        sels.append(f"SELECT '{name}' AS table_name, (SELECT count(*) FROM {name}) AS rows_in, "
                    f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(keys)} FROM {name} WHERE {nn})) AS rows_out")
    body = "\nUNION ALL\n".join(sels)
    return (f"SELECT table_name, rows_in, rows_out, rows_out = rows_in "
            f"AS complete FROM ({body})")


register("table_refresh_report", _table_refresh_report())


# ------------------------------------------------------------------ lookups ---
MED = f"""med AS (
  SELECT CAST(p_partkey AS VARCHAR) AS item_seq, p_name AS item_name, p_brand AS entp_name,
         'size ' || CAST(p_size AS VARCHAR) AS chartn, p_type AS drug_shape,
         split_part(p_name, ' ', 1) AS color_class1, split_part(p_name, ' ', 2) AS color_class2,
         CASE WHEN p_size > 25 THEN 'ETC' ELSE 'OTC' END AS etc_otc_code,
         'img/' || CAST(p_partkey AS VARCHAR) || '.png' AS image_url, {X.fold('p_name')} AS name_fold
  FROM part)"""
CAT = "item_seq, item_name, entp_name, chartn, drug_shape, color_class1, color_class2, etc_otc_code"
CAT_M = ", ".join(f"m.{c}" for c in CAT.split(", "))


def kw_cte(name: str, source: str, col: str, col_alias: str, where: str = "") -> str:
    """Distinct long tokens of ``source.col``."""
    w = f"WHERE {where}" if where else ""
    return (f"{name} AS (SELECT DISTINCT w AS {col_alias} FROM "
            f"(SELECT unnest({X.tokens(col)}) AS w FROM {source} {w}) WHERE length(w) >= {FV.MIN_TOKEN_LEN})")


def like_join(term: str, name_fold: str) -> str:
    return X.like_contains(name_fold, X.fold(term))


def kw_wild_cte(name: str, col: str) -> str:
    """All turns' long tokens and the wildcard terms made from names."""
    return (f"{kw_cte('kw0', 'conversations', 'text', 'k')}, {name} AS (SELECT DISTINCT k AS {col} FROM (SELECT k FROM kw0 "
            "UNION ALL SELECT substr(p_name, 1, 2) || '%' || right(p_name, 2) FROM part "
            "UNION ALL SELECT '_' || substr(p_name, 2, 3) || '_' FROM part))")


def _name_search() -> str:
    return f"""
WITH {MED}, {kw_wild_cte('kw', 'keyword')},
top AS (SELECT k.keyword AS term, {CAT_M},
               CAST(row_number() OVER (PARTITION BY k.keyword ORDER BY m.item_name, m.item_seq) AS INTEGER) AS rank
        FROM kw k JOIN med m ON {like_join('k.keyword', 'm.name_fold')}
        QUALIFY rank <= {FV.NAME_SEARCH_LIMIT}),
cnt AS (SELECT term, count(*) AS n_found FROM top GROUP BY term)
SELECT kw.keyword, coalesce(cnt.n_found, 0) > 0 AS found, coalesce(cnt.n_found, 0) AS n_found, coalesce(top.rank, 0) AS rank,
       {", ".join(f"top.{c}" for c in CAT.split(", "))}
FROM kw LEFT JOIN top ON kw.keyword = top.term LEFT JOIN cnt ON kw.keyword = cnt.term"""


register("name_search_top5", _name_search())
register("name_search_indexed", _name_search())

_has_s = "coalesce(r.shape <> '', false)"
_has_c = "coalesce(r.color <> '', false)"
register("identify_by_attributes", f"""
WITH {MED},
req0 AS (SELECT DISTINCT shape, color FROM (
   SELECT lower(p_type) AS shape, split_part(p_name, ' ', 1) AS color FROM part
   UNION ALL SELECT lower(p_type), NULL FROM part
   UNION ALL SELECT '', split_part(p_name, ' ', 2) FROM part
   UNION ALL SELECT '', NULL FROM part
   UNION ALL SELECT NULL, '' FROM part
   UNION ALL SELECT 'no ' || lower(p_type), NULL FROM part)),
req AS (SELECT *, coalesce(shape, '∅') || '|' || coalesce(color, '∅') AS request_id FROM req0),
top AS (SELECT r.request_id, {CAT_M},
               CAST(row_number() OVER (PARTITION BY r.request_id ORDER BY m.item_name, m.item_seq) AS INTEGER) AS rank
        FROM req r JOIN med m ON ({_has_s} OR {_has_c})
          AND (NOT {_has_s} OR {X.like_contains(X.fold('m.drug_shape'), X.fold('r.shape'))})
          AND (NOT {_has_c} OR {X.like_contains(X.fold('m.color_class1'), X.fold('r.color'))}
                            OR {X.like_contains(X.fold('m.color_class2'), X.fold('r.color'))})
        QUALIFY rank <= {FV.SHAPE_SEARCH_LIMIT}),
cnt AS (SELECT request_id, count(*) AS n_found FROM top GROUP BY request_id)
SELECT req.request_id, req.shape, req.color,
       NOT (coalesce(req.shape <> '', false) OR coalesce(req.color <> '', false)) AS rejected,
       coalesce(cnt.n_found, 0) > 0 AS found, coalesce(cnt.n_found, 0) AS n_found, coalesce(top.rank, 0) AS rank,
       {", ".join(f"top.{c}" for c in CAT.split(", "))}
FROM req LEFT JOIN top USING (request_id) LEFT JOIN cnt USING (request_id)""")

_WARN = {
    "elderly": "SELECT CAST(p_partkey AS VARCHAR) AS item_key, p_name AS item_name, 'caution ' || p_brand AS detail1, p_type AS detail2 FROM part",
    "duration": "SELECT CAST(s_suppkey AS VARCHAR) AS item_key, s_name AS item_name, CAST(s_nationkey + 1 AS VARCHAR) || '일' AS detail1, '' AS detail2 FROM supplier",
    "age_taboo": "SELECT CAST(c_custkey AS VARCHAR) AS item_key, c_name AS item_name, 'age ' || CAST(c_nationkey AS VARCHAR) AS detail1, c_mktsegment AS detail2 FROM customer",
}


def _warning_lookup() -> str:
    parts = []
    for wt, sel in _WARN.items():
        parts.append(f"""
SELECT t.term, '{wt}' AS warning_type, coalesce(c.n, 0) > 0 AS found, coalesce(c.n, 0) AS n_found,
       h.item_key, h.item_name, h.detail1, h.detail2
FROM terms t
LEFT JOIN (SELECT t.term, x.* FROM terms t JOIN ({sel}) x ON {like_join('t.term', X.fold('x.item_name'))}) h USING (term)
LEFT JOIN (SELECT t.term, count(*) AS n FROM terms t JOIN ({sel}) x ON {like_join('t.term', X.fold('x.item_name'))}
           GROUP BY t.term) c USING (term)""")
    return f"""
WITH terms AS (SELECT DISTINCT term FROM (
   SELECT split_part(p_name, ' ', 2) AS term FROM part
   UNION ALL SELECT split_part(s_name, '#', 2) FROM supplier
   UNION ALL SELECT split_part(c_name, '#', 2) FROM customer))
{" UNION ALL ".join(parts)}"""


register("warning_lookup", _warning_lookup())

register("first_match_or_null", f"""
WITH {MED}, {kw_cte('terms', 'benchmark', 'text', 'term')},
h AS (SELECT t.term, m.* FROM terms t JOIN med m ON {like_join('t.term', 'm.name_fold')}
      QUALIFY row_number() OVER (PARTITION BY t.term ORDER BY m.item_name, m.item_seq) = 1)
SELECT terms.term, h.item_seq IS NOT NULL AS found, h.item_name, h.drug_shape AS appearance,
       h.entp_name AS class_name, h.image_url
FROM terms LEFT JOIN h USING (term)""")

_LINE = X.context_line_table("item_name", "entp_name", "drug_shape", "color_class1", "etc_otc_code", "chartn")


def token_context_sql(msgs: str) -> str:
    """CTEs toks/ctx over a CTE ``msgs(conv_id, turn, text)``: Q8 + F15."""
    return f"""
toks0 AS (SELECT conv_id, turn, unnest({X.tokens('text')}) AS token,
                 generate_subscripts({X.tokens('text')}, 1) AS pos FROM {msgs}),
toks AS (SELECT * FROM toks0 WHERE length(token) >= {FV.MIN_TOKEN_LEN}),
th0 AS (SELECT DISTINCT token FROM toks),
nf AS (SELECT DISTINCT name_fold FROM med),
tn AS (SELECT t.token, nf.name_fold FROM th0 t JOIN nf ON {like_join('t.token', 'nf.name_fold')}),
hits AS (SELECT t.token, {CAT_M},
                row_number() OVER (PARTITION BY t.token ORDER BY m.item_name, m.item_seq) AS rank
         FROM tn t JOIN med m USING (name_fold)
         QUALIFY rank <= {FV.TOKEN_CONTEXT_HITS}),
th AS (SELECT toks.conv_id, toks.turn, toks.pos, hits.* FROM toks JOIN hits USING (token)),
chosen AS (SELECT * FROM th QUALIFY pos = min(pos) OVER (PARTITION BY conv_id, turn)),
ctx AS (SELECT conv_id, turn, any_value(token) AS matched_token, count(*) AS n_hits,
               {X.q(FV.CONTEXT_HEADER)} || string_agg({_LINE}, '' ORDER BY rank) AS context
        FROM chosen GROUP BY conv_id, turn)"""


register("first_token_match", f"""
WITH {MED}, msgs AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
{token_context_sql('msgs')}
SELECT msgs.conv_id, msgs.turn, ctx.matched_token, coalesce(ctx.n_hits, 0) AS n_hits,
       coalesce(ctx.context, '') AS context
FROM msgs LEFT JOIN ctx USING (conv_id, turn)""")


def _gate_terms():
    return ["the", "que", "und", "les"]


register("keyword_gate", f"""
SELECT conv_id, turn, coalesce({X.contains_any('text', _gate_terms())}, false) AS gated FROM conversations""")

_CAPS = X.capitalised_tokens("text")
_NAMES_CTE = f"""
caps AS (SELECT doc_id, text, {_CAPS} AS c0 FROM documents),
dist AS (SELECT doc_id, text, list_filter(c0, lambda x, i: list_position(c0, x) = i) AS c1 FROM caps),
nm AS (SELECT doc_id, text,
              list_transform(c1, lambda w: CASE WHEN length(w) % 2 = 0 THEN w ELSE 'Zq' || w END) AS names FROM dist)"""


def validate_sql(src: str, extra: str = "") -> str:
    """rows (doc_id, pos, name, ok, validated) kept by T6, from CTE ``src(doc_id, text, names)``."""
    return f"""
ex AS (SELECT doc_id, text{extra}, unnest(names) AS name,
              CAST(generate_subscripts(names, 1) - 1 AS INTEGER) AS pos FROM {src}),
chk AS (SELECT *, contains(text, substr(name, 1, {FV.PREFIX_LEN})) AS ok FROM ex),
val AS (SELECT *, bool_or(ok) OVER (PARTITION BY doc_id) AS validated FROM chk
        QUALIFY ok OR NOT validated)"""


register("validate_extractions", f"""
WITH {_NAMES_CTE}, {validate_sql('nm')}
SELECT doc_id, pos, name, ok, validated FROM val""")


def prefix_match_sql(src: str, cols: str) -> str:
    """SELECT over CTE ``src`` with ``original`` and ``short``: Q9 output."""
    return f"""
pm AS (SELECT DISTINCT short FROM {src}),
ph AS (SELECT p.short, {CAT_M} FROM pm p JOIN med m ON {like_join('p.short', 'm.name_fold')}
       QUALIFY row_number() OVER (PARTITION BY p.short ORDER BY m.item_name, m.item_seq) = 1)
SELECT {cols}, s.short, ph.item_seq IS NOT NULL AS db_matched,
       CASE WHEN ph.item_seq IS NOT NULL THEN ph.item_name ELSE s.original END AS name,
       coalesce(ph.entp_name, '') AS company, coalesce(ph.chartn, '') AS description,
       coalesce(ph.drug_shape, '') AS shape, coalesce(ph.color_class1, '') AS color1,
       coalesce(ph.color_class2, '') AS color2, coalesce(ph.etc_otc_code, '') AS otc_type
FROM {src} s LEFT JOIN ph USING (short)"""


register("fuzzy_prefix_match", f"""
WITH {MED}, {kw_wild_cte('kw', 'original')},
names AS (SELECT original, substr(original, 1, {FV.PREFIX_LEN}) AS short FROM kw),
{prefix_match_sql('names', 's.original')}""")

_REPLY = """CASE
  WHEN event_type = 'purchase' AND value > 50 THEN '{"medicines": ["a"]} and {"x": ' || CAST(user_id AS VARCHAR) || '}'
  WHEN event_type = 'purchase' AND value < 2 THEN '{"medicines": [1, "b"]}'
  WHEN event_type = 'purchase' AND value < 4 THEN '{"medicines": ["a"]}] trailing {x}'
  WHEN event_type = 'purchase' AND value < 6 THEN '{"medicines": ["a"]}], [{"b":1}'
  WHEN event_type = 'purchase' AND value < 8 THEN '{"medicines": ["a"]}, "w": {"b":1}'
  WHEN event_type = 'purchase' THEN 'Result: {"medicines": ["' || event_type || '", "u' || CAST(user_id AS VARCHAR) || '"]} done'
  WHEN event_type = 'signup' THEN '{"other": ' || props || '}'
  WHEN event_type = 'view' THEN 'no json here (' || CAST(user_id AS VARCHAR) || ')'
  WHEN event_type = 'error' THEN '{"medicines": ["a", }'
  ELSE '{''medicines'': [''' || event_type || ''']}' END"""


register("json_extract_list", f"""
WITH r AS (SELECT event_id, regexp_extract({_REPLY}, '\\{{.*\\}}', 0, 's') AS cut FROM events),
p AS (SELECT event_id, cut, CASE WHEN cut = '' THEN false ELSE json_valid(cut) END AS valid FROM r),
s AS (SELECT event_id, cut,
        CASE WHEN cut = '' THEN 'no_json'
             WHEN NOT valid THEN 'error'
             WHEN json_type(cut, '$.medicines') IS NULL THEN 'ok'
             WHEN json_type(cut, '$.medicines') = 'ARRAY'
                  AND len(list_filter(json_extract(cut, '$.medicines[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0 THEN 'ok'
             ELSE 'error' END AS status FROM p),
n AS (SELECT event_id, status,
        CASE WHEN status = 'ok' AND json_type(cut, '$.medicines') = 'ARRAY'
             THEN json_extract_string(cut, '$.medicines[*]') ELSE [] END AS names FROM s)
SELECT event_id, status, CAST(-1 AS INTEGER) AS pos, CAST(NULL AS VARCHAR) AS name FROM n WHERE len(names) = 0
UNION ALL
SELECT event_id, status, CAST(generate_subscripts(names, 1) - 1 AS INTEGER) AS pos, unnest(names) AS name
FROM n WHERE len(names) > 0""")

register("ocr_response_text", """
WITH r AS (SELECT doc_id, json_object('IsErroredOnProcessing', lang = 'de', 'ParsedResults',
                  CASE WHEN source = 'src3' THEN json_array() ELSE json_array(json_object('ParsedText', text)) END) AS resp
           FROM documents),
t AS (SELECT doc_id, CASE WHEN coalesce(CAST(json_extract(resp, '$.IsErroredOnProcessing') AS BOOLEAN), false) THEN ''
                          ELSE coalesce(json_extract_string(resp, '$.ParsedResults[0].ParsedText'), '') END AS txt FROM r)
SELECT doc_id, length(txt) AS text_len, md5(txt) AS text_md5 FROM t""")

register("extraction_match", f"""
WITH {MED},
nm AS (SELECT d.doc_id, d.text, 'ok' AS status,
              list_filter([p.p_name, 'Zq' || d.lang], lambda x: x IS NOT NULL) AS names
       FROM documents d LEFT JOIN part p ON d.doc_id = p.p_partkey),
{validate_sql('nm', ', status')},
kept AS (SELECT doc_id, status, validated, pos, name AS original, substr(name, 1, {FV.PREFIX_LEN}) AS short FROM val),
{prefix_match_sql('kept', 's.doc_id, s.status, s.validated, s.pos, s.original')}""")

register("recent_history", f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations
           QUALIFY rn <= {FV.PROMPT_HISTORY})
SELECT conv_id, CAST(count(*) OVER (PARTITION BY conv_id) - rn + 1 AS INTEGER) AS pos, turn, role, text AS content
FROM t""")

register("history_report", f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations
           QUALIFY rn <= {FV.REPORT_HISTORY})
SELECT conv_id, count(*) AS n_turns, string_agg(role, ',' ORDER BY turn) AS roles,
       md5(string_agg(text, '␞' ORDER BY turn)) AS content_md5,
       CAST(sum(length(text)) AS BIGINT) AS chars
FROM t GROUP BY conv_id""")

_HIST = (f"list({{'role': role, 'content': text}}) OVER (PARTITION BY conv_id ORDER BY turn "
         f"ROWS BETWEEN {FV.PROMPT_HISTORY - 1} PRECEDING AND CURRENT ROW)")
register("rolling_context", f"""
WITH h AS (SELECT conv_id, turn, {_HIST} AS history FROM conversations)
SELECT conv_id, turn, CAST(len(history) AS INTEGER) AS n_history,
       array_to_string(list_transform(history, lambda m: m.role), ',') AS roles,
       CAST(list_sum(list_transform(history, lambda m: length(m.content))) AS BIGINT) AS history_chars,
       CAST(len(history) + 2 AS INTEGER) AS n_prompt
FROM h""")

_HEX = "'0123456789abcdef'"


def hash_counts_sql(src: str, key: str, text: str) -> str:
    """SELECT (key, i, v): feature-hashing counts of the tokens of ``text``."""
    d = lambda n: f"(strpos({_HEX}, substr(md5(t), {n}, 1)) - 1)"
    return (f"SELECT {key}, ({d(1)} * 16 + {d(2)}) % 64 AS i, sum(CASE WHEN {d(3)} >= 8 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v "
            f"FROM (SELECT {key}, unnest(string_split({X.collapse_ws(text)}, ' ')) AS t FROM {src}) WHERE t <> '' GROUP BY ALL")


def _hits_sql(name: str, coll: str) -> str:
    """Top 3 of a collection per gated user message: squared distances of sparse whole-number vectors."""
    return f"""
{name}_v AS ({hash_counts_sql(coll, 'id', 'document')}),
{name}_n AS (SELECT c.id, coalesce(sum(v * v), 0) AS n FROM {coll} c LEFT JOIN {name}_v USING (id) GROUP BY c.id),
{name}_dot AS (SELECT q.conv_id, q.turn, d.id, sum(q.v * d.v) AS dot FROM q_v q JOIN {name}_v d USING (i) GROUP BY ALL),
{name} AS (SELECT q.conv_id, q.turn, n.id, row_number() OVER (PARTITION BY q.conv_id, q.turn
              ORDER BY q.n + n.n - 2 * coalesce(dot, 0), n.id) AS rank
           FROM q_n q, {name}_n n LEFT JOIN {name}_dot d ON d.conv_id = q.conv_id AND d.turn = q.turn AND d.id = n.id
           QUALIFY rank <= {FV.VECTOR_TOP_K})"""


def _search_line(name, company, shape, c1, desc) -> str:
    e = lambda x: f"coalesce({x}, '')"
    return (f"('- ' || {e(name)} || ' (' || {e(company)} || ') | ' || {e(shape)} || ' | ' || "
            f"{e(c1)} || {X.q(chr(10) + FV.CONTEXT_DESC_LABEL)} || {e(desc)} || {X.q(chr(10))})")


_CHAT_CTX = f"""
m0 AS (SELECT conv_id, turn, role, text, coalesce({X.contains_any('text', _gate_terms())}, false) AS gated FROM conversations),
msgs AS (SELECT * FROM m0 WHERE gated AND coalesce(role <> 'user', false)),
{token_context_sql('msgs')},
asked AS (SELECT conv_id, turn, text FROM m0 WHERE gated AND role = 'user'),
q_v AS ({hash_counts_sql('asked', 'conv_id, turn', 'text')}),
q_n AS (SELECT a.conv_id, a.turn, coalesce(sum(v * v), 0) AS n FROM asked a LEFT JOIN q_v USING (conv_id, turn) GROUP BY ALL),
c1 AS (SELECT item_seq AS id, item_name || ' ' || drug_shape AS document FROM med),
c2 AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, translate(s_name, '#0', '  ') AS document FROM supplier),
{_hits_sql('h1', 'c1')}, {_hits_sql('h2', 'c2')},
lines AS (SELECT conv_id, turn, 0 AS c, rank, {_search_line('item_name', 'entp_name', 'drug_shape', 'color_class1', 'chartn')} AS line
          FROM h1 JOIN med ON id = item_seq
          UNION ALL SELECT conv_id, turn, 1, rank, {_search_line('s_name', 'NULL', 'NULL', 'NULL', 'NULL')}
          FROM h2 JOIN supplier ON id = CAST(s_suppkey AS VARCHAR)),
vec AS (SELECT conv_id, turn, {X.q(FV.CONTEXT_HEADER)} || string_agg(line, '' ORDER BY c, rank) AS context FROM lines GROUP BY ALL),
chat AS (SELECT m.conv_id, m.turn, m.text, m.gated,
                CASE WHEN vec.context IS NOT NULL THEN 'vector' WHEN ctx.context IS NOT NULL THEN 'token' ELSE 'none' END AS context_source,
                coalesce(vec.context, ctx.context, '') AS context
         FROM m0 m LEFT JOIN ctx USING (conv_id, turn) LEFT JOIN vec USING (conv_id, turn))"""

register("message_context", f"""
WITH {MED}, {_CHAT_CTX}
SELECT conv_id, turn, gated, context_source, context FROM chat""")

register("prompt_usage_flags", f"""
WITH {MED}, {_CHAT_CTX},
h AS (SELECT conv_id, turn, {_HIST} AS history FROM conversations)
SELECT c.conv_id, c.turn, CAST(len(h.history) + 2 AS INTEGER) AS n_prompt,
       CAST(length(c.context) + list_sum(list_transform(h.history, lambda m: length(m.content))) + length(c.text) AS BIGINT)
         AS prompt_chars,
       c.context <> '' AS med_context_used, c.context <> '' AND c.context_source = 'vector' AS rag_used
FROM chat c JOIN h USING (conv_id, turn)""")

def leaflet_ctes(key: str) -> str:
    return f"""
raw AS (SELECT doc_id AS ord, {X.ustrip(f"CAST({key} AS VARCHAR)")} AS k, {X.clean_text("concat_ws(' ', source, lang)")} AS name,
               {X.clean_text('text')} AS effect FROM documents),
one AS (SELECT * FROM raw WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord) = 1),
docs AS (SELECT 'easy_' || k AS id, name, {X.leaflet_document('name', ['effect', "''", "''", "''", "''", "''", "''"])} AS document
         FROM one),
kept AS (SELECT * FROM docs WHERE length(document) > 20)"""


register("leaflet_first_per_key", f"""
WITH {leaflet_ctes('n_chars')}
SELECT id, length(document) AS doc_chars, md5(document) AS document_md5, name FROM kept""")


def whole_vectors(src: str) -> str:
    """Vectors of whole numbers as text, from the rows (id, document) of ``src``."""
    return f"""
v AS ({hash_counts_sql(src, 'id', 'document')}),
txt AS (SELECT k.id, string_agg(CAST(CAST(coalesce(v.v, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY g.i) AS vector
        FROM {src} k CROSS JOIN (SELECT unnest(range(64)) AS i) g LEFT JOIN v ON v.id = k.id AND v.i = g.i GROUP BY k.id)"""


register("encode_documents", f"""
WITH {leaflet_ctes('doc_id')}, {whole_vectors('kept')}
SELECT id, length(document) AS doc_chars, vector FROM kept JOIN txt USING (id)""")

register("incremental_index", f"""
WITH kept AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS document, source AS name FROM documents
              WHERE {X.ustrip("coalesce(text, '')")} <> ''), {whole_vectors('kept')}
SELECT id, length(document) AS doc_chars, vector, name FROM kept JOIN txt USING (id)""")

register("append_batches", """
SELECT row_number() OVER (ORDER BY ((conv_id % 3) + 3) % 3, conv_id, turn) AS id,
       'batch-' || CAST(((conv_id % 3) + 3) % 3 AS VARCHAR) AS batch, conv_id, turn, CAST(conv_id AS VARCHAR) AS user_id, role,
       md5(coalesce(text, '')) AS content_md5
FROM conversations""")

register("vector_topk_indexed", """
WITH e AS (SELECT vec_id, label * 10 + vec_id % 10 AS q, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT q, i, avg(CAST(x AS DOUBLE)) AS cx FROM e GROUP BY q, i),
d AS (SELECT CAST(c.q AS BIGINT) AS qid, e.vec_id, sum((CAST(e.x AS DOUBLE) - c.cx) * (CAST(e.x AS DOUBLE) - c.cx)) AS dist
      FROM e JOIN c ON e.i = c.i GROUP BY c.q, e.vec_id)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS INTEGER) AS rank, vec_id, round(dist, 6) AS dist
FROM d QUALIFY rank <= 3""")

register("embed_every_document", f"""
WITH raw AS (SELECT doc_id AS ord, {X.ustrip("CAST(doc_id AS VARCHAR)")} AS k, {X.clean_text("concat_ws(' ', source, lang)")} AS name,
                    {X.clean_text('text')} AS effect FROM documents),
one AS (SELECT * FROM raw WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord) = 1),
docs AS (SELECT '{FV.LEAFLET_ID_PREFIX}' || k AS id, name, {X.leaflet_document('name', ['effect', "''", "''", "''", "''", "''", "''"])} AS document
         FROM one),
kept AS (SELECT * FROM docs WHERE length(document) > {FV.LEAFLET_MIN_CHARS}),
v AS ({hash_counts_sql('kept', 'id', 'document')}),
n AS (SELECT id, sqrt(sum(v * v)) AS n FROM v GROUP BY id),
full_v AS (SELECT k.id, g.i, coalesce(v.v, 0) / CASE WHEN coalesce(n.n, 0) > 0 THEN n.n ELSE 1 END AS x
           FROM kept k CROSS JOIN (SELECT unnest(range(64)) AS i) g LEFT JOIN v ON v.id = k.id AND v.i = g.i LEFT JOIN n ON n.id = k.id),
txt AS (SELECT id, string_agg(CAST(CAST(round(x * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS vector FROM full_v GROUP BY id)
SELECT id, length(document) AS doc_chars, vector, name FROM kept JOIN txt USING (id)""")

register("alarm_state", """
WITH log AS (
  SELECT event_id AS alarm_id, ts, event_id, 'register' AS action, CAST(user_id AS VARCHAR) AS user_id,
         event_type AS medication_name, strftime(ts, '%H:%M') AS time_hhmm, strftime(ts, '%a') AS days_of_week
  FROM events WHERE event_type <> 'error'
  UNION ALL BY NAME
  SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS alarm_id, ts, event_id, 'disable' AS action
  FROM events WHERE event_type = 'error'),
last AS (SELECT alarm_id, action AS last_action FROM log WHERE alarm_id IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY alarm_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT r.alarm_id, r.user_id, r.medication_name, r.time_hhmm, r.days_of_week, l.last_action = 'register' AS is_enabled
FROM log r JOIN last l USING (alarm_id) WHERE r.action = 'register'""")

_FOLD = ORACLE["alarm_state"]
register("active_alarms", f"""
SELECT alarm_id, user_id, medication_name, time_hhmm, days_of_week FROM ({_FOLD})
WHERE is_enabled AND user_id IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'purchase')""")

register("append_with_ids", f"""
WITH n AS (SELECT ts, event_id, CAST(user_id AS VARCHAR) AS user_id,
                  'med-' || json_extract_string(props, '$.k') AS medication_name,
                  strftime(ts, '%H:%M') AS time_hhmm, 'daily' AS days_of_week
           FROM events WHERE event_type = 'signup')
SELECT CAST(coalesce((SELECT max(event_id) FROM events WHERE event_type <> 'signup'), 0)
            + row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS id,
       event_id, user_id, medication_name, time_hhmm, days_of_week, 1 AS is_enabled,
       medication_name || {X.q(FV.ALARM_MSG_MIDDLE)} || time_hhmm || {X.q(FV.ALARM_MSG_END)} AS message
FROM n""")

register("speech_text", f"""
WITH d AS (SELECT doc_id, {X.speech_text(X.ustrip('text'))} AS clean FROM documents
           WHERE {X.ustrip("coalesce(text, '')")} <> '')
SELECT doc_id, length(clean) AS clean_len, md5(clean) AS clean_md5 FROM d""")

_VEC = """
e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label AS q, i, avg(CAST(x AS DOUBLE)) AS cx FROM e GROUP BY label, i)"""


def _topk_sql(where: str) -> str:
    return f"""SELECT CAST(c.q AS BIGINT) AS label, e.vec_id,
       sum((CAST(e.x AS DOUBLE) - c.cx) * (CAST(e.x AS DOUBLE) - c.cx)) AS dist
FROM e JOIN c ON e.i = c.i WHERE {where} GROUP BY c.q, e.vec_id"""


register("vector_topk", f"""
WITH {_VEC}, d AS ({_topk_sql('true')})
SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS INTEGER) AS rank,
       vec_id, round(dist, 6) AS dist
FROM d QUALIFY rank <= {FV.VECTOR_TOP_K}""")

register("two_collection_search", f"""
WITH {_VEC},
a AS ({_topk_sql('e.label % 2 = 0')}), b AS ({_topk_sql('e.label % 2 = 1')}),
ra AS (SELECT label, 'medicines' AS source, 1 AS source_rank,
              CAST(row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS INTEGER) AS rank, vec_id,
              round(dist, 6) AS dist FROM a QUALIFY rank <= {FV.VECTOR_TOP_K}),
rb AS (SELECT label, 'drug_info' AS source, 2 AS source_rank,
              CAST(row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS INTEGER) AS rank, vec_id,
              round(dist, 6) AS dist FROM b QUALIFY rank <= {FV.VECTOR_TOP_K})
SELECT * FROM ra UNION ALL SELECT * FROM rb""")

# every document once: the later repeats that ``embed_every_document`` adds never win
register("embed_documents", ORACLE["embed_every_document"])
