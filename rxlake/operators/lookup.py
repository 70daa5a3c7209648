"""Substring lookups (Q1-Q10) as joins.

The original runs ``name LIKE '%term%'`` once per term.  Here a whole table
of terms is matched against the catalogue at once.  Matching follows a SQLite
``LIKE``: ASCII-only case folding, ``%`` and ``_`` inside a term stay
wildcards, no escape character (SURVEY D1).

Two exact strategies:

* ``broadcast``: the distinct terms, behind a row-count check, are broadcast
  and compared with every catalogue row (nested loop, O(N*M)); fine while one
  side is small.
* ``ngram``: an n-gram index of the catalogue names (n = 1..``NGRAM_MAX``,
  kept as a table).  Each term is routed to its *rarest* n-gram
  (n = min(``NGRAM_MAX``, len); a longer gram is never more frequent than
  the grams inside it, so the rarest gram is among the longest),
  equi-joined with the index and re-checked with the real predicate.  A true
  match contains every n-gram of the term, so no match is lost; the rarest
  gram keeps candidate lists short and a hot gram away from most terms.
  For first-k lookups a term that is itself a gram needs no list at all: a
  table holds the first k rows of every gram (``build_gram_topk``).
  Wildcard terms use the longest literal run between wildcards; terms made
  only of wildcards match by name length through an equi-join on length.

Matching runs over the *distinct* folded names (the predicate depends on the
name only), then expands to catalogue rows; for first-k lookups only each
name's own first k rows are expanded.  ``auto`` (``choose_strategy``) uses
bounded size checks: a few distinct names are broadcast whatever the number
of terms; otherwise the terms are broadcast when few and the nested loop
stays within a comparison budget; otherwise the n-gram index.  The streamed
side of a nested loop is repartitioned explicitly so AQE cannot coalesce a
small, CPU-heavy input into one task.  An empty term matches every named row,
as in the original; it never enters the join (``substring_matches``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxlake.functions import text as T
from rxlake.operators import rank as R
from rxlake.session import shuffle_partitions

BROADCAST_TERMS_LIMIT = 200_000    # rows we allow to broadcast (terms or names)
BROADCAST_CHARS_LIMIT = 32 << 20   # ... and characters in them
# nested-loop comparisons accepted per core: the loop's work divides over
# the cores, while the n-gram plan pays a few shuffles whatever the size, so
# the break-even grows with the cluster (about 25 M folded-text comparisons a
# core-second, against ~1-2 s of fixed n-gram cost)
PAIR_BUDGET_PER_CORE = 25_000_000
SMALL_SIDE_ROWS = 1_000            # names this few are broadcast without counting terms
MATERIALISE_HITS = True
# longest indexed gram: 3-grams of low-entropy names (digits, codes) leave
# hundreds of candidates per term, 5-grams few; the index holds about
# NGRAM_MAX rows per name character
NGRAM_MAX = 5
WILD = "[%_]"


def like_regex(term_fold: Column) -> Column:
    """Java regex for ``LIKE '%term%'`` (find semantics): every character that
    is not a letter or digit is escaped, then ``\\%`` -> ``.*`` and ``\\_`` -> ``.``."""
    esc = F.regexp_replace(term_fold, r"([^\p{L}\p{N}])", r"\\$1")
    esc = F.regexp_replace(esc, r"\\%", ".*")
    esc = F.regexp_replace(esc, r"\\_", ".")
    return F.concat(F.lit("(?s)"), esc)


def like_match(name_fold: Column, term_fold: Column, is_wild: Column, term_re: Column) -> Column:
    """``name LIKE '%term%'`` on folded text."""
    return F.when(is_wild, F.rlike(name_fold, term_re)).otherwise(F.contains(name_fold, term_fold))


def ngrams(c: Column, n: int | Column) -> Column:
    """Distinct substrings of length ``n`` (empty when the text is shorter)."""
    n_c = F.lit(n) if isinstance(n, int) else n
    L = F.length(c)
    return F.when(L >= n_c, F.array_distinct(
        F.transform(F.sequence(F.lit(1), L - n_c + 1), lambda i: F.substring(c, i, n_c)))
    ).otherwise(F.array().cast("array<string>"))


def prepare_terms(requests: DataFrame, term_col: str) -> DataFrame:
    """Distinct non-empty terms with their folded form, wildcard flag, regex."""
    terms = requests.select(F.col(term_col).alias("term")).where(F.col("term") != "").distinct()
    fold = T.fold_ascii("term")
    return (terms.withColumn("term_fold", fold)
                 .withColumn("is_wild", F.col("term_fold").rlike(WILD))
                 .withColumn("term_re", like_regex(F.col("term_fold"))))


def all_ngrams(c: Column, max_n: int) -> Column:
    """Distinct ``struct(n, gram)`` for every n = 1..max_n (one array, so the
    index is one pass over the names, not one scan per n).  The copies go while the
    grams are plain strings, by a hash set; structs would be compared pair by pair."""
    L = F.length(c)
    per_n = F.transform(F.sequence(F.lit(1), F.least(F.lit(max_n), L)),
                        lambda n: F.transform(F.sequence(F.lit(1), L - n + 1), lambda i: F.substring(c, i, n)))
    grams = F.when(L >= 1, F.array_distinct(F.flatten(per_n))).otherwise(F.array().cast("array<string>"))
    return F.transform(grams, lambda g: F.struct(F.length(g).alias("n"), g.alias("gram")))


def build_ngram_index(catalogue: DataFrame, carry: list, name_fold: str = "name_fold",
                      max_n: int = NGRAM_MAX) -> DataFrame:
    """Rows ``(n, gram, *carry)``: every distinct n-gram (n = 1..max_n) of the
    folded name.  Build once per catalogue version and keep it as a table;
    ``names_index`` builds it over the distinct names only."""
    g = catalogue.select(F.explode(all_ngrams(F.col(name_fold), max_n)).alias("_g"), *carry)
    return g.select(F.col("_g.n").alias("n"), F.col("_g.gram").alias("gram"), *carry)


def distinct_names(catalogue: DataFrame, name_fold: str = "name_fold") -> DataFrame:
    """The predicate depends on the folded name only: match distinct names
    (copies of a name, however many, are matched once)."""
    return catalogue.select(name_fold).where(F.col(name_fold).isNotNull()).distinct()


def names_index(catalogue: DataFrame, name_fold: str = "name_fold") -> DataFrame:
    """The n-gram index of the distinct names.  Generating grams multiplies
    the rows by about ``NGRAM_MAX`` x name length, so the names are spread
    over the cluster first (AQE would otherwise coalesce a few megabytes of
    names into one task)."""
    return build_ngram_index(_streamed(distinct_names(catalogue, name_fold)), [name_fold], name_fold)


def _shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a sort-merge join.  Spark sizes an exploded or checkpointed table
    by the files it comes from, far below its rows, and would send it whole through
    the driver as a broadcast; with a shuffle a skewed partition is still split."""
    return df.hint("merge")


def _names_ngram(terms: DataFrame, names: DataFrame, name_fold: str, index: DataFrame | None) -> DataFrame:
    if index is None:
        # spread the names before generating grams (AQE would coalesce a few
        # megabytes of names into one task)
        index = build_ngram_index(_streamed(names), [name_fold], name_fold)
    idx = index
    freq = idx.groupBy("n", "gram").agg(F.count(F.lit(1)).alias("cnt"))
    # literal part that drives the lookup: the whole term, or its longest
    # run between wildcards
    segs = F.split(F.col("term_fold"), WILD)
    longest = F.aggregate(segs, F.lit(""), lambda acc, s: F.when(F.length(s) > F.length(acc), s).otherwise(acc))
    lit_part = F.when(F.col("is_wild"), longest).otherwise(F.col("term_fold"))
    t = terms.withColumn("_lit", lit_part).withColumn("n", F.least(F.lit(NGRAM_MAX), F.length("_lit")))
    literal = t.where(F.col("n") >= 1)
    # the term's own columns ride along in the grouping (they depend on the
    # term only), so the candidate list is built by one join with the index
    tcols = ["term", "term_fold", "is_wild", "term_re"]
    tg = literal.select(*tcols, "n", F.explode(ngrams(F.col("_lit"), F.col("n"))).alias("gram"))
    best = (tg.join(_shuffled(freq), ["n", "gram"], "left")
              .withColumn("cnt", F.coalesce("cnt", F.lit(0)))
              .groupBy(*tcols, "n").agg(F.min_by("gram", F.struct("cnt", "gram")).alias("gram")))
    cand = best.join(_shuffled(idx), ["n", "gram"], "inner")
    hits = cand.where(like_match(F.col(name_fold), F.col("term_fold"), F.col("is_wild"), F.col("term_re")))
    hits = hits.select("term", name_fold)
    # terms made only of wildcards: LIKE matches every name with at least
    # (#underscores) characters -> equi-join on the lengths a name allows
    # (checked first: usually there are none, and then the names are not
    # exploded by length at all)
    allwild = t.where(F.col("n") < 1).select(
        "term", F.length(F.regexp_replace("term_fold", "%", "")).alias("_m"))
    if allwild.isEmpty():
        return hits
    by_len = names.select(F.explode(F.sequence(F.lit(0), F.length(name_fold))).alias("_m"), name_fold)
    wild_hits = allwild.join(_shuffled(by_len), "_m", "inner").select("term", name_fold)
    return hits.unionByName(wild_hits)


def _streamed(df: DataFrame) -> DataFrame:
    """The streamed side of a nested loop is CPU-bound: an explicit
    repartition keeps AQE from coalescing a small input into one task."""
    sc = df.sparkSession.sparkContext
    n = max(sc.defaultParallelism, shuffle_partitions(df.sparkSession))
    return df.repartition(n)


def _names_broadcast(terms: DataFrame, names: DataFrame, name_fold: str, small: str) -> DataFrame:
    cond = like_match(F.col(name_fold), F.col("term_fold"), F.col("is_wild"), F.col("term_re"))
    if small == "terms":
        return _streamed(names).join(F.broadcast(terms), cond, "inner").select("term", name_fold)
    return _streamed(terms).join(F.broadcast(names), cond, "inner").select("term", name_fold)


def _size(df: DataFrame, col: str) -> tuple:
    """(rows, characters) of ``df``: one aggregate, combined map-side."""
    r = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(col)), F.lit(0))).first()
    return int(r[0]), int(r[1])


def pair_budget_for(spark) -> int:
    return PAIR_BUDGET_PER_CORE * max(1, spark.sparkContext.defaultParallelism)


def choose_strategy(terms: DataFrame, names: DataFrame, name_fold: str,
                    broadcast_limit: int = BROADCAST_TERMS_LIMIT,
                    pair_budget: int | None = None):
    """Pick the plan from the two sides' sizes.  Returns ``(strategy, terms)``
    (terms materialised when they had to be counted).

    * few distinct names (a small catalogue, or many copies of few names):
      broadcast the names and stream the terms, whatever their number;
    * else, when one side fits a broadcast and terms x names stays within
      ``pair_budget`` comparisons: a nested loop with the smaller side
      broadcast;
    * else the n-gram index.
    """
    if pair_budget is None:
        pair_budget = pair_budget_for(names.sparkSession)
    nn, cn = _size(names, name_fold)
    if nn <= min(SMALL_SIDE_ROWS, broadcast_limit) and cn <= BROADCAST_CHARS_LIMIT:
        return "broadcast_names", terms
    terms = terms.checkpoint(eager=True)          # counted, then matched: materialise once
    nt, ct = _size(terms, "term_fold")
    terms_fit = nt <= broadcast_limit and ct <= BROADCAST_CHARS_LIMIT
    names_fit = nn <= broadcast_limit and cn <= BROADCAST_CHARS_LIMIT
    if not (terms_fit or names_fit):
        return "ngram", terms
    if nt * nn > pair_budget:
        return "ngram", terms
    if terms_fit and (not names_fit or ct < cn):
        return "broadcast", terms
    return "broadcast_names", terms


def name_matches(requests: DataFrame, catalogue: DataFrame, term_col: str,
                 name_fold: str = "name_fold", strategy: str = "auto",
                 index: DataFrame | None = None,
                 broadcast_limit: int = BROADCAST_TERMS_LIMIT) -> DataFrame:
    """(term, folded name) pairs with ``name LIKE '%term%'`` over the
    distinct names of the catalogue."""
    terms = prepare_terms(requests, term_col)
    names = distinct_names(catalogue, name_fold)
    auto = strategy == "auto"
    if auto:
        strategy, terms = choose_strategy(terms, names, name_fold, broadcast_limit)
    if strategy == "broadcast":
        return _names_broadcast(terms, names, name_fold, "terms")
    if strategy == "broadcast_names":
        return _names_broadcast(terms, names, name_fold, "names")
    if strategy == "ngram":
        if not auto:
            # read three times (routing, candidates, the all-wildcard
            # check): materialise once, as the size checks do on ``auto``
            terms = terms.checkpoint(eager=True)
        return _names_ngram(terms, names, name_fold, index)
    raise ValueError(f"unknown strategy {strategy}")


def substring_matches(requests: DataFrame, catalogue: DataFrame, term_col: str, carry: list,
                      name_fold: str = "name_fold", strategy: str = "auto",
                      index: DataFrame | None = None,
                      broadcast_limit: int = BROADCAST_TERMS_LIMIT,
                      per_name: tuple | None = None) -> DataFrame:
    """All (term, catalogue row) pairs with ``name LIKE '%term%'``.

    Names are matched once each (``name_matches``), then expanded to the
    catalogue rows carrying them.  ``per_name=(order, k)`` expands only each
    name's first ``k`` rows in ``order`` (enough for any first-k per term).
    Returns ``term`` plus ``name_fold`` and the ``carry`` columns.
    """
    pairs = name_matches(requests, catalogue, term_col, name_fold, strategy, index, broadcast_limit)
    cols = list(dict.fromkeys([name_fold, *carry]))
    rows = catalogue.where(F.col(name_fold).isNotNull()).select(*cols)
    if per_name is not None:
        order, k = per_name
        rows = R.first_k(rows, [name_fold], order, k)
    hits = pairs.join(_shuffled(rows), name_fold, "inner").select("term", *cols)
    # the empty term: every named row (or the first k of all), at most once
    every = catalogue.where(F.col(name_fold).isNotNull()).select(*cols)
    if per_name is not None:
        every = every.orderBy(*per_name[0]).limit(per_name[1])
    empty = requests.select(F.col(term_col).alias("term")).where(F.col("term") == "").distinct()
    return hits.unionByName(every.withColumn("term", F.lit("")).join(empty, "term", "left_semi").select("term", *cols))


def build_gram_topk(catalogue: DataFrame, carry: list, order: list, k: int, name_fold: str = "name_fold",
                    max_n: int = NGRAM_MAX, only: DataFrame | None = None) -> DataFrame:
    """Rows ``(gram, rank, name_fold, *carry)``: for every gram of up to ``max_n``
    characters the first ``k`` catalogue rows in ``order`` whose name contains it.

    A term without wildcards that is no longer than ``max_n`` *is* a gram, so its
    first ``k`` matches are the gram's rows: ``k`` of them, where the n-gram index
    holds every name with the gram.  Only a name's own first ``k`` rows are
    exploded, and the group limit cuts each gram to ``k`` rows per input partition
    before the shuffle.  Build once per catalogue version and keep it as a table.
    For one set of requests ``only``, distinct grams few enough to broadcast, leaves
    the others out before the sort.
    """
    cols = list(dict.fromkeys([name_fold, *carry]))
    rows = R.first_k(catalogue.where(F.col(name_fold).isNotNull()).select(*cols), [name_fold], order, k)
    grams = _streamed(rows).select(F.explode(all_ngrams(F.col(name_fold), max_n)).alias("_g"), *cols)
    grams = grams.select(F.col("_g.gram").alias("gram"), *cols)
    if only is not None:
        grams = grams.join(F.broadcast(only), "gram", "left_semi")
    return R.first_k(grams, ["gram"], order, k, rank_col="rank")


def first_matches(requests: DataFrame, catalogue: DataFrame, term_col: str, carry: list,
                  order: list, k: int, strategy: str = "auto", name_fold: str = "name_fold",
                  grams: DataFrame | None = None, **kw) -> DataFrame:
    """Q1/Q2-style ``LIMIT k``: the first ``k`` matches per term in ``order``
    (catalogue order; must end in a unique key).  Adds ``rank`` 1..k.

    With the n-gram strategy short terms without wildcards are answered by the
    top-k gram table (``grams``, from ``build_gram_topk`` with at least ``k`` rows
    a gram; built here when it is not given); only the others go through the index.
    """
    asked = requests.select(F.col(term_col).alias("term"))
    if strategy == "auto":
        strategy, terms = choose_strategy(prepare_terms(asked, "term"), distinct_names(catalogue, name_fold), name_fold,
                                          kw.get("broadcast_limit", BROADCAST_TERMS_LIMIT))
        asked = terms.select("term").unionByName(asked.where(F.col("term") == "").distinct())
    if strategy != "ngram":
        pairs = substring_matches(asked, catalogue, "term", carry, name_fold=name_fold, strategy=strategy,
                                  per_name=(order, k), **kw)
        return R.first_k(pairs, ["term"], order, k, rank_col="rank")
    asked = asked.distinct().checkpoint(eager=True)          # read by both ways
    is_gram = (F.length("term") >= 1) & (F.length("term") <= NGRAM_MAX) & ~F.col("term").rlike(WILD)
    if grams is None:
        wanted = asked.where(is_gram).select(T.fold_ascii("term").alias("gram")).distinct()
        few = wanted.limit(BROADCAST_TERMS_LIMIT + 1).count() <= BROADCAST_TERMS_LIMIT
        grams = build_gram_topk(catalogue, carry, order, k, name_fold, only=wanted if few else None)
    cols = list(dict.fromkeys([name_fold, *carry]))
    short = asked.where(is_gram).withColumn("gram", T.fold_ascii("term")).join(_shuffled(grams.where(F.col("rank") <= k)), "gram") \
        .select("term", *cols, "rank")
    other = asked.where(~is_gram)
    if other.isEmpty():
        return short
    pairs = substring_matches(other, catalogue, "term", carry, name_fold=name_fold, strategy="ngram", per_name=(order, k), **kw)
    return short.unionByName(R.first_k(pairs, ["term"], order, k, rank_col="rank").select(*short.columns))


def envelope(requests: DataFrame, hits: DataFrame, req_key, hit_key: str = "term") -> DataFrame:
    """N7/A2 flat form: every request row once per hit, or once with nulls;
    ``found`` and ``n_found`` per request.

    Written as an inner join plus an anti join rather than a left join: a
    term with a huge hit list puts its hits on the non-preserved side of a
    left join, which AQE cannot split; an inner join's skewed partition it
    can.  The count is a grouped aggregate (combined map-side), not a window
    over a possibly huge group.  ``hits`` feeds the join and the count, so it
    is materialised once with ``checkpoint()`` (in the shared
    ``spark.checkpoint.dir``) instead of being computed twice.  ``req_key``
    is a column or a list of columns (then ``hits`` carries the same names).
    """
    if MATERIALISE_HITS:
        hits = hits.checkpoint(eager=True)
    keys = [req_key] if isinstance(req_key, str) else list(req_key)
    h = hits.withColumnRenamed(hit_key, req_key) if isinstance(req_key, str) and hit_key != req_key else hits
    counts = h.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n_found"))
    matched = requests.join(h, keys, "inner").join(counts, keys, "inner")
    missing = requests.join(counts.select(*keys), keys, "left_anti")
    hit_cols = [c for c in h.columns if c not in keys and c not in requests.columns]
    types = dict(h.dtypes)
    missing = missing.select(*requests.columns,
                             *[F.lit(None).cast(types[c]).alias(c) for c in hit_cols],
                             F.lit(0).cast("long").alias("n_found"))
    out = matched.select(*requests.columns, *hit_cols, "n_found").unionByName(missing)
    return out.withColumn("found", F.col("n_found") > 0)


# ------------------------------------------------------- one request at a time ---
def fold_ascii_text(s: str) -> str:
    """D1 folding of a Python string (A-Z only), as ``fold_ascii`` on a column."""
    return "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in s)


def like_term(name_fold: Column, term: str) -> Column:
    """``name LIKE '%term%'`` for one term given as text.  A literal term is a
    plain ``contains`` (pushed into the Parquet scan as ``StringContains`` when
    ``name_fold`` is a stored column); a term with ``%``/``_`` is a LIKE whose
    escape character does not occur in the term (SQLite has none)."""
    t = fold_ascii_text(term)
    if not any(ch in t for ch in "%_"):
        return name_fold.contains(t)
    esc = next(chr(c) for c in range(1, 0x110000) if chr(c) not in t and chr(c) not in "%_")
    return F.like(name_fold, F.lit(f"%{t}%"), F.lit(esc))


def search_by_name(catalogue: DataFrame, keyword: str, order: list, k: int = 5,
                   name_fold: str = "name_fold") -> DataFrame:
    """Q1 for one keyword: the first ``k`` rows (in ``order``) whose name
    contains it.  A filter plus ``orderBy().limit()``: Spark plans a
    per-partition top-k merged once (``TakeOrderedAndProject``).  As in the
    original, an empty keyword matches every named row."""
    return catalogue.where(like_term(F.col(name_fold), keyword)).orderBy(*order).limit(k)


def search_by_attributes(catalogue: DataFrame, shape: str | None, color: str | None, order: list,
                         k: int = 10, shape_col: str = "drug_shape",
                         color_cols: tuple = ("color_class1", "color_class2")) -> DataFrame:
    """Q2/P11/P12 for one request: ``shape LIKE`` and ``(color1 LIKE or
    color2 LIKE)``, an absent or empty argument adds no condition; at least
    one argument is required (the original answers 400)."""
    if not shape and not color:
        raise ValueError("shape or color is required")
    cond = F.lit(True)
    if shape:
        cond = cond & like_term(T.fold_ascii(shape_col), shape)
    if color:
        any_c = F.lit(False)
        for c in color_cols:
            any_c = any_c | F.coalesce(like_term(T.fold_ascii(c), color), F.lit(False))
        cond = cond & any_c
    return catalogue.where(F.coalesce(cond, F.lit(False))).orderBy(*order).limit(k)
