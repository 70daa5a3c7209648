"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base finders.  Each kind's pattern is searched leftmost and non-overlapping in
the whole text; matches that fail the kind's check are dropped.  Positions come
from the text between the matches: ``split`` and ``regexp_extract_all`` walk the
same matches, and a running sum over a document's few match rows turns lengths
into code-point positions.  The patterns below are written so that Java's
matcher needs neither recursion nor repeated scans of one run; ``\\G`` lets a match
start right after the previous one, as the plain pattern does.

Bootstrapping.  Seeds are the base spans.  Candidates are other number- or
address-like strings that overlap no base span.

1. A lexical pattern is the pair of words left of a seed or candidate.  It is
   of use for a kind if at least ``MIN_SEEDS`` different seeds of the kind follow
   it, whatever the size of the corpus, and if at least ``MIN_SELECTIVE`` of its
   occurrences in the whole corpus are followed by a seed or candidate (common
   word pairs are not).
2. On the graph of patterns and instances (distinct strings) scores alternate
   for ``ROUNDS``: a pattern's confidence in a kind is the mean score of its
   instances, with one doubtful instance added; a candidate's score is the
   noisy-or of its patterns' confidences.  Seeds stay at 1.
3. Candidates of a fitting shape after a pattern of confidence ``ACCEPT``, or
   whose own score is ``ACCEPT_INSTANCE``, become spans of the kind.

Defined results: null and empty texts have no spans; repeated rows get equal
spans; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rxlake.llm.store import drop, recorded, written

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = [
    f"(?:(?<!{_LOCAL})|\\G){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "[0-9](?:[\\x20-]?[0-9])++",
    "\\+[0-9][\\x20().0-9-]+[0-9]",
]
CANDIDATE = (f"(?:(?<!{_LOCAL})|\\G)(?:{_LOCAL}++@[A-Za-z0-9._-]++"
             "|[+(]{0,2}[0-9](?:[\\x20().-]{0,2}[0-9]){4,}+(?![A-Za-z0-9_]))")
#: a text without this matches none of the patterns
NEEDS = ["@", ".", None, "+", None]
MIN_SEEDS = 3
BITS = 1 << 18               # of the bitmap by which other word pairs are told from patterns before the shuffle
MIN_SELECTIVE = 0.5
ROUNDS = 3
ACCEPT, ACCEPT_INSTANCE = 0.7, 0.9
TAIL = 160                   # characters before a match that are searched for its two words


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda a, i: a + (
        lambda d: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    )(F.substr(back, i, F.lit(1)).cast("int")))
    return total % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    """The kind's check of a matched string (kind: its number)."""
    part = lambda p: F.ltrim(p, F.lit("0"))
    ip = F.forall(F.split(value, "\\."), lambda p: (F.length(part(p)) <= 3) & (
        F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(value))
    card = F.when(n.between(13, 19), luhn(_digits(value))).otherwise(False)
    return F.when(kind == 0, F.lit(True)).when(kind == 1, ip).when(kind == 2, card) \
        .when(kind == 3, n.between(9, 15)).otherwise(F.lit(True))


def _fits(kind: int, value: Column) -> Column:
    """Whether a candidate has the shape of a kind."""
    n = F.length(_digits(value))
    return [F.instr(value, "@") > 0,
            value.rlike("^[0-9]++(?:\\.[0-9]++){2,}+$"),
            value.rlike("^[0-9][0-9 -]*+$") & n.between(12, 19),
            value.rlike("^[0-9+(][0-9 ().+-]*+$") & n.between(6, 15)][kind]


def matches(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per document: rid, keys, and all matches with the text lengths between them."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = docs.select(*[F.col(f"`{c}`") for c in keys], t.alias("_t")).withColumn("_d", F.col("_t").rlike("[0-9]"))
    found = {}
    for k, pattern in enumerate([*PATTERNS, CANDIDATE]):
        may = F.instr("_t", NEEDS[k]) > 0 if NEEDS[k] else F.lit(True)
        if k < 4 and k > 0:
            may = may & F.col("_d")
        elif k == 4:
            may = F.col("_d") | (F.instr("_t", "@") > 0)
        hits = F.when(may, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)))
        found[f"_m{k}"] = F.when(F.size(hits) > 0, hits)
    df = df.withColumns(found)
    rows = []
    for k, pattern in enumerate([*PATTERNS, CANDIDATE]):
        gaps = F.slice(F.split("_t", pattern), 1, F.size(f"_m{k}"))
        rows.append(F.when(F.col(f"_m{k}").isNotNull(), F.zip_with(gaps, f"_m{k}", lambda g, m: F.struct(
            F.lit(k).alias("kind"), F.length(g).alias("gap"), m.alias("value"), F.right(g, F.lit(TAIL)).alias("tail")))))
    none = F.array().cast("array<struct<kind:int,gap:int,value:string,tail:string>>")
    df = df.withColumn("found", F.concat(*[F.coalesce(r, none) for r in rows]))
    return df.select(F.monotonically_increasing_id().alias("rid"), *[f"`{c}`" for c in keys], "found")


def placed(found: DataFrame) -> DataFrame:
    """One row per valid match: rid, kind (4: candidate), start, end, value, pattern (two left words)."""
    rows = found.select("rid", F.posexplode("found").alias("at", "x")).select("rid", "at", "x.*")
    upto = W.partitionBy("rid", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    size = F.length("value")
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(upto)).withColumn("start", F.col("end") - size)
    words = F.regexp_extract("tail", "(?:^|\\s)(\\S++\\s++\\S++)\\s+\\S{0,2}$", 1)
    rows = rows.where(_valid(F.col("kind"), F.col("value"))).select(
        "rid", "kind", "start", "end", F.lower("value").alias("value"),
        F.when(words != "", F.lower(F.regexp_replace(words, "\\s+", " "))).alias("pattern"))
    # candidates must not touch a base span
    before = W.partitionBy("rid").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("rid").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)
    base = F.col("kind") < 4
    rows = rows.withColumn("left", F.max(F.when(base, F.col("end"))).over(before)) \
        .withColumn("right", F.min(F.when(base, F.col("start"))).over(after))
    clear = (F.coalesce("left", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("right") >= F.col("end"), F.lit(True)))
    return rows.where(base | clear).drop("left", "right")


def selective_patterns(docs: DataFrame, text: str, spots: DataFrame) -> DataFrame:
    """(pattern): those with enough seeds of one kind that are mostly followed by an identifier."""
    seeded = spots.where("pattern is not null and kind < 4").groupBy("pattern", "kind") \
        .agg(F.count_distinct("value").alias("n")).where(F.col("n") >= MIN_SEEDS).select("pattern").distinct()
    # a spot counts once, though several kinds may match it
    here = spots.where("pattern is not null").select("rid", "start", "pattern").distinct() \
        .join(seeded, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("followed"))
    here = written(here, "pii-followed")
    w = F.split(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), "\\s+")
    pairs = docs.select(w.alias("w")).select(F.explode(F.zip_with(
        "w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))),
        lambda a, b: F.concat_ws(" ", a, b))).alias("pattern"))
    # a bitmap of the patterns' hashes (BITS numbers of a bit each, whatever the corpus) keeps most other pairs out of
    # the shuffle; occurrences are summed up before they meet the patterns, so the join makes at most one row a
    # pattern.  The patterns grow with the corpus, so no broadcast of them
    bit = F.pmod(F.xxhash64("pattern"), F.lit(BITS))
    words = here.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")) \
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits")).collect()
    of = dict(words)
    bitmap = F.split(F.lit(",".join(str(of.get(i, 0)) for i in range(BITS // 64))), ",").cast("array<bigint>")
    likely = pairs.withColumn("bit", bit).where(
        F.getbit(F.get(bitmap, F.floor(F.col("bit") / 64).cast("int")), (F.col("bit") % 64).cast("int")) == 1)
    total = likely.groupBy("pattern").agg(F.count("*").alias("total"))
    return total.join(here.hint("merge"), "pattern").where(F.col("followed") >= MIN_SELECTIVE * F.col("total")).select("pattern")


def bootstrap(spots: DataFrame, patterns: DataFrame) -> DataFrame:
    """(rid, start, end, kind) of candidates that the pattern graph accepts."""
    seeds = spots.where("kind < 4").select("kind", "value").distinct().withColumn("seed", F.lit(1.0))
    fits = F.array(*[F.when(_fits(k, F.col("value")), F.lit(k)) for k in range(4)])
    could = spots.where("kind = 4").select("rid", "start", "end", "pattern", "value",
                                           F.explode(F.array_compact(fits)).alias("kind"))
    could = written(could, "pii-candidates")
    edges = could.select("kind", "pattern", "value").union(spots.where("kind < 4").select("kind", "pattern", "value")) \
        .distinct().join(patterns, "pattern", "left_semi")
    enough = edges.join(seeds, ["kind", "value"], "left_semi").groupBy("kind", "pattern") \
        .agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SEEDS)
    edges = written(edges.join(enough.select("kind", "pattern"), ["kind", "pattern"], "left_semi")
                    .join(seeds, ["kind", "value"], "left"), "pii-graph")
    instance = edges.select("kind", "value", F.coalesce("seed", F.lit(0.0)).alias("score")).distinct()
    for i in range(ROUNDS):
        confidence = edges.join(instance, ["kind", "value"]).groupBy("kind", "pattern").agg(
            F.round(F.sum("score") / (F.count("*") + 1), 9).alias("confidence"))
        confidence = written(confidence, f"pii-confidence-{i}")
        instance = edges.join(confidence, ["kind", "pattern"]).groupBy("kind", "value").agg(F.round(F.coalesce(
            F.max("seed"), 1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))), 9).alias("score"))
        instance = written(instance, f"pii-instances-{i}")
    scored = could.join(confidence, ["kind", "pattern"], "left").join(instance, ["kind", "value"], "left")
    good = scored.where((F.coalesce("confidence", F.lit(0.0)) >= ACCEPT) | (F.coalesce("score", F.lit(0.0)) >= ACCEPT_INSTANCE))
    return good.groupBy("rid", "start", "end").agg(F.max_by("kind", F.struct(
        F.greatest(F.coalesce("confidence", F.lit(0.0)), F.coalesce("score", F.lit(0.0))), -F.col("kind"))).alias("kind"))


def find(docs: DataFrame, keys: list[str], *, text: str = "text", bootstrapping: bool = True) -> DataFrame:
    """Every row's ``keys`` with ``spans``: array of (kind number, start, end, base), by kind and start.

    ``bootstrapping=False`` gives the base spans alone.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    src = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keys, names)], F.col(f"`{text}`").alias("_text"))
    found = written(matches(src, names, "_text"), "pii-matches")
    spots = written(placed(found.where(F.size("found") > 0)), "pii-spots")
    spans = spots.where("kind < 4").select("rid", "kind", "start", "end", F.lit(True).alias("base"))
    if bootstrapping:
        patterns = written(selective_patterns(src, "_text", spots), "pii-patterns")
        more = bootstrap(spots, patterns)
        spans = spans.union(more.select("rid", "kind", "start", "end", F.lit(False).alias("base")))
    per_doc = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("spans"))
    out = found.select("rid", *names).join(per_doc, "rid", "left")
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean>>")
    return out.select(*[F.col(k).alias(c) for c, k in zip(keys, names)], F.coalesce("spans", none).alias("spans"))


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return find(docs, ["doc_id"]).select("doc_id", *[count(k).alias(f"n_{n}") for k, n in enumerate(KINDS)],
                                         F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _replaced(keyed: DataFrame, marks: Column, bootstrapping: bool) -> tuple[DataFrame, DataFrame]:
    """(rows with spans, spans replaced; rows without) of (row, _t, _id, _h)."""
    with recorded() as temporary:
        found = find(keyed, ["_id", "_h"], text="_t", bootstrapping=bootstrapping)
    spans = found.where(F.size("spans") > 0).groupBy("_id", "_h").agg(F.first("spans").alias("spans"))
    one = spans.select("_id", "_h", F.explode("spans").alias("s")).select("_id", "_h", "s.*")
    # what lies before a span from the furthest end so far; a span inside another adds nothing
    so_far = W.partitionBy("_id", "_h").orderBy("start", "end", "kind").rowsBetween(W.unboundedPreceding, -1)
    one = one.withColumn("from", F.coalesce(F.max("end").over(so_far), F.lit(0).cast("long")))
    cuts = written(one.groupBy("_id", "_h").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "from", "kind"))).alias("cuts"), F.max("end").alias("last")), "pii-cuts")
    drop(keyed.sparkSession, temporary)
    # both sides grow with the data: no broadcast, whatever the size now
    cuts = cuts.hint("merge")
    same = keyed["_id"].eqNullSafe(cuts["_id"]) & keyed["_h"].eqNullSafe(cuts["_h"])
    full = keyed.join(cuts, same, "left").select("row", "_t", keyed["_id"], keyed["_h"], "cuts", "last")
    piece = F.transform("cuts", lambda s: F.when(s["start"] >= s["from"], F.concat(
        F.substr("_t", s["from"] + 1, s["start"] - s["from"]), F.get(marks, s["kind"]))).otherwise(F.lit("")))
    new = F.concat(F.array_join(piece, ""), F.substr("_t", F.col("last") + 1, F.length("_t")))
    full = written(full.withColumn("_t", F.when(F.col("cuts").isNull(), F.col("_t")).otherwise(new))
                   .withColumn("hit", F.col("cuts").isNotNull()).drop("cuts", "last"), "pii-replaced")
    return full.where("hit").withColumn("_h", F.xxhash64("_t")).drop("hit"), full.where("not hit").drop("hit")


def redact(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", mark: str = "[{kind}]") -> DataFrame:
    """``docs`` with every span of its text replaced by a mark; overlapping spans are replaced as one.

    Rows that changed are searched again by the base finders until they have no
    base span left: a number that was too long for its kind may become valid
    when a part of it is replaced.
    """
    marks = F.array(*[F.lit(mark.format(kind=k.upper())) for k in KINDS])
    keyed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns if c != text]).alias("row") if len(docs.columns) > 1
                        else F.struct(F.lit(0)).alias("row"),
                        F.col(f"`{text}`").alias("_t"), F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_h"))
    todo, done = _replaced(keyed, marks, True)
    while not todo.isEmpty():
        todo, clean = _replaced(todo, marks, False)
        done = done.unionByName(clean)
    return done.select(*[(F.col("_t") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
