"""Chat formatting by quotation linking, in DataFrame functions.

Parsing.  A line's quote level is the number of ``>`` at its start (blanks
between them do not count).  Runs of lines of one level are passages; passages of level 0
are the message's own text.  A line of own text that only announces the quote
after it (``... wrote:`` and the like) is dropped.

Linking.  Passages, and single lines of at least ``LINE_WORDS`` words, are
normalised (markers removed, blanks collapsed, lower-cased) and hashed.  A quoted
passage of any level is looked up among the original passages and lines:

1. in the same conversation: the latest earlier message that has it (``latest_before``:
   frames over ranges of the sorted rows, which carry the latest turn on, not a join);
2. else anywhere: the first message by (conversation, turn) that has it, from
   one aggregate per hash.  Only a smaller (conversation, turn) may be a parent,
   so the links have no cycle.

``links`` has the original of every quoted passage.  The parent of a message is found at
the smallest level that has a link (what it quotes directly, else what was quoted
in that): the link with most words, then the nearest (same
conversation, then latest).  A message without a link answers the turn before it
in its conversation; the first turn is a root.

Threads.  Parent links form trees; roots and depths come from pointer doubling,
in as many rounds as the logarithm of the deepest reply; a message whose root is known
rests.  Messages of a thread are
ordered by (depth, conversation, turn), a parent always before its replies;
``position`` numbers them from 0 with a range partition and per-partition
offsets, so a thread of any size is spread over tasks.

Defined results: null and empty texts have no quotes and an empty body; rows of
equal (conversation, turn) are one message if their texts are equal, else the
smaller text is message and the others keep their own body with the same place;
rows with a null conversation or turn stand alone, each a root of a thread of no
id; a text of any length is parsed whole, in one row; an empty table gives an empty
result; quotes of nothing known are removed from the body and counted as unlinked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rxlake.llm.store import written

LINE_WORDS = 4
ANNOUNCES = "(?i)\\b(?:wrote|writes|said|says|schrieb|écrit|escribió)\\s*:\\s*$"


def _level(line: Column) -> Column:
    return F.length(F.translate(F.regexp_extract(line, "^[\\s>]*+", 0), " \t\r\n\x0b\x0c", ""))


def _normal(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(F.regexp_replace(text, "(?m)^[\\s>]*+", " "), "\\s+", " ")))


def _words(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " ")))


def parse(messages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, body, quotes (level, text) and own passages of every row; each text is read once."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = messages.select(*keys, F.split(t, "\n").alias("lines"), (F.instr(t, ">") > 0).alias("may"))
    # (level, line) of every line; most texts have no mark and skip this
    df = df.withColumn("marked", F.when(F.col("may"), F.transform("lines", lambda x: F.struct(_level(x).alias("level"), x.alias("line")))))
    same = lambda i: F.get("marked", i)["level"] == F.get("marked", i - 1)["level"]
    df = df.withColumn("starts", F.filter(F.transform("marked", lambda x, i: F.when((i == 0) | ~same(i), i)), lambda i: i.isNotNull()))
    stop = lambda k: F.coalesce(F.get("starts", k + 1), F.size("marked"))
    runs = F.transform("starts", lambda i, k: F.struct(
        F.get("marked", i)["level"].alias("level"),
        F.array_join(F.transform(F.slice("marked", i + 1, stop(k) - i), lambda x: x["line"]), "\n").alias("text")))
    df = df.withColumn("runs", runs)
    body = F.transform("runs", lambda r, k: F.when(r["level"] == 0, F.when(
        F.coalesce(F.get("runs", k + 1)["level"] > 0, F.lit(False)), F.regexp_replace(
            r["text"], "(?:^|\\n)[^\\n]*" + ANNOUNCES, "")).otherwise(r["text"])))
    own = F.when(F.col("runs").isNull(), F.array(F.array_join("lines", "\n"))).otherwise(F.filter(body, lambda b: b.isNotNull()))
    none = F.array().cast("array<struct<level:int,text:string>>")
    return df.withColumn("own", own).select(
        *keys, F.btrim(F.array_join("own", "\n"), F.lit(" \t\r\n")).alias("body"), "own",
        F.coalesce(F.filter("runs", lambda r: r["level"] > 0), none).alias("quotes"))


def _hashes(texts: Column) -> Column:
    """Distinct (hash, words) of the passages and of their longer lines."""
    whole = F.transform(texts, _normal)
    lines = F.filter(F.transform(F.flatten(F.transform(texts, lambda t: F.split(t, "\n"))), _normal),
                     lambda x: _words(x) >= LINE_WORDS)
    return F.array_distinct(F.transform(F.filter(F.concat(whole, lines), lambda x: x != ""), lambda x: F.struct(
        F.xxhash64(x).alias("hash"), _words(x).alias("words"))))


def latest_before(rows: DataFrame, keys: list[str], order: str, is_event: str, result: str) -> DataFrame:
    """``rows`` with ``result``: of the events of its key with a smaller ``order``, the largest ``order``.

    Rows are sorted by range over (keys, order); equal rows share a range.  Within a range a frame
    finds the event, and each range hands its latest on through a table of one row per key and
    range, so a key of any size is spread over tasks.
    """
    placed = written(rows.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()), "quotes-ranges")
    event = F.when(F.col(is_event), F.col(order))
    ranges = placed.groupBy(*keys, "_part").agg(F.max(event).alias("_last"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("_carried", F.max("_last").over(earlier)).drop("_last").where("_carried is not null")
    within = W.partitionBy(*keys, "_part").orderBy(order).rangeBetween(W.unboundedPreceding, -1)
    return placed.withColumn("_near", F.max(event).over(within)).join(ranges, [*keys, "_part"], "left") \
        .withColumn(result, F.coalesce("_near", "_carried")).drop("_part", "_near", "_carried")


def links(parsed: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, words, p struct(conv, turn)): every quoted passage, or longer line of one,
    whose original is found; a passage that a message quotes repeatedly at one level is one row."""
    asks = parsed.where(F.size("quotes") > 0).select("conv", "turn", F.explode("quotes").alias("q")) \
        .select("conv", "turn", "q.level", F.explode(_hashes(F.array("q.text"))).alias("h")) \
        .select("conv", "turn", "level", "h.*").distinct()
    asks = written(asks, "quotes-asked")
    wanted = asks.select("hash").distinct()
    # only what somebody quotes
    has = parsed.select("conv", "turn", F.explode(_hashes(F.col("own"))).alias("h")).select("conv", "turn", "h.hash") \
        .join(wanted, "hash", "left_semi").distinct()
    has = written(has, "quotes-originals")
    both = asks.withColumn("has", F.lit(False)).unionByName(has.withColumns({"level": F.lit(0), "words": F.lit(0), "has": F.lit(True)}))
    near = latest_before(both, ["conv", "hash"], "turn", "has", "near").where("not has").drop("has")
    first = has.groupBy("hash").agg(F.min(F.struct("conv", "turn")).alias("first"))
    here = F.struct("conv", "turn")
    link = F.when(F.col("near").isNotNull(), F.struct("conv", F.col("near").alias("turn"))) \
        .when(F.col("first") < here, F.col("first"))
    return near.join(first, "hash", "left").withColumn("p", link).where("p is not null") \
        .select("conv", "turn", "level", "hash", "words", "p")


def parents(parsed: DataFrame) -> DataFrame:
    """(conv, turn, p_conv, p_turn, linked words, linked level) of messages whose quotes are found."""
    votes = links(parsed).groupBy("conv", "turn", "level", "p").agg(F.sum("words").alias("words"))
    best = votes.groupBy("conv", "turn").agg(F.max(F.struct(
        (-F.col("level")).alias("up"), "words", (F.col("p.conv") == F.col("conv")).alias("near"), F.col("p.turn").alias("t"),
        F.col("p.conv").alias("c"))).alias("b"))
    return best.select("conv", "turn", F.col("b.c").alias("p_conv"), F.col("b.t").alias("p_turn"),
                       F.col("b.words").cast("long").alias("linked_words"), (-F.col("b.up")).alias("linked_level"))


def roots(tree: DataFrame) -> DataFrame:
    """(id, up: the root struct, depth) of (conv, turn, parent struct or null) by pointer doubling.

    A message that knows its root rests: each round joins only the others, so a message of depth d
    is joined about log2(d) + 1 times and a deep thread costs the others nothing.
    """
    here = F.struct("conv", "turn")
    now = written(tree.select(here.alias("id"), F.coalesce("parent", here).alias("up"), F.col("parent").isNotNull().cast("long").alias("depth"),
                              F.col("parent").isNull().alias("done")), "threads")
    known, active = now.where("done"), now.where("not done")
    while not active.isEmpty():
        # everyone hands its own parent and depth on; both sides grow with the data, so no broadcast
        above = known.unionByName(active).select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"),
                                                 F.col("done").alias("done2"))
        now = written(active.drop("done").join(above.hint("merge"), "up", "left").select(
            "id", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
            F.coalesce("done2", F.lit(True)).alias("done")), "threads")
        known, active = known.unionByName(now.where("done")), now.where("not done")
    return known.drop("done")


def positions(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with ``position`` from 0 within ``key`` in ``order``; a key may be of any size."""
    placed = written(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
                     .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "positions")
    # a key's rows in one partition are consecutive: at most one (key, part) row for each
    sizes = placed.groupBy(key, "_part").agg(F.count("*").alias("n"), F.min("_row").alias("_first"))
    earlier = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return placed.join(sizes.drop("n"), [key, "_part"]).withColumn("position", F.col("_row") - F.col("_first") + F.col("_base")) \
        .drop("_part", "_row", "_first", "_base")


def link(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every message without its quotes, in reply order.

    Columns: conv_id, turn, role, body, n_quotes (passages of any level),
    max_level, parent_conv, parent_turn, linked_words (0: the parent is the turn
    before), linked_level (of the quote that found the parent, else 0), thread_conv, thread_turn (the root), depth, position.
    """
    src = messages.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"),
                          F.col(f"`{text}`").alias("_text"))
    parsed = written(parse(src, ["conv", "turn", "role"], "_text"), "quotes-parsed")
    placed = parsed.where("conv is not null and turn is not null")
    ids = written(placed.select("conv", "turn").distinct(), "quotes-ids")
    # the turn before, joined by place: a conversation of any size stays spread
    numbered = positions(ids, "conv", ["turn"])
    above = numbered.select("conv", (F.col("position") + 1).alias("position"), F.col("turn").alias("before"))
    by_turn = numbered.join(above, ["conv", "position"], "left").drop("position")
    tree = by_turn.join(parents(placed), ["conv", "turn"], "left").withColumn("parent", F.when(
        F.col("p_conv").isNotNull(), F.struct(F.col("p_conv").alias("conv"), F.col("p_turn").alias("turn"))).when(
        F.col("before").isNotNull(), F.struct("conv", F.col("before").alias("turn"))))
    tree = written(tree.select("conv", "turn", "parent", F.coalesce("linked_words", F.lit(0).cast("long")).alias("linked_words"),
                               F.coalesce("linked_level", F.lit(0)).alias("linked_level")), "quotes-tree")
    spots = roots(tree).select("id.conv", "id.turn", F.col("up").alias("thread"), "depth")
    spots = positions(spots, "thread", ["depth", "conv", "turn"]).join(tree, ["conv", "turn"])
    full = parsed.join(spots, ["conv", "turn"], "left")
    return full.select(
        F.col("conv").alias("conv_id"), "turn", "role", "body", F.size("quotes").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)).alias("max_level"),
        F.col("parent.conv").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"),
        F.coalesce("linked_words", F.lit(0).cast("long")).alias("linked_words"),
        F.coalesce("linked_level", F.lit(0)).alias("linked_level"),
        F.col("thread.conv").alias("thread_conv"), F.col("thread.turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), F.coalesce("position", F.lit(0).cast("long")).alias("position"))
