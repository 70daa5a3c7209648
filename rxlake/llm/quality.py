"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every document gets four shares: symbols, upper-case letters, words in
repeated three-word windows, and lines that repeat an earlier line.  A rule
rejects a document whose share exceeds the rule's cutoff in the document's
stratum (its language).  The cutoffs of the four rules move together along one
ordered path, from lenient to strict (``joint_path``); labelled rows decide how
far each stratum goes:

1. per stratum the labelled good rows that each step of the path rejects are
   counted (rows that the base rule fails are left out: their fate does not
   depend on a cutoff);
2. a step is certified if the exact binomial probability of so few or fewer
   false rejections, were the true risk ``alpha``, is at most
   ``delta / strata`` (Bonferroni over the strata).  Within a stratum the path
   is tested from its most lenient step on and stops at the first failure, so
   the steps themselves need no correction (fixed-sequence testing).  One joint
   path spends the whole ``alpha`` and ``delta / strata`` on all four rules, so with
   four strata 86 good rows without a false rejection certify a step;
3. of the certified steps the one with the largest difference between the
   rejected shares of bad and good rows is used, the most lenient on ties.

With probability ``1 - delta`` no stratum loses more than ``alpha`` of its good
documents to the rules.  A stratum with too few labels certifies nothing and
keeps all that pass the base rule.

Window equality is decided by 64-bit hashes of three words within one text.

Defined results: a null or blank text has no words and fails the base rule; a
null language is a stratum of its own; labels that contradict each other for
one id are not used; repeated rows are judged alike; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rxlake.llm.store import written

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
RULES = ["symbol_share", "upper_share", "repeat_share", "dup_line_share"]
#: the rules' cutoffs where the path's factor is 1
UNITS = {"symbol_share": 0.25, "upper_share": 0.5, "repeat_share": 0.5, "dup_line_share": 0.75}
#: the path's factors, from lenient to strict
FACTORS = [1.3, 1.2, 1.1, 1.0, 0.9, 0.8, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.175, 0.15,
           0.125, 0.1, 0.08, 0.06, 0.05]
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: strata above which the cutoff table is joined by shuffle, not broadcast
BROADCAST_STRATA = 10_000


def _covered(grams: Column, spans: int) -> Column:
    """Words covered by the windows of ``grams`` that occur twice or more."""
    placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    last = F.size("_sorted")
    same = lambda k, g: F.coalesce(F.get("_sorted", k)["g"] == g, F.lit(False))
    repeated = F.filter("_sorted", lambda x, k: (((k > 0) & same(k - 1, x["g"]))
                                                 | ((k + 1 < last) & same(k + 1, x["g"]))))
    starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    zero = F.struct(F.lit(-spans).alias("at"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate(starts, zero, lambda a, x: F.struct(
        x.alias("at"), (a["n"] + F.least(F.lit(spans), x - a["at"])).alias("n")))["n"]
    return placed, total


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the metrics, base_failed and the rules' shares (replacing columns of these names)."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACE))
    df = docs.drop(*(c for c in METRICS + RULES + ["base_failed"] if c != text))
    df = df.withColumns({
        "_words": F.when(trimmed == "", F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")),
        "_lines": F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
        "word_chars": F.length(F.translate(t, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long"),
        "_upper": F.length(F.regexp_replace(t, "[^\\p{Lu}]+", "")),
    })
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "_h": F.transform("_words", lambda w: F.xxhash64(w)),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    n = F.size("_h")
    df = df.withColumn("_zip", F.slice(F.arrays_zip(F.col("_h").alias("a"), F.slice("_h", 2, n).alias("b"),
                                                    F.slice("_h", 3, n).alias("c")), 1, F.greatest(n - 2, F.lit(0))))
    df = df.withColumn("_grams", F.transform("_zip", lambda x: F.xxhash64(x["a"], x["b"], x["c"])))
    df = df.withColumn("_some", F.size(F.array_distinct("_grams")) < F.size("_grams"))
    placed, total = _covered(F.col("_grams"), 3)
    df = df.withColumn("_sorted", F.when(F.col("_some"), placed))
    df = df.withColumn("n_repeat_words", F.when(F.col("_some"), total).otherwise(F.lit(0).cast("long")))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    df = df.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbol_share": share(F.col("n_symbols"), F.col("word_chars")),
        "upper_share": share(F.col("_upper"), F.col("word_chars")),
        "repeat_share": share(F.col("n_repeat_words"), F.col("n_words")),
        "dup_line_share": share(F.col("n_dup_lines"), F.size("_lines")),
    })
    return df.drop("_words", "_lines", "_upper", "_h", "_zip", "_grams", "_some", "_sorted")


def _ln_factorial(x: Column) -> Column:
    d = x.cast("double")
    series = d * F.ln(d) - d + 0.5 * F.ln(2 * math.pi * d) + 1 / (12 * d) - 1 / (360 * d * d * d) + \
        1 / (1260 * d * d * d * d * d)
    return F.when(x <= 20, F.ln(F.factorial(F.least(x, F.lit(20)).cast("int")))).otherwise(series)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), for k up to the mean.

    The terms rise up to k there, so the sum runs from the largest term down;
    terms more than 12 square roots of n below it are under double precision.
    """
    steps = F.least(k, (12 * F.sqrt(n.cast("double")) + 200).cast("long"))
    top = _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    down = F.aggregate(F.when(steps > 0, F.sequence(F.lit(0).cast("long"), steps - 1)).otherwise(F.array().cast("array<bigint>")),
                       zero, lambda a, j: F.struct(
        (a["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)).alias("term"),
        (a["sum"] + a["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)).alias("sum")))["sum"]
    return F.exp(top) * down


def joint_path(factors: list[float] = FACTORS, units: dict[str, float] = UNITS) -> list[dict[str, float]]:
    """The rules' cutoffs step by step; no rule's cutoff rises from one step to the next."""
    return [{r: f * units[r] for r in RULES} for f in sorted(factors, reverse=True)]


def cutoffs(measured: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", stratum: str = "lang",
            label: str = "quality", alpha: float = 0.05, delta: float = 0.05,
            path: list[dict[str, float]] | None = None) -> DataFrame:
    """(stratum, step, cutoffs map<rule, cutoff>, n_good, false_rejections): what the labelled rows certify.

    ``measured`` is the result of ``with_metrics``; label 1 is good, 0 bad.
    """
    path = joint_path() if path is None else path
    steps = F.array(*[F.struct(*[F.lit(p[r]).alias(r) for r in RULES]) for p in path])
    good = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).alias("lo"), F.max(label).alias("hi")) \
        .where("lo = hi").select("_id", F.col("hi").alias("good"))
    rejects = lambda p: reduce(or_, [F.col(r) > p[r] for r in RULES])
    # a row that a step rejects is rejected by all later ones: the number of steps says which
    rows = measured.where(~F.col("base_failed")).select(
        F.col(doc_id).alias("_id"), F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("\0")).alias("stratum"),
        F.size(F.filter(steps, rejects)).alias("level"))
    counts = written(rows.join(good, "_id").groupBy("stratum", "level").agg(
        F.sum((F.col("good") == 1).cast("long")).alias("good"), F.sum((F.col("good") == 0).cast("long")).alias("bad")), "levels")
    strata = counts.agg(F.count_distinct("stratum")).first()[0]
    # at most len(path) + 1 levels a stratum
    held = counts.groupBy("stratum").agg(F.collect_list(F.struct("level", "good", "bad")).alias("at"),
                                         F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
    tests = held.select("*", F.posexplode(steps).alias("step", "limits"))
    reached = lambda what: F.aggregate(
        F.filter("at", lambda x: x["level"] >= len(path) - F.col("step")), F.lit(0).cast("long"),
        lambda a, x: a + x[what])
    tests = tests.withColumns({"k": reached("good"), "hit": reached("bad")})
    passed = (F.col("k") <= F.col("n_good") * alpha) & (F.col("n_good") > 0) & \
        (binomial_cdf(F.col("k"), F.col("n_good"), alpha) <= delta / max(strata, 1))
    in_order = W.partitionBy("stratum").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    certified = tests.withColumn("ok", F.min(passed.cast("int")).over(in_order)).where("ok = 1")
    gain = F.col("hit") / F.greatest(F.col("n_bad"), F.lit(1)) - F.col("k") / F.col("n_good")
    best = certified.groupBy("stratum").agg(
        F.max_by(F.struct("step", "limits", "n_good", "k"), F.struct(gain, -F.col("step"))).alias("x"))
    return best.select("stratum", "x.step", F.create_map(*[c for r in RULES for c in (F.lit(r), F.col(f"x.limits.{r}"))])
                       .alias("cutoffs"), "x.n_good", F.col("x.k").alias("false_rejections"))


def judge(measured: DataFrame, limits: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured`` with ``kept``: passes the base rule and every certified cutoff."""
    small = limits.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    limits = limits.select("stratum", "cutoffs")
    joined = measured.withColumn("_stratum", F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("\0"))).join(
        F.broadcast(limits) if small else limits, F.col("_stratum") == limits["stratum"], "left")
    over = None
    for r in RULES:
        hit = F.coalesce(F.col(r) > F.col("cutoffs")[r], F.lit(False))
        over = hit if over is None else over | hit
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("_stratum", "stratum", "cutoffs")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every document; the texts are read once."""
    measured = written(with_metrics(docs.select("doc_id", "lang", "text")).drop("text"), "quality")
    limits = written(cutoffs(measured, labels), "cutoffs")
    return judge(measured, limits).select("doc_id", *METRICS, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns."""
    names = [f"_in{i}" for i in range(len(docs.columns))]       # no clash with a metric's name
    of = dict(zip(docs.columns, names))
    measured = written(with_metrics(docs.toDF(*names), of["text"]), "quality-docs")
    limits = written(cutoffs(measured, labels, doc_id=of["doc_id"], stratum=of["lang"]), "cutoffs")
    return judge(measured, limits, of["lang"]).where("kept").select(*names).toDF(*docs.columns)
