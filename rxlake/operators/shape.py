"""Projections, renames, filters and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxlake.functions import text as T


def normalize_headers(df: DataFrame, upper: bool = True, strip: bool = True) -> DataFrame:
    """Header names upper-cased and stripped."""
    names = []
    for c in df.columns:
        n = c.strip() if strip else c
        names.append(n.upper() if upper else n)
    return df.toDF(*names)


def rename_positional(df: DataFrame, names: list) -> DataFrame:
    """Rename by position; a different column count is an error."""
    if len(df.columns) != len(names):
        raise ValueError(f"expected {len(names)} columns, found {len(df.columns)}")
    return df.toDF(*names)


def keep_columns(df: DataFrame, cols: list, extra: list | None = None,
                 fill: str = "") -> DataFrame:
    """Keep a fixed list, missing columns become ``fill``."""
    present = set(df.columns)
    sel = [F.col(f"`{c}`") if c in present else F.lit(fill).alias(c) for c in cols]
    sel += [F.col(f"`{c}`") for c in (extra or [])]
    return df.select(*sel)


def map_columns(df: DataFrame, mapping, fill: str = "") -> DataFrame:
    """Target <- source; a tuple source means first non-empty of them;
    an absent source becomes ``fill``."""
    present = set(df.columns)
    items = mapping.items() if isinstance(mapping, dict) else mapping

    def src(c):
        return F.col(f"`{c}`") if c in present else F.lit(fill)

    sel = []
    for target, source in items:
        if isinstance(source, tuple):
            sel.append(first_nonempty(*[src(s) for s in source]).alias(target))
        else:
            sel.append(src(source).alias(target))
    return df.select(*sel)


def select_strict(df: DataFrame, mapping) -> DataFrame:
    """Missing column is an error (the analyzer raises)."""
    items = mapping.items() if isinstance(mapping, dict) else mapping
    return df.select(*[F.col(f"`{s}`").alias(t) for t, s in items])


def first_nonempty(*cols) -> Column:
    """P5: ``str(a) or str(b)``: first value that is not empty."""
    parts = [F.when(T.col_(c) != "", T.col_(c)) for c in cols[:-1]]
    return F.coalesce(*parts, F.coalesce(T.col_(cols[-1]), F.lit("")))


def with_constants(df: DataFrame, consts: dict) -> DataFrame:
    """Constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in consts.items()})


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    """Drop rows whose value is ""."""
    return df.where(F.col(f"`{col}`") != "")


def longer_than(df: DataFrame, col: str, n: int) -> DataFrame:
    """Keep rows whose text is longer than ``n`` characters."""
    return df.where(F.length(F.col(f"`{col}`")) > n)


def drop_blank_text(df: DataFrame, col: str) -> DataFrame:
    """Drop rows whose text is blank after stripping."""
    return df.where(T.ustrip(F.coalesce(F.col(f"`{col}`"), F.lit(""))) != "")


def has_any_argument(*args) -> Column:
    """At least one non-empty argument."""
    return reduce(lambda a, b: a | b,
                  [F.coalesce(T.col_(a) != "", F.lit(False)) for a in args])


def union_by_name(dfs: list) -> DataFrame:
    """Union over differing schemas, by column name."""
    if not dfs:
        raise ValueError("nothing to combine")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
