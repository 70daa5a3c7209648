"""JSON, array and struct helpers (N1-N9), JVM-side.

Strictness follows Python's ``json.loads`` (SURVEY D6): single quotes, comments,
leading zeros, raw control characters and any text after the first complete value
are errors; of a repeated key the last counts; ``NaN``, ``Infinity`` and ``-Infinity``
are numbers.  One deviation remains: where the field's own value holds an object with
a repeated key, the text is an ``error`` even if a later repeat of the field is a
proper list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxlake.functions.text import col_

OUTER_OBJECT_RE = r"(?s)\{.*\}"


def outer_object(c) -> Column:
    """Greedy first-``{`` to last-``}`` cut, across lines; "" = no match."""
    return F.regexp_extract(col_(c), OUTER_OBJECT_RE, 0)


_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true", "columnNameOfCorruptRecord": "_corrupt"}


def _object_field(c: Column, field: str) -> tuple[Column, Column]:
    """Of a text that starts with ``{``: ``struct(v struct(field variant), _corrupt)`` and
    whether the text is *one* value.

    The parser stops after the first complete value.  So the text is parsed as the only field of
    ``{"v": ...}`` and again as the only element of a list there: what could follow the value in
    one of them is an error in the other.  A parse by schema takes the last of a repeated key
    and skips what the schema does not name.
    """
    parsed = F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), f"v struct<`{field}`: variant>, _corrupt string", _JSON)
    listed = F.from_json(F.concat(F.lit('{"v":['), c, F.lit("]}")), f"v array<struct<`{field}`: variant>>, _corrupt string", _JSON)
    # the parser also takes INF and a plus sign for numbers: looked for outside quoted strings
    bare = F.regexp_replace(c, r'"(?:[^"\\]|\\.)*+"', '""')
    foreign = c.rlike(r"INF|\+I") & bare.rlike(r"INF|\+I")
    return parsed, listed["_corrupt"].isNull() & ~foreign


def _names_and_error(parsed: Column, single: Column, field: str) -> tuple[Column, Column]:
    """The field as a list of strings.  A missing field gives ``[]``
    (``.get(field, [])``); one that is not a list of non-null strings is an error."""
    value = parsed["v"][field]
    arr = F.try_variant_get(value, "$", "array<string>")
    good = F.schema_of_variant(value).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(arr, lambda x: x.isNull())
    names = F.when(value.isNull(), F.array().cast("array<string>")).when(good, arr)
    valid = single & parsed["_corrupt"].isNull() & parsed["v"].isNotNull()
    return names, ~F.coalesce(valid & (value.isNull() | good), F.lit(False))


def parse_name_list(reply, field: str = "medicines"):
    """N1+N2+N3 on a model reply.  Returns ``(status, names)`` where status is
    ``no_json`` (no braces: empty result, no error), ``error`` (not exactly
    one valid object, or a bad field) or ``ok``."""
    cut = outer_object(reply)
    names, bad = _names_and_error(*_object_field(cut, field), field)
    status = F.when(cut == "", F.lit("no_json")).when(bad, F.lit("error")).otherwise(F.lit("ok"))
    return status, F.when(status == "ok", names).otherwise(F.array().cast("array<string>"))


def with_name_list(df: DataFrame, reply, field: str = "medicines", keep: list | None = None) -> DataFrame:
    """``parse_name_list`` as staged projections: the cut, the parsed value
    and the field each become a column once.  Catalyst does not inline a
    non-trivial expression that a later projection reads twice, so each JSON
    text is parsed once, where the nested ``Column`` form re-evaluates the
    parse in every branch that reads it.  Adds ``status`` and ``names`` to
    the ``keep`` columns (default: all of ``df``)."""
    keep = list(df.columns) if keep is None else keep
    d = df.select(*keep, outer_object(reply).alias("_cut"))
    parsed, single = _object_field(F.col("_cut"), field)
    d = d.select(*keep, "_cut", parsed.alias("_parsed"), single.alias("_single"))
    names, bad = _names_and_error(F.col("_parsed"), F.col("_single"), field)
    d = d.select(*keep, "_cut", names.alias("_names"), bad.alias("_bad"))
    status = F.when(F.col("_cut") == "", F.lit("no_json")).when(F.col("_bad"), F.lit("error")).otherwise(F.lit("ok"))
    d = d.select(*keep, "_names", status.alias("status"))
    return d.select(*keep, "status", F.when(F.col("status") == "ok", F.col("_names"))
                    .otherwise(F.array().cast("array<string>")).alias("names"))


OCR_SCHEMA = "IsErroredOnProcessing boolean, ParsedResults array<struct<ParsedText: string>>"


def ocr_text(response) -> Column:
    """Errored -> "", else the first result's text, default ""."""
    r = F.from_json(col_(response), OCR_SCHEMA)
    first = F.try_element_at(r["ParsedResults"], F.lit(1))
    return F.when(F.coalesce(r["IsErroredOnProcessing"], F.lit(False)), F.lit("")) \
            .otherwise(F.coalesce(first["ParsedText"], F.lit("")))


def ordered_concat(items: Column, sep: str = "␞") -> Column:
    """Render an array of ``struct(pos, value)`` as one string in ``pos`` order
    (for hashing and display)."""
    return F.concat_ws(sep, F.transform(F.array_sort(items), lambda s: s.getField("value")))


def prompt_messages(system: Column, history: Column, user: Column) -> Column:
    """``[system, *history, user]`` as ``array<struct<role, content>>``."""
    sys_m = F.struct(F.lit("system").alias("role"), system.alias("content"))
    usr_m = F.struct(F.lit("user").alias("role"), user.alias("content"))
    return F.concat(F.array(sys_m), history, F.array(usr_m))
