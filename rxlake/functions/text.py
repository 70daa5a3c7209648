"""Text functions as ``Column -> Column`` expressions (no UDFs).

Every function stays JVM-side so it fuses into whole-stage codegen.  Regex
classes are spelled out so the same pattern means the same thing in Spark
(Java regex) and in the DuckDB oracle (RE2), see ``WS`` below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rxlake import fixed_values as FV

# Python's str.isspace() set: ASCII controls 0x09-0x0D, 0x1C-0x1F, space,
# NEL, NBSP and the Unicode space separators.  Java's plain \s misses most of
# them and RE2's \s is ASCII only, so the class is written out.  The same
# text works in Java regex and in RE2.
WS_CHARS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS = "[" + WS_CHARS + "]"
# The same set as literal characters, for trim(): stripping with a character
# set is a linear scan from both ends instead of a regex search of the text.
WS_SET = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
          + "".join(chr(c) for c in range(0x2000, 0x200B))
          + "\u2028\u2029\u202f\u205f\u3000")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """strip leading/trailing Unicode whitespace (Python ``str.strip``)."""
    return F.trim(col_(c), F.lit(WS_SET))


def collapse_ws(c) -> Column:
    """Runs of whitespace -> one space, then strip."""
    return ustrip(F.regexp_replace(col_(c), f"{WS}+", " "))


def fold_ascii(c) -> Column:
    """ASCII-only case folding, the way a SQLite LIKE compares."""
    return F.translate(col_(c), _UPPER, _LOWER)


def clean_text(c) -> Column:
    """null -> "", strip, tags -> space, named entities -> space,
    collapse whitespace, strip, null words -> ""."""
    s = ustrip(F.coalesce(col_(c).cast("string"), F.lit("")))
    s = F.regexp_replace(s, "<[^>]+>", " ")          # F1a
    s = F.regexp_replace(s, "&[a-zA-Z]+;", " ")      # F1b
    s = collapse_ws(s)                                # F1c
    # F1d, by a one-element transform: both uses read the text that is cleaned once
    return F.get(F.transform(F.array(s), lambda x: F.when(F.lower(x).isin(FV.NULL_WORDS), F.lit("")).otherwise(x)), F.lit(0))


def blank_nan(c) -> Column:
    """null -> "", to string, strip, exact "nan" -> ""."""
    s = ustrip(F.coalesce(col_(c).cast("string"), F.lit("")))
    return F.when(s == "nan", F.lit("")).otherwise(s)


def na_words_to_null(c) -> Column:
    """pandas' default NA words become null (raw CSV fields only)."""
    c = col_(c)
    return F.when(c.isin(FV.PANDAS_NA_WORDS), F.lit(None).cast("string")).otherwise(c)


NUMBER_RE = rf"^{WS}*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?{WS}*$"


def to_number(c) -> Column:
    """numeric coercion, anything not a plain decimal number -> 0.0.

    The guard keeps Spark's lenient casts ("1.0d", "1f") out; ``nan`` and
    ``inf`` also go to 0.0 (see README, deviations).
    """
    c = col_(c).cast("string")
    v = F.when(c.rlike(NUMBER_RE), ustrip(c).try_cast("double"))
    return F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))


def to_text(c) -> Column:
    """any column -> trimmed text, null -> ""."""
    return ustrip(F.coalesce(col_(c).cast("string"), F.lit("")))


def nonempty(c) -> Column:
    """"" -> null, so concat_ws skips the part."""
    c = col_(c)
    return F.when(c != "", c)


def labelled(label: str, c) -> Column:
    c = col_(c)
    return F.when(c != "", F.concat(F.lit(label), c))


def catalogue_document(name, company, shape, color1, color2, print_front,
                       print_back, otc, chartn) -> Column:
    """F8: name, then labelled optional parts, joined by " | "."""
    colors = F.concat_ws(" ", nonempty(color1), nonempty(color2))      # F8a
    prints = F.concat_ws(" ", nonempty(print_front), nonempty(print_back))
    return F.concat_ws(
        FV.CAT_DOC_SEP,
        col_(name),
        labelled(FV.CAT_LABEL_COMPANY, company),
        labelled(FV.CAT_LABEL_SHAPE, shape),
        labelled(FV.CAT_LABEL_COLOR, colors),
        labelled(FV.CAT_LABEL_PRINT, prints),
        nonempty(otc),
        nonempty(chartn),
    )


def leaflet_document(name, parts: list) -> Column:
    """"약품명: name" then up to seven labelled parts.

    ``parts`` is a list of Columns in the order of ``LEAFLET_PARTS``.
    """
    labelled_parts = [labelled(label, c) for (_, label), c in zip(FV.LEAFLET_PARTS, parts)]
    return F.concat_ws(FV.CAT_DOC_SEP, F.concat(F.lit(FV.LEAFLET_NAME_LABEL), col_(name)),
                       *labelled_parts)


def leaflet_id(key) -> Column:
    """F10."""
    return F.concat(F.lit(FV.LEAFLET_ID_PREFIX), col_(key))


def tokens(c) -> Column:
    """whitespace tokens in order (Python ``str.split()``); the empty
    pieces a leading or trailing run leaves are filtered out."""
    parts = F.split(F.coalesce(col_(c), F.lit("")), f"{WS}+")
    return F.filter(parts, lambda w: w != "")


def capitalised_tokens(c) -> Column:
    """Tokens whose first character is an upper-case letter, in order; one
    regex pass over the text (a token is a maximal run of non-space)."""
    return F.regexp_extract_all(F.concat(F.lit(" "), F.coalesce(col_(c), F.lit(""))),
                                F.lit(f"{WS}(\\p{{Lu}}[^{WS_CHARS}]*)"), 1)


def long_tokens(c, min_len: int = FV.MIN_TOKEN_LEN) -> Column:
    """F11 + P17: tokens of at least ``min_len`` characters."""
    return F.filter(tokens(c), lambda w: F.length(w) >= min_len)


def prefix(c, n: int = FV.PREFIX_LEN) -> Column:
    """first ``n`` characters (all of a shorter name)."""
    return F.substring(col_(c), 1, n)


def contains_text(text, part) -> Column:
    """case-sensitive containment; an empty part is always contained."""
    return F.contains(col_(text), col_(part))


# Python's \w plus whitespace, Hangul and "?!.,~" survive; everything else goes.
SPEECH_DROP_RE = r"[^\p{L}\p{N}_" + WS_CHARS + r"?!.,~]"


def speech_text(c) -> Column:
    """F14 (after F3): keep letters, digits, "_", whitespace and ?!.,~."""
    return F.regexp_replace(col_(c), SPEECH_DROP_RE, "")


def contains_any(c, terms: list) -> Column:
    """The text contains any of ``terms`` (case-sensitive)."""
    c = col_(c)
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(c, F.lit(t))
    return F.coalesce(out, F.lit(False))


def alarm_message(name, time_hhmm) -> Column:
    """F16."""
    return F.concat(col_(name), F.lit(FV.ALARM_MSG_MIDDLE), col_(time_hhmm),
                    F.lit(FV.ALARM_MSG_END))


def context_line_search(name, company, shape, color1, description) -> Column:
    """F15, vector-search layout."""
    e = lambda c: F.coalesce(col_(c), F.lit(""))
    return F.concat(F.lit("- "), e(name), F.lit(" ("), e(company), F.lit(") | "), e(shape),
                    F.lit(" | "), e(color1), F.lit("\n" + FV.CONTEXT_DESC_LABEL), e(description),
                    F.lit("\n"))


def context_line_table(name, company, shape, color1, otc, description) -> Column:
    """F15, catalogue-table layout."""
    e = lambda c: F.coalesce(col_(c), F.lit(""))
    return F.concat(F.lit("- "), e(name), F.lit(" ("), e(company), F.lit(") | "), e(shape),
                    F.lit(" | "), e(color1), F.lit(" | "), e(otc),
                    F.lit("\n" + FV.CONTEXT_DESC_LABEL), e(description), F.lit("\n"))
