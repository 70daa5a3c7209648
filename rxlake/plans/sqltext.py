"""DuckDB spellings of the text functions, for the oracle SQL.

Each helper returns a SQL expression string that computes what the Column
function of the same name in ``rxlake.functions.text`` computes.
"""

from __future__ import annotations

from rxlake import fixed_values as FV

# Written out here, not imported from the engine, so that a wrong pattern there
# differs from the oracle's.  White space is the set of Python's str.isspace().
_SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
           0x205F, 0x3000]
WS_SET = "".join(map(chr, _SPACES))
WS_CHARS = "".join(f"\\x{{{c:X}}}" for c in _SPACES)
WS = f"[{WS_CHARS}]"
# digits with an optional point and exponent, blanks around; kept in speech: letters, numbers, "_", blanks, ?!.,~
NUMBER_RE = f"^{WS}*[-+]?(?:\\d+(?:\\.\\d*)?|\\.\\d+)(?:[eE][-+]?\\d+)?{WS}*$"
SPEECH_DROP_RE = f"[^_?!.,~\\p{{L}}\\p{{N}}{WS_CHARS}]"

UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LO = "abcdefghijklmnopqrstuvwxyz"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def ustrip(x: str) -> str:
    return f"trim({x}, {q(WS_SET)})"


def collapse_ws(x: str) -> str:
    return ustrip(f"regexp_replace({x}, {q(WS + '+')}, ' ', 'g')")


def fold(x: str) -> str:
    return f"translate({x}, '{UP}', '{LO}')"


def blank_nan(x: str) -> str:
    s = ustrip(f"coalesce(CAST({x} AS VARCHAR), '')")
    return f"(CASE WHEN {s} = 'nan' THEN '' ELSE {s} END)"


def to_number(x: str) -> str:
    x = f"CAST({x} AS VARCHAR)"
    return (f"coalesce(CASE WHEN regexp_matches({x}, {q(NUMBER_RE)}) "
            f"THEN TRY_CAST({ustrip(x)} AS DOUBLE) END, 0.0)")


def clean_text(x: str) -> str:
    s = ustrip(f"coalesce(CAST({x} AS VARCHAR), '')")
    s = f"regexp_replace({s}, '<[^>]+>', ' ', 'g')"
    s = f"regexp_replace({s}, '&[a-zA-Z]+;', ' ', 'g')"
    s = collapse_ws(s)
    words = ", ".join(q(w) for w in FV.NULL_WORDS)
    return f"(CASE WHEN lower({s}) IN ({words}) THEN '' ELSE {s} END)"


def nonempty(x: str) -> str:
    return f"(CASE WHEN {x} <> '' THEN {x} END)"


def labelled(label: str, x: str) -> str:
    return f"(CASE WHEN {x} <> '' THEN {q(label)} || {x} END)"


def catalogue_document(name, company, shape, c1, c2, pf, pb, otc, chartn) -> str:
    colors = f"concat_ws(' ', {nonempty(c1)}, {nonempty(c2)})"
    prints = f"concat_ws(' ', {nonempty(pf)}, {nonempty(pb)})"
    return (f"concat_ws({q(FV.CAT_DOC_SEP)}, {name}, {labelled(FV.CAT_LABEL_COMPANY, company)}, "
            f"{labelled(FV.CAT_LABEL_SHAPE, shape)}, {labelled(FV.CAT_LABEL_COLOR, colors)}, "
            f"{labelled(FV.CAT_LABEL_PRINT, prints)}, {nonempty(otc)}, {nonempty(chartn)})")


def leaflet_document(name: str, parts: list) -> str:
    lp = ", ".join(labelled(label, p) for (_, label), p in zip(FV.LEAFLET_PARTS, parts))
    return f"concat_ws({q(FV.CAT_DOC_SEP)}, {q(FV.LEAFLET_NAME_LABEL)} || {name}, {lp})"


def tokens(x: str) -> str:
    """list of whitespace tokens (empty list for blank text)."""
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), {q(WS + '+')}), lambda w: w <> '')"


def capitalised_tokens(x: str) -> str:
    return (f"regexp_extract_all(' ' || coalesce({x}, ''), "
            f"{q(WS + '(' + chr(92) + 'p{Lu}[^' + WS_CHARS + ']*)')}, 1)")


def speech_text(x: str) -> str:
    return f"regexp_replace({x}, {q(SPEECH_DROP_RE)}, '', 'g')"


def contains_any(x: str, terms: list) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


def like_contains(name_fold: str, kw_fold: str) -> str:
    """SQLite ``name LIKE '%kw%'`` on folded text: % and _ stay wildcards."""
    return f"({name_fold} LIKE '%' || {kw_fold} || '%')"


def context_line_table(name, company, shape, c1, otc, desc) -> str:
    e = lambda x: f"coalesce({x}, '')"
    return (f"('- ' || {e(name)} || ' (' || {e(company)} || ') | ' || {e(shape)} || ' | ' || "
            f"{e(c1)} || ' | ' || {e(otc)} || {q(chr(10) + FV.CONTEXT_DESC_LABEL)} || {e(desc)} || "
            f"{q(chr(10))})")
