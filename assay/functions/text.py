"""Text functions: folding, blank tests, guards and lookups, all as built-in Spark expressions unless said otherwise."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, StringType

#: A number as text, for columns where a dirty value must not be taken for one ("1d", "1_0").
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"

# Names of tables that systems create for themselves.
SYSTEM_NAMES = (r"^GDB_", r"^UN_\d+_", r"^UN_Temp", r"^[ABC]_", r"^_Version$", r"__ATTACH$", r"^T_\d+_", r"^N_\d+_", r"^view_UN_", r"^gpkg_", r"^rtree_", r"^sqlite_")

# Texts that stand for a text that nobody has written yet.
PLACEHOLDER = r"(?i)REQUIRED:|There is no description|No description available|^\s*(none|n/?a|tbd|todo)\s*$"

# Words in a name that tell its utility domain; the first domain with a word in it wins.
DOMAIN_WORDS = {
    "stormwater": ("storm",),
    "sewer": ("sewer", "sanitary", "wastewater"),
    "water": ("water",),
    "electric": ("electric", "transmission", "distribution", "power"),
    "gas": ("gas", "pipeline", "updm"),
    "communications": ("communication", "telecom", "fiber"),
    "district_energy": ("districtenergy", "district_energy", "district energy", "steam"),
}

_NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def ws_trim(c: Column) -> Column:
    """Without leading and trailing white space of any kind (trim() takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def as_text(c: Column, kind: DataType | None = None) -> Column:
    """c as text; bytes are read as UTF-8."""
    return F.make_valid_utf8(c.cast("string")) if kind is not None and kind.typeName() == "binary" else c.cast("string")


def is_null(c: Column, kind: DataType | None = None) -> Column:
    """Null, or NaN in a floating column."""
    return c.isNull() | F.isnan(c) if isinstance(kind, FloatType | DoubleType) else c.isNull()


def blank(c: Column, kind: DataType | None = None) -> Column:
    """Null, NaN, or a text that is empty, ``None`` or ``nan`` once trimmed."""
    return is_null(c, kind) | F.coalesce(ws_trim(as_text(c, kind)).isin("", "None", "nan"), F.lit(False))


def guid(c: Column) -> Column:
    """Upper case, without white space and braces around it."""
    return F.btrim(ws_trim(F.upper(c)), F.lit("{}"))


def number(c: Column) -> Column:
    """A double, or null where the text is not a number."""
    text = c.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(ws_trim(text)).try_cast("double"))


def name_fold(c: Column) -> Column:
    """Lower-case letters and digits only; whole numbers lose their fraction (``1.0`` is ``1``); null and zero are empty."""
    value, text = number(c), c.cast("string")
    whole = value.isNotNull() & (value == F.floor(value)) & (F.abs(value) < 1e15)
    folded = F.when(whole, value.cast("long").cast("string")).otherwise(F.regexp_replace(F.lower(text), "[^a-z0-9]+", ""))
    return F.coalesce(F.when(value == 0, "").otherwise(folded), F.lit(""))


def html_clean(c: Column) -> Column:
    """The text of an HTML fragment: the commonest entities decoded, tags blanked, white space collapsed."""
    for entity, char in _NAMED:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return ws_trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def html_unescape(c: pd.Series) -> pd.Series:
    """All named and numeric entities decoded (Spark has no built-in for the whole table)."""
    return c.map(html.unescape, na_action="ignore")


def rule_key(c: Column) -> Column:
    """A message without its numbers, so that it keeps its key when only counts change."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"\d[\d,.\x{a0}]*", "#")
    return F.substring(F.lower(ws_trim(F.regexp_replace(text, r"(?U)\s+", " "))), 1, 300)


def csv_safe(c: Column) -> Column:
    """A cell that a spreadsheet will not run as a formula; null is empty."""
    text = c.cast("string")
    real = text.rlike(r"(?i)^\s*[+-]?((\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$")
    return F.coalesce(F.when(text.rlike("^[=+\\-@\\t\\r]") & ~real, F.concat(F.lit("'"), text)).otherwise(text), F.lit(""))


def type_family(c: Column) -> Column:
    """int, float, date, guid or text; any other type's own name, ``?`` for none."""
    low = F.lower(F.coalesce(c.cast("string"), F.lit("")))

    def has(*words: str) -> Column:
        return low.rlike("|".join(words))

    return (
        F.when(has("integer", "int16", "int32", "int64"), "int").when(has("double", "single", "float", "real"), "float").when(has("date", "time"), "date")
        .when(has("guid", "globalid"), "guid").when(has("str", "object"), "text").when(low == "", "?").otherwise(low)
    )


def domain_guess(c: Column) -> Column:
    """The utility domain that a name suggests, or null."""
    low = F.lower(c)
    out = F.lit(None).cast("string")
    for name, words in reversed(DOMAIN_WORDS.items()):
        hit = low.rlike("|".join(words))
        if name == "water":
            hit = hit & ~low.rlike("storm|waste|sewer")
        out = F.when(hit, name).otherwise(out)
    return out


def is_system(c: Column) -> Column:
    return c.rlike("(?i)" + "|".join(SYSTEM_NAMES))


def is_placeholder(c: Column) -> Column:
    return F.coalesce(c.rlike(PLACEHOLDER), F.lit(False))


def short_name(c: Column) -> Column:
    """What follows the last dot."""
    return F.element_at(F.split(c, r"\."), -1)


def path_tail(c: Column, parts: int = 3) -> Column:
    """The last components of a path."""
    split = F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    return F.array_join(F.slice(split, F.greatest(F.size(split) - parts + 1, F.lit(1)), F.lit(parts)), "/")


def parse_dates(c: Column) -> Column:
    """A timestamp without zone from a dirty text: as it is, or from its first 19 characters; null if neither is one."""
    text = ws_trim(c.cast("string"))
    short = F.substring(F.replace(text, F.lit(" "), F.lit("T")), 1, 19)
    return F.coalesce(text.try_cast("timestamp_ntz"), short.try_cast("timestamp_ntz"))
