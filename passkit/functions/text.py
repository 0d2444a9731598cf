"""String helpers with Python semantics, as Spark SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.isspace() accepts -- ASCII
# whitespace, the separators U+001C..U+001F, NEL, and Unicode category Z.
PY_SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]"
PY_SPACE_DUCK = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\pZ]"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: Spark's ``trim`` only removes spaces."""
    return F.regexp_replace(c, f"^{PY_SPACE}+|{PY_SPACE}+\\z", "")


def sql_strip(expr: str) -> str:
    """The same strip for DuckDB (RE2)."""
    return f"regexp_replace({expr}, '^{PY_SPACE_DUCK}+|{PY_SPACE_DUCK}+$', '', 'g')"


def word_count(c: Column) -> Column:
    """``len(text.split())``: 0 for empty or blank text."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), f"{PY_SPACE}+"), lambda t: t != ""))


def sql_word_count(expr: str) -> str:
    return f"len(list_filter(regexp_split_to_array(coalesce({expr}, ''), '{PY_SPACE_DUCK}+'), lambda t: t <> ''))"
