"""Tolerant deep equality between typed columns (the test checker's rule).

Restated on Spark types, decided at plan time from the two columns' data
types, so the whole comparison is one Catalyst expression:

* NULL equals NULL and nothing else;
* text compares by value (its UTF-8 bytes are equal iff the strings are);
* numbers compare by value: integers and decimals exactly, as DOUBLE if one
  side is a float; a boolean equals the number 1/0 (as in Python); NaN never
  equals NaN;
* arrays (Python lists and tuples alike) must have equal length and
  pairwise equal elements, recursively;
* maps compare entry by entry after sorting by key (the original compared
  only key lists when values differed; we compare values);
* structs compare field by field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


_FLOATS = (T.FloatType, T.DoubleType)


def _is_num(t: T.DataType) -> bool:
    return isinstance(t, _NUMERIC) or isinstance(t, T.BooleanType)


def _num(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.BooleanType):
        return c.cast("int").cast("double")
    return c.cast("double")


def _digits(t: T.DataType) -> tuple[int, int]:
    """Digits before and after the point that hold every value of an exact type."""
    if isinstance(t, T.DecimalType):
        return t.precision - t.scale, t.scale
    return {T.BooleanType: 1, T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}[type(t)], 0


def _exact(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Integers, decimals and booleans in a type that holds both; whole and fraction apart where none does."""
    a, b = (x.cast("int") if isinstance(t, T.BooleanType) else x for x, t in ((a, ta), (b, tb)))
    (wa, fa), (wb, fb) = _digits(ta), _digits(tb)
    whole, part = max(wa, wb), max(fa, fb)
    if not part:
        return a.cast(f"decimal({whole},0)") == b.cast(f"decimal({whole},0)")
    if whole + part <= 38:
        return a.cast(f"decimal({whole + part},{part})") == b.cast(f"decimal({whole + part},{part})")
    fraction = [(x % F.lit(1)).cast(f"decimal(38,{min(part, 37)})") if f else F.lit(0) for x, f in ((a, fa), (b, fb))]
    return (F.floor(a).cast(f"decimal({whole},0)") == F.floor(b).cast(f"decimal({whole},0)")) & (fraction[0] == fraction[1])


def _by_key(m: Column) -> Column:
    """Entries in the order of their keys; values need not be orderable."""
    return F.array_sort(F.map_entries(m), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))


def _eq(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Non-null-aware core; the caller wraps the NULL rule around it."""
    if _is_num(ta) and _is_num(tb):
        if not isinstance(ta, _FLOATS) and not isinstance(tb, _FLOATS):
            return _exact(a, ta, b, tb)
        x, y = _num(a, ta), _num(b, tb)
        return (x == y) & ~F.isnan(x) & ~F.isnan(y)
    if isinstance(ta, T.StringType) and isinstance(tb, T.StringType):
        return a == b
    if isinstance(ta, T.BinaryType) or isinstance(tb, T.BinaryType):
        return a.cast("binary") == b.cast("binary")
    if isinstance(ta, T.ArrayType) and isinstance(tb, T.ArrayType):
        ea, eb = ta.elementType, tb.elementType
        pairs = F.zip_with(a, b, lambda x, y: smart_equal_typed(x, ea, y, eb))
        return (F.size(a) == F.size(b)) & F.aggregate(pairs, F.lit(True), lambda acc, v: acc & v)
    if isinstance(ta, T.MapType) and isinstance(tb, T.MapType):
        sa, sb = _by_key(a), _by_key(b)
        et_a = T.StructType([T.StructField("key", ta.keyType), T.StructField("value", ta.valueType)])
        et_b = T.StructType([T.StructField("key", tb.keyType), T.StructField("value", tb.valueType)])
        return _eq(sa, T.ArrayType(et_a), sb, T.ArrayType(et_b))
    if isinstance(ta, T.StructType) and isinstance(tb, T.StructType):
        if len(ta.fields) != len(tb.fields):
            return F.lit(False)
        out = F.lit(True)
        for fa, fb in zip(ta.fields, tb.fields):
            out = out & smart_equal_typed(a[fa.name], fa.dataType, b[fb.name], fb.dataType)
        return out
    # incomparable kinds (text vs number, list vs scalar ...) are unequal
    return F.lit(False)


def smart_equal_typed(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    both_null = a.isNull() & b.isNull()
    one_null = a.isNull() | b.isNull()
    return F.when(both_null, F.lit(True)).when(one_null, F.lit(False)).otherwise(
        F.coalesce(_eq(a, ta, b, tb), F.lit(False)))


def smart_equal(df, a: str, b: str) -> Column:
    """Equality column for columns ``a`` and ``b`` of ``df`` (types read from its schema)."""
    ta, tb = df.schema[a].dataType, df.schema[b].dataType
    return smart_equal_typed(F.col(a), ta, F.col(b), tb)


def as_set(c: Column) -> Column:
    """A Python set restated on arrays: order and repeats do not matter."""
    return F.array_sort(F.array_distinct(c))
