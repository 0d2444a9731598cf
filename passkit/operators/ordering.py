"""Running (prefix) aggregates that stay balanced when one key is huge.

A plain ``Window.partitionBy(key).orderBy(t)`` puts every row of a key in
one task; a key holding a third of the table then decides the job's run
time and memory. Here the order column is cut into blocks of ``width``
consecutive values: per-(key, block) totals are aggregated (map-side
combined), a window over the *block totals* gives each block its offset,
and the row-level window runs per (key, block), so no task sees more than
one block of one key. The result is exact.

``running_sums`` cuts blocks of equal width in the value, which needs no pass
of its own and suits dense ids. ``ranged_sums`` cuts them by sampled range
boundaries over (keys, order), so that a block has about ``rows`` rows
however the values lie: timestamps, sparse ids, text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passkit.session import materialize

DEFAULT_BLOCK_WIDTH = 1 << 16
RANGE_ROWS = 1 << 18  # rows of a range, about


def join_back(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (``<=>``), keeping ``left``'s key columns.

    Aggregations group NULL keys together; joining their results back with
    plain ``=`` would silently drop those rows.
    """
    keys = list(keys)
    if not keys:
        return left.join(right, how=how) if how != "inner" else left.join(right)
    ren = {k: f"_jb_{i}" for i, k in enumerate(keys)}
    r = right.select(*[F.col(c).alias(ren.get(c, c)) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[ren[k]])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*ren.values())


def running_sums(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                 values: Mapping[str, Column], width: int = DEFAULT_BLOCK_WIDTH) -> DataFrame:
    """Add inclusive running sums of ``values`` per ``keys`` in ``order_cols`` order.

    ``order_cols[0]`` is numeric, a timestamp or a date (blocks are cut on
    its epoch value; the original column still orders rows inside a block);
    later order columns only break ties. Each output column is named by its
    ``values`` key.
    """
    keys, order_cols = list(keys), list(order_cols)
    blk = "_pk_block"
    first = F.col(order_cols[0])
    kind = df.schema[order_cols[0]].dataType.typeName()
    if kind == "timestamp":
        first = F.unix_micros(first)
    elif kind == "timestamp_ntz":
        # zone-free epoch at second resolution: a cast to TIMESTAMP would depend on the
        # session zone and is not monotone across DST gaps
        secs = (F.unix_date(F.to_date(first)).cast("long") * 86400 + F.hour(first) * 3600
                + F.minute(first) * 60 + F.second(first))
        first = secs * 1_000_000
    elif kind == "date":
        first = F.unix_date(first)
    # NULL order values sort first, as in a window: they get the lowest block
    base = df.withColumn(blk, F.coalesce(F.floor(first / F.lit(width)), F.lit(-(1 << 62))))
    for name, expr in values.items():
        base = base.withColumn(f"_pk_v_{name}", expr)
    block_totals = base.groupBy(*keys, blk).agg(
        *[F.sum(f"_pk_v_{name}").alias(f"_pk_t_{name}") for name in values])
    earlier = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = block_totals.select(
        *keys, blk,
        *[F.coalesce(F.sum(f"_pk_t_{name}").over(earlier), F.lit(0)).alias(f"_pk_o_{name}")
          for name in values])
    inside = (Window.partitionBy(*keys, blk).orderBy(*order_cols)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = join_back(base, offsets, [*keys, blk])
    for name in values:
        out = out.withColumn(name, F.col(f"_pk_o_{name}") + F.sum(f"_pk_v_{name}").over(inside))
    drop = [blk] + [f"_pk_{p}_{name}" for name in values for p in ("v", "o")]
    return out.drop(*drop)


def row_index(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], name: str = "row_index",
              width: int = DEFAULT_BLOCK_WIDTH) -> DataFrame:
    """0-based position of each row inside its key, in ``order_cols`` order.

    Equals ``row_number() over (partition by keys order by order_cols) - 1``
    when the order columns are unique per key.
    """
    out = running_sums(df, keys, order_cols, {name: F.lit(1)}, width)
    return out.withColumn(name, (F.col(name) - 1).cast("bigint"))


def ranged(df: DataFrame, cols: Sequence[str], rows: int = RANGE_ROWS, name: str = "_range") -> DataFrame:
    """``df`` written in ranges of about ``rows`` rows, ascending in ``cols``, with the number of each row's range.

    Boundaries come from a sample of the rows (Spark's range partitioner). Rows that
    are equal in every column of ``cols`` are dealt over ranges by the split
    they were read from, so that no value makes a range long. The ranges are
    written to the shared folder, so their numbers are facts and not a plan's:
    starts two jobs (count and write).
    """
    n = max(1, -(-df.count() // rows))
    split = f"{name}_split"
    held = df.withColumn(split, F.spark_partition_id()).repartitionByRange(n, *cols, split).drop(split)
    return materialize(held.withColumn(name, F.spark_partition_id()), "ranges")


def ranged_sums(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], values: Mapping[str, Column],
                rows: int = RANGE_ROWS) -> DataFrame:
    """Inclusive running sums of ``values`` per ``keys`` in ``order_cols`` order, as ``running_sums``, over ranges of rows.

    The order columns may be of any type that Spark orders; NULLs sort first.
    Totals per (key, range) are scanned for the offsets (a key has as many as
    the ranges it lies in), and the row-level window runs per (key, range).
    Rows equal in keys and order columns come in any order.
    """
    keys, order_cols = list(keys), list(order_cols)
    rng = "_pk_range"
    held = ranged(df.select("*", *[v.alias(f"_pk_v_{k}") for k, v in values.items()]), [*keys, *order_cols], rows, rng)
    totals = held.groupBy(*keys, rng).agg(*[F.sum(f"_pk_v_{k}").alias(f"_pk_t_{k}") for k in values])
    earlier = Window.partitionBy(*keys).orderBy(rng).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, rng, *[F.coalesce(F.sum(f"_pk_t_{k}").over(earlier), F.lit(0)).alias(f"_pk_o_{k}") for k in values])
    inside = Window.partitionBy(*keys, rng).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = join_back(held, offsets, [*keys, rng])
    for k in values:
        out = out.withColumn(k, F.col(f"_pk_o_{k}") + F.sum(f"_pk_v_{k}").over(inside))
    return out.drop(rng, *[f"_pk_{p}_{k}" for k in values for p in ("v", "o")])


def ranged_index(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], name: str = "row_index",
                 rows: int = RANGE_ROWS) -> DataFrame:
    """0-based position of each row inside its key, as ``row_index``, over ranges of rows."""
    out = ranged_sums(df, keys, order_cols, {name: F.lit(1).cast("bigint")}, rows)
    return out.withColumn(name, F.col(name) - 1)
