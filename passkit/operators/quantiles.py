"""Exact percentiles (linear interpolation at p*(n-1)) without a per-group sort.

``percentile`` keeps every distinct value of a group in one aggregation
buffer, and a window sort keeps every row of a group in one task; with a
group holding a third of the table either one breaks. Here:

1. one aggregation per group: n and a quantile sketch (``percentile_approx``
   with ``accuracy``), both mergeable map-side; its few rows are written to
   the shared folder, so that the planner knows their size;
2. the sketch brackets each target rank: by the sketch's error bound the
   values of ranks lo and lo+1 lie in [q(p - 4/acc), q(p + 4/acc)] once
   n >= accuracy; smaller groups use their full range (at most ``accuracy``
   rows);
3. one pass with the group's brackets beside each row counts, for all
   percentiles at once, the rows below each bracket and the rows per distinct
   value inside one (an aggregation again: a hot value collapses map-side,
   rows are not repeated per percentile and not shuffled before it);
4. a running count over the few bracket values finds the exact values of
   ranks lo and lo+1. A rank outside its bracket raises an error instead of
   giving a near value.

The result equals ``percentile(value, p)`` exactly; a group without a value
has NULL percentiles.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passkit.operators.ordering import join_back
from passkit.session import materialize

DEFAULT_ACCURACY = 100_000


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float],
                      names: Sequence[str] | None = None, accuracy: int = DEFAULT_ACCURACY,
                      extra_aggs: Sequence[Column] = ()) -> DataFrame:
    """Exact ``percentile(value, p)`` per group for every p in ``ps``.

    ``extra_aggs`` (over column ``_v``, the non-null values) are computed in
    the sketch pass and returned alongside, so other statistics of the same
    groups cost no extra scan.
    """
    keys = list(keys)
    names = list(names or [f"p{int(round(p * 100))}" for p in ps])
    eps = 4.0 / accuracy
    lows = [max(0.0, p - eps) for p in ps]
    highs = [min(1.0, p + eps) for p in ps]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    stats = rows.groupBy(*keys).agg(F.count("_v").alias("_n"),
                                    F.percentile_approx("_v", lows + highs, accuracy).alias("_q"),
                                    *extra_aggs)
    extra_names = [c for c in stats.columns if c not in (*keys, "_n", "_q")]
    stats = materialize(stats, "quantile-sketches")
    k = len(ps)
    wide = F.col("_n") < accuracy
    bounds, group = [], []
    for i, p in enumerate(ps):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        bounds += [F.when(wide, F.lit(float("-inf"))).otherwise(F.col("_q")[i]).alias(f"_a{i}"),
                   F.when(wide, F.lit(float("inf"))).otherwise(F.col("_q")[k + i]).alias(f"_b{i}"),
                   F.floor(pos).alias(f"_r{i}"), (pos - F.floor(pos)).alias(f"_f{i}")]
        group += [f"_a{i}", f"_b{i}", f"_r{i}", f"_f{i}"]
    j = join_back(rows.where(F.col("_v").isNotNull()), stats.where(F.col("_n") > 0).select(*keys, *bounds), keys)
    inside = [(F.col("_v") >= F.col(f"_a{i}")) & (F.col("_v") <= F.col(f"_b{i}")) for i in range(k)]
    cells = j.groupBy(*keys, *group, F.when(reduce(or_, inside), F.col("_v")).alias("v")).agg(
        F.count(F.lit(1)).alias("c"), *[F.count_if(F.col("_v") < F.col(f"_a{i}")).alias(f"below{i}") for i in range(k)])
    part = Window.partitionBy(*keys)
    run = part.orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = [(F.col("v") >= F.col(f"_a{i}")) & (F.col("v") <= F.col(f"_b{i}")) for i in range(k)]
    for i in range(k):
        cells = cells.withColumn(f"below{i}", F.sum(f"below{i}").over(part)).withColumn(
            f"cum{i}", F.col(f"below{i}") + F.sum(F.when(held[i], F.col("c")).otherwise(0)).over(run))
    aggs = []
    for i in range(k):
        at = lambda more: F.min(F.when(held[i] & (F.col(f"cum{i}") > F.col(f"_r{i}") + more), F.col("v")))  # noqa: E731,B023
        aggs += [at(0).alias(f"_lo{i}"), at(1).alias(f"_hi{i}"), F.max(f"_f{i}").alias(f"_f{i}"),
                 (F.max(f"below{i}") <= F.max(f"_r{i}")).alias(f"_ok{i}")]
    picked = cells.groupBy(*keys).agg(*aggs)
    out = []
    for i, n in enumerate(names):
        lo, hi, frac = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_f{i}")
        sound = F.col(f"_ok{i}") & lo.isNotNull() & ((frac == 0) | hi.isNotNull())
        value_ = F.when(frac == 0, lo).otherwise(lo + (hi - lo) * frac)
        out.append(F.when(sound, value_).otherwise(F.raise_error(F.lit("a rank lies outside its bracket: raise accuracy")).cast("double")).alias(n))
    return join_back(stats.select(*keys, *extra_names), picked.select(*keys, *out), keys, "left")


KLL_K = 800  # sketch size: a rank error of about 0.4 %


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, name: str = "sketch") -> DataFrame:
    """(keys, n, sketch): a mergeable KLL sketch of each group's values, a few KB whatever the group's size.

    To be stored (say per model and day) and merged for any period later,
    without the values. Nulls are left out; a group of nulls has none.
    """
    v = F.col(value).cast("double")
    return df.where(v.isNotNull()).groupBy(*keys).agg(F.count(v).alias("n"), F.kll_sketch_agg_double(v, F.lit(KLL_K)).alias(name))


def sketched_percentiles(sketches: DataFrame, keys: Sequence[str], ps: Sequence[float], name: str = "sketch") -> DataFrame:
    """(keys, n, p, value) from stored sketches, merged per ``keys``; ``value`` has nearly rank ``p``."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double(name).alias("_s"))
    found = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias("value")) for p in ps])
    return merged.select(*keys, "n", F.inline(found))
