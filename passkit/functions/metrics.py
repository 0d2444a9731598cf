"""Column expressions for the unbiased pass@k estimator and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The k grid of the gated summary and the minimum samples per
# problem a submission needs.
K_VALUES = (1, 5, 10, 20, 50, 100)
MIN_SUBMISSION_SAMPLES = 50


def _col(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(x))


def pass_at_k(n, c, k) -> Column:
    """1 - C(n-c, k) / C(n, k) as 1 - prod_{i=0..k-1} (n - c - i) / (n - i): k factors, whatever n and c are.

    ``n - c < k`` gives 1.0 (every k-subset holds a correct sample), ``c = 0`` gives 0.0.
    """
    n, c, k = _col(n), _col(c), _col(k)
    prod = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint") - 1), F.lit(1.0),
                       lambda acc, i: acc * ((n - c - i).cast("double") / (n - i)))
    return (F.when(n - c < k, F.lit(1.0))
            .when(c == 0, F.lit(0.0))
            .otherwise(F.lit(1.0) - prod))


def wilson_bounds(passed, total, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval for a binomial proportion (closed form)."""
    x, n = _col(passed).cast("double"), _col(total).cast("double")
    p = x / n
    z2 = F.lit(z * z)
    denom = F.lit(1.0) + z2 / n
    centre = (p + z2 / (F.lit(2.0) * n)) / denom
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + z2 / (F.lit(4.0) * n * n)) / denom
    return centre - half, centre + half


def safe_ratio(num, den) -> Column:
    """num / den, 0.0 when den is 0 or NULL (the reference's ``if x > 0`` guard)."""
    return F.coalesce(F.try_divide(_col(num).cast("double"), _col(den).cast("double")), F.lit(0.0))
