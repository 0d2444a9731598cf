"""Goldens for the estimator, gates, intervals and the six model cards."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from passkit.functions.metrics import pass_at_k, wilson_bounds
from passkit.operators import scoring as S
from passkit.plans import views as V


def _est(spark, n, c, k):
    return spark.range(1).select(pass_at_k(F.lit(n), F.lit(c), F.lit(k)).alias("p")).first().p


@pytest.mark.parametrize("n,c,k,want", [
    (10, 3, 1, 0.3), (10, 3, 5, 1 - math.comb(7, 5) / math.comb(10, 5)),
    (10, 0, 5, 0.0), (10, 8, 5, 1.0), (3, 0, 5, 1.0), (50, 0, 50, 0.0), (1, 1, 1, 1.0)])
def test_estimator_goldens(spark, n, c, k, want):
    assert _est(spark, n, c, k) == pytest.approx(want, abs=1e-12)


def test_estimator_matches_combinatorics(spark):
    rows = [(n, c, k) for n in range(1, 25) for c in range(0, n + 1) for k in (1, 2, 5, 10, 20)]
    df = spark.createDataFrame(rows, "n int, c int, k int").withColumn("p", pass_at_k("n", "c", "k"))
    for r in df.collect():
        want = 1.0 if r.n - r.c < r.k else 1 - math.comb(r.n - r.c, r.k) / math.comb(r.n, r.k)
        assert r.p == pytest.approx(want, abs=1e-9)


def test_gated_goldens_v2(spark):
    got = {r.k: r.pass_at_k for r in S.gated_pass_at_k(V.results_counts(spark, SF01)).collect()}
    assert sorted(got) == [1, 5, 10, 20]  # min n = 49 drops 50 and 100
    want = {1: 0.198442282, 5: 0.669664845, 10: 0.891177457, 20: 0.988348194}
    for k, v in want.items():
        assert round(got[k], 9) == v


def test_ungated_k50(spark):
    m = S.mean_pass_at_k(V.results_counts(spark, SF01), 50).first()[0]
    assert round(m, 9) == 0.999997342


def test_pass_at_k_non_decreasing_in_k(spark):
    g = S.gated_pass_at_k(V.attempt_counts(spark, SF01).drop("category"), ["model"]).collect()
    by = {}
    for r in g:
        by.setdefault(r.model, []).append((r.k, r.pass_at_k))
    for vals in by.values():
        ps = [p for _, p in sorted(vals)]
        assert ps == sorted(ps)


def test_mean_is_zero_without_problems(spark):
    empty = spark.createDataFrame([], "task_id string, num_samples long, num_correct long")
    assert S.mean_pass_at_k(empty, 1).first()[0] == 0.0
    t = S.totals(empty).first()
    assert (t.total_solutions, t.passed_solutions, t.pass_rate, t.total_problems) == (0, 0, 0.0, 0)


def test_wilson_golden(spark):
    lo, hi = wilson_bounds(F.lit(0.451 * 8200), F.lit(8200))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert r.lo == pytest.approx(0.440255, abs=1e-6) and r.hi == pytest.approx(0.461790, abs=1e-6)


# The six published model cards: passed solutions of 8,200 and the printed pass@1.
CARDS = [(575, 7.01), (1195, 14.57), (2020, 24.63), (2264, 27.61), (2880, 35.12), (3698, 45.10)]


@pytest.mark.parametrize("passed,printed", CARDS)
def test_card_reconcile(spark, passed, printed):
    """164 problems x 50 samples: with equal n, mean pass@1 equals passed / total."""
    per = [passed // 164 + (1 if i < passed % 164 else 0) for i in range(164)]
    df = spark.createDataFrame([("m", str(i), 50, c) for i, c in enumerate(per)],
                               "model string, task_id string, num_samples long, num_correct long")
    r = S.card_reconcile(df, "model").first()
    assert r.uniform_n and r.reconciles
    assert round(r.pass_at_1 * 100, 2) == printed


def test_running_pass_rate_matches_window_with_hot_key(spark):
    """Blocked prefix sums equal a plain window, also when one key holds most rows."""
    from pyspark.sql import Window
    rows = [("hot" if i % 4 else f"k{i % 7}", i, i % 3 == 0) for i in range(5000)]
    df = spark.createDataFrame(rows, "model string, event_id long, passed boolean")
    from passkit.operators.ordering import running_sums
    got = running_sums(df, ["model"], ["event_id"], {"s": F.col("passed").cast("long"), "n": F.lit(1)}, width=64)
    w = Window.partitionBy("model").orderBy("event_id")
    want = df.withColumn("s", F.sum(F.col("passed").cast("long")).over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    a = sorted(got.select("model", "event_id", "s", "n").collect())
    b = sorted(want.select("model", "event_id", "s", "n").collect())
    assert a == b


def test_running_sums_on_timestamps(spark):
    from pyspark.sql import Window
    from passkit.operators.ordering import running_sums
    from passkit.sources.tables import table
    e = table(spark, SF01, "events").select("event_type", "ts", "event_id")
    got = running_sums(e, ["event_type"], ["ts", "event_id"], {"n": F.lit(1)}, width=3_600_000_000)  # 1 h blocks
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    want = e.withColumn("n", F.count(F.lit(1)).over(w))
    assert got.select("event_id", "n").exceptAll(want.select("event_id", "n")).count() == 0
    assert got.count() == want.count()


def test_estimator_takes_k_factors_whatever_the_counts(spark):
    big = 10 ** 9
    rows = [(big, big // 2, 1, 0.5), (big, big // 2, 2, 1 - 0.25), (10, 3, 5, 1 - (7 * 6 * 5 * 4 * 3) / (10 * 9 * 8 * 7 * 6)),
            (10, 3, 10, 1.0), (4, 0, 10, 1.0), (20, 0, 10, 0.0), (2 ** 40, 2 ** 40 - 5, 5, 1.0)]
    df = spark.createDataFrame(rows, "n bigint, c bigint, k int, want double")
    for r in df.withColumn("got", pass_at_k("n", "c", F.col("k"))).collect():
        assert abs(r.got - r.want) < 1e-8, r
