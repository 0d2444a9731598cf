"""Percentiles (both code paths), measurement rules and request planning goldens."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passkit.functions.text import py_strip, word_count
from passkit.operators import perf as P
from passkit.operators import requests as Q
from passkit.operators.quantiles import exact_percentiles
from passkit.plans.registry import QUERIES, load_all


def test_percentile_golden(spark):
    df = spark.createDataFrame([("m", float(v)) for v in (1, 2, 3, 10)], "model string, v double")
    r = exact_percentiles(df, ["model"], "v", [0.95, 0.5]).first()
    assert r.p95 == pytest.approx(8.95) and r.p50 == pytest.approx(2.5)


def test_percentile_bracket_path_with_hot_group(spark):
    """accuracy far below n forces the sketch bracket; one group holds most rows and many ties."""
    rng = np.random.default_rng(7)
    hot = np.concatenate([rng.exponential(30, 20000), np.full(8000, 12.5)])
    cold = rng.normal(50, 5, 300)
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold]
    df = spark.createDataFrame(rows, "model string, v double")
    ps = [0.05, 0.5, 0.95, 0.99]
    got = {r.model: r for r in exact_percentiles(df, ["model"], "v", ps, accuracy=200).collect()}
    for name, vals in (("hot", hot), ("cold", cold)):
        for p in ps:
            want = float(np.percentile(vals, p * 100))  # linear interpolation at p*(n-1)
            assert getattr(got[name], f"p{int(round(p * 100))}") == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_latency_stats_single_value(spark):
    df = spark.createDataFrame([("m", 3.0)], "model string, latency double")
    r = P.latency_stats(df, ["model"]).first()
    assert (r.mean, r.median, r.stdev, r.min, r.max, r.p95, r.p99) == (3.0, 3.0, 0.0, 3.0, 3.0, 3.0, 3.0)


def test_word_count_and_strip(spark):
    df = spark.createDataFrame([("",), (" a b ",), ("x　y\tz\n",), (None,)], "t string")
    got = [(r.w, r.s) for r in df.select(word_count(F.col("t")).alias("w"), py_strip(F.col("t")).alias("s")).collect()]
    assert got == [(0, ""), (2, "a b"), (3, "x　y\tz"), (0, None)]


def test_split_calls(spark):
    df = spark.createDataFrame([(50,), (10,), (11,), (1,)], "n int")
    got = {r.n: r.c for r in df.select("n", Q.call_sizes(F.col("n")).alias("c")).collect()}
    assert got == {50: [8, 8, 8, 8, 8, 8, 2], 10: [10], 11: [8, 3], 1: [1]}


def test_seeds_injective_and_in_range(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("task_id"))
    df = Q.expand_samples(df, 500)
    s = df.select(Q.unique_seed(Q.seed_base(F.col("task_id")), F.col("sample_index")).alias("seed"), "task_id")
    agg = s.groupBy("task_id").agg(F.countDistinct("seed").alias("d"), F.count(F.lit(1)).alias("n"),
                                   F.min("seed").alias("lo"), F.max("seed").alias("hi")).collect()
    assert all(r.d == r.n == 500 and r.lo >= 0 and r.hi < 2 ** 31 for r in agg)


def test_batches_last_one_short(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "pos long")
    got = [(r.pos, r.batch_no) for r in Q.assign_batches(df, ["pos"], 2).orderBy("pos").collect()]
    assert got == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]


def test_normalize_and_pad(spark):
    df = spark.createDataFrame([([" a ", None, "b"],), ([],), (None,), (["x", "y", "z", "w"],)], "l array<string>")
    got = [r.c for r in df.select(Q.normalize_completions(F.col("l"), 3).alias("c")).collect()]
    assert got == [["a", "", "b"], ["", "", ""], ["", "", ""], ["x", "y", "z"]]


def test_pad_failures_every_request_answered(spark):
    req = Q.expand_samples(spark.createDataFrame([("t1",), ("t2",)], "task_id string"), 2)
    resp = spark.createDataFrame([("t1", 0, "ok")], "task_id string, sample_index int, completion string")
    got = sorted((r.task_id, r.sample_index, r.completion, r.failed) for r in Q.pad_failures(req, resp).collect())
    assert got == [("t1", 0, "ok", False), ("t1", 1, "", True), ("t2", 0, "", True), ("t2", 1, "", True)]


def test_balanced_choice_ties_and_zero_memory(spark):
    rows = [("m", 1, 100.0, 0.0, None), ("m", 2, 100.0, 0.0, None), ("m", 3, 50.0, 0.0, None), ("m", 4, 999.0, 0.0, "oom")]
    df = spark.createDataFrame(rows, "model string, trial_no long, tokens_per_second double, memory_used_gb double, error string")
    r = P.balanced_trial(df).first()
    assert r.balanced_trial == 1 and r.balanced_score == pytest.approx(1.0)
    b = P.best_trials(df).first()
    assert b.best_throughput_trial == 1 and b.best_memory_trial == 1


def test_null_keys_and_orders_keep_every_row(spark):
    """Block prefix sums, run ranks and percentiles keep NULL-key / NULL-order rows."""
    from pyspark.sql import Window
    from passkit.operators.ordering import running_sums
    rows = [("a", 1, 1.0), ("a", None, 2.0), (None, 3, 3.0), (None, 4, 5.0), ("b", 5, None)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = running_sums(df, ["k"], ["t"], {"n": F.lit(1)}, width=2)
    w = Window.partitionBy("k").orderBy("t")
    want = df.withColumn("n", F.count(F.lit(1)).over(w))
    assert sorted(got.select("k", "t", "n").collect(), key=repr) == sorted(want.select("k", "t", "n").collect(), key=repr)
    ranked = P.run_rank(df, ["k"], "t")
    assert ranked.count() == 5
    pct = {r.k: r.p50 for r in exact_percentiles(df, ["k"], "v", [0.5]).collect()}
    assert pct == {"a": 1.5, None: 4.0, "b": None} or pct == {"a": 1.5, None: 4.0}


def test_cycled_slots_are_not_broadcast(spark, tmp_path):
    """The batches' file is small, their slots need not be: only the prompts may be broadcast."""
    spark.range(1, 9).select(F.col("id").alias("b"), F.col("id").cast("int").alias("size")).write.parquet(str(tmp_path / "b"))
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(3)], "prompt_pos long, task_id string")
    out = P.cycle_prompts(spark.read.parquet(str(tmp_path / "b")), prompts, "size")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan
    assert sorted((r.b, r.slot, r.task_id) for r in out.collect()) == [(b, i, f"p{i % 3}") for b in range(1, 9) for i in range(b)]


def test_latency_stats_approx_close_to_exact(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("m", float(v)) for v in rng.exponential(10, 5000)], "model string, latency double")
    ex = P.latency_stats(df, ["model"]).first()
    ap = P.latency_stats(df, ["model"], exact=False, accuracy=1000).first()
    assert ap.mean == pytest.approx(ex.mean) and ap.samples == ex.samples == 5000
    for c in ("median", "p95", "p99"):
        assert getattr(ap, c) == pytest.approx(getattr(ex, c), rel=0.05)


def test_salted_attach_equals_plain_with_hot_task(spark):
    from passkit.operators.evaluate import attach_problem
    sol = spark.createDataFrame([("hot" if i % 3 else f"t{i % 11}", i, "m") for i in range(3000)] + [("orphan", 0, "m")],
                                "task_id string, sample_index int, model_name string")
    probs = spark.createDataFrame([("hot", "f"), *[(f"t{i}", f"g{i}") for i in range(11)]], "task_id string, entry_point string")
    plain = attach_problem(sol, probs).collect()
    salted = attach_problem(sol, probs, salt_buckets=16)
    assert sorted(plain) == sorted(salted.select(*[c for c in plain[0].asDict()]).collect())
    assert salted.count() == 3001 and salted.where("NOT has_problem").count() == 1


def _small_tables(spark, folder, turns, items):
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(i, f"item {i}") for i in items], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_any_completion_attempts_its_problem(spark, tmp_path):
    load_all()
    turns = [(0, 1, "assistant", "a"), (1, 4, "assistant", "b"), (2, 2, "assistant", "c"), (3, 3, "user", "d")]
    d = _small_tables(spark, tmp_path, turns, range(5))
    assert {r["task_id"] for r in QUERIES["unattempted_problems"](spark, d).collect()} == {"3", "4"}


def test_every_answer_meets_a_request(spark, tmp_path):
    load_all()
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}/{t}") for c in range(700) for t in range(2 + c % 3)]
    turns += [(1, 100 + t, "assistant", f"1/{100 + t}") for t in range(3000)] + [(900, 0, "user", "900/0")]
    d = _small_tables(spark, tmp_path, turns, range(7))
    got = {(r["task_id"], r["sample_index"]): (r["completion"], r["failed"]) for r in QUERIES["pad_failures"](spark, d).collect()}
    want = {}
    for item in range(7):
        mine = sorted(x for x in turns if x[0] % 7 == item)
        answers = [x[3] for x in mine if x[2] == "assistant"]
        for k in range(max(3, len(answers), len(mine) - len(answers))):
            want[str(item), k] = (answers[k], False) if k < len(answers) else ("", True)
    assert got == want
    assert sum(not failed for _, failed in got.values()) == sum(x[2] == "assistant" for x in turns)
