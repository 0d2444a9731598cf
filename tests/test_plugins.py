"""Plug-ins: one row per request or solution, whatever the batch size."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from passkit.operators import plugins as G
from passkit.operators.harness import generate_solutions


@pytest.fixture(params=[1, 10, 10_000])
def batch_size(spark, request):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield request.param
    spark.conf.set(key, old)


def test_only_bad_rows_fail(spark, batch_size):
    def runner(batch):
        if (batch["code"] == "boom").any():
            raise RuntimeError("bad code")
        if (batch["code"] == "short").any():
            return pd.DataFrame({"passed": [], "info": []})
        return pd.DataFrame({"passed": batch["code"].str.startswith("{"), "info": "ran"})

    code = F.when(F.col("id") == 500, "boom").when(F.col("id") == 7, "short").when(F.col("id") == 9, "  ").otherwise("{x}")
    rows = spark.range(1000, numPartitions=3).select(F.lit("t").alias("task_id"), F.col("id").alias("sample_index"), F.lit("m").alias("model_name"),
                                                     code.alias("code"), F.when(F.col("id") == 11, "guarded").alias("error"))
    got = {r.sample_index: (r.passed, r.error) for r in G.evaluate(rows, runner).collect()}
    assert len(got) == 1000
    assert {k: v for k, v in got.items() if not v[0]} == {
        500: (False, "Execution error: bad code"), 7: (False, "Execution error: the runner returned 0 rows for 1"),
        9: (False, "Empty code"), 11: (False, "guarded")}


def test_one_completion_per_request(spark, batch_size):
    def generator(batch):
        if (batch["sample_index"] == 3).any():
            raise RuntimeError("no answer")
        out = batch[batch["sample_index"] != 4][["task_id", "sample_index", "model_name"]].assign(completion="c")
        return pd.concat([out, out, out.assign(sample_index=-1)]).iloc[::-1]  # repeated, unasked, in another order

    req = spark.range(100, numPartitions=2).select(F.when(F.col("id") % 2 == 0, "t").alias("task_id"), F.col("id").cast("int").alias("sample_index"),
                                                   F.lit("m").alias("model_name"))
    got = sorted((r.sample_index, r.task_id, r.completion) for r in G.generate(req, generator).collect())
    assert got == [(i, "t" if i % 2 == 0 else None, "" if i in (3, 4) else "c") for i in range(100)]


def test_unrendered_problems_are_reported(spark):
    problems = spark.createDataFrame([("a", "write it", "f"), ("b", None, "g")], "task_id string, prompt string, entry_point string")
    rows = generate_solutions(problems, "m", 2, generator=lambda b: b[["task_id", "sample_index", "model_name"]].assign(completion="c")).collect()
    assert sorted((r.task_id, r.sample_index, r.completion, r.error is None) for r in rows) == [
        ("a", 0, "c", True), ("a", 1, "c", True), ("b", 0, "", False), ("b", 1, "", False)]


def test_recorded_runs_decide_and_missing_ones_fail(spark):
    """Verdicts belong to the solution itself: (task, sample, model); guarded rows keep their guard's message."""
    from passkit.operators.harness import execute_solutions
    problems = spark.createDataFrame([("t1", "f", "x"), ("t2", "", "x")], "task_id string, entry_point string, tests string")
    solutions = spark.createDataFrame(
        [("t1", 0, "m", "f:{x+1}"), ("t1", 1, "m", "f:{x+2}"), ("t1", 2, "m", "f:{x+3}"), ("t1", 3, "m", " "), ("t1", 4, "m", None),
         ("t2", 0, "m", "f:{x}"), ("t9", 0, "m", "f:{x}"), ("t1", 0, "other", "f:{x}")],
        "task_id string, sample_index int, model_name string, completion string")
    runs = spark.createDataFrame(
        [("t1", 0, "m", True, None), ("t1", 1, "m", False, "timed out"), ("t1", 3, "m", True, None), ("t1", 0, "other", False, None),
         ("t2", 0, "m", True, None), ("t9", 0, "m", True, None)],
        "task_id string, sample_index int, model_name string, passed boolean, info string")
    got = {(r["task_id"], r["sample_index"], r["model_name"]): (r["passed"], r["info"], r["error"])
           for r in execute_solutions(solutions, problems, verdicts=runs).collect()}
    assert got == {
        ("t1", 0, "m"): (True, "passed", None),
        ("t1", 1, "m"): (False, "timed out", None),
        ("t1", 2, "m"): (False, "failed: no recorded run", None),
        ("t1", 3, "m"): (False, None, "Empty code"),
        ("t1", 4, "m"): (False, None, "Empty code"),
        ("t2", 0, "m"): (False, None, "Missing entry_point for t2"),
        ("t9", 0, "m"): (False, None, "No problem data found for t9"),
        ("t1", 0, "other"): (False, "failed: Test assertion failed: an answer differs", None)}


def test_answers_of_a_run_are_checked(spark, tmp_path):
    """A recorded run that passed fails if its answer sheet has a wrong answer or none; every event has a run, SQL agrees."""
    import duckdb
    from pyspark.sql import types as T
    from oracle import compare
    from passkit.plans.registry import ORACLE, QUERIES, load_all
    load_all()
    made = {
        "benchmark": spark.range(3).select(F.col("id").alias("item_id"), F.lit("t").alias("text")),
        "conversations": spark.createDataFrame([(1, 1, "assistant", "a\nb"), (1, 2, "user", "q"), (1, 3, "assistant", "a"), (41, 5, "assistant", "a\nb")],
                                               "conv_id long, turn long, role string, text string"),
        # label 1 has vectors 1 and 2: sheets 0, 1 and 2 are right (no multiple of 7, 11 or 3), 3 is not answered;
        # label 5 has vector 7: sheet 1 has a second, wrong answer
        "embeddings": spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [3.0, 4.0], 1), (7, [5.0, 6.0], 5)],
                                            T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                                                          T.StructField("label", T.LongType())])),
        "events": spark.createDataFrame([(1, 2, "purchase", None, "{}"), (5, 2, "purchase", 1.0, "{}"), (11, 2, "purchase", 1.0, "{}"),
                                         (21, 2, "click", 1.0, "{}")],
                                        "event_id long, user_id long, event_type string, value double, props string"),
    }
    con = duckdb.connect()
    for name, df in made.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = QUERIES["evaluate_plugin"](spark, str(tmp_path)).toPandas()
    wrong = "failed: Test assertion failed: an answer differs"
    assert {(r.model_name, r.sample_index): (r.passed, r.info) for r in got.itertuples()} == {
        ("m0", 1): (True, "passed"), ("m0", 3): (False, wrong), ("m0", 1005): (False, wrong),
        ("m1", 1): (True, "passed"), ("m1", 5): (False, wrong), ("m1", 11): (False, wrong), ("m1", 21): (False, "failed: click")}
    assert compare(got, con.execute(ORACLE["evaluate_plugin"]).df()) is None
