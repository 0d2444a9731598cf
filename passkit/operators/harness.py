"""The reference's three commands as DataFrame functions: generate, execute, score.

    problems  = read_problems(spark, "problems.jsonl")
    solutions = generate_solutions(problems, "my-model", n=50, generator=my_generator)
    results   = execute_solutions(solutions, problems, runner=my_runner)
    per_problem, summary = score_results(results)

Each step is lazy; write ``solutions`` / ``results`` to the shared folder
(``passkit.session.materialize``) between steps when a step is expensive,
as the reference does with its files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passkit.functions.extraction import with_solution_code
from passkit.functions.text import py_strip
from passkit.functions.prompts import SCHEMA_TO_TEMPLATE, render
from passkit.operators import evaluate as E
from passkit.operators import plugins as G
from passkit.operators import requests as Q
from passkit.operators import scoring as S


def generate_solutions(problems: DataFrame, model_name: str, n: int, template: str = "q_humaneval",
                       *, generator: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Render every problem, plan ``n`` requests each, run the generator plug-in.

    Output: task_id, sample_index, completion, model_name, error, generated_at,
    one row per request. A problem that lacks a template field keeps its
    requests, with '' completions and the reason in ``error``.
    """
    rendered = render(problems, SCHEMA_TO_TEMPLATE.get(template, template), out="prompt_text")
    req = (Q.expand_samples(rendered, n)
           .withColumn("sample_index", F.col("sample_index").cast("int"))
           .withColumn("model_name", F.lit(model_name)))
    out = G.generate(req.select("task_id", "sample_index", "model_name", "entry_point",
                                F.col("prompt_text").alias("prompt"), "error"), generator)
    return out.withColumn("generated_at", F.localtimestamp())


def execute_solutions(solutions: DataFrame, problems: DataFrame,
                      runner: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
                      salt_buckets: int = 0, verdicts: DataFrame | None = None,
                      verdict_keys: Sequence[str] = ("task_id", "sample_index", "model_name")) -> DataFrame:
    """One result per solution: guarded rows fail with their message, the rest are
    extracted and tested. No row is dropped; scans and joins happen once.

    Tested by ``runner`` (a plug-in over batches), or by ``verdicts``: the
    recorded runs, a table of ``verdict_keys`` (one row for each solution that was run), ``passed``
    and, where known, the runner's ``info``. A solution without a recorded run fails and says so.
    Only keys and guard results meet the verdicts; no code is shuffled.

    ``problems`` needs task_id, entry_point, tests and (optionally)
    test_setup_code; duplicates of a task_id should be resolved first with
    ``evaluate.problem_lookup``.
    """
    cols = ["task_id", "entry_point", "tests"] + (["test_setup_code"] if "test_setup_code" in problems.columns else [])
    probs = problems.select(*cols)
    if "test_setup_code" not in probs.columns:
        probs = probs.withColumn("test_setup_code", F.lit(""))
    j = E.attach_problem(solutions, probs, salt_buckets=salt_buckets)
    j = j.withColumn("error", E.guard_error(F.col("task_id"), F.col("has_problem"), F.col("entry_point"),
                                           F.col("completion")))
    # guarded rows are not run, so nothing is cut out of their text
    j = j.withColumn("completion", F.when(F.col("error").isNull(), F.col("completion")))
    coded = with_solution_code(j, "completion", "entry_point")
    coded = coded.withColumn("sample_index", F.col("sample_index").cast("bigint"))
    if verdicts is None:
        return G.evaluate(coded, runner)
    blank = py_strip(F.coalesce("code", F.lit(""))) == ""
    keys = list(verdict_keys)
    ran = coded.select(*dict.fromkeys(["task_id", "sample_index", "model_name", *keys]),
                       F.coalesce("error", F.when(blank, F.lit("Empty code"))).alias("error"))
    told = F.col("info").cast("string") if "info" in verdicts.columns else F.lit(None).cast("string")
    out = ran.join(verdicts.select(*keys, F.col("passed").alias("_passed"), told.alias("_info")), on=keys, how="left")
    runnable = F.col("error").isNull()
    ok = runnable & F.coalesce("_passed", F.lit(False))
    why = F.coalesce("_info", F.when(F.col("_passed").isNull(), F.lit(E.FAILED_PREFIX + "no recorded run")).otherwise(
        F.lit(E.FAILED_PREFIX + "Test assertion failed: an answer differs")))
    return out.select("task_id", "sample_index", "model_name", ok.alias("passed"),
                      F.when(ok, F.lit(E.PASSED)).when(runnable, why).alias("info"), "error")


def score_results(results: DataFrame, by: Sequence[str] = ("model_name",), max_workers: int = 1
                  ) -> tuple[DataFrame, DataFrame]:
    """(per-problem counts, summary with gated pass@k) per group."""
    pp = S.per_problem(results, [*by, "task_id"])
    return pp, S.summary(pp, list(by), max_workers=max_workers)
