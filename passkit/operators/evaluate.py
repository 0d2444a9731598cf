"""Evaluating solutions: problem lookup, guards, answer checking, outcome labels.

The solution side is the big one (models x problems x samples); problems
are few. Joins are plain equi-joins on task_id: the planner broadcasts
the problem side when its measured size passes
``spark.sql.autoBroadcastJoinThreshold`` and AQE re-plans at run time (and
splits a skewed task_id partition), so no hint is needed and none is given
for data whose size is not fixed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passkit.functions.text import py_strip

# Outcome strings of the test runner.
PASSED = "passed"
TIMED_OUT = "timed out"
FAILED_PREFIX = "failed: "
EXECUTABLE_MISSING = "Q/KDB+ executable not found. Please ensure q is installed and in PATH."


def problem_lookup(problems: DataFrame, pos: str = "pos") -> DataFrame:
    """One problem per task_id; NULL task_id becomes ``task_{pos}``; the last duplicate wins.

    ``max_by`` inside an aggregation (partial aggregation on the map side)
    instead of ``row_number`` over a window, so a task id repeated a
    billion times is combined map-side rather than sorted in one task.
    """
    keyed = problems.withColumn("task_id", F.coalesce(F.col("task_id"), F.concat(F.lit("task_"), F.col(pos).cast("string"))))
    others = [c for c in keyed.columns if c != "task_id"]
    best = keyed.groupBy("task_id").agg(F.max_by(F.struct(*others), F.col(pos)).alias("_p"))
    return best.select("task_id", *[F.col(f"_p.{c}").alias(c) for c in others])


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], buckets: int, how: str = "left",
                salt_from: Sequence[str] = ()) -> DataFrame:
    """Equi-join that spreads each key of ``big`` over ``buckets`` partitions.

    ``big`` gets a salt from a hash of ``salt_from`` (deterministic, so a
    recomputed partition lands in the same bucket); ``small`` is repeated
    once per bucket with a generator column. A key holding a third of
    ``big`` is then split ``buckets`` ways instead of landing in one task.
    """
    keys = list(keys)
    src = [F.col(c) for c in (salt_from or big.columns)]
    b = big.withColumn("_salt", F.pmod(F.xxhash64(*src), F.lit(buckets)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return b.join(s, on=[*keys, "_salt"], how=how).drop("_salt")


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = 0.01) -> dict[int, float]:
    """Hash of each key that may hold at least ``share`` of the rows, and its estimated share.

    One scan with a frequent-items sketch, which counts map-side and never
    misses a key of that size; at most ``1 / share`` hashes (and a few it takes for one) come to the driver.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    k = int(1 / share) + 1
    tracked = 1 << (8 * k).bit_length()
    got = df.agg(F.count(F.lit(1)).alias("n"), F.call_function("approx_top_k", F.xxhash64(*keys), F.lit(k), F.lit(tracked)).alias("top")).first()
    return {t["item"]: t["count"] / got["n"] for t in got["top"] or [] if t["count"] >= share * got["n"]}


def heavy_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left", share: float = 0.01,
               salt_from: Sequence[str] = ()) -> DataFrame:
    """Equi-join that spreads the heavy keys of ``big``, and only those, over partitions of about ``share`` of its rows.

    A key with an estimated third of the rows gets ``1 / (3 share)`` salts: its
    rows take one by hash, its row in ``small`` is repeated for each. All other
    rows keep salt 0, so ``small`` grows by the heavy keys' salts and no more.
    """
    keys = list(keys)
    heavy = heavy_keys(big, keys, share)
    if not heavy:
        return big.join(small, on=keys, how=how)
    salts = F.create_map(*[F.lit(x) for h, part in sorted(heavy.items()) for x in (h, max(2, round(part / share)))])
    many = F.coalesce(F.element_at(salts, F.xxhash64(*keys)), F.lit(1))
    src = [F.col(c) for c in (salt_from or big.columns)]
    b = big.withColumn("_salt", F.pmod(F.xxhash64(F.lit("salt"), *src), many).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), (many - 1).cast("int"))))
    return b.join(s, on=[*keys, "_salt"], how=how).drop("_salt")


def attach_problem(solutions: DataFrame, problems: DataFrame, keys: Sequence[str] = ("task_id",),
                   salt_buckets: int = 0, heavy_share: float = 0.0) -> DataFrame:
    """Left outer join solutions -> problems; unmatched solutions are kept with ``has_problem`` false.

    By default the planner broadcasts the problems when their measured size
    allows, and AQE splits a skewed task partition otherwise;
    ``salt_buckets`` forces a deterministic salted join of all tasks instead, and
    ``heavy_share`` finds the tasks with that share of the solutions and salts those (one more scan of the keys).
    """
    p = problems.withColumn("has_problem", F.lit(True))
    if heavy_share:
        salt_cols = [c for c in ("model_name", "sample_index") if c in solutions.columns]
        out = heavy_join(solutions, p, keys, "left", heavy_share, salt_cols)
        return out.withColumn("has_problem", F.coalesce(F.col("has_problem"), F.lit(False)))
    if salt_buckets > 1:
        salt_cols = [c for c in ("model_name", "sample_index") if c in solutions.columns]
        out = salted_join(solutions, p, keys, salt_buckets, "left", salt_cols)
    else:
        out = solutions.join(p, on=list(keys), how="left")
    return out.withColumn("has_problem", F.coalesce(F.col("has_problem"), F.lit(False)))


def guard_error(task_id: Column, has_problem: Column, entry_point: Column, code: Column) -> Column:
    """First failing guard's message, NULL when the row may be run."""
    name = F.coalesce(task_id, F.lit("None"))  # a NULL id must not make the message NULL: the row would count as runnable
    return (F.when(~F.coalesce(has_problem, F.lit(False)), F.concat(F.lit("No problem data found for "), name))
            .when(F.coalesce(entry_point, F.lit("")) == "", F.concat(F.lit("Missing entry_point for "), name))
            .when(py_strip(F.coalesce(code, F.lit(""))) == "", F.lit("Empty code")))


def orphan_solutions(solutions: DataFrame, problems: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    return solutions.join(problems.select(*keys), on=list(keys), how="left_anti")


def unattempted_problems(problems: DataFrame, results: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    # distinct first: it combines before the shuffle, so the big side meets the join as one row per key
    return problems.join(results.select(*keys).distinct(), on=list(keys), how="left_anti")


def check_answers(answers: DataFrame, expected: DataFrame, equal: Column | None = None,
                  task: str = "task_id", sample: str = "sample_index", case: str = "case_no",
                  samples: DataFrame | None = None) -> DataFrame:
    """A sample passes iff every expected case of its task has an answer and all its answers to it are equal.

    Answers are joined to expected values on (task, case) -- an equi-join
    on a near-unique key, no pair expansion. A case counts as passed if no
    answer to it is unequal; the sample passes when that count reaches the
    task's number of expected cases (so a task with no cases passes).
    ``samples`` (task, sample) lists the samples to report, answered or not;
    by default those with an answer. ``equal`` compares columns ``actual``
    and ``expected``.
    """
    a = answers.withColumnRenamed("value", "actual")
    e = expected.withColumnRenamed("value", "expected").withColumn("_has_case", F.lit(True))
    j = a.join(e, on=[task, case], how="left")
    if equal is None:
        from passkit.functions.equality import smart_equal
        equal = smart_equal(j, "actual", "expected")
    ok = F.coalesce(F.coalesce(F.col("_has_case"), F.lit(False)) & equal, F.lit(False))
    per_case = j.groupBy(task, sample, case).agg(F.min(ok).alias("_ok"), F.count(F.lit(1)).alias("_n"))
    per_sample = per_case.groupBy(task, sample).agg(F.count_if("_ok").alias("cases_passed"), F.sum("_n").alias("cases_answered"))
    if samples is not None:
        per_sample = samples.select(task, sample).distinct().join(per_sample, on=[task, sample], how="left")
    n_cases = expected.groupBy(task).agg(F.count(F.lit(1)).alias("cases_expected"))
    out = per_sample.join(n_cases, on=[task], how="left").fillna(0, subset=["cases_passed", "cases_answered", "cases_expected"])
    return out.withColumn("passed", F.col("cases_passed") >= F.col("cases_expected"))


def classify_outcome(stage: Column, message: Column, strict: bool = False) -> Column:
    """Label of a test run from the stage that ended it and its error text.

    stage: 'passed' | 'assert' (assertion failed) | 'test' (other error while
    testing) | 'nocheck' (tests define no check) | 'notcallable' (their check
    is no function) | 'ipc' (outer error). A NULL message reads as ''.
    The reference's substring tests are kept: any text holding "time"
    counts as a timeout and any outer text holding "port" as a port error
    ("runtime", "import" and "support" included); ``strict`` matches whole
    words instead.
    """
    message = F.coalesce(message, F.lit(""))
    low = F.lower(message)
    if strict:
        has_time = low.rlike(r"\b(timeout|timed out|time)\b")
        has_port = low.rlike(r"\bport\b")
    else:
        has_time = low.contains("time")
        has_port = low.contains("port")
    fail = lambda *parts: F.concat(F.lit(FAILED_PREFIX), *parts)
    return (F.when(stage == "passed", F.lit(PASSED))
            .when(stage == "assert", fail(F.lit("Test assertion failed: "), message))
            .when(stage == "nocheck", fail(F.lit("No 'check' function found in tests")))
            .when(stage == "notcallable", fail(F.lit("'check' is not callable in tests")))
            .when((stage == "test") & has_time, F.lit(TIMED_OUT))
            .when(stage == "test", fail(F.lit("Test execution failed: "), message))
            .when(message.contains("q executable not found"), fail(F.lit(EXECUTABLE_MISSING)))
            .when(has_port, fail(F.lit("IPC port error: "), message))
            .when(has_time, F.lit(TIMED_OUT))
            .otherwise(fail(F.lit("IPC execution error: "), message)))


def outcome_kind(label: Column) -> Column:
    """'passed', 'timed out', or the failure's first clause ('failed: Test assertion failed')."""
    return (F.when(label.isin(PASSED, TIMED_OUT), label)
            .when(label.startswith(FAILED_PREFIX),
                  F.concat(F.lit(FAILED_PREFIX), F.substring_index(F.substring(label, len(FAILED_PREFIX) + 1, 1 << 30), ":", 1)))
            .otherwise(label))


def failure_breakdown(results: DataFrame, label: str = "label") -> DataFrame:
    """Rows per outcome kind with their share of all rows."""
    by_kind = results.groupBy(outcome_kind(F.col(label)).alias("kind")).agg(F.count(F.lit(1)).alias("rows"))
    from pyspark.sql import Window
    total = F.sum("rows").over(Window.partitionBy())
    return by_kind.withColumn("share", F.col("rows") / total)
