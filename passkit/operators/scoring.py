"""Scoring: per-problem counts, pass@k, summaries, leaderboards.

All of these are aggregations. The big input (one row per sample) is
touched once by ``per_problem``, whose count/count_if combine map-side, so
a problem or model holding a third of all samples costs no more than any
other; everything after that works on models x problems rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passkit.functions.metrics import K_VALUES, MIN_SUBMISSION_SAMPLES, pass_at_k, safe_ratio, wilson_bounds
from passkit.operators.ordering import ranged_sums


def per_problem(results: DataFrame, keys: Sequence[str] = ("task_id",), passed: str = "passed") -> DataFrame:
    """num_samples = rows, num_correct = rows with passed true (NULL counts as false)."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.count_if(F.coalesce(F.col(passed), F.lit(False))).alias("num_correct"))


def totals(problems: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summary scalars from per-problem rows: total, passed, pass_rate, total_problems."""
    agg = problems.groupBy(*by) if by else problems.groupBy()
    return agg.agg(
        F.coalesce(F.sum("num_samples"), F.lit(0)).cast("bigint").alias("total_solutions"),
        F.coalesce(F.sum("num_correct"), F.lit(0)).cast("bigint").alias("passed_solutions"),
        F.count(F.lit(1)).alias("total_problems"),
    ).withColumn("pass_rate", safe_ratio("passed_solutions", "total_solutions"))


def with_pass_at_k(problems: DataFrame, k: int, name: str | None = None) -> DataFrame:
    return problems.withColumn(name or f"pass_at_{k}", pass_at_k("num_samples", "num_correct", F.lit(k)))


def mean_pass_at_k(problems: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the per-problem estimates; 0.0 when there is no problem."""
    est = with_pass_at_k(problems, k, "_p")
    agg = est.groupBy(*by) if by else est.groupBy()
    return agg.agg(F.coalesce(F.avg("_p"), F.lit(0.0)).alias(f"pass_at_{k}"))


def gated_pass_at_k(problems: DataFrame, by: Sequence[str] = (), ks: Sequence[int] = K_VALUES) -> DataFrame:
    """Long form (by..., k, pass_at_k): k is kept only if every problem has >= k samples.

    The k grid is a generator column on the per-problem rows (no join), and
    one aggregation yields both the mean and the gate's min(num_samples).
    """
    est = problems.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    est = est.withColumn("_p", pass_at_k("num_samples", "num_correct", F.col("k")))
    out = (est.groupBy(*by, "k")
           .agg(F.avg("_p").alias("pass_at_k"), F.min("num_samples").alias("_min_n"))
           .where(F.col("_min_n") >= F.col("k"))
           .drop("_min_n"))
    return out


def gated_wide(problems: DataFrame, by: Sequence[str], ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Wide form: one pass_at_{k} column per k, NULL where the gate drops k."""
    est = problems
    aggs = [F.min("num_samples").alias("_min_n")]
    for k in ks:
        est = est.withColumn(f"_p{k}", pass_at_k("num_samples", "num_correct", F.lit(k)))
        aggs.append(F.avg(f"_p{k}").alias(f"_m{k}"))
    out = est.groupBy(*by).agg(*aggs)
    for k in ks:
        out = out.withColumn(f"pass_at_{k}", F.when(F.col("_min_n") >= k, F.col(f"_m{k}")))
    return out.drop("_min_n", *[f"_m{k}" for k in ks])


def leaderboard(problems: DataFrame, model: str = "model", ks: Sequence[int] = (1, 5, 10),
                carry: Sequence[str] = ()) -> DataFrame:
    """Models ranked by pass@1 (rank() semantics; ties share a rank).

    ``carry`` are columns functionally dependent on the model (provider,
    category, ...): grouping by them too keeps them without a second pass
    over the input. The ranking window has no partition: it runs on one row
    per model.
    """
    wide = gated_wide(problems, [model, *carry], ks)
    return wide.withColumn("rank", F.rank().over(Window.orderBy(F.desc(f"pass_at_{ks[0]}"))))


def leaderboard_best(board: DataFrame, model: str = "model",
                     metrics: Sequence[str] = ("pass_at_1", "pass_at_5", "pass_at_10")) -> DataFrame:
    """Best model per metric; ties go to the smallest model name.

    ``stack`` turns the metric columns into rows, then ``min_by`` on an
    ordering struct picks the winner inside an aggregation (no window).
    """
    pairs = ", ".join(f"'{m}', {m}" for m in metrics)
    long = board.selectExpr(f"{model} AS model", f"stack({len(metrics)}, {pairs}) AS (metric, value)")
    long = long.where(F.col("value").isNotNull())
    return long.groupBy("metric").agg(
        F.min_by(F.struct("model", "value"), F.struct((-F.col("value")).alias("v"), F.col("model").alias("m")))
        .alias("best")).select("metric", F.col("best.model").alias("model"), F.col("best.value").alias("value"))


def leaderboard_categories(board: DataFrame, category: str = "category") -> DataFrame:
    """Models per category plus the grand total (rollup row with category NULL)."""
    return (board.rollup(category).agg(F.count(F.lit(1)).alias("models"),
                                       F.grouping(category).alias("_g"))
            .withColumn("is_total", F.col("_g") == 1).drop("_g"))


def wilson_interval(problems: DataFrame, by: Sequence[str], z: float = 1.96, target: float = 0.03) -> DataFrame:
    """Wilson 95% interval of the pass rate and whether its half-width is within ``target``."""
    t = totals(problems, by)
    lo, hi = wilson_bounds("passed_solutions", "total_solutions", z)
    return (t.withColumn("wilson_low", lo).withColumn("wilson_high", hi)
            .withColumn("half_width", (F.col("wilson_high") - F.col("wilson_low")) / 2)
            .withColumn("within_target", F.col("half_width") <= F.lit(target)))


def submission_check(problems: DataFrame, model: str, expected_problems: int | None = None,
                     min_samples: int = MIN_SUBMISSION_SAMPLES) -> DataFrame:
    """Per model: accepted iff every problem has >= min_samples and all problems are present."""
    agg = problems.groupBy(model).agg(F.min("num_samples").alias("min_samples"),
                                      F.count(F.lit(1)).alias("problems"))
    reasons = [F.when(F.col("min_samples") < min_samples,
                      F.format_string(f"fewer than {min_samples} samples for some problem (min %d)",
                                      F.col("min_samples")))]
    if expected_problems is not None:
        reasons.append(F.when(F.col("problems") < expected_problems,
                              F.format_string(f"%d of {expected_problems} problems attempted",
                                              F.col("problems"))))
    arr = F.filter(F.array(*reasons), lambda r: r.isNotNull())
    return (agg.withColumn("accepted", F.size(arr) == 0)
            .withColumn("reasons", F.array_join(arr, "; ")))


def card_reconcile(problems: DataFrame, model: str, eps: float = 1e-9) -> DataFrame:
    """With equal n for every problem, pass@1 must equal passed / total."""
    est = with_pass_at_k(problems, 1, "_p1")
    agg = est.groupBy(model).agg(
        F.min("num_samples").alias("min_n"), F.max("num_samples").alias("max_n"),
        F.avg("_p1").alias("pass_at_1"),
        F.sum("num_correct").alias("_c"), F.sum("num_samples").alias("_n"))
    return (agg.withColumn("pass_rate", safe_ratio("_c", "_n"))
            .withColumn("uniform_n", F.col("min_n") == F.col("max_n"))
            .withColumn("reconciles", ~F.col("uniform_n") | (F.abs(F.col("pass_at_1") - F.col("pass_rate")) < eps))
            .drop("_c", "_n"))


def metric_text(gated_long: DataFrame, by: Sequence[str]) -> DataFrame:
    """'Pass@1: 0.198, Pass@5: 0.670, ...' in k order, per group."""
    item = F.struct(F.col("k"), F.format_string("Pass@%d: %.3f", F.col("k"), F.col("pass_at_k")).alias("t"))
    return gated_long.groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["t"]), ", ").alias("metrics_text"))


def running_pass_rate(results: DataFrame, key: str, order_col: str, passed: str = "passed") -> DataFrame:
    """Pass rate after each result, per key in ``order_col`` order (prefix sums over ranges of rows)."""
    out = ranged_sums(results, [key], [order_col], {
        "running_total": F.lit(1).cast("bigint"),
        "running_passed": F.coalesce(F.col(passed), F.lit(False)).cast("bigint")})
    return out.withColumn("running_pass_rate", F.col("running_passed") / F.col("running_total"))


def summary(problems_counts: DataFrame, by: Sequence[str], max_workers: int = 1,
            ks: Sequence[int] = K_VALUES) -> DataFrame:
    """One summary row per group: totals, one ``pass_at_{k}`` column per k of the grid
    (NULL where the gate drops k, so ``to_json`` leaves the key out, as the
    reference's document does), execution method and workers.

    Totals and the gated estimates come from one aggregation over the
    per-problem rows. Per-problem rows and result rows stay tables of their
    own (they grow with the data); the document sink joins them back.
    """
    by = list(by)
    est = problems_counts
    aggs = [F.coalesce(F.sum("num_samples"), F.lit(0)).cast("bigint").alias("total_solutions"),
            F.coalesce(F.sum("num_correct"), F.lit(0)).cast("bigint").alias("passed_solutions"),
            F.count(F.lit(1)).alias("total_problems"), F.min("num_samples").alias("_min_n")]
    for k in ks:
        est = est.withColumn(f"_p{k}", pass_at_k("num_samples", "num_correct", F.lit(k)))
        aggs.append(F.avg(f"_p{k}").alias(f"_m{k}"))
    out = (est.groupBy(*by) if by else est.groupBy()).agg(*aggs)
    out = out.withColumn("pass_rate", safe_ratio("passed_solutions", "total_solutions"))
    for k in ks:
        out = out.withColumn(f"pass_at_{k}", F.when(F.col("_min_n") >= k, F.col(f"_m{k}")))
    method = "sequential" if max_workers == 1 else "multithreaded"
    return (out.drop("_min_n", *[f"_m{k}" for k in ks])
            .withColumn("execution_method", F.lit(method))
            .withColumn("max_workers", F.lit(max_workers)))


def poisson_bootstrap(replicates: int = 200, level: float = 0.95):
    """A grouped-aggregate Arrow UDF (task, estimate) -> [low, high]: bootstrap interval of the mean estimate over tasks.

    Each replicate weights every task by a Poisson(1) count drawn from the hash
    of (task, replicate), so neither the order nor the split of the rows
    matters and a rerun agrees. Replicates without any weight are left out; a
    group without an estimate has no interval.
    """
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])

    @F.arrow_udf("array<double>")
    def interval(task: pa.Array, estimate: pa.Array) -> Any:
        kept = [(t, e) for t, e in zip(task.to_pylist(), estimate.to_pylist()) if e is not None]
        value = np.array([e for _, e in kept])
        means = []
        for r in range(replicates if kept else 0):
            u = np.array([int(hashlib.md5(f"{t}/{r}".encode()).hexdigest()[:8], 16) for t, _ in kept]) / 2.0 ** 32
            weight = np.searchsorted(steps, u, side="right")
            if weight.sum():
                means.append(float((weight * value).sum() / weight.sum()))
        return [float(x) for x in np.quantile(means, [(1 - level) / 2, (1 + level) / 2])] if means else None

    return interval


def pass_at_k_interval(problems: DataFrame, by: Sequence[str], k: int = 1, task: str = "task_id", replicates: int = 200) -> DataFrame:
    """Mean pass@k per group with its bootstrap interval over problems (rows of a group: one per problem)."""
    est = with_pass_at_k(problems, k, "_pk")
    out = est.groupBy(*by).agg(poisson_bootstrap(replicates)(F.col(task).cast("string"), F.col("_pk")).alias("_i"))
    mean = est.groupBy(*by).agg(F.avg("_pk").alias("pass_at_k"))
    return mean.join(out, list(by)).select(*by, "pass_at_k", F.col("_i")[0].alias("low"), F.col("_i")[1].alias("high"))


# -- submissions ---------------------------------------------------------------------

# The fields of a model card, and what each must look like.
CARD_FIELDS = ("Provider", "Version", "Parameters", "License", "Dataset", "Samples", "Date", "Hardware", "Pass@1", "Pass@5", "Pass@10")
CARD_RULES = (
    *((f"missing {f}", f"coalesce(trim(fields['{f}']), '') <> ''") for f in CARD_FIELDS),
    ("no date", "fields['Date'] IS NULL OR fields['Date'] RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'"),
    *((f"{f} is no percentage", f"fields['{f}'] IS NULL OR fields['{f}'] RLIKE '^[0-9]+([.][0-9]+)?%$'") for f in CARD_FIELDS if f.startswith("Pass@")),
    ("samples stated differently", "fields['Samples'] IS NULL OR min_samples IS NULL OR coalesce(try_cast(regexp_extract(fields['Samples'], '[0-9]+', 0) AS bigint), 0) <= min_samples"),
    (f"fewer than {MIN_SUBMISSION_SAMPLES} samples for some problem", f"coalesce(min_samples, 0) >= {MIN_SUBMISSION_SAMPLES}"),
    ("results are not valid JSON", "coalesce(bad_lines, 0) = 0"),
    ("not one model", "coalesce(models, 0) = 1"),
)


def read_cards(spark, path: str) -> DataFrame:
    """(file, title, fields): model cards in Markdown, one a file; fields are its ``**name**: value`` pairs, the first of a name counts."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    pairs = F.transform(F.regexp_extract_all("value", F.lit(r"(?m)^\s*(?:[-*]\s+)?\*\*([^*\n]+)\*\*:[ \t]*([^\r\n]*)"), F.lit(0)), lambda line: F.struct(
        F.regexp_extract(line, r"\*\*([^*]+)\*\*:", 1).alias("key"), F.trim(F.regexp_extract(line, r"\*\*:[ \t]*(.*)$", 1)).alias("value")))
    once = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)
    return whole.select("file", F.regexp_extract("value", r"(?m)^#\s+(.*)$", 1).alias("title"), F.map_from_entries(once).alias("fields"))


def read_submitted(spark, path: str) -> DataFrame:
    """(file, models, min_samples, bad_lines) of submitted result files, one submission a file."""
    keys = "model_name string, task_id string, sample_index bigint"
    rows = spark.read.text(path).where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"), F.from_json("value", keys).alias("r"), F.json_object_keys("value").isNull().alias("bad"))
    counts = rows.groupBy("file", "r.model_name", "r.task_id", "bad").agg(F.count(F.lit(1)).alias("n"))
    good = ~F.col("bad")
    names = counts.where(good).select("file", "model_name").distinct().groupBy("file").agg(F.count("model_name").alias("models"))
    return counts.groupBy("file").agg(F.min(F.when(good, F.col("n"))).alias("min_samples"),
                                      F.sum(F.when(good, 0).otherwise(F.col("n"))).alias("bad_lines")).join(names, "file", "left")


def submission_report(cards: DataFrame, submitted: DataFrame, key: str = "submission", rules=CARD_RULES) -> DataFrame:
    """(key, accepted, reasons): each card with its results against the table of rules (name, what must hold in SQL)."""
    both = cards.join(submitted, key, "left")
    broken = F.filter(F.array(*[F.when(~F.coalesce(F.expr(f"({must})"), F.lit(False)), F.lit(name)) for name, must in rules]), lambda x: x.isNotNull())
    return both.select(key, (F.size(broken) == 0).alias("accepted"), F.array_join(broken, "; ").alias("reasons"))
