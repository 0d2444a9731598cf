"""Statistics over recorded measurement runs and profiling trials.

Per-model choices ("best trial", "best batch size") are ``min_by`` /
``max_by`` aggregations on an ordering struct, which combine map-side;
normalising by a per-model maximum joins a models-sized table back instead
of running a window over all rows of a model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passkit.functions.metrics import safe_ratio
from passkit.functions.text import word_count
from passkit.operators.ordering import join_back
from passkit.operators.quantiles import exact_percentiles
from passkit.session import materialize

MB = 1024.0 ** 2
GB = 1024.0 ** 3


def run_rank(df: DataFrame, keys: Sequence[str], order: str, name: str = "run") -> DataFrame:
    """Dense rank of ``order`` within ``keys``, computed on the distinct (keys, order) pairs.

    The pairs' ranks are written to the shared folder once, so later scans
    join a table of known size instead of ranking again.
    """
    keys = list(keys)
    distinct = df.select(*keys, order).distinct()
    ranked = distinct.withColumn(name, F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)))
    return join_back(df, materialize(ranked, "run-ranks"), [*keys, order])


def drop_warmup(runs: DataFrame, warmup: int, run: str = "run") -> DataFrame:
    """The first ``warmup`` runs are not measured."""
    return runs.where(F.col(run) > warmup)


def latency_stats(runs: DataFrame, keys: Sequence[str], value: str = "latency", exact: bool = True,
                  accuracy: int = 100_000) -> DataFrame:
    """mean, median, sample stdev (0.0 for one value), min, max, p95, p99 per group.

    ``exact=False`` answers the percentiles from the quantile sketch alone
    (one pass, rank error <= n / accuracy, no interpolation) -- the opt-in
    for very large inputs where the exact refinement pass is not wanted.
    """
    keys = list(keys)
    if not exact:
        x = F.col(value)
        return runs.groupBy(*keys).agg(
            F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("stdev"),
            F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("samples"),
            F.percentile_approx(x, [0.5, 0.95, 0.99], accuracy).alias("_q")
        ).select(*keys, "mean", "stdev", "min", "max", "samples", F.col("_q")[0].alias("median"),
                 F.col("_q")[1].alias("p95"), F.col("_q")[2].alias("p99"))
    v = F.col("_v")
    return exact_percentiles(runs, keys, value, [0.5, 0.95, 0.99], ["median", "p95", "p99"], extra_aggs=[
        F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("samples")])


def throughput(outputs: DataFrame, keys: Sequence[str], batch_size: str = "batch_size",
               elapsed: str = "elapsed", text: str = "text") -> DataFrame:
    """Per batch size: time, outputs, tokens, requests/s, tokens/s, time per request (0-guarded)."""
    g = outputs.groupBy(*keys, batch_size).agg(
        F.sum(elapsed).alias("total_time"), F.count(F.lit(1)).alias("total_outputs"),
        F.sum(F.when(F.coalesce(F.col(text), F.lit("")) != "", word_count(F.col(text))).otherwise(0))
        .cast("bigint").alias("total_tokens"))
    return (g.withColumn("throughput_requests_per_sec", safe_ratio("total_outputs", "total_time"))
            .withColumn("throughput_tokens_per_sec", safe_ratio("total_tokens", "total_time"))
            .withColumn("avg_time_per_request", safe_ratio("total_time", batch_size)))


def memory_delta(initial_bytes: Column, final_bytes: Column, peak_bytes: Column) -> dict[str, Column]:
    return {"initial_memory_mb": initial_bytes / MB, "final_memory_mb": final_bytes / MB,
            "peak_memory_mb": peak_bytes / MB, "memory_increase_mb": (final_bytes - initial_bytes) / MB}


def config_grid(models: DataFrame, tp_sizes: Sequence[int], max_tokens: Sequence[int],
                batch_sizes: Sequence[int]) -> DataFrame:
    """tensor-parallel x max_tokens x batch per model, as three generator columns (no join)."""
    arr = lambda xs: F.array(*[F.lit(int(x)) for x in xs])
    return (models.withColumn("tensor_parallel_size", F.explode(arr(tp_sizes)))
            .withColumn("max_tokens", F.explode(arr(max_tokens)))
            .withColumn("batch_size", F.explode(arr(batch_sizes))))


def cycle_prompts(batches: DataFrame, prompts: DataFrame, size: str) -> DataFrame:
    """Each batch of ``size`` takes prompts[i % n] for i in 0..size-1 (repeat, then cut).

    ``prompts`` carries a 0-based ``prompt_pos`` (0 to n-1, each once) and is written to the
    shared folder once; slots are generated per batch and joined to the
    prompts that any batch reaches on ``pmod(slot, n)``. Spark takes the slots for as small as
    the batches they are made of; the join is a left one (every slot has a prompt), so
    that it can broadcast the prompts, if they are small, but never the slots.
    """
    prompts = materialize(prompts, "prompts")
    n_prompts = prompts.select(F.count(F.lit(1))).scalar()  # scalar subquery, no driver round trip
    most = F.max(F.when(F.col(size) < 1, F.lit(1 << 62)).otherwise(F.col(size)))  # slots below 0 wrap to the last prompts
    reached = prompts.where(F.col("prompt_pos") < batches.select(most).scalar())
    slots = batches.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col(size) - 1))).where(n_prompts > 0)
    slots = slots.withColumn("prompt_pos", F.pmod(F.col("slot"), n_prompts))
    return slots.join(reached, on="prompt_pos", how="left")


def trial_metrics(trials: DataFrame) -> DataFrame:
    """tokens, tokens/s, requests/s, memory used and peak from the raw trial columns."""
    end = F.col("start_memory_gb") + F.col("memory_used_gb")
    return (trials.withColumn("tps", safe_ratio("tokens_generated", "total_time_seconds"))
            .withColumn("requests_per_second", safe_ratio("batch_size", "total_time_seconds"))
            .withColumn("end_memory_gb", end)
            .withColumn("memory_delta_gb", end - F.col("start_memory_gb"))
            .withColumn("peak_memory_gb", F.greatest(end, F.col("start_memory_gb"))))


def valid_trials(trials: DataFrame) -> DataFrame:
    return trials.where(F.col("error").isNull())


def best_trials(trials: DataFrame, key: str = "model", tps: str = "tokens_per_second",
                mem: str = "memory_used_gb", order: str = "trial_no") -> DataFrame:
    """Per model: fastest trial and leanest trial among valid ones; the earlier trial wins ties.

    A trial without a measurement cannot win by it (NULL orders are skipped by ``min_by``).
    """
    v = valid_trials(trials)

    def rank(metric, c):
        return F.when(F.col(c).isNotNull(), F.struct(metric.alias("a"), F.col(order).alias("b")))

    return v.groupBy(key).agg(
        F.min_by(F.col(order), rank(-F.col(tps), tps)).alias("best_throughput_trial"),
        F.max(tps).alias("max_tokens_per_second"),
        F.min_by(F.col(order), rank(F.col(mem), mem)).alias("best_memory_trial"),
        F.min(mem).alias("min_memory_used_gb"))


def balanced_trial(trials: DataFrame, key: str = "model", tps: str = "tokens_per_second",
                   mem: str = "memory_used_gb", order: str = "trial_no") -> DataFrame:
    """0.7 * t / max(t) + 0.3 * (1 - m / max(m)); throughput term 0 when max(t) is 0, memory term 1 when
    max(m) <= 0; a trial without a measurement has no score; earlier trial wins ties."""
    v = valid_trials(trials)
    mx = v.groupBy(key).agg(F.max(tps).alias("_mt"), F.max(mem).alias("_mm"))
    s = v.join(mx.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).drop("_key").withColumn(
        "score", F.lit(0.7) * F.when(F.col("_mt") == 0, F.lit(0.0)).otherwise(F.col(tps) / F.col("_mt"))
        + F.lit(0.3) * F.when(F.col("_mm") > 0, F.lit(1.0) - F.col(mem) / F.col("_mm")).otherwise(F.lit(1.0)))
    return s.groupBy(key).agg(
        F.min_by(F.struct(F.col(order).alias("trial_no"), F.col("score").alias("score")),
                 F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("a"), F.col(order).alias("b")))).alias("_b")
    ).select(key, F.col("_b.trial_no").alias("balanced_trial"), F.col("_b.score").alias("balanced_score"))


def profile_summary(trials: DataFrame, key: str = "model", tps: str = "tokens_per_second",
                    mem: str = "memory_used_gb") -> DataFrame:
    ok = F.col("error").isNull()
    return trials.groupBy(key).agg(
        F.count(F.lit(1)).alias("configurations_tested"), F.count_if(ok).alias("valid_configurations"),
        F.max(F.when(ok, F.col(tps))).alias("max_tokens_per_second"),
        F.min(F.when(ok, F.col(mem))).alias("min_memory_usage_gb"))


def best_batch_size(tp: DataFrame, keys: Sequence[str], batch_size: str = "batch_size",
                    metric: str = "throughput_tokens_per_sec", extra: Sequence[Column] = ()) -> DataFrame:
    """The batch size with the most tokens/s; the smaller batch size wins ties. ``extra`` aggregates come along."""
    return tp.groupBy(*keys).agg(
        F.min_by(F.col(batch_size), F.struct((-F.col(metric)).alias("a"), F.col(batch_size).alias("b"))).alias("best_batch_size"),
        F.max(metric).alias("peak_tokens_per_sec"), *extra)
