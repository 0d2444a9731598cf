"""Registered measurement-analysis queries (latency, throughput, memory, trials)."""

from __future__ import annotations

from pyspark.sql import functions as F

from passkit.functions.text import sql_word_count, word_count
from passkit.operators import perf as P
from passkit.operators.ordering import row_index
from passkit.plans import views as V
from passkit.plans.oracle_views import with_views
from passkit.plans.registry import register
from passkit.sources.tables import table

R = 9


def r(c):
    return F.round(F.col(c) if isinstance(c, str) else c, R)


def _rounded(df, cols):
    for c in cols:
        df = df.withColumn(c, r(c))
    return df


@register("drop_warmup", with_views(["measurements"], """
SELECT model, event_id, run FROM measurements WHERE run > 2"""))
def q_drop_warmup(spark, d):
    return P.drop_warmup(V.measurements(spark, d), 2).select("model", "event_id", "run")


_STATS = ["mean", "stdev", "min", "max", "median", "p95", "p99"]


@register("latency_stats", with_views(["measurements"], """
SELECT model, round(avg(latency), 9) AS mean, round(coalesce(stddev_samp(latency), 0.0), 9) AS stdev,
       round(min(latency), 9) AS min, round(max(latency), 9) AS max, count(latency) AS samples,
       round(quantile_cont(latency, 0.5), 9) AS median, round(quantile_cont(latency, 0.95), 9) AS p95,
       round(quantile_cont(latency, 0.99), 9) AS p99
FROM measurements WHERE run > 2 GROUP BY model"""))
def q_latency_stats(spark, d):
    """Statistics of the measured (post-warm-up) latencies per model."""
    runs = P.drop_warmup(V.measurements(spark, d), 2)
    return _rounded(P.latency_stats(runs, ["model"]), _STATS)


@register("latency_percentiles", with_views(["measurements"], """
SELECT model, round(quantile_cont(latency, 0.05), 9) AS p05, round(quantile_cont(latency, 0.5), 9) AS p50,
       round(quantile_cont(latency, 0.95), 9) AS p95
FROM measurements GROUP BY model"""))
def q_latency_percentiles(spark, d):
    from passkit.operators.quantiles import exact_percentiles
    out = exact_percentiles(V.measurements(spark, d), ["model"], "latency", [0.05, 0.5, 0.95], ["p05", "p50", "p95"])
    return _rounded(out, ["p05", "p50", "p95"])


@register("token_count", with_views(["texts"], f"""
SELECT doc_id, CAST({sql_word_count('text')} AS INTEGER) AS words FROM texts"""))
def q_token_count(spark, d):
    return V.texts(spark, d).select("doc_id", word_count(F.col("text")).alias("words"))


_OUTPUTS_SQL = """(SELECT event_type AS model, CAST(1 + user_id % 4 AS INTEGER) AS batch_size,
                          value / 100.0 AS elapsed, props AS text FROM events)"""


def _outputs(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("model"), (F.lit(1) + F.col("user_id") % 4).cast("int").alias("batch_size"),
                    (F.col("value") / 100.0).alias("elapsed"), F.col("props").alias("text"))


_TP_SQL = f"""
SELECT model, batch_size, total_time, total_outputs, total_tokens,
       coalesce(total_outputs / nullif(total_time, 0), 0.0) AS throughput_requests_per_sec,
       coalesce(total_tokens / nullif(total_time, 0), 0.0) AS throughput_tokens_per_sec,
       coalesce(total_time / nullif(batch_size, 0), 0.0) AS avg_time_per_request
FROM (SELECT model, batch_size, sum(elapsed) AS total_time, count(*) AS total_outputs,
             CAST(sum(CASE WHEN coalesce(text, '') <> '' THEN {sql_word_count('text')} ELSE 0 END) AS BIGINT) AS total_tokens
      FROM {_OUTPUTS_SQL} GROUP BY model, batch_size)"""
_TP_COLS = ["total_time", "throughput_requests_per_sec", "throughput_tokens_per_sec", "avg_time_per_request"]


@register("throughput", f"""
SELECT model, batch_size, round(total_time, 9) AS total_time, total_outputs, total_tokens,
       round(throughput_requests_per_sec, 9) AS throughput_requests_per_sec,
       round(throughput_tokens_per_sec, 9) AS throughput_tokens_per_sec,
       round(avg_time_per_request, 9) AS avg_time_per_request
FROM ({_TP_SQL})""")
def q_throughput(spark, d):
    return _rounded(P.throughput(_outputs(spark, d), ["model"]), _TP_COLS)


@register("best_batch_size", f"""
SELECT model, arg_min(batch_size, (-throughput_tokens_per_sec, batch_size)) AS best_batch_size,
       round(max(throughput_tokens_per_sec), 9) AS peak_tokens_per_sec
FROM ({_TP_SQL}) GROUP BY model""")
def q_best_batch_size(spark, d):
    tp = P.throughput(_outputs(spark, d), ["model"])
    return _rounded(P.best_batch_size(tp, ["model"]), ["peak_tokens_per_sec"])


@register("benchmark_report", with_views(["measurements", "trials"], f"""
SELECT coalesce(l.model, b.model, m.model) AS model, round(l.mean, 9) AS latency_mean, round(l.p95, 9) AS latency_p95,
       b.best_batch_size, round(b.peak, 9) AS peak_tokens_per_sec, b.batches,
       round(m.peak_mb, 6) AS peak_memory_mb, round(m.increase_mb, 6) AS mean_memory_increase_mb
FROM (SELECT model, avg(latency) AS mean, quantile_cont(latency, 0.95) AS p95 FROM measurements WHERE run > 2 GROUP BY model) l
FULL JOIN (SELECT model, arg_min(batch_size, (-throughput_tokens_per_sec, batch_size)) AS best_batch_size,
             max(throughput_tokens_per_sec) AS peak, count(*) AS batches
      FROM ({_TP_SQL}) GROUP BY model) b ON l.model = b.model
FULL JOIN (SELECT model, max(greatest(start_memory_gb + memory_used_gb, start_memory_gb)) * 1024 AS peak_mb,
                  avg(memory_used_gb) * 1024 AS increase_mb FROM trials GROUP BY model) m ON m.model = coalesce(l.model, b.model)"""))
def q_benchmark_report(spark, d):
    """Latency, throughput and memory summaries of each model in one row; a model without one of them keeps the others."""
    lat = P.latency_stats(P.drop_warmup(V.measurements(spark, d), 2), ["model"])
    tp = P.throughput(_outputs(spark, d), ["model"])
    mem = P.memory_delta(F.col("start_memory_gb") * P.GB, (F.col("start_memory_gb") + F.col("memory_used_gb")) * P.GB,
                         F.greatest(F.col("start_memory_gb") + F.col("memory_used_gb"), F.col("start_memory_gb")) * P.GB)
    best = P.best_batch_size(tp, ["model"], extra=[F.count(F.lit(1)).alias("batches")])
    used = V.trials(spark, d).groupBy("model").agg(
        F.round(F.max(mem["peak_memory_mb"]), 6).alias("peak_memory_mb"), F.round(F.avg(mem["memory_increase_mb"]), 6).alias("mean_memory_increase_mb"))
    # one row per model and summary, folded into one per model: no join, and a NULL model stays one row
    parts = lat.select("model", F.col("mean").alias("latency_mean"), F.col("p95").alias("latency_p95"))
    for more in (best, used):
        parts = parts.unionByName(more, allowMissingColumns=True)
    out = parts.groupBy("model").agg(*[F.max(c).alias(c) for c in parts.columns if c != "model"])
    return _rounded(out, ["latency_mean", "latency_p95", "peak_tokens_per_sec"])


@register("memory_delta", with_views(["trials"], """
SELECT trial_no, max_tokens,
       round(start_memory_gb * 1024, 9) AS initial_memory_mb,
       round((start_memory_gb + memory_used_gb) * 1024, 9) AS final_memory_mb,
       round(greatest(start_memory_gb + memory_used_gb, start_memory_gb) * 1024, 9) AS peak_memory_mb,
       round(memory_used_gb * 1024, 9) AS memory_increase_mb
FROM trials"""))
def q_memory_delta(spark, d):
    t = V.trials(spark, d)
    gb = P.GB
    ini = F.col("start_memory_gb") * gb
    fin = (F.col("start_memory_gb") + F.col("memory_used_gb")) * gb
    cols = P.memory_delta(ini, fin, F.greatest(fin, ini))
    return t.select("trial_no", "max_tokens", *[r(c).alias(n) for n, c in cols.items()])


@register("config_grid", with_views(["trials"], """
SELECT model, tp AS tensor_parallel_size, mt AS max_tokens, bs AS batch_size
FROM (SELECT DISTINCT model FROM trials), unnest([1, 2, 4, 8]) a(tp), unnest([256, 512, 1024]) b(mt),
     unnest([1, 2, 4, 8, 16, 32]) c(bs)"""))
def q_config_grid(spark, d):
    models = V.trials(spark, d).select("model").distinct()
    return P.config_grid(models, [1, 2, 4, 8], [256, 512, 1024], [1, 2, 4, 8, 16, 32])


@register("cycle_prompts", with_views(["trials", "problems"], """
SELECT t.trial_no, CAST(s.slot AS INTEGER) AS slot, p.task_id
FROM trials t, range(0, t.batch_size) s(slot),
     (SELECT task_id, row_number() OVER (ORDER BY item_id) - 1 AS pos, count(*) OVER () AS n FROM problems) p
WHERE p.pos = s.slot % p.n"""))
def q_cycle_prompts(spark, d):
    prompts = row_index(V.problems(spark, d).select("task_id", "item_id"), [], ["item_id"], "prompt_pos")
    b = V.trials(spark, d).select("trial_no", "batch_size")
    out = P.cycle_prompts(b, prompts.select("prompt_pos", "task_id"), "batch_size")
    return out.select("trial_no", F.col("slot").cast("int").alias("slot"), "task_id")


@register("trial_metrics", with_views(["trials"], """
SELECT trial_no, round(coalesce(tokens_generated / nullif(total_time_seconds, 0), 0.0), 9) AS tps,
       round(coalesce(batch_size / nullif(total_time_seconds, 0), 0.0), 9) AS requests_per_second,
       round(memory_used_gb, 9) AS memory_delta_gb,
       round(greatest(start_memory_gb + memory_used_gb, start_memory_gb), 9) AS peak_memory_gb
FROM trials"""))
def q_trial_metrics(spark, d):
    t = P.trial_metrics(V.trials(spark, d))
    return _rounded(t.select("trial_no", "tps", "requests_per_second", "memory_delta_gb", "peak_memory_gb"),
                    ["tps", "requests_per_second", "memory_delta_gb", "peak_memory_gb"])


@register("best_trials", with_views(["trials"], """
SELECT model, arg_min(trial_no, (-tokens_per_second, trial_no)) AS best_throughput_trial,
       round(max(tokens_per_second), 9) AS max_tokens_per_second,
       arg_min(trial_no, (memory_used_gb, trial_no)) AS best_memory_trial,
       round(min(memory_used_gb), 9) AS min_memory_used_gb
FROM trials WHERE error IS NULL GROUP BY model"""))
def q_best_trials(spark, d):
    return _rounded(P.best_trials(V.trials(spark, d)), ["max_tokens_per_second", "min_memory_used_gb"])


@register("balanced_trial", with_views(["trials"], """
SELECT model, arg_min(trial_no, (-score, trial_no)) AS balanced_trial, round(max(score), 9) AS balanced_score
FROM (SELECT model, trial_no,
             0.7 * (tokens_per_second / max(tokens_per_second) OVER (PARTITION BY model))
             + 0.3 * CASE WHEN max(memory_used_gb) OVER (PARTITION BY model) > 0
                          THEN 1.0 - memory_used_gb / max(memory_used_gb) OVER (PARTITION BY model) ELSE 1.0 END AS score
      FROM trials WHERE error IS NULL)
GROUP BY model"""))
def q_balanced_trial(spark, d):
    return _rounded(P.balanced_trial(V.trials(spark, d)), ["balanced_score"])


@register("profile_summary", with_views(["trials"], """
SELECT model, count(*) AS configurations_tested, CAST(count_if(error IS NULL) AS BIGINT) AS valid_configurations,
       round(max(tokens_per_second) FILTER (WHERE error IS NULL), 9) AS max_tokens_per_second,
       round(min(memory_used_gb) FILTER (WHERE error IS NULL), 9) AS min_memory_usage_gb
FROM trials GROUP BY model"""))
def q_profile_summary(spark, d):
    return _rounded(P.profile_summary(V.trials(spark, d)), ["max_tokens_per_second", "min_memory_usage_gb"])


@register("latency_sketch_percentiles", with_views(["measurements"], """
SELECT model, p, n, true AS within_error
FROM (SELECT model, count(latency) AS n FROM measurements GROUP BY model), (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) v(p)"""))
def q_latency_sketch_percentiles(spark, d):
    """Percentiles per model from stored sketches per model and day, and whether each one's exact rank is within a hundredth of p."""
    from passkit.operators.quantiles import quantile_sketches, sketched_percentiles
    from passkit.session import materialize
    e = table(spark, d, "events").select(F.col("event_type").alias("model"), F.to_date("ts").alias("day"), F.col("value").alias("latency"))
    daily = materialize(quantile_sketches(e, ["model", "day"], "latency"), "latency-sketches")
    found = materialize(sketched_percentiles(daily, ["model"], [0.05, 0.5, 0.95, 0.99]), "sketched-percentiles")
    wide = found.groupBy("model").agg(F.collect_list(F.struct("p", "n", "value")).alias("found"))
    ranks = e.where(F.col("latency").isNotNull()).join(wide, "model").select("model", "latency", F.inline("found"))
    ranks = ranks.groupBy("model", "p", "n").agg(F.count_if(F.col("latency") < F.col("value")).alias("below"), F.count_if(F.col("latency") <= F.col("value")).alias("upto"))
    inside = (F.col("below") <= (F.col("p") + 0.01) * F.col("n")) & (F.col("upto") >= (F.col("p") - 0.01) * F.col("n"))
    return ranks.select("model", "p", "n", inside.alias("within_error"))
