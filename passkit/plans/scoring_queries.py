"""Registered scoring queries (per-problem counts, pass@k, leaderboards)."""

from __future__ import annotations

from pyspark.sql import functions as F

from passkit.operators import scoring as S
from passkit.plans import views as V
from passkit.plans.oracle_views import sql_pass_at_k, with_views
from passkit.plans.registry import register

R = 9  # decimals kept in float outputs so both engines hash the same values


def r(c, digits: int = R):
    return F.round(c if not isinstance(c, str) else F.col(c), digits)


# -- V2: events as one model's results ------------------------------------------------

@register("per_problem", with_views(["results"], """
SELECT task_id, count(*) AS num_samples, CAST(count_if(coalesce(passed, false)) AS BIGINT) AS num_correct
FROM results GROUP BY task_id"""))
def q_per_problem(spark, d):
    return S.per_problem(V.results(spark, d, sample_index=False).select("task_id", "passed"))


@register("totals", with_views(["results"], """
SELECT CAST(count(*) AS BIGINT) AS total_solutions,
       CAST(count_if(coalesce(passed, false)) AS BIGINT) AS passed_solutions,
       round(coalesce(count_if(coalesce(passed, false)) / nullif(count(*), 0), 0.0), 9) AS pass_rate,
       count(DISTINCT task_id) AS total_problems
FROM results"""))
def q_totals(spark, d):
    t = S.totals(V.results_counts(spark, d))
    return t.withColumn("pass_rate", r("pass_rate"))


@register("pass_at_k_per_problem", with_views(["results"], f"""
SELECT task_id, num_samples, num_correct, k, round({sql_pass_at_k('num_samples', 'num_correct', 'k')}, 9) AS pass_at_k
FROM (SELECT task_id, count(*) AS num_samples, CAST(count_if(passed) AS BIGINT) AS num_correct
      FROM results GROUP BY task_id), (SELECT unnest([1, 5, 10, 20, 50]) AS k)"""))
def q_pass_at_k_per_problem(spark, d):
    pp = V.results_counts(spark, d).drop("model_name")
    pp = pp.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 5, 10, 20, 50)])))
    return pp.withColumn("pass_at_k", r(S.pass_at_k("num_samples", "num_correct", F.col("k"))))


@register("pass_at_k", with_views(["results"], f"""
SELECT k, round(coalesce(avg({sql_pass_at_k('num_samples', 'num_correct', 'k')}), 0.0), 9) AS pass_at_k
FROM (SELECT task_id, count(*) AS num_samples, CAST(count_if(passed) AS BIGINT) AS num_correct
      FROM results GROUP BY task_id), (SELECT unnest([1, 5, 10, 20, 50, 100]) AS k)
GROUP BY k"""))
def q_pass_at_k(spark, d):
    """Ungated mean pass@k for every k (the estimator is 1.0 where n < k)."""
    pp = V.results_counts(spark, d)
    pp = pp.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 5, 10, 20, 50, 100)])))
    pp = pp.withColumn("_p", S.pass_at_k("num_samples", "num_correct", F.col("k")))
    return pp.groupBy("k").agg(r(F.coalesce(F.avg("_p"), F.lit(0.0))).alias("pass_at_k"))


@register("pass_at_k_gated", with_views(["results"], f"""
SELECT k, round(avg({sql_pass_at_k('num_samples', 'num_correct', 'k')}), 9) AS pass_at_k
FROM (SELECT task_id, count(*) AS num_samples, CAST(count_if(passed) AS BIGINT) AS num_correct
      FROM results GROUP BY task_id), (SELECT unnest([1, 5, 10, 20, 50, 100]) AS k)
GROUP BY k HAVING min(num_samples) >= k"""))
def q_pass_at_k_gated(spark, d):
    g = S.gated_pass_at_k(V.results_counts(spark, d))
    return g.withColumn("pass_at_k", r("pass_at_k"))


@register("pass_at_k_zeros", with_views(["results_z"], f"""
SELECT k, round(avg({sql_pass_at_k('num_samples', 'num_correct', 'k')}), 9) AS pass_at_k,
       CAST(count_if(num_correct = 0) AS BIGINT) AS zero_problems
FROM (SELECT task_id, count(*) AS num_samples, CAST(count_if(passed) AS BIGINT) AS num_correct
      FROM results_z GROUP BY task_id), (SELECT unnest([1, 5, 10, 20]) AS k)
GROUP BY k"""))
def q_pass_at_k_zeros(spark, d):
    """V2z: problems with no correct sample must score exactly 0 (the c = 0 guard)."""
    pp = V.results_counts(spark, d, zeros=True)
    pp = pp.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 5, 10, 20)])))
    pp = pp.withColumn("_p", S.pass_at_k("num_samples", "num_correct", F.col("k")))
    return pp.groupBy("k").agg(r(F.avg("_p")).alias("pass_at_k"),
                               F.count_if(F.col("num_correct") == 0).alias("zero_problems"))


@register("running_pass_rate", with_views(["results"], """
SELECT model_name, event_id,
       CAST(count(*) OVER w AS BIGINT) AS running_total,
       CAST(sum(CAST(passed AS INTEGER)) OVER w AS BIGINT) AS running_passed,
       round(sum(CAST(passed AS INTEGER)) OVER w / count(*) OVER w, 9) AS running_pass_rate
FROM results
WINDOW w AS (PARTITION BY model_name ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def q_running_pass_rate(spark, d):
    res = V.results(spark, d, sample_index=False).select("model_name", "event_id", "passed")
    out = S.running_pass_rate(res, "model_name", "event_id")
    return out.select("model_name", "event_id", "running_total", "running_passed",
                      r("running_pass_rate").alias("running_pass_rate"))


@register("metric_text", with_views(["results"], f"""
SELECT model_name, string_agg(printf('Pass@%d: %.3f', k, p), ', ' ORDER BY k) AS metrics_text
FROM (SELECT model_name, k, avg({sql_pass_at_k('num_samples', 'num_correct', 'k')}) AS p
      FROM (SELECT model_name, task_id, count(*) AS num_samples, CAST(count_if(passed) AS BIGINT) AS num_correct
            FROM results GROUP BY model_name, task_id), (SELECT unnest([1, 5, 10, 20, 50, 100]) AS k)
      GROUP BY model_name, k HAVING min(num_samples) >= k)
GROUP BY model_name"""))
def q_metric_text(spark, d):
    g = S.gated_pass_at_k(V.results_counts(spark, d), ["model_name"])
    return S.metric_text(g, ["model_name"])


def _summary_sql() -> str:
    cols = ",\n       ".join(
        f"CASE WHEN min(num_samples) >= {k} THEN round(avg({sql_pass_at_k('num_samples', 'num_correct', str(k))}), 9) END"
        f" AS pass_at_{k}" for k in (1, 5, 10, 20, 50, 100))
    return with_views(["results"], f"""
SELECT model_name, CAST(sum(num_samples) AS BIGINT) AS total_solutions,
       CAST(sum(num_correct) AS BIGINT) AS passed_solutions, count(*) AS total_problems,
       round(sum(num_correct) / sum(num_samples), 9) AS pass_rate,
       {cols},
       'sequential' AS execution_method, 1 AS max_workers
FROM (SELECT model_name, task_id, count(*) AS num_samples, CAST(count_if(passed) AS BIGINT) AS num_correct
      FROM results GROUP BY model_name, task_id)
GROUP BY model_name""")


@register("summary", _summary_sql())
def q_summary(spark, d):
    """The summary document's fields per model (per-problem rows stay a table)."""
    pp = V.results_counts(spark, d)
    s = S.summary(pp, ["model_name"], max_workers=1)
    for c in ["pass_rate"] + [f"pass_at_{k}" for k in (1, 5, 10, 20, 50, 100)]:
        s = s.withColumn(c, r(c))
    return s


# -- V3: lineitem attempts, 25 models ------------------------------------------------

_ATTEMPT_COUNTS = """(SELECT model, category, task_id, count(*) AS num_samples,
        CAST(count_if(passed) AS BIGINT) AS num_correct FROM attempts GROUP BY model, category, task_id)"""


def _board_sql(extra: str = "") -> str:
    p = {k: sql_pass_at_k("num_samples", "num_correct", str(k)) for k in (1, 5, 10)}
    return f"""board AS (
  SELECT model, category,
         round(avg({p[1]}), 9) AS pass_at_1,
         CASE WHEN min(num_samples) >= 5 THEN round(avg({p[5]}), 9) END AS pass_at_5,
         CASE WHEN min(num_samples) >= 10 THEN round(avg({p[10]}), 9) END AS pass_at_10
  FROM {_ATTEMPT_COUNTS} GROUP BY model, category)"""


def _board(spark, d):
    pp = V.attempt_counts(spark, d)
    # category (the model's region) is functionally dependent on the model
    b = S.leaderboard(pp, "model", carry=["category"])
    for k in (1, 5, 10):
        b = b.withColumn(f"pass_at_{k}", r(f"pass_at_{k}"))
    return b


@register("leaderboard", with_views(["attempts"], """
SELECT model, pass_at_1, pass_at_5, pass_at_10, CAST(rank() OVER (ORDER BY pass_at_1 DESC) AS INTEGER) AS rank
FROM board""", (_board_sql(),)))
def q_leaderboard(spark, d):
    return _board(spark, d).select("model", "pass_at_1", "pass_at_5", "pass_at_10", "rank")


@register("leaderboard_categories", with_views(["attempts"], """
SELECT category, CAST(count(*) AS BIGINT) AS models, grouping(category) = 1 AS is_total
FROM (SELECT DISTINCT model, category FROM attempts)
GROUP BY ROLLUP (category)"""))
def q_leaderboard_categories(spark, d):
    return S.leaderboard_categories(_board(spark, d), "category")


@register("leaderboard_best", with_views(["attempts"], """
SELECT metric, model, value FROM (
  SELECT metric, model, value, row_number() OVER (PARTITION BY metric ORDER BY value DESC, model) AS rn
  FROM (SELECT model, 'pass_at_1' AS metric, pass_at_1 AS value FROM board
        UNION ALL SELECT model, 'pass_at_5', pass_at_5 FROM board
        UNION ALL SELECT model, 'pass_at_10', pass_at_10 FROM board)
  WHERE value IS NOT NULL)
WHERE rn = 1""", (_board_sql(),)))
def q_leaderboard_best(spark, d):
    return S.leaderboard_best(_board(spark, d), "model")


@register("wilson_interval", with_views(["attempts"], """
SELECT model, total_solutions, passed_solutions, total_problems,
       round(pass_rate, 9) AS pass_rate,
       round(centre - half, 9) AS wilson_low, round(centre + half, 9) AS wilson_high,
       round(half, 9) AS half_width, half <= 0.03 AS within_target
FROM (SELECT *, (p + z2 / (2 * n)) / (1 + z2 / n) AS centre,
             1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n) AS half
      FROM (SELECT model, CAST(count(*) AS BIGINT) AS total_solutions,
                   CAST(count_if(passed) AS BIGINT) AS passed_solutions,
                   count(DISTINCT task_id) AS total_problems,
                   count_if(passed) / count(*) AS pass_rate,
                   count_if(passed) / count(*) AS p, CAST(count(*) AS DOUBLE) AS n, 1.96 * 1.96 AS z2
            FROM attempts GROUP BY model))"""))
def q_wilson_interval(spark, d):
    w = S.wilson_interval(V.attempt_counts(spark, d).drop("category"), ["model"])
    for c in ("pass_rate", "wilson_low", "wilson_high", "half_width"):
        w = w.withColumn(c, r(c))
    return w


@register("submission_check", with_views(["attempts"], """
SELECT model, min_samples, problems, len(reasons) = 0 AS accepted, array_to_string(reasons, '; ') AS reasons
FROM (SELECT model, min(num_samples) AS min_samples, count(*) AS problems,
             list_filter([CASE WHEN min(num_samples) < 50
                               THEN printf('fewer than 50 samples for some problem (min %d)', min(num_samples)) END,
                          CASE WHEN count(*) < 164 THEN printf('%d of 164 problems attempted', count(*)) END],
                         lambda x: x IS NOT NULL) AS reasons
      FROM (SELECT model, task_id, count(*) AS num_samples FROM attempts GROUP BY model, task_id)
      GROUP BY model)"""))
def q_submission_check(spark, d):
    return S.submission_check(V.attempt_counts(spark, d), "model", expected_problems=V.N_TASKS_ATTEMPTS)


@register("card_reconcile", with_views(["attempts"], f"""
SELECT model, min_n, max_n, round(pass_at_1, 9) AS pass_at_1, round(pass_rate, 9) AS pass_rate,
       min_n = max_n AS uniform_n, NOT (min_n = max_n) OR abs(pass_at_1 - pass_rate) < 1e-9 AS reconciles
FROM (SELECT model, min(num_samples) AS min_n, max(num_samples) AS max_n,
             avg({sql_pass_at_k('num_samples', 'num_correct', '1')}) AS pass_at_1,
             sum(num_correct) / sum(num_samples) AS pass_rate
      FROM {_ATTEMPT_COUNTS} GROUP BY model)"""))
def q_card_reconcile(spark, d):
    out = S.card_reconcile(V.attempt_counts(spark, d), "model")
    return out.withColumn("pass_at_1", r("pass_at_1")).withColumn("pass_rate", r("pass_rate"))



@register("pass_at_k_bootstrap", with_views(["attempts"], f"""
SELECT model, round(any_value(pass_at_1), 9) AS pass_at_1, round(quantile_cont(mean, (1 - 0.95::DOUBLE) / 2), 9) AS low, round(quantile_cont(mean, (1 + 0.95::DOUBLE) / 2), 9) AS high
FROM (SELECT model, r, avg(e) AS pass_at_1, sum(w * e) / nullif(sum(w), 0) AS mean
      FROM (SELECT model, r, e, (u >= 0.36787944117144233)::INT + len(list_filter(range(1, 13),
              lambda k: u >= list_sum(list_transform(range(0, k + 1), lambda j: exp(-1) / gamma(j + 1.0))))) AS w
            FROM (SELECT model, r, e, ('0x' || substr(md5(task_id || '/' || r), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
                  FROM (SELECT model, task_id, {sql_pass_at_k('num_samples', 'num_correct', '1')} AS e FROM {_ATTEMPT_COUNTS}), range(200) t(r)))
      GROUP BY model, r)
GROUP BY model"""))
def q_pass_at_k_bootstrap(spark, d):
    """pass@1 per model with a Poisson bootstrap interval over its problems."""
    out = S.pass_at_k_interval(V.attempt_counts(spark, d), ["model"])
    return out.select("model", r("pass_at_k").alias("pass_at_1"), r("low").alias("low"), r("high").alias("high"))


_CARD_LINES = [("Provider", "'org'"), ("Version", "'v1.0'"), ("Parameters", "'7B'"), ("License", "'MIT'"), ("Dataset", "'q-humaneval'"),
               ("Samples", "'50 per problem'"), ("Date", "'2025-01-31'"), ("Hardware", "'8 GPUs'"), ("Pass@1", "'7.01%'"), ("Pass@5", "'15%'"), ("Pass@10", "'19.9%'")]


@register("submission_rules", with_views(["attempts"], """
SELECT model AS submission, len(reasons) = 0 AS accepted, array_to_string(reasons, '; ') AS reasons
FROM (SELECT model, list_filter([
  CASE WHEN k = 1 THEN 'missing Provider' END, CASE WHEN k = 2 THEN 'missing License' END, CASE WHEN k = 2 THEN 'missing Samples' END, CASE WHEN k = 3 THEN 'missing Hardware' END,
  CASE WHEN k = 3 THEN 'no date' END, CASE WHEN k = 4 THEN 'Pass@5 is no percentage' END,
  CASE WHEN k <> 2 AND CASE WHEN k = 5 THEN 5000 ELSE 50 END > n THEN 'samples stated differently' END,
  CASE WHEN n < 50 THEN 'fewer than 50 samples for some problem' END,
  CASE WHEN k = 6 THEN 'results are not valid JSON' END, CASE WHEN k = 7 THEN 'not one model' END], lambda x: x IS NOT NULL) AS reasons
  FROM (SELECT model, min(c) AS n, min(nationkey) % 8 AS k FROM (SELECT model, task_id, count(*) AS c FROM attempts GROUP BY ALL)
        JOIN (SELECT n_name, n_nationkey AS nationkey FROM nation) ON n_name = model GROUP BY model))"""))
def q_submission_rules(spark, d):
    """A card and a result file per model, seven of eight with one thing wrong, against the rules of a submission."""
    from passkit.plans.source_queries import derived_dir
    base = derived_dir(spark, d, "submissions")
    li = V.attempts(spark, d).select("model", "task_id", F.xxhash64("l_orderkey", "l_linenumber").alias("sample_index"))
    k = V.table(spark, d, "nation").select(F.col("n_name").alias("model"), (F.col("n_nationkey") % 8).alias("k"))
    k = k.join(li.select("model").distinct(), "model")
    shown = {"Provider": F.col("k") != 1, "License": F.col("k") != 2, "Hardware": F.col("k") != 3, "Samples": F.col("k") != 2}
    put = {"Date": F.when(F.col("k") == 3, "31 Jan 2025"), "Pass@5": F.when(F.col("k") == 4, "15"), "Samples": F.when(F.col("k") == 5, "5000 per problem")}
    lines = [F.when(shown.get(f, F.lit(True)), F.concat(F.lit(f"- **{f}**: "), F.coalesce(put.get(f, F.lit(None).cast("string")), F.expr(v)))) for f, v in _CARD_LINES]
    cards = k.select("model", F.concat_ws("\n", F.concat(F.lit("# "), "model"), *lines).alias("value"))
    cards.repartition("model").write.partitionBy("model").text(f"{base}/cards")
    row = F.to_json(F.struct(F.when((F.col("k") == 7) & (F.col("sample_index") % 2 == 0), "other").otherwise(F.col("model")).alias("model_name"), "task_id", "sample_index"))
    rows = li.join(k, "model").select("model", row.alias("value"))
    bad = k.where(F.col("k") == 6).select("model", F.lit('{"open').alias("value"))
    rows.union(bad).repartition("model").write.partitionBy("model").text(f"{base}/results")
    name = F.regexp_extract("file", "model=([^/]*)/", 1)
    got = S.read_submitted(spark, f"{base}/results").withColumn("submission", name).groupBy("submission").agg(
        F.max("models").alias("models"), F.min("min_samples").alias("min_samples"), F.sum("bad_lines").alias("bad_lines"))
    out = S.submission_report(S.read_cards(spark, f"{base}/cards").withColumn("submission", name), got)
    return out.withColumn("submission", F.url_decode("submission"))
