"""Registered plug-in queries: generation, test rewriting, assertion inventory, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from passkit.functions.text import sql_strip
from passkit.operators import plugins as G
from passkit.operators import scoring as S
from passkit.plans import views as V
from passkit.plans.oracle_views import _DEPS, VIEWS, with_views
from passkit.plans.registry import register
from passkit.plans.request_queries import ANSWERED_CTES, ANSWERED_SQL, asked_and_answered
from passkit.session import materialize
from passkit.sources.tables import table

VIEWS["rich_tests"] = """
  SELECT CAST(item_id AS VARCHAR) AS task_id,
         'def check(candidate):' || chr(10) || '    assert candidate(' || CAST(item_id AS VARCHAR) || ') == '
         || CAST(item_id * 2 AS VARCHAR) || chr(10)
         || CASE item_id % 4 WHEN 0 THEN '    assert candidate(0) != 1'
                             WHEN 1 THEN '    assert not candidate(-1)'
                             WHEN 2 THEN '    assert candidate(' || CAST(item_id AS VARCHAR) || ')'
                             ELSE '    assert abs(candidate(1) - 2) < 1e-6' END
         || CASE WHEN item_id % 5 = 0 THEN chr(10) || '    assert candidate(' || CAST(item_id AS VARCHAR) || ') == '
                                            || CAST(item_id AS VARCHAR) || ' == x'
                 ELSE '' END AS tests
  FROM benchmark"""


def rich_tests(spark, d):
    """Test texts of every assertion shape, one per benchmark item."""
    b = table(spark, d, "benchmark")
    iid = F.col("item_id").cast("string")
    shape = F.col("item_id") % 4
    extra = (F.when(shape == 0, F.lit("    assert candidate(0) != 1"))
             .when(shape == 1, F.lit("    assert not candidate(-1)"))
             .when(shape == 2, F.concat(F.lit("    assert candidate("), iid, F.lit(")")))
             .otherwise(F.lit("    assert abs(candidate(1) - 2) < 1e-6")))
    chained = F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("\n    assert candidate("), iid, F.lit(") == "), iid,
                                                         F.lit(" == x"))).otherwise(F.lit(""))
    tests = F.concat(F.lit("def check(candidate):\n    assert candidate("), iid, F.lit(") == "),
                     (F.col("item_id") * 2).cast("string"), F.lit("\n"), extra, chained)
    return b.select(iid.alias("task_id"), tests.alias("tests"))


@register("generate_plugin", with_views(["problems"], f"""
SELECT task_id, CAST(s AS INTEGER) AS sample_index, 'replay' AS model_name, coalesce(completion, '') AS completion FROM {ANSWERED_SQL}""",
                                        ANSWERED_CTES))
def q_generate_plugin(spark, d):
    """Every recorded answer is replayed as the sample of its request (``pad_failures`` says which); requests without one get ''."""
    requests, told = asked_and_answered(spark, d)
    req = requests.join(told.withColumnRenamed("completion", "recorded"), ["_item", "sample_index"], "left").drop("_item")
    return G.generate(req.withColumn("model_name", F.lit("replay")), G.replay_generator)


@register("loosen_equality", with_views(["rich_tests"], """
SELECT task_id, 'def check(candidate):' || chr(10) || '    assert smart_equal(candidate(' || task_id || '), '
       || CAST(CAST(task_id AS BIGINT) * 2 AS VARCHAR) || ')' || chr(10)
       || CASE CAST(task_id AS BIGINT) % 4 WHEN 0 THEN '    assert candidate(0) != 1' WHEN 1 THEN '    assert not candidate(-1)'
            WHEN 2 THEN '    assert candidate(' || task_id || ')' ELSE '    assert abs(candidate(1) - 2) < 1e-06' END
       || CASE WHEN CAST(task_id AS BIGINT) % 5 = 0 THEN chr(10) || '    assert candidate(' || task_id || ') == ' || task_id || ' == x'
            ELSE '' END AS loosened
FROM rich_tests"""))
def q_loosen_equality(spark, d):
    t = rich_tests(spark, d)
    return t.select("task_id", G.loosen_equality(F.col("tests")).alias("loosened"))


_LINE_SQL = """(SELECT task_id, unnest(string_split(tests, chr(10))) AS line FROM rich_tests)"""


def _inventory_sql(function_sql: str) -> str:
    """Single-line assertion classes in SQL; ``function_sql`` names the called function."""
    return with_views(["rich_tests"], f"""
SELECT kind, function, count(*) AS asserts FROM (
  SELECT CASE WHEN regexp_matches(body, '^not\\b') THEN 'not'
              WHEN len(string_split(ops, '==')) - 1 = 1 AND NOT regexp_matches(ops, '!=|<=|>=|<|>|\\bin\\b|\\bis\\b') THEN 'eq'
              WHEN len(string_split(ops, '==')) - 1 > 0 OR regexp_matches(ops, '!=|<=|>=|<|>|\\bin\\b|\\bis\\b') THEN 'compare'
              ELSE 'bare' END AS kind,
         {function_sql} AS function
  FROM (SELECT line, body, regexp_replace(body, '''[^'']*''|"[^"]*"', '', 'g') AS ops
        FROM (SELECT line, regexp_replace(line, '^\\s*assert\\s+', '') AS body FROM {_LINE_SQL}
              WHERE regexp_matches(line, '^\\s*assert\\s'))))
GROUP BY kind, function""")


@register("assertion_inventory", _inventory_sql("regexp_extract(line, 'assert\\s+(\\w+)\\s*\\(', 1)"))
def q_assertion_inventory(spark, d):
    lines = rich_tests(spark, d).select("task_id", F.explode(F.split("tests", "\n")).alias("line"))
    a = lines.where(F.col("line").rlike(r"^\s*assert\s"))
    out = a.select(G.assertion_kind_regex(F.col("line")).alias("kind"),
                   F.regexp_extract("line", r"assert\s+(\w+)\s*\(", 1).alias("function"))
    return out.groupBy("kind", "function").agg(F.count(F.lit(1)).alias("asserts"))


@register("assertion_inventory_exact", _inventory_sql(
    "nullif(regexp_extract(line, 'assert\\s+(?:not\\s+)?(\\w+)\\s*\\(', 1), '')"))
def q_assertion_inventory_exact(spark, d):
    """The same inventory from the Python parser (multi-line asserts included; the
    function of ``assert not f(x)`` is ``f``). The oracle restates it for these
    single-line shapes."""
    t = rich_tests(spark, d).select(F.inline(G.assertion_inventory_exact(F.col("tests"))))
    return t.groupBy("kind", "function").agg(F.count(F.lit(1)).alias("asserts"))


VIEWS["all_runs"] = """
  SELECT model_name, task_id, sample_index, text LIKE '%' || chr(10) || '%' AS passed, NULL::VARCHAR AS info
  FROM completions JOIN (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant') USING (conv_id, turn)
  UNION ALL
  SELECT 'm1', CAST(user_id AS VARCHAR), CAST(event_id AS BIGINT), event_type = 'purchase',
         CASE WHEN event_type <> 'purchase' THEN 'failed: ' || event_type END
  FROM events"""
VIEWS["recorded_runs"] = VIEWS["all_runs"] + " WHERE value IS NOT NULL"
_DEPS["recorded_runs"] = _DEPS["all_runs"] = ["completions"]


def recorded_runs(spark, d, every: bool = False):
    """One recorded run of each solution, keyed like the solution itself: an answer's run passed if
    the answer has several lines (m0, without a message), an event's if it is a purchase (m1). Without
    ``every``, events without a value have no run."""
    told = V.completions(spark, d, with_text=True).select("model_name", "task_id", "sample_index", F.col("text").contains("\n").alias("passed"),
                                                         F.lit(None).cast("string").alias("info"))
    bought = F.col("event_type") == "purchase"
    e = table(spark, d, "events")
    e = (e if every else e.where(F.col("value").isNotNull())).select(
        F.lit("m1").alias("model_name"), F.col("user_id").cast("string").alias("task_id"), F.col("event_id").cast("bigint").alias("sample_index"),
        bought.alias("passed"), F.when(~bought, F.concat(F.lit("failed: "), F.col("event_type"))).alias("info"))
    return told.unionByName(e)


def checked_runs(spark, d):
    """The recorded runs of all solutions with their answers checked: a run that passed keeps that only if every answer of its sheet is right.

    The tables do not say which answers a run gave, so it is given one of the sheets of
    ``check_answers``: the label and the sheet that its sample number names. The sheets (four a label) are
    written once, so that they meet the runs as a table of known size.
    """
    from passkit.plans.evaluation_queries import q_check_answers
    sheets = materialize(q_check_answers(spark, d).select(F.col("task_id").alias("_label"), F.col("sample_index").alias("_sheet"),
                                                          F.col("passed").alias("_right")), "answer-sheets")
    runs = recorded_runs(spark, d, every=True).withColumns({"_label": (F.col("sample_index") % 10).cast("string"), "_sheet": (F.col("sample_index") % 4).cast("int")})
    right = F.when(F.col("passed").isNotNull(), F.col("passed") & F.coalesce("_right", F.lit(False)))
    return runs.join(sheets, ["_label", "_sheet"], "left").withColumn("passed", right).drop("_label", "_sheet", "_right")


def evaluated(spark, d, checked: bool = False):
    """Solutions -> problems -> guards -> extraction -> recorded runs (and their answers, if ``checked``): one result row per solution."""
    from passkit.operators.harness import execute_solutions
    from passkit.plans.evaluation_queries import problems_g, solutions
    runs = checked_runs(spark, d) if checked else recorded_runs(spark, d)
    return execute_solutions(solutions(spark, d), problems_g(spark, d), verdicts=runs)


_GUARD_SQL = f"""CASE WHEN p.task_id IS NULL THEN 'No problem data found for ' || s.task_id
            WHEN coalesce(p.entry_point, '') = '' THEN 'Missing entry_point for ' || s.task_id
            WHEN {sql_strip("coalesce(s.completion, '')")} = '' THEN 'Empty code' END"""


def _evaluated_sql(select: str, checked: bool = False) -> str:
    from passkit.plans.evaluation_queries import SHEET_CTES, SHEETS_SQL
    from passkit.plans.extraction_queries import extraction_ctes
    src = f"""src AS (SELECT s.model_name, s.task_id, s.sample_index, s.completion AS t, p.entry_point AS name
         FROM solutions s JOIN problems_g p ON s.task_id = p.task_id
         WHERE ({_GUARD_SQL}) IS NULL)"""
    code = f"""code AS (
  SELECT src.model_name, src.task_id, src.sample_index,
         {sql_strip(f"coalesce(fb.body, ft.body, {sql_strip('src.t')})")} AS code
  FROM src LEFT JOIN fb_fn fb USING (model_name, task_id, sample_index)
  LEFT JOIN ft_fn ft USING (model_name, task_id, sample_index))"""
    runs, right = ("all_runs", " AND ok") if checked else ("recorded_runs", "")
    given = " coalesce(w.passed, false) AS ok," if checked else ""
    sheet = """
        LEFT JOIN sheets w ON w.task_id = CAST(s.sample_index % 10 AS VARCHAR) AND w.sample_index = s.sample_index % 4""" if checked else ""
    results = f"""evaluated AS (
  SELECT task_id, sample_index, model_name, error IS NULL AND coalesce(ran, false){right} AS passed,
         CASE WHEN error IS NOT NULL THEN NULL WHEN ran{right} THEN 'passed' WHEN ran IS NULL THEN coalesce(told, 'failed: no recorded run')
              ELSE coalesce(told, 'failed: Test assertion failed: an answer differs') END AS info, error
  FROM (SELECT s.task_id, CAST(s.sample_index AS BIGINT) AS sample_index, s.model_name, v.passed AS ran, v.info AS told,{given}
               coalesce({_GUARD_SQL}, CASE WHEN c.code = '' THEN 'Empty code' END) AS error
        FROM solutions s LEFT JOIN problems_g p ON s.task_id = p.task_id
        LEFT JOIN code c ON s.model_name = c.model_name AND s.task_id = c.task_id AND s.sample_index = c.sample_index
        LEFT JOIN {runs} v ON v.model_name = s.model_name AND v.task_id = s.task_id AND v.sample_index = s.sample_index{sheet}))"""
    sheets = (*SHEET_CTES, f"sheets AS ({SHEETS_SQL})") if checked else ()
    return with_views(["completions", "solutions", "problems", "problems_g", runs] + (["answers"] if checked else []), select,
                      sheets + extraction_ctes(src) + (code, results))


@register("evaluate_plugin", _evaluated_sql("SELECT * FROM evaluated", checked=True))
def q_evaluate_plugin(spark, d):
    """Every solution gets exactly one result row: guarded, or extracted and run, with its answers checked."""
    return evaluated(spark, d, checked=True)


_K_SQL = "CASE WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1.0 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - k / i)) END"


@register("evaluate_pass_at_k", _evaluated_sql(f"""
SELECT model_name, k, round(avg({_K_SQL}), 9) AS pass_at_k
FROM (SELECT model_name, task_id, count(*) AS n, CAST(count_if(passed) AS BIGINT) AS c FROM evaluated GROUP BY ALL),
     (SELECT unnest([1, 5, 10, 20, 50, 100]) AS k)
GROUP BY model_name, k HAVING min(n) >= k"""))
def q_evaluate_pass_at_k(spark, d):
    """The whole evaluation ending in gated pass@k per model."""
    res = evaluated(spark, d)
    pp = S.per_problem(res, ["model_name", "task_id"])
    return S.gated_pass_at_k(pp, ["model_name"]).withColumn("pass_at_k", F.round("pass_at_k", 9))
