"""Registered evaluation queries: lookup, join, guards, answer checks, outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from passkit.functions.equality import smart_equal
from passkit.functions.text import sql_strip
from passkit.operators import evaluate as E
from passkit.plans import views as V
from passkit.plans.oracle_views import VIEWS, with_views
from passkit.plans.registry import register
from passkit.sources.tables import table

# -- extra fixture views used by this module ----------------------------------------

VIEWS["solutions"] = """
  SELECT model_name, task_id, sample_index, completion FROM completions
  UNION ALL
  SELECT 'm1' AS model_name, CAST(user_id AS VARCHAR) AS task_id, CAST(event_id AS BIGINT) AS sample_index,
         CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN '  ' || chr(9) || ' ' ELSE props END AS completion
  FROM events"""
VIEWS["problems_g"] = """
  SELECT task_id, prompt, CASE WHEN item_id % 10 = 9 THEN '' ELSE entry_point END AS entry_point, tests
  FROM problems"""
from passkit.plans import oracle_views as _ov  # noqa: E402

_ov._DEPS.update({"solutions": ["completions"], "problems_g": ["problems"]})


def solutions(spark, d):
    """V4 completions plus one solution per event (model m1): orphans, blank and brace-only code."""
    v4 = V.completions(spark, d).select("model_name", "task_id", "sample_index", "completion")
    e = table(spark, d, "events")
    m1 = e.select(F.lit("m1").alias("model_name"), F.col("user_id").cast("string").alias("task_id"),
                  F.col("event_id").cast("bigint").alias("sample_index"),
                  F.when(F.col("event_type") == "error", F.lit(""))
                  .when(F.col("event_type") == "view", F.lit("  \t "))
                  .otherwise(F.col("props")).alias("completion"))
    return v4.unionByName(m1)


def problems_g(spark, d):
    p = V.problems(spark, d)
    return p.select("task_id", "prompt",
                    F.when(F.col("item_id") % 10 == 9, F.lit("")).otherwise(F.col("entry_point")).alias("entry_point"),
                    "tests")


@register("problem_lookup", """
SELECT task_id, pos, n_chars FROM (
  SELECT coalesce(task_id, 'task_' || CAST(pos AS VARCHAR)) AS task_id, pos, n_chars,
         row_number() OVER (PARTITION BY coalesce(task_id, 'task_' || CAST(pos AS VARCHAR)) ORDER BY pos DESC) AS rn
  FROM (SELECT CASE WHEN lang = 'de' THEN NULL ELSE lang || '/' || source END AS task_id,
               doc_id AS pos, n_chars FROM documents))
WHERE rn = 1""")
def q_problem_lookup(spark, d):
    """Documents as a problem file with duplicate and missing task ids (German rows have none)."""
    docs = table(spark, d, "documents")
    probs = docs.select(
        F.when(F.col("lang") == "de", F.lit(None).cast("string"))
        .otherwise(F.concat_ws("/", "lang", "source")).alias("task_id"),
        F.col("doc_id").alias("pos"), F.col("n_chars"))
    return E.problem_lookup(probs, "pos")


@register("attach_problem", with_views(["solutions", "problems_g"], """
SELECT s.model_name, s.task_id, s.sample_index, p.entry_point, p.task_id IS NOT NULL AS has_problem
FROM solutions s LEFT JOIN problems_g p ON s.task_id = p.task_id"""))
def q_attach_problem(spark, d):
    j = E.attach_problem(solutions(spark, d), problems_g(spark, d).select("task_id", "entry_point"))
    return j.select("model_name", "task_id", "sample_index", "entry_point", "has_problem")


@register("guard_chain", with_views(["solutions", "problems_g"], f"""
SELECT model_name, task_id, sample_index, error, error IS NULL AS runnable,
       CASE WHEN error IS NULL THEN NULL ELSE false END AS passed
FROM (SELECT s.model_name, s.task_id, s.sample_index,
             CASE WHEN p.task_id IS NULL THEN 'No problem data found for ' || s.task_id
                  WHEN coalesce(p.entry_point, '') = '' THEN 'Missing entry_point for ' || s.task_id
                  WHEN {sql_strip("coalesce(s.completion, '')")} = '' THEN 'Empty code' END AS error
      FROM solutions s LEFT JOIN problems_g p ON s.task_id = p.task_id)"""))
def q_guard_chain(spark, d):
    j = E.attach_problem(solutions(spark, d), problems_g(spark, d).select("task_id", "entry_point"))
    err = E.guard_error(F.col("task_id"), F.col("has_problem"), F.col("entry_point"), F.col("completion"))
    return j.select("model_name", "task_id", "sample_index", err.alias("error")).select(
        "model_name", "task_id", "sample_index", "error", F.col("error").isNull().alias("runnable"),
        F.when(F.col("error").isNotNull(), F.lit(False)).alias("passed"))


@register("guard_null_ids", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'No problem data found for None'
                      WHEN event_id % 3 = 1 THEN 'Missing entry_point for None' END AS error
FROM events""")
def q_guard_null_ids(spark, d):
    """Solutions without a task id fail their guard with a message instead of counting as runnable."""
    e = table(spark, d, "events")
    shape = F.col("event_id") % 3
    err = E.guard_error(F.lit(None).cast("string"), F.when(shape != 0, F.lit(True)), F.when(shape == 2, F.lit("f")), F.lit("{x}"))
    return e.select("event_id", err.alias("error"))


@register("orphan_solutions", with_views(["solutions", "problems"], """
SELECT model_name, task_id, sample_index FROM solutions s
WHERE NOT EXISTS (SELECT 1 FROM problems p WHERE p.task_id = s.task_id)"""))
def q_orphan_solutions(spark, d):
    return E.orphan_solutions(solutions(spark, d), V.problems(spark, d).select("task_id")).select(
        "model_name", "task_id", "sample_index")


@register("unattempted_problems", with_views(["problems", "completions"], """
SELECT task_id, entry_point FROM problems p
WHERE NOT EXISTS (SELECT 1 FROM completions c WHERE c.task_id = p.task_id)"""))
def q_unattempted_problems(spark, d):
    """Problems with no completion of any shape."""
    return E.unattempted_problems(V.problems(spark, d).select("task_id", "entry_point"), V.completions(spark, d))


@register("smart_equal", with_views(["answers"], """
SELECT vec_id, len(expected) = len(actual) AS same_length, expected = actual AS equal FROM answers"""))
def q_smart_equal(spark, d):
    a = V.answers(spark, d)
    return a.select("vec_id", (F.size("expected") == F.size("actual")).alias("same_length"),
                    smart_equal(a, "expected", "actual").alias("equal"))


_ANSWERS_SQL = """
  SELECT CAST(label AS VARCHAR) AS task_id, 0 AS sample_index, vec_id AS case_no, actual AS value
  FROM answers JOIN embeddings USING (vec_id)
  UNION ALL
  SELECT CAST(label AS VARCHAR), 1, vec_id, expected FROM answers JOIN embeddings USING (vec_id)
  UNION ALL
  SELECT CAST(label AS VARCHAR), 2, vec_id, expected FROM answers JOIN embeddings USING (vec_id)
  WHERE vec_id % 3 <> 0
  UNION ALL
  SELECT CAST(label AS VARCHAR), 1, vec_id, expected[1:1] FROM answers JOIN embeddings USING (vec_id)
  WHERE vec_id % 7 = 0"""


SHEETS_SQL = """
SELECT s.task_id, CAST(s.sample_index AS INTEGER) AS sample_index, CAST(coalesce(count_if(c.ok), 0) AS BIGINT) AS cases_passed,
       CAST(coalesce(sum(c.n), 0) AS BIGINT) AS cases_answered, CAST(max(s.cases_expected) AS BIGINT) AS cases_expected,
       coalesce(count_if(c.ok), 0) >= max(s.cases_expected) AS passed
FROM (SELECT task_id, count(*) AS cases_expected, unnest([0, 1, 2, 3]) AS sample_index FROM expected_rows GROUP BY task_id) s
LEFT JOIN (SELECT a.task_id, a.sample_index, a.case_no, count(*) AS n, bool_and(coalesce(a.value = e.expected, false)) AS ok
           FROM answer_rows a LEFT JOIN expected_rows e ON a.task_id = e.task_id AND a.case_no = e.case_no GROUP BY ALL) c
  ON c.task_id = s.task_id AND c.sample_index = s.sample_index
GROUP BY s.task_id, s.sample_index"""
SHEET_CTES = (
    f"answer_rows AS ({_ANSWERS_SQL})",
    """expected_rows AS (SELECT CAST(label AS VARCHAR) AS task_id, vec_id AS case_no, embedding AS expected
                         FROM embeddings)""")


@register("check_answers", with_views(["answers"], SHEETS_SQL, SHEET_CTES))
def q_check_answers(spark, d):
    """Sample 0 answers with the altered arrays, 1 with exact copies, 2 leaves every third case out, 3 has no answer;
    sample 1 also gives a wrong second answer to every seventh case."""
    a = V.answers(spark, d, with_label=True)
    samples = F.array(
        F.struct(F.lit(0).alias("sample_index"), F.col("actual").alias("value")),
        F.struct(F.lit(1).alias("sample_index"), F.col("expected").alias("value")),
        F.when(F.col("vec_id") % 7 == 0, F.struct(F.lit(1).alias("sample_index"), F.slice("expected", 1, 1).alias("value"))),
        F.when(F.col("vec_id") % 3 != 0, F.struct(F.lit(2).alias("sample_index"), F.col("expected").alias("value"))))
    # one scan: the three answer sets are a generator column, not a union of re-reads
    answers = (a.select(F.col("label").cast("string").alias("task_id"), F.col("vec_id").alias("case_no"),
                        F.explode(F.filter(samples, lambda x: x.isNotNull())).alias("s"))
               .select("task_id", "s.sample_index", "case_no", "s.value"))
    expected = table(spark, d, "embeddings").select(
        F.col("label").cast("string").alias("task_id"), F.col("vec_id").alias("case_no"), F.col("embedding").alias("value"))
    samples = expected.select("task_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("sample_index"))
    return E.check_answers(answers, expected, samples=samples)


_RUNS_SQL = """
  SELECT event_id,
         CASE event_type WHEN 'purchase' THEN 'passed' WHEN 'signup' THEN 'assert' WHEN 'click' THEN 'test'
              WHEN 'view' THEN 'ipc' ELSE CASE WHEN event_id % 2 = 0 THEN 'nocheck' ELSE 'ipc' END END AS stage,
         CASE user_id % 5 WHEN 0 THEN 'Connection timeout after 5s' WHEN 1 THEN 'runtime error: rank'
              WHEN 2 THEN 'cannot import name ' || props WHEN 3 THEN 'q executable not found'
              ELSE 'type error ' || props END AS message
  FROM events"""


def _runs(spark, d):
    e = table(spark, d, "events")
    et, uid = F.col("event_type"), F.col("user_id") % 5
    stage = (F.when(et == "purchase", "passed").when(et == "signup", "assert").when(et == "click", "test")
             .when(et == "view", "ipc").when(F.col("event_id") % 2 == 0, "nocheck").otherwise("ipc"))
    msg = (F.when(uid == 0, F.lit("Connection timeout after 5s")).when(uid == 1, F.lit("runtime error: rank"))
           .when(uid == 2, F.concat(F.lit("cannot import name "), F.col("props")))
           .when(uid == 3, F.lit("q executable not found"))
           .otherwise(F.concat(F.lit("type error "), F.col("props"))))
    return e.select("event_id", stage.alias("stage"), msg.alias("message"))


def _sql_classify(stage: str, msg: str) -> str:
    low = f"lower(coalesce({msg}, ''))"
    t = f"({low} LIKE '%timeout%' OR {low} LIKE '%time%')"
    return f"""CASE WHEN {stage} = 'passed' THEN 'passed'
            WHEN {stage} = 'assert' THEN 'failed: Test assertion failed: ' || {msg}
            WHEN {stage} = 'nocheck' THEN 'failed: No ''check'' function found in tests'
            WHEN {stage} = 'test' AND {t} THEN 'timed out'
            WHEN {stage} = 'test' THEN 'failed: Test execution failed: ' || {msg}
            WHEN coalesce({msg}, '') LIKE '%q executable not found%'
              THEN 'failed: {E.EXECUTABLE_MISSING}'
            WHEN {low} LIKE '%port%' THEN 'failed: IPC port error: ' || {msg}
            WHEN {t} THEN 'timed out'
            ELSE 'failed: IPC execution error: ' || {msg} END"""


@register("classify_outcome", f"""
SELECT event_id, stage, {_sql_classify('stage', 'message')} AS label FROM ({_RUNS_SQL})""")
def q_classify_outcome(spark, d):
    runs = _runs(spark, d)
    return runs.select("event_id", "stage", E.classify_outcome(F.col("stage"), F.col("message")).alias("label"))


@register("failure_breakdown", f"""
SELECT kind, CAST(count(*) AS BIGINT) AS rows, round(count(*) / sum(count(*)) OVER (), 9) AS share
FROM (SELECT CASE WHEN label IN ('passed', 'timed out') THEN label
                  WHEN starts_with(label, 'failed: ') THEN 'failed: ' || split_part(label[9:], ':', 1)
                  ELSE label END AS kind
      FROM (SELECT {_sql_classify('stage', 'message')} AS label FROM ({_RUNS_SQL})))
GROUP BY kind""")
def q_failure_breakdown(spark, d):
    runs = _runs(spark, d)
    labelled = runs.select(E.classify_outcome(F.col("stage"), F.col("message")).alias("label"))
    out = E.failure_breakdown(labelled)
    return out.withColumn("share", F.round("share", 9))


@register("attach_problem_heavy", """
SELECT e.event_id AS sample_index, e.event_type AS task_id, p.entry_point, p.task_id IS NOT NULL AS has_problem
FROM events e LEFT JOIN (SELECT event_type AS task_id, 'f_' || event_type AS entry_point FROM events
                         WHERE event_type <> 'error' GROUP BY event_type) p ON p.task_id = e.event_type""")
def q_attach_problem_heavy(spark, d):
    """A few tasks hold all solutions (a task per event type): the heavy ones are found by a sketch and salted."""
    e = table(spark, d, "events")
    sol = e.select(F.col("event_type").alias("task_id"), F.col("event_id").alias("sample_index"))
    prob = e.where(F.col("event_type") != "error").groupBy(F.col("event_type").alias("task_id")).agg(
        F.concat(F.lit("f_"), F.first("event_type")).alias("entry_point"))
    return E.attach_problem(sol, prob, heavy_share=0.05).select("sample_index", "task_id", "entry_point", "has_problem")
