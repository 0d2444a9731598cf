"""Registered extraction queries over the V4 completions.

The oracle is a different formulation of the same rules: lines exploded
to rows, the capture start as a MIN, the brace depth as a running SUM
window, and the body re-assembled with STRING_AGG.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from passkit.functions import extraction as X
from passkit.functions.text import sql_strip
from passkit.plans import views as V
from passkit.plans.oracle_views import with_views
from passkit.plans.registry import register

KEY = "model_name, task_id, sample_index"


def _count(expr: str, ch: str) -> str:
    return f"(length({expr}) - length(replace({expr}, '{ch}', '')))"


def _last(expr: str, ch: str) -> str:
    return f"(CASE WHEN instr(reverse({expr}), '{ch}') = 0 THEN 0 ELSE length({expr}) - instr(reverse({expr}), '{ch}') + 1 END)"


def _fence(expr: str) -> str:
    return f"starts_with({expr}, '```')"


_SRC = f"""src AS (SELECT c.model_name, c.task_id, c.sample_index, c.completion AS t, p.entry_point AS name
         FROM completions c JOIN problems p ON c.task_id = p.task_id)"""
_LINES = f"""lines AS (
  SELECT *, {sql_strip('line')} AS st FROM (
    SELECT {KEY}, name, unnest(string_split(t, chr(10))) AS line,
           generate_subscripts(string_split(t, chr(10)), 1) AS i
    FROM src))"""
_BLOCK = f"""blk_open AS (SELECT {KEY}, min(i) AS o FROM lines WHERE st = '```q' GROUP BY ALL),
blk_close AS (SELECT l.model_name, l.task_id, l.sample_index, min(l.i) AS c
              FROM lines l JOIN blk_open b USING (model_name, task_id, sample_index)
              WHERE l.i > b.o AND l.st = '```' GROUP BY ALL),
blk_lines AS (SELECT l.* FROM lines l JOIN blk_open b USING (model_name, task_id, sample_index)
              LEFT JOIN blk_close c USING (model_name, task_id, sample_index)
              WHERE l.i > b.o AND l.i < coalesce(c.c, 2147483647) AND l.st <> '```q'),
blk AS (SELECT {KEY}, string_agg(line, chr(10) ORDER BY i) AS block FROM blk_lines GROUP BY ALL)"""


def _fx(scope: str, lines: str) -> str:
    """Function extraction over the line set ``lines``; CTEs prefixed by ``scope``."""
    part = "substr(st, instr(st, '{'))"
    return f"""{scope}_start AS (
  SELECT {KEY}, min(i) AS s FROM {lines}
  WHERE st <> '' AND NOT starts_with(st, '//') AND NOT {_fence('st')}
        AND contains(st, name || ':') AND contains(st, '{{') GROUP BY ALL),
{scope}_depth AS (
  SELECT l.*, x.s,
         sum(CASE WHEN l.i = x.s THEN {_count(part, '{')} - {_count(part, '}')}
                  WHEN l.st <> '' AND NOT {_fence('l.st')} THEN {_count('l.st', '{')} - {_count('l.st', '}')}
                  ELSE 0 END) OVER (PARTITION BY l.model_name, l.task_id, l.sample_index ORDER BY l.i) AS depth
  FROM {lines} l JOIN {scope}_start x USING (model_name, task_id, sample_index) WHERE l.i >= x.s),
{scope}_end AS (
  SELECT {KEY}, min(i) AS e FROM {scope}_depth
  WHERE depth = 0 AND (i = s OR (st <> '' AND NOT {_fence('st')})) GROUP BY ALL),
{scope}_braces AS (
  SELECT d.model_name, d.task_id, d.sample_index,
         max(CASE WHEN d.i = d.s THEN substr(d.st, instr(d.st, '{{')) END)
         || coalesce(string_agg(chr(10) || d.line, '' ORDER BY d.i)
                     FILTER (WHERE d.i > d.s AND d.i <= coalesce(e.e, 2147483647) AND d.st <> ''
                             AND NOT {_fence('d.st')}), '') AS body
  FROM {scope}_depth d LEFT JOIN {scope}_end e USING (model_name, task_id, sample_index) GROUP BY ALL),
{scope}_one AS (
  SELECT {KEY}, arg_min(substr(st, instr(st, '{{'), {_last('st', '}')} - instr(st, '{{') + 1), i) AS body
  FROM {lines}
  WHERE contains(st, '{{') AND contains(st, '}}') AND contains(st, name) AND {_last('st', '}')} > instr(st, '{{')
  GROUP BY ALL),
{scope}_fn AS (
  SELECT {KEY}, coalesce(b.body, o.body) AS body, CASE WHEN b.body IS NOT NULL THEN 'braces' ELSE 'oneliner' END AS how
  FROM {scope}_braces b FULL JOIN {scope}_one o USING (model_name, task_id, sample_index))"""


_BLK_SCOPE = """blk_scope AS (SELECT l.* FROM blk_lines l JOIN blk b USING (model_name, task_id, sample_index)
                          WHERE b.block <> '')"""

def extraction_ctes(src: str = _SRC) -> tuple[str, ...]:
    """The extraction CTEs over a ``src`` CTE of (model_name, task_id, sample_index, t, name).

    Defines ``fb_fn`` (function found in the first block) and ``ft_fn``
    (function in the whole text), keyed by (model_name, task_id, sample_index).
    """
    return (src, _LINES, _BLOCK, _BLK_SCOPE, _fx("fb", "blk_scope"), _fx("ft", "lines"))


_CTES = extraction_ctes()


def _src(spark, d):
    c = V.completions(spark, d).select("model_name", "task_id", "sample_index", "completion")
    p = V.problems(spark, d).select("task_id", "entry_point")
    return c.join(p, "task_id")


@register("extract_code_block", with_views(["completions", "problems"], f"""
SELECT s.model_name, s.task_id, s.sample_index, CASE WHEN b.block IS NOT NULL THEN b.block END AS code_block
FROM src s LEFT JOIN blk b USING (model_name, task_id, sample_index)""", _CTES))
def q_extract_code_block(spark, d):
    return X.with_code_block(_src(spark, d), "completion", "code_block").select(
        "model_name", "task_id", "sample_index", "code_block")


@register("extract_function", with_views(["completions", "problems"], f"""
SELECT s.model_name, s.task_id, s.sample_index, f.body AS function, f.how
FROM src s LEFT JOIN ft_fn f USING (model_name, task_id, sample_index)""", _CTES))
def q_extract_function(spark, d):
    return X.with_function(_src(spark, d), "completion", "entry_point", "function", "how").select(
        "model_name", "task_id", "sample_index", "function", "how")


@register("extract_oneliner", with_views(["completions", "problems"], f"""
SELECT s.model_name, s.task_id, s.sample_index, o.body AS oneliner
FROM src s JOIN ft_one o USING (model_name, task_id, sample_index)
LEFT JOIN ft_braces b USING (model_name, task_id, sample_index) WHERE b.body IS NULL""", _CTES))
def q_extract_oneliner(spark, d):
    """Completions whose function only the one-line fallback finds."""
    f = X.with_function(_src(spark, d), "completion", "entry_point", "function", "how")
    return f.where(F.col("how") == "oneliner").select(
        "model_name", "task_id", "sample_index", F.col("function").alias("oneliner"))


_EXTRACT_SQL = f"""
SELECT s.model_name, s.task_id, s.sample_index,
       coalesce(fb.body, ft.body, {sql_strip("coalesce(s.t, '')")}) AS code,
       CASE WHEN fb.body IS NOT NULL THEN 'block' WHEN ft.how = 'braces' THEN 'full'
            WHEN ft.how = 'oneliner' THEN 'oneliner' ELSE 'whole' END AS path
FROM src s LEFT JOIN fb_fn fb USING (model_name, task_id, sample_index)
LEFT JOIN ft_fn ft USING (model_name, task_id, sample_index)"""


@register("extract_code", with_views(["completions", "problems"], _EXTRACT_SQL, _CTES))
def q_extract_code(spark, d):
    return X.with_extracted(_src(spark, d), "completion", "entry_point").select(
        "model_name", "task_id", "sample_index", "code", "path")


@register("extraction_paths", with_views(["completions", "problems"], f"""
SELECT path, CAST(count(*) AS BIGINT) AS rows, round(count(*) / sum(count(*)) OVER (), 9) AS share
FROM ({_EXTRACT_SQL}) GROUP BY path""", _CTES))
def q_extraction_paths(spark, d):
    from pyspark.sql import Window
    e = X.with_extracted(_src(spark, d), "completion", "entry_point")
    g = e.groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
    return g.withColumn("share", F.round(F.col("rows") / F.sum("rows").over(Window.partitionBy()), 9))
