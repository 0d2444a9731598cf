"""The fixture views as DuckDB SQL (the oracle side of every query)."""

from __future__ import annotations

from passkit.plans.views import MODEL_NAMES, N_TASKS_ATTEMPTS, N_TASKS_COMPLETIONS

NL = "chr(10)"

VIEWS: dict[str, str] = {
    "problems": f"""
  SELECT CAST(item_id AS VARCHAR) AS task_id, text AS prompt,
         'f' || CAST(item_id AS VARCHAR) AS entry_point,
         'def check(candidate):' || {NL} || '    assert candidate(' || CAST(item_id AS VARCHAR) || ') == '
           || CAST(item_id * 2 AS VARCHAR) || {NL} || '    assert candidate(0) == 0' AS tests,
         ['f' || CAST(item_id AS VARCHAR) || '[' || CAST(item_id AS VARCHAR) || '] ~ '
           || CAST(item_id * 2 AS VARCHAR)] AS q_tests,
         '' AS test_setup_code, '' AS canonical_solution, item_id
  FROM benchmark""",
    "results": """
  SELECT 'm0' AS model_name, CAST(user_id AS VARCHAR) AS task_id, event_id,
         event_type = 'purchase' AS passed,
         CASE WHEN event_type = 'error' THEN 'error' END AS error,
         ts AS generated_at, value,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS sample_index
  FROM events""",
    "results_z": """
  SELECT 'm0' AS model_name, CAST(user_id AS VARCHAR) AS task_id, event_id,
         event_type = 'purchase' AND value > 100 AS passed, ts AS generated_at
  FROM events""",
    "attempts": f"""
  SELECT n.n_name AS model, r.r_name AS category,
         CAST(l.l_partkey % {N_TASKS_ATTEMPTS} AS VARCHAR) AS task_id,
         l.l_returnflag = 'R' AS passed, l.l_orderkey, l.l_linenumber
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
       JOIN nation n ON s.s_nationkey = n.n_nationkey
       JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "completions": f"""
  SELECT CAST(conv_id % {N_TASKS_COMPLETIONS} AS VARCHAR) AS task_id,
         CAST((conv_id // {N_TASKS_COMPLETIONS}) * 1000 + turn AS BIGINT) AS sample_index,
         'm0' AS model_name, conv_id, turn,
         CASE turn % 4
           WHEN 0 THEN 'Here is the solution:' || {NL} || '```q' || {NL} || 'f' || CAST(conv_id % {N_TASKS_COMPLETIONS} AS VARCHAR)
                       || ':{{[x]' || {NL} || text || {NL} || '  x+1}}' || {NL} || '```' || {NL} || 'It adds one.'
           WHEN 1 THEN text || {NL} || 'f' || CAST(conv_id % {N_TASKS_COMPLETIONS} AS VARCHAR) || ':{{[x]' || {NL}
                       || '  y:x*2;' || {NL} || {NL} || '  y+' || CAST(turn AS VARCHAR) || {NL} || '  }}' || {NL} || 'Done.'
           WHEN 2 THEN text || {NL} || 'Call f' || CAST(conv_id % {N_TASKS_COMPLETIONS} AS VARCHAR) || '{{x*'
                       || CAST(turn AS VARCHAR) || '}} on the input.'
           ELSE text END AS completion
  FROM conversations WHERE role = 'assistant'""",
    "measurements": """
  SELECT event_type AS model, event_id, user_id AS prompt_id, value AS latency,
         CAST(dense_rank() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)) AS INTEGER) AS run
  FROM events""",
    "trials": """
  SELECT p_brand AS model, p_partkey AS trial_no, p_size AS batch_size,
         CAST(1 + p_partkey % 4 AS INTEGER) AS tensor_parallel_size,
         CAST(256 * (1 + p_partkey % 3) AS INTEGER) AS max_tokens,
         p_retailprice AS tokens_per_second, p_size / 10.0 AS memory_used_gb,
         CAST(p_size * 37 AS BIGINT) AS tokens_generated, p_retailprice / 1000.0 AS total_time_seconds,
         (p_partkey % 7) / 10.0 AS start_memory_gb,
         CASE WHEN p_partkey % 11 = 0 THEN 'oom' END AS error
  FROM part""",
    "texts": """
  SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "answers": """
  SELECT vec_id, embedding AS expected,
         CASE WHEN vec_id % 11 = 0 THEN ch[1:len(ch) - 1] ELSE ch END AS actual
  FROM (SELECT vec_id, embedding,
               CASE WHEN vec_id % 7 = 0 THEN list_concat([embedding[1] + CAST(1.0 AS FLOAT)], embedding[2:])
                    ELSE embedding END AS ch
        FROM embeddings)""",
    "models": "\n  SELECT unnest([" + ", ".join(f"'{m}'" for m in MODEL_NAMES) + "]) AS model_name",
}
VIEWS["requests"] = """
  SELECT p.task_id, p.prompt, p.entry_point, m.model_name FROM problems p, models m"""

_DEPS = {"requests": ["problems", "models"]}


def with_views(names: list[str], body: str, ctes: tuple[str, ...] = ()) -> str:
    """``WITH <views>, <ctes> <body>``; dependencies are added before their users."""
    order: list[str] = []
    for n in names:
        for dep in _DEPS.get(n, []) + [n]:
            if dep not in order:
                order.append(dep)
    parts = [f"{n} AS ({VIEWS[n]}\n)" for n in order] + list(ctes)
    return "WITH " + ",\n".join(parts) + "\n" + body


def sql_pass_at_k(n: str, c: str, k: str) -> str:
    """The estimator in DuckDB: range() is half-open and empty when c = 0."""
    return (f"CASE WHEN {n} - {c} < {k} THEN 1.0 WHEN {c} = 0 THEN 0.0 "
            f"ELSE 1.0 - list_product(list_transform(range({n} - {c} + 1, {n} + 1), lambda i: 1.0 - {k} / i)) END")
