"""Registered prompt, request-planning and completion-collection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from passkit.functions import models as M
from passkit.functions import prompts as P
from passkit.functions.text import sql_strip
from passkit.operators import requests as Q
from passkit.operators.ordering import row_index
from passkit.plans import views as V
from passkit.plans.oracle_views import with_views
from passkit.plans.registry import register
from passkit.sources.tables import table


def _lit(s: str) -> str:
    """A Python string as a DuckDB expression (newlines via chr(10))."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def _sql_family(m: str) -> str:
    low = f"lower({m})"
    whens = " ".join(
        f"WHEN {' OR '.join(f'contains({low}, {_lit(n)})' for n in needles)} THEN '{fam}'"
        for fam, needles in M.FAMILY_RULES)
    return f"CASE {whens} ELSE 'unknown' END"


def _sql_thinking(m: str) -> str:
    return "(" + " OR ".join(f"contains(lower({m}), '{p}')" for p in M.THINKING_PATTERNS) + ")"


# -- prompts ---------------------------------------------------------------------------

@register("prompt_humaneval", with_views(["problems"], f"""
SELECT task_id, {_lit(P.HUMANEVAL_PREAMBLE)} || prompt || {_lit(P.HUMANEVAL_CLOSE)} AS rendered FROM problems"""))
def q_prompt_humaneval(spark, d):
    p = V.problems(spark, d).select("task_id", "prompt", "entry_point")
    return P.render(p, "q_humaneval").select("task_id", "rendered")


@register("prompt_mbpp", with_views(["problems"], f"""
SELECT task_id, {_lit(P.MBPP_PREAMBLE)} || prompt || {_lit(P.MBPP_MIDDLE)} || coalesce(q_tests[1], '')
       || {_lit(P.MBPP_CLOSE)} AS rendered FROM problems"""))
def q_prompt_mbpp(spark, d):
    p = V.problems(spark, d).select("task_id", F.col("prompt").alias("text"), F.col("q_tests").alias("q_test_list"))
    return P.render(p, "q_mbpp").select("task_id", "rendered")


_GENERIC_SRC = """(SELECT doc_id, CASE WHEN quality = 1 THEN text || ' Answer as a q programmer.' ELSE text END AS prompt
   FROM texts)"""


@register("prompt_generic", with_views(["texts"], f"""
SELECT doc_id, CASE WHEN NOT contains(prompt, 'q (KDB+)') AND NOT contains(prompt, 'q programmer')
                    THEN {_lit(P.GENERIC_PREAMBLE)} || prompt || {_lit(P.GENERIC_CLOSE)} ELSE prompt END AS rendered
FROM {_GENERIC_SRC}"""))
def q_prompt_generic(spark, d):
    t = V.texts(spark, d)
    p = t.select("doc_id", F.when(F.col("quality") == 1, F.concat(F.col("text"), F.lit(" Answer as a q programmer.")))
                 .otherwise(F.col("text")).alias("prompt"))
    return P.render(p, "generic").select("doc_id", "rendered")


@register("prompt_missing_fields", with_views(["texts"], """
SELECT doc_id, CASE WHEN quality IS NULL THEN 'entry_point' ELSE '' END AS missing,
       quality IS NOT NULL AS renderable
FROM texts"""))
def q_prompt_missing_fields(spark, d):
    """Documents as problems; only labelled ones carry an entry point."""
    t = V.texts(spark, d).select("doc_id", F.col("text").alias("prompt"),
                                 F.when(F.col("quality").isNotNull(), F.concat(F.lit("f"), F.col("doc_id").cast("string")))
                                 .alias("entry_point"))
    miss = P.missing_fields(t, P.template("q_humaneval")[0])
    return t.select("doc_id", F.array_join(miss, ", ").alias("missing"), (F.size(miss) == 0).alias("renderable"))


# -- request planning ---------------------------------------------------------------

@register("expand_samples", with_views(["problems"], """
SELECT task_id, CAST(s AS INTEGER) AS sample_index FROM problems, range(0, 50) t(s)"""))
def q_expand_samples(spark, d):
    p = V.problems(spark, d).select("task_id")
    return Q.expand_samples(p, 50)


@register("unique_seeds", with_views(["requests"], """
SELECT model_name, task_id, CAST(s AS INTEGER) AS sample_index,
       (CAST('0x' || substr(md5(model_name || '/' || task_id), 1, 8) AS BIGINT) + s * 2654435761) % 2147483648 AS seed
FROM requests, range(0, 5) t(s)"""))
def q_unique_seeds(spark, d):
    r = Q.expand_samples(V.requests(spark, d).select("model_name", "task_id"), 5)
    base = Q.seed_base(F.col("model_name"), F.col("task_id"))
    return r.select("model_name", "task_id", F.col("sample_index").cast("int"),
                    Q.unique_seed(base, F.col("sample_index")).alias("seed"))


@register("batch_plan", with_views(["problems"], """
SELECT task_id, CAST((row_number() OVER (ORDER BY item_id) - 1) // 8 AS BIGINT) AS batch_no,
       CAST((row_number() OVER (ORDER BY item_id) - 1) % 8 AS INTEGER) AS position_in_batch
FROM problems"""))
def q_batch_plan(spark, d):
    p = V.problems(spark, d).select("task_id", "item_id")
    return Q.assign_batches(p, ["item_id"], 8).select("task_id", "batch_no", "position_in_batch")


@register("split_calls", with_views(["results"], """
SELECT task_id, n, CAST(i AS INTEGER) AS call_no, CAST(least(8, n - 8 * i) AS INTEGER) AS call_size
FROM (SELECT task_id, count(*) AS n FROM results GROUP BY task_id), range(0, CAST(ceil(n / 8) AS BIGINT)) t(i)
WHERE n > 10
UNION ALL
SELECT task_id, n, 0, CAST(n AS INTEGER) FROM (SELECT task_id, count(*) AS n FROM results GROUP BY task_id)
WHERE n BETWEEN 1 AND 10"""))
def q_split_calls(spark, d):
    pp = V.results_counts(spark, d).select("task_id", F.col("num_samples").alias("n"))
    return Q.split_calls(pp, "n").withColumn("call_no", F.col("call_no").cast("int"))


@register("request_messages", with_views(["problems"], f"""
SELECT task_id, CAST(to_json([{{'role': 'user', 'content': {_lit(P.HUMANEVAL_PREAMBLE)} || prompt || {_lit(P.HUMANEVAL_CLOSE)}}}])
       AS VARCHAR) AS messages
FROM problems"""))
def q_request_messages(spark, d):
    p = V.problems(spark, d).select("task_id", "prompt", "entry_point")
    r = P.render(p, "q_humaneval")
    return r.select("task_id", F.to_json(Q.user_message(F.col("rendered"))).alias("messages"))


@register("conversation_messages", """
SELECT conv_id, count(*) AS n_messages,
       CAST(to_json(list({'role': role, 'content': text} ORDER BY turn)) AS VARCHAR) AS messages
FROM conversations GROUP BY conv_id""")
def q_conversation_messages(spark, d):
    c = table(spark, d, "conversations")
    m = Q.conversation_messages(c)
    return m.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"),
                    F.to_json("messages").alias("messages"))


# -- model rules ------------------------------------------------------------------------

@register("model_family", with_views(["requests"], f"""
SELECT model_name, task_id, {_sql_family('model_name')} AS family FROM requests"""))
def q_model_family(spark, d):
    r = V.requests(spark, d)
    return r.select("model_name", "task_id", M.model_family(F.col("model_name")).alias("family"))


def _sql_settings_case(field_sql) -> str:
    return "CASE fam " + " ".join(f"WHEN '{f}' THEN {field_sql(v)}" for f, v in M.FAMILY_SETTINGS.items()) + " END"


@register("model_settings", with_views(["requests"], f"""
SELECT model_name, task_id, fam AS family,
       {_sql_settings_case(lambda v: str(v[0]))} AS max_concurrent,
       CAST({_sql_settings_case(lambda v: repr(v[1]))} AS DOUBLE) AS rate_limit_delay,
       {_sql_settings_case(lambda v: str(v[2]).lower())} AS requires_parallel_generation,
       {_sql_settings_case(lambda v: str(v[3]).lower())} AS requires_seed_diversification,
       {_sql_settings_case(lambda v: _lit(",".join(sorted(v[4]))))} AS updated_keys,
       {_sql_settings_case(lambda v: _lit(",".join(v[5])))} AS removed_keys
FROM (SELECT *, {_sql_family('model_name')} AS fam FROM requests)"""))
def q_model_settings(spark, d):
    r = V.requests(spark, d).withColumn("family", M.model_family(F.col("model_name")))
    s = r.withColumn("_s", M.family_settings(F.col("family")))
    return s.select("model_name", "task_id", "family",
                    F.col("_s.max_concurrent").alias("max_concurrent"),
                    F.col("_s.rate_limit_delay").alias("rate_limit_delay"),
                    F.col("_s.requires_parallel_generation").alias("requires_parallel_generation"),
                    F.col("_s.requires_seed_diversification").alias("requires_seed_diversification"),
                    F.array_join(F.array_sort(F.map_keys("_s.param_updates")), ",").alias("updated_keys"),
                    F.array_join(F.col("_s.param_removals"), ",").alias("removed_keys"))


def _sql_merged() -> str:
    j = M.jtext
    fam = "fam"
    items = [
        ("max_completion_tokens", f"CASE WHEN {fam} IN ('o_series', 'gpt5') THEN '{j(M.DEFAULT_MAX_THINKING_TOKENS)}' END"),
        ("max_tokens", f"CASE WHEN {fam} IN ('gpt5', 'gemini') THEN NULL WHEN {fam} IN ('claude', 'grok') "
                       f"THEN '{j(M.DEFAULT_MAX_THINKING_TOKENS)}' ELSE coalesce(req_max_tokens, '{j(M.DEFAULT_MAX_TOKENS)}') END"),
        ("reasoning_effort", f"CASE WHEN {fam} IN ('o_series', 'gemini') THEN '{j(M.DEFAULT_REASONING_EFFORT)}' END"),
        ("seed", f"'{j(M.DEFAULT_SEED)}'"),
        ("temperature", f"CASE WHEN {fam} IN ('o_series', 'gpt5') THEN NULL ELSE '0.2' END"),
        ("thinking", f"CASE WHEN {fam} = 'gemini' THEN '{j(M.FAMILY_SETTINGS['gemini'][4]['thinking'])}' END"),
        ("top_p", f"CASE WHEN {fam} = 'gpt5' THEN NULL ELSE '{j(M.DEFAULT_TOP_P)}' END"),
    ]
    lst = ", ".join(f"'{k}=' || ({v})" for k, v in items)
    return f"array_to_string(list_filter([{lst}], lambda x: x IS NOT NULL), ',')"


@register("merge_params", with_views(["requests"], f"""
SELECT model_name, task_id, {_sql_merged()} AS params
FROM (SELECT *, {_sql_family('model_name')} AS fam,
             CASE WHEN length(prompt) > 300 THEN '2048' END AS req_max_tokens FROM requests)"""))
def q_merge_params(spark, d):
    """Request params: temperature 0.2 always, max_tokens 2048 for long prompts."""
    r = V.requests(spark, d)
    req = F.when(F.length("prompt") > 300, F.create_map(F.lit("max_tokens"), F.lit("2048"), F.lit("temperature"), F.lit("0.2"))) \
        .otherwise(F.create_map(F.lit("temperature"), F.lit("0.2")))
    s = M.family_settings(M.model_family(F.col("model_name")))
    merged = M.merge_params(req, s["param_updates"], s["param_removals"])
    return r.select("model_name", "task_id", M.params_text(merged).alias("params"))


@register("token_limit", with_views(["requests"], f"""
SELECT model_name, task_id, {_sql_thinking('model_name')} AS is_reasoning,
       CASE WHEN length(prompt) > 300 THEN 2048 WHEN {_sql_thinking('model_name')} THEN {M.DEFAULT_MAX_THINKING_TOKENS}
            ELSE {M.DEFAULT_MAX_TOKENS} END AS max_tokens
FROM requests"""))
def q_token_limit(spark, d):
    r = V.requests(spark, d)
    override = F.when(F.length("prompt") > 300, F.lit(2048))
    return r.select("model_name", "task_id", M.is_thinking_model(F.col("model_name")).alias("is_reasoning"),
                    M.token_limit(F.col("model_name"), override).alias("max_tokens"))


# -- completions ------------------------------------------------------------------------

_ASSIST_LISTS = f"""(SELECT conv_id, list({sql_strip('text')} ORDER BY turn) AS texts
   FROM conversations WHERE role = 'assistant' GROUP BY conv_id)"""


def _assist_lists(spark, d):
    c = table(spark, d, "conversations").where(F.col("role") == "assistant")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_t"))
    return g.select("conv_id", F.transform("_t", lambda x: x["text"]).alias("texts"))


@register("normalize_completions", f"""
SELECT conv_id, (texts || list_resize([]::VARCHAR[], 3, ''))[1:3] AS completions
FROM {_ASSIST_LISTS}""")
def q_normalize_completions(spark, d):
    return _assist_lists(spark, d).select("conv_id", Q.normalize_completions(F.col("texts"), 3).alias("completions"))


@register("flatten_completions", f"""
SELECT conv_id, CAST(i - 1 AS INTEGER) AS sample_index, c AS completion, 'm0' AS model_name
FROM (SELECT conv_id, unnest(texts) AS c, generate_subscripts(texts, 1) AS i FROM {_ASSIST_LISTS})""")
def q_flatten_completions(spark, d):
    """Every answer of every conversation, whole lists."""
    n = _assist_lists(spark, d).select("conv_id", F.col("texts").alias("cs"))
    return Q.flatten_completions(n, "cs", "m0").drop("generated_at")


ANSWERED_CTES = (
    "numbered AS (SELECT task_id, row_number() OVER (ORDER BY item_id) - 1 AS item FROM problems)",
    "told AS (SELECT *, conv_id % (SELECT count(*) FROM problems) AS item FROM conversations WHERE role IN ('assistant', 'user'))")
ANSWERED_SQL = """
(SELECT r.task_id, r.s, x.completion
 FROM (SELECT p.task_id, p.item, unnest(range(greatest(coalesce(a.n, 0), 3)::BIGINT)) AS s
       FROM numbered p LEFT JOIN (SELECT item, greatest(count_if(role = 'user'), count_if(role = 'assistant')) AS n FROM told GROUP BY item) a USING (item)) r
 LEFT JOIN (SELECT item, text AS completion, row_number() OVER (PARTITION BY item ORDER BY conv_id, turn, text) - 1 AS s
            FROM told WHERE role = 'assistant') x ON r.item = x.item AND r.s = x.s)"""


def asked_and_answered(spark, d):
    """(requests, answers) with the keys ``_item`` and ``sample_index``.

    Every answer is the response to a request: a conversation is of problem conv_id modulo their number, and
    its answers follow those of earlier conversations of that problem. A problem has a request for each of its
    user turns or answers, whichever are more, and three at least. The two numbers
    that this needs of the tables are scalar subqueries of the plan.
    """
    p = V.problems(spark, d).select("task_id", "item_id")
    c = table(spark, d, "conversations").where(F.col("role").isin("assistant", "user"))
    n_items = p.select(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    turns = c.select(F.coalesce(F.max("turn"), F.lit(0)) + 1).scalar()
    c = c.withColumn("_item", F.pmod(F.col("conv_id"), n_items))
    asked = c.groupBy("_item").agg(F.greatest(F.count_if(F.col("role") == "user"), F.count_if(F.col("role") == "assistant")).alias("_n"))
    req = row_index(p, [], ["item_id"], "_item").join(asked, "_item", "left")
    req = Q.expand_samples(req, F.greatest(F.coalesce("_n", F.lit(0)), F.lit(3)).cast("int")).select("task_id", "_item", "sample_index")
    # place over conversations and turns as one number, so that a long conversation is cut into blocks
    answers = c.where(F.col("role") == "assistant").withColumn("_at", F.col("conv_id") * turns + F.col("turn"))
    told = row_index(answers, ["_item"], ["_at", "text"], "sample_index", width=1024).select(
        "_item", F.col("sample_index").cast("int").alias("sample_index"), F.col("text").alias("completion"))
    return req.withColumn("sample_index", F.col("sample_index").cast("int")), told


@register("pad_failures", with_views(["problems"], f"""
SELECT task_id, CAST(s AS INTEGER) AS sample_index, coalesce(completion, '') AS completion, completion IS NULL AS failed FROM {ANSWERED_SQL}""",
                                     ANSWERED_CTES))
def q_pad_failures(spark, d):
    """Every request of ``asked_and_answered`` with its answer; requests nobody answered get ''."""
    requests, told = asked_and_answered(spark, d)
    return Q.pad_failures(requests, told, ["_item", "sample_index"]).select("task_id", "sample_index", "completion", "failed")
