"""Fixture views over the test-bed tables, as Spark DataFrames.

Each view re-reads the parquet sources, so Catalyst prunes the columns a
query does not use and pushes filters into the scans. ``oracle_views``
holds the same definitions as SQL for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passkit.operators.ordering import row_index
from passkit.operators.perf import run_rank
from passkit.sources.tables import table

# Fixed values of the fixtures: number of problems tasks are folded into,
# the completion fold width, and the model names of the request plan.
N_TASKS_ATTEMPTS = 164
N_TASKS_COMPLETIONS = 40
MODEL_NAMES = [
    "gpt-4o", "gpt-4o-mini", "gpt-5", "gpt-5-mini", "o1-preview", "o1-mini", "o3", "o3-mini",
    "claude-3-5-sonnet", "claude-sonnet-4", "grok-3", "grok-4", "gemini-2.5-pro", "gemini-2.0-flash",
    "gpt-oss-20b", "deepseek-r1", "deepseek-r1-distill-qwen-32b", "qwen3-coder-30b-a3b",
    "llama-3.3-70b", "gemma-3-4b", "gemma-3-12b", "mistral-large", "phi-4-reasoning",
    "qwen3-thinking", "cot-llama-8b", "chain-of-thought-7b", "gpt-o1-custom", "my-model",
    "proto3-coder", "Claude-Opus",
]


def _s(c) -> F.Column:
    return c.cast("string")


def problems(spark: SparkSession, d: str) -> DataFrame:
    """V1: one problem per benchmark item."""
    b = table(spark, d, "benchmark")
    iid = _s(F.col("item_id"))
    return b.select(
        iid.alias("task_id"),
        F.col("text").alias("prompt"),
        F.concat(F.lit("f"), iid).alias("entry_point"),
        F.concat(F.lit("def check(candidate):\n    assert candidate("), iid, F.lit(") == "),
                 _s(F.col("item_id") * 2), F.lit("\n    assert candidate(0) == 0")).alias("tests"),
        F.array(F.concat(F.lit("f"), iid, F.lit("["), iid, F.lit("] ~ "), _s(F.col("item_id") * 2))).alias("q_tests"),
        F.lit("").alias("test_setup_code"),
        F.lit("").alias("canonical_solution"),
        F.col("item_id"),
    )


def results(spark: SparkSession, d: str, zeros: bool = False, sample_index: bool = True) -> DataFrame:
    """V2 (V2z with ``zeros``): one result per event, sample_index by event_id within user.

    The sample index needs a join Catalyst cannot prune; pass
    ``sample_index=False`` when a query does not read it.
    """
    e = table(spark, d, "events")
    passed = F.col("event_type") == "purchase"
    if zeros:
        passed = passed & (F.col("value") > 100)
    out = e.select(
        F.lit("m0").alias("model_name"),
        _s(F.col("user_id")).alias("task_id"),
        F.col("user_id"), F.col("event_id"),
        passed.alias("passed"),
        F.when(F.col("event_type") == "error", F.lit("error")).alias("error"),
        F.col("ts").alias("generated_at"),
        F.col("value"),
    )
    if not sample_index:
        return out.drop("user_id")
    return row_index(out, ["user_id"], ["event_id"], "sample_index").drop("user_id")


def results_counts(spark: SparkSession, d: str, zeros: bool = False) -> DataFrame:
    """Per-problem counts of V2 without building sample indexes (pruned early)."""
    e = table(spark, d, "events")
    passed = F.col("event_type") == "purchase"
    if zeros:
        passed = passed & (F.col("value") > 100)
    return (e.groupBy(_s(F.col("user_id")).alias("task_id"))
            .agg(F.count(F.lit(1)).alias("num_samples"), F.count_if(passed).alias("num_correct"))
            .withColumn("model_name", F.lit("m0")))


def _nations(spark: SparkSession, d: str) -> DataFrame:
    # nation (25 rows) and region (5 rows) are fixed-size dimensions at any
    # scale factor: broadcasting them is size-safe.
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    return F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).drop("r_regionkey"))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """V3 row level: model = supplier nation, task = part key folded into 164 problems."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    sup = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    nat = _nations(spark, d)
    j = li.join(sup, li.l_suppkey == sup.s_suppkey).join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.select(
        F.col("n_name").alias("model"), F.col("r_name").alias("category"),
        _s(F.col("l_partkey") % N_TASKS_ATTEMPTS).alias("task_id"),
        (F.col("l_returnflag") == "R").alias("passed"),
        "l_orderkey", "l_linenumber")


def attempt_counts(spark: SparkSession, d: str) -> DataFrame:
    """V3 per (model, task) counts with eager aggregation.

    lineitem is first reduced to (supplier, task) counts, which combine
    map-side; only that much smaller table meets the supplier join (left
    to the planner: broadcast when its size check passes, sort-merge
    otherwise) and the fixed-size nation dimension.
    """
    li = table(spark, d, "lineitem")
    pre = (li.groupBy(F.col("l_suppkey"), (F.col("l_partkey") % N_TASKS_ATTEMPTS).alias("task"))
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("c")))
    sup = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    nat = _nations(spark, d)
    j = pre.join(sup, pre.l_suppkey == sup.s_suppkey).join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
    return (j.groupBy(F.col("n_name").alias("model"), F.col("r_name").alias("category"),
                      _s(F.col("task")).alias("task_id"))
            .agg(F.sum("n").alias("num_samples"), F.sum("c").alias("num_correct")))


def completions(spark: SparkSession, d: str, with_text: bool = False) -> DataFrame:
    """V4: assistant turns wrapped into four completion shapes by turn % 4 (``with_text``: beside the turn's own text)."""
    c = table(spark, d, "conversations").where(F.col("role") == "assistant")
    task = _s(F.col("conv_id") % N_TASKS_COMPLETIONS)
    name = F.concat(F.lit("f"), task)
    shape = F.col("turn") % 4
    text = F.col("text")
    completion = (
        F.when(shape == 0, F.concat(F.lit("Here is the solution:\n```q\n"), name, F.lit(":{[x]\n"), text,
                                    F.lit("\n  x+1}\n```\nIt adds one.")))
        .when(shape == 1, F.concat(text, F.lit("\n"), name, F.lit(":{[x]\n  y:x*2;\n\n  y+"),
                                   _s(F.col("turn")), F.lit("\n  }\nDone.")))
        .when(shape == 2, F.concat(text, F.lit("\nCall "), name, F.lit("{x*"), _s(F.col("turn")),
                                   F.lit("} on the input.")))
        .otherwise(text))
    return c.select(
        task.alias("task_id"),
        ((F.col("conv_id") / N_TASKS_COMPLETIONS).cast("bigint") * 1000 + F.col("turn")).cast("bigint").alias("sample_index"),
        F.lit("m0").alias("model_name"),
        completion.alias("completion"),
        F.col("conv_id"), F.col("turn"), *([text] if with_text else []))


def measurements(spark: SparkSession, d: str) -> DataFrame:
    """V5: latency runs. model = event type, run = dense rank of the day within the model.

    The dense rank is taken over the distinct (model, day) pairs, a table of
    models x days, and joined back, so no task holds all rows of one model.
    """
    e = table(spark, d, "events").select(
        F.col("event_type").alias("model"), F.col("event_id"), F.col("user_id").alias("prompt_id"),
        F.to_date(F.col("ts")).alias("day"), F.col("value").alias("latency"))
    return run_rank(e, ["model"], "day").drop("day")


def trials(spark: SparkSession, d: str) -> DataFrame:
    """V6: profiling trials, one per part."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_brand").alias("model"), F.col("p_partkey").alias("trial_no"),
        F.col("p_size").alias("batch_size"),
        (F.lit(1) + F.col("p_partkey") % 4).cast("int").alias("tensor_parallel_size"),
        (F.lit(256) * (F.lit(1) + F.col("p_partkey") % 3)).cast("int").alias("max_tokens"),
        F.col("p_retailprice").alias("tokens_per_second"),
        (F.col("p_size") / 10.0).alias("memory_used_gb"),
        (F.col("p_size") * 37).cast("bigint").alias("tokens_generated"),
        (F.col("p_retailprice") / 1000.0).alias("total_time_seconds"),
        ((F.col("p_partkey") % 7) / 10.0).alias("start_memory_gb"),
        F.when(F.col("p_partkey") % 11 == 0, F.lit("oom")).alias("error"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """V7: documents with their labels (left join on doc_id)."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    lab = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return docs.join(lab, "doc_id", "left")


def answers(spark: SparkSession, d: str, with_label: bool = False) -> DataFrame:
    """V8: expected = embedding; actual changed (first element) or cut (last element) by id."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    emb = F.col("embedding")
    changed = F.when(F.col("vec_id") % 7 == 0,
                     F.concat(F.array(F.element_at(emb, 1) + F.lit(1.0).cast("float")),
                              F.slice(emb, 2, F.size(emb) - 1))).otherwise(emb)
    actual = F.when(F.col("vec_id") % 11 == 0, F.slice(changed, 1, F.size(changed) - 1)).otherwise(changed)
    cols = [F.col("vec_id"), emb.alias("expected"), actual.alias("actual")]
    return e.select(*cols, *([F.col("label")] if with_label else []))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """V9: every problem requested from each of the model names.

    The model list is a generator column on the problems (no join).
    """
    p = problems(spark, d).select("task_id", "prompt", "entry_point")
    return p.withColumn("model_name", F.explode(F.array(*[F.lit(m) for m in MODEL_NAMES])))
