"""Request planning and completion collection.

Generators (``explode``/``posexplode`` of ``sequence``) fan rows out inside
one projection, so planning n samples per problem is a map-only stage;
per-request facts (seed, family settings, token limit) are expressions on
that stage. Only batch numbering needs an order, and it uses the
prefix count over ranges of rows, not a single global window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passkit.functions.text import py_strip
from passkit.operators.ordering import ranged_index

SEED_MULTIPLIER = 2654435761  # odd, so sample -> seed is a bijection mod 2^31
SEED_MODULUS = 1 << 31
# Sequences per generation call once n exceeds the single-call limit.
MAX_SEQUENCES_PER_CALL = 8
SINGLE_CALL_LIMIT = 10


def expand_samples(problems: DataFrame, n: int | Column, name: str = "sample_index") -> DataFrame:
    """One request per (problem, sample 0..n-1)."""
    nn = n if isinstance(n, Column) else F.lit(int(n))
    return problems.withColumn(name, F.explode(F.sequence(F.lit(0), nn - 1)))


def seed_base(*keys: Column) -> Column:
    """Repeatable 32-bit value per key (md5 prefix: the same in every engine)."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *keys)), 1, 8), 16, 10).cast("bigint")


def unique_seed(base: Column, sample_index: Column) -> Column:
    """Seed in [0, 2^31), distinct across the samples of one prompt."""
    return F.pmod(base + sample_index.cast("bigint") * F.lit(SEED_MULTIPLIER), F.lit(SEED_MODULUS))


def assign_batches(df: DataFrame, order_cols: Sequence[str], size: int, keys: Sequence[str] = ()) -> DataFrame:
    """Consecutive batches of ``size`` rows in ``order_cols`` order (last one short)."""
    t = ranged_index(df, keys, order_cols, "_pos")
    return (t.withColumn("batch_no", F.floor(F.col("_pos") / size).cast("bigint"))
            .withColumn("position_in_batch", (F.col("_pos") % size).cast("int")).drop("_pos"))


def call_sizes(n: Column) -> Column:
    """n <= 10: one call of n; else calls of at most 8 (e.g. 50 -> six 8s and a 2)."""
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(n / MAX_SEQUENCES_PER_CALL).cast("int") - 1),
                         lambda i: F.least(F.lit(MAX_SEQUENCES_PER_CALL), n - i * MAX_SEQUENCES_PER_CALL))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= SINGLE_CALL_LIMIT, F.array(n.cast("int"))) \
        .otherwise(chunks.cast("array<int>"))


def split_calls(df: DataFrame, n: str) -> DataFrame:
    return df.select("*", F.posexplode(call_sizes(F.col(n))).alias("call_no", "call_size"))


def user_message(prompt: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def conversation_messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                          role: str = "role", text: str = "text") -> DataFrame:
    """Many-turn message list per conversation, in turn order.

    One list per conversation: the group is bounded by a conversation's
    length, and ``collect_list`` is combined map-side before the sort.
    """
    agg = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(
        F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content")))).alias("_m"))
    return agg.withColumn("messages", F.transform("_m", lambda m: F.struct(m["role"].alias("role"),
                                                                         m["content"].alias("content")))).drop("_m")


def normalize_completions(texts: Column, n: int | Column) -> Column:
    """Strip each, NULL -> '', pad with '' to n, cut to n."""
    nn = n if isinstance(n, Column) else F.lit(int(n))
    cleaned = F.transform(F.coalesce(texts, F.array().cast("array<string>")),
                          lambda x: F.coalesce(py_strip(x), F.lit("")))
    return F.slice(F.concat(cleaned, F.array_repeat(F.lit(""), nn)), 1, nn)


def flatten_completions(df: DataFrame, lists: str, model_name: str | Column,
                        generated_at: Column | None = None) -> DataFrame:
    """(task, [completion]) -> one row per completion with its sample_index."""
    m = model_name if isinstance(model_name, Column) else F.lit(model_name)
    out = (df.select("*", F.posexplode(lists).alias("sample_index", "completion")).drop(lists)
           .withColumn("sample_index", F.col("sample_index").cast("int"))
           .withColumn("model_name", m))
    return out.withColumn("generated_at", generated_at if generated_at is not None
                          else F.localtimestamp())


def pad_failures(requests: DataFrame, responses: DataFrame,
                 keys: Sequence[str] = ("task_id", "sample_index")) -> DataFrame:
    """Every request gets a completion; failed or missing ones get ''."""
    r = responses.select(*keys, F.col("completion").alias("_c"))
    return (requests.join(r, on=list(keys), how="left")
            .withColumn("completion", F.coalesce(F.col("_c"), F.lit("")))
            .withColumn("failed", F.col("_c").isNull()).drop("_c"))
