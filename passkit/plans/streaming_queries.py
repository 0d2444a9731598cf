"""Registered streaming queries: each writes V2 results as files, streams them, reads the sink back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from passkit.plans import views as V
from passkit.plans.oracle_views import with_views
from passkit.plans.registry import register
from passkit.sources import evalfiles as EF
from passkit.streaming import live as L

RESULTS_STREAM_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()), T.StructField("task_id", T.StringType()),
    T.StructField("sample_index", T.IntegerType()), T.StructField("passed", T.BooleanType()),
    T.StructField("generated_at", T.TimestampNTZType()),
])


def _write_result_files(spark, d, run_dir: str, copies: int = 1, rows_per_file: int = 20_000) -> str:
    """V2 results as files of ``rows_per_file`` rows at most, appended ``copies`` times."""
    src = V.results(spark, d).select(*RESULTS_STREAM_SCHEMA.fieldNames())
    path = f"{run_dir}/in"
    for _ in range(copies):
        src.write.mode("append").option("maxRecordsPerFile", rows_per_file).json(path)
    return path


@register("stream_tally", with_views(["results"], """
SELECT model_name, task_id, count(*) AS num_samples, CAST(count_if(passed) AS BIGINT) AS num_correct
FROM results GROUP BY model_name, task_id"""))
def q_stream_tally(spark, d):
    """The live tally after every file has arrived equals the batch per-problem counts; some keys are closed on the way."""
    run = L.new_run_dir(spark, "tally")
    src = _write_result_files(spark, d, run)
    q = L.live_tally(L.stream_files(spark, src, RESULTS_STREAM_SCHEMA, files_per_trigger=L.files_per_batch(spark, src, 2)),
                     f"{run}/out", f"{run}/checkpoint", idle="1 day")
    q.awaitTermination()
    return L.read_tally(spark, f"{run}/out", f"{run}/checkpoint")


@register("stream_dedup", with_views(["results"], """
SELECT DISTINCT model_name, task_id, sample_index FROM results"""))
def q_stream_dedup(spark, d):
    """Every result file appended twice; the stream keeps one row per (model, task, sample)."""
    run = L.new_run_dir(spark, "dedup")
    src = _write_result_files(spark, d, run, copies=2)
    # every file may span the whole event range: the delay is what the files need
    delay = L.spread(spark.read.schema(RESULTS_STREAM_SCHEMA).json(src))
    q = L.stream_dedup(L.stream_files(spark, src, RESULTS_STREAM_SCHEMA, files_per_trigger=L.files_per_batch(spark, src, 4)),
                       f"{run}/out", f"{run}/checkpoint", delay)
    q.awaitTermination()
    return spark.read.parquet(f"{run}/out").select("model_name", "task_id", "sample_index")


@register("stream_committed_sink", with_views(["results"], """
SELECT task_id, CAST(sample_index AS BIGINT) AS sample_index, passed FROM results"""))
def q_stream_committed_sink(spark, d):
    """Result files streamed into the sink with commits and read back from its committed batches."""
    run = L.new_run_dir(spark, "sink")
    src = _write_result_files(spark, d, run)
    EF.register(spark)
    q = (L.stream_files(spark, src, RESULTS_STREAM_SCHEMA, files_per_trigger=L.files_per_batch(spark, src, 2)).writeStream.format(EF.FORMAT)
         .option("path", f"{run}/out").option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return EF.load(spark, f"{run}/out", "results", committed=True).select("task_id", "sample_index", "passed")


@register("dedup_solutions", """
SELECT model_name, task_id, sample_index, completion, generated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY model_name, task_id, sample_index
                               ORDER BY generated_at DESC, completion DESC) AS rn
  FROM (SELECT 'm0' AS model_name, CAST(user_id AS VARCHAR) AS task_id, CAST(event_id AS BIGINT) AS sample_index,
               props AS completion, ts AS generated_at FROM events
        UNION ALL
        SELECT 'm0', CAST(user_id AS VARCHAR), CAST(event_id AS BIGINT), upper(props), ts + INTERVAL 1 DAY
        FROM events WHERE event_id % 3 = 0))
WHERE rn = 1""")
def q_dedup_solutions(spark, d):
    """Solutions re-appended with a later timestamp (every third event): the later copy wins."""
    from passkit.sources.tables import table
    e = table(spark, d, "events")
    base = e.select(F.lit("m0").alias("model_name"), F.col("user_id").cast("string").alias("task_id"),
                    F.col("event_id").cast("bigint").alias("sample_index"), F.col("props").alias("completion"),
                    F.col("ts").alias("generated_at"))
    again = e.where(F.col("event_id") % 3 == 0).select(
        F.lit("m0").alias("model_name"), F.col("user_id").cast("string").alias("task_id"),
        F.col("event_id").cast("bigint").alias("sample_index"), F.upper("props").alias("completion"),
        (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("generated_at"))
    return L.dedup_latest(base.unionByName(again), order=("generated_at", "completion"))
