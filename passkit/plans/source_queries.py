"""Registered source/sink queries.

Each one first writes a dataset that Spark derives from the test-bed
tables into the shared folder (``spark.checkpoint.dir``), then reads it
back through the library's readers; the oracle computes the expected rows
straight from the tables, so a lossless round trip is what is checked.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from passkit.functions import prompts as PT
from passkit.operators import scoring as S
from passkit.plans import views as V
from passkit.plans.oracle_views import with_views
from passkit.plans.registry import register
from passkit.session import shared_dir
from passkit.sources import catalog as C
from passkit.sources import evalfiles as EF
from passkit.sources import jsonl as J
from passkit.sources import profiles as PR


def derived_dir(spark, sf_dir: str, name: str) -> str:
    """A fresh folder per call (concurrent calls never share or overwrite input)."""
    tag = re.sub(r"[^A-Za-z0-9_.-]", "_", sf_dir.strip("/"))
    return os.path.join(shared_dir(spark), "passkit_derived", tag, uuid.uuid4().hex[:12], name)


def _write_problems(spark, d):
    """V1 as a problems folder (parts in item order); every 7th item lacks its task_id."""
    p = V.problems(spark, d)
    p = p.withColumn("task_id", F.when(F.col("item_id") % 7 == 3, F.lit(None)).otherwise(F.col("task_id")))
    path = derived_dir(spark, d, "problems.jsonl")
    J.write_jsonl(p.orderBy("item_id")
                  .select("task_id", "prompt", "q_tests", "entry_point", "test_setup_code", "canonical_solution"),
                  path, mode="overwrite")
    return path


@register("read_problems", """
SELECT CASE WHEN item_id % 7 = 3 THEN 'task_' || CAST(row_number() OVER (ORDER BY item_id) - 1 AS VARCHAR)
            ELSE CAST(item_id AS VARCHAR) END AS task_id,
       CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS pos,
       text AS prompt, 'f' || CAST(item_id AS VARCHAR) AS entry_point
FROM benchmark""")
def q_read_problems(spark, d):
    df = J.read_problems(spark, _write_problems(spark, d))
    return df.select("task_id", F.col("pos"), "prompt", "entry_point")


@register("read_solutions", with_views(["completions"], """
SELECT task_id, sample_index, model_name, completion FROM completions"""))
def q_read_solutions(spark, d):
    return J.read_solutions(spark, _write_solutions(spark, d)).select(*_LEGACY_COLUMNS)


_LEGACY_COLUMNS = ["task_id", "sample_index", "model_name", "completion"]


def _write_solutions(spark, d):
    """V4 written as solutions; shape-3 rows use the legacy ``extracted_code`` field."""
    c = V.completions(spark, d)
    legacy = F.col("turn") % 4 == 3
    path = derived_dir(spark, d, "solutions.jsonl")
    J.write_jsonl(c.select("task_id", "sample_index", "model_name", F.when(~legacy, F.col("completion")).alias("completion"),
                           F.when(legacy, F.col("completion")).alias("extracted_code"),
                           F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("generated_at")), path, mode="overwrite")
    return path


@register("source_problems", """
SELECT CASE WHEN item_id % 7 = 3 THEN 'task_' || CAST(row_number() OVER (ORDER BY item_id) - 1 AS VARCHAR)
            ELSE CAST(item_id AS VARCHAR) END AS task_id,
       CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS pos,
       text AS prompt, 'f' || CAST(item_id AS VARCHAR) AS entry_point
FROM benchmark""")
def q_source_problems(spark, d):
    """The written problems through the byte-range data source, in ranges of 4 KB so that files are cut."""
    return EF.read_problems(spark, _write_problems(spark, d), rangeBytes=4096).select("task_id", "pos", "prompt", "entry_point")


@register("source_solutions", with_views(["completions"], """
SELECT task_id, sample_index, model_name, completion FROM completions"""))
def q_source_solutions(spark, d):
    """The written solutions through the byte-range data source, legacy field included."""
    return EF.read_solutions(spark, _write_solutions(spark, d), rangeBytes=1 << 16).select(*_LEGACY_COLUMNS)


@register("source_pushed_filter", with_views(["completions"], """
SELECT task_id, count(*) AS answers, min(sample_index) AS first_sample, max(sample_index) AS last_sample
FROM completions WHERE sample_index >= 1000 AND task_id IN ('3', '17') GROUP BY task_id"""))
def q_source_pushed_filter(spark, d):
    """Solutions of two problems from their second fold on: the reader drops the other lines."""
    rows = EF.load(spark, _write_solutions(spark, d), "solutions", rangeBytes=1 << 16)
    rows = rows.where((F.col("sample_index") >= 1000) & F.col("task_id").isin("3", "17"))
    return rows.groupBy("task_id").agg(F.count(F.lit(1)).alias("answers"), F.min("sample_index").alias("first_sample"),
                                       F.max("sample_index").alias("last_sample"))


@register("sample_row", """
SELECT true AS is_object, 'task_id,prompt,q_tests,entry_point,test_setup_code,canonical_solution' AS keys
FROM (SELECT min(item_id) AS first FROM benchmark) WHERE first % 7 <> 3
UNION ALL
SELECT true, 'prompt,q_tests,entry_point,test_setup_code,canonical_solution'
FROM (SELECT min(item_id) AS first FROM benchmark) WHERE first % 7 = 3""")
def q_sample_row(spark, d):
    return J.sample_row(spark, _write_problems(spark, d)).select("is_object", F.array_join("keys", ",").alias("keys"))


@register("required_fields_report", """
SELECT field, present, CAST(null_rows AS BIGINT) AS null_rows, rows FROM (
  SELECT 'task_id' AS field, true AS present, count_if(item_id % 7 = 3) AS null_rows, count(*) AS rows FROM benchmark
  UNION ALL SELECT 'prompt', true, count_if(text IS NULL), count(*) FROM benchmark
  UNION ALL SELECT 'tests', false, count(*), count(*) FROM benchmark
  UNION ALL SELECT 'entry_point', true, 0, count(*) FROM benchmark)""")
def q_required_fields_report(spark, d):
    """The written problems file has no ``tests`` field; keys come from its text."""
    return J.required_fields_report(spark.read.text(_write_problems(spark, d)))


def _key_sets(spark, d):
    """One key set per document: which problem fields a file built from it would carry."""
    t = V.texts(spark, d)
    k = F.filter(F.array(F.lit("prompt"),
                         F.when(F.col("lang") == "en", F.lit("entry_point")),
                         F.when(F.col("quality") == 1, F.lit("test_setup_code")),
                         F.when(F.col("toxic") == 1, F.lit("canonical_solution")),
                         F.when(F.col("source").isin("src0", "src1", "src2", "src3", "src4"), F.lit("q_tests"))),
                 lambda x: x.isNotNull())
    return t.select("doc_id", k.alias("keys"))


_KEYS_SQL = """(SELECT doc_id, list_filter(['prompt',
        CASE WHEN lang = 'en' THEN 'entry_point' END,
        CASE WHEN quality = 1 THEN 'test_setup_code' END,
        CASE WHEN toxic = 1 THEN 'canonical_solution' END,
        CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN 'q_tests' END], lambda x: x IS NOT NULL) AS keys
   FROM texts)"""
_SCHEMA_SQL = """CASE WHEN list_contains(keys, 'entry_point') AND list_contains(keys, 'prompt')
                       AND list_contains(keys, 'test_setup_code') THEN 'mbpp'
                  WHEN list_contains(keys, 'entry_point') AND list_contains(keys, 'prompt')
                       AND list_contains(keys, 'canonical_solution') THEN 'humaneval'
                  WHEN list_contains(keys, 'q_tests') AND list_contains(keys, 'test_setup_code') THEN 'q_mbpp'
                  WHEN list_contains(keys, 'q_tests') THEN 'q_humaneval' ELSE 'generic' END"""


@register("detect_schema", with_views(["texts"], f"""
SELECT doc_id, schema,
       CASE WHEN starts_with(schema, 'q_') OR list_contains(keys, 'q_tests') THEN schema ELSE 'generic' END
         AS prompt_template
FROM (SELECT doc_id, keys, {_SCHEMA_SQL} AS schema FROM {_KEYS_SQL})"""))
def q_detect_schema(spark, d):
    k = _key_sets(spark, d)
    s = k.withColumn("schema", C.detect_schema(F.col("keys")))
    return s.select("doc_id", "schema", C.prompt_template(F.col("schema"), F.col("keys")).alias("prompt_template"))


@register("list_datasets", with_views(["texts"], f"""
SELECT 'doc' || CAST(doc_id AS VARCHAR) AS name, printf('%s -> %s (%s)', 'q', 'python', {_SCHEMA_SQL}) AS description
FROM {_KEYS_SQL}"""))
def q_list_datasets(spark, d):
    k = _key_sets(spark, d)
    return k.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"),
                    C.describe(F.lit(C.LANGUAGE), F.lit(C.TEST_LANGUAGE), C.detect_schema(F.col("keys")))
                    .alias("description"))


def _write_catalog_fixture(spark, d):
    """Datasets of every shape, all derived from the problems view."""
    root = derived_dir(spark, d, "catalog")
    p = V.problems(spark, d)
    shapes = {
        "humaneval.jsonl": ["task_id", "prompt", "tests", "entry_point", "canonical_solution"],
        "mbpp.jsonl": ["task_id", "prompt", "tests", "entry_point", "test_setup_code"],
        "q_humaneval.jsonl": ["task_id", "prompt", "tests", "q_tests"],
        "q_mbpp.jsonl": ["task_id", "prompt", "tests", "q_tests", "test_setup_code"],
        "generic.data": ["task_id", "prompt"],
    }
    for name, cols in shapes.items():
        J.write_jsonl(p.select(*cols), os.path.join(root, name), mode="overwrite")
    p.select(F.concat(F.lit("not json: "), F.regexp_replace("prompt", "\\s+", " ")).alias("value")) \
        .write.mode("overwrite").text(os.path.join(root, "broken.data"))
    return root


@register("dataset_catalog", """
SELECT * FROM (VALUES ('humaneval.jsonl', 'jsonl', 'humaneval', 'q', 'python', 'generic', true),
  ('mbpp.jsonl', 'jsonl', 'mbpp', 'q', 'python', 'generic', true),
  ('q_humaneval.jsonl', 'jsonl', 'q_humaneval', 'q', 'python', 'q_humaneval', true),
  ('q_mbpp.jsonl', 'jsonl', 'q_mbpp', 'q', 'python', 'q_mbpp', true),
  ('generic.data', 'jsonl', 'generic', 'q', 'python', 'generic', true),
  ('broken.data', 'jsonl', 'generic', 'q', 'python', 'generic', false))
  t(dataset, format, schema, language, test_language, prompt_template, first_line_is_json)""")
def q_dataset_catalog(spark, d):
    return C.catalog(spark, _write_catalog_fixture(spark, d)).select(
        "dataset", "format", "schema", "language", "test_language", "prompt_template", "first_line_is_json")


@register("detect_format", """
SELECT * FROM (VALUES ('humaneval.jsonl', 'jsonl'), ('mbpp.jsonl', 'jsonl'), ('q_humaneval.jsonl', 'jsonl'),
  ('q_mbpp.jsonl', 'jsonl'), ('generic.data', 'jsonl'), ('broken.data', 'jsonl')) t(dataset, format)""")
def q_detect_format(spark, d):
    c = C.first_lines(spark, _write_catalog_fixture(spark, d))
    return c.select("dataset", C.detect_format(F.col("dataset"), F.col("first_line")).alias("format"))


_SUMMARY_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()), T.StructField("total_solutions", T.LongType()),
    T.StructField("passed_solutions", T.LongType()), T.StructField("total_problems", T.LongType()),
    T.StructField("pass_rate", T.DoubleType()), T.StructField("execution_method", T.StringType()),
    T.StructField("max_workers", T.IntegerType()),
    *[T.StructField(f"pass_at_{k}", T.DoubleType()) for k in (1, 5, 10, 20, 50, 100)],
    T.StructField("per_problem_results", T.ArrayType(T.StructType([
        T.StructField("task_id", T.StringType()), T.StructField("num_samples", T.LongType()),
        T.StructField("num_correct", T.LongType())]))),
])


@register("summary_roundtrip", with_views(["results"], """
SELECT model_name, task_id, count(*) AS num_samples, CAST(count_if(passed) AS BIGINT) AS num_correct
FROM results GROUP BY model_name, task_id"""))
def q_summary_roundtrip(spark, d):
    """Summary documents written as text and read back; their per-problem rows must survive."""
    pp = V.results_counts(spark, d)
    s = S.summary(pp, ["model_name"])
    docs = J.summary_documents(s, pp, ["model_name"])
    path = derived_dir(spark, d, "summary.json")
    J.write_summary(docs, path)
    back = J.read_summary(spark, path, _SUMMARY_SCHEMA)
    return back.select("model_name", F.inline("per_problem_results"))


@register("results_roundtrip", with_views(["results"], """
SELECT model_name, task_id, CAST(sample_index AS BIGINT) AS sample_index, passed FROM results"""))
def q_results_roundtrip(spark, d):
    """A run's result rows written beside its summary and read back."""
    results = V.results(spark, d)
    pp = V.results_counts(spark, d)
    path = derived_dir(spark, d, "run")
    J.write_run(J.summary_documents(S.summary(pp, ["model_name"]), pp, ["model_name"]),
                results.select("model_name", "task_id", "sample_index", "passed"), path)
    return J.read_run_results(spark, path).select("model_name", "task_id", "sample_index", "passed")


@register("registry_listing", """
SELECT * FROM (VALUES ('humaneval', 'q -> python (humaneval)'), ('mbpp', 'q -> python (mbpp)'), ('generic', 'q -> python (generic)'),
  ('q_mbpp', 'q -> python (q_mbpp)')) t(name, description)""")
def q_registry_listing(spark, d):
    """Datasets registered from written files, each with its detected schema, as the registry lists them."""
    root = _write_catalog_fixture(spark, d)
    registry = C.DatasetRegistry(spark, {})
    for name, folder in (("humaneval", "humaneval.jsonl"), ("mbpp", "mbpp.jsonl"), ("generic", "generic.data"), ("q_mbpp", "q_mbpp.jsonl")):
        registry.register(name, os.path.join(root, folder))
    return registry.listing()


@register("summary_indented", with_views(["results"], """
SELECT model_name, task_id, count(*) AS num_samples, CAST(count_if(passed) AS BIGINT) AS num_correct
FROM results GROUP BY model_name, task_id"""))
def q_summary_indented(spark, d):
    """Indented summary documents, a file each, read back; their per-problem rows must survive."""
    pp = V.results_counts(spark, d)
    path = derived_dir(spark, d, "summaries")
    docs = J.summary_documents(S.summary(pp, ["model_name"]), pp, ["model_name"], indented=True)
    J.write_summary_files(docs, path)
    return J.read_summary(spark, path, _SUMMARY_SCHEMA).select("model_name", F.inline("per_problem_results"))


@register("profile_documents", with_views(["trials"], """
SELECT model, trial_no, CAST(tensor_parallel_size AS INTEGER) AS tensor_parallel_size, CAST(batch_size AS INTEGER) AS batch_size, max_tokens,
       CASE WHEN error IS NULL THEN tokens_per_second END AS tokens_per_second, CASE WHEN error IS NULL THEN tokens_generated END AS tokens_generated, error
FROM trials"""))
def q_profile_documents(spark, d):
    """Trials saved as indented documents with nested metrics (even blocks) and flat lines of a later version (odd ones), loaded as VARIANT."""
    t = V.trials(spark, d).withColumn("block", F.floor(F.col("trial_no") / 500))
    ok = F.col("error").isNull()
    metrics = [F.when(ok, F.col(c)).alias(c) for c in ("tokens_per_second", "memory_used_gb", "total_time_seconds")]
    count = F.when(ok, F.col("tokens_generated")).alias("tokens_generated")
    conf = [F.col(c) for c in ("tensor_parallel_size", "batch_size", "max_tokens", "trial_no")]
    old = t.where("block % 2 = 0").groupBy("model", "block").agg(F.collect_list(F.struct(
        *conf, F.when(ok, F.struct(*metrics, count)).alias("metrics"), "error")).alias("configurations"))
    new = t.where("block % 2 = 1").groupBy("model", "block").agg(F.collect_list(F.struct(*conf, *metrics, count, "error")).alias("trials"))
    path = derived_dir(spark, d, "profiles")
    old.select("model", "block", F.to_json(F.struct(F.col("model").alias("model_name"), F.lit(1.7e9).alias("timestamp"), "configurations"), {"pretty": "true"})
               .alias("value")).repartition("model", "block").write.partitionBy("model", "block").text(f"{path}/v1")
    new.select(F.to_json(F.struct(F.lit(2).alias("version"), "model", "trials")).alias("value")).write.text(f"{path}/v2")
    docs = PR.documents(spark, f"{path}/v1").union(PR.documents(spark, f"{path}/v2"))
    PR_FIELDS = dict(PR.TRIAL_FIELDS, trial_no=("bigint", ("$.trial_no",)))
    held = docs.select(PR.field("document", "string", PR.MODEL_PATHS).alias("model"), F.explode(PR.field("document", "array<variant>", PR.TRIAL_LISTS)).alias("_t"))
    names = ["trial_no", "tensor_parallel_size", "batch_size", "max_tokens", "tokens_per_second", "tokens_generated", "error"]
    return held.select("model", *[PR.field("_t", *PR_FIELDS[n]).alias(n) for n in names])


@register("template_registry", with_views(["texts"], f"""
SELECT doc_id, schema, CASE schema WHEN 'mbpp' THEN 'q_mbpp' WHEN 'humaneval' THEN 'q_humaneval' ELSE schema END AS template,
       CASE WHEN schema IN ('mbpp', 'q_mbpp') THEN 'text,q_test_list' WHEN schema = 'generic' THEN 'prompt' ELSE 'prompt,entry_point' END AS fields
FROM (SELECT doc_id, {_SCHEMA_SQL} AS schema FROM {_KEYS_SQL})"""))
def q_template_registry(spark, d):
    """The template, and the fields it reads, that the registry has for each key set's schema."""
    k = _key_sets(spark, d)
    found = k.select("doc_id", C.detect_schema(F.col("keys")).alias("schema")).join(PT.registry(spark), "schema", "left")
    return found.select("doc_id", "schema", "template", F.array_join("fields", ",").alias("fields"))
