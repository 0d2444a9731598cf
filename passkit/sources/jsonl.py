"""JSON Lines / JSON sources and sinks for problems, solutions and summaries.

A dataset is a path Spark can read: a file or a directory of part files.
Explicit schemas (no inference pass over the data), ``FAILFAST`` so a
malformed line stops the job instead of turning into NULLs; blank lines
are skipped by the reader. Writers append new part files -- Spark's file
stream only sees new files, never lines appended to a file it has read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


PROBLEM_SCHEMA = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("tests", T.StringType()),
    T.StructField("q_tests", T.ArrayType(T.StringType())),
    T.StructField("entry_point", T.StringType()),
    T.StructField("test_setup_code", T.StringType()),
    T.StructField("canonical_solution", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("q_test_list", T.ArrayType(T.StringType())),
])
SOLUTION_SCHEMA = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("sample_index", T.LongType()),
    T.StructField("completion", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("generated_at", T.TimestampNTZType()),
    T.StructField("extracted_code", T.StringType()),
])
RESULT_SCHEMA = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("sample_index", T.LongType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("info", T.StringType()),
    T.StructField("error", T.StringType()),
])
REQUIRED_PROBLEM_FIELDS = ("task_id", "prompt", "tests", "entry_point")


def _reader(spark: SparkSession, schema: T.StructType, multiline: bool = False):
    r = spark.read.schema(schema).option("mode", "FAILFAST")
    if multiline:
        r = r.option("multiLine", "true")
    return r


def with_positions(df: DataFrame, name: str, touch: str) -> DataFrame:
    """Add the 0-based position of each row of a freshly read ``df``: by file path, then place in the file.

    A split's rows are numbered by ``monotonically_increasing_id`` from its
    first row on; where a split starts follows from the row counts of those
    before it, a table of one row per split. Rows are not shuffled.
    ``touch`` is a column the counting scan reads, so that it parses the rows
    as the other scan does.
    """
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    rows = df.select("*", *split).withColumn("_mono", F.monotonically_increasing_id())
    starts = rows.groupBy("_file", "_block").agg(F.min("_mono").alias("_first"), F.count(F.lit(1)).alias("_rows"), F.max(touch).alias("_touch"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_file", "_block", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return rows.join(starts, ["_file", "_block"]).withColumn(name, F.col("_offset") + F.col("_mono") - F.col("_first")).drop(
        "_file", "_block", "_mono", "_first", "_offset")


def read_problems(spark: SparkSession, path: str, fmt: str = "jsonl") -> DataFrame:
    """Problems with a 0-based ``pos`` in file order (by path, then place) and ``task_id`` defaulted to ``task_{pos}``."""
    df = _reader(spark, PROBLEM_SCHEMA, multiline=(fmt == "json")).json(path)
    df = with_positions(df, "pos", "task_id")
    return df.withColumn("task_id", F.coalesce(F.col("task_id"), F.concat(F.lit("task_"), F.col("pos").cast("string"))))


def read_solutions(spark: SparkSession, path: str, default_ids: bool = True) -> DataFrame:
    """Solutions; the legacy ``extracted_code`` stands in where ``completion`` is absent,
    a missing sample_index is 0, and a missing task_id is ``task_{pos}`` by the
    position in the files (NULL without ``default_ids``).
    """
    df = _reader(spark, SOLUTION_SCHEMA).json(path)
    if default_ids:
        df = with_positions(df, "_pos", "task_id").withColumn(
            "task_id", F.coalesce(F.col("task_id"), F.concat(F.lit("task_"), F.col("_pos").cast("string")))).drop("_pos")
    return (df.withColumn("completion", F.coalesce(F.col("completion"), F.col("extracted_code")))
            .withColumn("sample_index", F.coalesce(F.col("sample_index"), F.lit(0)))
            .drop("extracted_code"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return _reader(spark, RESULT_SCHEMA).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object per line; ``append`` adds new part files (O9)."""
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)


def first_file(spark: SparkSession, path: str) -> str:
    """The first data file of a dataset (by name); files are listed without being read, one name comes to the driver."""
    name = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.min("path")).first()[0]
    if name is None:
        raise ValueError(f"Dataset is empty: {path}")
    return name


def sample_row(spark: SparkSession, path: str) -> DataFrame:
    """First line of the first file: its text, whether it is a JSON object, and its keys.

    The file is read up to the end of that line (``evalfiles.heads``). A
    non-object (array, scalar, bad JSON) gives ``is_object`` false and NULL keys.
    """
    from passkit.sources.evalfiles import heads
    line = heads(spark.createDataFrame([(first_file(spark, path),)], "file string")).where("first_line IS NOT NULL")
    keys = F.json_object_keys(F.col("first_line"))
    return line.select("file", "first_line", keys.isNotNull().alias("is_object"), keys.alias("keys"))


def required_fields_report(lines: DataFrame, required=REQUIRED_PROBLEM_FIELDS, value: str = "value") -> DataFrame:
    """Per required field: whether any record has the key, and records without it or with a null (one aggregation).

    ``lines`` are the JSON texts of the records, as ``spark.read.text``
    gives them; blank lines are no records.
    """
    t = lines.where(F.trim(value) != "").select(F.coalesce(F.json_object_keys(value), F.array().cast("array<string>")).alias("keys"), value)
    counts = t.agg(F.count(F.lit(1)).alias("_rows"),
                   *[F.coalesce(F.max(F.array_contains("keys", f)), F.lit(False)).alias(f"_has_{f}") for f in required],
                   *[F.count_if(F.get_json_object(value, f"$.{f}").isNull()).alias(f"_null_{f}") for f in required])
    stack = ", ".join(f"'{f}', _has_{f}, _null_{f}" for f in required)
    return counts.selectExpr(f"stack({len(required)}, {stack}) AS (field, present, null_rows)", "_rows AS rows")


def summary_documents(summary: DataFrame, per_problem: DataFrame, keys=("model_name",), indented: bool = False) -> DataFrame:
    """One JSON document per group: summary scalars + its per-problem rows; on one line, or ``indented``.

    Per-problem rows are few per model (one per problem); raw results are
    not embedded -- they stay their own table.
    """
    keys = list(keys)
    pp = per_problem.groupBy(*keys).agg(F.collect_list(F.struct("task_id", "num_samples", "num_correct"))
                                        .alias("per_problem_results"))
    doc = summary.join(pp, on=keys, how="left")
    return doc.select(*keys, F.to_json(F.struct(*[c for c in doc.columns]), {"pretty": str(indented).lower()}).alias("document"))


def write_summary(docs: DataFrame, path: str) -> None:
    """Writes the documents as text (UTF-8, one document per line)."""
    docs.select("document").write.mode("overwrite").text(path)


def write_summary_files(docs: DataFrame, path: str, keys=("model_name",)) -> None:
    """One file per document (indented or not) under folders named by the keys, as ``read_summary`` reads them."""
    docs.repartition(*keys).select(*keys, "document").write.mode("overwrite").partitionBy(*keys).text(path)


def write_run(docs: DataFrame, results: DataFrame, path: str, keys=("model_name",)) -> None:
    """A run's summary documents under ``summary/`` and its result rows, JSON Lines by ``keys``, under ``results/``.

    Results stay rows of files: a model may have more of them than one
    document, one task or one row can hold.
    """
    write_summary(docs, f"{path}/summary")
    results.write.mode("overwrite").option("ignoreNullFields", "true").partitionBy(*keys).json(f"{path}/results")


def read_run_results(spark: SparkSession, path: str, keys: str = "model_name string") -> DataFrame:
    """The result rows of ``write_run``, with the keys from the folder names."""
    schema = T.StructType([*RESULT_SCHEMA.fields, *T.StructType.fromDDL(keys).fields])
    return _reader(spark, schema).json(f"{path}/results")


def read_summary(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Summary documents back as rows, from files with one document per line or one indented document.

    A file with a line that is no document is read as one whole document; one that is none either
    gives no row. A missing path gives an empty table, as the reference does.
    """
    def read(whole: bool) -> DataFrame:
        return spark.read.text(path, wholetext=whole).select("value", F.col("_metadata.file_path").alias("_file")).where(F.trim("value") != "")

    try:
        lines, whole = read(False), read(True)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise
    is_document = F.json_object_keys("value").isNotNull()
    broken = lines.where(~is_document).select("_file").distinct()
    found = lines.join(broken, "_file", "left_anti").union(whole.join(broken, "_file", "left_semi").where(is_document))
    return found.select(F.from_json("value", schema).alias("_d")).select("_d.*")
