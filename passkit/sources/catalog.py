"""Dataset catalog: format and schema detection over many datasets at once.

Detection is a job over the datasets' first records rather than a loop of
file opens on the driver: tasks read the head of each first file and no
more (``evalfiles.heads``), keys come from ``json_object_keys``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passkit.sources.evalfiles import heads

# Language pair of every dataset.
LANGUAGE = "q"
TEST_LANGUAGE = "python"
# Datasets known before any registration (a deployment lists its own here).
REGISTERED: dict[str, dict] = {}


def detect_schema(keys: Column) -> Column:
    """mbpp, humaneval, q_mbpp, q_humaneval or generic, tested in that order on a key array."""
    has = lambda k: F.array_contains(keys, F.lit(k))
    core = has("entry_point") & has("prompt")
    return (F.when(core & has("test_setup_code"), F.lit("mbpp"))
            .when(core & has("canonical_solution"), F.lit("humaneval"))
            .when(has("q_tests") & has("test_setup_code"), F.lit("q_mbpp"))
            .when(has("q_tests"), F.lit("q_humaneval"))
            .otherwise(F.lit("generic")))


def prompt_template(schema: Column, keys: Column) -> Column:
    return F.when(schema.startswith("q_") | F.array_contains(keys, F.lit("q_tests")), schema).otherwise(F.lit("generic"))


def detect_format(name: Column, first_line: Column) -> Column:
    """'.jsonl' / '.json' by suffix of the dataset name; else sniff the first line; fall back to jsonl."""
    return (F.when(name.endswith(".jsonl"), F.lit("jsonl"))
            .when(name.endswith(".json"), F.lit("json"))
            .otherwise(F.lit("jsonl")))


def first_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, dataset, file, first_line, first_record) for every dataset under ``root``.

    A plain file is a dataset of its own; part files (``part-*``) belong to
    their folder, whose first part by name is read. Files are listed without
    being read; of each first file a task reads the first line and, of a
    ``.json`` document, the first record. Nothing comes to the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("file"))
    is_part = F.element_at(F.split("file", "/"), -1).startswith("part-")
    files = files.select("file", F.when(is_part, F.regexp_replace("file", "/[^/]*$", "")).otherwise(F.col("file")).alias("path"))
    first = files.groupBy("path").agg(F.min("file").alias("file")).withColumn("dataset", F.element_at(F.split("path", "/"), -1))
    found = heads(first.withColumn("document", F.col("dataset").endswith(".json")), document="document")
    return found.where(F.col("first_line").isNotNull()).select("path", "dataset", "file", "first_line", "first_record")


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """Auto-configuration of every dataset under ``root`` (format, schema, languages, template).

    A '.json' dataset is a JSON document (an array of records or one record): its first
    record, not its first line, carries the keys.
    """
    fl = first_lines(spark, root).withColumn("_record", F.coalesce("first_record", "first_line")).drop("first_record")
    keys = F.coalesce(F.json_object_keys(F.col("_record")), F.array().cast("array<string>"))
    out = fl.withColumn("keys", keys).withColumn("format", detect_format(F.col("dataset"), F.col("first_line")))
    out = out.withColumn("schema", detect_schema(F.col("keys")))
    return (out.withColumn("language", F.lit(LANGUAGE)).withColumn("test_language", F.lit(TEST_LANGUAGE))
            .withColumn("prompt_template", prompt_template(F.col("schema"), F.col("keys")))
            .withColumn("first_line_is_json", F.try_parse_json(F.col("first_line")).isNotNull())
            .drop("_record"))


def describe(language: Column, test_language: Column, schema: Column) -> Column:
    """'q -> python (humaneval)'."""
    return F.format_string("%s -> %s (%s)", language, test_language, schema)


class DatasetRegistry:
    """Named datasets of a session: config per name, each readable as a temp view.

    ``register`` stores a config (auto-detected from the data when none is
    given) and exposes the problems as a temp view under the name;
    ``listing`` returns name -> 'q -> python (schema)' as a DataFrame.
    """

    def __init__(self, spark: SparkSession, configs: dict | None = None):
        self.spark = spark
        self.configs: dict[str, dict] = {k: dict(v) for k, v in (configs or REGISTERED).items()}

    def register(self, name: str, path: str, config: dict | None = None) -> dict:
        from passkit.sources.jsonl import read_problems
        if config is None:
            keys = F.coalesce(F.json_object_keys(F.coalesce("first_record", "first_line")), F.array().cast("array<string>"))
            row = first_lines(self.spark, path).orderBy("file").select(detect_schema(keys).alias("schema"), keys.alias("keys")).first()
            schema = row.schema if row else "generic"
            keys_list = row["keys"] if row else []
            fmt = "json" if path.rstrip("/").endswith(".json") else "jsonl"
            template = schema if schema.startswith("q_") or "q_tests" in keys_list else "generic"
            config = {"path": path, "format": fmt, "schema": schema, "language": LANGUAGE,
                      "test_language": TEST_LANGUAGE, "prompt_template": template}
        self.configs[name] = dict(config)
        read_problems(self.spark, path, config.get("format", "jsonl")).createOrReplaceTempView(
            name.replace("-", "_"))
        return self.configs[name]

    def get(self, name: str) -> dict:
        if name not in self.configs:
            raise ValueError(f"Dataset not registered: {name}")
        return dict(self.configs[name])

    def listing(self) -> DataFrame:
        rows = [(n, c["language"], c["test_language"], c["schema"]) for n, c in sorted(self.configs.items())]
        df = self.spark.createDataFrame(rows, "name string, language string, test_language string, schema string")
        return df.select("name", describe(F.col("language"), F.col("test_language"), F.col("schema")).alias("description"))
