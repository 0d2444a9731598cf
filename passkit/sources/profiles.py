"""Saved profile and benchmark documents: JSON objects of several versions, loaded as VARIANT.

A document keeps its own shape in one ``document`` column; ``field`` takes a value
from the first of several paths that has one, so a table of trials comes out
alike whatever version wrote the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# name -> (type, paths in a trial, newest version last)
TRIAL_FIELDS: dict[str, tuple[str, tuple[str, ...]]] = {
    "tensor_parallel_size": ("int", ("$.tensor_parallel_size",)),
    "batch_size": ("int", ("$.batch_size",)),
    "max_tokens": ("int", ("$.max_tokens",)),
    "tokens_per_second": ("double", ("$.metrics.tokens_per_second", "$.tokens_per_second")),
    "memory_used_gb": ("double", ("$.metrics.memory_used_gb", "$.memory_used_gb")),
    "tokens_generated": ("bigint", ("$.metrics.tokens_generated", "$.tokens_generated")),
    "total_time_seconds": ("double", ("$.metrics.total_time_seconds", "$.total_time_seconds")),
    "error": ("string", ("$.error",)),
}
TRIAL_LISTS = ("$.configurations", "$.trials")
MODEL_PATHS = ("$.model_name", "$.model")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, document, broken): one JSON object per file, however indented, or one per line.

    A text that is no JSON has a NULL document and stands in ``broken``.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    # a file whose first line is a document by itself is read line by line: a JSON parser would stop behind the first
    by_line = F.try_parse_json(F.substring_index(F.trim("value", F.lit(" \t\r\n")), "\n", 1)).isNotNull()
    texts = whole.select("file", F.explode(F.when(by_line, F.split("value", "\n")).otherwise(F.array("value"))).alias("value")).where(F.trim("value") != "")
    return texts.select("file", F.try_parse_json("value").alias("document"), F.when(F.try_parse_json("value").isNull(), F.col("value")).alias("broken"))


def field(variant: str | Column, kind: str, paths: tuple[str, ...]) -> Column:
    """The value at the first path that holds one of this type; NULL if none does."""
    return F.coalesce(*[F.try_variant_get(variant, p, kind) for p in paths])


def trials(docs: DataFrame) -> DataFrame:
    """(file, model, place, fields of a trial...): one row per trial of every document; documents without trials give none."""
    held = docs.where(F.col("document").isNotNull()).select(
        "file", field("document", "string", MODEL_PATHS).alias("model"),
        F.posexplode(field("document", "array<variant>", TRIAL_LISTS)).alias("place", "_t"))
    return held.select("file", "model", "place", *[field("_t", kind, paths).alias(name) for name, (kind, paths) in TRIAL_FIELDS.items()])
