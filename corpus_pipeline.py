"""Corpus pipeline: five stages over ``documents``, each a thin call of an operator in ``passkit.llm``.

Defined results: an empty table passes through as an empty one; nulls and
repeated rows are treated as each operator's docstring says; columns beyond
those of ``documents`` are dropped by the first stage. ``n_chars`` follows
``text`` (0 for a null text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passkit.llm import decontaminate, line_templates, quality_rules, sentencepiece_wfst, simhash
from passkit.llm.base import documents, ship, stored
from passkit.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    ship(spark)
    return quality_rules.keep(docs.select(*COLUMNS))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines of recurring templates."""
    ship(spark)
    out = line_templates.dedup(docs.select(*COLUMNS))
    length = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", length).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    ship(spark)
    return simhash.keep_one(docs.select(*COLUMNS))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding gives its text back."""
    ship(spark)
    model = sentencepiece_wfst.compile_model(TOKENIZER)
    rows = sentencepiece_wfst.encode(docs, model, decoded="decoded")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids",
                       (F.replace("text", F.lit(sentencepiece_wfst.SPACE), F.lit(" ")) == F.col("decoded")).alias("lossless"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("sentencepiece", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's rows written to the shared folder and read again as the next one's ``docs``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# the near-duplicate, benchmark and encoding stages have no SQL; tests compare them with brute force
ORACLE_SQL = None
