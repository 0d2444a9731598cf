"""Input tables of the test bed (one parquet file per table)."""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# The test-bed tables are read-only: one DataFrame per (session, path) saves
# the file listing and footer reads that every ``spark.read.parquet`` repeats.
_READS: "weakref.WeakKeyDictionary[SparkSession, dict[str, DataFrame]]" = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table: {name}")
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    per_session = _READS.setdefault(spark, {})
    df = per_session.get(path)
    if df is None:
        df = per_session[path] = spark.read.parquet(path)
    return df
