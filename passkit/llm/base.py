"""Helpers shared by the training-data operators.

Words are maximal runs of characters other than U+0020 and U+0009..U+000D;
that is what ``bytes.split()`` does on UTF-8 text and what ``WORD_GAP``
splits on in Spark SQL.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAP = "[\\x20\\x09-\\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers that cannot import it: once per application, unless PYTHONPATH has its folder."""
    app = spark.sparkContext.applicationId
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or os.path.realpath(root) in known:
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp(prefix="passkit-package-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/passkit", "zip", root, "passkit"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local-mode session without one gets its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="passkit-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, different for every call."""
    return f"{shared_dir(spark)}/passkit-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (few narrow columns) with a broadcast hint if it has at most ``most`` rows; else a shuffle join is left to Spark."""
    return F.broadcast(df) if df.count() <= most else df
