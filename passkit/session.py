"""Session and storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "passkit") -> SparkSession:
    """Build (or reuse) a session with the settings the library expects.

    On a cluster the master and resources come from spark-submit; locally
    we default to ``local[*]``. AQE stays on so shuffle partitions are
    coalesced and skewed joins are split at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Intermediate tables and checkpoints go there so they survive the loss of
    an executor. A cluster session must set it; a local one without it (tests) gets
    a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="passkit-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` as parquet under the shared folder and read it back.

    Cuts lineage (a lost executor recomputes from the written table, not
    from the sources) and keeps costly plug-in output from being re-run. Each
    call writes a folder of its own.
    """
    spark = spark or df.sparkSession
    base = shared_dir(spark)
    path = os.path.join(base, "passkit_tables", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.parquet(path)
