"""Structured Streaming: solutions and results arriving as new files.

* ``stream_files`` reads a directory as a stream (explicit schema; one or
  more new files per micro-batch -- lines appended to a file already read
  are not seen, so writers always add files);
* ``live_tally`` keeps the counts of each (model, task) in keyed state
  (``transformWithStateInPandas``, RocksDB), and the state is the live table: it has a row per
  key however many micro-batches have run. A key that stays idle may leave the state by a
  timer, as one row of the table of closed keys. ``read_tally``
  reads both, now or as of an earlier micro-batch, and equals the batch ``per_problem``;
* ``stream_dedup`` drops re-appended samples with
  ``dropDuplicatesWithinWatermark`` (state bounded by the watermark); times
  in the future do not move the watermark, ``spread`` finds the delay that files
  need, and ``StreamCounts`` counts every row that came in, went out or was late;
* ``dedup_latest`` is the batch form: the latest record per key wins.

Checkpoints live under ``spark.checkpoint.dir`` so a restarted query resumes
exactly once.
"""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener

from passkit.functions.metrics import pass_at_k
from passkit.session import shared_dir

KEY = ("model_name", "task_id", "sample_index")
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never reused, never cleared)."""
    return os.path.join(shared_dir(spark), "passkit_streams", f"{name}-{uuid.uuid4().hex[:12]}")


def stream_files(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None,
                 bytes_per_trigger: str = "4g") -> DataFrame:
    """New files of ``path``: a micro-batch takes as many as ``bytes_per_trigger`` holds, or ``files_per_trigger``."""
    reader = spark.readStream.schema(schema).option("mode", "FAILFAST")
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.json(path)


def files_per_batch(spark: SparkSession, path: str, least: int, batches: int = 8) -> int:
    """Files of a micro-batch, so that the files waiting in ``path`` take ``batches`` micro-batches at most: ``least`` files or more.

    A micro-batch has a cost of its own (a task and a commit per state partition, and what each sends to the
    driver), so their number must not grow with a backlog.
    """
    return max(least, -(-len(spark.read.text(path).inputFiles()) // batches))


class Tally(StatefulProcessor):
    """Counts of one key in state. With ``idle_ms``, a key without a result for that long leaves as a row."""

    def __init__(self, keys: Sequence[str], idle_ms: int | None):
        self.keys, self.idle_ms = list(keys), idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.tally = handle.getValueState("tally", "num_samples long, num_correct long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, c, timer = self.tally.get() if self.tally.exists() else (0, 0, -1)
        now = 0
        for part in rows:
            n, c, now = n + int(part["n"].sum()), c + int(part["c"].sum()), max(now, int(part["at"].max()))
        if self.idle_ms is not None:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = now + self.idle_ms
            self.handle.registerTimer(timer)
        self.tally.update((n, c, timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.tally.exists():
            return
        n, c, _ = self.tally.get()
        self.tally.clear()
        yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key)}, "num_samples": [n], "num_correct": [c]})

    def close(self) -> None:
        pass


def _combined(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a micro-batch as (keys, n, c) per task: a hot key reaches the state as one row a task."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield part.groupby(list(keys), dropna=False, as_index=False).agg(n=("ok", "size"), c=("ok", "sum"))

    fields = [T.StructField(k, rows.schema[k].dataType) for k in keys]
    return rows.mapInPandas(run, T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("c", T.LongType())]))


def live_tally(results: DataFrame, out_path: str, checkpoint: str, keys: Sequence[str] = ("model_name", "task_id"),
               idle: str | None = None) -> StreamingQuery:
    """Start the tally of streamed results; closed keys (see ``idle``, such as '1 day') are appended to ``out_path``.

    Idle time is counted from when rows arrive: the watermark follows the time of the micro-batch,
    so no row is ever late and none is dropped. A closed key that gets results again starts a new count, and ``read_tally`` adds
    the two.
    """
    spark = results.sparkSession
    rows = results.select(*keys, F.coalesce("passed", F.lit(False)).cast("int").alias("ok"))
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    schema = T.StructType([*[T.StructField(k, results.schema[k].dataType) for k in keys],
                           T.StructField("num_samples", T.LongType()), T.StructField("num_correct", T.LongType())])
    combined = _combined(rows, keys).withColumns({"seen": F.current_timestamp(), "at": F.unix_millis(F.current_timestamp())})
    closed = combined.withWatermark("seen", "0 seconds").groupBy(*keys).transformWithStateInPandas(
        Tally(keys, idle_ms), schema, "append", "None" if idle is None else "EventTime")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        return (closed.writeStream.outputMode("append").format("parquet").option("path", out_path)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def tally_state(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """(keys, num_samples, num_correct) of the open keys: the state itself, one row a key, as of a micro-batch (default: the last)."""
    reader = spark.read.format("statestore").option("stateVarName", "tally")
    state = (reader if batch_id is None else reader.option("batchId", batch_id)).load(checkpoint)
    return state.select("key.*", "value.num_samples", "value.num_correct")


def read_tally(spark: SparkSession, out_path: str, checkpoint: str, keys: Sequence[str] = ("model_name", "task_id"),
               ks: Sequence[int] = ()) -> DataFrame:
    """Counts per key, open or closed, plus running pass@k for ``ks``."""
    state = tally_state(spark, checkpoint)
    both = state.unionByName(spark.read.schema(state.schema).parquet(out_path))
    out = both.groupBy(*keys).agg(F.sum("num_samples").alias("num_samples"), F.sum("num_correct").alias("num_correct"))
    for k in ks:
        out = out.withColumn(f"pass_at_{k}", pass_at_k("num_samples", "num_correct", F.lit(k)))
    return out


def spread(rows: DataFrame, event_time: str = "generated_at") -> str:
    """The watermark delay under which no row of a batch table is late, however its files are ordered: last time less first
    (times in the future taken as now, as ``stream_dedup`` takes them), and a day, for now moves on until the files are read."""
    t = F.least(F.col(event_time).cast("timestamp"), F.current_timestamp())
    got = rows.agg((F.unix_seconds(F.max(t)) - F.unix_seconds(F.min(t))).alias("s")).first()["s"]
    return f"{(got or 0) + 86400} seconds"


class StreamCounts(StreamingQueryListener):
    """Rows of each streaming query by what became of them: ``read`` (seen by ``stream_dedup``'s observation), ``late`` (dropped
    behind the watermark by a stateful operator) and ``written`` (by the sink, where it tells). Only these numbers are kept.

    Progress events come in a thread of Spark's; ``of`` gives the sums so far.
    """

    def __init__(self):
        self.sums: dict[str, dict[str, int]] = {}
        self.ended: set[str] = set()
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get("rows_read")
        with self.lock:
            s = self.sums.setdefault(str(p.id), {"read": 0, "late": 0, "written": 0})
            s["read"] += seen["n"] if seen is not None else 0
            s["late"] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
            s["written"] += max(p.sink.numOutputRows, 0)

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.ended.add(str(event.id))

    def of(self, query: StreamingQuery) -> dict[str, int]:
        with self.lock:
            return dict(self.sums.get(str(query.id), {"read": 0, "late": 0, "written": 0}))


def stream_dedup(solutions: DataFrame, out_path: str, checkpoint: str, delay: str,
                 keys: Sequence[str] = KEY, event_time: str = "generated_at") -> StreamingQuery:
    """Drop re-appended samples. ``delay`` must cover how far out of event-time order
    records arrive (``spread`` finds it for given files): state is kept that long, and rows
    older than the watermark are late; Spark drops them and a ``StreamCounts`` listener counts them.

    A time in the future counts as now, so one wrong date cannot make the rows after it
    late; a row without a time counts as of the Unix epoch.
    """
    # watermarks need TIMESTAMP; solution times are written without a zone (NTZ)
    when = F.coalesce(F.least(F.col(event_time).cast("timestamp"), F.current_timestamp()), F.lit("1970-01-01").cast("timestamp"))
    timed = solutions.observe("rows_read", F.count(F.lit(1)).alias("n")).withColumn("_event_time", when)
    deduped = (timed.withWatermark("_event_time", delay).dropDuplicatesWithinWatermark(list(keys))
               .drop("_event_time"))
    return (deduped.writeStream.outputMode("append").format("parquet").option("path", out_path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def dedup_latest(df: DataFrame, keys: Sequence[str] = KEY, order: Sequence[str] = ("generated_at",)) -> DataFrame:
    """Latest record per key; ``order`` columns (then the rest of the row) decide, so ties are repeatable.

    ``max_by`` in an aggregation combines map-side: a key re-appended a
    million times costs no single task more than any other key.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordering).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
