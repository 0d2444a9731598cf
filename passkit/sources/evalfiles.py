"""Data source ``passkit_jsonl``: evaluation files (JSON Lines) read by byte ranges, written by committed batches.

    evalfiles.register(spark)
    spark.read.format("passkit_jsonl").option("kind", "solutions").load(path)
    stream.writeStream.format("passkit_jsonl").option("path", path).option("checkpointLocation", ...)

Reading. A file is cut into ranges of ``rangeBytes``; a line belongs to the range that
holds its first byte, so ranges need no pass of their own to find line ends, and small files
share a task. Blocks of whole lines are parsed to Arrow. Comparisons, IN and null tests on
top-level fields are applied in the reader, before rows reach the JVM; a block whose bytes
lack a wanted text is not even parsed. A line that is no record stops the
job. ``positions`` adds where a row was found: file, range and row of the range.

Writing a stream. Tasks write files under ``_staging``; the commit of a micro-batch names
them ``batch-<id>-<k>.jsonl`` and then writes the marker ``_commits/<id>``, which
lists them. A batch that Spark runs again after its marker was written is thrown
away; one whose commit was cut off half-way is named anew. Readers with ``committed`` take
the files of the markers and no others, so they see a batch whole or not at all.

Files are opened with Arrow's filesystems (local, HDFS, S3, ...).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passkit.sources.jsonl import PROBLEM_SCHEMA, RESULT_SCHEMA, SOLUTION_SCHEMA

FORMAT = "passkit_jsonl"
RANGE_BYTES = 64 << 20
CHUNK = 4 << 20
KINDS = {"problems": PROBLEM_SCHEMA, "solutions": SOLUTION_SCHEMA, "results": RESULT_SCHEMA}
POSITIONS = T.StructType([T.StructField("_path", T.StringType()), T.StructField("_start", T.LongType()), T.StructField("_row", T.LongType())])
PLAIN = re.compile(rb'[A-Za-z0-9_ .:-]+')


# -- files ---------------------------------------------------------------------------

def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's filesystem of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def data_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a dataset, by path: itself, or all files below it but for hidden ones."""
    store, at = store_of(path)
    info = store.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(at, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(pafs.FileSelector(at, recursive=True))
    shown = [f for f in found if f.type == pafs.FileType.File and f.size and not any(
        p.startswith(("_", ".")) for p in f.path[len(at):].split("/"))]
    return sorted((f.path, f.size) for f in shown)


def blocks(f, start: int, end: int, chunk: int = CHUNK) -> Iterator[bytes]:
    """Blocks of the whole lines whose first byte lies in [start, end); reads up to the end of the last one."""
    at, held = start, b""
    if start:  # the line that the byte before ``start`` belongs to is another range's
        f.seek(start - 1)
        at = start - 1
        while True:
            data = f.read(chunk)
            if not data:
                return
            cut = data.find(b"\n")
            if cut >= 0:
                at, held = at + cut + 1, data[cut + 1:]
                break
            at += len(data)
    first = True
    while at < end:
        data = held if first and held else f.read(chunk)
        held, first = (b"" if first and held else held), False
        if not data:
            break
        held += data
        if at + len(held) >= end:
            cut = held.find(b"\n", max(0, end - at - 1))
            if cut >= 0:
                yield held[:cut + 1]
                return
        else:
            cut = held.rfind(b"\n")
            if cut >= 0:
                yield held[:cut + 1]
                at, held = at + cut + 1, held[cut + 1:]
    if held and at < end:
        yield held


def first_line(f, chunk: int = 1 << 16) -> str | None:
    """The first line of an open file, which is read no further; None if it is empty."""
    held = b""
    while True:
        data = f.read(chunk)
        held += data
        cut = held.find(b"\n")
        if cut >= 0 or not data:
            return (held[:cut] if cut >= 0 else held).removesuffix(b"\r").decode("utf-8", "replace") if held else None


def first_record(f, chunk: int = 1 << 16) -> str | None:
    """The text of the first record of a JSON document (an array of records, or one record); None if there is none.

    Reads on, twice as much each time, until the record ends.
    """
    held, ended = b"", False
    while not ended:
        data = f.read(max(chunk, len(held)))
        held, ended = held + data, not data
        text = held.decode("utf-8", "ignore").lstrip("\ufeff \t\r\n")
        if text.startswith("["):
            text = text[1:].lstrip()
        if not text.startswith("{"):
            if text:
                return None
            continue
        try:
            _, stop = json.JSONDecoder().raw_decode(text)
            return text[:stop]
        except ValueError:
            continue
    return None


def heads(files: DataFrame, column: str = "file", document: str | None = None) -> DataFrame:
    """``files`` and the ``first_line`` and ``first_record`` of each file, of which no more is read than those.

    The first record is the first line, or where the boolean column ``document`` is true the first
    record of the JSON document.
    """
    at, whole = files.columns.index(column), files.columns.index(document) if document else None
    schema = T.StructType([*files.schema.fields, T.StructField("first_line", T.StringType()), T.StructField("first_record", T.StringType())])

    def head(path: str, how):
        store, inner = store_of(path)
        with store.open_input_stream(inner) as f:
            return how(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column(at).to_pylist()
            lines = [head(p, first_line) for p in paths]
            wanted = b.column(whole).to_pylist() if document else [False] * len(paths)
            records = [head(p, first_record) if w else x for p, w, x in zip(paths, wanted, lines)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lines, pa.string()), pa.array(records, pa.string())],
                                             names=[*b.schema.names, "first_line", "first_record"])

    return files.mapInArrow(run, schema)


# -- records -------------------------------------------------------------------------

def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _value(v, kind: pa.DataType):
    """A JSON value as Spark's own reader takes it: any other value in a text field is its JSON text, without spaces."""
    if v is None:
        return None
    if pa.types.is_string(kind):
        return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    if pa.types.is_timestamp(kind):
        return datetime.fromisoformat(v)
    if pa.types.is_list(kind):
        return [_value(x, kind.value_type) for x in v]
    return v


def parse(block: bytes, schema: pa.Schema) -> pa.Table:
    """Records of a block of lines; blank lines are none. ValueError for a line that is no record."""
    from pyarrow import json as paj
    if not block.strip():
        return schema.empty_table()
    try:
        return paj.read_json(pa.BufferReader(block), read_options=paj.ReadOptions(use_threads=False, block_size=len(block) + 1),
                             parse_options=paj.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore")).select(schema.names)
    except pa.ArrowInvalid:  # a number in a text field, or a bad line
        rows = []
        for line in block.split(b"\n"):
            if line.strip():
                row = json.loads(line)
                if not isinstance(row, dict):
                    raise ValueError(f"no record: {line[:200]!r}") from None
                rows.append({f.name: _value(row.get(f.name), f.type) for f in schema})
        return pa.Table.from_pylist(rows, schema=schema)


_COMPARED = {ds.EqualTo: pc.equal, ds.GreaterThan: pc.greater, ds.GreaterThanOrEqual: pc.greater_equal,
             ds.LessThan: pc.less, ds.LessThanOrEqual: pc.less_equal}


def _kept(table: pa.Table, filters: Sequence[ds.Filter]) -> pa.Table:
    """Rows that pass every filter (a null comparison does not pass)."""
    def mask(f):
        column = table.column(f.attribute[0])
        if isinstance(f, ds.IsNull):
            return column.is_null()
        if isinstance(f, ds.IsNotNull):
            return column.is_valid()
        if isinstance(f, ds.In):
            return pc.is_in(column, value_set=pa.array([v for v in f.value if v is not None], column.type))
        return _COMPARED[type(f)](column, pa.scalar(f.value, column.type))

    return table.filter(reduce(pc.and_, map(mask, filters))) if filters else table


@dataclass
class Ranges(ds.InputPartition):
    """Byte ranges of one task: (path, start, end)."""

    ranges: tuple[tuple[str, int, int], ...]


class RangeReader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.wanted, self.path = schema, options["path"]
        self.positions = options.get("positions", "false").lower() == "true"
        self.committed = options.get("committed", "false").lower() == "true"
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters):
        """Keeps comparisons of plain fields; the others stay with Spark."""
        kinds = {f.name: f.dataType for f in self.wanted.fields if f.name not in POSITIONS.names}
        for f in filters:
            plain = isinstance(f, (*_COMPARED, ds.In, ds.IsNull, ds.IsNotNull)) and len(f.attribute) == 1
            if plain and isinstance(kinds.get(f.attribute[0]), (T.StringType, T.LongType, T.BooleanType)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        files = committed_files(self.path) if self.committed else data_files(self.path)
        tasks, held, size = [], [], 0
        for path, n in files:
            packed = path.endswith((".gz", ".bz2"))  # no reading from the middle
            for start in range(0, n, n if packed else self.range_bytes):
                end = n if packed else min(n, start + self.range_bytes)
                if held and size + end - start > self.range_bytes:
                    tasks.append(Ranges(tuple(held)))
                    held, size = [], 0
                held.append((path, start, end))
                size += end - start
        if held:
            tasks.append(Ranges(tuple(held)))
        return tasks or [Ranges(())]

    def _lacks(self, block: bytes) -> bool:
        """Whether a wanted text stands nowhere in the block, so that no line of it can pass."""
        if b"\\u" in block:
            return False
        for f in self.filters:
            if isinstance(f, ds.EqualTo) and isinstance(f.value, str):
                text = f.value.encode()
                if PLAIN.fullmatch(text) and b'"' + text + b'"' not in block and text not in re.findall(rb":\s*([-+.0-9Ea-z]+)", block):
                    return True
        return False

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        own = T.StructType([f for f in self.wanted.fields if f.name not in POSITIONS.names])
        schema, out = arrow_schema(own), arrow_schema(self.wanted)
        for path, start, end in partition.ranges:
            packed = path.endswith((".gz", ".bz2"))
            with store.open_input_stream(path) if packed else store.open_input_file(path) as f:
                row = 0
                for block in blocks(f, 0, 1 << 62) if packed else blocks(f, start, end):
                    if self.filters and not self.positions and self._lacks(block):
                        continue
                    try:
                        table = parse(block, schema)
                    except ValueError as e:
                        raise ValueError(f"{path}, bytes {start} to {end}: {e}") from None
                    n = table.num_rows
                    if self.positions:
                        for name, column in (("_path", pa.repeat(path, n)), ("_start", pa.repeat(pa.scalar(start, pa.int64()), n)),
                                             ("_row", pa.array(range(row, row + n), pa.int64()))):
                            table = table.append_column(name, column)
                        row += n
                    yield from _kept(table, self.filters).select(out.names).cast(out).to_batches(max_chunksize=10_000)


# -- stream sink ---------------------------------------------------------------------

@dataclass
class Staged(ds.WriterCommitMessage):
    """A file that a task has written, '' if it had no rows."""

    path: str
    rows: int


def committed_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of all committed batches."""
    store, at = store_of(path)
    marks = store.get_file_info(pafs.FileSelector(f"{at}/_commits", allow_not_found=True))
    names = []
    for m in marks:
        if not m.base_name.startswith((".", "_")):
            with store.open_input_stream(m.path) as f:
                names += json.loads(f.read())["files"]
    return [(i.path, i.size) for i in store.get_file_info([f"{at}/{n}" for n in sorted(names)])]


class BatchSink(ds.DataSourceStreamWriter):
    """Each micro-batch once, however often Spark runs it."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator) -> Staged:
        store, at = store_of(self.path)
        staged, rows, f = f"{at}/_staging/{uuid.uuid4().hex}.jsonl", 0, None
        try:
            for row in iterator:
                if f is None:
                    store.create_dir(f"{at}/_staging", recursive=True)
                    f = store.open_output_stream(staged)
                fields = {k: v.isoformat() if isinstance(v, datetime) else v for k, v in row.asDict(recursive=True).items() if v is not None}
                f.write(json.dumps(fields, ensure_ascii=False).encode() + b"\n")
                rows += 1
        finally:
            if f is not None:
                f.close()
        return Staged(staged if rows else "", rows)

    def _drop(self, messages) -> None:
        store, _ = store_of(self.path)
        for m in messages:
            if m is not None and m.path and store.get_file_info(m.path).type == pafs.FileType.File:
                store.delete_file(m.path)

    def commit(self, messages, batchId: int) -> None:
        store, at = store_of(self.path)
        mark = f"{at}/_commits/{batchId}"
        if store.get_file_info(mark).type == pafs.FileType.File:
            return self._drop(messages)  # an earlier run of this batch is the one that counts
        store.create_dir(f"{at}/_commits", recursive=True)
        for left in store.get_file_info(pafs.FileSelector(at)):  # of a commit that was cut off
            if left.base_name.startswith(f"batch-{batchId}-"):
                store.delete_file(left.path)
        files = []
        for k, m in enumerate(m for m in messages if m is not None and m.path):
            files.append(f"batch-{batchId}-{k}.jsonl")
            store.move(m.path, f"{at}/{files[-1]}")
        half = f"{at}/_commits/.{batchId}-{uuid.uuid4().hex}"
        with store.open_output_stream(half) as f:
            f.write(json.dumps({"files": files, "rows": sum(m.rows for m in messages if m is not None)}).encode())
        store.move(half, mark)

    def abort(self, messages, batchId: int) -> None:
        self._drop(messages)


class EvaluationFiles(ds.DataSource):
    """Options: path, kind (problems, solutions, results), positions, committed, rangeBytes."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        kind = KINDS[self.options.get("kind", "solutions")]
        return T.StructType([*kind.fields, *POSITIONS.fields]) if self.options.get("positions", "false").lower() == "true" else kind

    def reader(self, schema):
        return RangeReader(schema, {k.lower(): v for k, v in self.options.items()})

    def streamWriter(self, schema, overwrite):
        return BatchSink({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let Spark offer it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EvaluationFiles)


def load(spark: SparkSession, path: str, kind: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """The records as they stand in the files."""
    register(spark)
    reader = spark.read.format(FORMAT).option("kind", kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def with_place(rows: DataFrame, name: str) -> DataFrame:
    """0-based position of rows loaded with ``positions``: by file path, then place in the file.

    Rows are counted per range, and the ranges' offsets (a row each) joined; no row is shuffled.
    """
    counts = rows.groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_path", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return rows.join(offsets, ["_path", "_start"]).withColumn(name, F.col("_offset") + F.col("_row")).drop("_path", "_start", "_row", "_offset")


def read_problems(spark: SparkSession, path: str, **options) -> DataFrame:
    """As ``jsonl.read_problems``, through the data source."""
    df = with_place(load(spark, path, "problems", positions=True, **options), "pos")
    return df.withColumn("task_id", F.coalesce("task_id", F.concat(F.lit("task_"), F.col("pos").cast("string"))))


def read_solutions(spark: SparkSession, path: str, default_ids: bool = True, **options) -> DataFrame:
    """As ``jsonl.read_solutions``, through the data source."""
    df = load(spark, path, "solutions", positions=default_ids, **options)
    if default_ids:
        df = with_place(df, "_pos").withColumn("task_id", F.coalesce(
            "task_id", F.concat(F.lit("task_"), F.col("_pos").cast("string")))).drop("_pos")
    return (df.withColumn("completion", F.coalesce("completion", "extracted_code"))
            .withColumn("sample_index", F.coalesce("sample_index", F.lit(0))).drop("extracted_code"))
