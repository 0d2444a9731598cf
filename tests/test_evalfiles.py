"""The byte-range data source, file heads, and the stream sink with commits."""
import io
import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from passkit.sources import catalog as C
from passkit.sources import evalfiles as E
from passkit.sources import jsonl as J


def test_ranges_give_every_line_once():
    rnd = random.Random(0)
    for _ in range(300):
        lines = [b"x" * rnd.randrange(0, 30) for _ in range(rnd.randrange(0, 12))]
        data = b"\n".join(lines) + (b"\n" if rnd.random() < 0.5 else b"")
        step, chunk = rnd.randrange(1, 40), rnd.randrange(1, 20)
        got = [b for at in range(0, len(data), step) for b in E.blocks(io.BytesIO(data), at, min(len(data), at + step), chunk)]
        assert b"".join(got) == data


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


def test_heads_read_no_further_than_the_first_record():
    line = Counting(b'{"a": 1}\r\n' + b"x" * 10_000_000)
    assert E.first_line(line) == '{"a": 1}' and line.taken <= 1 << 16
    doc = Counting(b'\n [ {"a": "]}", "b": [1]}, ' + b'{"c": 2},' * 1_000_000)
    assert E.first_record(doc) == '{"a": "]}", "b": [1]}' and doc.taken <= 1 << 16
    long = Counting(json.dumps([{"t": "y" * 500_000}, {"u": "z" * 5_000_000}]).encode())
    assert json.loads(E.first_record(long)) == {"t": "y" * 500_000} and long.taken <= 1_200_000
    for text in (b"", b"[", b"[1, 2]", b"not json", b'{"open": '):
        assert E.first_record(io.BytesIO(text)) is None
    assert E.first_line(io.BytesIO(b"")) is None and E.first_line(io.BytesIO(b"\nx")) == ""


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture()
def solutions(tmp_path):
    rnd = random.Random(4)
    (tmp_path / "s.jsonl").mkdir()
    for k in range(3):
        with open(tmp_path / "s.jsonl" / f"part-{k}.json", "w") as f:
            for i in range(40):
                row = {"task_id": f"t{rnd.randrange(5)}", "sample_index": i, "completion": "é\n" * rnd.randrange(9), "model_name": "m" + str(k), "extra": {"x": 1},
                       "generated_at": "2024-01-01T00:00:00.500"}
                for c in list(row):
                    if rnd.random() < 0.1:
                        row[c] = None
                    elif rnd.random() < 0.1:
                        del row[c]
                if "completion" not in row:
                    row["extracted_code"] = "old"
                f.write(json.dumps(row, ensure_ascii=bool(k)) + rnd.choice(["\n", "\n\n", "\n  \n"]))
    return str(tmp_path / "s.jsonl")


def test_source_equals_json_reader(spark, solutions):
    for size in (50, 1000, 1 << 20):
        assert rows_of(E.read_solutions(spark, solutions, rangeBytes=size)) == rows_of(J.read_solutions(spark, solutions))
    assert rows_of(E.read_solutions(spark, solutions, default_ids=False)) == rows_of(J.read_solutions(spark, solutions, default_ids=False))


def test_filters_are_applied_in_the_reader(spark, solutions):
    df, plain = E.load(spark, solutions, "solutions", rangeBytes=500), spark.read.schema(J.SOLUTION_SCHEMA).json(solutions)
    for cond in (F.col("task_id") == "t1", F.col("sample_index") > 30, F.col("task_id").isin("t1", "t2", None) & (F.col("sample_index") <= 9),
                 F.col("task_id").isNull(), F.col("completion").isNotNull() & (F.col("model_name") == "m1"), F.col("task_id") == "nowhere",
                 F.col("task_id").eqNullSafe("t1"), F.length("completion") > 3):
        assert rows_of(df.where(cond)) == rows_of(plain.where(cond))
    reader = E.RangeReader(J.SOLUTION_SCHEMA, {"path": solutions})
    left = list(reader.pushFilters([E.ds.EqualTo(("task_id",), "t1"), E.ds.StringContains(("completion",), "x")]))
    assert len(left) == 1 and len(reader.filters) == 1
    assert reader._lacks(b'{"task_id": "t2"}\n') and not reader._lacks(b'{"task_id": "t1"}\n') and not reader._lacks(b'{"task_id": "\\u0074x"}\n')


def test_numbers_in_text_fields_and_bad_lines(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text('{"task_id": 7, "sample_index": 1, "completion": [1,"a"]}\n{"task_id": "x", "completion": true}\n')
    assert rows_of(E.read_solutions(spark, str(tmp_path / "n.jsonl"))) == rows_of(J.read_solutions(spark, str(tmp_path / "n.jsonl")))
    assert E.load(spark, str(tmp_path / "n.jsonl"), "solutions").where("task_id = '7'").count() == 1
    (tmp_path / "bad.jsonl").write_text('{"task_id": "a"}\nnot json\n')
    with pytest.raises(Exception, match="bad.jsonl"):
        E.load(spark, str(tmp_path / "bad.jsonl"), "solutions").collect()
    (tmp_path / "empty").mkdir()
    assert E.read_problems(spark, str(tmp_path / "empty")).collect() == []
    with pytest.raises(Exception, match="missing"):
        E.load(spark, str(tmp_path / "missing"), "solutions").collect()


def test_catalog_opens_first_files_only(spark, tmp_path):
    (tmp_path / "a.jsonl").mkdir()
    (tmp_path / "a.jsonl" / "part-0.json").write_text('{"prompt": "p", "entry_point": "f", "test_setup_code": ""}\n' + "garbage\n" * 1000)
    (tmp_path / "a.jsonl" / "part-1.json").write_bytes(b"\xff\xfe broken")
    (tmp_path / "b.json").write_text('[\n {"q_tests": ["x"], "t": "]"},\n not json at all')
    (tmp_path / "void.jsonl").write_text("")
    got = {r["dataset"]: (r["format"], r["schema"]) for r in C.catalog(spark, str(tmp_path)).collect()}
    assert got == {"a.jsonl": ("jsonl", "mbpp"), "b.json": ("json", "q_humaneval")}


# -- stream sink -----------------------------------------------------------------------

def stream(spark, src, out, check, fail=None):
    from pyspark.sql import types as T
    rows = spark.readStream.schema(T.StructType([T.StructField("task_id", T.StringType()), T.StructField("sample_index", T.LongType())])) \
        .option("maxFilesPerTrigger", 2).json(src)
    if fail:  # tasks that meet this sample fail while the flag stands
        flag = F.udf(lambda i, stop=fail: 1 // (0 if i == 17 and os.path.exists(stop) else 1), "int")
        rows = rows.where(flag("sample_index") == 1)
    E.register(spark)
    return rows.writeStream.format(E.FORMAT).option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()


def test_restart_in_mid_run_leaves_no_row_twice(spark, tmp_path):
    src, out, check, flag = (str(tmp_path / x) for x in ("in", "out", "check", "flag"))
    os.makedirs(src)
    os.makedirs(out)
    for k in range(6):
        with open(f"{src}/f{k}.json", "w") as f:
            f.writelines(json.dumps({"task_id": f"t{k}", "sample_index": 5 * k + i}) + "\n" for i in range(5))
        os.utime(f"{src}/f{k}.json", (1e9 + k, 1e9 + k))  # the order in which the stream takes them
    open(flag, "w").close()
    with pytest.raises(Exception):
        stream(spark, src, out, check, flag).awaitTermination()
    first = E.load(spark, out, "solutions", committed=True).count()
    assert first == 10  # the batch of two files before the one that failed
    os.remove(flag)
    stream(spark, src, out, check, flag).awaitTermination()
    want = [(f"t{k}", 5 * k + i) for k in range(6) for i in range(5)]
    read = lambda: sorted((r["task_id"], r["sample_index"]) for r in E.load(spark, out, "solutions", committed=True).collect())
    assert read() == want
    # the sink has committed the last batch, the checkpoint has not: Spark runs it again
    for name in os.listdir(f"{check}/commits"):
        if name.strip(".").split(".")[0] == "2":
            os.remove(f"{check}/commits/{name}")
    stream(spark, src, out, check).awaitTermination()
    assert read() == want
    # the commit of the last batch was cut off after its files were named
    for name in os.listdir(f"{check}/commits"):
        if name.strip(".").split(".")[0] == "2":
            os.remove(f"{check}/commits/{name}")
    os.remove(f"{out}/_commits/2")
    shutil.copy(f"{out}/batch-2-0.jsonl", f"{out}/batch-2-77.jsonl")
    assert len(read()) == 20  # half a batch is not seen
    stream(spark, src, out, check).awaitTermination()
    assert read() == want and not os.path.exists(f"{out}/batch-2-77.jsonl")


def test_abort_drops_what_tasks_wrote(tmp_path):
    sink = E.BatchSink({"path": str(tmp_path)})
    from pyspark.sql import Row
    staged = [sink.write(iter([Row(task_id="a", sample_index=k)])) for k in range(2)] + [sink.write(iter([])), None]
    assert len(os.listdir(tmp_path / "_staging")) == 2
    sink.abort(staged, 0)
    assert os.listdir(tmp_path / "_staging") == [] and E.committed_files(str(tmp_path)) == []
