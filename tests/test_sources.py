"""Readers, catalog detection and the driver entry points."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from passkit.sources import catalog as C
from passkit.sources import jsonl as J


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_read_problems_blank_lines_and_default_ids(spark):
    d = tempfile.mkdtemp(prefix="passkit-src-")
    p = _write(os.path.join(d, "p.jsonl"), json.dumps({"task_id": "a", "prompt": "x", "entry_point": "f"}) + "\n\n"
               + json.dumps({"prompt": "y", "entry_point": "g"}) + "\n" + json.dumps({"task_id": 7, "prompt": "z"}) + "\n")
    rows = J.read_problems(spark, p).orderBy("pos").collect()
    assert [(r.task_id, r.pos, r.prompt) for r in rows] == [("a", 0, "x"), ("task_1", 1, "y"), ("7", 2, "z")]


def test_malformed_line_fails(spark):
    d = tempfile.mkdtemp(prefix="passkit-src-")
    p = _write(os.path.join(d, "bad.jsonl"), '{"prompt": "x"}\n{not json\n')
    with pytest.raises(Exception):
        J.read_problems(spark, p).collect()


def test_json_document_format(spark):
    d = tempfile.mkdtemp(prefix="passkit-src-")
    p = _write(os.path.join(d, "p.json"), json.dumps([{"task_id": "a", "prompt": "x"}, {"task_id": "b", "prompt": "y"}], indent=2))
    assert sorted(r.task_id for r in J.read_problems(spark, p, fmt="json").collect()) == ["a", "b"]


def test_sample_row_non_object(spark):
    d = tempfile.mkdtemp(prefix="passkit-src-")
    _write(os.path.join(d, "a.jsonl"), "[1, 2]\n")
    r = J.sample_row(spark, d).first()
    assert r.is_object is False and r.keys is None


def test_legacy_extracted_code(spark):
    d = tempfile.mkdtemp(prefix="passkit-src-")
    p = _write(os.path.join(d, "s.jsonl"), json.dumps({"task_id": "t", "sample_index": 1, "extracted_code": "{x}"}) + "\n")
    r = J.read_solutions(spark, p).first()
    assert (r.task_id, r.sample_index, r.completion) == ("t", 1, "{x}")


@pytest.mark.parametrize("keys,schema,template", [
    (["prompt", "entry_point", "test_setup_code"], "mbpp", "generic"),
    (["prompt", "entry_point", "canonical_solution", "q_tests"], "humaneval", "humaneval"),
    (["prompt", "tests", "q_tests", "entry_point", "test_setup_code", "canonical_solution"], "mbpp", "mbpp"),
    (["q_tests", "test_setup_code"], "q_mbpp", "q_mbpp"),
    (["q_tests"], "q_humaneval", "q_humaneval"),
    (["prompt"], "generic", "generic"),
])
def test_detect_schema(spark, keys, schema, template):
    df = spark.createDataFrame([(keys,)], "k array<string>")
    r = df.select(C.detect_schema(F.col("k")).alias("s"), "k").select(
        "s", C.prompt_template(F.col("s"), F.col("k")).alias("t")).first()
    assert (r.s, r.t) == (schema, template)


def test_catalog_over_files(spark):
    root = tempfile.mkdtemp(prefix="passkit-cat-")
    for name, obj in {"a.jsonl": {"prompt": "p", "entry_point": "f", "canonical_solution": ""},
                      "b.json": {"q_tests": [], "prompt": "p"}, "c.data": {"prompt": "p"}}.items():
        os.makedirs(os.path.join(root, name))
        _write(os.path.join(root, name, "part-0"), json.dumps(obj) + "\n")
    os.makedirs(os.path.join(root, "d.data"))
    _write(os.path.join(root, "d.data", "part-0"), "not json\n")
    os.makedirs(os.path.join(root, "e.json"))  # a pretty-printed document: keys come from its first record
    _write(os.path.join(root, "e.json", "part-0"), json.dumps(
        [{"prompt": "p", "entry_point": "f", "test_setup_code": ""}, {"prompt": "q"}], indent=2))
    got = {r.dataset: (r.format, r.schema, r.prompt_template) for r in C.catalog(spark, root).collect()}
    assert got == {"a.jsonl": ("jsonl", "humaneval", "generic"), "b.json": ("json", "q_humaneval", "q_humaneval"),
                   "c.data": ("jsonl", "generic", "generic"), "d.data": ("jsonl", "generic", "generic"),
                   "e.json": ("json", "mbpp", "generic")}


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "pass_at_1" in df.columns
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 70


def test_dataset_registry(spark):
    d = tempfile.mkdtemp(prefix="passkit-reg-")
    p = _write(os.path.join(d, "mine.jsonl"), json.dumps({"task_id": "a", "prompt": "x", "q_tests": [], "tests": "t"}) + "\n")
    reg = C.DatasetRegistry(spark)
    cfg = reg.register("mine", p)
    assert (cfg["schema"], cfg["prompt_template"], cfg["format"]) == ("q_humaneval", "q_humaneval", "jsonl")
    got = {r.name: r.description for r in reg.listing().collect()}
    assert got == {"mine": "q -> python (q_humaneval)"}
    assert spark.sql("SELECT task_id FROM mine").first().task_id == "a"
    with pytest.raises(ValueError):
        reg.get("nope")


def test_solution_default_ids(spark):
    d = tempfile.mkdtemp(prefix="passkit-src-")
    p = _write(os.path.join(d, "s.jsonl"), "\n".join(json.dumps(o) for o in [
        {"task_id": "a", "completion": "x"}, {"completion": "y", "sample_index": 3}, {"task_id": "b"}]) + "\n")
    rows = sorted((r.task_id, r.sample_index, r.completion) for r in J.read_solutions(spark, p, default_ids=True).collect())
    assert rows == [("a", 0, "x"), ("b", 0, None), ("task_1", 3, "y")]
    assert J.read_solutions(spark, p, default_ids=False).where("task_id IS NULL").count() == 1


def test_registry_json_document(spark):
    d = tempfile.mkdtemp(prefix="passkit-reg-")
    p = _write(os.path.join(d, "doc.json"), json.dumps(
        [{"task_id": "a", "prompt": "x", "entry_point": "f", "canonical_solution": ""}], indent=2))
    cfg = C.DatasetRegistry(spark).register("doc", p)
    assert (cfg["format"], cfg["schema"]) == ("json", "humaneval")
    assert spark.sql("SELECT task_id FROM doc").first().task_id == "a"


def test_positions_follow_file_names_not_sizes(spark):
    d = tempfile.mkdtemp(prefix="passkit-src-")
    small = [{"prompt": "a"}, {"prompt": "b"}]
    big = [{"prompt": "c" * 1000}] * 500
    for name, rows in (("part-00000.json", small), ("part-00001.json", big), ("part-00002.json", small)):
        _write(os.path.join(d, name), "\n".join(map(json.dumps, rows)) + "\n")
    rows = {r.pos: r.prompt[0] for r in J.read_problems(spark, d).collect()}
    assert rows == {i: "ab"[i] for i in range(2)} | {i: "c" for i in range(2, 502)} | {502: "a", 503: "b"}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 40_000)  # the big file in many splits, several files in one
    try:
        assert {r.pos: r.prompt[0] for r in J.read_problems(spark, d).collect()} == rows
        sol = [r.task_id for r in J.read_solutions(spark, d).collect()]
        assert sorted(sol) == sorted(f"task_{i}" for i in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_read_summary_forms(spark):
    from pyspark.sql import types as T
    schema = T.StructType.fromDDL("model_name string, total_solutions bigint, results array<struct<task_id:string,passed:boolean>>")
    doc = {"model_name": "m", "total_solutions": 2, "results": [{"task_id": "t", "passed": True}, {"task_id": "u", "passed": False}]}
    d = tempfile.mkdtemp(prefix="passkit-src-")
    _write(os.path.join(d, "a.json"), json.dumps(doc, indent=2))                       # one indented document
    _write(os.path.join(d, "b.json"), json.dumps(doc) + "\n" + json.dumps(doc) + "\n")  # one per line
    _write(os.path.join(d, "c.json"), "{broken\nfile")
    rows = J.read_summary(spark, d, schema).collect()
    assert [(r.model_name, r.total_solutions, [x.passed for x in r.results]) for r in rows] == [("m", 2, [True, False])] * 3
    assert J.read_summary(spark, os.path.join(d, "a.json"), schema).count() == 1
    assert J.read_summary(spark, os.path.join(d, "c.json"), schema).count() == 0


def test_catalog_of_plain_files(spark):
    d = tempfile.mkdtemp(prefix="passkit-src-")
    for name, keys in (("x.jsonl", ["prompt", "entry_point", "canonical_solution"]), ("y.jsonl", ["q_tests"]), ("z.data", ["prompt"])):
        _write(os.path.join(d, name), json.dumps(dict.fromkeys(keys, "v")) + "\n")
    os.makedirs(os.path.join(d, "sub", "x.jsonl"))
    _write(os.path.join(d, "sub", "x.jsonl", "part-00000.json"), json.dumps({"q_tests": [], "test_setup_code": ""}) + "\n")
    got = sorted((r.dataset, r.schema, r.format) for r in C.catalog(spark, d).collect())
    assert got == [("x.jsonl", "humaneval", "jsonl"), ("x.jsonl", "q_mbpp", "jsonl"), ("y.jsonl", "q_humaneval", "jsonl"), ("z.data", "generic", "jsonl")]
