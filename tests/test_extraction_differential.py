"""Differential test: the Spark fold vs the set-based SQL formulation on adversarial texts."""

import random

import duckdb
import pandas as pd

from oracle import compare
from passkit.functions.extraction import with_extracted
from passkit.plans.extraction_queries import _EXTRACT_SQL, extraction_ctes

FRAGMENTS = ["```q", "```", "", "   ", "// note f:{1}", "f:{", "f:{[x] x}", "  x+1", "}", "}}", "{",
             "call f{x} now", "g:{y}", "plain words here", "   ", "f: no brace", "```python", "\t```q  ",
             "  f:{[a;b] a+b}  ", "}{f", "ff:{2}", "x:{", "  {nested}", "　f:{3}　", "```q "]


def _texts(n=400, seed=11):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lines = [rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 9))]
        out.append(("m", str(i % 7), i, "\n".join(lines), "f"))
    return out


def test_fold_equals_set_based_sql(spark):
    rows = _texts()
    sdf = spark.createDataFrame(rows, "model_name string, task_id string, sample_index int, t string, name string")
    got = with_extracted(sdf, "t", "name").select("model_name", "task_id", "sample_index", "code", "path").toPandas()
    con = duckdb.connect()
    con.register("src_rows", pd.DataFrame(rows, columns=["model_name", "task_id", "sample_index", "t", "name"]))
    src = "src AS (SELECT model_name, task_id, CAST(sample_index AS INTEGER) AS sample_index, t, name FROM src_rows)"
    sql = "WITH " + ",\n".join(extraction_ctes(src)) + "\n" + _EXTRACT_SQL
    want = con.execute(sql).df()
    assert compare(got, want) is None
