"""Sinks (append, records round trip) and the template registry."""

import pandas as pd
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from passkit.functions import prompts as P
from passkit.plans import views as V
from passkit.sources import jsonl as J
from passkit.streaming.live import dedup_latest


def test_append_adds_files_and_rows_and_dedup_undoes_it(spark):
    """Re-running into the same folder doubles the samples (kept), dedup restores one per key."""
    out = tempfile.mkdtemp(prefix="passkit-sol-") + "/solutions"
    sol = V.completions(spark, SF01).select("task_id", "sample_index", "model_name", "completion",
                                            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("generated_at"))
    n = sol.count()
    J.write_jsonl(sol, out)
    J.write_jsonl(sol, out)
    back = J.read_solutions(spark, out)
    assert back.count() == 2 * n
    assert dedup_latest(back).count() == n


def test_profile_records_round_trip(spark):
    out = tempfile.mkdtemp(prefix="passkit-prof-") + "/trials"
    t = V.trials(spark, SF01)
    J.write_jsonl(t, out, mode="overwrite")
    back = spark.read.schema(t.schema).json(out)
    assert back.exceptAll(t).count() == 0 and t.exceptAll(back).count() == 0


def test_unknown_template_raises():
    with pytest.raises(ValueError, match="Unknown template: nope"):
        P.template("nope")


def test_render_reports_missing_fields(spark):
    df = spark.createDataFrame([("p", None), ("q", "f")], "prompt string, entry_point string")
    rows = P.render(df, "q_humaneval").collect()
    assert rows[0].rendered is None and rows[0].error == "Missing required fields: entry_point"
    assert rows[1].rendered.endswith('q\n"""') and rows[1].error is None
    # the mbpp template reads text and q_test_list: a table without them cannot render
    r = P.render(df, "q_mbpp").first()
    assert r.error == "Missing required fields: text, q_test_list"


def test_template_texts(spark):
    df = spark.createDataFrame([("do x", ["t1", "t2"]), ("a q programmer task", [])], "p string, t array<string>")
    r = df.select(P.render_humaneval(F.col("p")).alias("h"), P.render_mbpp(F.col("p"), F.col("t")).alias("m"),
                  P.render_generic(F.col("p")).alias("g")).collect()
    assert r[0].h == '"""You are an expert q/kdb+ programmer.\nWrite idiomatic q function to complete the following task:\ndo x\n"""'
    assert r[0].m == '"""Complete the following task in q (KDB+) language:\ndo x\n\nt1\n"""'
    assert r[1].m == '"""Complete the following task in q (KDB+) language:\na q programmer task\n\n\n"""'
    assert r[0].g == '"""You are an expert q (KDB+) programmer. Here is your task:\ndo x\n"""\n'
    assert r[1].g == "a q programmer task"


def test_summary_document_keys(spark):
    """Gated-out k are absent from the document (NULL fields are not written)."""
    import json as _json
    from passkit.operators import scoring as S
    pp = V.results_counts(spark, SF01)
    doc = J.summary_documents(S.summary(pp, ["model_name"]), pp, ["model_name"]).first().document
    d = _json.loads(doc)
    assert {"pass_at_1", "pass_at_5", "pass_at_10", "pass_at_20"} <= set(d)
    assert "pass_at_50" not in d and "pass_at_100" not in d
    assert d["total_problems"] == len(d["per_problem_results"]) == 150
    assert d["execution_method"] == "sequential" and d["max_workers"] == 1


def test_generate_execute_score(spark):
    """The three commands end to end on the benchmark problems."""
    from passkit.operators.harness import execute_solutions, generate_solutions, score_results
    problems = V.problems(spark, SF01)
    def generator(b):
        return b[["task_id", "sample_index", "model_name"]].assign(completion="{[x] x+" + b["sample_index"].astype(str) + "}")

    def runner(b):
        ok = b["code"].str.startswith("{")
        return pd.DataFrame({"passed": ok, "info": ok.map({True: "passed", False: "failed"})})

    sol = generate_solutions(problems, "lambda", 3, generator=generator)
    assert sol.count() == 3 * problems.count()
    res = execute_solutions(sol, problems, runner)
    assert res.count() == sol.count()
    pp, summary = score_results(res)
    s = summary.first()
    assert s.total_solutions == sol.count() and s.passed_solutions == sol.count()
    assert s.pass_at_1 == 1.0 and s.pass_at_5 is None  # n = 3 gates out k = 5


def test_live_tally_running_pass_at_k(spark):
    """Running pass@1 per problem written by the stream equals the batch estimate at the end."""
    from passkit.functions.metrics import pass_at_k
    from passkit.plans.streaming_queries import RESULTS_STREAM_SCHEMA, _write_result_files
    from passkit.streaming import live as L
    run = L.new_run_dir(spark, "tally-test")
    src = _write_result_files(spark, SF01, run, rows_per_file=1000)
    sizes = {}
    for files in (1, 4):  # the live table has a row per key, however many micro-batches there were
        q = L.live_tally(L.stream_files(spark, src, RESULTS_STREAM_SCHEMA, files_per_trigger=files), f"{run}/out{files}", f"{run}/ck{files}")
        q.awaitTermination()
        sizes[files] = (q.lastProgress.batchId, L.tally_state(spark, f"{run}/ck{files}").count())
    assert sizes[1][0] > sizes[4][0] and sizes[1][1] == sizes[4][1]
    early = L.tally_state(spark, f"{run}/ck1", batch_id=1).agg(F.sum("num_samples")).first()[0]
    assert 0 < early < V.results(spark, SF01).count()
    final = L.read_tally(spark, f"{run}/out1", f"{run}/ck1", ks=(1,)).withColumnRenamed("pass_at_1", "p").drop("num_samples", "num_correct")
    batch = V.results_counts(spark, SF01).withColumn("q", pass_at_k("num_samples", "num_correct", F.lit(1)))
    diff = final.join(batch, ["model_name", "task_id"]).where(F.abs(F.col("p") - F.col("q")) > 1e-12)
    assert diff.count() == 0 and final.count() == batch.count()


def _files(path, batches):
    """One JSON file per batch, in this order for a stream; rows (task_id, sample_index, passed, generated_at)."""
    import json
    import os
    os.makedirs(path)
    for k, rows in enumerate(batches):
        with open(f"{path}/f{k}.json", "w") as f:
            f.writelines(json.dumps({"model_name": "m", "task_id": t, "sample_index": i, "passed": p, "generated_at": w}) + "\n" for t, i, p, w in rows)
        os.utime(f"{path}/f{k}.json", (1e9 + k, 1e9 + k))
    return path


@pytest.mark.parametrize("name", ["stream_tally", "stream_dedup", "stream_committed_sink"])
def test_micro_batches_do_not_grow_with_the_files(spark, tmp_path, monkeypatch, name):
    import os
    from passkit.plans import streaming_queries as SQ
    from passkit.streaming import live as L
    spark.range(400, numPartitions=1).select(
        F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.when(F.col("id") % 3 == 0, "purchase").otherwise("view").alias("event_type"),
        F.lit(1.0).alias("value"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id)").alias("ts")).write.parquet(str(tmp_path / "events.parquet"))
    write = SQ._write_result_files
    monkeypatch.setattr(SQ, "_write_result_files", lambda s, d, run, copies=1: write(s, d, run, copies, rows_per_file=4))
    monkeypatch.setattr(L, "new_run_dir", lambda s, kind: str(tmp_path / kind))
    rows = getattr(SQ, f"q_{name}")(spark, str(tmp_path)).count()
    assert rows == (7 if name == "stream_tally" else 400)
    run = tmp_path / name.removeprefix("stream_").removeprefix("committed_")
    assert len(list((run / "in").glob("*.json"))) >= 100
    assert 1 < len([x for x in os.listdir(run / "checkpoint" / "commits") if x.isdigit()]) <= 9  # and one without rows


def test_idle_keys_leave_the_state_and_come_back(spark, tmp_path):
    from passkit.plans.streaming_queries import RESULTS_STREAM_SCHEMA
    from passkit.streaming import live as L
    src = _files(str(tmp_path / "in"), [
        [("a", 0, True, "2024-01-01T00:00:00"), ("a", 1, False, None), ("b", 0, True, "1970-01-01T00:00:00"), (None, 0, True, None)],
        [("c", 0, True, "2024-01-03T00:00:00"), ("c", 1, None, "2199-01-03T00:00:00")],
        [("a", 2, True, "2023-01-01T00:00:00")]])  # a comes back
    for idle in ("0 seconds", "1 day", None):
        out, ck = (str(tmp_path / f"{x}-{str(idle)[:1]}") for x in ("out", "ck"))
        L.live_tally(L.stream_files(spark, src, RESULTS_STREAM_SCHEMA, files_per_trigger=1), out, ck, idle=idle).awaitTermination()
        closed = {(r["task_id"], r["num_samples"], r["num_correct"]) for r in spark.read.schema(
            "task_id string, num_samples long, num_correct long").parquet(out).collect()}
        open_keys = {r["task_id"] for r in L.tally_state(spark, ck).collect()}
        if idle == "0 seconds":
            assert {("a", 2, 1), ("b", 1, 1), (None, 1, 1)} <= closed and "b" not in open_keys
        else:
            assert closed == set() and open_keys == {"a", "b", "c", None}
        got = {r["task_id"]: (r["num_samples"], r["num_correct"]) for r in L.read_tally(spark, out, ck).collect()}
        assert got == {"a": (3, 2), "b": (1, 1), "c": (2, 1), None: (1, 1)}


def test_every_late_row_is_counted(spark, tmp_path):
    """A wrong future date makes no row late; a delay that is too short loses rows, and each one is counted."""
    import time as _time
    from passkit.plans.streaming_queries import RESULTS_STREAM_SCHEMA
    from passkit.streaming import live as L
    src = _files(str(tmp_path / "in"), [
        [("a", 0, True, "2024-01-05T00:00:00"), ("a", 1, True, "2150-01-01T00:00:00")],
        [("b", 0, True, "2024-01-05T00:00:01")],
        [("c", i, True, "2024-01-01T00:00:00") for i in range(3)] + [("a", 0, True, "2024-01-05T00:00:00")],
        [("d", 0, True, "2024-01-04T00:00:00")]])
    counts = L.StreamCounts()
    spark.streams.addListener(counts)
    try:
        seen = {}
        table = spark.read.schema(RESULTS_STREAM_SCHEMA).json(src)
        for name, delay in (("long", L.spread(table)), ("short", "1 hour")):
            q = L.stream_dedup(L.stream_files(spark, src, RESULTS_STREAM_SCHEMA, files_per_trigger=1), str(tmp_path / name), str(tmp_path / f"ck-{name}"), delay)
            q.awaitTermination()
            for _ in range(100):  # progress comes in a thread of its own
                if str(q.id) in counts.ended:
                    break
                _time.sleep(0.1)
            seen[name] = counts.of(q), spark.read.parquet(str(tmp_path / name)).count()
        assert seen["long"][0]["read"] == seen["short"][0]["read"] == 8
        assert seen["long"][0]["late"] == 0 and seen["long"][1] == 7  # one repeated sample
        late, kept = seen["short"][0]["late"], seen["short"][1]
        assert late > 0 and kept + late + 1 >= 8 and kept + late <= 8
    finally:
        spark.streams.removeListener(counts)
    days = table.where("generated_at < '2025-01-01'")  # from the first to the fifth
    assert L.spread(days) == f"{5 * 86400 + 1} seconds" and L.spread(days.limit(0)) == "86400 seconds"


def test_read_summary_missing_path_is_empty(spark):
    from passkit.plans.source_queries import _SUMMARY_SCHEMA
    missing = tempfile.mkdtemp(prefix="passkit-none-") + "/does-not-exist"
    df = J.read_summary(spark, missing, _SUMMARY_SCHEMA)
    assert df.count() == 0 and df.schema == _SUMMARY_SCHEMA
