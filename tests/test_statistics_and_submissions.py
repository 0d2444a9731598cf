"""Heavy-key joins, range prefix sums, sketches, bootstrap intervals, submission rules, profile documents."""
import json
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from passkit.functions import prompts as PT
from passkit.operators import evaluate as E
from passkit.operators import ordering as O
from passkit.operators import quantiles as QT
from passkit.operators import scoring as S
from passkit.sources import jsonl as J
from passkit.sources import profiles as PR


def test_ranges_bound_rows_on_timestamps_and_ties(spark):
    """Rows a second apart, one hot key, one value with many ties, nulls: as a plain window, with a bounded number of ranges."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
        F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 4 == 0, F.timestamp_seconds(F.lit(1_700_000_000))).otherwise(
            F.timestamp_seconds(F.col("id") + 1_700_000_000)).alias("t"), "id", (F.col("id") % 7).alias("v"))
    held = O.ranged(rows, ["k", "t", "id"], rows=1000).groupBy("_range").count().toPandas()
    assert held["count"].sum() == 20_000 and 15 <= len(held) <= 20 and held["count"].max() <= 2500
    got = O.ranged_sums(rows, ["k"], ["t", "id"], {"s": F.col("v"), "n": F.lit(1)}, rows=1000)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumns({"s": F.sum("v").over(w), "n": F.sum(F.lit(1)).over(w)})
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    same = spark.range(3000).select(F.lit("x").alias("k"), F.lit(1).alias("t"))  # equal rows are dealt over ranges
    assert O.ranged(same, ["k", "t"], rows=500).groupBy("_range").count().count() > 1
    assert sorted(r["i"] for r in O.ranged_index(same, ["k"], ["t"], "i", rows=500).collect()) == list(range(3000))
    assert O.ranged_index(same.limit(0), ["k"], ["t"], "i").collect() == []


def test_heavy_join_equals_plain_join_and_splits_the_key(spark):
    sol = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("t"), F.col("id") % 900)).alias("task_id"), F.col("id").alias("sample_index"))
    prob = spark.createDataFrame([("hot", "f")] + [(f"t{k}", f"f{k}") for k in range(700)], "task_id string, entry_point string")
    heavy = E.heavy_keys(sol, ["task_id"], 0.05)
    assert len(heavy) == 1 and abs(next(iter(heavy.values())) - 1 / 3) < 0.02
    got = E.attach_problem(sol, prob, heavy_share=0.05)
    want = E.attach_problem(sol, prob)
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == 30_000
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("-1", "false", "16")):
            spark.conf.set(k, v)
        part = lambda df: df.where("task_id = 'hot'").groupBy(F.spark_partition_id()).count().count()
        assert part(E.attach_problem(sol, prob)) == 1
        assert part(E.attach_problem(sol, prob, heavy_share=0.05)) > 3
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert E.heavy_keys(sol.limit(0), ["task_id"]) == {}


def test_sketches_merge_to_near_percentiles(spark):
    df = spark.range(60_000).select((F.col("id") % 2).alias("m"), (F.col("id") % 30).alias("day"), F.when(F.col("id") % 10 == 3, F.lit(None)).otherwise(
        F.sqrt(F.col("id") * 7919 % 60_013)).alias("v"))
    daily = QT.quantile_sketches(df, ["m", "day"], "v")
    got = QT.sketched_percentiles(daily.where("day < 20"), ["m"], [0.0, 0.1, 0.5, 0.99, 1.0]).toPandas()
    data = df.where("day < 20 AND v IS NOT NULL").toPandas()
    for r in got.itertuples():
        v = data[data.m == r.m].v.to_numpy()
        assert r.n == len(v) and (v < r.value).mean() <= r.p + 0.01 and (v <= r.value).mean() >= r.p - 0.01
    assert QT.quantile_sketches(df.where("v IS NULL"), ["m"], "v").collect() == []


def test_bootstrap_covers_and_repeats(spark):
    rnd = random.Random(1)
    rows = [("m", f"t{k}", 10, rnd.randrange(11)) for k in range(120)] + [("one", "t", 5, 2)]
    df = spark.createDataFrame(rows, "model string, task_id string, num_samples long, num_correct long")
    got = {r["model"]: r for r in S.pass_at_k_interval(df, ["model"]).collect()}
    p = np.array([r[3] / 10 for r in rows[:-1]])
    m = got["m"]
    assert m["low"] < m["pass_at_k"] < m["high"] and m["pass_at_k"] == pytest.approx(p.mean())
    assert (m["high"] - m["low"]) == pytest.approx(2 * 1.96 * p.std() / 120 ** 0.5, rel=0.35)
    assert got["one"]["low"] == pytest.approx(0.4) and got["one"]["high"] == pytest.approx(0.4)
    again = {r["model"]: r for r in S.pass_at_k_interval(df.repartition(7).orderBy(F.rand(3)), ["model"]).collect()}
    assert again["m"]["low"] == pytest.approx(m["low"], abs=1e-12)


CARD = "# The Model\n\n**Provider**: Org\n**Version**: v1.0\n**Parameters**: 7B\n**License**: MIT\n\n## Evaluation Details\n- **Dataset**: q-humaneval\n" \
       "- **Samples**: 50 per problem\n- **Date**: 2025-01-31\n- **Hardware**: 8 GPUs\n\n## Results Summary\n- **Pass@1**: 7.01%\n- **Pass@5**: 15.5%\n- **Pass@10**: 20%\n"


@pytest.mark.parametrize("change, reasons", [
    (lambda c: c, ""), (lambda c: c + "\n**Provider**: again\n", ""),
    *[(lambda c, f=f: "\n".join(x for x in c.split("\n") if f"**{f}**" not in x), f"missing {f}") for f in S.CARD_FIELDS],
    (lambda c: c.replace("2025-01-31", "January"), "no date"), (lambda c: c.replace("15.5%", "15.5"), "Pass@5 is no percentage"),
    (lambda c: c.replace("MIT", " "), "missing License"), (lambda c: c.replace("50 per", "500 per"), "samples stated differently")])
def test_each_card_rule_rejects_its_breach(spark, tmp_path, change, reasons):
    (tmp_path / "card.md").write_text(change(CARD))
    cards = S.read_cards(spark, str(tmp_path / "card.md")).withColumn("submission", F.lit("a"))
    good = spark.createDataFrame([("a", 1, 50, 0)], "submission string, models long, min_samples long, bad_lines long")
    r = S.submission_report(cards, good).first()
    assert (r["accepted"], r["reasons"]) == (not reasons, reasons) and cards.first()["title"] == "The Model"


def test_result_files_of_a_submission(spark, tmp_path):
    line = lambda m, t, i: json.dumps({"model_name": m, "task_id": t, "sample_index": i}) + "\n"
    (tmp_path / "good.jsonl").write_text("".join(line("m", f"t{i % 3}", i) for i in range(150)))
    (tmp_path / "two.jsonl").write_text("".join(line("m" if i else "n", "t", i) for i in range(60)) + "\n")
    (tmp_path / "bad.jsonl").write_text("".join(line("m", "t", i) for i in range(60)) + "{oops\n[1]\n")
    got = {r["file"].rsplit("/", 1)[1]: (r["models"], r["min_samples"], r["bad_lines"]) for r in S.read_submitted(spark, str(tmp_path)).collect()}
    assert got == {"good.jsonl": (1, 50, 0), "two.jsonl": (2, 1, 0), "bad.jsonl": (1, 60, 2)}
    cards = spark.createDataFrame([("x", {"Samples": "1"})], "submission string, fields map<string,string>")
    none = S.submission_report(cards, spark.createDataFrame([], "submission string, models long, min_samples long, bad_lines long")).first()
    assert not none["accepted"] and "not one model" in none["reasons"]


def test_profile_documents_of_several_versions(spark, tmp_path):
    one = {"model_name": "a", "configurations": [{"batch_size": 4, "max_tokens": 256, "tensor_parallel_size": 2, "metrics": {"tokens_per_second": 7, "memory_used_gb": 1.5}},
                                                 {"batch_size": 8, "error": "oom", "metrics": {}}]}
    two = {"version": 2, "model": "b", "trials": [{"batch_size": "16", "tokens_per_second": 3.25, "memory_used_gb": "high"}]}
    (tmp_path / "one.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "two.json").write_text(json.dumps(two) + "\n" + json.dumps({"model": "c"}) + "\nnot json\n")
    docs = PR.documents(spark, str(tmp_path))
    assert sorted(r["broken"] for r in docs.collect() if r["broken"]) == ["not json"]
    got = sorted(((r["model"], r["place"], r["batch_size"], r["tokens_per_second"], r["memory_used_gb"], r["error"]) for r in PR.trials(docs).collect()), key=str)
    assert got == [("a", 0, 4, 7.0, 1.5, None), ("a", 1, 8, None, None, "oom"), ("b", 0, 16, 3.25, None, None)]


def test_indented_summaries_and_rows_rendered_by_schema(spark, tmp_path):
    pp = spark.createDataFrame([("m", "t1", 3, 1), ("n", "t1", 2, 2)], "model_name string, task_id string, num_samples long, num_correct long")
    docs = J.summary_documents(S.summary(pp, ["model_name"]), pp, indented=True)
    text = docs.where("model_name = 'm'").first()["document"]
    assert text.count("\n") > 5 and json.loads(text)["per_problem_results"][0]["num_correct"] == 1
    J.write_summary_files(docs, str(tmp_path / "s"))
    schema = spark.createDataFrame([], "model_name string, total_solutions long").schema
    assert sorted(tuple(r) for r in J.read_summary(spark, str(tmp_path / "s"), schema).collect()) == [("m", 3), ("n", 2)]
    df = spark.createDataFrame([("generic", "do x", None), ("q_humaneval", "do x", None), ("nope", "p", "f"), (None, "p", "f"), ("humaneval", "do x", "f")],
                               "schema string, prompt string, entry_point string")
    got = [(r["rendered"] is not None, r["error"]) for r in PT.render_by_schema(df, "schema").collect()]
    assert got == [(True, None), (False, "Missing required fields: entry_point"), (False, "Unknown template: nope"), (False, "Unknown template: None"), (True, None)]
    assert {r["schema"]: r["template"] for r in PT.registry(spark).collect()} == PT.SCHEMA_TO_TEMPLATE
