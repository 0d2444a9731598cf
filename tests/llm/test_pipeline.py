"""The corpus pipeline, stage by stage, on each stage's own input."""
import duckdb
import pandas as pd
import sentencepiece

import corpus_pipeline as cp
from passkit.llm import base, decontaminate, queries, simhash

SF001 = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    docs, seen = base.documents(spark, SF001), {}
    for name, stage in cp.STAGES:
        docs = base.stored(stage(spark, docs, SF001), name)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == cp.COLUMNS
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    # filtered here: a filter on the query would be pushed into its rules and copy them
    kept = {r["doc_id"] for r in queries.QUERIES["op3_quality_rules"](spark, SF001).select("doc_id", "kept").collect() if r["kept"]}
    assert set(seen["quality_rules"]) == kept
    assert set(seen["line_dedup"]) == kept and all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"].values())
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r.asDict() for r in seen["quality_rules"].values()]))
    lines = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, text FROM ({queries.OP1_SQL})").fetchall()}
    assert {i: r["text"] for i, r in seen["line_dedup"].items()} == lines
    fp = {i: simhash.fingerprint(r["text"]) for i, r in seen["line_dedup"].items()}
    left = seen["simhash_near_dedup"]
    assert all(any(bin(fp[i] ^ fp[j]).count("1") <= 4 for j in fp if j < i) for i in set(fp) - set(left))
    assert not any(bin(fp[i] ^ fp[j]).count("1") <= 4 for i in left for j in left if j < i)
    items = [r["text"] for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    clean = seen["benchmark_decontamination"]
    holds = lambda t: any(" ".join(decontaminate.tokens(x)) in " ".join(decontaminate.tokens(t)) for x in items)
    assert set(clean) == {i for i, r in left.items() if not holds(r["text"])}
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    assert {i: list(r["ids"]) for i, r in seen["sentencepiece"].items()} == {i: lib.encode(r["text"]) for i, r in clean.items()}
