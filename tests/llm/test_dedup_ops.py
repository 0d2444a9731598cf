"""Line templates, SimHash and passage removal against brute force, and on odd rows."""
import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from passkit.llm import components, debruijn, line_templates, queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "alpha beta"), (4, "alpha beta"), (4, "alpha beta"), (5, "x" * 50_000)]


# -- SimHash ---------------------------------------------------------------
def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i:i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fp, radius=4):
    ids = sorted(fp)
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if bin(fp[i] ^ fp[j]).count("1") <= radius:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in ids}


def test_simhash_query_equals_brute_force(spark, texts001):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op8_simhash_bktree"](spark, "/root/testdata/sf0.001").collect()}
    fp = {i: brute_fingerprint(t) for i, t in texts001}
    root = brute_components(fp)
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in fp}


def test_simhash_odd_rows(make_docs):
    rows = simhash.near_duplicates(make_docs(ODD)).collect()
    assert len(rows) == len(ODD)
    by = collections.defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add((r["fingerprint"], r["component_id"]))
    assert by[1] == by[2] == by[3] == {("0" * 16, 1)}  # without words: linked like any other
    assert {c for _, c in by[None] | by[4]} == {4}     # a null id names no component
    assert simhash.near_duplicates(make_docs([])).count() == 0
    assert {r["component_id"] for r in simhash.near_duplicates(make_docs([(None, "a b"), (None, "a b")])).collect()} == {None}


def test_simhash_keep_one(make_docs):
    docs = make_docs(ODD)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, None), (None, "alpha beta"), (5, "x" * 50_000)], key=str)


@pytest.mark.parametrize("tree_max", [64, 8192])
def test_bktree_links_connect_all_pairs_within_the_radius(spark, monkeypatch, tree_max):
    monkeypatch.setattr(simhash, "TREE_MAX", tree_max)  # 64: the hot shard is cut into several trees
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(0, 6))) for _ in range(600)} | {rng.getrandbits(64) for _ in range(400)}
    fps = sorted(int(np.uint64(x).astype(np.int64)) for x in fps)
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp bigint"))
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    want = brute_components({x: x & (2 ** 64 - 1) for x in fps})
    groups = collections.defaultdict(set)
    for x in fps:
        groups[want[x]].add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1001)], "a bigint, b bigint").repartition(7)
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- passages ----------------------------------------------------------------
def brute_removal(docs, k=35):
    docs = [(i, WORD.findall(t or "")) for i, t in docs]
    seen = collections.Counter(tuple(w[a:a + k]) for _, w in docs for a in range(len(w) - k + 1))
    out = []
    for i, w in docs:
        gone = {x for a in range(len(w) - k + 1) if seen[tuple(w[a:a + k])] > 1 for x in range(a, a + k)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def removal(df, k=35, m=10):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in debruijn.remove_repeats(df, k=k, m=m).collect()), key=str)


def test_passage_query_equals_brute_force(spark, texts001):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.QUERIES["op7_debruijn_repeats"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in brute_removal(texts001)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_with_branches_and_loops(make_docs, seed):
    """Two letters only, so that the graph branches and loops everywhere."""
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choice("ab" if i % 3 else "abcdefgh") for _ in range(rng.randrange(0, 120)))) for i in range(40)]
    docs += [(100, docs[1][1]), (100, docs[1][1]), (101, "a " * 60), (102, None), (None, docs[2][1] + "\n" + docs[5][1])]
    assert removal(make_docs(docs), k=6, m=3) == brute_removal(docs, k=6)


def test_passages_odd_rows(make_docs):
    long = " ".join(f"w{i}" for i in range(40))
    docs = [*ODD, (6, long), (7, "start " + long + " end"), (8, long.upper())]
    assert removal(make_docs(docs)) == brute_removal(docs)
    assert removal(make_docs([])) == []


# -- lines ---------------------------------------------------------------------
def test_lines_of_recurring_templates_go_but_for_the_first(make_docs):
    rows = [(i, f"Page {i} of 9\nown {'abcdefgh'[i]} text {'abcdefgh'[i]} here\n\nshared by all") for i in range(4)]
    got = {r["doc_id"]: (r["text"], r["_n_lines"], r["_n_dropped"]) for r in line_templates.dedup(make_docs(rows)).collect()}
    assert got[0] == (rows[0][1], 4, 0)
    for i in range(1, 4):
        assert got[i] == (f"own {'abcdefgh'[i]} text {'abcdefgh'[i]} here\n", 4, 2)


def test_lines_learn_variable_fields(make_docs):
    """The sixth token differs in every document; five of six tokens are constant."""
    rows = [(i, f"opened by the same user {name}") for i, name in enumerate(["ann", "bob", "cat", "dan"])]
    assert [r["text"] for r in line_templates.dedup(make_docs(rows)).orderBy("doc_id").collect()] == [rows[0][1], "", "", ""]
    two = [(i, f"opened by {name} {name} user {name}") for i, name in enumerate(["ann", "bob", "cat", "dan"])]  # three of six
    assert all(r["_n_dropped"] == 0 for r in line_templates.dedup(make_docs(two)).collect())


def test_lines_odd_rows(make_docs):
    docs = make_docs([*ODD, (9, "alpha beta\r\n alpha   beta")])
    out = line_templates.dedup(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"]
    got = sorted(((r["doc_id"], r["text"], r["_n_dropped"]) for r in out.collect()), key=str)
    want = [(1, None, 0), (2, "", 0), (3, " \n\t ", 0), (None, "alpha beta", 0), (4, "", 1), (4, "", 1), (5, "x" * 50_000, 0), (9, "", 2)]
    assert got == sorted(want, key=str)
    assert line_templates.dedup(make_docs([])).count() == 0


def brute_templates(rows, min_docs=3):
    """Line numbers dropped per document, with every leaf's places counted over all its lines one after the other."""
    lines = [(i, k, tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(x))) for i, t in rows for k, x in enumerate(t.split("\n"))]
    per = {(i, w) for i, _, w in lines if len(w) >= 5}
    docs = collections.Counter((len(w), w[:2], p, x) for _, w in per for p, x in enumerate(w))
    name = {}
    for w in {w for _, w in per}:
        n = [docs[len(w), w[:2], p, x] for p, x in enumerate(w)]
        part = sorted(n, reverse=True)[-(-4 * len(w) // 5) - 1]
        if part >= min_docs:
            name[w] = tuple(x if m >= min_docs and 10 * m >= part else "<*>" for x, m in zip(w, n))
    held = collections.defaultdict(list)
    for i, k, w in lines:
        if w:
            held[name.get(w, w)].append((i, k))
    gone = {x for xs in held.values() if len({i for i, _ in xs}) >= min_docs for x in xs if x != min(xs)}
    return {i: sum(x[0] == i for x in gone) for i, _ in rows}


@pytest.mark.parametrize("n", [100, 1000, 3000])
def test_fields_whose_values_recur_stay_variable(make_docs, n):
    """Two word fields of 60 values among 13 tokens, beside a second template of the same leaf and lines of no template."""
    rng = random.Random(n)
    word = lambda k, v="v": v + "abcdefghijklmnopqrstuvwxyz"[k % 26] + "abcdefghijklmnopqrstuvwxyz"[k // 26]
    rows = [(i, f"this account of {word(rng.randrange(60))} was opened in {word(rng.randrange(60))} by the same user again") for i in range(n)]
    rows += [(n + i, f"this account of ours will never be opened by {word(i % 60)} or by anyone") for i in range(n // 5)]
    rows += [(2 * n + i, " ".join(["this", "account", *(word(rng.randrange(60), "x") for _ in range(11))])) for i in range(30)]
    got = {r["doc_id"]: r["_n_dropped"] for r in line_templates.dedup(make_docs(rows)).select("doc_id", "_n_dropped").collect()}
    assert got == brute_templates(rows)
    assert sum(got[i] for i in range(n)) == n - 1 and sum(got[n + i] for i in range(n // 5)) == n // 5 - 1
    assert not any(got[2 * n + i] for i in range(30))


def many_leaves(n):
    """Lines of 40 leaves, with one field of many values each, beside lines that share only a leaf and repeated lines."""
    rng = random.Random(n)
    word = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    rows = []
    for i in range(n):
        leaf = rng.randrange(40)
        start = f"leaf {word(leaf)}"
        lines = [f"{start} holds the line of {word(rng.randrange(300))} as it was" if leaf % 2 else
                 f"{start} " + " ".join(word(rng.randrange(300)) for _ in range(leaf % 5 + 5))]
        lines += [f"{start} holds  item {i} of {word(i % 7)} and no more"] * (i % 3)
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize(("tokens", "share", "rows"), [(10**9, 1.0, 0), (0, 0.0, 10**6), (0, 0.0, 0), (150, 1.0, 10**6)])
def test_leaves_counted_in_one_task_or_by_place(make_docs, monkeypatch, tokens, share, rows):
    """no leaf, all leaves (common tokens broadcast or not) and some leaves are counted by place."""
    monkeypatch.setattr(line_templates, "LEAF_TOKENS", tokens)
    monkeypatch.setattr(line_templates, "LEAF_SHARE", share)
    monkeypatch.setattr(line_templates, "COMMON_ROWS", rows)
    docs = many_leaves(400)
    got = {r["doc_id"]: r["_n_dropped"] for r in line_templates.dedup(make_docs(docs)).select("doc_id", "_n_dropped").collect()}
    assert got == brute_templates(docs)
    assert sum(got.values()) > 200


def test_leaf_tokens_stay_with_their_lines(make_docs, capsys):
    """the lines of a leaf are exchanged, not each of their tokens."""
    lines = line_templates._with_hash(line_templates._with_leaf(line_templates.lines_of(make_docs(many_leaves(60)), "doc_id", "text")))
    line_templates.templates(lines.withColumn("line", F.array_join("toks", " ")).drop("toks"), 3).explain()
    plan = capsys.readouterr().out
    assert re.search(r"hashpartitioning\(leaf#\d+L?, \d+\)", plan)
    assert not re.search(r"hashpartitioning\([^)]*\btok#", plan)
