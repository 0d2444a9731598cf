"""Merkle manifest, conversation repair and source mixing, each against a plain version of its rule."""
import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from passkit.llm import conversations as C
from passkit.llm import merkle, mixing
from passkit.llm.base import ship

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# -- manifest ------------------------------------------------------------------------

def plain_manifest(rows):
    """(id, leaf, subroot, root, proof, folded) by levels of Python lists."""
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        proofs, cur, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
        while len(cur) > 1:
            for j, k in enumerate(at):
                proofs[j].append((cur[k ^ 1] if k ^ 1 < len(cur) else "", k & 1))
            at = [k // 2 for k in at]
            cur = [sha("".join(cur[k:k + 2])) for k in range(0, len(cur), 2)]
        return cur[0], proofs

    groups = defaultdict(list)
    for row in rows:
        d, s, g, n, t = row
        shown = (d, s, g, n if n is None or d is None or zlib.crc32(str(d).encode()) % 7 else n + 1, t)
        groups[g].append((d is not None, d or 0, sha("".join(map(enc, row))), sha("".join(map(enc, shown))), d))
    if not rows:
        return []
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, upper = tree([inner[g][0] for g in order])
    out = []
    for g, up in zip(order, upper):
        for (_, _, leaf, shown, d), low in zip(sorted(groups[g], key=lambda x: x[:3]), inner[g][1]):
            h = shown
            for s, left in low + up:
                h = sha(s + h if left else h + s)
            out.append((d, leaf, inner[g][0], root, "".join(s for s, _ in low + up), h))
    return out


@pytest.mark.parametrize("n, levels, langs", [(0, 2, ["en"]), (1, 2, ["en"]), (9, 1, ["en"]), (150, 2, ["en", "en", "fr", None, "Z", "é", "de"])])
def test_manifest_equals_plain_tree(spark, n, levels, langs):
    rnd = random.Random(n)
    rows = [(i if rnd.random() < 0.95 else None, rnd.choice(["a", None]), rnd.choice(langs), rnd.choice([None, i]),
             rnd.choice([None, "", "x" * i, "héé"])) for i in range(n)]
    rows += rows[:2]  # repeated rows are leaves of their own
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int, node string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    shown = merkle.digest([F.col(c) + F.when(hit, 1).otherwise(0) if c == "n_chars" else F.col(c) for c in FIELDS])
    got = merkle.manifest(df, FIELDS, shown=shown, levels=levels, range_rows=40).select("doc_id", "leaf", "subroot", "root", "proof", "folded").collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_block_size_does_not_matter(spark):
    df = spark.createDataFrame([(i, "s", "en" if i % 9 else "fr", i, "t" * (i % 5)) for i in range(70)], "doc_id long, source string, lang string, n_chars long, text string")
    one, two = ({tuple(r) for r in merkle.manifest(df, FIELDS, levels=k, range_rows=r).collect()} for k, r in ((8, 1000), (1, 10)))
    assert one == two and len(one) == 70


# -- conversations -------------------------------------------------------------------

def plain_repair(rows):
    """Cheapest edits by a best-first search over (cost, audit)."""
    seen, fault = set(), []
    for _, r, x in rows:
        s = x.strip(" \t\n\x0b\x0c\r")
        fault.append("b" if not s else "d" if (r, x) in seen else "t" if s[-1] not in ".!?" else "")
        seen.add((r, x))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return (gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, sha("\n".join(f"{r}:{x}" for r, x in out)))
        to = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[to]
        heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*out, (name, ""))))
        if i < len(rows):
            _, r, x = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if fault[i] not in ("b", "d"):
                more = 5 * (fault[i] == "t")
                if r[:1] == to or r[:1] == "s" and not state:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, r[:1], (*out, (r, x))))
                heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, to, (*out, (name, x))))


def plain_damage(rows):
    out = {}
    for c, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        got = out.setdefault(c, [])
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        got += [] if lot == 0 else [(turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in out.items()}


CONVERSATION = "conv_id long, turn long, role string, text string, id string, kind int, audit string"


def test_repair_equals_search(spark):
    rnd = random.Random(5)
    rows = [(c, None if rnd.random() < 0.03 and not t else t * 2 if rnd.random() < 0.1 else t, rnd.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]),
             rnd.choice(["Hi.", "Hi.", "Yes?", "no end", "", " \n\u000b", None, "A! ", "b.\t", "é…", "x. y"]), "x", 1, "y")
            for c in [None, *range(400)] for t in range(rnd.choice([1, 2, 3, 5, 9]))]
    single = Counter((r[0], r[1]) for r in rows)
    rows = [r for r in rows if single[r[0], r[1]] == 1]  # no ties here
    rows += [r for r in rows if r[0] == 7]  # repeated rows are neighbours
    got = {r["conv_id"]: tuple(r)[1:] for r in C.repair(C.damage(spark.createDataFrame(rows, CONVERSATION))).collect()}
    assert got == {c: plain_repair(r) for c, r in plain_damage(rows).items()}


def test_repaired_turns_and_empty_tables(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "More."), (1, 2, "assistant", "Ok."), (2, 0, "system", "S."), (3, 0, "user", " ")]
    df = spark.createDataFrame([(*r, False) for r in rows], "conv_id long, turn long, role string, text string, dropped boolean")
    found = C.audits(df)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in found.collect()} == {1: (2, "DKK"), 2: (2, "D"), 3: (2, "D")}
    assert sorted(tuple(r) for r in C.repaired(df, found).collect()) == [(1, 1, "user", "More."), (1, 2, "assistant", "Ok.")]
    assert C.repair(C.damage(spark.createDataFrame([], CONVERSATION))).collect() == []


def test_runs_equal_single_turns():
    rnd = random.Random(2)
    for _ in range(300):
        symbols = [rnd.randrange(9) for _ in range(rnd.randrange(1, 6))]
        lengths = [rnd.randrange(1, 40) for _ in symbols]
        flat = bytes(s for s, n in zip(symbols, lengths) for _ in range(n))
        whole = C._solve(flat, [1] * len(flat))
        assert C._solve(bytes(symbols), lengths) == whole
        old, C.HALVED = C.HALVED, 3
        try:
            assert C._solve(bytes(symbols), lengths) == whole
        finally:
            C.HALVED = old
    cost, audit = C._solve(bytes([2]), [100_001])  # one long run of clean user turns
    assert cost == C.before(2, 100_001, C.TO_GO)[0] and len(audit.replace("I", "")) == 100_001


# -- mixing --------------------------------------------------------------------------

def test_hypergeometric_has_its_distribution(spark):
    rng = np.random.default_rng(0)
    for total, marked, drawn in ((50, 20, 10), (1000, 300, 500), (10, 10, 3), (10, 0, 3), (7, 3, 7), (1, 1, 0)):
        args = [F.lit(x).cast("long") for x in (total, marked, drawn)]
        x = spark.range(8000).select(mixing.hypergeometric(*args, mixing._uniform(F.lit(1), "id")).alias("x")).toPandas().x.to_numpy()
        y = rng.hypergeometric(marked, total - marked, drawn, 200_000)
        assert x.min() >= max(0, drawn + marked - total) and x.max() <= min(drawn, marked)
        assert abs(x.mean() - y.mean()) < 5 * max(y.std(), 0) / 8000 ** 0.5 + 1e-9
        top = max(y.max(), x.max()) + 1
        assert np.abs(np.bincount(x, minlength=top) / 8000 - np.bincount(y, minlength=top) / 200_000).max() < 0.025


def test_tree_meets_quotas_and_shard_sizes(spark):
    quotas = [700, 0, 13, 250, 1]
    q = spark.createDataFrame(list(enumerate(quotas)), "number long, quota long")
    got = mixing.split_quotas(q, 11, sum(quotas)).collect()
    assert [sum(r["n"] for r in got if r["number"] == k) for k in range(5)] == quotas
    assert {sum(r["n"] for r in got if r["shard"] == s) for s in range(11)} <= {964 // 11, 964 // 11 + 1}
    assert got == mixing.split_quotas(q, 11, sum(quotas)).collect()


def plain_targets(sizes):
    """By rounds of exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    out, left = {}, Fraction(sum(sizes.values()))
    while True:
        rest = [s for s in names if s not in out]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        full = [s for s in rest if share[s] > 3 * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = Fraction(3 * sizes[s])
            left -= 3 * sizes[s]


def test_mix_of_a_small_table(spark):
    rnd = random.Random(3)
    names = ["b", "a", None, "é", "Z", "tiny", "blank", "c"]
    size = {"tiny": 3, "blank": 0}
    rows = []
    for i in range(300):
        s = rnd.choice(["b"] * 6 + names)
        n = size.get(s, rnd.choice([0, 1, 5, 40, 900]))
        rows.append((i if i % 50 else None, s, None if n == 0 and i % 2 else " ".join(f"w{i}_{k}" for k in range(n)) + rnd.choice(["", " ", "\n\t"]), 4, "k"))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int, key string")
    m = mixing.mix(df, block_words=64, shard_blocks=100, range_rows=100)
    docs = m.taken().collect()
    assert Counter(r["id"] for r in docs) == Counter(r[0] for r in rows)
    sizes, taken = Counter(), Counter()
    for r in docs:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = plain_targets(dict(sizes))
    for r in docs:
        assert r["target"] == pytest.approx(float(want[r["source"]])) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= 64 + 0.01 * float(want[s]) for s in want)
    assert sum(want.values()) == sum(sizes.values())
    spans = m.spans.collect()
    copies = defaultdict(list)
    for s in spans:
        copies[s["source"], s["key"], s["copy"]].append((s["first"], s["n"]))
    for got in copies.values():  # the stretches of one copy are disjoint
        got.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(got, got[1:]))
    blocks = Counter(shard for shard, _ in {(s["shard"], s["place"]) for s in spans})
    assert set(blocks) == set(range(m.shards)) and max(blocks.values()) - min(blocks.values()) <= 1
    words = {(r[0], w) for r in rows for w in (r[2] or "").split()}
    mixed = m.texts(df).collect()
    assert sum(len(t["text"].split()) for t in mixed) == sum(taken.values())
    assert all((t["id"], w) in words for t in mixed for w in t["text"].split())
    again = mixing.mix(df.repartition(5), block_words=64, shard_blocks=100, range_rows=30)
    assert sorted(map(str, again.taken().collect())) == sorted(map(str, docs))


def test_mix_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    m = mixing.mix(df)
    assert m.taken().collect() == [] and m.spans.collect() == []
    blank = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(blank).taken().collect()] == [(0, 0.0, 0)] * 2
