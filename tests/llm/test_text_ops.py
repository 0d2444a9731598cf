"""Quality rules, encoding, language, line CRF, decontamination, archives, licences."""
import gzip
import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from passkit.llm import decontaminate, langid, licenses, quality_crf, quality_rules, queries, sentencepiece_wfst, warc

SF001 = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "alpha beta"), (4, "alpha beta"), (4, "alpha beta"), (5, "x" * 50_000)]


# -- quality rules -----------------------------------------------------------
def brute_repeat_words(words):
    tri = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    return len({i + o for i, t in enumerate(tri) if tri.count(t) > 1 for o in range(3)})


def test_repeat_words_against_brute_force(make_docs):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("abcd"[:1 + i % 4]) for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.ledger(make_docs(docs)).collect()}
    assert got == {i: brute_repeat_words(t.split()) for i, t in docs}


@pytest.mark.parametrize("bits", [24, 4, 60])
def test_repeat_words_on_either_branch(spark, bits):
    """4: more words than places; 60: four bits of hash left, so neighbours with equal bits differ. Both take the exact branch."""
    rng = random.Random(7)
    rows = [([rng.randrange(k) for _ in range(rng.randrange(0, 60))],) for k in (3, 5, 9, 30) for _ in range(15)]
    df = spark.createDataFrame(rows, "h array<bigint>")
    for r in quality_rules.with_repeat_words(df, "h", bits).collect():
        assert r["n_repeat_words"] == brute_repeat_words(list(r["h"]))


def test_quality_rules_odd_rows_and_policies(make_docs):
    rows = quality_rules.apply_policy(quality_rules.ledger(make_docs(ODD)))
    got = sorted(((r["doc_id"], r["n_words"], r["n_lines"], r["kept"]) for r in rows.collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (3, 0, 0, False), (None, 2, 1, False), (4, 2, 1, False), (4, 2, 1, False), (5, 1, 1, False)], key=str)
    assert quality_rules.ledger(make_docs([])).count() == 0
    good = " ".join(f"word{i}" for i in range(60))
    docs = make_docs([(1, good), (2, good + " #" * 30), (3, "few"), (4, good.upper() + "!" * 20)])
    assert quality_rules.keep(docs).columns == docs.columns
    assert [r["doc_id"] for r in quality_rules.keep(docs).collect()] == [1]
    v1 = quality_rules.POLICIES[0]
    assert sorted(r["doc_id"] for r in quality_rules.keep(docs, v1).collect()) == [1, 2, 4]
    abl = {(r["policy"], r["rule"]): (r["n_docs"], r["n_failed"], r["n_regained_without_rule"]) for r in quality_rules.ablations(quality_rules.ledger(docs)).collect()}
    assert abl["v3", "symbols"] == (4, 1, 1) and abl["v3", "few_words"] == (4, 1, 1)


# -- SentencePiece -------------------------------------------------------------
@pytest.fixture(scope="module")
def bpe():
    return sentencepiece_wfst.compile_model(queries.TOKENIZER)


def test_encoding_equals_the_library_on_random_texts(bpe):
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    rng = random.Random(8)
    parts = ["a", "b", "th", "e ", "  ", " ", "\n", "é", "日", "𝄞", "▁", "<0x0A>", "1", "ing", "er", "  \t", "=", "//", "--"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 30)))
        assert bpe.encode(t) == lib.encode(t), t
        assert bpe.decode(bpe.encode(t)) == lib.decode(lib.encode(t)), t


def test_unigram_shortest_path_is_the_cheapest_of_all():
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.1, 1), ("▁a", -2.2, 1), ("ba", -4.0, 1), ("bab", -3.9, 1)]
    m = sentencepiece_wfst.Transducer(sentencepiece_wfst.UNIGRAM, pieces)
    cost = {p: -s for p, s, t in pieces if t == 1}
    for n in range(1, 8):
        for letters in itertools.product("ab", repeat=n):
            s = "▁" + "".join(letters)
            best = [0.0] + [float("inf")] * len(s)
            for j in range(1, len(s) + 1):
                best[j] = min(best[i] + cost.get(s[i:j], float("inf")) for i in range(j))
            got = m.encode("".join(letters))
            assert "".join(pieces[i][0] for i in got) == s
            assert sum(-pieces[i][1] for i in got) == pytest.approx(best[-1])


def test_encode_decode_tables(spark, make_docs, bpe, texts001):
    docs = make_docs([*ODD, (6, "tab\tand  two spaces ")])
    rows = sentencepiece_wfst.decode(sentencepiece_wfst.encode(docs, bpe), bpe)
    at_once = sentencepiece_wfst.encode(docs, bpe, decoded="decoded")
    assert at_once.columns == rows.columns and sorted(map(str, at_once.collect())) == sorted(map(str, rows.collect()))
    got = sorted(((r["doc_id"], r["text"], r["decoded"], r["ids"] is None) for r in rows.collect()), key=str)
    assert got == sorted([(i, t, t, t is None) for i, t in [*ODD, (6, "tab\tand  two spaces ")]], key=str)
    assert sentencepiece_wfst.encode(make_docs([]), bpe).count() == 0
    bad = spark.createDataFrame([([1, 2, 99_999],), ([-1],), ([],), (None,), ([None],)], "ids array<int>")
    assert [r["decoded"] for r in sentencepiece_wfst.decode(bad, bpe).collect()] == [None, None, "", None, None]
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    out = queries.QUERIES["op4_sentencepiece_wfst"](spark, SF001).collect()
    text = dict(texts001)
    assert len(out) == len(text) and all(r["lossless"] and list(r["ids"]) == lib.encode(text[r["doc_id"]]) for r in out)


# -- language -------------------------------------------------------------------
def brute_phrases(sample, text):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i = max(j - 1, i + 1)
        n += 1
    return n


def test_cross_parsing_equals_brute_force():
    rng = random.Random(3)
    samples = ["".join(rng.choice("abc ") for _ in range(200)), "".join(rng.choice("bcd ") for _ in range(150))]
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 90))) for _ in range(50)] + [""]
    parts = [langid.letters(s) for s in samples]
    own = np.array([ord(c) for c in "abcd"])
    code = langid.code_table(own)
    m = langid.Model(["x", "y"], own, [langid.automaton(code[p].tolist()) for p in parts], [len(p) for p in parts]).ready()
    as_text = lambda cp: "".join(chr(c) if c else " " for c in cp)
    got = langid.phrases(m, [code[langid.letters(t)] for t in texts])
    assert got.tolist() == [[brute_phrases(as_text(p), as_text(langid.letters(t))) for p in parts] for t in texts]


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.QUERIES["op5_crossparse_langid"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_odd_rows(make_docs):
    docs = make_docs([(1, "der hund und die katze " * 20, "de"), (2, "the dog and the cat " * 20, "en"), (3, "nothing", None)])
    model = langid.learn(docs, F.lit(True))
    assert model.langs == ["de", "en"]
    got = sorted(((r["doc_id"], r["lang_pred"]) for r in langid.identify(make_docs(
        [(1, None), (2, ""), (3, "12 34 !?"), (4, "the cat"), (4, "the cat"), (None, "und die katze"), (5, "hund " * 30_000)]), model).collect()), key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"), (5, "de")], key=str)
    none = langid.learn(make_docs([]), F.lit(True))
    assert [r["lang_pred"] for r in langid.identify(make_docs([(1, "text")]), none).collect()] == ["und"]


# -- line CRF ----------------------------------------------------------------------
def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(5)
    per = np.array([3, 0, 1, 4])
    score, turn = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    marginal, pair, log_z = quality_crf.forward_backward(score, turn, per)
    want, want_pair, want_z, at = np.zeros((8, 2)), np.zeros((2, 2)), 0.0, 0
    for n in per:
        paths = list(itertools.product((0, 1), repeat=int(n))) if n else []
        w = [np.exp(sum(score[at + i, y] for i, y in enumerate(p)) + sum(turn[a, b] for a, b in zip(p, p[1:]))) for p in paths]
        for p, x in zip(paths, w):
            for i, y in enumerate(p):
                want[at + i, y] += x / sum(w)
            for a, b in zip(p, p[1:]):
                want_pair[a, b] += x / sum(w)
        want_z += np.log(sum(w)) if w else 0
        at += n
    assert np.allclose(marginal, want) and np.allclose(pair, want_pair) and log_z == pytest.approx(want_z)


def test_line_features_count_repeats():
    x, length, per = quality_crf.line_features(["it it it fine\n\nother words here", None, "", "abc"])
    assert per.tolist() == [2, 0, 0, 1] and length.tolist() == [13, 16, 3]
    assert x[0, 9] == pytest.approx(2 / 4) and x[0, 10] == pytest.approx(2 / 4) and x[1, 9] == 0
    assert x[0, quality_crf.OWN * 2:quality_crf.OWN * 3].tolist() == x[1, :quality_crf.OWN].tolist()  # the next line


def test_quality_on_held_out_documents(spark):
    out = queries.QUERIES["op6_quality_crf"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    out = out.filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 for r in out)
    good, bad = [r for r in out if r["quality"] == 1], [r for r in out if r["quality"] == 0]
    assert all(r["predicted"] == 1 for r in good)
    assert sum(r["predicted"] == 0 for r in bad) >= 0.9 * len(bad)


def test_crf_odd_rows(spark, make_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id bigint, quality int")
    docs = make_docs([(1, "some plain words in a line"), (2, "### $$$ ### !!!"), (3, None)])
    model = quality_crf.learn(docs, labels, F.lit(True))
    got = sorted(((r["doc_id"], r["score"]) for r in quality_crf.score(make_docs(ODD), model).collect()), key=str)
    assert len(got) == len(ODD) and all(0 <= s <= 1 for _, s in got)
    assert dict(got)[1] == dict(got)[2] == dict(got)[3] == 0.0
    untrained = quality_crf.learn(docs, labels.limit(0), F.lit(True))
    assert quality_crf.score(make_docs([(1, "a line")]), untrained).first()["score"] == pytest.approx(0.5)


# -- decontamination ------------------------------------------------------------------
def brute_leaks(docs, items):
    """All items against all windows by plain BM25, then the overlap checks."""
    bags = [decontaminate.Counter(decontaminate.tokens(t)) for _, t in items]
    df = decontaminate.Counter(w for b in bags for w in b)
    n, mean = len(items), sum(sum(b.values()) for b in bags) / len(items)

    def impact(b, w):
        return np.log(1 + (n - df[w] + .5) / (df[w] + .5)) * b[w] * 2.2 / (b[w] + 1.2 * (.25 + .75 * sum(b.values()) / mean))
    stride = max(sum(b.values()) for b in bags)
    out = set()
    for i, t in docs:
        words = decontaminate.tokens(t)
        for start in range(0, max(1, len(words)), stride):
            w = words[start:start + 2 * stride]
            for (item, text), b in zip(items, bags):
                if sum(impact(b, x) for x in b if x in set(w)) >= 0.6 * sum(impact(b, x) for x in b) - 1e-9:
                    held = []
                    for part in decontaminate.question_and_answer(text):
                        k = min(5, len(part))
                        own = {tuple(part[a:a + k]) for a in range(len(part) - k + 1)} if part else set()
                        held.append(len(own & {tuple(w[a:a + k]) for a in range(len(w) - k + 1)}) / len(own) if own else 1.0)
                    if min(held) >= 0.8:
                        out.add((i, item))
    return out


def test_wand_equals_plain_bm25(spark, make_docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 3)
    monkeypatch.setattr(decontaminate, "SHARD", 100)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["the"] * 20
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 30))) + ". " + " ".join(rng.choice(words) for _ in range(4)) + ".") for i in range(30)]
    docs = []
    for i in range(60):
        body = [rng.choice(words) for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(0, 3)):
            part = rng.choice(items)[1].split()
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = "zzz"
            at = rng.randrange(len(body) + 1)
            body[at:at] = part
        docs.append((i, " ".join(body)))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(make_docs(docs), table).collect()}
    assert got == brute_leaks(docs, items) and len(got) > 20
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 1000)  # several groups, one pass each
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(make_docs(docs), table).collect()} == got
    left = decontaminate.clean(make_docs(docs), table)
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_pivots_and_bounds_of_blocks(monkeypatch):
    """Against the impacts themselves: every block's bound, and every item that reaches its threshold."""
    monkeypatch.setattr(decontaminate, "BLOCK", 2)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)] + ["the", "of"] * 60
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 25)))) for i in range(60)]
    df = decontaminate.Counter(w for _, t in rows for w in set(t.split()))
    index = decontaminate.build_index(rows, df, len(rows), 12.0, 0.3)
    shard, = index.shards
    impact = np.zeros((len(rows), len(shard.terms)))
    impact[shard.item, np.repeat(np.arange(len(shard.terms)), np.diff(shard.ptr))] = shard.impact
    dense, row, _ = shard.maxima
    assert 0 < len(dense) - 1 < len(shard.terms)  # both kinds of rows
    found = 0
    for _ in range(200):
        term = np.array(sorted(rng.sample(range(len(shard.terms)), rng.randrange(1, 60))))
        edge = np.array([0, len(term)])
        upper = shard.bounds(term, edge)[0]
        score = impact[:, term].sum(axis=1)
        n = len(shard.least)
        got = {(int(p), int(i)): x for ps, ks, xs in shard.pivots(np.repeat(np.arange(n), len(term)), np.tile(term, n), np.arange(n))
               for p, i, x in zip(ps, ks, xs)}
        assert got == pytest.approx({(k // 2, k): score[k] for k in range(len(rows)) if score[k] >= shard.theta[k]})
        found += len(got)
        for b in range(n):
            own = impact[2 * b:2 * b + 2, term]
            assert upper[b] == pytest.approx(own.max(axis=0).sum(), rel=1e-5, abs=1e-6)
    assert found > 100


def test_index_is_a_few_bytes_a_word():
    import pickle
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 11))) for _ in range(20_000)]
    rows = [(i, " ".join(words[int(20_000 * rng.random() ** 3)] for _ in range(40))) for i in range(3_000)]
    df = decontaminate.Counter(w for _, t in rows for w in set(t.split()))
    index = decontaminate.build_index(rows, df, len(rows), 40.0, 0.6)
    assert len(pickle.dumps(index)) <= 4 * sum(len(t) for _, t in rows)
    for shard in index.shards:
        assert shard.maxima[0].size <= 8 * len(shard.item) + len(shard.least)


def test_decontamination_odd_rows(spark, make_docs):
    items = spark.createDataFrame([(1, "what is the colour of the early morning sky. deep blue."), (2, None), (3, ""), (None, "alpha beta"), (1, "alpha beta")],
                                  "item_id bigint, text string")
    docs = make_docs([*ODD, (6, "x " * 500 + "What is the colour of the early morning sky? Deep blue!" + " y" * 500), (7, "what is the colour of the early morning sky")])
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()), key=str)
    assert got == sorted([(6, 1), (None, None), (None, 1), (4, None), (4, 1), (4, None), (4, 1)], key=str)
    assert decontaminate.clean(docs, items).columns == docs.columns
    assert sorted((r["doc_id"] for r in decontaminate.clean(docs, items).collect())) == [1, 2, 3, 5, 7]
    assert decontaminate.leaks(make_docs([]), items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0 and decontaminate.clean(docs, items.limit(0)).count() == len(ODD) + 2


def test_planted_items_are_found(spark, texts001):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op10_benchmark_wand"](spark, SF001).collect()}
    assert got >= {(d, i) for d, t in texts001 for i, x in items if x in t}


# -- archives ---------------------------------------------------------------------------
def test_archive_round_trip_of_odd_pages(spark, tmp_path):
    big = "ä€𝄞\r\n\r\nWARC/1.1\r\n" * 20_000
    rows = [(1, "http://a/", "x" * 200), (2, "http://b/\r\nX: y", "x" * 200), (3, None, None), (4, "u", ""), (None, "u", "x" * 200),
            (5, "u", "short"), (6, "u", "short"), (7, "u", big), (8, "u", big), (8, "u", big)]
    table = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, payload string").repartition(3)
    path = str(tmp_path / "warc")
    warc.write(table, path, segment=1000)
    raw = warc.read(spark, path)
    whole = {r["row_id"]: r for r in raw.filter("type = 'response'").collect()}
    assert bytes(whole["7"]["payload"]).decode() == big and whole["7"]["sound"]
    out = warc.pages(raw, {"n": F.octet_length("payload"), "d": F.sha2("payload", 256)}).collect()
    got = sorted(((r["row_id"], r["n"], r["type"], r["refers_to_row"], r["url"]) for r in out), key=str)
    n = len(big.encode())
    assert got == sorted([("1", 200, "response", None, "http://a/"), ("2", 200, "revisit", "1", "http://b/%0D%0AX: y"), ("3", 0, "response", None, None),
                          ("4", 0, "response", None, "u"), (None, 200, "revisit", "1", "u"), ("5", 5, "response", None, "u"), ("6", 5, "response", None, "u"),
                          ("7", n, "response", None, "u"), ("8", n, "revisit", "7", "u"), ("8", n, "revisit", "7", "u")], key=str)
    assert all(r["sound"] for r in out) and {r["d"] for r in out if r["row_id"] in ("7", "8")} == {hashlib.sha256(big.encode()).hexdigest()}


def test_archive_of_an_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"), str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).count() == 0


def test_broken_segments_are_not_sound(spark, tmp_path):
    parts = warc.records_of(1, "1", "u", b"y" * 5000, "d", None, 1000)
    assert len(parts) > 4
    for name, kept in (("whole", parts), ("gap", parts[:2] + parts[3:]), ("cut", parts[:-1])):
        os.makedirs(tmp_path / name)
        body = b"".join(p + b"\r\n\r\n" for p in reversed(kept))  # any order
        (tmp_path / name / "part-0.warc.gz").write_bytes(gzip.compress(body[:700]) + gzip.compress(body[700:]))  # several members
        row = warc.read(spark, str(tmp_path / name)).first()
        assert (row["sound"], row["payload"] is not None) == (name == "whole", name == "whole")
    assert warc.dechunk(b"3\r\nabc\r\n0\r\n\r\n") == b"abc" and warc.dechunk(b"9\r\nabc\r\n0\r\n\r\n") is None and warc.dechunk(b"zz\r\n") is None


# -- licences --------------------------------------------------------------------------------
def test_licences_and_inheritance(spark):
    body = "some other words that fill the file and say nothing at all about rights\n" * 3
    files = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/x.py", body), (3, "a/b/y.py", body), (4, "a/b/c/z.py", "Licensed under the Apache License, Version 2.0.\n" + body),
             (5, "d/e.py", body), (6, None, body), (7, "a/b/NOTICE.txt", body + "This work is licensed under the GNU General Public License, version 3.\n"),
             (8, "a/b/c/w.py", None), (9, "top.py", ""), (9, "top.py", "")]
    out = licenses.scan(spark.createDataFrame([(*f, "q", "r") for f in files], "id bigint, path string, text string, _file string, licence string"), id_col="id")
    got = sorted(((r["id"], r["own_licences"], r["inherited_from"], r["licences"], r["via"]) for r in out.collect()), key=str)
    assert got == sorted([(1, "MIT", None, "MIT", "own"), (2, None, "a", "MIT", "directory"), (3, None, "a/b", "GPL-3.0", "directory"), (4, "Apache-2.0", None, "Apache-2.0", "own"),
                          (5, None, None, None, "none"), (6, None, None, None, "none"), (7, "GPL-3.0", None, "GPL-3.0", "own"), (8, None, "a/b", "GPL-3.0", "directory"),
                          (9, None, None, None, "none"), (9, None, None, None, "none")], key=str)
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_broadcasts_are_size_checked_or_of_literals():
    """A broadcast hint stands in ``small``, which counts first, or on a table made of the templates' literals."""
    import pathlib
    import passkit.llm
    for f in pathlib.Path(passkit.llm.__file__).parent.glob("*.py"):
        for line in f.read_text().splitlines():
            if "F.broadcast(" in line:
                assert f.name == "base.py" or "F.broadcast(_table(" in line, (f.name, line)
