"""The SentencePiece transducer: character maps, the merge-order acceptor, long segments, memos."""

import itertools
import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from passkit.llm import queries, sentencepiece_wfst as wfst


@pytest.fixture(scope="module")
def bpe():
    return wfst.compile_model(queries.TOKENIZER)


def changed(tmp_path, change):
    """The public model with another normaliser: as the operator and as the library read it."""
    m = pb.ModelProto()
    with open(queries.TOKENIZER, "rb") as f:
        m.ParseFromString(f.read())
    change(m)
    path = str(tmp_path / "changed.model")
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    return wfst.compile_model(path), sentencepiece.SentencePieceProcessor(model_file=path)


def random_texts(parts, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map_equals_the_library(tmp_path, rule):
    def change(m):
        m.normalizer_spec.CopyFrom(pb.ModelProto.FromString(
            sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=True).serialized_model_proto()).normalizer_spec)
        m.normalizer_spec.add_dummy_prefix = True
        m.normalizer_spec.escape_whitespaces = True
    ours, lib = changed(tmp_path, change)
    parts = ["a", "ﬁ", "Ａ", "①", "é", "́", "ｶ", "ﾞ", "ｶﾞ", "㍿", " ", "  ", "\t", "\n", "​", "½", "Straße", "한", "한", "the", "日本", "　"]
    for t in random_texts(parts, 800, 4):
        assert ours.encode(t) == lib.encode(t), repr(t)


def test_surplus_spaces_without_a_character_map(tmp_path):
    def change(m):
        m.normalizer_spec.remove_extra_whitespaces = True
        m.normalizer_spec.add_dummy_prefix = False
    ours, lib = changed(tmp_path, change)
    for t in random_texts(["a", "the", " ", "  ", "\n", "-", "日"], 400, 5):
        assert ours.encode(t) == lib.encode(t), repr(t)


def test_accepted_pairs_are_those_that_merging_keeps_apart(bpe):
    number = {p: i for i, (p, _, t) in enumerate(bpe.pieces) if t == wfst.NORMAL}
    score = {p: -bpe.pieces[i][1] for p, i in number.items()}

    def merged(s):
        parts = list(s)
        while True:
            best = min(((score[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score), default=None)
            if best is None:
                return parts
            parts[best[1]:best[1] + 2] = ["".join(parts[best[1]:best[1] + 2])]
    rng = random.Random(6)
    own = [p for p in rng.sample(sorted(number), 3000) if merged(p) == [p]] + [p for p in number if set(p) <= set("aen-") and merged(p) == [p]]
    pairs = [(rng.choice(own), rng.choice(own)) for _ in range(4000)] + list(itertools.product(own[-25:], repeat=2))
    got = bpe.accepts(np.array([number[a] for a, _ in pairs]), np.array([number[b] for _, b in pairs]))
    assert got.tolist() == [merged(a + b) == [a, b] for a, b in pairs]
    assert 0 < got.sum() < len(pairs)


def test_long_segments_runs_and_batches(bpe):
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    rng = random.Random(7)
    texts = ["a" * 3000, "ab" * 2001, "-" * 777, "\n" * 50, "日" * 300, "".join(rng.choice("etaoin") for _ in range(5000)), " " * 40, "▁" * 9]
    assert bpe.encode_all(texts) == lib.encode(texts)
    assert bpe.encode_all([]) == [] and bpe.encode_all(["", ""]) == [[], []]
    again = bpe.encode_all(texts[::-1])[::-1]  # from the memo
    assert again == lib.encode(texts)


def test_small_memo_gives_the_same(bpe, monkeypatch):
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    monkeypatch.setattr(wfst, "MEMO", 5)
    monkeypatch.setattr(wfst, "LONG", 3)
    monkeypatch.setattr(wfst, "GROUP", 16)
    bpe.forget()
    for t in random_texts(["the ", "cat", " sat", "on", "\n", "ing "], 200, 8):
        assert bpe.encode(t) == lib.encode(t)


def test_unigram_equals_the_library(tmp_path):
    m = pb.ModelProto()
    m.trainer_spec.model_type = wfst.UNIGRAM
    m.normalizer_spec.remove_extra_whitespaces = False
    rng = random.Random(9)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))) for _ in range(40)} | {"▁a", "▁ab", "▁c"}
    for piece, score, kind in [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((c, -6.0 - k / 8, 1) for k, c in enumerate("▁abc")),
                               *((w, -4.0 - rng.randrange(1, 4000) / 512, 1) for w in sorted(words))]:
        m.pieces.add(piece=piece, score=score, type=kind)
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    ours, lib = wfst.compile_model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in random_texts(["a", "b", "c", " ", "x", "yz"], 600, 10):
        assert ours.encode(t) == lib.encode(t), t


def test_pieces_whose_merges_are_out_of_order_are_refused():
    pieces = [("<unk>", 0.0, 2), ("a", 0.0, 1), ("b", 0.0, 1), ("c", 0.0, 1), ("ab", -5.0, 1), ("abc", -1.0, 1)]
    with pytest.raises(ValueError):
        wfst.Transducer(wfst.BPE, pieces)
