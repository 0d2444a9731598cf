"""Document quality from a linear-chain conditional random field over lines.

Every non-blank line of a text is one position, with the labels bad (0) and
good (1). A line's features are shares of its characters and words, those
of the line before and after it, and whether it is the first or the last.
Forward-backward gives each line's marginal of good; a document's quality is
their mean, weighted by line length.

Learning: a line takes its document's label; weights maximise the penalised
conditional likelihood (Adam, full batches) on a bounded sample of about
``SAMPLE_DOCS`` labelled documents, dealt by a hash of the id. The sample is
fitted inside one task; only the weights come to the driver.

Defined results: a null text or one without a non-blank line scores 0; with
no labelled document every line's marginal is one half; texts of any length
are scored whole; equal rows give equal results; rows with a null label or
id are not learned from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passkit.llm.base import small

SAMPLE_DOCS = 4000
STEPS, RATE, L2 = 200, 0.2, 1e-5
CHUNK = 2 << 20
LOWER, UPPER, DIGIT, SPACE, NEWLINE, SYMBOL, STOP, OTHER = range(8)
SYMBOLS = "#*$%&|<>{}[]=_~^\\/@+"
STOPS = ".,;:!?\"'()-"
OWN = 12  # features of a line itself
N_FEATURES = 3 * OWN + 3


@cache
def classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = UPPER if ch.isupper() else LOWER
        elif ch.isdigit():
            table[c] = DIGIT
    for kind, chars in ((SYMBOL, SYMBOLS), (STOP, STOPS), (SPACE, " \t\x0b\x0c\r"), (NEWLINE, "\n")):
        table[[ord(c) for c in chars]] = kind
    return table


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, line lengths, lines per text); lines in order, blank ones left out."""
    parts = [np.frombuffer(((t or "") + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    size = np.array([len(p) for p in parts], dtype=np.int64)
    cp = np.concatenate(parts) if parts else np.array([], dtype=np.uint32)
    kind = classes()[cp]
    end = np.flatnonzero(kind == NEWLINE)
    start = np.concatenate([[0], end[:-1] + 1]).astype(np.int64)
    total = np.zeros((len(end), 8))
    for k in range(8):
        total[:, k] = np.add.reduceat(kind == k, start, dtype=np.int64)
    bang = np.add.reduceat(cp == ord("!"), start, dtype=np.int64)
    # words: where they start, and a polynomial hash of each, modulo 2**64
    gap = (kind == SPACE) | (kind == NEWLINE)
    first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    line = np.searchsorted(end, first)
    word = np.zeros(0, dtype=np.uint64)
    if len(first):
        place = np.arange(first[0], len(cp)) - np.repeat(first, np.diff(np.append(first, len(cp))))
        up = np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64)
        up[0] = 1
        term = (cp[first[0]:].astype(np.uint64) + np.uint64(1)) * np.cumprod(up)[place]
        term[gap[first[0]:]] = 0
        word = np.add.reduceat(term, first - first[0])
    n_words = np.bincount(line, minlength=len(end))
    again = np.bincount(line[1:][(line[1:] == line[:-1]) & (word[1:] == word[:-1])], minlength=len(end))
    order = np.lexsort((word, line))
    repeat = np.bincount(line[order][1:][(line[order][1:] == line[order][:-1]) & (word[order][1:] == word[order][:-1])], minlength=len(end))
    ink = total[:, [LOWER, UPPER, DIGIT, SYMBOL, STOP, OTHER]].sum(axis=1)
    held = ink > 0
    letters = total[:, LOWER] + total[:, UPPER]
    words = np.maximum(n_words, 1)
    own = np.stack([
        np.log1p(ink) / 6, letters / np.maximum(ink, 1), total[:, UPPER] / np.maximum(letters, 1),
        total[:, DIGIT] / np.maximum(ink, 1), np.minimum(total[:, SYMBOL] / words, 1), total[:, STOP] / np.maximum(ink, 1),
        total[:, OTHER] / np.maximum(ink, 1), np.minimum(bang / words, 1), np.minimum(ink / words, 20) / 10,
        again / words, repeat / words, np.minimum(words, 100) / 100], axis=1)[held]
    per = np.bincount(np.searchsorted(np.cumsum(size), start[held], side="right"), minlength=len(texts))
    length = (end - start)[held]
    bound = np.concatenate([[0], np.cumsum(per)])
    is_first, is_last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    is_first[bound[:-1][per > 0]] = True
    is_last[bound[1:][per > 0] - 1] = True
    prev, nxt = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    prev[is_first], nxt[is_last] = 0, 0
    return np.concatenate([own, prev, nxt, is_first[:, None], is_last[:, None], np.ones((len(own), 1))], axis=1), length, per


def forward_backward(score: np.ndarray, turn: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each line, summed marginals of neighbouring labels, and the summed log partition.

    ``score``: lines x 2, ``turn``: 2 x 2 (label before, label). All texts
    step along together, those with most lines first.
    """
    bound = np.concatenate([[0], np.cumsum(per)])
    order = np.argsort(-per, kind="stable")
    order = order[per[order] > 0]
    n, start = per[order], bound[:-1][order]
    steps = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(steps), side="left")  # texts with more than t lines
    phi = np.exp(score - score.max(axis=1, keepdims=True))
    t = np.exp(turn)
    alpha, beta, scale = np.zeros_like(phi), np.ones_like(phi), np.ones(len(phi))
    for k in range(steps):
        at = start[:live[k]] + k
        a = phi[at] if k == 0 else (alpha[at - 1] @ t) * phi[at]
        scale[at] = a.sum(axis=1)
        alpha[at] = a / scale[at, None]
    for k in range(steps - 2, -1, -1):
        at = start[:live[k + 1]] + k
        beta[at] = ((phi[at + 1] * beta[at + 1]) @ t.T) / scale[at + 1, None]
    marginal = alpha * beta
    marginal /= np.maximum(marginal.sum(axis=1, keepdims=True), 1e-300)
    inner = np.ones(len(phi), bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    pair = alpha[at - 1][:, :, None] * t[None] * (phi[at] * beta[at])[:, None, :] / scale[at][:, None, None]
    return marginal, pair.sum(axis=0), float(np.log(scale).sum() + score.max(axis=1).sum()) if len(score) else 0.0


@dataclass
class Crf:
    weights: np.ndarray  # features x 2
    turn: np.ndarray     # 2 x 2

    def qualities(self, texts: list[str | None]) -> list[float]:
        x, length, per = line_features(texts)
        if not len(x):
            return [0.0] * len(texts)
        good = forward_backward(x @ self.weights, self.turn, per)[0][:, 1]
        text = np.repeat(np.arange(len(texts)), per)
        weight = np.bincount(text, length, minlength=len(texts))
        return np.clip(np.bincount(text, good * length, minlength=len(texts)) / np.maximum(weight, 1), 0.0, 1.0).tolist()


def train(texts: list[str], labels: np.ndarray) -> Crf:
    x, _, per = line_features(texts)
    model = Crf(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    if not len(x):
        return model
    y = np.repeat(labels, per)
    inner = np.ones(len(x), bool)
    inner[(np.cumsum(per) - per)[per > 0]] = False
    seen = x.T @ np.eye(2)[y]
    seen_turn = np.diag(np.bincount(y[inner], minlength=2).astype(float))
    p = np.concatenate([model.weights.ravel(), model.turn.ravel()])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        w, t = p[:2 * N_FEATURES].reshape(-1, 2), p[2 * N_FEATURES:].reshape(2, 2)
        marginal, pair, _ = forward_backward(x @ w, t, per)
        grad = np.concatenate([(seen - x.T @ marginal).ravel(), (seen_turn - pair).ravel()]) / len(x) - L2 * p
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        p = p + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Crf(p[:2 * N_FEATURES].reshape(-1, 2), p[2 * N_FEATURES:].reshape(2, 2))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Crf:
    """Fit on the rows of ``labels`` where ``usable`` (over its id) holds."""
    rows = labels.filter(usable).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    n = rows.count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    rows = rows.filter(share * F.lit(n) < SAMPLE_DOCS).distinct()
    sample = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).join(small(rows), "id")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "y", "text"])
        got = train(pdf["text"].tolist(), pdf["y"].to_numpy())
        return pd.DataFrame({"p": [np.concatenate([got.weights.ravel(), got.turn.ravel()])]})

    row = sample.filter("text is not null").groupBy().applyInPandas(fit, "p array<double>").first()
    p = np.array(row["p"]) if row else np.zeros(2 * N_FEATURES + 4)
    return Crf(p[:2 * N_FEATURES].reshape(-1, 2), p[2 * N_FEATURES:].reshape(2, 2))


def score(docs: DataFrame, model: Crf, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            texts, at, size = [], 0, 0
            for k in range(b.num_rows + 1):
                if texts and (k == b.num_rows or size >= CHUNK):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(m.qualities(texts), pa.float64())], names=["id", "score"])
                    texts, at, size = [], k, 0
                if k < b.num_rows:
                    texts.append(b.column(1)[k].as_py())
                    size += len(texts[-1] or "")

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, score double").withColumnRenamed("id", id_col)
