"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a sample of labelled text. A text
is parsed greedily into phrases, each the longest that occurs in the sample;
a language that needs few phrases resembles the text. Phrases are normalised
to bits per letter, ``phrases * log2(sample length) / letters`` (the
cross-parsing estimate of cross entropy), and the least wins; equal bits go
to the language that sorts first.

Letters are lower-cased, and each run of other characters is one gap. Texts
are parsed whole, in pieces of ``PIECE`` characters that run through the
automata side by side; a phrase ends where a piece ends, for every language
alike.

Learning takes a bounded sample: about ``SAMPLE_DOCS`` documents per
language, dealt by a hash of the text, up to ``SAMPLE_CHARS`` letters and
gaps of them, shorter texts first where one text would fill over an eighth.

Defined results: ``und`` and score 0 for a null text, one without letters,
or when nothing was learned; equal rows give equal results; null labels and
null ids are not learned from (a null id is not held out); other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passkit.llm.base import small

SAMPLE_DOCS = 400
SAMPLE_CHARS = 60_000
PIECE = 2048
CHUNK = 4 << 20
OWN_CODES, SHARED_CODES = 96, 31
EVIDENCE = 20  # letters whose likelihood the score compares


@cache
def lower_letters() -> np.ndarray:
    """Code point to the code point of its lower-case letter; 0 where it is no letter."""
    table = np.zeros(0x110000, dtype=np.int32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def letters(text: str) -> np.ndarray:
    """Lower-case letters as code points, with one 0 for each run of others."""
    cp = lower_letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    keep = cp != 0
    keep[:-1] |= cp[1:] != 0  # the last of a run of others stays, but at the end
    return cp[keep]


def automaton(codes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions (state, code, target) of the suffix automaton of ``codes``; state 1 is its root."""
    nxt: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    at = np.repeat(np.arange(len(nxt), dtype=np.int32), [len(x) for x in nxt])
    code = np.fromiter((c for x in nxt for c in x), dtype=np.uint8, count=len(at))
    to = np.fromiter((t for x in nxt for t in x.values()), dtype=np.int32, count=len(at))
    return at, code, to


@dataclass
class Model:
    """Languages in order, letters with a code of their own, and each language's transitions."""
    langs: list[str]
    own: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    lengths: list[int]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("code", "table", "restart")}

    def ready(self) -> Model:
        """Dense tables, once per process: state 0 is "no phrase yet" and has no way on."""
        if not hasattr(self, "table"):
            self.code = code_table(self.own)
            width = int(self.code.max()) + 1
            total = 1 + sum(int(max(p[0].max(), p[2].max())) + 1 for p in self.parts)
            self.table = np.zeros((total, width), dtype=np.int32)
            self.restart = np.zeros((len(self.parts), width), dtype=np.int32)
            base = 1
            for k, (at, code, to) in enumerate(self.parts):
                self.table[at + base, code] = to + base
                self.restart[k] = self.table[1 + base]
                base += int(max(at.max(), to.max())) + 1
        return self


def code_table(own: np.ndarray) -> np.ndarray:
    """Code point of a lower-case letter to its code; letters without their own share some by remainder."""
    code = np.zeros(0x110000, dtype=np.uint8)
    cp = np.flatnonzero(lower_letters())
    code[cp] = 1 + len(own) + cp % SHARED_CODES
    code[own] = np.arange(1, len(own) + 1)
    return code


def phrases(model: Model, codes: list[np.ndarray]) -> np.ndarray:
    """Phrase counts, texts x languages."""
    pieces = [(k, x[a:a + PIECE]) for k, x in enumerate(codes) for a in range(0, len(x), PIECE)]
    pieces.sort(key=lambda p: -len(p[1]))
    n_lang, width = len(model.langs), model.table.shape[1]
    out = np.zeros((len(codes), n_lang), dtype=np.int64)
    if not pieces:
        return out
    size = np.array([len(p[1]) for p in pieces])
    grid = np.zeros((int(size[0]), len(pieces)), dtype=np.int32)
    for k, (_, x) in enumerate(pieces):
        grid[:len(x), k] = x
    flat, restart = model.table.ravel(), model.restart
    state = np.zeros((n_lang, len(pieces)), dtype=np.int32)
    count = np.zeros((n_lang, len(pieces)), dtype=np.int32)
    for row in range(len(grid)):
        live = int(np.searchsorted(-size, -row, side="left"))  # pieces longer than row
        c = grid[row, :live]
        to = flat[state[:, :live] * width + c]
        new = to == 0
        count[:, :live] += new
        state[:, :live] = np.where(new, restart[:, c], to)
    np.add.at(out, np.array([p[0] for p in pieces]), count.T)
    return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    model.ready()
    cps = [letters(t) if t else np.array([], dtype=np.int32) for t in texts]
    n = np.array([int((x != 0).sum()) for x in cps])
    count = phrases(model, [model.code[x] for x in cps])
    bits = count * np.log2(np.array(model.lengths))[None, :] / np.maximum(n, 1)[:, None]
    best = bits.argmin(axis=1)
    gap = np.minimum((bits - bits.min(axis=1, keepdims=True)) * EVIDENCE, 500.0)
    score = 1.0 / (2.0 ** -gap).sum(axis=1)
    return ([model.langs[b] if k else "und" for b, k in zip(best, n)],
            [float(s) if k else 0.0 for s, k in zip(score, n)])


def _learn_language(pdf: pd.DataFrame) -> pd.DataFrame:
    """One language's sample rows to one row: its letters in a single run of code points."""
    got, size = [], 0
    cps = [letters(t) for t in pdf.sort_values(["h", "text"])["text"]]
    for x in sorted(cps, key=lambda x: len(x) > SAMPLE_CHARS // 8):  # stable
        x = np.concatenate([x, [0]]).astype(np.int32)[:SAMPLE_CHARS - size]
        got.append(x)
        size += len(x)
        if size >= SAMPLE_CHARS:
            break
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "cps": [np.concatenate(got).tobytes()]})


def learn(docs: DataFrame, usable: Column, lang: str = "lang", text: str = "text") -> Model:
    """Model from the rows where ``usable`` holds; what reaches the driver is bounded by the sample's size per language."""
    rows = docs.filter(usable).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.filter("lang is not null and text rlike '\\\\p{L}'")
    # of different texts, so that a text which many rows repeat weighs once
    counts = rows.select("lang", F.xxhash64("text").alias("th")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    h = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.withColumn("h", h).join(small(counts, 10_000), "lang").filter(F.col("h") * F.col("n") < SAMPLE_DOCS)
    got = sample.select("lang", "text", "h").dropDuplicates(["lang", "text"]).groupBy("lang").applyInPandas(
        _learn_language, "lang string, cps binary").toPandas().sort_values("lang")
    texts = [np.frombuffer(x, dtype=np.int32) for x in got["cps"]]
    tally = Counter()
    for x in texts:
        tally.update(x[x != 0].tolist())
    own = np.array([c for c, _ in sorted(tally.items(), key=lambda cn: (-cn[1], cn[0]))[:OWN_CODES]], dtype=np.int64)
    code = code_table(own)
    return Model(list(got["lang"]), own, [automaton(code[x].tolist()) for x in texts], [max(2, len(x)) for x in texts])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            texts, at, size = [], 0, 0
            for k in range(b.num_rows + 1):
                if texts and (k == b.num_rows or size >= CHUNK):
                    lang, score = predict(m, texts) if m.langs else (["und"] * len(texts), [0.0] * len(texts))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                     names=["id", "lang_pred", "score"])
                    texts, at, size = [], k, 0
                if k < b.num_rows:
                    texts.append(b.column(1)[k].as_py())
                    size += len(texts[-1] or "")

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
