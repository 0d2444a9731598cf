"""Benchmark decontamination: BM25 retrieval of test items with block-max WAND, then overlap checks.

Items are indexed once; every passage of every document is a query. A
passage is a window of 2 S words that starts at each multiple of S, with S
the length of the longest item of the shard, so an item quoted anywhere lies
whole in some passage. An item is retrieved if its BM25 score reaches
``share`` of the score it gets from its own text. Of retrieved items, the
question and the answer are verified by their five-word shingles.

Pruning is exact. An item's least terms that together stay below its
threshold cannot bring it there, so only passages with one of its other
(essential) terms are looked at; of those, a block of items is opened only
if the sum of the block's largest impacts reaches the least threshold in it.
In an open block, cursors on the terms' postings move by WAND: sorted by the
item they stand on, the first one up to which the largest impacts add up to
its item's threshold names the pivot, and items before it are skipped; many
passages' blocks move together.

The index is broadcast in groups of at most ``GROUP_BYTES`` of item text,
one pass over the documents per group; nothing else of the items' number
reaches a task at once. It holds postings, essential blocks and the items'
words as flat arrays, a few bytes for each word of the items; block maxima are
derived from the postings in the worker and dense only for terms of an
eighth of a shard's blocks, so they take at most eight cells a posting.

Defined results: null or empty texts and items match nothing; equal rows
give equal result rows; item ids may repeat, each row is an item of its
own; other columns are ignored or passed through; ties between passages of
a document go to the first one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
SHARE = 0.6
SHINGLE = 5
OVERLAP = 0.8
BLOCK = 16
SHARD = 1024
GROUP_BYTES = 16 << 20
CHUNK_CHARS = 4 << 20
CURSORS = 1 << 19  # moved together, or those of one passage and block
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¡¿"


def tokens(text: str | None) -> list[str]:
    """Lower-case words without punctuation at their ends."""
    return [t for t in (w.strip(EDGE) for w in text.lower().split()) if t] if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence or line is the answer; a single sentence gives its last fifth."""
    words = text.split()
    ends = [i + 1 for i, w in enumerate(words[:-1]) if w[-1] in ".?!"]
    q, a = (words[:ends[-1]], words[ends[-1]:]) if ends else (words[:-max(1, len(words) // 5)], words[-max(1, len(words) // 5):])
    return tokens(" ".join(q)), tokens(" ".join(a))


class Terms(dict):
    """Raw word to term number: -1 for a term of no item, -2 for a word without a term. Bounded memo."""

    def __init__(self, number: dict[str, int], most: int = 400_000):
        self.number, self.most = number, most

    def __missing__(self, word: str) -> int:
        t = word.strip(EDGE)
        n = self.number.get(t, -1) if t else -2
        if len(self) >= self.most:
            self.clear()
        self[word] = n
        return n


def offsets(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of 0..n-1 starts in sorted ``keys``, and the end."""
    return np.searchsorted(keys, np.arange(n + 1)).astype(np.int32)


def spread(ptr: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ptr[a] .. ptr[a + 1] - 1 of each ``a`` in ``at``, one after the other, and how many each has."""
    n = ptr[at + 1] - ptr[at]
    return np.repeat(ptr[at] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


@dataclass
class Shard:
    """Up to ``SHARD`` items in blocks, ascending in threshold; a shard numbers its own terms."""
    items: list[int]                    # places in the group's item list
    stride: int
    block: int                          # items of a block
    theta: np.ndarray                   # by item of the shard, ascending
    least: np.ndarray                   # least theta of each block
    terms: np.ndarray                   # the group's number of each of the shard's terms
    essential: tuple[np.ndarray, np.ndarray]  # term -> blocks, as offsets and values
    ptr: np.ndarray                     # term -> postings
    item: np.ndarray                    # by posting: item of the shard, ascending in a term
    impact: np.ndarray                  # by posting

    @cached_property
    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term, block) cells that have postings: keys term * blocks + block, their postings' offsets, largest impacts."""
        nb = len(self.least)
        key = np.repeat(np.arange(len(self.terms)), np.diff(self.ptr)) * nb + self.item // self.block
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return key[first], np.append(first, len(key)), np.maximum.reduceat(self.impact, first)

    @cached_property
    def maxima(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Dense rows of block maxima, each term's row in them (the last row, all zero, if it has few blocks), and
        the offsets of each term's cells."""
        nb, n = len(self.least), len(self.terms)
        key, _, top = self.cells
        ptr = offsets(key // nb, n)
        many = np.diff(ptr) * 8 >= nb
        row = np.where(many, np.cumsum(many) - 1, many.sum())
        dense = np.zeros((many.sum() + 1, nb), dtype=np.float32)
        held = many[key // nb]
        dense[row[key[held] // nb], key[held] % nb] = top[held]
        return dense, row, ptr

    def local(self, n_terms: int) -> np.ndarray:
        """The shard's number of each of the group's terms, -1 for others; the last entry serves term -1."""
        out = np.full(n_terms + 1, -1, dtype=np.int32)
        out[self.terms] = np.arange(len(self.terms))
        return out

    def bounds(self, term: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Windows x blocks: sums of the block maxima of each window's terms term[edge[w]:edge[w + 1]], none empty."""
        dense, row, ptr = self.maxima
        rows = row[term]
        upper = np.add.reduceat(dense[rows], edge[:-1], axis=0)
        rare = np.flatnonzero(rows == len(dense) - 1)
        if len(rare):
            key, _, top = self.cells
            nb = len(self.least)
            at, n = spread(ptr, term[rare])
            win = np.searchsorted(edge, rare, side="right") - 1
            np.add.at(upper.reshape(-1), np.repeat(win, n) * nb + key[at] % nb, top[at])
        return upper

    def pivots(self, pair: np.ndarray, term: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(pair, item of the shard, score) of the items that reach their threshold in the blocks block[p].

        Pair p has the terms ``term`` where ``pair`` (ascending) is p, each with a cursor on its postings
        in the block; a round takes one pivot of each pair that has any left.
        """
        key, start, top = self.cells
        want = term * len(self.least) + block[pair]
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        held = key[at] == want
        pair, at = pair[held], at[held]
        cursor, end, top = start[at], start[at + 1], top[at]
        done = len(self.theta)
        while len(pair):
            here = self.item[cursor].astype(np.int64)
            order = np.argsort(pair * done + here, kind="stable")
            pair, cursor, end, top, here = pair[order], cursor[order], end[order], top[order], here[order]
            head = np.flatnonzero(np.diff(pair, prepend=-1))
            most = np.cumsum(top)
            most -= np.repeat(most[head] - top[head], np.diff(np.append(head, len(pair))))
            reach = np.flatnonzero(most * (1 + 1e-6) >= self.theta[here] * (1 - 1e-6))
            who, first = np.unique(pair[reach], return_index=True)
            pivot = np.full(len(block), done)
            pivot[who] = here[reach[first]]
            level = np.zeros(len(block), dtype=bool)  # the first cursor stands on the pivot
            level[pair[head]] = here[head] == pivot[pair[head]]
            to = pivot[pair]
            on = (here == to) & level[pair]
            score = np.bincount(pair[on], self.impact[cursor[on]], len(block))
            good = np.flatnonzero(level)
            good = good[score[good] >= self.theta[pivot[good]] * (1 - 1e-9)]
            if len(good):
                yield good, pivot[good], score[good]
            cursor = cursor + on
            for _ in range(self.block):  # cursors before a pivot go up to it
                behind = (cursor < end) & (self.item[np.minimum(cursor, end - 1)] < to) & (to < done)
                if not behind.any():
                    break
                cursor = cursor + behind
            left = (to < done) & (cursor < end)
            pair, cursor, end, top = pair[left], cursor[left], end[left], top[left]


@dataclass
class Index:
    ids: list
    parts: list[tuple[np.ndarray, np.ndarray]]  # question and answer as term numbers
    terms: list[str]
    shards: list[Shard]

    @cached_property
    def number(self) -> dict[str, int]:
        return {t: k for k, t in enumerate(self.terms)}


def build_index(rows: list[tuple], df: dict[str, int], n_items: int, mean_len: float, share: float) -> Index:
    """Index of (item id, text) rows; ``df``, ``n_items`` and ``mean_len`` are those of all items."""
    bags = [Counter(tokens(t)) for _, t in rows]
    names = sorted({t for b in bags for t in b})
    number = {t: k for k, t in enumerate(names)}
    idf = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) for t in number}
    length = [sum(b.values()) for b in bags]

    def impacts(i: int) -> dict[int, float]:
        norm = K1 * (1 - B + B * length[i] / mean_len)
        return {number[t]: idf[t] * n * (K1 + 1) / (n + norm) for t, n in bags[i].items()}

    theta = [share * sum(impacts(i).values()) for i in range(len(rows))]
    order = sorted((i for i in range(len(rows)) if bags[i]), key=lambda i: (length[i], theta[i], i))
    shards = []
    for s in range(0, len(order), SHARD):
        part = order[s:s + SHARD]
        stride = max(length[i] for i in part)
        part.sort(key=lambda i: (theta[i], i))
        nb = -(-len(part) // BLOCK)
        postings, essential = [], set()
        for k, i in enumerate(part):
            below = 0.0
            for t, x in sorted(impacts(i).items(), key=lambda tx: (tx[1], tx[0])):
                below += x
                if below >= theta[i] * (1 - 1e-9):
                    essential.add((t, k // BLOCK))
                postings.append((t, k, x))
        postings.sort()
        own, term = np.unique(np.array([p[0] for p in postings], dtype=np.int32), return_inverse=True)
        needed = np.array(sorted(essential), dtype=np.int32).reshape(-1, 2)
        least = np.array([theta[part[b * BLOCK]] for b in range(nb)])
        shards.append(Shard(part, stride, BLOCK, np.array([theta[i] for i in part]), least, own,
                            (offsets(np.searchsorted(own, needed[:, 0]), len(own)), needed[:, 1].astype(np.uint16)),
                            offsets(term, len(own)), np.array([p[1] for p in postings], dtype=np.uint16), np.array([p[2] for p in postings])))
    parts = [tuple(np.array([number[t] for t in side], dtype=np.int32) for side in question_and_answer(text or "")) for _, text in rows]
    return Index([r[0] for r in rows], parts, names, shards)


def overlap(part: list[int], passage: np.ndarray, shingles: dict) -> float:
    """Share of a part's distinct shingles that the passage holds; an empty part is held."""
    if not part:
        return 1.0
    n = min(SHINGLE, len(part))
    if n not in shingles:
        p = passage.tolist()
        shingles[n] = {tuple(p[i:i + n]) for i in range(len(p) - n + 1)}
    own = {tuple(part[i:i + n]) for i in range(len(part) - n + 1)}
    return len(own & shingles[n]) / len(own)


def search(index: Index, shard: Shard, ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(document, first word, item, score) of the passages of the documents ids[bounds[d]:bounds[d + 1]]."""
    s, nb = shard.stride, len(shard.least)
    n = np.diff(bounds)
    n_win = np.maximum(1, -(-(n - s) // s))
    first = np.concatenate([[0], np.cumsum(n_win)])
    ids = shard.local(len(index.terms))[ids]
    ptr, val = shard.essential
    needed = np.append(np.diff(ptr) > 0, False)  # term -1 reads the last entry
    hit = np.flatnonzero(needed[ids])
    if not len(hit):
        return
    doc = np.searchsorted(bounds, hit, side="right") - 1
    cell = (hit - bounds[doc]) // s
    off, reps = spread(ptr, ids[hit])
    block, doc, cell = val[off].astype(np.int64), np.repeat(doc, reps), np.repeat(cell, reps)
    keys = [(first[doc] + cell)[cell < n_win[doc]] * nb + block[cell < n_win[doc]],
            (first[doc] + cell - 1)[cell > 0] * nb + block[cell > 0]]
    keys = np.unique(np.concatenate(keys))
    n_terms = len(shard.terms)
    for k in range(0, len(keys), 200_000):
        part = keys[k:k + 200_000]
        wins, at = np.unique(part // nb, return_inverse=True)
        doc = np.searchsorted(first, wins, side="right") - 1
        start = bounds[doc] + (wins - first[doc]) * s
        end = np.minimum(start + 2 * s, bounds[doc + 1])
        size = end - start
        flat = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        term = ids[flat].astype(np.int64)
        pair = np.unique(np.repeat(np.arange(len(wins)), size)[term >= 0] * n_terms + term[term >= 0])
        row, term = pair // n_terms, pair % n_terms
        edge = np.searchsorted(row, np.arange(len(wins) + 1))
        upper = shard.bounds(term, edge)
        good = np.flatnonzero(upper[at, part % nb] >= shard.least[part % nb] * (1 - 1e-5))
        pace = np.cumsum(np.diff(edge)[at[good]]) // CURSORS
        for some in np.split(good, np.flatnonzero(np.diff(pace)) + 1):
            places, size = spread(edge, at[some])
            for p, i, x in shard.pivots(np.repeat(np.arange(len(some)), size), term[places], part[some] % nb):
                w = at[some[p]]
                yield from zip(doc[w].tolist(), (start[w] - bounds[doc[w]]).tolist(), (shard.items[k] for k in i), x.tolist())


def leaks_of(index: Index, texts: list[str | None], terms: Terms) -> list[tuple]:
    """(text's place, item's place, first word, score, question share, answer share), verified, best per pair."""
    per = []
    for t in texts:
        x = np.array(list(map(terms.__getitem__, t.lower().split())), dtype=np.int64) if t else np.array([], dtype=np.int64)
        per.append(x[x != -2])
    ids, bounds = np.concatenate([*per, np.array([], dtype=np.int64)]), np.concatenate([[0], np.cumsum([len(x) for x in per])]).astype(np.int64)
    best = {}
    for shard in index.shards:
        grams = {}
        for d, start, i, score in search(index, shard, ids, bounds):
            passage = per[d][start:start + 2 * shard.stride]
            held = grams.setdefault((d, start), {})
            q, a = (overlap(p.tolist(), passage, held) for p in index.parts[i])
            if q >= OVERLAP and a >= OVERLAP:
                row = (-min(q, a), -score, start, q, a)
                if row < best.get((d, i), (1,)):
                    best[d, i] = row
    return [(d, i, r[2], -r[1], r[3], r[4]) for (d, i), r in sorted(best.items())]


def chunks(column: pa.Array) -> Iterator[tuple[int, list]]:
    """(offset, texts) pieces of a column, of ``CHUNK_CHARS`` or so."""
    held, size, at = [], 0, 0
    for k, t in enumerate(column):
        t = t.as_py()
        held.append(t)
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield at, held
            held, size, at = [], 0, k + 1
    if held:
        yield at, held


def indexes(items: DataFrame, item_id: str, text: str, share: float) -> list:
    """Broadcast indexes, one for each group of items of at most ``GROUP_BYTES`` (or one longer item)."""
    spark = items.sparkSession
    base = items.select(F.col(item_id).alias("id"), F.col(text).cast("string").alias("text")).filter("text is not null")

    def terms_of(batches):
        for b in batches:
            got = [(i, t, n) for i, x in enumerate(b.column(1)) for t, n in Counter(tokens(x.as_py())).items()]
            yield pa.RecordBatch.from_arrays([pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int64())], names=["term", "n"])

    terms = base.mapInArrow(terms_of, "term string, n bigint")
    size, n_items = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    n_groups = max(1, -(-size // GROUP_BYTES))
    dealt = base.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(n_groups)))
    total = terms.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = []
    for g in range(n_groups):
        rows = sorted(((r["id"], r["text"]) for r in dealt.filter(F.col("part") == g).select("id", "text").toLocalIterator()), key=str)
        own = terms.groupBy("term").count()
        vocabulary = {t for _, x in rows for t in tokens(x)}
        if n_groups == 1:
            df = {r["term"]: r["count"] for r in own.toLocalIterator()}
        else:  # document frequencies over all items, of this group's terms
            want = spark.createDataFrame([(t,) for t in sorted(vocabulary)], "term string")
            df = {r["term"]: r["count"] for r in own.join(want, "term").toLocalIterator()}
        if rows and total:
            out.append(spark.sparkContext.broadcast(build_index(rows, df, n_items, total / n_items, share)))
    return out


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """One row for each document and item it holds: ids, first word of the passage, score, overlaps."""
    doc_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = (f"{id_col} {doc_kind}, {item_id} {item_kind}, first_word bigint, score double, "
              "question_overlap double, answer_overlap double")

    def run_with(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            terms = Terms(index.number)
            for b in batches:
                for at, texts in chunks(b.column(1)):
                    got = leaks_of(index, texts, terms)
                    if got:
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array([at + g[0] for g in got])),
                             pa.array([index.ids[g[1]] for g in got], item_type),
                             *(pa.array([g[k] for g in got], kind) for k, kind in ((2, pa.int64()), (3, pa.float64()), (4, pa.float64()), (5, pa.float64())))],
                            names=[id_col, item_id, "first_word", "score", "question_overlap", "answer_overlap"])
        return run

    from pyspark.sql.pandas.types import to_arrow_type
    item_type = to_arrow_type(items.schema[item_id].dataType)
    base = docs.select(id_col, F.col(text).cast("string").alias("_text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for held in indexes(items, item_id, item_text, share):
        out = out.union(base.mapInArrow(run_with(held), schema))
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
          item_text: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; rows stay where they are (no shuffle)."""
    at = docs.columns.index(text)

    def run_with(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            terms = Terms(index.number)
            for b in batches:
                bad = {k + g[0] for k, texts in chunks(b.column(at)) for g in leaks_of(index, texts, terms)}
                yield b.filter(pa.array([k not in bad for k in range(b.num_rows)], pa.bool_())) if bad else b
        return run

    for held in indexes(items, item_id, item_text, share):
        docs = docs.mapInArrow(run_with(held), docs.schema)
    return docs
