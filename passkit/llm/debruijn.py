"""Removal of long repeated passages over a compacted de Bruijn graph of words.

The k-word windows (k = 35) of all texts are the edges of a de Bruijn graph.
They are never moved one by one: each text is cut into runs of windows that
share a minimiser (the least hash among the ``M``-word pieces inside a
window), as equal windows have equal minimisers and so meet in one place.

1. A run's minimiser is counted; runs whose minimiser occurs once hold no repeat.
2. Runs with equal content (all their windows in order) repeat as a whole.
3. Where runs with one minimiser differ, those that occur once are taken
   apart, and their windows are compared with each other and with one run of
   each repeated content.
4. Repeated runs that follow each other in a text are edges between runs. An
   edge that all occurrences of both its ends go through does not branch;
   such paths are compacted into one span (joins for the edges and
   their counts, an ordered pass over each text's own runs for the paths).
5. Every span and every window taken apart is read again at its source
   coordinates and confirmed by a 128-bit digest of its words, shared by
   two places at least.

Steps 1 to 4 use 64-bit hashes; a false match there is refused by step 5.

Defined results: each row is a document, also when rows are equal (their
windows then repeat); null texts have no words; a text below k words loses
nothing; the same window twice in one text counts as a repeat; null ids are
kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from passkit.llm.base import small, stored

K = 35
M = 10
BASE = 0x9E3779B97F4A7C15
_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(1 << n.bit_length(), b, dtype=np.uint64)
            x[0] = 1
            made.append(np.cumprod(x))
        _powers = tuple(made)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def runs(words: list[bytes], k: int = K, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, content, first window, number of windows) of a text's runs."""
    n = len(words)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in words], dtype=np.uint64)
    up, down = powers(n + 1)
    s = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * up[:n], out=s[1:])
    piece = mix((s[m:] - s[:-m]) * down[:n - m + 1])
    low = np.lib.stride_tricks.sliding_window_view(piece, k - m + 1).argmin(axis=1) + np.arange(n - k + 1)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    size = np.diff(np.append(first, n - k + 1))
    content = mix((s[first + size + k - 1] - s[first]) * down[first] + size.astype(np.uint64) * np.uint64(BASE))
    return piece[low[first]], content, first, size


def with_runs(docs: DataFrame, k: int, m: int) -> DataFrame:
    """(id, th, a: minimiser, c: content, first, n) for every run of the rows (id, th, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows, parts, at):
            cols = [np.concatenate(c) for c in zip(*parts)]
            take = pa.array(np.repeat(np.array(at), [len(p[0]) for p in parts]))
            return pa.RecordBatch.from_arrays(
                [rows.column(0).take(take), rows.column(1).take(take), pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)),
                 pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32))], names=["id", "th", "a", "c", "first", "n"])

        for b in batches:
            parts, at, size = [], [], 0
            for i, t in enumerate(b.column(2)):
                t = t.as_py()
                words = t.encode("utf-8", "surrogatepass").split() if t else []
                if len(words) >= k:
                    parts.append(runs(words, k, m))
                    at.append(i)
                    size += len(parts[-1][0])
                    if size >= 100_000:
                        yield batch(b, parts, at)
                        parts, at, size = [], [], 0
            if parts:
                yield batch(b, parts, at)

    return docs.mapInArrow(run, f"id {kind}, th bigint, a bigint, c bigint, first int, n int")


def repeated_runs(docs: DataFrame, k: int, m: int) -> tuple[DataFrame, DataFrame]:
    """Runs (id, th, c, first, n) that repeat as a whole, and (id, th, a, first, n, own) to take apart.

    ``own`` is false for the one run that stands for a repeated content.
    """
    rows = stored(with_runs(docs, k, m), "runs")
    many = rows.groupBy("a").agg(F.count(F.lit(1)).alias("k"), (F.min("c") != F.max("c")).alias("mixed")).filter("k > 1")
    rows = stored(rows.join(small(many.select("a", "mixed")), "a"), "repeats")
    mixed = rows.filter("mixed")
    content = mixed.groupBy("a", "c").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("id", "th", "first", "n")).alias("source"))
    content = stored(content, "contents")
    whole = rows.filter("not mixed").select("id", "th", "c", "first", "n").union(
        mixed.join(small(content.filter("k > 1").select("a", "c")), ["a", "c"], "left_semi").select("id", "th", "c", "first", "n"))
    apart = content.select("a", "source.*", (F.col("k") == 1).alias("own"))
    return whole, apart.select("id", "th", "a", "first", "n", "own")


def spans(whole: DataFrame) -> DataFrame:
    """Repeated runs to (id, th, first, n): the compacted paths' occurrences."""
    text = Window.partitionBy("id", "th").orderBy("first")
    w = whole.groupBy("id", "th", "first", "n", "c").agg(F.count(F.lit(1)).alias("rows"))  # over 1 for equal documents
    w = stored(w.withColumns({"p": F.lag("c").over(text), "p_end": F.lag(F.col("first") + F.col("n")).over(text)}).withColumn(
        "p", F.when(F.col("p_end") == F.col("first"), F.col("p"))).drop("p_end"), "edges")
    node = w.groupBy("c").agg(F.sum("rows").alias("m"))
    edge = w.filter("p is not null").groupBy("p", "c").agg(F.sum("rows").alias("m"))
    straight = edge.join(node, ["c", "m"]).join(node.withColumnRenamed("c", "p"), ["p", "m"]).select("p", "c", F.lit(True).alias("on"))
    w = w.join(small(stored(straight, "straight")), ["p", "c"], "left")
    path = F.sum(F.when(F.col("on"), 0).otherwise(1)).over(text)
    return w.withColumn("path", path).groupBy("id", "th", "path").agg(
        F.min("first").alias("first"), F.sum("n").cast("int").alias("n")).drop("path")


def packed(docs: DataFrame) -> DataFrame:
    """(id, th, z): texts compressed, for the joins that have to move them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = [None if t is None else squeeze(t.encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], names=["id", "th", "z"])

    return docs.mapInArrow(run, T.StructType([docs.schema["id"], docs.schema["th"], T.StructField("z", T.BinaryType())]))


def unpacked(z: bytes | None) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(z).split() if z else []


def _by_document(rows: DataFrame, *cols: str) -> DataFrame:
    """One row per document with its places, each once however many equal rows there are; bounded by the document's own length."""
    return rows.groupBy("id", "th").agg(F.collect_set(F.struct(*cols)).alias("places")).withColumnsRenamed({"id": "_id", "th": "_th"})


def _with_places(texts: DataFrame, places: DataFrame, how: str) -> DataFrame:
    return texts.join(places, texts["id"].eqNullSafe(places["_id"]) & (texts["th"] == places["_th"]), how).drop("_id", "_th")


def confirmed(texts: DataFrame, whole: DataFrame, apart: DataFrame, k: int) -> DataFrame:
    """(id, th, first, n): the windows first .. first + n - 1 are repeated, verified on their words."""
    todo = spans(whole).select("id", "th", "first", "n", F.lit(False).alias("apart"), F.lit(True).alias("own")).union(
        apart.select("id", "th", "first", "n", F.lit(True), "own"))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests of spans as wholes, and of every window of the runs taken apart."""
        for b in batches:
            at, cols = [], ([], [], [], [], [])
            for i in range(b.num_rows):
                words = unpacked(b.column(2)[i].as_py())
                for p in b.column(3)[i].as_py():
                    pieces = [(x, 1) for x in range(p["first"], p["first"] + p["n"])] if p["apart"] else [(p["first"], p["n"])]
                    for first, n in pieces:
                        d = hashlib.blake2b(b" ".join(words[first:first + n + k - 1]), digest_size=16).digest()
                        at.append(i)
                        for c, v in zip(cols, (first, n, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), p["own"])):
                            c.append(v)
                if len(at) > 50_000 or at and i == b.num_rows - 1:
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(
                        pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())))],
                        names=["id", "th", "first", "n", "d1", "d2", "own"])
                    at, cols = [], ([], [], [], [], [])

    places = _with_places(texts, _by_document(todo, "first", "n", "apart", "own"), "inner").mapInArrow(
        run, f"id {kind}, th bigint, first int, n int, d1 bigint, d2 bigint, own boolean")
    places = stored(places, "places")
    # a run that stands for a repeated content stands for two places at least
    twice = places.groupBy("d1", "d2").agg(F.sum(F.when(F.col("own"), 1).otherwise(2)).alias("k")).filter("k > 1").select("d1", "d2")
    return places.filter("own").join(small(stored(twice, "twice")), ["d1", "d2"], "left_semi").select("id", "th", "first", "n")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, m: int = M) -> DataFrame:
    """(id, n_words, n_removed, text): every row, its text the words left over, joined by one space."""
    if not 1 <= m <= k:
        raise ValueError("the piece must be no longer than the window")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("th"), "text")
    texts = packed(rows)
    places = confirmed(texts, *repeated_runs(rows, k, m), k)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                n, gone, left = [], [], []
                for z, held in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = unpacked(z)
                    if held:
                        edge = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(edge, [p["first"] for p in held], 1)
                        np.add.at(edge, [p["first"] + p["n"] + k - 1 for p in held], -1)
                        keep = np.cumsum(edge)[:-1] == 0
                        kept = [w for w, y in zip(words, keep.tolist()) if y]
                    else:
                        kept = words
                    n.append(len(words))
                    gone.append(len(words) - len(kept))
                    left.append(b" ".join(kept))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.binary())],
                                                 names=["id", "n_words", "n_removed", "left"])

    out = _with_places(texts, _by_document(places, "first", "n"), "left").select("id", "z", "places")
    return out.mapInArrow(run, f"id {kind}, n_words bigint, n_removed bigint, left binary").select(
        F.col("id").alias(id_col), "n_words", "n_removed", F.col("left").cast("string").alias("text"))
