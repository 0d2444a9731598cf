"""SimHash near-duplicates, found with BK-trees.

Fingerprints: 64 bits over the XXH64 hashes of word shingles. Links: two
fingerprints differ in at most ``radius`` bits. The distinct fingerprints
are dealt to shards so that any linked pair shares at least one shard: the
64 bits are cut into ``radius + 2`` blocks, at least two blocks of a linked
pair are equal, and each pair of blocks with its bits names a shard. Every
shard with two or more fingerprints is a BK-tree (children keyed by their
Hamming distance to the parent) that is searched along the edges within the
radius. Shards travel to their queries through the shuffle, as broadcasting
all shard trees would compare all pairs. A shard above ``TREE_MAX``
fingerprints is cut into several trees, and its queries go to each of them.

Defined results: a null text or one without words has fingerprint zero and
links like any other; equal rows and equal texts share a fingerprint; a
null id never becomes a component's name unless all its ids are null; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passkit.llm.base import stored
from passkit.llm.components import components, roots

SHINGLE = 4
RADIUS = 4
SEED = 42
TREE_MAX = 8192
LEAF = 24


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash; a bit is set if it is set in over half of the shingle hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower: A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    start = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b - 1], SEED) for a, b in zip(start, start[shingle:])], dtype="<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp holds the 64 bits as a bigint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of ``radius + 2`` blocks that cover 64 bits."""
    n = radius + 2
    cut = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def _within(points: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (point place, query place) of a BK-tree over ``points``, searched by all ``queries`` at once.

    A node is taken as the tree's root, the rest fall into its children by
    distance, and each child gets the queries whose distance to the root is
    within the radius of the edge. Small children are compared directly.
    """
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        p, q = todo.pop()
        if len(p) <= LEAF:
            near = np.bitwise_count(points[p][:, None] ^ queries[q][None, :]) <= radius
            i, j = near.nonzero()
            yield p[i], q[j]
            continue
        root, p = p[0], p[1:]
        dp = np.bitwise_count(points[p] ^ points[root]).astype(np.int16)
        dq = np.bitwise_count(queries[q] ^ points[root]).astype(np.int16)
        hit = q[dq <= radius]
        yield np.full(len(hit), root), hit
        for d in np.unique(dp):
            sub = q[np.abs(dq - d) <= radius]
            if len(sub):
                todo.append((p[dp == d], sub))


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (tree, part, home, fp) in the order of (tree, part); yields the links as stars."""
        rest = None
        for b in batches:
            cur = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if not cur.num_rows:
                continue
            tree, part = cur["tree"].to_numpy(), cur["part"].to_numpy()
            new = np.flatnonzero((tree[1:] != tree[:-1]) | (part[1:] != part[:-1])) + 1
            last = new[-1] if len(new) else 0
            rest = cur.slice(last)
            if last:
                yield links(cur.slice(0, last), new[:-1])
        if rest is not None and rest.num_rows:
            yield links(rest, np.array([], dtype=np.int64))

    def links(t: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        fp, home = t["fp"].to_numpy().view(np.uint64), t["home"].to_numpy()
        bounds = np.concatenate([[0], new, [len(fp)]])
        size = np.diff(bounds)
        a, b = [], []
        two = bounds[:-1][size == 2]  # most trees: one pair
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        near = near[home[near] | home[near + 1]]
        a.append(fp[near])
        b.append(fp[near + 1])
        for s, n in zip(bounds[:-1][size > 2], size[size > 2]):
            x, own = fp[s:s + n], home[s:s + n]
            points = x[own]
            u, v = np.array([], dtype=np.uint64), np.array([], dtype=np.uint64)
            for p, q in _within(points, x, radius):
                far = points[p] != x[q]
                u, v = np.concatenate([u, points[p][far]]), np.concatenate([v, x[q][far]])
                if len(u) > 4 * n:  # keeps what a tree holds in proportion to its size
                    u, v = roots(u, v)
            if len(u):
                v, u = roots(u, v)
                a.append(u[u != v])
                b.append(v[u != v])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp bigint) to edges (a, b) that connect all within the radius.

    Not all pairs: a tree returns stars that connect what its pairs connect.
    """
    cut = blocks(radius)
    shards = []
    for k, (i, j) in enumerate(combinations(range(len(cut)), 2)):
        bits = [F.shiftrightunsigned("fp", cut[x][0]).bitwiseAND(F.lit((1 << cut[x][1]) - 1).cast("long")) for x in (i, j)]
        shards.append(F.shiftleft(bits[0], cut[j][1]).bitwiseOR(bits[1]).bitwiseOR(F.lit(k << 48).cast("long")))
    rows = fps.select("fp", F.explode(F.array(*shards)).alias("tree"))
    size = rows.groupBy("tree").count().filter("count > 1")
    # one tree up to TREE_MAX; above, each fingerprint lives in one part and asks all parts
    n = F.ceil(F.col("count") / TREE_MAX).cast("int")
    rows = rows.join(size, "tree").select(
        "tree", "fp", F.when(n > 1, F.pmod(F.xxhash64("fp"), n).cast("int")).otherwise(0).alias("own"),
        F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    rows = rows.select("tree", "part", (F.col("own") == F.col("part")).alias("home"), "fp")
    rows = rows.repartition("tree", "part").sortWithinPartitions("tree", "part")
    return rows.mapInArrow(_search(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id it reaches)."""
    fp = stored(fingerprints(docs, id_col, text, shingle), "simhash")
    nodes = fp.groupBy("fp").agg(F.min("id").alias("low"))
    root = components(links(nodes.select("fp"), radius))
    named = nodes.join(root, nodes["fp"] == root["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("low").alias("component_id"))
    names = named.select("fp", "root").join(best, "root").select("fp", "component_id")
    return fp.join(names, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
             shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs``, all columns, for each component: the smallest by id, then text hash.

    A null id sorts first. Of rows equal in id and text any one stays.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("th"))
    groups = near_duplicates(docs.select(key.alias("key"), F.col(text).alias("text")), "key", "text", shingle, radius)
    kept = stored(groups.filter(F.col("key") == F.col("component_id")).groupBy("key").agg(
        F.count(F.lit(1)).alias("copies")).select(F.col("key.id").alias("id"), F.col("key.th").alias("th"), "copies"), "kept")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"),
                       F.xxhash64(F.col(text).cast("string")).alias("_th"))
    rows = rows.join(kept, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")))
    if kept.filter("copies > 1").isEmpty():
        return rows.select("_row.*")
    return rows.filter("copies = 1").select("_row.*").union(
        rows.filter("copies > 1").dropDuplicates(["_id", "_th"]).select("_row.*"))
