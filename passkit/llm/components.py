"""Connected components of an edge table, by alternating large-star and small-star joins.

Every step is a join or an aggregation keyed by node, so no task holds a
whole component; each round's edges go to the shared folder. Before the
first round, every partition replaces its edges by stars of its own
(union-find), which needs no more memory than the partition's edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passkit.llm.base import stored


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a[i], b[i]) and the smallest node each one reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a):]
    parent = np.arange(len(nodes))
    while True:
        low = np.minimum(parent[u], parent[v])
        new = parent.copy()
        np.minimum.at(new, parent[u], low)
        np.minimum.at(new, parent[v], low)
        while True:  # pointer jumping
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == parent).all():
            return nodes, nodes[parent]
        parent = new


def _contract(batches: Iterator[pa.RecordBatch], rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Stars instead of edges, for every ``rows`` edges or so."""
    def flush(held):
        node, root = roots(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        far = node != root
        return pa.RecordBatch.from_arrays([pa.array(root[far]), pa.array(node[far])], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
        if n >= rows:
            yield flush(held)
            held, n = [], 0
    if held:
        yield flush(held)


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: non-null bigint) to (node, root): every node of an edge and the smallest it reaches.

    Self-loops and repeated edges do no harm; an empty table gives an empty one.
    """
    cur = stored(edges.select("a", "b").mapInArrow(_contract, "a bigint, b bigint"), "edges")
    seen = None
    while True:
        both = cur.filter("a <> b").select("a", "b").union(cur.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node are linked to the least of its neighbours and itself
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the others below a node are linked to the least below it (edges now point down)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                            F.col("m").alias("b")).filter("a <> b").distinct()
        nxt = stored(small.select(F.col("b").alias("a"), F.col("a").alias("b")), "edges")
        mark = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, cur = mark, nxt
    return nxt.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        nxt.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
