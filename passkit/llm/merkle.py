"""Merkle dataset manifest over concatenated level strings.

A leaf is the SHA-256 of its row's fields, each written as ``-`` for null or
as its number of UTF-8 bytes, ``:`` and the value. The leaves of a group,
ascending by id, are cut into aligned blocks of ``2 ** BLOCK_LEVELS``. A block
keeps each of its levels as one string of hex digests, and substrings of
fixed width do the rest: two digests side by side are hashed to their
parent, and the digest flanking a position is its sibling. A last node without a
neighbour becomes its own hash, as long as its group has several nodes. The roots of
the blocks are the leaves of the next tier, until one node is left for each
group, its subroot; the subroots, ascending by group, go through the same
tiers to the root. Proofs come down again: a block's path above it is joined
once, on a table of blocks, and handed to all its rows.

Blocks hold at most ``2 ** BLOCK_LEVELS`` rows of any group, and positions come
from range-partitioned prefix counts, so a group of a third of all rows is
spread like any other. Only digests and ids are moved, never the fields.

Defined results: every row is a leaf, repeated or not; rows of a group with
equal ids are ordered by digest; null ids come first, and the null group
comes first; an empty text is a field of 0 bytes; a group of one row has its leaf
as subroot, and one group alone has its subroot as root; an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passkit.llm.base import stored
from passkit.operators.ordering import RANGE_ROWS, join_back, ranged_index

BLOCK_LEVELS = 8
WIDTH = 64  # hex digits of a digest


def field(value: Column) -> Column:
    """``-``, or byte count, ``:`` and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(fields: Sequence[Column]) -> Column:
    """The leaf of a row with these fields."""
    return F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256)


def _joined(digests: Column) -> Column:
    """One level: its digests as one string of hex digits, kept as bytes so that a substring is found by its place."""
    return F.array_join(digests, "").cast("binary")


def _at(level: Column, k: Column, n: int = 1) -> Column:
    """``n`` digests of a level from number k on (fewer, or none, at its end)."""
    return F.substring(level, (k * WIDTH + 1).cast("int"), F.lit(n * WIDTH))


def _parents(level: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / (2 * WIDTH)).cast("int") - 1)
    return _joined(F.transform(pairs, lambda k: F.sha2(_at(level, k * 2, 2), 256)))


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """(g, block, more, held, levels, top) from (g, pos, node, item); ``more`` says whether the group has other blocks."""
    size = nodes.groupBy("g").agg((F.max("pos") + 1).alias("n"))
    held = nodes.groupBy("g", F.call_function("shiftright", "pos", F.lit(levels)).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "node", "item"))).alias("held"))
    rows = join_back(held, size, ["g"]).withColumn("more", F.col("n") > (1 << levels))
    height = F.when(F.col("more"), levels).when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    first = F.array(_joined(F.transform("held", lambda x: x["node"])))
    rows = rows.withColumn("levels", F.aggregate(steps, first, lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1))))))
    return rows.select("g", "block", "more", "held", "levels", F.element_at("levels", -1).cast("string").alias("top"))


def _tiers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Block tables from (g, pos, node, item), each tier's tops being the nodes of the next, until no group has two blocks."""
    tiers = []
    while True:
        tiers.append(stored(_blocks(nodes, levels), "merkle-blocks"))
        if tiers[-1].filter("more").isEmpty():
            return tiers
        nodes = tiers[-1].filter("more").select("g", F.col("block").alias("pos"), F.col("top").alias("node"), F.lit(None).cast("string").alias("item"))


def _tops(tiers: list[DataFrame]) -> DataFrame:
    """(g, top): the one node left of every group, from the tier where the group has a single block."""
    out = None
    for t in tiers:
        own = t.filter(~F.col("more")).select("g", "top")
        out = own if out is None else out.union(own)
    return out


def _path(levels: Column, pos: Column, size: int) -> Column:
    """Siblings of a position in its block, lowest level first: (sibling or '', whether it stands left)."""
    place = pos.bitwiseAND(size - 1)

    def step(level, k):
        here = F.call_function("shiftright", place, k)
        return F.struct(_at(level, here.bitwiseXOR(F.lit(1))).cast("string").alias("sibling"), (here.bitwiseAND(F.lit(1)) == 1).alias("left"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), step)


def _descend(tiers: list[DataFrame], above: DataFrame, levels: int, make: Callable[[Column, Column], Column]) -> DataFrame:
    """One row for each node of the lowest tier: ``make(node, path)`` and the columns of ``above`` (g, path, ...).

    ``above`` has what lies above each group; the blocks of a group with
    more of them get theirs from the tier above.
    """
    own = [c for c in above.columns if c not in ("g", "path")]
    down = None
    for k, blocks in reversed(list(enumerate(tiers))):
        over = above.withColumn("block", F.lit(0).cast("bigint"))
        over = join_back(over, blocks.filter(~F.col("more")).select("g"), ["g"], "left_semi") if len(tiers) > 1 else over
        if down is not None:
            over = over.select("g", "block", "path", *own).union(down.select("g", F.col("pos").alias("block"), "path", *own))
        rows = join_back(blocks, over, ["g", "block"])
        if k:
            entry = F.inline(F.transform("held", lambda x: F.struct(
                x["pos"].alias("pos"), F.concat(_path(F.col("levels"), x["pos"], 1 << levels), F.col("path")).alias("path"))))
            down = stored(rows.select("g", *own, entry), "merkle-paths")
        else:
            return rows.select("g", *own, F.inline(F.transform("held", lambda x: make(
                x, F.concat(_path(F.col("levels"), x["pos"], 1 << levels), F.col("path"))))))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.when(s["left"], F.concat(s["sibling"], h)).otherwise(
        F.concat(h, s["sibling"])).cast("binary"), 256))


def proof_text(path: Column) -> Column:
    """The siblings that exist, from the leaf upwards, as one string."""
    return F.array_join(F.transform(path, lambda s: s["sibling"]), "")


def manifest(docs: DataFrame, fields: Sequence[str], id_col: str = "doc_id", group: str = "lang", shown: Column | None = None,
             levels: int = BLOCK_LEVELS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(id, group, leaf, shown, subroot, root, proof, folded) for every row of ``docs``.

    ``proof`` is the string of sibling digests up to the root. ``shown`` is the
    digest that a holder of the row presents (default: the leaf), and
    ``folded`` the root that it leads to with the row's siblings; the row is
    verified if that is ``root``.
    """
    leaf = digest([F.col(c) for c in fields])
    rows = stored(docs.select(F.col(group).cast("string").alias("g"), F.col(id_col).alias("id"), leaf.alias("node"),
                              (leaf if shown is None else shown).alias("shown")), "merkle-leaves")
    placed = ranged_index(rows, ["g"], ["id", "node", "shown"], "pos", range_rows)
    trees = _tiers(placed.select("g", "pos", "node", F.struct("id", "shown").alias("item")), levels)
    tops = stored(_tops(trees), "merkle-subroots")
    over = ranged_index(tops, [], ["g"], "pos", range_rows).select(F.lit(0).alias("g"), "pos", F.col("top").alias("node"),
                                                                    F.struct(F.col("g").alias("group")).alias("item"))
    over = stored(over, "merkle-crown")  # g is a column of it, no constant that joins would lose
    crown = _tiers(over, levels)
    root = _tops(crown).first()
    none = F.array().cast("array<struct<sibling:string,left:boolean>>")
    start = docs.sparkSession.createDataFrame([(0, root["top"] if root else None)], "g int, root string").withColumn("path", none)
    above = _descend(crown, start, levels, lambda x, path: F.struct(
        x["item"]["group"].alias("group"), x["node"].alias("subroot"), path.alias("path")))
    above = stored(above.select(F.col("group").alias("g"), "path", "subroot", "root"), "merkle-groups")
    out = _descend(trees, above, levels, lambda x, path: F.struct(
        x["item"]["id"].alias("id"), x["node"].alias("leaf"), x["item"]["shown"].alias("shown"),
        proof_text(path).alias("proof"), fold(x["item"]["shown"], path).alias("folded")))
    return out.select(F.col("id").alias(id_col), F.col("g").alias(group), "leaf", "shown", "subroot", "root", "proof", "folded")
