"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: every source's share of all words by weight, held at ``REPEATS``
   times its size, the excess shared again by weight until none is above.
2. Blocks: the documents of a source, one after the other by id, are a stream of
   words, cut into blocks of ``BLOCK_WORDS`` words at most and of
   nearly equal length (``LEAST_BLOCKS`` of them at least, so that a small source
   also comes near its target). A source's quota is the number of block
   copies that comes nearest to its target.
3. Splitting tree: all quotas are dealt to output shards of ``SHARD_BLOCKS`` copies.
   Each node halves its shards; how many copies of each source go
   left is a multivariate hypergeometric draw (a chain of exact univariate draws by inversion),
   so every shard has the mixture that drawing all copies without replacement would give it,
   all quotas are met exactly, and no block is looked at.
4. Draw: the blocks of a source are permuted for each copy by hash; the shards take
   disjoint stretches of that order, as long as their quotas, and shuffle what they took locally.

All of it is DataFrame functions; random numbers are hashes of the seed, so reruns
agree and a lost task gives the same rows again. Prefix sums and permutations run over ranges of
rows, so a source of a third of all words is spread like any other. Rows with one entry for each
source exist for the nodes of the tree only.

Defined results: every row is a document; a null or blank text has size 0 and gives no words; rows
equal in source, id and text share what is taken of them in any order; the null source is a source of its own,
the last one; a source without words has target 0; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passkit.llm.base import GAP_CHARS, WORD_GAP, small, stored, words_of
from passkit.operators.ordering import RANGE_ROWS, join_back, ranged_index, ranged_sums

WEIGHTS = (1, 2, 3)  # of the sources in order, again and again
REPEATS = 3
BLOCK_WORDS = 1024
LEAST_BLOCKS = 256
SHARD_BLOCKS = 4096
SEED = 13


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    line = F.trim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    return F.when(line == "", 0).otherwise(F.size(F.split(line, WORD_GAP))).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, number, target) from (source, source_size); ``number`` counts the sources by code point, null last.

    Shares beyond ``repeats`` times a source's size are given out again, round by round;
    the driver sees the level of a round only.
    """
    order = ranged_index(sizes.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "number").drop("_null")
    rows = stored(order.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights)).cast("int"))), "mix-sources")
    held = F.col("source_size") * repeats
    level = lambda x: F.lit(float(x)) * F.col("weight")
    whole = rows.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words = whole["words"] or 0
    now = words / whole["weight"] if whole["weight"] else 0.0
    while True:
        full = held < level(now)
        got = rows.agg(F.sum(F.when(full, held)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        new = (words - (got["held"] or 0)) / got["weight"] if got["weight"] else now
        if new == now:
            break
        now = new
    return rows.withColumn("target", F.when(held < level(now), held.cast("double")).otherwise(level(now))).drop("weight")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` found once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _uniform(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are among the ``marked``, by inversion of ``u`` in [0, 1).

    Probabilities are followed from the mode both ways, each from its neighbour, over ten standard
    deviations and twenty more; what lies beyond has less weight than a double can add.
    """
    big, k_all, n_all = (c.cast("double") for c in (total, marked, drawn))
    share = k_all / F.greatest(big, F.lit(1.0))
    spread = F.sqrt(F.greatest(n_all * share * (1 - share) * (big - n_all) / F.greatest(big - 1, F.lit(1.0)), F.lit(0.0)))
    low, high = F.greatest(F.lit(0).cast("bigint"), drawn + marked - total), F.least(drawn, marked)
    mode = F.greatest(low, F.least(high, F.floor((n_all + 1) / (big + 2) * (k_all + 1)).cast("bigint")))
    reach = (F.ceil(spread * 10) + 20).cast("bigint")
    p = F.struct(big.alias("all"), k_all.alias("marked"), n_all.alias("drawn"), u.alias("u"), mode.alias("mode"),
                 F.greatest(low, mode - reach).alias("low"), F.least(high, mode + reach).alias("high"))

    def draw(p):
        none = F.array().cast("array<bigint>")
        ups = F.when(p["high"] > p["mode"], F.sequence(p["mode"], p["high"] - 1)).otherwise(none)
        downs = F.when(p["low"] < p["mode"], F.sequence(p["mode"], p["low"] + 1)).otherwise(none)

        def up(w, k):  # weight of k + 1 from that of k
            return w * ((p["marked"] - k) / (k + 1)) * ((p["drawn"] - k) / (p["all"] - p["marked"] - p["drawn"] + k + 1))

        def down(w, k):  # weight of k - 1 from that of k
            return w * (k / (p["marked"] - k + 1)) * ((p["all"] - p["marked"] - p["drawn"] + k) / (p["drawn"] - k + 1))

        one, zero = F.lit(1.0), F.lit(0.0)

        def summed(ks, step):
            return F.aggregate(ks, F.struct(one.alias("w"), zero.alias("s")),
                               lambda a, k: _bound(step(a["w"], k), lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s"))), lambda a: a["s"])

        def search(sums):
            goal = p["u"] * (1 + sums["up"] + sums["down"])

            def walk(ks, step, before, move):
                start = F.struct(one.alias("w"), before.alias("s"), F.lit(None).cast("bigint").alias("x"))
                return F.aggregate(ks, start, lambda a, k: F.when(a["x"].isNotNull(), a).otherwise(_bound(
                    step(a["w"], k), lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s"), F.when(a["s"] + w > goal, k + move).alias("x")))),
                    lambda a: a["x"])

            return F.when(goal < 1, p["mode"]).otherwise(F.coalesce(
                walk(ups, up, one, 1), walk(downs, down, 1 + sums["up"], -1), p["mode"]))

        return _bound(F.struct(summed(ups, up).alias("up"), summed(downs, down).alias("down")), search)

    return _bound(p, draw)


def split_quotas(quotas: DataFrame, shards: int, total: int, seed: int = SEED) -> DataFrame:
    """(shard, number, n): the quotas (number from 0 on, quota), ``total`` together, over shards of equal size (or one more)."""
    def filled(shard):  # copies in the shards before
        return F.floor(shard * F.lit(total) / F.lit(shards)).cast("bigint") if total * shards >= 1 << 62 else \
            F.call_function("div", shard * F.lit(total), F.lit(shards))

    root = quotas.agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "quota"))), lambda x: x["quota"]).alias("q"))
    nodes = root.select(F.lit(0).cast("bigint").alias("lo"), F.lit(shards).cast("bigint").alias("hi"), "q")
    for _ in range((shards - 1).bit_length()):
        lo, hi, q = F.col("lo"), F.col("hi"), F.col("q")
        mid = F.shiftright(lo + hi, 1)
        state = F.struct((filled(hi) - filled(lo)).alias("total"), (filled(mid) - filled(lo)).alias("left"), F.array().cast("array<bigint>").alias("xs"))

        def draw(a, i):
            marked = F.get(q, i)
            x = hypergeometric(a["total"], marked, a["left"], _uniform(F.lit(seed), lo, hi, i))
            return _bound(x, lambda x: F.struct((a["total"] - marked).alias("total"), (a["left"] - x).alias("left"), F.concat(a["xs"], F.array(x)).alias("xs")))

        drawn = nodes.withColumn("mid", mid).withColumn("left", F.when(hi - lo > 1, F.aggregate(
            F.sequence(F.lit(0), F.size(q) - 1), state, draw, lambda a: a["xs"])))
        both = F.array(F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("q")),
                       F.struct(F.col("mid").alias("lo"), "hi", F.zip_with("q", "left", lambda a, b: a - b).alias("q")))
        nodes = drawn.select(F.inline(F.when(hi - lo > 1, both).otherwise(F.array(F.struct("lo", "hi", "q")))))
    return nodes.select(F.col("lo").alias("shard"), F.posexplode("q").alias("number", "n")).filter("n > 0")


@dataclass
class Mix:
    """``documents``: (id, source, size, source_size, target, th, key) of every row; ``spans``: (shard, place, id, th, key, source, copy, first, n),
    the stretches of words in their order, ``first`` counting a document's words from 0; (source, key) names a row with words."""

    documents: DataFrame
    spans: DataFrame
    sources: DataFrame
    shards: int

    def taken(self) -> DataFrame:
        """``documents`` and the number of words the mix takes of each, repeats counted."""
        n = self.spans.groupBy("source", "key").agg(F.sum("n").alias("taken"))
        some = join_back(self.documents.filter("size > 0"), n, ["source", "key"], "left")
        return some.withColumn("taken", F.coalesce("taken", F.lit(0).cast("bigint"))).union(
            self.documents.filter("size = 0").withColumn("taken", F.lit(0).cast("bigint")))

    def texts(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """(shard, place, id, source, copy, text): the mixed text, each span's words joined by spaces."""
        t = F.col(text).cast("string")
        held = docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("th"), t.alias("_text")).dropDuplicates(["id", "th"])
        rows = join_back(self.spans, held, ["id", "th"])
        return rows.select("shard", "place", "id", "source", "copy", F.array_join(F.slice(
            words_of(F.col("_text")), (F.col("first") + 1).cast("int"), F.col("n").cast("int")), " ").alias("text"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
        repeats: int = REPEATS, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED,
        range_rows: int = RANGE_ROWS) -> Mix:
    """The mixture of all ``docs``. Starts jobs: sizes, targets, positions and block copies are written to the shared folder."""
    t = F.col(text).cast("string")
    sized = stored(docs.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), n_words(t).alias("size"), F.xxhash64(t).alias("th")), "mix-sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    size, n = F.col("source_size"), F.col("n_blocks")
    div = lambda a, b: F.call_function("div", a, b)
    sources = sources.withColumn("n_blocks", F.least(size, F.greatest(F.ceil(size / block_words), F.lit(LEAST_BLOCKS))).cast("bigint"))
    quota = F.least(n * repeats, F.floor(F.col("target") * n / size + 0.5))
    sources = sources.withColumn("quota", F.when(size > 0, quota).otherwise(0).cast("bigint"))
    # the first ``longer`` blocks have a word more than the others
    sources = stored(sources.withColumns({"short": F.when(n > 0, div(size, n)), "longer": F.when(n > 0, size % n)}), "mix-quotas")
    total = sources.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, -(-total // shard_blocks))

    placed = ranged_sums(sized.filter("size > 0"), ["source"], ["id", "size", "th"], {"end": F.col("size")}, range_rows)
    placed = placed.withColumn("key", F.col("end") - F.col("size"))
    placed = stored(join_back(placed, sources.select("source", "number", "n_blocks", "quota", "short", "longer"), ["source"]), "mix-placed")
    short, longer, key = F.col("short"), F.col("longer"), F.col("key")

    def block_of(word):
        return F.when(word < longer * (short + 1), div(word, short + 1)).otherwise(longer + div(word - longer * (short + 1), short))

    begins = F.col("block") * short + F.least(F.col("block"), longer)
    ends = begins + short + F.when(F.col("block") < longer, 1).otherwise(0)
    pieces = placed.withColumn("block", F.explode(F.sequence(block_of(key), block_of(F.col("end") - 1))))
    pieces = pieces.withColumns({"from": F.greatest(key, begins), "to": F.least(F.col("end"), ends), "opens": key <= begins})
    # the piece with a block's first word stands for the block
    copies = F.call_function("div", F.col("quota") + F.col("n_blocks") - 1, F.col("n_blocks"))
    drawn = pieces.filter("opens and quota > 0").select("number", "block", "n_blocks", "quota", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)).alias("copy"))
    drawn = drawn.withColumn("lot", F.md5(F.concat_ws("/", F.lit(str(seed)), "number", "copy", "block").cast("binary")))
    drawn = ranged_index(drawn, ["number", "copy"], ["lot", "block"], "rank", range_rows)
    drawn = drawn.withColumn("draw", F.col("copy") * F.col("n_blocks") + F.col("rank")).filter("draw < quota")

    dealt = stored(split_quotas(sources.select("number", "quota"), shards, total, seed), "mix-shards")
    by_shard = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("since", F.coalesce(F.sum("n").over(by_shard), F.lit(0)))
    stride = F.greatest(F.lit(1).cast("bigint"), div(F.col("quota"), F.lit(shards)))
    dealt = dealt.join(sources.select("number", "quota"), "number").select(
        "number", "shard", "since", "n", F.explode(F.sequence(div(F.col("since"), stride), div(F.col("since") + F.col("n") - 1, stride))).alias("bucket"))
    taken = drawn.withColumn("bucket", div(F.col("draw"), stride)).join(small(dealt), ["number", "bucket"]).filter("draw >= since and draw < since + n")
    taken = taken.withColumn("order", F.md5(F.concat_ws("/", F.lit(f"{seed}s"), "shard", "number", "draw").cast("binary")))
    local = Window.partitionBy("shard").orderBy("order", "number", "draw")
    taken = stored(taken.withColumn("place", F.row_number().over(local)).select("number", "block", "copy", "shard", "place"), "mix-taken")
    spans = pieces.select("number", "block", "source", "id", "th", "key", (F.col("from") - key).alias("first"), (F.col("to") - F.col("from")).alias("n")).join(
        taken, ["number", "block"]).select("shard", "place", "id", "th", "key", "source", "copy", "first", "n")
    known = ["id", "source", "size", "th", "key"]
    rows = placed.select(*known).union(sized.filter("size = 0").withColumn("key", F.lit(0).cast("bigint")).select(*known))
    rows = join_back(rows, sources.select("source", "source_size", "target"), ["source"])
    return Mix(rows, spans, sources, shards)
