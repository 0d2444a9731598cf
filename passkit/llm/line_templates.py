"""Line dedup over a log-template tree.

Each line goes down a tree of fixed depth: its number of tokens, then its
first ``DEPTH`` tokens. Tokens with a digit are variable fields from the
start (``<*>``). In a leaf that holds several different lines, a token is
judged by the documents that have it at its place: it is a variable field as
well if they are fewer than ``min_docs``, or fewer than ``SHARE`` of those that
have the line's constant part, which is the count that ``SIMILAR`` of the
line's tokens reach. As that bound grows with the table, the values of a field
stay variable however often each recurs. A line takes the generalised template
if at least ``SIMILAR`` of its tokens stay constant, else it is a template of
its own. A template found in
``min_docs`` documents or more recurs: all its lines go, but for the
first one (smallest id, then text hash, then line number).

The generalisation counts tokens instead of matching lines one after the
other, so its result does not depend on any order. The lines of a leaf meet
in one task, and a leaf too large for that is spread over tasks by token
place. Lines are counted by 128-bit hash before anything
is joined, so a line that a third of all documents hold moves once per task.

Defined results: every row is a document; rows equal in id and text are
treated alike; a null text stays null and has no lines; blank lines belong
to no template and stay; a null id sorts first; other columns pass through
``dedup`` unchanged and may have any name; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passkit.llm.base import GAP_CHARS, WORD_GAP, small, stored

DEPTH = 2
MIN_DOCS = 3
SIMILAR = 0.8
SHARE = 0.1  # a field of ten even values or fewer is several templates, each of which recurs
LEAST_TOKENS = 5  # below it, one variable field is over a fifth of the line
WILD = "<*>"
LEAF_TOKENS = 1_000_000  # a leaf with more tokens in its different lines is counted by place, over several tasks
LEAF_SHARE = 0.002  # as is a leaf with more than this share of all such tokens
COMMON_ROWS = 200_000  # so many common tokens of such leaves are broadcast at most


def _tokens(line: Column) -> Column:
    """Tokens of a line that neither begins nor ends with a gap, with ``WILD`` for those with a digit."""
    # possessive: a token without a digit is left as soon as it ends
    plain = F.when(line.rlike("[0-9]"), F.regexp_replace(
        line, "[^0-9\\x20\\x09-\\x0D]*+[0-9][^\\x20\\x09-\\x0D]*+", WILD)).otherwise(line)
    other = line.contains("  ")  # most lines have single spaces only, which are split without a pattern
    for gap in GAP_CHARS[1:]:
        other = other | line.contains(gap)
    return F.when(other, F.split(plain, WORD_GAP)).otherwise(F.split(plain, " "))


def lines_of(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, th, line_no, toks) of the lines with a token; (id, th) names a document."""
    t = F.col(text).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("th"),
                       F.posexplode(F.split(t, "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.trim("line", F.lit(GAP_CHARS))).filter("line <> ''")
    return rows.withColumn("toks", _tokens(F.col("line"))).drop("line")


def _with_leaf(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"n_tok": F.size("toks"), "leaf": F.xxhash64(F.size("toks"), F.slice("toks", 1, DEPTH))})


def _with_hash(lines: DataFrame) -> DataFrame:
    """The 128-bit hash of a line's tokens."""
    return lines.withColumns({"h1": F.xxhash64("toks"), "h2": F.xxhash64(F.lit(1), "toks")})


def _contested(keyed: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, h1, h2, w, n, line, wide): the different lines of leaves that hold several, with the documents that have each.

    ``wide`` leaves hold more tokens than one task should count.
    """
    lines = keyed.filter(F.col("n_tok") >= LEAST_TOKENS).groupBy("leaf", "n_tok", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    leaves = stored(lines.groupBy("leaf", "n_tok").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("n").alias("n"))
                    .filter((F.col("n_lines") > 1) & (F.col("n") >= min_docs))
                    .select("leaf", (F.col("n_lines") * F.col("n_tok")).alias("size")), "leaves")
    most = min(LEAF_TOKENS, LEAF_SHARE * (leaves.agg(F.sum("size")).first()[0] or 0))
    mine = keyed.filter(F.col("n_tok") >= LEAST_TOKENS).join(small(leaves.select("leaf", (F.col("size") > most).alias("wide"))), "leaf")
    # documents are counted without the text, which moves once a task for each line, however many documents hold it
    held = mine.groupBy("leaf", "h1", "h2", "id", "th").agg(F.count(F.lit(1)).alias("w")).groupBy("leaf", "h1", "h2").agg(F.count(F.lit(1)).alias("w"))
    text = mine.groupBy("leaf", "h1", "h2").agg(F.first("n_tok").alias("n"), F.first("line").alias("line"), F.first("wide").alias("wide"))
    return held.join(text, ["leaf", "h1", "h2"])


def _common(held: DataFrame, min_docs: int, wide: bool) -> DataFrame:
    """(leaf, h1, h2, n, docs, p, tok): the tokens that ``min_docs`` documents have at their place, for each line of ``held``."""
    if not wide:
        # a leaf's lines move as they are and are cut where they meet: no token is exchanged
        held = held.repartition("leaf")
    tok = held.select("leaf", "h1", "h2", "w", "n", F.posexplode(F.split("line", " ")).alias("p", "tok"))
    if wide:
        seen = tok.groupBy("leaf", "p", "tok").agg(F.sum("w").alias("docs"))
        # few tokens are common where lines meet by chance, so the common ones are joined, not the rare; stored, so that
        # a shuffle join reads both sides from an exchange and a token that all lines have is split
        return tok.join(small(stored(seen.filter(F.col("docs") >= min_docs), "common"), COMMON_ROWS), ["leaf", "p", "tok"])
    return tok.withColumn("docs", F.sum("w").over(Window.partitionBy("leaf", "p", "tok"))).filter(F.col("docs") >= min_docs)


def _names(common: DataFrame) -> DataFrame:
    """(h1, h2, t1, t2) of the lines that stay similar enough to their template and differ from it."""
    places = common.groupBy("leaf", "h1", "h2", "n").agg(F.collect_list(F.struct("docs", "p", "tok")).alias("places"))
    least = F.lit(SIMILAR) * F.col("n")
    # the count that the constant part reaches, in an array so that it is found once a line; the places above it stay constant
    part = F.array(F.get(F.sort_array("places", asc=False), F.ceil(least).cast("int") - 1)["docs"])
    fixed = F.flatten(F.transform(part, lambda c: F.filter("places", lambda x: x["docs"] >= F.lit(SHARE) * c)))
    new = places.filter(F.size("places") >= least).select("h1", "h2", "n", fixed.alias("fixed")).filter(F.size("fixed") < F.col("n"))
    # places and tokens in an array as well, so that they are taken out once a line
    kept = F.array(F.struct(F.transform("fixed", lambda x: x["p"]).alias("p"), F.transform("fixed", lambda x: x["tok"]).alias("tok")))
    name = F.flatten(F.transform(kept, lambda k: F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(
        F.get(k["tok"], F.array_position(k["p"], i).cast("int") - 1), F.lit(WILD)))))
    return new.select("h1", "h2", F.xxhash64(name).alias("t1"), F.xxhash64(F.lit(1), name).alias("t2"))


def templates(keyed: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, t1, t2): the generalised template of lines that have one; other lines are absent."""
    held = stored(_contested(keyed, min_docs), "contested", "zstd")
    return _names(_common(held.filter(~F.col("wide")), min_docs, False)).unionAll(_names(_common(held.filter("wide"), min_docs, True)))


def recurring(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, th, drop): line numbers to drop, for the documents that lose a line."""
    # the tokens are kept as one text, which only the contested leaves read: cutting all texts up again costs more
    keyed = _with_hash(_with_leaf(lines_of(docs, id_col, text))).withColumn("line", F.array_join("toks", " ")).drop("toks")
    keyed = stored(keyed, "lines", "zstd")
    names = stored(templates(keyed, min_docs), "templates")
    rows = keyed.join(small(names), ["h1", "h2"], "left").select(
        "id", "th", "line_no", F.coalesce("t1", "h1").alias("t1"), F.coalesce("t2", "h2").alias("t2"))
    once = rows.groupBy("t1", "t2", "id", "th").agg(F.min("line_no").alias("line_no"))
    known = once.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("id", "th", "line_no")).alias("first"))
    known = stored(known.filter(F.col("n_docs") >= min_docs).drop("n_docs"), "recurring")
    gone = rows.join(small(known), ["t1", "t2"]).filter(~F.struct("id", "th", "line_no").eqNullSafe(F.col("first")))
    return gone.groupBy("id", "th").agg(F.collect_set("line_no").alias("drop"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``, and (packed last) ``n_lines``, ``n_dropped``.

    Documents are counted by distinct (id, text).
    """
    drop = recurring(docs, id_col, text, min_docs)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("_th"))
    rows = rows.join(drop, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")), "left")
    whole = F.col("_row").getField(text).cast("string")
    lines = F.split(whole, "\n")
    # the lines in an array, so that a text is split once and not for each line that stays
    left = F.flatten(F.transform(F.array(lines), lambda a: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("drop")), lambda i: F.get(a, i))))
    new = F.when(F.col("drop").isNull(), F.col("_row").getField(text)).otherwise(F.array_join(left, "\n"))
    return rows.select(
        *[new.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns],
        F.when(whole.isNull(), 0).otherwise(F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("_n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("_n_dropped"))
