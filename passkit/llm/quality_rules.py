"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; its measurement and one failure
bit go to a ledger row. A policy is a versioned mask over the bits, so a new
policy version, or the effect of leaving one rule out (ablation), needs the
ledger only and never the texts again. Everything is a built-in function.

Defined results: a null or empty text has no words, no lines and no
measurements above zero, and fails ``few_words``; each input row is a
document of its own (equal rows give equal ledger rows); a null id stays
null; columns other than the id and the text are ignored, so their names
cannot clash; an empty table gives an empty ledger.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passkit.llm.base import GAP_CHARS, words_of

SYMBOLS = "#*$%&|<>"

# Failure conditions over the measurements, integer arithmetic only, so that
# every engine gives the same bit. The place in the list is the bit number.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("dup_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    ("shouting", "2 * n_upper > word_chars"),
    ("exclamations", "5 * n_exclamations > n_words"),
]
BIT = {name: i for i, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_trigrams")
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_bullet_lines", "n_upper", "n_exclamations"]


@dataclass(frozen=True)
class Policy:
    """A version and the names of the rules that reject under it."""
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BIT[r] for r in self.rules)


POLICIES = [
    Policy("v1", BASE),
    Policy("v2", BASE + ("symbols", "dup_lines")),
    Policy("v3", tuple(name for name, _ in RULES)),
]
CURRENT = POLICIES[-1]


def _pair_starts(n: Column, same) -> Column:
    """Places j in 1..n-1 of a sorted array for which ``same(j)`` holds: j and j + 1 are equal."""
    return F.when(n >= 2, F.filter(F.sequence(F.lit(1), n - 1), same)).otherwise(F.array().cast("array<int>"))


def _covered(starts: Column) -> Column:
    """Words covered by three-word windows at the ascending positions ``starts``."""
    return F.aggregate(
        starts, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + (p + 3 - F.greatest(acc["end"], p))).alias("n")),
        lambda acc: acc["n"])


def with_repeat_words(df: DataFrame, hashes: str, bits: int = 24) -> DataFrame:
    """Add ``n_repeat_words`` from the word hashes: words in trigrams that the text holds twice or more.

    A trigram's hash and place share one long (the low bits of the hash above
    ``bits`` bits of place), so one primitive sort brings equal trigrams together.
    Neighbours with equal hash bits are compared on the full hash; should one
    pair differ, or a text have 2**bits words or more, the text takes the other
    branch, which sorts (full hash, place) structs and has no such limits.
    """
    place = (1 << bits) - 1
    df = df.withColumn("_n", F.greatest(F.size(hashes) - 2, F.lit(0)))
    df = df.withColumn("_tri", F.when(F.col("_n") >= 1, F.transform(
        F.sequence(F.lit(1), "_n"),
        lambda i: F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i), F.get(hashes, i + 1)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_keys", F.sort_array(F.transform(
        "_tri", lambda h, i: F.shiftleft(h, bits).bitwiseOR(i.cast("long")))))
    df = df.withColumn("_at", _pair_starts(F.col("_n"), lambda j: F.shiftright(F.get("_keys", j - 1), bits) == F.shiftright(F.get("_keys", j), bits)))
    at = lambda j: F.get("_keys", j).bitwiseAND(F.lit(place).cast("long")).cast("int")
    df = df.withColumn("_sound", (F.col("_n") <= place) & F.forall(
        "_at", lambda j: F.get("_tri", at(j - 1)) == F.get("_tri", at(j))))
    fast = F.concat(F.transform("_at", lambda j: at(j - 1)), F.transform("_at", lambda j: at(j)))
    df = df.withColumn("_all", F.when(F.col("_sound"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.array_sort(F.transform("_tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    pairs = _pair_starts(F.size("_all"), lambda j: F.get("_all", j - 1)["h"] == F.get("_all", j)["h"])
    slow = F.flatten(F.transform(pairs, lambda j: F.array(F.get("_all", j - 1)["i"], F.get("_all", j)["i"])))
    df = df.withColumn("_rep", F.sort_array(F.array_distinct(F.when(F.col("_sound"), fast).otherwise(slow))))
    return df.withColumn("n_repeat_words", _covered(F.col("_rep"))).drop("_n", "_tri", "_keys", "_at", "_sound", "_all", "_rep")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``' columns plus the measurements of ``MEASURES`` (all bigint); no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumns({
        "_words": words_of(F.col(text)),
        "_lines": F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x, F.lit(GAP_CHARS))) > 0),
        "n_chars_": F.length(t),
        "_bare": F.regexp_replace(t, "[" + re.escape(SYMBOLS) + "]+", ""),
        "_mild": F.replace(t, F.lit("!"), F.lit("")),
        "_low": F.regexp_replace(t, "\\p{Lu}+", ""),
    })
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.col("n_chars_") - F.length("_bare")).cast("long"),
        "n_exclamations": (F.col("n_chars_") - F.length("_mild")).cast("long"),
        "n_upper": (F.col("n_chars_") - F.length("_low")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_bullet_lines": F.size(F.filter("_lines", lambda x: x.rlike("^[\\x20\\t]*[-*•][\\x20\\t]"))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    }).drop("_words", "_lines", "n_chars_", "_bare", "_mild", "_low")
    return with_repeat_words(df, "_hashes").drop("_hashes")


def failed_bits() -> Column:
    """The ledger's bits, over columns named as in ``MEASURES``."""
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << BIT[name])).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, measurements, ``failed_bits`` (bit i set: rule i failed)."""
    return measure(docs.select(id_col, text), text).select(id_col, *MEASURES).withColumn("failed_bits", failed_bits())


def apply_policy(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Ledger rows plus ``kept``: no bit of the policy's mask is set."""
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablations(rows: DataFrame, policies: list[Policy] | None = None) -> DataFrame:
    """Per policy and rule: documents that fail the rule, and those that only this rule rejects.

    Counts are taken per bit pattern first (at most 2 ** len(RULES) groups),
    so the policies are compared over a table of bounded size.
    """
    policies = POLICIES if policies is None else policies
    spec = F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask).cast("long").alias("mask"),
                              F.lit(r).alias("rule"), F.lit(1 << BIT[r]).cast("long").alias("bit"))
                     for p in policies for r in p.rules])
    counts = rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    x = counts.select("n", "failed_bits", F.explode(spec).alias("s")).select("n", "failed_bits", "s.*")
    hit = F.col("failed_bits").bitwiseAND(F.col("bit")) != 0
    only = F.col("failed_bits").bitwiseAND(F.col("mask")) == F.col("bit")
    return x.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(only, F.col("n")).otherwise(0)).alias("n_regained_without_rule"))


def keep(docs: DataFrame, policy: Policy = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the policy keeps."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    mask = F.lit(policy.mask).cast("long")
    rows = measure(packed, "_text").withColumn("_bits", failed_bits())
    # a filter on computed columns is pushed down with every expression copied into it,
    # many times over here; a column that is not deterministic keeps it above them
    rows = rows.withColumn("_here", F.monotonically_increasing_id())
    return rows.filter((F.col("_bits").bitwiseAND(mask) == 0) & (F.col("_here") >= 0)).select("_row.*")
