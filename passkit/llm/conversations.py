"""Conversation structure repair by a run-length dynamic program.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``. Its
turns may be kept (0), given the role user or assistant (1) or deleted (2; the only
edit for a blank or duplicate turn), empty user or assistant turns may be
inserted anywhere (5), and a truncated turn that stays costs 5 more. The cheapest
edits are found over four states (nothing yet, system, user, assistant):

* a turn is a symbol of role and fault; equal consecutive symbols collapse to a run;
* a symbol is a 4 x 4 matrix in the (min, +) semiring, insertions before the turn
  included; the cost to go before a run is its matrix to the power of its length,
  as cached binary powers, times the cost to go after it;
* the audit then unrolls the choices run by run from the front, taking the
  least letter (D, I, K, R) among the cheapest, which gives the ASCII-least audit;
  long runs are unrolled in halves, so that no run is held turn by turn.

Conversations are hash-partitioned and sorted by turn; tasks read them as a
stream and keep a run list of a few bytes a turn for the one at hand, while texts go
by a second time for the repaired rows. An audit is one string and a digest
reads a conversation from front to end, so one conversation is one task's
work, in bounded memory apart from its audit; many copies of one conversation are many keys.

Defined results: null ids, turns, roles and texts are one space where text is read, and a null id
is a conversation of its own; null turns come first; turns alike in number come by role and then by the hash of
their text, so that repeated rows are neighbours; only a role's first character counts for its state;
texts of any length are fine; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passkit.llm.base import GAP_CHARS
from passkit.operators.ordering import join_back

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
CLEAN, CUT, BLANK, DUPLICATE, DROPPED = 0, 1, 2, 3, 4  # faults; a dropped row is no turn
NONE, SYSTEM, USER, ASSISTANT = range(4)  # states: the last role so far
OTHER = 3  # class of a role that is none of s, u, a; those are 0, 1, 2
GONE = 8  # the symbol of a turn that must be deleted; the others are 2 * class + truncated
TO_GO = (0, 10, 5, 0)  # insertions that end a conversation in each state
LEGAL = {(0, 1), (1, 2), (2, 1)}
HALVED = 2048
SHORT = 64


# -- the dynamic program -----------------------------------------------------------

def _next(state: int) -> int:
    """The state after an inserted or re-roled turn."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, role: int) -> int | None:
    """The state after a turn that keeps its role, if it may stand there."""
    if role == 0:
        return SYSTEM if state == NONE else None
    if role == 1:
        return USER if state != USER else None
    return ASSISTANT if role == 2 and state == USER else None


@lru_cache(maxsize=None)
def _edits(symbol: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of the edits that take a turn in, in ASCII order."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        role, more = symbol >> 1, TRUNCATED * (symbol & 1)
        kept = _kept(state, role)
        if kept is not None:
            out.append(("K", more, kept))
        out.append(("R", REROLE + more, _next(state)))
    return tuple(out)


Matrix = tuple[tuple[float, ...], ...]


def _product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> Matrix:
    """The matrix of 2 ** k turns of a symbol."""
    if k:
        half = power(symbol, k - 1)
        return _product(half, half)
    far = float("inf")
    turn = [[far] * 4 for _ in range(4)]
    for i in range(4):
        for _, cost, j in _edits(symbol, i):
            turn[i][j] = min(turn[i][j], cost)
    inserts = [[far] * 4 for _ in range(4)]
    for i in range(4):
        inserts[i][i], j = 0, i
        for n in range(1, 4):
            j = _next(j)
            inserts[i][j] = min(inserts[i][j], n * INSERT)
    return _product(tuple(map(tuple, inserts)), tuple(map(tuple, turn)))


def before(symbol: int, n: int, to_go: tuple) -> tuple:
    """Costs to go before a run of ``n`` turns, from those after it."""
    k = 0
    while n:
        if n & 1:
            m = power(symbol, k)
            to_go = tuple(min(m[i][j] + to_go[j] for j in range(4)) for i in range(4))
        n >>= 1
        k += 1
    return to_go


def _unroll(symbol: int, n: int, state: int, after: tuple, out: list[str]) -> int:
    """Write the letters of a run to ``out``; gives the state behind it."""
    if n > HALVED:
        state = _unroll(symbol, n // 2, state, before(symbol, n - n // 2, after), out)
        return _unroll(symbol, n - n // 2, state, after, out)
    to_go = [after]
    for _ in range(n):
        to_go.append(before(symbol, 1, to_go[-1]))
    letters = []
    for k in range(n, 0, -1):
        now, then = to_go[k], to_go[k - 1]
        while True:
            letter, into = next((x, j) for x, cost, j in sorted(
                [("I", INSERT + now[_next(state)], None)] + [(x, cost + then[j], j) for x, cost, j in _edits(symbol, state)],
                key=lambda e: e[0]) if cost == now[state])
            letters.append(letter)
            if into is None:
                state = _next(state)
            else:
                state = into
                break
    out.append("".join(letters))
    return state


def _solve(symbols: bytes, lengths: tuple[int, ...] | array) -> tuple[int, str]:
    """(cost, audit) of a conversation given as runs."""
    to_go = [TO_GO]
    for symbol, n in zip(reversed(symbols), reversed(lengths)):
        to_go.append(before(symbol, n, to_go[-1]))
    to_go.reverse()
    state, out = NONE, []
    for k, (symbol, n) in enumerate(zip(symbols, lengths)):
        state = _unroll(symbol, n, state, to_go[k + 1], out)
    while TO_GO[state]:
        out.append("I")
        state = _next(state)
    return int(to_go[0][NONE]), "".join(out)


@lru_cache(maxsize=1 << 16)
def _known(symbols: bytes, lengths: tuple[int, ...]) -> tuple[int, str]:
    return _solve(symbols, lengths)


def solve(symbols: bytes, lengths: array) -> tuple[int, str]:
    """As ``_solve``, remembered for conversations of few runs."""
    return _known(symbols, tuple(lengths)) if len(symbols) <= SHORT else _solve(symbols, lengths)


# -- rows --------------------------------------------------------------------------

def _read(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): the contract's damage; dropped rows stay, marked."""
    lot = F.crc32(F.concat(_read(F.col("conv_id")), F.lit(":"), _read(F.col("turn"))).cast("binary")) % 20
    text = _read(F.col("text"))
    text = F.when(lot == 1, "").when(lot == 2, F.translate(text, ".!?", "")).otherwise(text)
    times = F.array_repeat(F.lit(0), F.when(lot == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(lot == 4, "user").otherwise(_read(F.col("role"))).alias("role"), text.alias("text"),
                       (lot == 0).alias("dropped"), times.alias("_times")).withColumn("_times", F.explode("_times")).drop("_times")


def _ordered(rows: DataFrame) -> DataFrame:
    """(id, turn, role, text, dropped, h1, h2); the last two order turns alike in number and role."""
    text = _read(F.col("text"))
    return rows.select(F.col("conv_id").alias("id"), F.col("turn").cast("bigint").alias("turn"), _read(F.col("role")).alias("role"), text.alias("text"),
                       F.col("dropped"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def faults(rows: DataFrame) -> DataFrame:
    """(id, turn, role, h1, h2, class, fault) of every row, without its text."""
    body = F.rtrim("text", F.lit(GAP_CHARS))
    last = F.substring(body, -1, 1)
    seen = Window.partitionBy("id", "dropped", "role", "h1", "h2").orderBy("turn")
    start = F.substring("role", 1, 1)
    kind = F.when(start == "s", 0).when(start == "u", 1).when(start == "a", 2).otherwise(OTHER)
    bare = _ordered(rows).withColumns({"class": kind, "fault": F.when(F.col("dropped"), DROPPED).when(F.trim("text", F.lit(GAP_CHARS)) == "", BLANK).when(
        last.isin(".", "!", "?"), CLEAN).otherwise(CUT)}).drop("text").repartition("id")
    again = F.row_number().over(seen) > 1
    return bare.withColumn("fault", F.when(again & (F.col("fault") < BLANK), DUPLICATE).otherwise(F.col("fault"))).drop("dropped")


class _Conversation:
    """What is known of the conversation whose rows are read."""

    def __init__(self, conv_id):
        self.id, self.symbols, self.lengths = conv_id, bytearray(), array("q")
        self.low = self.high = self.turn = None
        self.turns = self.illegal = self.blank = self.duplicate = self.truncated = 0
        self.role = None

    def add(self, turn, role, fault):
        if fault == DROPPED:
            return
        if turn is not None:
            if turn != self.turn:  # rows come by turn
                self.turns += 1
                self.low = turn if self.low is None else self.low
            self.turn = self.high = turn
        self.illegal += self.role is not None and (self.role, role) not in LEGAL
        self.role = role
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == CUT
        symbol = GONE if fault >= BLANK else 2 * role + fault
        if self.symbols and self.symbols[-1] == symbol:
            self.lengths[-1] += 1
        else:
            self.symbols.append(symbol)
            self.lengths.append(1)

    def row(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *solve(bytes(self.symbols), self.lengths))


def _stream(batches: Iterator[pa.RecordBatch], begin, out: pa.Schema, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows of ``begin(id).add(...)`` and ``.row()`` for each run of equal ids in the first column."""
    held, done = None, []
    for batch in batches:
        for conv_id, *row in zip(*[c.to_pylist() for c in batch.columns]):
            if held is None or held.id != conv_id:
                if held is not None:
                    done.append(held.row())
                held = begin(conv_id)
            held.add(*row)
            if len(done) >= rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), out.types)], schema=out)
                done = []
    if held is not None:
        done.append(held.row())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), out.types)], schema=out)


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for every conversation of ``rows`` (as ``damage`` gives them)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *[T.StructField(c, T.LongType()) for c in _COUNTS], T.StructField("audit", T.StringType())])
    held = faults(rows).sortWithinPartitions("id", "turn", "role", "h1", "h2").select("id", "turn", "class", "fault")

    def run(batches):
        yield from _stream(batches, _Conversation, to_arrow_schema(schema))

    return held.mapInArrow(run, schema)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns of the repaired conversations, each one's neighbours in a partition and in order.

    ``found`` is ``audits(rows)``. An audit and its rows meet in one partition, the audit first.
    """
    kind = rows.schema["conv_id"].dataType
    texts = _ordered(rows).filter("not dropped").select("id", F.lit(1).alias("kind"), "turn", "role", "text", "h1", "h2")
    plans = found.select(F.col("conv_id").alias("id"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
                         F.col("audit").alias("text"), F.lit(0).cast("bigint").alias("h1"), F.lit(0).cast("bigint").alias("h2"))
    both = plans.union(texts).repartition("id").sortWithinPartitions("id", "kind", "turn", "role", "h1", "h2").select("id", "kind", "role", "text")
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    name = {USER: "user", ASSISTANT: "assistant"}

    def turns(batches):
        """Each repaired turn; insertions wait for the row after them, those at the end for the next audit."""
        conv_id, audit, at, state, place = None, "", 0, NONE, 0

        def inserted():
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                at, state, place = at + 1, _next(state), place + 1
                yield conv_id, place, name[state], ""

        for batch in batches:
            for new_id, kind, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if not kind:
                    yield from inserted()
                    conv_id, audit, at, state, place = new_id, text, 0, NONE, 0
                    continue
                yield from inserted()
                letter, at = audit[at], at + 1
                if letter == "D":
                    continue
                if letter == "R":
                    state = _next(state)
                    role = name[state]
                else:
                    state = _kept(state, {"s": 0, "u": 1, "a": 2}[role[0]])
                place += 1
                yield conv_id, place, role, text
        yield from inserted()

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        out, done, size = to_arrow_schema(schema), [], 0
        for row in turns(batches):
            done.append(row)
            size += len(row[3]) + 64
            if size >= 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), out.types)], schema=out)
                done, size = [], 0
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), out.types)], schema=out)

    return both.mapInArrow(run, schema)


class _Digest:
    def __init__(self, conv_id):
        self.id, self.sha, self.first = conv_id, hashlib.sha256(), True

    def add(self, role, text):
        self.sha.update((role if self.first else "\n" + role).encode() + b":" + text.encode())
        self.first = False

    def row(self):
        return self.id, self.sha.hexdigest()


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``repaired`` turns: SHA-256 of the lines ``role:text``, read as a stream."""
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), T.StructField("repaired_sha256", T.StringType())])

    def run(batches):
        yield from _stream(batches, _Digest, to_arrow_schema(schema))

    return turns.select("conv_id", "role", "text").mapInArrow(run, schema)


def repair(rows: DataFrame) -> DataFrame:
    """Audit and digest of every conversation of ``rows`` (conv_id, turn, role, text, dropped)."""
    from passkit.llm.base import stored
    found = stored(audits(rows), "conversation-audits")
    out = join_back(found, digests(repaired(rows, found)), ["conv_id"], "left")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
