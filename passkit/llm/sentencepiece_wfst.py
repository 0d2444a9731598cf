"""SentencePiece encoding and decoding as a weighted finite-state transducer.

``compile_model`` turns a model file into composed parts:

* normaliser: the rewriting rules of the model's character map (longest
  match first), surplus spaces, dummy prefix, space to U+2581;
* pieces: an automaton with an arc from i to j for every piece that equals
  input[i:j]; byte fallback: an arc over one character that no piece covers,
  giving the pieces of its bytes;
* for BPE models an acceptor of merge order. Each piece carries the last of
  its own merges. Two pieces may stand side by side if, undoing their merges
  from the last one back, no merge across the border would have come before
  the merges undone so far.

Unigram arcs weigh minus the piece's score; BPE arcs weigh zero, or infinity
where the acceptor refuses. The encoding is the shortest path in the
tropical semiring (min, +): one relaxation for both kinds, position by
position over all new segments of a batch at once. Under the BPE acceptor
exactly one path to each position is finite: merging is greedy and local, so
a border is refused in the whole text if and only if it is refused in the
pair alone. That is why the result equals the library's own for a model it
calls BPE.

Input is composed in segments (a run of U+2581 and what follows up to the
next) where no piece crosses a segment's start; results of segments are kept
in a bounded memo. A segment falls apart further where no arc crosses.

Defined results: a null text gives null ids; an empty text gives no ids (no
dummy prefix); texts of any length take linear time; decoding gives back
the normalised text with U+2581 read as a space; ids the model lacks give null; rows
stay rows, repeated or not; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
MEMO = 40_000     # segments in each of the memo's two generations
LONG = 64          # characters of the longest segment that is kept
GROUP = 1 << 16    # characters composed at once
CHUNK = 1 << 19    # characters of the texts encoded at once
NOTHING = -1
JUDGED = 1 << 18   # verdicts on pairs that are kept
VALUE_BITS = 24    # states, and twice the ranks, stay below 2 ** 24
VALUES = (1 << VALUE_BITS) - 1


class Memo:
    """Bounded memo of a function of many strings: the last results, and the generation before them until it is asked for again."""

    def __init__(self, fn):
        self.fn, self.new, self.old, self.long = fn, {}, {}, []

    def fill(self, asked: set[str]) -> dict[str, tuple[int, ...]]:
        """A mapping that holds a result for each string asked for, until the next call."""
        for s in self.long:
            self.new.pop(s, None)
        if len(self.new) >= MEMO:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = asked.difference(new)
        again = missing.intersection(old) if old else ()
        new.update((s, old[s]) for s in again)
        missing = list(missing.difference(again))
        new.update(zip(missing, self.fn(missing)))
        self.long = [s for s in missing if len(s) > LONG]
        return new


class Normaliser:
    """Longest-match rewriting of a text, then surplus spaces, U+2581 and the dummy prefix."""

    def __init__(self, rules: dict[str, str] | None = None, squeeze: bool = False, dummy_prefix: bool = True):
        self.squeeze, self.dummy_prefix = squeeze, dummy_prefix
        self.single = {ord(k): v for k, v in (rules or {}).items() if len(k) == 1}
        self.longer: dict[str, dict[int, dict[str, str]]] = {}  # first character -> length -> rule
        for k, v in (rules or {}).items():
            if len(k) > 1:
                self.longer.setdefault(k[0], {}).setdefault(len(k), {})[k] = v
        starts = "".join(map(re.escape, sorted(self.longer)))
        self.start = re.compile(f"[{starts}]") if starts else None
        self.plain = not (rules or squeeze) and dummy_prefix  # only spaces change

    def rewrite(self, text: str) -> str:
        """The arcs of the rules, the longest one at each place; a character without an arc stays."""
        if self.start is None:
            return text.translate(self.single) if self.single else text
        out, at = [], 0
        for m in self.start.finditer(text):
            k = m.start()
            if k < at:
                continue
            for n, rules in sorted(self.longer[text[k]].items(), reverse=True):
                to = rules.get(text[k:k + n])
                if to is not None:
                    out += [text[at:k].translate(self.single), to]
                    at = k + n
                    break
        return "".join([*out, text[at:].translate(self.single)])

    def __call__(self, text: str) -> str:
        x = self.rewrite(text)
        if self.squeeze:
            x = re.sub(" +", " ", x.strip(" "))
        x = x.replace(" ", SPACE)
        return SPACE + x if self.dummy_prefix and x else x


def charsmap_rules(blob: bytes) -> dict[str, str]:
    """Rules of a model's compiled character map: a double-array trie over UTF-8 bytes, then NUL-ended outputs."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist()
    outputs = blob[4 + size:]
    offset = [(u >> 10) << ((u & 512) >> 6) for u in units]
    rules, waiting = {}, [(offset[0], b"")]
    while waiting:
        at, key = waiting.pop()
        for c in range(1, 256):
            k = at ^ c
            if k < len(units) and units[k] & 0x800000FF == c:
                below, longer = k ^ offset[k], key + bytes([c])
                if units[k] & 256:  # a key ends here; its leaf holds the place of the output
                    start = units[below] & 0x7FFFFFFF
                    rules[longer.decode()] = outputs[start:outputs.index(b"\0", start)].decode()
                waiting.append((below, longer))
    return {k: v for k, v in rules.items() if k != v or len(k) > 1}  # a longer rule hides those of its beginnings


def last_merge(text: str, rank: dict[str, float]) -> tuple[str, str, bool] | None:
    """The two sides of the last merge of a piece's own characters (best rank first, leftmost among equals), and
    whether ranks rose; None if merging does not end in the piece."""
    parts, before, rising = list(text), -1.0, True
    while True:
        best = min(((rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
        if best is None:
            return None
        k = best[1]
        if best[0] < before:
            rising = False
        if len(parts) == 2:
            return parts[0], parts[1], rising
        before = best[0]
        parts[k:k + 2] = [parts[k] + parts[k + 1]]


class Keyed:
    """Integer keys with a small value each in one open hash table, looked up many at a time."""

    def __init__(self, rows: dict[int, int]):
        bits = max(4, (4 * len(rows)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, dtype=np.int64)  # key and value in one number
        keys = np.array(list(rows), dtype=np.int64)
        for slot, key in zip(self.slots(keys).tolist(), keys.tolist()):
            while self.table[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.table[slot] = key << VALUE_BITS | rows[key]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, absent: int) -> np.ndarray:
        slot = self.slots(keys)
        got = self.table[slot]
        out = np.where(got >> VALUE_BITS == keys, got & VALUES, absent)
        at = np.flatnonzero((got >= 0) & (got >> VALUE_BITS != keys))
        slot = slot[at]
        while len(at):  # other keys in the way
            slot = slot + 1 & self.mask
            got = self.table[slot]
            hit = got >> VALUE_BITS == keys[at]
            out[at[hit]] = got[hit] & VALUES
            on = (got >= 0) & ~hit
            at, slot = at[on], slot[on]
        return out


class Decoder:
    """The inverse arcs: bytes of each piece, joined before they are read as UTF-8; control pieces give nothing."""

    def __init__(self, pieces: list[tuple[str, float, int]], dummy_prefix: bool):
        self.dummy_prefix = dummy_prefix
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else
                    " ⁇ ".encode() if t == UNKNOWN else p.encode() for p, _, t in pieces]

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@dataclass
class Transducer:
    kind: int
    pieces: list[tuple[str, float, int]]
    normalise: Normaliser = field(default_factory=Normaliser)

    def __post_init__(self):
        number = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, UNUSED)}
        self.unk = next(i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN)
        self.none = len(self.pieces)  # the arc over a character without a piece
        byte_id = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.byte_ids = np.array([byte_id[b] for b in range(256)], dtype=np.int64) if len(byte_id) == 256 else None
        weight = [-s for _, s, _ in self.pieces]
        self.weight = np.array([*weight, max(weight) + UNKNOWN_PENALTY])
        if self.kind == BPE:
            number = self.compile_acceptor(number)
        self.letters = np.array(sorted({ord(c) for p in number for c in p}), dtype=np.int64)
        # the pieces' automaton: (state, letter) to state; state 0 leads nowhere, 1 is the start
        code = {chr(c): k for k, c in enumerate(self.letters.tolist(), 1)}
        self.width = len(code) + 1
        arcs, ends = {}, [-1, -1]
        for p, i in number.items():
            state = 1
            for c in p:
                key = state * self.width + code[c]
                if key not in arcs:
                    arcs[key] = len(ends)
                    ends.append(-1)
                state = arcs[key]
            ends[state] = i
        self.steps, self.ends = Keyed(arcs), np.array(ends, dtype=np.int64)
        self.start = self.steps.get(self.width + np.arange(self.width), 0)
        self.inner = np.zeros(len(ends), dtype=bool)  # states with a way on
        self.inner[[key // self.width for key in arcs]] = True
        whole = any(SPACE in p.lstrip(SPACE) for p in number)
        self.segment = None if whole else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.decoder = Decoder(self.pieces, self.normalise.dummy_prefix)
        self.forget()

    def forget(self) -> None:
        """Empty memos, and the table of letters; they never travel with the model."""
        self.code = np.zeros(0x110000, dtype=np.int32)
        self.code[self.letters] = np.arange(1, self.width)
        self.judged = np.full(JUDGED, -3, dtype=np.int64)  # no pair's key
        self.segments = Memo(self.compose)
        self.words = Memo(lambda ws: self.compose([SPACE + w for w in ws]))  # by the word after a space

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("code", "judged", "segments", "words")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    # -- the merge-order acceptor ------------------------------------------------
    def compile_acceptor(self, number: dict[str, int]) -> dict[str, int]:
        """Ranks, last merges and joined pairs of the pieces; returns the pieces that their own characters merge to."""
        order = {w: k for k, w in enumerate(sorted({float(self.weight[i]) for i in number.values()}))}
        rank = {p: order[float(self.weight[i])] for p, i in number.items()}
        self.left, self.right = np.full(self.none + 1, NOTHING), np.full(self.none + 1, NOTHING)
        self.rank = np.full(self.none + 1, NOTHING)
        reached, pairs = {}, {}
        for p, i in number.items():
            if len(p) == 1:
                reached[p] = i
                continue
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    pairs[number[p[:k]] * (self.none + 1) + number[p[k:]]] = 2 * rank[p]
            got = last_merge(p, rank)
            if got is not None:
                if not got[2]:
                    raise ValueError(f"the merges of piece {p!r} are not in order of score")
                if got[0] in number and got[1] in number:
                    self.left[i], self.right[i], self.rank[i] = number[got[0]], number[got[1]], rank[p]
                    reached[p] = i
                elif len(got[0]) == len(got[1]) == 1:  # of characters that are no pieces themselves
                    self.left[i], self.right[i], self.rank[i] = number.get(got[0], self.none), number.get(got[1], self.none), rank[p]
                    reached[p] = i
        self.pairs = Keyed(pairs)
        return reached

    def accepts(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the pieces ``right`` may follow the pieces ``left``; a pair's last verdict stays in its slot."""
        key = left * (self.none + 1) + right
        slot = key * 0x9E3779B97F4A7C1 >> 20 & JUDGED - 1
        got = self.judged[slot]
        ok = got & 1 == 1
        new = np.flatnonzero(got >> 1 != key)
        if len(new):
            ok[new] = self.judge(left[new], right[new])
            self.judged[slot[new]] = key[new] << 1 | ok[new]
        return ok

    def judge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The acceptor itself (``NOTHING``: a beginning, followed by any)."""
        ok = np.ones(len(left), dtype=bool)
        at = np.flatnonzero(left != NOTHING)
        l, r = left[at], right[at]
        limit = np.full(len(at), np.iinfo(np.int64).max)  # twice the rank of the merge undone last, one more if on the right
        while len(at):
            before = self.pairs.get(l * (self.none + 1) + r, np.iinfo(np.int64).max) < limit
            ok[at[before]] = False
            left_rank, right_rank = self.rank[l], self.rank[r]
            on = ~before & ((left_rank >= 0) | (right_rank >= 0))
            at, l, r, left_rank, right_rank = at[on], l[on], r[on], left_rank[on], right_rank[on]
            undo = left_rank > right_rank  # of equal ranks the right one is merged last
            l, r = np.where(undo, self.right[l], l), np.where(undo, r, self.left[r])
            limit = np.where(undo, 2 * left_rank, 2 * right_rank + 1)
        return ok

    # -- composition and shortest path -------------------------------------------
    def weigh(self, left: np.ndarray | None, arc: np.ndarray) -> np.ndarray:
        """Weight of each arc behind the arc ``left`` (none: at a beginning)."""
        if self.kind == UNIGRAM:
            return self.weight[arc]
        return np.zeros(len(arc)) if left is None else np.where(self.accepts(left, arc), 0.0, np.inf)

    def arcs(self, code: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of every arc over the letters, none beyond ``until``; longer ones of a start later."""
        start, state = np.arange(len(code)), self.start[code]
        piece = self.ends[state]
        found = [(start, start + 1, np.where(piece >= 0, piece, self.none))]
        length = 1
        while True:
            on = self.inner[state] & (start + length < until[start])
            start, state = start[on], state[on]
            state = self.steps.get(state * self.width + code[start + length], 0)
            start, state = start[state > 0], state[state > 0]
            if not len(start):
                break
            length += 1
            piece = self.ends[state]
            held = piece >= 0
            found.append((start[held], start[held] + length, piece[held]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def compose(self, segments: list[str]) -> list[tuple[int, ...]]:
        """Ids of the shortest path over each normalised segment."""
        group = np.cumsum([len(s) for s in segments]) // GROUP
        edge = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(segments)] if segments else [0]
        return [x for a, b in zip(edge, edge[1:]) for x in self.paths(segments[a:b])]

    def paths(self, segments: list[str]) -> list[tuple[int, ...]]:
        cp = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        size = np.array([len(s) for s in segments], dtype=np.int64)
        bound = np.concatenate([[0], np.cumsum(size)])
        start, end, arc = self.arcs(self.code[cp].astype(np.int64), np.repeat(bound[1:], size))
        # parts: from one place that no arc crosses to the next
        wide = end > start + 1
        crossed = np.cumsum(np.bincount(start[wide] + 1, minlength=len(cp) + 1) - np.bincount(end[wide], minlength=len(cp) + 1))
        first = np.flatnonzero(crossed[:-1] == 0)
        place = np.arange(len(cp)) - np.repeat(first, np.diff(np.append(first, len(cp))))
        turn = place[start]
        order = np.argsort(turn.astype(np.uint16) if turn.max(initial=0) < 1 << 16 else turn, kind="stable")  # short keys are sorted by digits
        start, end, arc = start[order], end[order], arc[order]
        step = np.searchsorted(place[start], np.arange(int(place.max(initial=-1)) + 2))
        # relaxation; last, back and dist belong to a part's positions behind its first
        dist = np.full(len(cp) + 1, np.inf)
        last, back = np.full(len(cp) + 1, NOTHING), np.zeros(len(cp) + 1, dtype=np.int64)
        for k in range(len(step) - 1):
            s, e, x = (v[step[k]:step[k + 1]] for v in (start, end, arc))
            cost = dist[s] + self.weigh(last[s], x) if k else self.weigh(None, x)
            better = cost < dist[e]
            to = e[better]  # no place comes twice: a part's arcs of one start end at different places
            dist[to], last[to], back[to] = cost[better], x[better], s[better]
        used = np.zeros(len(cp) + 1, dtype=bool)
        here = np.append(first[1:], len(cp)) if len(cp) else first
        while len(here):
            used[here] = True
            here = back[here]
            here = here[place[here] > 0]
        stop = np.flatnonzero(used)
        ids = last[stop]
        own = np.searchsorted(bound, stop, side="left") - 1  # segment of each id
        strange = ids == self.none
        if strange.any():
            ids, own = self.spell(ids, own, strange, cp[stop - 1])
        flat, cut = ids.tolist(), np.searchsorted(own, np.arange(len(segments) + 1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip(cut, cut[1:])]

    def spell(self, ids: np.ndarray, own: np.ndarray, strange: np.ndarray, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as pieces of their bytes; a run of them is one unknown piece where the model has no bytes."""
        if self.byte_ids is None:
            ids = np.where(strange, self.unk, ids)
            keep = np.ones(len(ids), dtype=bool)
            keep[1:] = ~(strange[1:] & strange[:-1] & (own[1:] == own[:-1]))
            return ids[keep], own[keep]
        size = np.where(strange, 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), 1)
        out = np.repeat(ids, size)
        text = "".join(map(chr, cp[strange].tolist())).encode("utf-8", "surrogatepass")
        out[np.repeat(strange, size)] = self.byte_ids[np.frombuffer(text, dtype=np.uint8)]
        return out, np.repeat(own, size)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; segments not seen lately are composed together."""
        parts, by_word = [], []
        for t in texts:
            words = t.split(" ") if self.segment and self.normalise.plain and SPACE not in t else [""]
            simple = "" not in words  # single spaces only: a segment for each word
            if not simple:
                x = self.normalise(t)
                words = self.segment.findall(x) if self.segment else [x] if x else []
            parts.append(words)
            by_word.append(simple)
        known = [memo.fill(set().union(*(p for p, w in zip(parts, by_word) if w == kind)))
                 for kind, memo in ((False, self.segments), (True, self.words))]
        return [list(chain.from_iterable(map(known[w].__getitem__, p))) for p, w in zip(parts, by_word)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return self.decoder.decode(ids)


def compile_model(path: str) -> Transducer:
    """Read a SentencePiece model file (unigram or BPE, no user-defined pieces)."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models")
    spec = m.normalizer_spec
    if not spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models that write a space before a word as U+2581")
    pieces = [(p.piece, p.score, p.type) for p in m.pieces]
    if any(t == USER_DEFINED for _, _, t in pieces):
        raise ValueError("models with user-defined pieces are not supported")
    return Transducer(m.trainer_spec.model_type, pieces,
                      Normaliser(charsmap_rules(spec.precompiled_charsmap), spec.remove_extra_whitespaces, spec.add_dummy_prefix))


def encode(docs: DataFrame, model: Transducer, id_col: str = "doc_id", text: str = "text", decoded: str | None = None) -> DataFrame:
    """(id, text, ids). The compiled model is broadcast; its size is that of the vocabulary.

    ``decoded`` names a further column with the text of the ids, decoded in the same pass: texts and ids
    then cross to Python and back once instead of twice, with one worker a task.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            at, size, texts = 0, 0, []
            for k, t in enumerate(b.column(1)):
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size >= CHUNK or k + 1 == b.num_rows:
                    ids = iter(m.encode_all([t for t in texts if t]))
                    ids = [next(ids) if t else [] for t in texts]
                    off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(off[-1]))
                    col = pa.ListArray.from_arrays(pa.array(off), pa.array(flat), mask=pa.array([t is None for t in texts]))
                    part = b.slice(at, len(texts))
                    back = [pa.array([None if t is None else m.decode(x) for t, x in zip(texts, ids)], pa.string())] if decoded else []
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), col, *back], names=["id", "text", "ids", "decoded"][:3 + len(back)])
                    at, size, texts = k + 1, 0, []

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, text string, ids array<int>" + (", decoded string" if decoded else ""))
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text), "ids", *([F.col("decoded").alias(decoded)] if decoded else []))


def decode(rows: DataFrame, model: Transducer, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and the text of its ids in the column ``into``."""
    if into in rows.columns:
        raise ValueError(f"the table has a column {into!r}")
    held = rows.sparkSession.sparkContext.broadcast(model.decoder)
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                col = part.column(at)
                off, flat = col.offsets.to_numpy().tolist(), col.values  # to_pylist makes an object per id first
                null = col.is_null().to_pylist()
                flat = flat.fill_null(-1).to_numpy()  # a null id is no id of the model
                strange = np.concatenate([[0], np.cumsum((flat < 0) | (flat >= len(m.raw)))]).tolist()
                got = [None if no or strange[b] != strange[a] else m.decode(flat[a:b].tolist())
                       for no, a, b in zip(null, off, off[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string())], names=[*part.schema.names, into])

    from pyspark.sql.types import StringType, StructField, StructType
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(into, StringType())]))
