"""Operator 9: repeated long substrings, by a logarithmic family of suffix arrays.

A byte is removed if a string of ``LENGTH`` bytes over it also starts earlier
(smaller id, or same document and smaller offset), judged on the input.

Method, in three steps.

1. Suffixes are sampled by content: of each ``LENGTH`` bytes the one whose first
   ``PREFIX`` bytes hash least starts a sampled suffix, so two equal strings of
   that length have a sampled suffix at the same place in both.  (An array of all
   suffixes takes 16 bytes for each byte of text, more than may be moved.)
   Suffixes whose prefix, with the bytes on one side of it, occurs once drop out,
   by their hashes: two with a string in common share a side.
2. The bytes of the others' contexts (what a string through them can reach) are
   fetched and sent to the partition of their prefix, where they arrive in
   document order.  Each batch becomes a suffix array: sorted by the bytes from
   the suffix on, then by those before it.  It is merge-scanned against the levels
   of the index: a suffix whose whole context stands there, or earlier in the
   batch, came earlier with all strings through it; with each other one of its
   prefix the common lengths ahead and behind are measured, and where they come
   to ``LENGTH`` bytes, these came earlier.  New contexts become the smallest
   level; levels of equal size merge, so there are logarithmically many.
3. Prefixes with over ``FEW`` different contexts (a passage that many documents
   share has such at its edges) are not compared pair by pair.  All are measured
   against the first of them, the leader.  Another earlier one can only reach
   further than the leader if both part from it at the same place, and have the
   same byte there; so contexts are filed by where, and with which byte, they part
   from the leader behind and ahead, and each file has a leader again.  Over
   ``DENSE`` of them this is done in distributed steps, else within a task.

Hashes only say what to compare: all that is removed has been found equal byte by
byte.  Before the first exchange, each batch of documents keeps the first suffix of
each context and turns equal ones into spans, so that copies within a batch are
not sent.  Prefixes that are frequent in a sample of the documents are candidates
without meeting in one partition.  The text is moved by document once; the joins
read that exchange.

Defined cases: NULL text is empty; NULL ids come first in order (an id of
-2^63 reads as NULL); rows with equal id and text are one place and get the
same result; texts of any length are read in pieces; an empty table gives an
empty table; other columns are not read, and their names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.llm.common import documents, slices, to_arrow, written

LENGTH = 100
PREFIX = 32
#: What a string through a sampled suffix can have before it, and places among which one suffix is sampled.
BEFORE = LENGTH - PREFIX
PLACES = BEFORE + 1
WIDTH = BEFORE + LENGTH
#: A string through a sampled suffix has so many bytes before it, or after its prefix.
SIDE = BEFORE // 2
#: Bytes of a text that are hashed at once.
PIECE = 1 << 15
#: Different contexts of one prefix that are compared pair by pair, and that one task measures against leaders.
FEW, DENSE = 64, 100_000
#: Rows of crowded prefixes' suffixes that may be sent to all tasks instead of moving all texts to them.
SENT = 2_000_000
#: Contexts that a partition of the index holds on average, at most, and those of a batch; pairs that are compared at once.
HELD, BATCH, PAIRS = 25_000, 2048, 50_000
#: One document in so many is looked through for frequent prefixes; fewest there of one, and most of them.
SAMPLE, OFTEN, MOST_OFTEN = 64, 64, 10_000
#: Rows of one prefix over which all are candidates.
RUN = 16_384
NO_ID = -(1 << 63)

_R = np.random.Generator(np.random.PCG64(20))
_TABLE = _R.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _MOST = 0x9E3779B97F4A7C15, PIECE * 4 + 4 * WIDTH
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(_MOST, _BASE, np.uint64)])
_INVERSE = np.cumprod(np.r_[np.uint64(1), np.full(_MOST, pow(_BASE, -1, 1 << 64), np.uint64)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sliding(x: np.ndarray, size: int, op) -> np.ndarray:
    """``op`` over ``x[i : i + size]`` for every ``i``; what is past the end counts as the last value."""
    width, out = 1, np.r_[x, np.full(size, x[-1])]
    n = len(x)
    while 2 * width <= size:
        out = np.r_[op(out[:-width], out[width:]), out[len(out) - width :]]
        width *= 2
    return op(out[:n], out[size - width : size - width + n])


def sampled(pieces: list[tuple[int, int, int, bytes, int, int]]) -> tuple[np.ndarray, ...]:
    """Sampled suffixes of pieces of texts: text number, offset, bytes after it (up to ``LENGTH``), prefix hash,
    context hash, and two 32-bit hashes of its sides (0: shorter than ``SIDE``).

    A piece is ``(text number, its text's length, its offset, bytes, first, last)``; strings of ``LENGTH`` bytes
    are considered that start in ``[first, last)`` of the text, and the piece has their contexts.
    """
    data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
    sizes = np.array([len(p[3]) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    n = len(data)
    sums = np.r_[np.uint64(0), np.cumsum(_TABLE[data] * _POWERS[:n])]
    h = mixed((sums[PREFIX:] - sums[:-PREFIX]) * _INVERSE[: n - PREFIX + 1]) | np.uint64(1) if n >= PREFIX else np.empty(0, np.uint64)
    h = np.r_[h, np.full(n - len(h), np.uint64(0xFFFFFFFFFFFFFFFF))]
    valid = np.zeros(n, bool)
    for (_, _, at, _, first, last), s in zip(pieces, starts.tolist()):
        valid[s + first - at : s + last - at] = True
    least = np.where(valid, _sliding(h, PLACES, np.minimum), np.uint64(0))
    reach = _sliding(np.r_[least[::-1], np.uint64(0)], PLACES, np.maximum)[:n][::-1]
    found = np.flatnonzero((reach == h) & (reach > 0))
    piece = np.searchsorted(starts, found, "right") - 1
    of = np.array([p[:3] for p in pieces], np.int64).reshape(-1, 3)[piece]
    offset = found - starts[piece] + of[:, 2]
    left, right = np.minimum(offset, BEFORE), np.minimum(of[:, 1] - offset, LENGTH)
    context = mixed((sums[found + right] - sums[found - left]) * _INVERSE[found - left]) + (left * 512 + right).astype(np.uint64)
    a, b = found - np.where(left >= SIDE, SIDE, 0), found + np.where(right >= PREFIX + SIDE, PREFIX + SIDE, 0)
    before, after = (mixed((sums[y] - sums[x]) * _INVERSE[x]) for x, y in ((a, found), (found, b)))
    sides = (before >> np.uint64(32) | np.uint64(1)) * (a < found) << np.uint64(32) | (after >> np.uint64(32) | np.uint64(1)) * (b > found)
    return of[:, 0], offset, right, h[found], mixed(context), sides


def pieces_of(number: int, text: bytes) -> Iterator[tuple[int, int, int, bytes, int, int]]:
    n = len(text)
    for first in range(0, n - LENGTH + 1, PIECE):
        last = min(first + PIECE, n - LENGTH + 1)
        at = max(0, first - BEFORE)
        yield number, n, at, text[at : last + BEFORE + LENGTH], first, last


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as disjoint ones in order."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    return starts[new], ends[np.r_[new[1:] - 1, len(ends) - 1]]


def spans_by(number: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The union of each number's intervals, as bytes of int64 pairs."""
    order = np.argsort(number, kind="stable")
    number, starts, ends = number[order], starts[order], ends[order]
    cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]).tolist() if len(number) else []
    for a, b in zip(cuts, [*cuts[1:], len(number)]):
        yield int(number[a]), np.stack(merged(starts[a:b], ends[a:b]), 1).astype("<i8").tobytes()


#: A suffix: hashes of its prefix (and whether that is frequent), context and sides, and its place; or spans of a document.
_SAMPLES = "key long, often boolean, context long, sides long, doc long, tie long, at long, spans binary"
#: A candidate (``key`` not NULL), or spans of a document.
_FOUND = "doc long, tie long, key long, context long, at long, spans binary"


def _sample(schema: pa.Schema, frequent: np.ndarray):
    """Sampled suffixes of batches of documents, and spans of those whose context came earlier in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                yield from one(whole.slice(lo, 4096))

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rank = np.lexsort((tie, doc))
        doc, tie = doc[rank], tie[rank]
        waiting, held, out, texts = [], 0, [], {}
        repeated = np.r_[False, (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1])]
        for i, r in enumerate(rank.tolist()):
            if repeated[i]:
                continue
            text = (batch.column(2)[r].as_py() or "").encode()
            texts[i] = text
            for p in pieces_of(i, text):
                waiting.append(p)
                held += len(p[3])
                if held >= PIECE:
                    out.append(sampled(waiting))
                    waiting, held = [], 0
        if waiting:
            out.append(sampled(waiting))
        if not out:
            return
        number, offset, right, key, context, sides = (np.concatenate(x) for x in zip(*out))
        same_place = np.r_[False, (number[1:] == number[:-1]) & (offset[1:] == offset[:-1])]  # seen from two pieces
        if same_place.any():
            number, offset, right, key, context, sides = (x[~same_place] for x in (number, offset, right, key, context, sides))
        order = np.argsort(key ^ (context << np.uint64(1)), kind="stable")
        k, c = key[order], context[order]
        again = np.r_[False, (k[1:] == k[:-1]) & (c[1:] == c[:-1])]
        if again.any():  # hashes are equal; the bytes have to be too
            leader = np.maximum.accumulate(np.where(again, -1, np.arange(len(order))))
            left = np.minimum(offset, BEFORE)
            of = lambda i: texts[int(number[i])][int(offset[i] - left[i]) : int(offset[i] + right[i])]
            for at in np.flatnonzero(again).tolist():
                i, j = order[at], order[leader[at]]
                again[at] = left[i] == left[j] and right[i] == right[j] and of(i) == of(j)
        first, later = np.sort(order[~again]), order[again]
        rows = list(spans_by(number[later], offset[later] - np.minimum(offset[later], BEFORE), offset[later] + right[later]))
        m, at = len(first), np.array([r[0] for r in rows], np.int64)
        none = np.zeros(len(at), np.int64)
        both = lambda x, y: pa.array(np.r_[x.view(np.int64), y.view(np.int64)])
        often = np.isin(key[first], frequent)
        yield pa.RecordBatch.from_arrays(
            [
                both(key[first], mixed(doc[at].view(np.uint64))), pa.array(np.r_[often, np.zeros(len(at), bool)]), both(context[first], none), both(sides[first], none), both(doc[number[first]], doc[at]), both(tie[number[first]], tie[at]),
                both(offset[first] * 128 + right[first], none - 1), pa.array([None] * m + [r[1] for r in rows], pa.binary()),
            ], schema=schema,
        )

    return run


def _candidates(schema: pa.Schema):
    """Suffixes, in the order of prefix hashes, that share the bytes on a side with another; and spans as they are."""

    def shared(codes: np.ndarray) -> np.ndarray:
        """Which codes occur more than once; zero never does."""
        order = np.argsort(codes, kind="stable")
        twin = np.r_[codes[order][1:] == codes[order][:-1], False]
        twin[1:] |= twin[:-1].copy()
        out = np.empty(len(codes), bool)
        out[order] = twin
        return out & (codes != 0)

    def told(key, often, context, sides, doc, tie, at) -> pa.RecordBatch:
        lo, hi = sides & np.uint64(0xFFFFFFFF), sides >> np.uint64(32)
        same = often.copy()
        for side, salt in ((lo, np.uint64(_BASE)), (hi, np.uint64(_BASE ^ 0x5555))):
            same |= shared(np.where(side > 0, mixed(key ^ side * salt) | np.uint64(1), np.uint64(0)))
        return pa.RecordBatch.from_arrays([pa.array(doc[same]), pa.array(tie[same]), pa.array(key[same].view(np.int64)), pa.array(context[same].view(np.int64)), pa.array(at[same] >> 7), pa.nulls(int(same.sum()), pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        long: np.uint64 | None = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            spans = np.flatnonzero(cols[6] < 0)
            if len(spans):
                none = pa.nulls(len(spans), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cols[4][spans]), pa.array(cols[5][spans]), none, none, none, batch.column(7).take(pa.array(spans))], schema=schema)
            now = tuple(x[cols[6] >= 0] for x in (cols[0].view(np.uint64), cols[1], cols[2].view(np.uint64), cols[3].view(np.uint64), *cols[4:]))
            if long is not None and len(now[0]):  # the rest of a run that is told as it comes
                n = int(np.argmin(now[0] == long)) if (now[0] != long).any() else len(now[0])
                yield told(now[0][:n], np.ones(n, bool), *(x[:n] for x in now[2:]))
                now = tuple(x[n:] for x in now)
                long = long if not len(now[0]) else None
            held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0].view(np.int64), held[0].view(np.int64)[-1], "left"))
            if last:
                yield told(*(x[:last] for x in held))
                held = tuple(x[last:] for x in held)
            if len(held[0]) > RUN:
                long = held[0][0]
                yield told(held[0], np.ones(len(held[0]), bool), *held[2:])
                held = tuple(x[:0] for x in held)
        if held is not None and len(held[0]):
            yield told(*held)

    return run


# Suffix arrays. A row has the bytes from the suffix on, those before it in reverse, and how many there are.

_AHEAD, _BEHIND = -(-LENGTH // 8) * 8, -(-BEFORE // 8) * 8
_ROW = _AHEAD + _BEHIND + 8


def rows_of(before: list[int], contexts: list[bytes]) -> np.ndarray:
    """A row of bytes for each context, whose order is that of the suffixes, and then of what is before them."""
    end = bytes(6)
    parts = []
    for b, c in zip(before, contexts):
        parts += [c[b:].ljust(_AHEAD, b"\0"), c[:b][::-1].ljust(_BEHIND, b"\0"), bytes((len(c) - b + 1, b + 1)), end]
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, _ROW)


def _whole(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{_ROW}").ravel()


def _prefix(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[:, :PREFIX]).view(f"S{PREFIX}").ravel()


def _common(x: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes before the first that isn't zero, by row of words, ``most`` at most."""
    some = x != 0
    first = some.argmax(1)
    word = x[np.arange(len(x)), first]
    low = word & (~word + np.uint64(1))
    n = 8 * first + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8
    return np.minimum(np.where(some.any(1), n, 1 << 20), most)


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common lengths behind and ahead of the suffixes of rows ``a`` and ``b``."""
    x = a[:, : _AHEAD + _BEHIND].copy().view(np.uint64) ^ b[:, : _AHEAD + _BEHIND].copy().view(np.uint64)
    most = np.minimum(a[:, -8:-6], b[:, -8:-6]).astype(np.int64) - 1
    return _common(x[:, _AHEAD // 8 :], most[:, 1]), _common(x[:, : _AHEAD // 8], most[:, 0])


class Reach:
    """How far behind and ahead of each suffix strings go that came earlier: all these go over the suffix's first byte."""

    def __init__(self, n: int):
        self.behind, self.ahead = np.full(n, -1), np.full(n, -1)

    def add(self, who: np.ndarray, behind: np.ndarray, ahead: np.ndarray) -> None:
        """Common lengths with an earlier suffix; ``who`` may repeat."""
        long = behind + ahead >= LENGTH
        np.maximum.at(self.behind, who[long], behind[long])
        np.maximum.at(self.ahead, who[long], ahead[long])

    def whole(self, rows: np.ndarray, who: np.ndarray) -> None:
        self.add(who, rows[who, -7].astype(np.int64) - 1, rows[who, -8].astype(np.int64) - 1)

    def spans(self, doc: np.ndarray, tie: np.ndarray, at: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The spans of documents, put together where suffixes of a document stand together."""
        who = np.flatnonzero(self.behind >= 0)
        if len(who):
            d, t = doc[who], tie[who]
            number = np.cumsum(np.r_[0, (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
            first = np.flatnonzero(np.diff(number, prepend=-1))
            found = [x for _, x in spans_by(number, at[who] - self.behind[who], at[who] + self.ahead[who])]
            yield pa.RecordBatch.from_arrays([pa.array(d[first]), pa.array(t[first]), pa.array(found, pa.binary())], schema=schema)


def settle(rows: np.ndarray) -> Reach:
    """What came earlier of contexts of one file, in the order of their places, measured against leaders."""
    reach = Reach(len(rows))
    _, first, of = np.unique(_whole(rows), return_index=True, return_inverse=True)
    reach.whole(rows, np.flatnonzero(first[of] != np.arange(len(rows))))
    todo, seen = [np.sort(first)], set()
    while todo:
        some = todo.pop()
        if len(some) <= FEW:
            i, j = np.triu_indices(len(some), 1)
            reach.add(some[j], *common(rows[some[i]], rows[some[j]]))
            continue
        rest = some[1:]
        parts = [common(rows[x], rows[np.repeat(some[:1], len(x))]) for x in np.split(rest, range(PAIRS, len(rest), PAIRS))]
        behind, ahead = (np.concatenate(x) for x in zip(*parts))
        reach.add(rest, behind, ahead)
        for n, of_, byte in ((behind, -7, _AHEAD), (ahead, -8, 0)):
            open_ = np.flatnonzero(n < rows[rest, of_].astype(np.int64) - 1)
            code = n[open_] * 256 + rows[rest[open_], byte + n[open_]]
            order = np.argsort(code, kind="stable")
            for part in np.split(rest[open_[order]], np.flatnonzero(np.diff(code[order])) + 1):
                if len(part) > 1 and (name := part.tobytes()) not in seen:
                    seen.add(name)
                    todo.append(part)
    return reach


class Levels:
    """The index: levels of suffix arrays, each at least twice as long as the next."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def has(self, whole: np.ndarray) -> np.ndarray:
        """Which of these sorted contexts stand in a level."""
        found = np.zeros(len(whole), bool)
        for _, of, _ in self.levels:
            at = np.minimum(np.searchsorted(of, whole), len(of) - 1)
            found |= of[at] == whole
        return found

    def meet(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of sorted rows, and rows of the levels with the same prefix, in pieces."""
        prefix = _prefix(rows)
        for level, _, prefixes in self.levels:
            lo, hi = np.searchsorted(prefixes, prefix, "left"), np.searchsorted(prefixes, prefix, "right")
            some = np.flatnonzero(hi > lo)
            n = (hi - lo)[some]
            cuts = np.flatnonzero(np.diff(np.cumsum(n) // PAIRS, prepend=-1))
            for part, size in zip(np.split(some, cuts[1:]), np.split(n, cuts[1:])):
                if len(part):
                    yield np.repeat(part, size), level[np.repeat(lo[part] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]

    def add(self, rows: np.ndarray) -> None:
        """Another level of sorted rows, merged with those that aren't twice as long."""
        self.levels.append((rows, _whole(rows), _prefix(rows)))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
            (b, x, _), (a, y, _) = self.levels.pop(), self.levels.pop()
            # a merge: each array's place is its own number plus the other's before it
            place = np.r_[np.arange(len(a)) + np.searchsorted(x, y, "left"), np.arange(len(b)) + np.searchsorted(y, x, "right")]
            both = np.empty((len(a) + len(b), _ROW), np.uint8)
            both[place] = np.concatenate((a, b))
            self.levels.append((both, _whole(both), _prefix(both)))


def _within(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of numbers of sorted rows with one prefix, in pieces."""
    prefix = _prefix(rows)
    starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
    sizes = np.diff(np.r_[starts, len(rows)])
    left = np.repeat(starts + sizes, sizes) - np.arange(len(rows))
    for d in range(1, int(sizes.max(initial=0))):
        i = np.flatnonzero(left > d)
        yield i, i + d


def _scan(schema: pa.Schema):
    """Spans of what came earlier, from contexts ``(doc, tie, at, before, context)`` in document order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last = Levels(), None
        for batch in slices(batches, BATCH):
            doc, tie, at, before = (batch.column(i).to_numpy() for i in range(4))
            rows = rows_of(before.tolist(), batch.column(4).to_pylist())
            place = np.stack((doc, tie, at))
            fresh = np.r_[last is None or bool((place[:, 0] != last).any()), (place[:, 1:] != place[:, :-1]).any(0)]  # else a repeated row's
            last = place[:, -1]
            doc, tie, at, rows = doc[fresh], tie[fresh], at[fresh], rows[fresh]
            whole = _whole(rows)
            order = np.argsort(whole, kind="stable")
            whole = whole[order]
            known = np.r_[False, whole[1:] == whole[:-1]] | index.has(whole)
            reach = Reach(len(rows))
            reach.whole(rows, order[known])
            new = order[~known]
            some = rows[new]
            for mine, theirs in index.meet(some):
                reach.add(new[mine], *common(some[mine], theirs))
            for i, j in _within(some):
                reach.add(np.maximum(new[i], new[j]), *common(some[i], some[j]))
            yield from reach.spans(doc, tie, at, schema)
            if len(new):
                index.add(some)

    return run


_CONTEXTS = "key long, doc long, tie long, at long, before int, context binary"


def _fetch(schema: pa.Schema):
    """Contexts of suffixes, from rows ``(doc, tie, text, asked)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                for doc, tie, text, asked in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                    text = (text or "").encode()
                    for q in asked:
                        first = max(0, q["at"] - BEFORE)
                        out.append((q["key"], doc, tie, q["at"], q["at"] - first, text[first : q["at"] + LENGTH]))
                for i in range(0, len(out), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 20_000]), schema)], schema=schema)

    return run


#: Crowded contexts, and spans of what a leader has (``path`` NULL).
_FILED = "path long, doc long, tie long, at long, before int, context binary, spans binary"


def _against(schema: pa.Schema):
    """Spans of contexts by their files' leaders, and the files of those that part from it in the same way.

    From rows ``(path, doc, tie, at, before, context)`` and the leader's ``doc, tie, at, before, context``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                path, doc, tie, at, before = (part.column(i).to_numpy() for i in range(5))
                _, first, of = np.unique(path, return_index=True, return_inverse=True)
                rows = rows_of(before.tolist(), part.column(5).to_pylist())
                leads = part.take(pa.array(first))
                lead = rows_of(leads.column(9).to_pylist(), leads.column(10).to_pylist())
                behind, ahead = common(rows, lead[of])
                own = np.ones(len(path), bool)
                for mine, theirs in ((doc, 6), (tie, 7), (at, 8)):
                    own &= mine == leads.column(theirs).to_numpy()[of]
                long = np.flatnonzero(~own & (behind + ahead >= LENGTH))
                found = list(spans_by(long, at[long] - behind[long], at[long] + ahead[long]))
                if found:
                    of_ = pa.array([f[0] for f in found])
                    none = [pa.nulls(len(found), f.type) for f in schema]
                    yield pa.RecordBatch.from_arrays([none[0], part.column(1).take(of_), part.column(2).take(of_), *none[3:6], pa.array([f[1] for f in found], pa.binary())], schema=schema)
                whole = np.arange(len(path))
                for salt, n, most, byte in ((1, behind, before, _AHEAD), (2, ahead, rows[:, -8].astype(np.int64) - 1, 0)):
                    some = np.flatnonzero(~own & (n < most))
                    code = (n[some].astype(np.uint64) << np.uint64(9)) + rows[whole[some], byte + n[some]] * np.uint64(2) + np.uint64(salt << 20)
                    files = mixed(mixed(path[some].view(np.uint64)) ^ mixed(code)).view(np.int64)
                    if len(some):
                        at_ = pa.array(some)
                        yield pa.RecordBatch.from_arrays([pa.array(files), *(part.column(i).take(at_) for i in range(1, 6)), pa.nulls(len(some), pa.binary())], schema=schema)

    return run


def _grouped(schema: pa.Schema):
    """Spans of what came earlier in a file, from contexts in the order of file and place, ``DENSE`` in one at most."""

    def done(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, tie, at, rows = (np.concatenate(x) for x in list(zip(*held))[1:])
        place = np.stack((doc, tie, at))
        once = np.r_[True, (place[:, 1:] != place[:, :-1]).any(0)]
        yield from settle(rows[once]).spans(doc[once], tie[once], at[once], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            path, doc, tie, at, before = (batch.column(i).to_numpy() for i in range(5))
            rows = rows_of(before.tolist(), batch.column(5).to_pylist())
            cuts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]]).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(path)]):
                if held and held[-1][0] != path[a]:
                    yield from done(held)
                    held.clear()
                held.append((path[a], doc[a:b], tie[a:b], at[a:b], rows[a:b]))
        if held:
            yield from done(held)

    return run


def _crowded_spans(files: DataFrame, dense: int) -> DataFrame:
    """``(doc, tie, spans)`` from a table of contexts ``(path, doc, tie, at, before, context)`` of crowded prefixes."""
    spark = files.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["path", "doc", "tie", "at", "before", "context"]
    spans_schema = "doc long, tie long, spans binary"
    against, grouped = _against(to_arrow(spark, _FILED)), _grouped(to_arrow(spark, spans_schema))
    out = []
    while True:
        rows = files.count()
        counts = written(files.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"), "files", rows // 2)
        few = files.join(counts.filter(F.col("n") <= dense).select("path"), "path").select(*columns)
        out.append(few.repartition(max(parts, rows // HELD), "path").sortWithinPartitions("path", "doc", "tie", "at").mapInArrow(grouped, spans_schema))
        many = counts.filter(F.col("n") > dense).select("path")
        if many.isEmpty():
            return reduce(DataFrame.union, out)
        state = written(files.join(many, "path").select(*columns), "crowded-contexts", rows)
        leaders = written(state.groupBy("path").agg(F.min(F.struct(*columns[1:])).alias("lead")), "leaders", rows // dense)
        step = state.join(leaders, "path").select(*columns, *(F.col(f"lead.{c}").alias(f"lead_{c}") for c in columns[1:]))
        step = written(step.mapInArrow(against, _FILED), "parted", 2 * rows)
        out.append(step.filter("path is null").select("doc", "tie", "spans"))
        files = step.filter("path is not null").select(*columns)


def _remove(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode()
                removed = np.frombuffer(b"".join(spans or ()), "<i8").reshape(-1, 2)
                kept, last, n, gone = [], 0, 0, 0
                if len(removed):
                    starts, ends = merged(removed[:, 0], removed[:, 1])
                    n, gone = len(starts), int((ends - starts).sum())
                    for a, b in zip(starts.tolist(), ends.tolist()):
                        kept.append(data[last:a])
                        last = b
                kept.append(data[last:])
                out.append({"doc_id": None if doc == NO_ID else doc, "n_bytes": len(data), "n_removed": gone, "n_spans": n, "kept": b"".join(kept)})
            yield pa.RecordBatch.from_pylist([x | {"kept_sha256": hashlib.sha256(x["kept"]).hexdigest()} for x in out], schema=schema)

    return run


def frequent_prefixes(docs: DataFrame) -> np.ndarray:
    """Prefix hashes that are frequent in a sample of ``docs (doc, tie, text)``: they only decide where suffixes are sent."""
    schema = to_arrow(docs.sparkSession, _SAMPLES)
    some = docs.filter(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0)
    counts = some.mapInArrow(_sample(schema, np.empty(0, np.uint64)), _SAMPLES).filter("at >= 0").groupBy("key").agg(F.count("*").alias("n"))
    top = counts.filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "key").limit(MOST_OFTEN).select("key").collect()
    return np.array([r.key for r in top], np.int64).view(np.uint64)


def removed(df: DataFrame, key: str = "doc_id", text: str = "text", few: int = FEW, dense: int = DENSE, kept: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` for every row; ``kept``: the remaining bytes, on demand."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arrow = lambda x: to_arrow(spark, x)
    twice = not df.groupBy(key).count().filter("count > 1").isEmpty()
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), (F.xxhash64(text) if twice else F.lit(0).cast("long")).alias("tie"), F.col(text).alias("text"))
    samples = docs.mapInArrow(_sample(arrow(_SAMPLES), frequent_prefixes(docs)), _SAMPLES)
    spread = F.when(F.col("often"), F.xxhash64("doc", "at")).otherwise(F.col("key"))
    samples = samples.repartition(parts, spread).sortWithinPartitions("key")
    found = written(samples.mapInArrow(_candidates(arrow(_FOUND)), _FOUND), "candidates")
    asked = found.filter("key is not null").select("doc", "tie", "key", "context", "at")
    crowded = asked.groupBy("key", "context").agg(F.first("at").alias("x")).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > few).select("key")
    crowded = written(crowded, "crowded")

    def contexts(asked: DataFrame, sent: bool = False) -> DataFrame:
        by_doc = asked.groupBy("doc", "tie").agg(F.collect_list(F.struct("key", "at")).alias("asked"))
        by_doc = F.broadcast(by_doc) if sent else by_doc
        return docs.join(by_doc, ["doc", "tie"]).select("doc", "tie", "text", "asked").mapInArrow(_fetch(arrow(_CONTEXTS)), _CONTEXTS)

    spans_schema = "doc long, tie long, spans binary"
    none = crowded.isEmpty()
    index_parts = max(parts, -(-asked.count() // HELD))
    indexed = contexts(asked if none else asked.join(crowded, "key", "left_anti")).repartition(index_parts, "key").select("doc", "tie", "at", "before", "context")
    indexed = indexed.sortWithinPartitions("doc", "tie", "at").mapInArrow(_scan(arrow(spans_schema)), spans_schema)
    spans = found.filter("key is null").select("doc", "tie", "spans").union(indexed)
    if not none:
        crowd = written(asked.join(crowded, "key", "left_semi"), "crowd")
        files = written(contexts(crowd, crowd.count() <= SENT).withColumnRenamed("key", "path"), "crowded-contexts")
        spans = spans.union(_crowded_spans(files, dense))
    by_doc = spans.groupBy("doc", "tie").agg(F.collect_list("spans").alias("spans"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept
    return docs.join(by_doc, ["doc", "tie"], "left").select("doc", "text", "spans").mapInArrow(_remove(arrow(out)), out)


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``: its bytes, those removed, their runs, and a digest of the rest."""
    return removed(documents(spark, sf_dir), kept=False)


#: For ids that don't repeat; every string of every text, as hexadecimal digits, by its 64-bit hash.
ORACLE = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, {2 * LENGTH})) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - {LENGTH - 1}, 0))) AS i FROM d)),
f AS (SELECT g, min(doc_id::HUGEINT * 4294967296 + i) AS at FROM g GROUP BY g HAVING count(*) > 1),
r AS (SELECT g.doc_id, g.i FROM g JOIN f ON g.g = f.g WHERE f.at <> g.doc_id::HUGEINT * 4294967296 + g.i),
s AS (SELECT *, CASE WHEN i > lag(i) OVER w + {LENGTH} THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
v AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM u GROUP BY doc_id, run),
x AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM v),
y AS (SELECT x.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM x JOIN d ON x.doc_id = d.doc_id GROUP BY x.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN y ON d.doc_id = y.doc_id"""
