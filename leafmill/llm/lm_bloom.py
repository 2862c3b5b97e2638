"""Language-model scores from a log-frequency Bloom filter.

Training texts' tokens (lower-cased words, then one end) are counted as single tokens and as pairs with the token before
(a start for the first). A count c has level 1 + floor(log2(c)); the filter holds each n-gram once for every level up to
its own, and a lookup probes levels 1, 2, ... until one is missing. The count behind level q is taken as 1 for q = 1, else
1.4 * 2^(q-1). Probabilities are smoothed by a Dirichlet prior of MU pseudo-counts dealt as single tokens are:

    p(w | h) = (min(c(h, w), c(h)) + MU * p(w)) / (c(h) + MU),    p(w) = (c(w) + 1) / (N + V + 1).

The filter grows with the n-grams; none is left out. It is made of segments by hash. A segment is filled in one task from all
counts of its n-grams, which are summed on the map side by block. One part of the filter is broadcast: a bit for each training token and
`filter_bits` at most, in equal shares for the segments; it holds the n-grams with the highest counts, about a sixth of all levels. A
segment's other n-grams are in its second part, as large as they need, which stays in the shared folder. A lookup in the first part
that finds less than any n-gram held there would have is open. Open positions are sent by block of texts to the segment of their pair, each
distinct pair once with the rows that have it, and probe its second part there. What they add comes back as sums by row and block and
meets the rows of the block, which take the same two exchanges.

The words with the highest counts, at most `head_words`, are broadcast with their counts; others are rare. A pair with a rare word is kept in
that word's segment (of two, the later one's), where the word itself is and, with its exact count for the base score, its entry in a table of
rare words; so one place answers for both. Only where both words are rare and the first is open, two segments answer, and their levels meet
in the block. A rare word has few places, so no segment gets hot. Words are named by 64-bit hashes, n-grams by the first 48 bits of theirs: an
n-gram shares its name with one of 10^9 others once in 280,000, far less often than the filter finds one that isn't there (1 in 64).

A null text is empty: one token, the end. Rows get a row each, also those with the same doc_id; equal texts have equal scores but for the
order of sums. An empty training set has N = 0 and V = 0, an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BLANK, GRAM, hashed_steps, mix, remainder, ship, stored

FILTER_BITS, HEAD_WORDS = 1 << 28, 1 << 20
HASHES, MU = 6, 32.0
#: Tokens to a task that fills segments; tokens to a block of texts, whose n-grams a task sums before it sends them.
TASK_TOKENS, FLUSH = 2_000_000, 1_000_000
#: Segments to such a task, and how many of them are made for that at most: more only if there are as many tasks.
SPREAD, MOST_SPREAD = 8, 1 << 12
MIN_SEGMENT_BITS = 1 << 6
#: An open lookup, in place of a level.
OPEN = -1
#: Open positions of a block for a segment: distinct pairs, their rare words, levels (word, word before, pair), the number of rows that have
#: each pair, those rows, counted from the block's first, and how often they have it.
_SENT = {"kind": pa.int32(), "segment": pa.int64(), "block": pa.int64(), **dict.fromkeys(("keys", "words", "levels", "each", "rows", "repeats"), pa.binary())}
#: What comes first in a segment: its second part of the filter, and rare words with their counts.
_PARTS = {"more": pa.binary(), "names": pa.binary(), "counts": pa.binary()}
#: What a block's rows get: sums of log10 p; sums of log10 (c + 1) and numbers of known words; levels to meet those of another segment.
_GOT = dict.fromkeys(("at", "add", "base_at", "base_add", "base_known", "keys", "rows", "repeats", "levels"), pa.binary())
#: Kinds of open positions: both words frequent, this one rare, the one before rare; both rare and the one before open, as sent to the
#: segment of the one before, and of this one.
BOTH, OWN, BEFORE, FIRST, SECOND = range(5)
TOP_LEVEL = 50
END, START = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
_ONE, _LEVEL = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xD6E8FEB86659FD93)
#: The bits of an n-gram's name. The first ones say its segment, of which there are so many at most that 28 are left for the n-gram itself;
#: beyond 2 * 10^12 tokens it is segments that grow, not their number.
_NAME = np.uint64(((1 << 48) - 1) << 16)
MOST_SEGMENTS = 1 << 20


def _planes(x: np.ndarray, least: int = 0) -> bytes:
    """All first bytes of the numbers, then all second ones and so on, without the least ones: what they have in common compresses well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize)[:, least:].T.tobytes()


def _numbers(data: bytes, kind: type, least: int = 0) -> np.ndarray:
    size = np.dtype(kind).itemsize
    own = np.frombuffer(data, np.uint8).reshape(size - least, -1).T
    full = np.zeros((len(own), size), np.uint8)
    full[:, least:] = own
    return full.view(kind).ravel()


def _names(x: np.ndarray) -> bytes:
    """Names of n-grams, best in order."""
    return _planes(np.diff(x, prepend=np.uint64(0)), 2)


def _named(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, np.uint64, 2), dtype=np.uint64)


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of rows: first, last + 1, hashes of all tokens with ends, hashes of those before, and tokens before each row."""
    for lo, hi, h, before in hashed_steps(column, BLANK):
        own = np.insert(h, before[1:], END)
        at = before + np.arange(len(before))
        previous = np.empty_like(own)
        previous[1:] = own[:-1]
        previous[at[:-1]] = START
        yield lo, hi, own, previous, at


def _single(h: np.ndarray) -> np.ndarray:
    return mix(h * GRAM[5] + _ONE) & _NAME


def _pair(previous: np.ndarray, own: np.ndarray, rare_previous: np.ndarray, rare_own: np.ndarray, segments: int) -> np.ndarray:
    """Names of pairs, in the segment of a rare word if there is one."""
    of_segment = np.uint64((1 << 64) - (1 << 65 - segments.bit_length()))
    g = mix(previous * GRAM[6] + own * GRAM[7]) & _NAME
    some = np.flatnonzero(rare_previous | rare_own)
    anchor = _single(np.where(rare_own[some], own[some], previous[some]))
    g[some] = (anchor & of_segment) | (g[some] & ~of_segment)
    return g


def _in(head: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the sorted head has h, and where."""
    place = np.minimum(np.searchsorted(head, h), max(0, len(head) - 1))
    return (head[place] == h if len(head) else np.zeros(len(h), bool)), place


def _before(x: np.ndarray, at: np.ndarray, first) -> np.ndarray:
    """What the token before has; first where there is none."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[at[:-1]] = first
    return out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts)], ["h", "c"])

    for batch in batches:
        for _, _, own, _, _ in tokens(batch.column(0)):
            held.append(np.unique(own, return_counts=True))
            size += len(held[-1][0])
        if size > FLUSH:
            yield out()
            held, size = [], 0
    if size:
        yield out()


class Filter:
    """The bits, and where an n-gram's are. bits and segments are powers of two.

    edges: of each segment, the least count held, and the first n-gram with this count that isn't held any more.
    """

    def __init__(self, data: np.ndarray, segments: int, edges: tuple[np.ndarray, np.ndarray] | None = None):
        self.data, self.segments, self.size, self.edges = data, segments, len(data) * 8 // segments, edges

    @staticmethod
    def places(g: np.ndarray, level: int, segment_bits: int) -> Iterator[np.ndarray]:
        """An n-gram's places in its segment at a level, one for each hash."""
        x = mix(g + _salt(level))
        step = (x >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            yield (x + np.uint64(i) * step) & np.uint64(segment_bits - 1)

    def levels(self, g: np.ndarray) -> np.ndarray:
        found = np.zeros(len(g), np.int64)
        base = segment_of(g, self.segments).astype(np.uint64) * np.uint64(self.size)
        live = np.arange(len(g))
        for level in range(1, TOP_LEVEL):
            for i in range(HASHES):
                x = mix(g[live] + _salt(level))
                at = base[live] + ((x + np.uint64(i) * ((x >> np.uint64(32)) | np.uint64(1))) & np.uint64(self.size - 1))
                live = live[(self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                if not len(live):
                    return found
            found[live] = level
        return found

    def closed(self, g: np.ndarray) -> np.ndarray:
        """Levels, or OPEN where the n-gram, if there is one, isn't held here."""
        q = self.levels(g)
        count, first = (x[segment_of(g, self.segments)] for x in self.edges)
        least = count + (g >= first)
        return np.where((least > 1) & (q < level_of(least)), OPEN, q)


def _salt(level: int) -> np.uint64:
    return np.uint64(level * int(_LEVEL) % (1 << 64))


def level_of(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(c, 1))).astype(np.int64)


def count_of(q: np.ndarray) -> np.ndarray:
    return np.where(q <= 1, q, 1.4 * np.exp2(q - 1.0))


def logs(own: np.ndarray, before: np.ndarray, pair: np.ndarray, size: int) -> np.ndarray:
    """log10 p from the levels of word, word before and pair; size: N + V + 1."""
    context = count_of(before)
    return np.log10((np.minimum(count_of(pair), context) + MU * (count_of(own) + 1) / size) / (context + MU))


def segment_of(g: np.ndarray, segments: int) -> np.ndarray:
    return (g >> np.uint64(65 - segments.bit_length())).astype(np.int64) if segments > 1 else np.zeros(len(g), np.int64)


def _send(segments: int, head):
    """Tokens to rows segment, keys, counts: sums of a block of n-grams. head: broadcast, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            edge = np.searchsorted(segment_of(keys, segments), np.arange(segments + 1))
            full = np.flatnonzero(np.diff(edge))
            part = lambda x, f: pa.array([f(x[edge[s] : edge[s + 1]]) for s in full], pa.binary())
            return pa.record_batch([pa.array(full, pa.int64()), part(keys, _names), part(counts.astype(np.uint32), _planes)], ["segment", "keys", "counts"])

        for batch in batches:
            for _, _, own, previous, at in tokens(batch.column(0)):
                distinct, which = np.unique(own, return_inverse=True)
                rare = ~_in(head.value, distinct)[0][which]
                held += [_single(own), _pair(previous, own, _before(rare, at, False), rare, segments), np.repeat(_single(np.array([START])), len(at) - 1)]
                size += len(own)
                if size > FLUSH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def _bits(g: np.ndarray, q: np.ndarray, size: int) -> bytes:
    bits = np.zeros(size, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        for at in Filter.places(g[q >= level], level, size):
            bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _fill(segment_bits: int):
    """Rows of a segment, which come together, to segment, its edge (count, first), bits, and bits of the second part (null if it is empty)."""

    def segment(number: int, keys: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
        k, c = _summed(np.concatenate([_named(x) for x in keys]), np.concatenate([_numbers(x, np.uint32) for x in counts]).astype(np.int64))
        q = level_of(c)
        # keys are sorted, so equal counts stand by hash
        order = np.argsort(-c, kind="stable")
        fits = int(np.searchsorted(np.cumsum(q[order]), int(segment_bits * np.log(2) / HASHES), "right"))
        held, rest = order[:fits], order[fits:]
        edge, more = (0, 0), None
        if len(rest):
            edge = int(c[rest[0]]), int(k[rest[0]])
            more = _bits(k[rest], q[rest], 1 << max(6, int(np.ceil(np.log2(q[rest].sum() * HASHES / np.log(2))))))
        columns = [pa.array([number], pa.int64()), pa.array([edge[0]], pa.int64()), pa.array(np.array([edge[1]], np.uint64).view(np.int64)), pa.array([_bits(k[held], q[held], segment_bits)], pa.binary()), pa.array([more], pa.binary())]
        return pa.record_batch(columns, ["segment", "count", "first", "bits", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts = None, [], []
        for batch in batches:
            for s, k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if s != now and keys:
                    yield segment(now, keys, counts)
                    keys, counts = [], []
                now = s
                keys.append(k)
                counts.append(c)
        if keys:
            yield segment(now, keys, counts)

    return run


class Positions:
    """Open pairs (name, kind, rare word, levels by row: word, word before and pair; number of rows), and the rows and repeats of each in turn."""

    def __init__(self, *columns: np.ndarray):
        self.all = columns

    @classmethod
    def merged(cls, parts: list[Positions]) -> Positions:
        return cls(*(np.concatenate(x) for x in zip(*(p.all for p in parts), strict=True)))

    def sent(self, segments: int, block: int) -> Iterator[list]:
        """Values of _SENT."""
        keys, kinds, words, levels, each, rows, repeats = self.all
        segment = segment_of(np.where(kinds == FIRST, _single(words), keys), segments)
        order = np.lexsort((keys, segment, kinds))
        begin = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        group = kinds.astype(np.int64)[order] * segments + segment[order]
        edge = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0, [True]]))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            x = order[lo:hi]
            n = each[x].astype(np.int64)
            entry = np.repeat(begin[x] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            kind = int(kinds[x[0]])
            yield [
                kind, int(segment[x[0]]), block, _names(keys[x]), b"" if kind == BOTH else _planes(words[x]),
                np.ascontiguousarray(levels[x].T).tobytes(), _planes(each[x]), _planes(rows[entry]), _planes(repeats[entry]),
            ]

    @classmethod
    def read(cls, kind: int, block: int, keys: bytes, words: bytes, levels: bytes, each: bytes, rows: bytes, repeats: bytes) -> Positions:
        k = _named(keys)
        w = _numbers(words, np.uint64) if words else np.zeros(len(k), np.uint64)
        return cls(k, np.full(len(k), kind, np.int8), w, np.frombuffer(levels, np.int8).reshape(3, -1).T, _numbers(each, np.uint32), _numbers(rows, np.uint32), _numbers(repeats, np.uint32))


class Segment:
    """What a segment can tell: levels of its second part, and counts of its rare words."""

    def __init__(self) -> None:
        self.more: Filter | None = None
        self.names, self.counts = [], []

    def levels(self, g: np.ndarray) -> np.ndarray:
        return self.more.levels(g) if self.more else np.zeros(len(g), np.int64)

    def count(self, h: np.ndarray) -> np.ndarray:
        if isinstance(self.names, list):
            names = np.concatenate([_numbers(x, np.uint64) for x in self.names]) if self.names else np.zeros(0, np.uint64)
            counts = np.concatenate([_numbers(x, np.int64) for x in self.counts]) if self.counts else np.zeros(0, np.int64)
            order = np.argsort(names)
            self.names, self.counts = names[order], counts[order]
        known, place = _in(self.names, h)
        return np.where(known, self.counts[place] if len(self.names) else 0, 0)

    def resolved(self, blocks: list[tuple], size: int) -> Iterator[dict]:
        """Messages to values of _GOT by block."""
        parts = [Positions.read(*r) for r in blocks]
        keys, kinds, words, levels, each, rows, repeats = Positions.merged(parts).all
        for column, at, names in ((2, kinds != FIRST, keys), (0, (kinds == OWN) | (kinds == SECOND), _single(words)), (1, (kinds == BEFORE) | (kinds == FIRST), _single(words))):
            at = np.flatnonzero(at & (levels[:, column] == OPEN))
            levels[at, column] = self.levels(names[at])
        block = np.array([r[1] for r in blocks])
        number = np.repeat(np.arange(len(blocks)), [len(x.all[5]) for x in parts])
        place = (number << 32) | rows
        entry = np.repeat(np.arange(len(keys)), each)
        half = (kinds == FIRST) | (kinds == SECOND)
        p = np.where(half, 0.0, logs(*np.maximum(levels, 0).astype(np.int64).T, size))
        rare = (kinds == OWN) | (kinds == SECOND)
        c = np.zeros(len(keys), np.int64)
        c[rare] = self.count(words[rare])
        got: dict[int, dict] = {i: {} for i in range(len(blocks))}

        def sums(at: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
            found, inverse = np.unique(place[at], return_inverse=True)
            total = [np.bincount(inverse, (v[entry[at]] * repeats[at]), len(found)) for v in values]
            edge = np.searchsorted(found, np.arange(len(blocks) + 1) << 32)
            for i in np.flatnonzero(np.diff(edge)):
                x = slice(edge[i], edge[i + 1])
                yield i, (found[x] & 0xFFFFFFFF).astype(np.uint32), [t[x] for t in total]

        for i, at, (add,) in sums(np.flatnonzero(~half[entry]), p):
            got[i] |= {"at": _planes(at), "add": _planes(add.astype(np.float32))}
        for i, at, (add, known) in sums(np.flatnonzero(rare[entry]), np.log10(c + 1.0), (c > 0).astype(float)):
            got[i] |= {"base_at": _planes(at), "base_add": _planes(add), "base_known": _planes(known.astype(np.uint32))}
        halves = np.flatnonzero(half[entry])
        for i in np.unique(number[halves]):
            x = halves[number[halves] == i]
            got[i] |= {"keys": _planes(keys[entry[x]]), "rows": _planes(rows[x]), "repeats": _planes(repeats[x]), "levels": np.ascontiguousarray(levels[entry[x]].T).tobytes()}
        for i, x in got.items():
            yield x | {"block": int(block[i])}


def _met(names: list[str], out: pa.Schema, size: int):
    """Rows of texts as they are; those of a segment, its parts first, to what its open positions get."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, Segment()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            text = pc.is_valid(table.column("row"))
            rows = table.filter(text).combine_chunks()
            if len(rows):
                yield from pa.table([rows.column(f.name) if f.name in ("block", *names) else pa.nulls(len(rows), f.type) for f in out], schema=out).to_batches()
            rest = table.filter(pc.invert(text)).select(["segment", *_PARTS, "kind", *list(_SENT)[2:]])
            found = []
            for segment, group in groupby(zip(*(c.to_pylist() for c in rest.columns), strict=True), lambda r: r[0]):
                if segment != now:
                    now, own = segment, Segment()
                blocks = []
                for r in group:
                    if r[1] is not None:
                        own.more = Filter(np.frombuffer(r[1], np.uint8), 1)
                    elif r[2] is not None:
                        own.names.append(r[2])
                        own.counts.append(r[3])
                    else:
                        blocks.append(r[4:])
                if blocks:
                    found += own.resolved(blocks, size)
            if found:
                yield pa.record_batch([pa.array([x.get(f.name) for x in found], f.type) for f in out], schema=out)

    return run


def _gathered(names: list[str], out: pa.Schema, size: int):
    """Rows of a block, which come together, to its texts with all sums."""

    def block(first: int, texts: list[pa.Table], got: list[dict]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(texts).combine_chunks()
        at = rows.column("row").to_numpy() - first
        n = int(at.max()) + 1
        score, base, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        halves = []
        for x in got:
            if x["at"] is not None:
                score[_numbers(x["at"], np.uint32)] += _numbers(x["add"], np.float32)
            if x["base_at"] is not None:
                own = _numbers(x["base_at"], np.uint32)
                base[own] += _numbers(x["base_add"], np.float64)
                known[own] += _numbers(x["base_known"], np.uint32)
            if x["keys"] is not None:
                halves.append((_numbers(x["rows"], np.uint32), _numbers(x["keys"], np.uint64), _numbers(x["repeats"], np.uint32), np.frombuffer(x["levels"], np.int8).reshape(3, -1).T))
        if halves:
            row, key, repeats, levels = (np.concatenate(x) for x in zip(*halves, strict=True))
            order = np.lexsort((key, row))
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(row[order]) != 0) | (np.diff(key[order]) != 0)]))
            # each segment knows some of the levels
            levels, one = np.maximum.reduceat(levels[order], edge), order[edge]
            np.add.at(score, row[one], logs(*np.maximum(levels, 0).astype(np.int64).T, size) * repeats[one])
        add = {"score": score, "base": base, "known": known}
        yield from pa.table([pa.array(rows.column(f.name).to_numpy() + add[f.name][at]) if f.name in add else rows.column(f.name) for f in out], schema=out).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, got = None, [], []
        for batch in batches:
            of = batch.column("block").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0, [True]])) if len(of) else []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if of[lo] != now:
                    if now is not None:
                        yield from block(now, texts, got)
                    now, texts, got = int(of[lo]), [], []
                table = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                text = pc.is_valid(table.column("row"))
                texts.append(table.filter(text).select(["row", *names]))
                got += table.filter(pc.invert(text)).select(list(_GOT)).to_pylist()
        if now is not None:
            yield from block(now, texts, got)

    return run


class Model:
    """What is broadcast: the first part of the filter, the head of the vocabulary, N, V and the number of texts."""

    def __init__(self, bits: Filter, head: np.ndarray, counts: np.ndarray, n: int, v: int, texts: int, tasks: int):
        self.bits, self.head, self.counts, self.n, self.v, self.texts, self.tasks = bits, head, counts, n, v, texts, tasks

    def score(self, column: pa.Array) -> Iterator[tuple[int, int, dict[str, pa.Array], Positions]]:
        """The open positions' rows are numbered from 0 for lo; score is without them."""
        for lo, hi, own, previous, at in tokens(column):
            distinct, which = np.unique(own, return_inverse=True)
            known, place = _in(self.head, distinct)
            exact = np.where(known, self.counts[place] if len(self.head) else 0, 0)
            level = np.where(known, level_of(exact), 0)
            level[~known] = self.bits.closed(_single(distinct[~known]))
            rare = ~known[which]
            rare_before = _before(rare, at, False)
            g = _pair(previous, own, rare_before, rare, self.bits.segments)
            # levels and rareness follow from the pair
            pairs, first, which_pair = np.unique(g, return_index=True, return_inverse=True)
            levels = np.stack([level[which][first], _before(level[which], at, level_of(np.array([self.texts]))[0] if self.texts else 0)[first], self.bits.closed(pairs)], 1).astype(np.int8)
            is_open = (levels == OPEN).any(1)
            # rare words have their exact counts elsewhere
            sent = is_open | rare[first]
            p = np.where(sent, 0.0, logs(*np.maximum(levels, 0).astype(np.int64).T, self.n + self.v + 1))
            row = np.repeat(np.arange(hi - lo), np.diff(at))
            still = sent[which_pair]
            # a pair that a text repeats is sent once
            entry, repeats = np.unique((which_pair[still] << 32) | row[still], return_counts=True)
            some = np.flatnonzero(sent)
            own_rare, before_rare = rare[first[some]], rare_before[first[some]]
            kinds = np.select([own_rare & before_rare & (levels[some, 1] == OPEN), own_rare, before_rare], [SECOND, OWN, BEFORE], BOTH).astype(np.int8)
            each = np.bincount(np.searchsorted(some, entry >> 32), minlength=len(some)).astype(np.uint32)
            open_pairs = [pairs[some], kinds, np.where(kinds == BEFORE, previous[first[some]], own[first[some]]), levels[some], each, (entry & 0xFFFFFFFF).astype(np.uint32), repeats.astype(np.uint32)]
            if (two := kinds == SECOND).any():
                mine = np.repeat(two, each)
                first_of = [pairs[some][two], np.full(two.sum(), FIRST, np.int8), previous[first[some]][two], levels[some][two], each[two], open_pairs[5][mine], open_pairs[6][mine]]
                open_pairs = [np.concatenate(x) for x in zip(open_pairs, first_of, strict=True)]
            total = lambda x: np.add.reduceat(x, at[:-1])
            yield lo, hi, {
                "n_tokens": pa.array(np.diff(at)),
                "known": pa.array(total(known[which].astype(np.int64))),
                "base": pa.array(total(np.log10(exact + 1.0)[which])),
                "score": pa.array(total(p[which_pair])),
            }, Positions(*open_pairs)


def train(texts: DataFrame, filter_bits: int = FILTER_BITS, head_words: int = HEAD_WORDS) -> tuple[Model, DataFrame, int, DataFrame | None]:
    """texts (text) to the model, all words' counts (h, c), the least count of the head's words, and second parts (segment, more), if there are any."""
    spark = texts.sparkSession
    ship(spark)
    texts = texts.select("text")
    words = stored(texts.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    size = F.when(F.col("c") < 64, F.col("c")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("c"))).cast("long"))
    ends = F.max(F.when(F.col("h") == F.lit(int(END.astype(np.int64))), F.col("c"))).alias("texts")
    # a hundred rows at most
    histogram = words.groupBy(size.alias("from")).agg(F.count("*").alias("v"), F.sum("c").alias("n"), ends).orderBy(F.desc("from")).collect()
    n, v, n_texts = sum(r.n for r in histogram), sum(r.v for r in histogram), max((r.texts or 0 for r in histogram), default=0)
    least, room = (histogram[0]["from"] + 1 if histogram else 1), head_words
    for r in histogram:
        if (room := room - r.v) < 0:
            break
        least = r["from"]
    head = words.where(F.col("c") >= least).toArrow()
    keys, counts = head.column("h").to_numpy().view(np.uint64), head.column("c").to_numpy()
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    tasks = 1 << int(n // TASK_TOKENS).bit_length()
    segments = min(MOST_SEGMENTS, max(tasks, min(SPREAD * tasks, MOST_SPREAD)))
    bits = max(segments * MIN_SEGMENT_BITS, min(filter_bits, 1 << max(0, int(n).bit_length() - 1)))
    sent = texts.mapInArrow(_send(segments, spark.sparkContext.broadcast(keys)), "segment long, keys binary, counts binary")
    met = sent.repartition(tasks, "segment").sortWithinPartitions("segment")
    filled = stored(met.mapInArrow(_fill(bits // segments), "segment long, count long, first long, bits binary, more binary"), "filter")
    data, edges = np.zeros(bits // 8, np.uint8), (np.zeros(segments, np.int64), np.zeros(segments, np.uint64))
    for r in filled.drop("more").toLocalIterator():
        lo = r.segment * (bits // segments) // 8
        data[lo : lo + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
        edges[0][r.segment], edges[1][r.segment] = r["count"], r["first"] % (1 << 64)
    return Model(Filter(data, segments, edges), keys, counts, n, v, n_texts, tasks), words, least, filled.select("segment", "more") if edges[0].any() else None


def _rare(segments: int):
    """Rare words (h, c) to rows of their segments: names, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            segment = segment_of(_single(h), segments)
            order = np.argsort(segment, kind="stable")
            edge = np.searchsorted(segment[order], np.arange(segments + 1))
            full = np.flatnonzero(np.diff(edge))
            part = lambda x: pa.array([_planes(x[order[edge[s] : edge[s + 1]]]) for s in full], pa.binary())
            yield pa.record_batch([pa.array(full, pa.int64()), part(h), part(c)], ["segment", "names", "counts"])

    return run


def score(docs: DataFrame, held_out, filter_bits: int = FILTER_BITS, head_words: int = HEAD_WORDS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; trained on the rows that aren't held out."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    model, words, least, second = train(rows.where(~F.col("held_out")), filter_bits, head_words)
    shared = spark.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "n_tokens", "known", "base", "score"]
    segments, size = model.bits.segments, model.n + model.v + 1
    fields = f"row long, doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, n_tokens long, known long, base double, score double"
    binary = lambda x: ", ".join(f"{c} binary" for c in x)
    sent = f"kind int, segment long, block long, {binary(list(_SENT)[3:])}"
    of_texts = to_arrow_schema(rows.select(F.lit(0).cast("long").alias("row"), "doc_id", "held_out", *[F.lit(0).cast(k).alias(c) for c, k in zip(names[2:], ("long", "long", "double", "double"), strict=True)]).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        held, waiting, block = [], 0, row
        kinds = pa.schema([*of_texts, *_SENT.items()])

        def table(x: dict[str, pa.Array], n: int) -> pa.RecordBatch:
            return pa.record_batch([x[f.name].cast(f.type) if f.name in x else pa.nulls(n, f.type) for f in kinds], schema=kinds)

        def out() -> pa.RecordBatch:
            found = list(Positions.merged(held).sent(segments, block))
            return table({c: pa.array(list(v), k) for (c, k), v in zip(_SENT.items(), zip(*found, strict=True), strict=True)}, len(found))

        for batch in batches:
            for lo, hi, found, positions in shared.value.score(batch.column(1)):
                n = hi - lo
                # rows of texts go with their block's messages, to any segment
                found |= {"row": pa.array(np.arange(row, row + n)), "block": pa.array(np.full(n, block)), "segment": pa.array(np.full(n, block // 1009 % segments)), "doc_id": batch.column(0).slice(lo, n), "held_out": batch.column(2).slice(lo, n)}
                if len(positions.all[0]):
                    held.append(Positions(*positions.all[:5], positions.all[5] + np.uint32(row - block), positions.all[6]))
                waiting += int(found["n_tokens"].to_numpy().sum())
                row += n
                yield table(found, n)
                if waiting > FLUSH:
                    if held:
                        yield out()
                    held, waiting, block = [], 0, row
        if held:
            yield out()

    every = rows.mapInArrow(run, f"{fields}, {sent}")
    tail = words.where(F.col("c") < least).mapInArrow(_rare(segments), "segment long, names binary, counts binary")
    every = every.unionByName(tail, allowMissingColumns=True)
    if second is not None:
        every = every.unionByName(second.where("more is not null"), allowMissingColumns=True)
    elif "more" not in every.columns:
        every = every.withColumn("more", F.lit(None).cast("binary"))
    dealt = every.repartition(model.tasks, "segment").sortWithinPartitions("segment", F.col("names").isNull() & F.col("more").isNull())
    between = pa.schema([*of_texts, ("block", pa.int64()), *_GOT.items()])
    got = dealt.mapInArrow(_met(["row", *names], between, size), f"{fields}, block long, {binary(_GOT)}")
    final = got.repartition(model.tasks, "block").sortWithinPartitions("block").mapInArrow(_gathered(names, pa.schema([f for f in of_texts if f.name != "row"]), size), fields.split(", ", 1)[1])
    return final.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(size)))).alias("base_score"), "score")


def held_out(docs: DataFrame, n: int = 7, rest: int = 2):
    return remainder(docs, n) == rest
