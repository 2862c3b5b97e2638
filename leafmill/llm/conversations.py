"""Repair of the turns of conversations by fewest edits, so that their roles follow a grammar: maybe a system turn, then pairs of user and assistant.

The search is by layers of costs, as in approximate matching with bit vectors: for each place between turns and each cost there is a
bit set of those states of the grammar from which the rest can be repaired within that cost. Layers are filled with costs rising, each
from lower layers of the same and of the next place. The first layer that has the start state gives the cost, and walking the layers
forward, always by the first letter that stays within what is left, gives the audit that is least of all cheapest ones.

From any state one comes into any other's rest with 7 more at most (two turns inserted, a system turn deleted), so of each place only
BAND layers from its lowest on are kept, 32 bits in all, and a conversation's memory doesn't grow with its turns. Two passes over rows
sorted by conversation do it: backwards for the layers, forwards for the audit; neither holds a conversation's rows. The hash of a
repaired conversation is by nature one sequence, so each conversation is one task's work, of time that grows with its length alone.

Turns ascend, nulls first; rows of one turn by role and text. Null roles and texts are one blank; so are null names of conversations
and turns where faults are drawn. A null conv_id is a conversation. An empty role has no initial, so its turn
can't be kept as it is. Repeated rows are rows, and all but the first are duplicates. A table without rows gives none. Columns beyond conv_id, turn, role and text are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored, tidy

BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Layers kept of a place, from the lowest that isn't empty; in the last one are all states.
BAND = 8
#: States as bits: nothing written yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8
ALL = START | SYSTEM | USER | ASSISTANT
#: What a turn of each initial leads to from a state, and what follows at all.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FOLLOWS = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
WRITTEN = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
#: Faults of a row.
NONE, BLANK, DUPLICATE, CUT = range(4)
Layers = tuple[int, list[int]]


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults drawn by conversation and turn; dropped ones stay, with present = false, so that no conversation goes."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    out = rows.select(
        "conv_id", "turn", (kind != 0).alias("present"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
    return out.drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Each row's first fault, and nth: its number among rows of its conversation with its role and text."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    same = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(end == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.substring(end, -1, 1).isin(".", "!", "?"), CUT).otherwise(NONE)
    return rows.withColumn("nth", F.row_number().over(same).cast("long")).withColumn("fault", fault.cast("int"))


# Layers --------------------------------------------------------------------


def before(mask: int, initial: str) -> int:
    """The states from which a turn of this initial leads into mask."""
    return sum(a for a, b in NEXT.get(initial, {}).items() if b & mask)


_BEFORE = {k: [before(m, k) for m in range(16)] for k in NEXT}
_INSERTED = [_BEFORE["u"][m] | _BEFORE["a"][m] for m in range(16)]


def closed(masks: list[int], low: int) -> Layers:
    """Layers from the lowest cost with a state on, a turn inserted wherever that helps."""
    for c in range(len(masks)):
        masks[c] |= (masks[c - 1] if c else 0) | (_INSERTED[masks[c - INSERT]] if c >= INSERT else 0)
    skip = next(c for c, m in enumerate(masks) if m)
    return low + skip, masks[skip : skip + BAND]


END: Layers = closed([START | ASSISTANT] + [0] * (BAND - 1), 0)


def at(layers: Layers, cost: int) -> int:
    """States from which the rest costs no more than this."""
    low, masks = layers
    return 0 if cost < low else masks[min(cost - low, BAND - 1)]


def back(layers: Layers, initial: str, fault: int) -> Layers:
    """The layers before a row, from those after it."""
    low, masks = layers[0], []
    more = TRUNCATED if fault == CUT else 0
    for c in range(low, low + BAND + DELETE):
        m = at(layers, c - DELETE)
        if fault not in (BLANK, DUPLICATE):
            if initial in _BEFORE:
                m |= _BEFORE[initial][at(layers, c - more)]
            m |= _INSERTED[at(layers, c - REROLE - more)]
        masks.append(m)
    return closed(masks, low)


def packed(layers: Layers) -> int:
    return sum(m << 4 * i for i, m in enumerate(layers[1]))


def unpacked(low: int, word: int) -> Layers:
    return low, [word >> 4 * i & ALL for i in range(BAND)]


def cost_from(layers: Layers, state: int) -> int:
    return next(layers[0] + i for i, m in enumerate(layers[1]) if m & state)


class Walk:
    """One conversation, row by row forwards: its counts, audit and the hash of what it becomes."""

    def __init__(self) -> None:
        self.state, self.left, self.cost = START, 0, 0
        self.audit, self.hash, self.written = bytearray(), hashlib.sha256(), False
        self.faults, self.illegal, self.last = [0, 0, 0, 0], 0, None
        self.low = self.high = self.turn = None
        self.turns, self.rows = 0, 0

    def write(self, role: str, text: str) -> None:
        if self.written:
            self.hash.update(b"\n")
        self.written = True
        self.hash.update(f"{role}:{text}".encode())

    def insert(self) -> None:
        self.state = FOLLOWS[self.state]
        self.left -= INSERT
        self.audit += b"I"
        self.write(WRITTEN[self.state], "")

    def row(self, turn: int | None, role: str, text: str, fault: int, own: Layers, rest: Layers) -> None:
        if not self.rows:
            self.cost = self.left = cost_from(own, START)
        self.rows += 1
        self.faults[fault] += 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += turn != self.turn
            self.turn = turn
        more = TRUNCATED if fault == CUT else 0
        kept = NEXT.get(initial, {})
        while True:
            if at(rest, self.left - DELETE) & self.state:
                self.audit += b"D"
                self.left -= DELETE
                return
            if at(own, self.left - INSERT) & FOLLOWS[self.state]:
                self.insert()
                continue
            if at(rest, self.left - more) & kept.get(self.state, 0):
                self.audit += b"K"
                self.state = kept[self.state]
                self.left -= more
                self.write(role, text)
                return
            self.audit += b"R"
            self.state = FOLLOWS[self.state]
            self.left -= REROLE + more
            self.write(WRITTEN[self.state], text)
            return

    def result(self) -> tuple:
        while self.left:
            self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.faults[1:], self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest()


# The two passes ------------------------------------------------------------


_ROWS = "conv_id {t}, turn {n}, present boolean, role string, text string, nth long, fault int, low long, word long, next_low long, next_word long"
_OUT = "conv_id {t}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NEW = object()


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, layers = _NEW, END
    for batch in batches:
        found: list[list[int]] = [[], [], [], []]
        for c, present, role, fault in zip(*(batch[k].to_pylist() for k in ("conv_id", "present", "role", "fault")), strict=True):
            if c != conv:
                conv, layers = c, END
            rest = layers
            if present:
                layers = back(layers, role[:1], fault)
            for to, x in zip(found, (layers[0], packed(layers), rest[0], packed(rest)), strict=True):
                to.append(x)
        columns = [batch.column(k) for k in range(batch.num_columns)] + [pa.array(x, pa.int64()) for x in found]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "low", "word", "next_low", "next_word"])
    tidy()


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, walk, kind = _NEW, None, None

    def done(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])

    for batch in batches:
        found, kind = [], batch.schema.field("conv_id").type
        names = ("conv_id", "turn", "present", "role", "text", "fault", "low", "word", "next_low", "next_word")
        for c, turn, present, role, text, fault, low, word, next_low, next_word in zip(*(batch[k].to_pylist() for k in names), strict=True):
            if c != conv or walk is None:
                if walk is not None:
                    found.append((conv, *walk.result()))
                conv, walk = c, Walk()
            if present:
                walk.row(turn, role, text, fault, unpacked(low, word), unpacked(next_low, next_word))
        if found:
            yield done(found)
    if walk is not None:
        yield done([(conv, *walk.result())])
    tidy()


def _order(desc: bool) -> list[Column]:
    columns = [F.col(c) for c in ("conv_id", "turn", "role", "text", "nth")]
    return [c.desc_nulls_last() if desc else c.asc_nulls_first() for c in columns]


def repaired(rows: DataFrame) -> DataFrame:
    """For each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    rows: conv_id, turn, role, text, and present (boolean) where rows that are not there stand for their conversation.
    """
    spark = rows.sparkSession
    ship(spark)
    kinds = dict(rows.dtypes)
    if "present" not in kinds:
        rows = rows.withColumn("present", F.lit(True))
    rows = rows.select("conv_id", "turn", "present", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    dealt = with_faults(rows).repartition("conv_id").sortWithinPartitions(*_order(desc=True))
    layered = stored(dealt.mapInArrow(_backwards, _ROWS.format(t=kinds["conv_id"], n=kinds["turn"])), "conversation-layers")
    return layered.repartition("conv_id").sortWithinPartitions(*_order(desc=False)).mapInArrow(_forwards, _OUT.format(t=kinds["conv_id"]))
