"""Conversation structure repair: cheapest edits that make roles follow `(s?(ua)+)?`, by secondary-sorted streaming.

Rows are dealt out by conversation and sorted by turn, last turn first, and a task streams them: the state of the
dynamic program (what the rest costs from each of four places in the pattern) goes from row to row and from Arrow batch
to Arrow batch. Each row leaves one 16-bit backpointer; those of a giant conversation go to an unnamed file of the task,
which ends with it. Read backwards, the backpointers give the edits from the first row on, the ASCII-least of the
cheapest. A second stream, first turn first, has the edits of a conversation before its rows and writes the repaired
rows or their digest. No task holds more of a conversation than its edits, one character each.

Order within a conversation: turn (nulls first), role, digest of role and text, copy. Defined cases: null roles and
texts are one space, also in a null conv_id or turn's place in the damage's key; rows of a null conv_id are one
conversation; rows that repeat, and rows of one turn, count each; a role whose first letter isn't s, u or a (or that is
empty) can't be kept; a conversation without rows gets zeros, no edits and the digest of an empty text; an empty table
gives an empty result; further columns are ignored; texts may be of any length.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key

WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Costs of edits, and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Backpointers held before they go to a file.
HELD = 1 << 22

#: Places in the pattern: 0 before everything, 1 after s, 2 after u, 3 after a. ROLE: what comes next, GO: the place after it.
ROLE = ("user", "user", "assistant", "user")
GO = (2, 2, 3, 2)
#: The place after a kept row, by its initial (0 s, 1 u, 2 a) and the place before.
KEEP = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
AT_END = (0, 2 * INSERT, INSERT, 0)
LEGAL = {(0, 1), (1, 2), (2, 1)}

FAULTS = {"blank": 1, "duplicate": 2, "truncated": 3}
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) by crc32 of `conv_id:turn`, mod 20: 0 is marked gone, 1 loses its text, 2 its
    marks of ends, 3 comes twice, 4 becomes the user's."""
    ids = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")]
    act = (F.crc32(F.concat(shown(F.col("conv_id")), F.lit(":"), shown(F.col("turn"))).cast("binary")) % 20).alias("act")
    rows = rows.select(*ids, shown(F.col("role")).alias("role"), shown(F.col("text")).alias("text"), act)
    text = F.when(F.col("act") == 1, "").when(F.col("act") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("act") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("act") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("act") == 0).alias("gone"), F.explode(copies).alias("copy"))


def _ordered(rows: DataFrame, gone: Column | None, copy: Column | None) -> DataFrame:
    ids = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")]
    rows = rows.select(*ids, shown(F.col("role")).alias("role"), shown(F.col("text")).alias("text"), (F.lit(False) if gone is None else gone).alias("gone"), (F.lit(0) if copy is None else copy).cast("int").alias("copy"))
    return rows.withColumn("digest", row_key(F.col("role"), F.col("text")))


def classed(rows: DataFrame) -> DataFrame:
    """Of ordered rows: conv_id, turn, role, digest, copy, nth (of equal rows), gone, initial (0 s, 1 u, 2 a, 3 other), fault (0 none, or
    FAULTS). Rows are dealt out by conversation here, and no step after this one shuffles them again."""
    ink = F.call_function("rtrim", F.lit(WHITE), F.col("text"))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).cast("byte")
    light = rows.select("conv_id", "turn", "role", "digest", "copy", "gone", initial.alias("initial"), (ink == "").alias("empty"), F.right(ink, F.lit(1)).isin(*ENDS).alias("ends"))
    same = Window.partitionBy("conv_id", "digest", "gone").orderBy(F.col("turn").asc_nulls_first(), "copy")
    light = light.repartition("conv_id").withColumn("nth", F.row_number().over(same))
    fault = F.when(F.col("empty"), 1).when(F.col("nth") > 1, 2).when(~F.col("ends"), 3).otherwise(0).cast("byte")
    return light.select("conv_id", "turn", "role", "digest", "copy", "nth", "gone", "initial", fault.alias("fault"))


@cache
def entries() -> list[tuple[tuple[str, int], ...]]:
    """What a backpointer stands for: for each place, the edits up to and with this row, and the place after it."""
    return []


@cache
def step(rest: tuple[int, ...], initial: int, fault: int) -> tuple[int, tuple[int, ...], int]:
    """One row back: from what the rows after it cost from each place (less the least), to (backpointer, what they cost
    with this row, and the least of that)."""
    due, stays = fault in (FAULTS["blank"], FAULTS["duplicate"]), TRUNCATED * (fault == FAULTS["truncated"])
    own: list[dict[str, tuple[int, int]]] = []
    for at in range(4):
        moves = {"D": (DELETE + rest[at], at)}
        if not due:
            if at in KEEP[initial]:
                moves["K"] = (stays + rest[KEEP[initial][at]], KEEP[initial][at])
            moves["R"] = (REROLE + stays + rest[GO[at]], GO[at])
        own.append(moves)
    cost = [min(c for c, _ in moves.values()) for moves in own]
    for _ in range(3):  # insertions before the row: the longest way without a circle has three
        cost = [min(cost[at], INSERT + cost[GO[at]]) for at in range(4)]
    out = []
    for at in range(4):
        edits, place = "", at
        while True:
            moves = own[place] | {"I": (INSERT + cost[GO[place]], GO[place])}
            letter = min(x for x, (c, _) in moves.items() if c == cost[place])
            edits, place = edits + letter, moves[letter][1]
            if letter != "I":
                break
        out.append((edits, place))
    least = min(cost)
    entries().append(tuple(out))
    return len(entries()) - 1, tuple(c - least for c in cost), least


class Pointers:
    """Backpointers, last row first; more than HELD of them lie in an unnamed file."""

    def __init__(self):
        self.held, self.file, self.blocks = array("H"), None, []

    def add(self, pointer: int) -> None:
        self.held.append(pointer)
        if len(self.held) >= HELD:
            self.file = self.file or tempfile.TemporaryFile()
            self.blocks.append(len(self.held))
            self.held.tofile(self.file)
            self.held = array("H")

    def backwards(self) -> Iterator[array]:
        yield self.held[::-1]
        end = sum(self.blocks) * self.held.itemsize
        for n in reversed(self.blocks):
            end -= n * self.held.itemsize
            self.file.seek(end)
            block = array("H")
            block.fromfile(self.file, n)
            yield block[::-1]
        if self.file:
            self.file.close()


class Conversation:
    """What goes from row to row, last row first."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.pointers = conv_id, Pointers()
        self.rest, self.cost, self.after = AT_END, 0, None
        self.least = self.most = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]

    def add(self, turn: int | None, initial: int, fault: int) -> None:
        pointer, self.rest, more = step(self.rest, initial, fault)
        self.pointers.add(pointer)
        self.cost += more
        self.faults[fault] += 1
        if self.after is not None and (initial, self.after) not in LEGAL:
            self.illegal += 1
        self.after = initial
        if turn is not None:
            if turn != self.least:  # turns fall
                self.turns, self.least = self.turns + 1, turn
            self.most = turn if self.most is None else self.most

    def audit(self) -> str:
        known, place, parts = entries(), 0, []
        for block in self.pointers.backwards():
            part = []
            for pointer in block:
                edits, place = known[pointer][place]
                part.append(edits)
            parts.append("".join(part))
        return "".join(parts) + {1: "II", 2: "I"}.get(place, "")

    def row(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, self.cost + self.rest[0], self.audit())


AUDIT = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.large_string())])
#: Rows, or characters of text, that go out together.
OUT_ROWS, OUT_CHARS = 4096, 4 << 20


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, whose last value is a text, in batches."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[-1])
        if len(held) >= OUT_ROWS or chars >= OUT_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        at: Conversation | None = None
        for batch in batches:
            for conv_id, turn, gone, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or at.conv_id != conv_id:
                    if at is not None:
                        yield at.row()
                    at = Conversation(conv_id)
                if not gone:
                    at.add(turn, initial, fault)
        if at is not None:
            yield at.row()

    yield from _batches(rows(), AUDIT)


def audits(rows: DataFrame, gone: Column | None = None, copy: Column | None = None) -> DataFrame:
    """For each conversation of rows (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit. Rows that are gone only name their conversation."""
    dealt = classed(_ordered(rows, gone, copy))
    down = dealt.sortWithinPartitions("conv_id", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("digest").desc(), F.col("copy").desc(), F.col("nth").desc())
    return down.select("conv_id", "turn", "gone", "initial", "fault").mapInArrow(_audit, f"conv_id long, {COUNTS}, audit string")


class Replay:
    """The edits of a conversation, applied row by row, first row first."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, 0

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield ROLE[self.place], ""
            self.at, self.place = self.at + 1, GO[self.place]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            yield role, text
            self.place = KEEP["sua".index(role[0])][self.place]
        elif edit == "R":
            yield ROLE[self.place], text
            self.place = GO[self.place]


def _replayed(rows: DataFrame, found: DataFrame, gone: Column | None, copy: Column | None) -> DataFrame:
    """The edits of each conversation, then its rows, first row first, in one task."""
    lines = _ordered(rows, gone, copy).where(~F.col("gone")).select("conv_id", F.lit(True).alias("is_row"), "turn", "role", "digest", "copy", "text")
    heads = found.select("conv_id", F.lit(False).alias("is_row"), F.struct(*found.columns[1:]).alias("found"))
    both = lines.unionByName(heads, allowMissingColumns=True).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "is_row", F.col("turn").asc_nulls_first(), "role", "digest", "copy").select("conv_id", "role", "text", "found")


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, int | None, tuple[str, str] | None]]:
    """(head, conv_id, None) where a conversation begins, then (None, conv_id, (role, text)) for each repaired row."""
    replay, conv = None, None
    for batch in batches:
        for conv_id, role, text, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if head is not None:
                if replay:
                    yield from ((None, conv, x) for x in replay.inserts())
                replay, conv = Replay(head["audit"]), conv_id
                yield head, conv_id, None
            else:
                yield from ((None, conv_id, x) for x in replay.row(role, text))
    if replay:
        yield from ((None, conv, x) for x in replay.inserts())


def repaired(rows: DataFrame, gone: Column | None = None, copy: Column | None = None) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, places from 0."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.large_string()), ("text", pa.large_string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            place = 0
            for head, conv_id, message in _messages(batches):
                if head is not None:
                    place = 0
                else:
                    yield (conv_id, place, *message)
                    place += 1

        yield from _batches(out(), schema)

    return _replayed(rows, audits(rows, gone, copy), gone, copy).mapInArrow(run, "conv_id long, place long, role string, text string")


def repair_report(rows: DataFrame, gone: Column | None = None, copy: Column | None = None) -> DataFrame:
    """audits' rows, each with repaired_sha256: of `role:text` of the repaired rows, joined by newlines."""
    schema = pa.schema([*list(AUDIT)[:-1], ("repaired_sha256", pa.string()), AUDIT.field("audit")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            at, begun, digest = None, False, None
            for head, conv_id, message in _messages(batches):
                if head is not None:
                    if at:
                        yield (*at[:-1], digest.hexdigest(), at[-1])
                    at, begun, digest = (conv_id, *head.values()), False, hashlib.sha256()
                else:
                    digest.update(("\n" if begun else "").encode() + ":".join(message).encode())
                    begun = True
            if at:
                yield (*at[:-1], digest.hexdigest(), at[-1])

        yield from _batches(out(), schema)

    return _replayed(rows, audits(rows, gone, copy), gone, copy).mapInArrow(run, f"conv_id long, {COUNTS}, repaired_sha256 string, audit string")


def damaged_report(rows: DataFrame) -> DataFrame:
    """repair_report of the rows after damage, for each original conversation."""
    return repair_report(damage(rows), F.col("gone"), F.col("copy"))
