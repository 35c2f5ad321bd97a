"""Repair of damaged conversations by a streamed dynamic program.

A repaired conversation's role initials read ``(s?(ua)+)?``. Its rows may be
kept (free), given the role user or assistant (3), deleted (4; blank rows and
repeats have to be) or joined by an inserted empty row of user or assistant (3);
a truncated row that stays adds 3. The cheapest list of edits is wanted, of
equally cheap ones the one whose initials (D, I, K, R) come first in ASCII.

The pattern is an automaton of four states, so what a conversation's rest costs
is four numbers. Rows are dealt by conversation (the one shuffle) and sorted
within partitions from the last turn to the first; a pass over the Arrow
batches carries the four numbers from batch to batch and appends one byte a row:
the best edit in each state, two bits each. The rows, sorted forward again, are
walked from the start state by these bytes. The bytes of a giant conversation
thus lie in Spark's own sorter, which spills them; a task holds one batch, four
numbers, a running hash and the edits' initials, which are part of the result.
Sorts and passes are deterministic, so a lost executor's tasks repeat them.

One conversation is one task's stream: the hash of its joined rows is
sequential. Repeats are found by a window within the same partitioning, not by
a set in memory.

Rows of equal turn are ordered by role and text. Defined cases: a null role or
text is one space; null turns come first and count for no gap; a null conv_id is
one conversation; a role without a first letter of s, u or a (an empty one too)
can't be kept; no rows give zeros, an empty audit and the hash of the empty
string; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.session import ship_package

BLANKS = "\x20\x09\x0A\x0B\x0C\x0D"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
EDITS = "DIKR"
# States: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row.
NEEDED = ("user", "user", "assistant", "user")
BEHIND = (2, 2, 3, 2)
FAR = 1 << 60


def kept_state(state: int, initial: str) -> int:
    """The state behind a kept row, or -1 where it can't stand."""
    if initial and initial == NEEDED[state][0]:
        return BEHIND[state]
    return 1 if state == 0 and initial == "s" else -1


def with_inserts(costs: list[int]) -> list[int]:
    """The costs if rows may be inserted first (two at most are of use)."""
    for _ in range(3):
        costs = [min(costs[q], INSERT + costs[BEHIND[q]]) for q in range(4)]
    return costs


AT_END = with_inserts([0, FAR, FAR, 0])


def row_step(rest: tuple, initial: str, gone: bool, cut: bool) -> tuple[tuple, int]:
    """Costs from before a row, given those from behind it, and the best edit of each state in two bits."""
    extra = TRUNCATED if cut else 0
    delete = [DELETE + rest[q] for q in range(4)]
    keep, rerole = [FAR] * 4, [FAR] * 4
    if not gone:
        rerole = [REROLE + extra + rest[BEHIND[q]] for q in range(4)]
        for q in range(4):
            to = kept_state(q, initial)
            if to >= 0:
                keep[q] = extra + rest[to]
    costs = with_inserts([min(delete[q], keep[q], rerole[q]) for q in range(4)])
    code = 0
    for q in range(4):
        options = (delete[q], INSERT + costs[BEHIND[q]], keep[q], rerole[q])
        code |= options.index(costs[q]) << 2 * q
    return tuple(costs), code


def mark_faults(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, text, present, again, fault) dealt by conversation; fault is blank, duplicate, truncated or null.

    Rows for which ``present`` is false only make their conversation known."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"),
                        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))
    rows = rows.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (F.when(body == "", "blank").when(F.col("again"), "duplicate")
             .when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated"))
    return rows.withColumn("again", again).select("conv_id", "turn", "role", "text", "present", "again", fault.alias("fault"))


def with_edits(marked: DataFrame) -> DataFrame:
    """``marked`` plus ``back`` (place from the end) and ``edits`` (best edit of each state, one byte)."""
    kind = marked.schema["conv_id"].dataType.simpleString()

    def backward(batches):
        rest, back, known, last, first = None, 0, {}, None, True
        for b in batches:
            ids = b.column("conv_id").to_pylist()
            kept, roles, faults = (b.column(c).to_pylist() for c in ("present", "role", "fault"))
            places, codes = [], []
            for conv, here, role, fault in zip(ids, kept, roles, faults):
                if first or conv != last:
                    rest, back, last, first = tuple(AT_END), 0, conv, False
                code = 0
                if here:
                    # costs relative to the least are few, so steps repeat
                    low = min(rest)
                    key = tuple(c - low for c in rest), role[:1], fault
                    step = known.get(key)
                    if step is None:
                        if len(known) > 100_000:
                            known.clear()
                        step = known[key] = row_step(key[0], key[1], fault in ("blank", "duplicate"), fault == "truncated")
                    rest, code = step
                places.append(back)
                codes.append(code - 256 if code > 127 else code)
                back += 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(places, pa.int64()), pa.array(codes, pa.int8())], [*b.schema.names, "back", "edits"])

    ordered = marked.sortWithinPartitions("conv_id", F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("text"), F.desc("again")).drop("again")
    return ordered.mapInArrow(backward, f"conv_id {kind}, turn long, role string, text string, present boolean, fault string, "
                                        "back long, edits tinyint")


class _Walk:
    """One conversation walked forward: its edits and, row by row, what stays."""

    def __init__(self):
        self.state, self.cost, self.audit = 0, 0, bytearray()

    def _insert(self):
        row = NEEDED[self.state], "", "I"
        self.audit += b"I"
        self.cost += INSERT
        self.state = BEHIND[self.state]
        return row

    def take(self, row: dict):
        """(role, text, edit) of the rows that stand for ``row``."""
        while (edit := EDITS[(row["edits"] & 255) >> 2 * self.state & 3]) == "I":
            yield self._insert()
        self.audit += edit.encode()
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += TRUNCATED if row["fault"] == "truncated" else 0
        if edit == "R":
            self.cost += REROLE
            role, self.state = NEEDED[self.state], BEHIND[self.state]
        else:
            role, self.state = row["role"], kept_state(self.state, row["role"][:1])
        yield role, row["text"], edit

    def end(self):
        while self.state in (1, 2):
            yield self._insert()


class _Summary:
    """The running figures of one conversation."""

    def __init__(self, conv):
        self.conv, self.walk, self.hash, self.lines = conv, _Walk(), hashlib.sha256(), 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.initial = 0, None
        self.low = self.high = None
        self.turns = 0

    def _write(self, role: str, text: str, _edit: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def add(self, row: dict) -> list:
        turn, initial = row["turn"], row["role"][:1]
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if row["fault"]:
            self.faults[row["fault"]] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        for line in self.walk.take(row):
            self._write(*line)
        return []

    def rows(self) -> list:
        for line in self.walk.end():
            self._write(*line)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [(self.conv, gaps, *self.faults.values(), self.illegal, self.walk.cost, self.walk.audit.decode(), self.hash.hexdigest())]


class _Rows:
    """The repaired rows of one conversation, numbered."""

    def __init__(self, conv):
        self.conv, self.walk, self.at = conv, _Walk(), 0

    def _number(self, lines) -> list:
        out = [(self.conv, self.at + i, *line) for i, line in enumerate(lines)]
        self.at += len(out)
        return out

    def add(self, row: dict) -> list:
        return self._number(self.walk.take(row))

    def rows(self) -> list:
        return self._number(self.walk.end())


def _walked(edited: DataFrame, schema: str, start, add, close) -> DataFrame:
    """A pass over each conversation's rows in order; ``add`` and ``close`` give result rows, written in small batches."""
    names = [c.split()[0] for c in schema.split(", ")]

    def forward(batches):
        rows, size, current, types = [], 0, None, None
        for b in batches:
            types = types or [b.schema.field("conv_id").type] + [pa.int64() if c.endswith(" long") else pa.string()
                                                                for c in schema.split(", ")[1:]]
            for row in b.to_pylist():
                if current is None or row["conv_id"] != current.conv:
                    rows += close(current) if current is not None else []
                    current = start(row["conv_id"])
                if row["present"]:
                    rows += add(current, row)
                    size += len(row["text"])
                if len(rows) >= 1000 or rows and size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, size = [], 0
        rows += close(current) if current is not None else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return edited.sortWithinPartitions("conv_id", F.col("back").desc()).mapInArrow(forward, schema)


def summaries(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conversation: faults, cost, audit (the edits' initials) and the hash of the repaired rows."""
    ship_package(turns.sparkSession)
    edited = with_edits(mark_faults(turns, present))
    kind = edited.schema["conv_id"].dataType.simpleString()
    longs = ", ".join(f"{n} long" for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return _walked(edited, f"conv_id {kind}, {longs}, audit string, repaired_sha256 string", _Summary, _Summary.add, _Summary.rows)


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """The repaired rows (conv_id, position from 0, role, text, edit K, R or I); emptied conversations have none."""
    ship_package(turns.sparkSession)
    edited = with_edits(mark_faults(turns, present))
    kind = edited.schema["conv_id"].dataType.simpleString()
    return _walked(edited, f"conv_id {kind}, position long, role string, text string, edit string", _Rows, _Rows.add, _Rows.rows)
