"""Repair of conversations whose turns are missing, empty, repeated, cut off or under a wrong role.

A whole conversation is at most one system turn and then user and assistant in turns, `(s?(ua)+)?` over the roles'
initials. The cheapest edits that lead there are found by dynamic programming over four states (nothing yet,
after system, after user, after assistant). Rows come in the order of a secondary sort, by conversation and turn, and
a conversation's costs are carried from one Arrow batch to the next. What has to be remembered of a row is the
number of its transition, two bytes; those of a giant conversation go to a task's own spill file, which is gone with the task.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.frames import quoted, row_of

BLANKS = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, UNFINISHED = 3, 2, 2, 1
#: A state that costs more than another by more than this is on no cheapest way: at most two inserts and the deletion of a
#: system turn lead from any state to where another one's edits can be followed.
SURPASSED = 2 * INSERT + DELETE
#: Transitions held in memory before they are spilled.
HELD = 1 << 18

# States: nothing yet, after system, after user, after assistant.
_ENDS = (0, 3)
_AFTER = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
# The one role that may be inserted or given in each state.
_WANTED = ("u", "u", "a", "u")
_ROLE = {"u": "user", "a": "assistant"}
_CLASSES = ("s", "u", "a", "")
_NOT, _TRUNCATED, _DUPLICATE, _BLANK = range(4)
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

#: Costs and ranks of the four states: (cost above the least or None, rank of the audit among the four).
Costs = tuple[tuple[int | None, int], ...]
START: Costs = ((0, 0), (None, 0), (None, 0), (None, 0))


def _inserted(state: int, times: int) -> int:
    for _ in range(times):
        state = _AFTER[_WANTED[state], state]
    return state


@cache
def _choices(symbol: int) -> tuple[tuple[int, int, str, int], ...]:
    """(state, next state, edits, cost) of a row: inserts in front of it, then its own edit. More than two inserts
    lead to a state that fewer reach."""
    fault, role = symbol // 4, _CLASSES[symbol % 4]
    out = []
    for state in range(4):
        for times in range(3):
            at, cost, edits = _inserted(state, times), INSERT * times, "I" * times
            out.append((state, at, edits + "D", cost + DELETE))
            if fault < _DUPLICATE:
                cost += UNFINISHED if fault == _TRUNCATED else 0
                if (role, at) in _AFTER:
                    out.append((state, _AFTER[role, at], edits + "K", cost))
                out.append((state, _AFTER[_WANTED[at], at], edits + "R", cost + REROLE))
    return tuple(out)


def step(costs: Costs, symbol: int) -> tuple[Costs, int, tuple]:
    """The costs after a row, what was taken off all of them, and (state before, edits) for each state.

    Of two ways to a state the cheaper counts, of equally cheap ones that with the ASCII-least edits since the
    conversation's start. Every way ends in a row's own edit, so none is the beginning of another and their
    order never changes: a rank per state stands for the whole text of edits.
    """
    best: list = [None] * 4
    # (cost, rank, edits since, state before) of the best way to each state.
    for state, then, edits, cost in _choices(symbol):
        before, rank = costs[state]
        if before is not None:
            way = (before + cost, rank, edits, state)
            if best[then] is None or way < best[then]:
                best[then] = way
    least = min(way[0] for way in best if way)
    best = [way if way and way[0] <= least + SURPASSED else None for way in best]
    order = sorted({way[1:3] for way in best if way})
    after = tuple((way[0] - least, order.index(way[1:3])) if way else (None, 0) for way in best)
    return after, least, tuple((way[3], way[2]) if way else None for way in best)


class Transitions:
    """The transitions met so far, by number. There are few, as costs differ by `SURPASSED` at most."""

    def __init__(self):
        self.numbers: dict[tuple[Costs, int], int] = {}
        self.made: list[tuple[Costs, int, tuple]] = []

    def number(self, costs: Costs, symbol: int) -> int:
        found = self.numbers.get((costs, symbol))
        if found is None:
            found = self.numbers[costs, symbol] = len(self.made)
            self.made.append(step(costs, symbol))
        return found


class Trail:
    """Transition numbers of one conversation, read from the last to the first."""

    def __init__(self):
        self.held = array("H")
        self.spilled = None

    def append(self, number: int) -> None:
        self.held.append(number)
        if len(self.held) >= HELD:
            if self.spilled is None:
                self.spilled = tempfile.TemporaryFile()  # has no name; ends with the task
            self.held.tofile(self.spilled)
            self.held = array("H")

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.held)
        if self.spilled is not None:
            size = HELD * self.held.itemsize
            for at in range(self.spilled.tell() - size, -1, -size):
                self.spilled.seek(at)
                block = array("H")
                block.fromfile(self.spilled, HELD)
                yield from reversed(block)
            self.spilled.close()


class Audit:
    """Faults and cheapest edits of one conversation, row by row."""

    def __init__(self, transitions: Transitions):
        self.transitions = transitions
        self.trail = Trail()
        self.costs, self.cost, self.rows = START, 0, 0
        self.low = self.high = self.turn = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]
        self.before = None

    def add(self, turn: int | None, symbol: int) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.turn
            self.high = self.turn = turn
        role = _CLASSES[symbol % 4]
        if self.rows and (self.before, role) not in _LEGAL:
            self.illegal += 1
        self.before = role
        self.faults[symbol // 4] += 1
        self.rows += 1
        number = self.transitions.number(self.costs, symbol)
        self.costs, least, _ = self.transitions.made[number]
        self.cost += least
        self.trail.append(number)

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit."""
        ways = []
        for state, (cost, rank) in enumerate(self.costs):
            for times in range(3):
                if cost is not None and _inserted(state, times) in _ENDS:
                    ways.append((cost + INSERT * times, rank, "I" * times, state))
        cost, _, last, state = min(ways)
        edits = [last]
        for number in self.trail.backwards():
            state, made = self.transitions.made[number][2][state]
            edits.append(made)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        _, truncated, duplicate, blank = self.faults
        return gaps, blank, duplicate, truncated, self.illegal, self.cost + cost, "".join(reversed(edits))


AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _given(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, carry: list[str]) -> DataFrame:
    blank = lambda name: F.coalesce(rows[quoted(name)].cast("string"), F.lit(" "))
    return rows.select(
        rows[quoted(conv_col)].alias("conv"),
        rows[quoted(turn_col)].cast("long").alias("turn"),
        blank(role_col).alias("role"),
        blank(text_col).alias("text"),
        *([row_of(rows, carry).alias("row")] if carry else []),
    )


def audit_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv and the audit of every conversation that has rows.

    Rows are taken by turn, nulls first, of one turn by role and text. Null roles and texts are one blank;
    null is a conversation of its own. A row's fault is the first of: blank (nothing but white space), duplicate (role
    and text came earlier in the conversation), truncated (does not end in `.`, `!` or `?`). gaps counts the
    turns missing between the first and the last; illegal the neighbours whose roles cannot follow one another.
    audit has one letter per edit, in order: Keep 0, Rerole to user or assistant 2, Delete 3 (blank and duplicate rows
    have no other), Insert an empty turn 2; a truncated row that stays costs 1. Of equally cheap audits it is the
    ASCII-least. No rows give no rows.

    One shuffle by conversation serves both sorts: by role and text, which shows duplicates, and by turn.
    Both spill; a task holds two bytes for each row of the conversation at hand, in a file beyond `HELD`.
    """
    given = _given(rows, conv_col, turn_col, role_col, text_col, [])
    same = Window.partitionBy("conv", "role", "text").orderBy(F.asc_nulls_first("turn"))
    ended = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(ended == "", _BLANK)
        .when(F.row_number().over(same) > 1, _DUPLICATE)
        .when(F.right(ended, F.lit(1)).isin(".", "!", "?"), _NOT)
        .otherwise(_TRUNCATED)
    )
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    marked = given.repartition("conv").select("conv", "turn", "role", "text", (fault * 4 + role).cast("byte").alias("symbol"))
    # Of equal rows the first one, which is no duplicate, has the least symbol.
    order = ["conv", F.asc_nulls_first("turn"), "role", "text", "symbol"]
    dealt = marked.sortWithinPartitions(*order).select("conv", "turn", "symbol")
    schema = T.StructType([dealt.schema["conv"], *T._parse_datatype_string(AUDIT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transitions, done, size = Transitions(), [], 0
        conv, audit = None, None
        for batch in batches:
            for own, turn, symbol in zip(*(c.to_pylist() for c in batch.columns)):
                if audit is None or own != conv:
                    if audit is not None:
                        done.append((conv, *audit.result()))
                        size += len(done[-1][-1]) + 100
                        if size > 1 << 20:
                            yield _batch(done, schema)
                            done, size = [], 0
                    conv, audit = own, Audit(transitions)
                audit.add(turn, symbol)
        if audit is not None:
            done.append((conv, *audit.result()))
        if done:
            yield _batch(done, schema)

    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)


class Repair:
    """Follows an audit over the rows of its conversation, in the same order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _own(self, edit: str, role: str) -> str:
        initial = role[:1] if edit == "K" else _WANTED[self.state]
        self.state = _AFTER[initial, self.state]
        return role if edit == "K" else _ROLE[initial]

    def inserted(self) -> Iterator[str]:
        """Roles of the turns put in before the next row, or at the end."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._own("I", "")

    def edit(self, role: str) -> tuple[str, str]:
        """The next row's edit and its role after it."""
        edit = self.audit[self.at]
        self.at += 1
        return edit, role if edit == "D" else self._own(edit, role)


def _with_audits(given: DataFrame, audits: DataFrame) -> DataFrame:
    """Every conversation's audit in front of its rows, in one partition."""
    ahead = audits.select("conv", F.struct(*audits.columns[1:]).alias("found"))
    together = ahead.withColumn("kind", F.lit(0)).unionByName(given.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return together.repartition("conv").sortWithinPartitions("conv", "kind", F.asc_nulls_first("turn"), "role", "text")


def repair_conversations(
    rows: DataFrame,
    audits: DataFrame | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """conv, place, role, text, edit and row: the repaired conversations, one row per turn.

    `place` counts from 0; `edit` is K, R or I; `row` holds the given columns (`carry`; all if None), and is null for an
    inserted turn. `audits` are those of `audit_conversations` over the same rows (made here if None).
    """
    names = [conv_col, turn_col, role_col, text_col]
    audits = audit_conversations(rows, *names) if audits is None else audits
    given = _given(rows, *names, carry=rows.columns if carry is None else carry)
    dealt = _with_audits(given, audits).select("conv", "found.audit", "kind", "role", "text", "row")
    added = T._parse_datatype_string("place long, role string, text string, edit string").fields
    schema = T.StructType([dealt.schema["conv"], *added, dealt.schema["row"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, repair, place = None, None, 0
        for batch in batches:
            out: list[tuple] = []
            taken: list[int | None] = []

            def put(role, text, edit, line=None):
                nonlocal place
                out.append((conv, place, role, text, edit))
                taken.append(line)
                place += 1

            columns = (batch[c].to_pylist() for c in ("conv", "audit", "kind", "role", "text"))
            for line, (own, audit, kind, role, text) in enumerate(zip(*columns)):
                if kind == 0:
                    for made in repair.inserted() if repair else ():
                        put(made, "", "I")
                    conv, repair, place = own, Repair(audit), 0
                    continue
                for made in repair.inserted():
                    put(made, "", "I")
                edit, role = repair.edit(role)
                if edit != "D":
                    put(role, text, edit, line)
            if out:
                yield _repaired(out, batch["row"].take(pa.array(taken, pa.int64())), schema)
        out, taken = [], []
        for made in repair.inserted() if repair else ():
            out.append((conv, place, made, "", "I"))
            place += 1
        if out:
            yield _repaired(out, pa.nulls(len(out), batch["row"].type), schema)

    return dealt.mapInArrow(run, schema)


def _repaired(rows: list[tuple], carried: pa.Array, schema: T.StructType) -> pa.RecordBatch:
    made = _batch(rows, T.StructType(schema.fields[:-1]))
    return pa.RecordBatch.from_arrays([*made.columns, carried], schema.names)


def repaired_digests(
    rows: DataFrame,
    audits: DataFrame | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv, its audit's columns, and repaired_sha256: of the repaired `role:text` lines, hashed as they stream by."""
    names = [conv_col, turn_col, role_col, text_col]
    audits = audit_conversations(rows, *names) if audits is None else audits
    dealt = _with_audits(_given(rows, *names, carry=[]), audits).select("conv", "found", "kind", "role", "text")
    names = T._parse_datatype_string(AUDIT).names
    schema = T.StructType([dealt.schema["conv"], *T._parse_datatype_string(AUDIT).fields, T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, found, repair, digest, joint = None, None, None, None, b""
        done, size = [], 0

        def put(role: str, text: str) -> None:
            nonlocal joint
            digest.update(joint + f"{role}:{text}".encode())
            joint = b"\n"

        def end() -> None:
            nonlocal size
            for made in repair.inserted():
                put(made, "")
            done.append((conv, *(found[n] for n in names), digest.hexdigest()))
            size += len(found["audit"]) + 200

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("conv", "found", "kind", "role", "text"))
            for own, about, kind, role, text in zip(*columns):
                if kind == 0:
                    if repair:
                        end()
                        if size > 1 << 20:
                            yield _batch(done, schema)
                            done, size = [], 0
                    conv, found, repair, digest, joint = own, about, Repair(about["audit"]), hashlib.sha256(), b""
                    continue
                for made in repair.inserted():
                    put(made, "")
                edit, role = repair.edit(role)
                if edit != "D":
                    put(role, text)
        if repair:
            end()
        if done:
            yield _batch(done, schema)

    return dealt.mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of `conversations` with faults put in by crc32 of `conv_id:turn`, modulo 20.

    0 drops the row, 1 empties its text, 2 takes its `.`, `!` and `?` out, 3 repeats it, 4 makes its role user.
    Null roles and texts are one blank, as nulls are in the hashed text.
    """
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    made = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    made = made.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times))
    return made.select("conv_id", "turn", "role", "text")
