"""Repair of conversations: generalised LR parsing of the roles with weighted edits.

A sound conversation derives from ``talk -> () | body``, ``body -> pair | s pair | body pair``,
``pair -> u a``.  Rows are read in order; each may be kept, get another role, or go, and empty rows may
be put in anywhere.  All ways are parsed at once on a graph-structured stack: each row's edits shift role
initials onto every live stack and reduce, and stacks whose tops are equal merge, keeping the one of
least (cost, audit).  Equal tops accept the same rests, and two audits of equal cost over the same rows
are never one the start of the other, so what merging drops could not have won.

Every live stack carries the SHA-256 state of its repaired rows.  A conversation is read once, as a
sorted stream, and only its audits are held: no rows.  Stacks more than ``SLACK`` above the cheapest go,
as each can be brought to any other's rest by edits of at most that cost; what all audits start with is
put aside.  One conversation is one stream, since its digest is sequential.

Cases: null conversation id - a conversation of its own; null turn - before all others; null role or text -
one space; roles are edited by their first character, one outside s, u, a can't be kept; rows of one turn
go by role, then text; conversations without rows - zeros and empty audit; very long texts - hashed
whole; empty table - empty result; other columns - ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import slices

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
# to go on from another stack's top: at most an insert of user and assistant, or less
SLACK = 2 * INSERT
# audits are shortened by what all have in common when they pass this length
AUDIT = 256

# the automaton of the grammar: shifts, gotos, reductions (length, left side), accepting tops
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 6, (3, "u"): 2}
GOTO = {(0, "pair"): 4, (1, "pair"): 5, (3, "pair"): 7, (0, "body"): 3}
REDUCE = {6: (2, "pair"), 4: (1, "body"), 5: (2, "body"), 7: (2, "body")}
ACCEPT = {0, 3}

NUMBERS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = ", ".join(f"{name} bigint" for name in NUMBERS) + ", audit string, repaired_sha256 string"
_STEPS: dict[tuple, tuple | None] = {}


def step(stack: tuple, initial: str) -> tuple | None:
    """The stack after a role initial is shifted and all reductions are done; None if it can't be."""
    found = _STEPS.get((stack, initial), ())
    if found != ():
        return found
    after = None
    if (stack[-1], initial) in SHIFT:
        after = (*stack, SHIFT[stack[-1], initial])
        while after[-1] in REDUCE:
            n, left = REDUCE[after[-1]]
            after = after[:-n]
            after = (*after, GOTO[after[-1], left])
    _STEPS[stack, initial] = after
    return after


class Repair:
    """The live stacks over the rows read so far: top -> (cost, audit, stack, hash state)."""

    def __init__(self) -> None:
        self.common: list[str] = []
        self.live = {0: (0, "", (0,), hashlib.sha256())}
        self._insert()

    def _merge(self, ways: dict, cost: int, audit: str, stack: tuple, sha, text: bytes | None) -> bool:
        old = ways.get(stack[-1])
        if old is not None and (old[0], old[1]) <= (cost, audit):
            return False
        ways[stack[-1]] = (cost, audit, stack, sha, text)
        return True

    def _settle(self, ways: dict) -> None:
        """Ways become stacks; hash states are copied only here, for those that are left."""
        least = min(w[0] for w in ways.values())
        self.live = {}
        for top, (cost, audit, stack, sha, text) in ways.items():
            if cost > least + SLACK:
                continue
            if text is not None:
                sha = sha.copy()
                sha.update(text)
            self.live[top] = (cost, audit, stack, sha)

    def _insert(self) -> None:
        """Empty rows put in at this place, as long as that makes a top cheaper or new."""
        changed = True
        while changed:
            changed = False
            ways = {top: (*way, None) for top, way in self.live.items()}
            for cost, audit, stack, sha in self.live.values():
                for role in ("user", "assistant"):
                    after = step(stack, role[0])
                    if after is not None:
                        changed |= self._merge(ways, cost + INSERT, audit + "I", after, sha, _line(stack, role, ""))
            if changed:
                self._settle(ways)

    def read(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        ways: dict = {}
        more = TRUNCATED if truncated else 0
        for cost, audit, stack, sha in self.live.values():
            self._merge(ways, cost + DELETE, audit + "D", stack, sha, None)
            if must_go:
                continue
            for name, initial, edit, price in (
                (role, role[:1], "K", 0), ("user", "u", "R", REROLE), ("assistant", "a", "R", REROLE)
            ):
                after = step(stack, initial)
                if after is not None:
                    self._merge(ways, cost + price + more, audit + edit, after, sha, _line(stack, name, text))
        self._settle(ways)
        self._insert()
        if len(next(iter(self.live.values()))[1]) > AUDIT:
            same = len(os.path.commonprefix([w[1] for w in self.live.values()]))
            self.common.append(next(iter(self.live.values()))[1][:same])
            self.live = {top: (c, a[same:], stack, sha) for top, (c, a, stack, sha) in self.live.items()}

    def end(self) -> tuple[int, str, str]:
        cost, audit, sha = min(((c, a, s) for c, a, stack, s in self.live.values() if stack[-1] in ACCEPT), key=lambda w: w[:2])
        return cost, "".join(self.common) + audit, sha.hexdigest()


def _line(stack: tuple, role: str, text: str) -> bytes:
    return f"{'' if stack == (0,) else chr(10)}{role}:{text}".encode()


GAP = " \t\n\x0b\x0c\r"


class Conversation:
    """Counts and repair of one conversation, row by row."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None
        self.repair = Repair()

    def add(self, turn: int | None, role: str, text: str, twin: bool) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        end = text.rstrip(GAP)[-1:]
        blank = end == ""
        twin = twin and not blank
        cut = not blank and not twin and end not in ".!?"
        self.blank += blank
        self.duplicate += twin
        self.truncated += cut
        self.repair.read(role, text, blank or twin, cut)

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.end())


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(name, pa.int64()) for name in NUMBERS] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
    talk, found = None, []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), schema)], schema=schema)

    for batch in slices(batches, 256):
        for conv_id, turn, role, text, twin, gone in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if talk is None or talk.conv_id != conv_id:
                if talk is not None:
                    found.append(talk.result())
                talk = Conversation(conv_id)
            if not gone:
                talk.add(turn, role, text, twin)
        if found:
            yield out()
            found = []
    if talk is not None:
        found.append(talk.result())
        yield out()


def repair(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """Faults and cheapest repair of every conversation of ``rows`` (conv_id, turn, role, text).

    A row where ``gone`` is true only names its conversation.
    """
    rows = rows.select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.lit(False) if gone is None else gone).alias("gone"),
    )
    # both orders below are sorts within this one exchange
    dealt = rows.repartition("conv_id")
    seen = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    marked = dealt.select("conv_id", "turn", "role", "text", (F.row_number().over(seen) > 1).alias("twin"), "gone")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "twin"]
    return marked.sortWithinPartitions(*order).mapInArrow(_repair, RESULT)


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with the faults that a hash of (conv_id, turn) chooses, and what became ``gone``."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text = F.coalesce("text", space)
    marked = rows.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("_fault")
    )
    fault = F.col("_fault")
    return marked.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault.isin(0, 1), "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (fault == 0).alias("gone"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")
