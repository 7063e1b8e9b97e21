"""Faults of conversations, and the cheapest edits that give them the roles `(system? (user assistant)+)?`.

Rows are repartitioned by conversation and sorted by turn (NULL first), role and text. A task reads them as one stream
and carries the state of a dynamic program from batch to batch: for each of four places in the role pattern the cost of
the cheapest edits so far and the order of their audits. Only differences between costs matter for what comes next, so
few states exist and each step is a lookup; the step's number is the backpointer, two bytes a row. When a conversation
ends, the backpointers are read back to front and its rows are then written with their edits. Backpointers and rows of a
giant conversation go to a spool of the task that moves to an unnamed file beyond a bound, like a sort's spill; a task
that runs again makes it anew.

Edits: Keep 0; Rerole to user or assistant 1; Delete 2, the only edit of blank rows and repeats; Insert a user or
assistant row without text 5. A truncated row that stays costs 5. Of equally cheap edits those with the least audit
(initials in order, by ASCII) are taken. Two audits of different edits first differ before the shorter one ends, as each
row has just one edit that is no insert, so their order never changes afterwards.

Defined cases: rows with NULL conv_id are one conversation; a NULL role or text is one space, so the row is blank or has
a role that cannot stay; role initials are what count; rows of equal turn, role and text are told apart only as first and
repeats; repeats are rows whose role and text an earlier row has. A table without rows gives no conversations. Columns other
than the four are not looked at; texts of any length pass through whole."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from typing import IO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 2, 1, 5, 5

# Kinds of rows for the program: what their role starts with, and 4 more if truncated; FORCED must go.
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER, CUT, FORCED = 3, 4, 8
KINDS = 9

# Places: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}

# From any place any other is two inserts away, and a system row that only START can keep may be deleted. What costs
# more than this above the least cannot win nor tie any more.
HOPELESS = 2 * INSERT_COST + DELETE_COST

# Bytes that a conversation's backpointers and rows may hold in memory each.
SPOOL = 32 << 20
# Rows of one batch that is given back.
ROWS = 4096


def _next(place: int) -> int:
    """The place after one more user or assistant row."""
    return ASSISTANT if place == USER else USER


def _moves(place: int, kind: int) -> Iterator[tuple[int, int, str]]:
    """(new place, cost, edits) that take one row of a kind; inserts stand before it."""
    yield place, DELETE_COST, DELETE
    if kind == FORCED:
        return
    stays = TRUNCATED_COST if kind >= CUT else 0
    initial = kind % CUT
    if initial == INITIALS["s"] and place == START:
        yield SYSTEM, stays, KEEP
    for inserts in range(3):
        after = _next(place)
        if initial == INITIALS["u"] and after == USER or initial == INITIALS["a"] and after == ASSISTANT:
            yield after, inserts * INSERT_COST + stays, INSERT * inserts + KEEP
        yield after, inserts * INSERT_COST + REROLE_COST + stays, INSERT * inserts + REROLE
        place = after


class Program:
    """Steps of the dynamic program by (state, kind of row), made when first needed.

    A state has, per place, (cost above the least one, rank of the audit) or None. A step has the state after it, the
    least cost added, and per place (the place before, the edits)."""

    def __init__(self):
        self.states = [((0, 0), None, None, None)]
        self.numbers = {self.states[0]: 0}
        self.steps: list[tuple] = []
        self.known: dict[tuple[int, int], int] = {}

    def step(self, state: int, kind: int) -> int:
        number = self.known.get((state, kind))
        return number if number is not None else self._make(state, kind)

    def _make(self, state: int, kind: int) -> int:
        best: list = [None] * 4
        for place, held in enumerate(self.states[state]):
            if held is None:
                continue
            for after, cost, edits in _moves(place, kind):
                found = (held[0] + cost, held[1], edits, place)
                if best[after] is None or found < best[after]:
                    best[after] = found
        least = min(b[0] for b in best if b)
        best = [b if b and b[0] <= least + HOPELESS else None for b in best]
        ranks = {b[1:3]: r for r, b in enumerate(sorted((b for b in best if b), key=lambda b: b[1:3]))}
        reached = tuple(b and (b[0] - least, ranks[b[1:3]]) for b in best)
        if reached not in self.numbers:
            self.numbers[reached] = len(self.states)
            self.states.append(reached)
        self.known[state, kind] = len(self.steps)
        self.steps.append((self.numbers[reached], least, [b and (b[3], b[2]) for b in best]))
        return len(self.steps) - 1

    def finish(self, state: int) -> tuple[int, int, str]:
        """(cost above the least one, last place, inserts at the end) of the cheapest whole edits."""
        ends = {START: "", ASSISTANT: "", USER: INSERT, SYSTEM: INSERT * 2}
        found = [(h[0] + len(ends[p]) * INSERT_COST, h[1], p) for p, h in enumerate(self.states[state]) if h]
        cost, _, place = min(found)
        return cost, place, ends[place]


@dataclass
class Talk:
    """One conversation on its way through the stream."""

    conv_id: int | None
    state: int = 0
    cost: int = 0
    rows: int = 0
    last: tuple | None = None  # turn, role and text of the row before
    backpointers: tempfile.SpooledTemporaryFile = field(default_factory=lambda: tempfile.SpooledTemporaryFile(SPOOL))
    texts: tempfile.SpooledTemporaryFile = field(default_factory=lambda: tempfile.SpooledTemporaryFile(SPOOL))
    held: list = field(default_factory=list)  # parts that are not in the spool
    size: int = 0

    def keep(self, rows: list[tuple], steps: list[int]) -> None:
        """Rows of (turn, role, text, fault) with their steps."""
        self.backpointers.write(np.asarray(steps, dtype="<u2").tobytes())
        self.held.append(rows)
        self.rows += len(rows)
        self.size += sum(len(r[2]) + 64 for r in rows)
        if self.size > SPOOL:
            for part in self.held:
                pickle.dump(part, self.texts)
            self.held, self.size = [], 0

    def parts(self) -> Iterator[list[tuple]]:
        """All rows in order."""
        end = self.texts.tell()
        self.texts.seek(0)
        while self.texts.tell() < end:
            yield pickle.load(self.texts)
        yield from self.held

    def edits(self, program: Program) -> tuple[IO[bytes], int, str]:
        """(one byte for each row's edits, whole cost, inserts at the end)."""
        more, place, tail = program.finish(self.state)
        codes = tempfile.SpooledTemporaryFile(SPOOL)
        block = SPOOL // 2
        for low in range((self.rows - 1) // block * block, -1, -block):
            self.backpointers.seek(2 * low)
            steps = np.frombuffer(self.backpointers.read(2 * min(block, self.rows - low)), dtype="<u2").tolist()
            out = bytearray(len(steps))
            for i in range(len(steps) - 1, -1, -1):
                place, edits = program.steps[steps[i]][2][place]
                out[i] = CODES[edits]
            codes.seek(low)
            codes.write(out)
        codes.seek(0)
        return codes, self.cost + more, tail


# Edits of one row as one byte.
EDITS = [INSERT * n + e for n in range(3) for e in (KEEP, REROLE, DELETE)]
CODES = {e: i for i, e in enumerate(EDITS)}


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, blank, ends (the last character that is no blank), again (an earlier turn has role and text)."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), said("role"), said("text"))
    words = rows.select("*", F.struct("turn").alias("when"), _said("role", "text").alias("said"))
    # Only what stands in several turns of one conversation meets the rows again.
    several = words.groupBy("conv_id", "said").agg(F.min("when").alias("low"), F.max("when").alias("high")).where("low < high")
    several = several.select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "low")
    marked = words.join(several, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    ends = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    return marked.select("conv_id", "turn", "role", "text", ends.alias("ends"), F.coalesce(F.col("when") > F.col("low"), F.lit(False)).alias("again"))


def _said(role: str, text: str) -> Column:
    return F.concat_ws(":", F.length(role).cast("string"), F.sha2(F.concat(role, text), 256))


class Stream:
    """Rows in order of conversation and turn to repaired conversations."""

    def __init__(self):
        self.program = Program()
        self.talk: Talk | None = None

    def read(self, batch: pd.DataFrame) -> Iterator[Talk]:
        """Conversations that end inside the batch."""
        conv = batch["conv_id"].tolist()
        cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.iloc[a:b]
            key = part["conv_id"].iat[0]
            key = None if key is None else int(key)
            if self.talk is None or self.talk.conv_id != key:
                if self.talk is not None:
                    yield self.talk
                self.talk = Talk(key)
            self.add(part)

    def add(self, part: pd.DataFrame) -> None:
        talk, program = self.talk, self.program
        rows, steps = [], []
        for turn, role, text, ends, again in zip(*(part[c].tolist() for c in ("turn", "role", "text", "ends", "again"))):
            now = (turn, role, text)
            if not ends:
                fault, kind = "blank", FORCED
            elif again or now == talk.last:
                fault, kind = "duplicate", FORCED
            else:
                cut = ends not in ".!?"
                fault, kind = "truncated" if cut else "", INITIALS.get(role[:1], OTHER) + CUT * cut
            step = program.step(talk.state, kind)
            talk.state, more, _ = program.steps[step]
            talk.cost += more
            talk.last = now
            steps.append(step)
            rows.append((None if turn is None else int(turn), role, text, fault))
        talk.keep(rows, steps)


def repaired(talk: Talk, program: Program) -> Iterator[tuple]:
    """(edit, turn, old role, role, text, fault, cost) for every edit in order; the whole cost stands with each."""
    codes, cost, tail = talk.edits(program)
    place = START
    for part in talk.parts():
        for code, (turn, role, text, fault) in zip(codes.read(len(part)), part):
            for edit in EDITS[code]:
                if edit == INSERT:
                    place = _next(place)
                    yield INSERT, None, None, ROLES[place], "", "", cost
                elif edit == DELETE:
                    yield DELETE, turn, role, None, text, fault, cost
                else:
                    place = SYSTEM if edit == KEEP and place == START and role[:1] == "s" else _next(place)
                    yield edit, turn, role, role if edit == KEEP else ROLES[place], text, fault, cost
    for _ in tail:
        place = _next(place)
        yield INSERT, None, None, ROLES[place], "", "", cost


def _stream(rows: DataFrame) -> DataFrame:
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    # Numbers as text: pandas would turn those with a NULL among them into floats.
    return rows.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "ends", "again")


def repair(rows: DataFrame) -> DataFrame:
    """One row per edit: conv_id, step (from 0), edit, turn, old_role, role (NULL if deleted), text, fault.

    The rows that are not deleted, by step, are the repaired conversation."""
    kinds = "conv_id long, step long, edit string, turn long, old_role string, role string, text string, fault string"
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = Stream()

        def frame(out: list) -> pd.DataFrame:
            done = pd.DataFrame(out, columns=names)
            return done.astype({"conv_id": "Int64", "turn": "Int64"})

        out: list = []
        for talk in _ended(stream, batches):
            for step, (edit, turn, old, role, text, fault, _) in enumerate(repaired(talk, stream.program)):
                out.append((talk.conv_id, step, edit, turn, old, role, text, fault))
                if len(out) >= ROWS:
                    yield frame(out)
                    out = []
        if out:
            yield frame(out)

    return _stream(faults(rows)).mapInPandas(run, kinds)


def _ended(stream: Stream, batches: Iterator[pd.DataFrame]) -> Iterator[Talk]:
    for batch in batches:
        if len(batch):
            yield from stream.read(batch)
    if stream.talk is not None:
        yield stream.talk


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The same stream as `repair`; a conversation's digest grows with its rows, so they are never held together."""
    counts = ("blank", "duplicate", "truncated")
    kinds = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, out = Stream(), []

        for talk in _ended(stream, batches):
            seen = dict.fromkeys(counts, 0)
            audit, text, first, illegal = [], sha256(), True, 0
            before = low = high = None
            distinct, cost = 0, 0
            for edit, turn, old, role, said, fault, cost in repaired(talk, stream.program):
                audit.append(edit)
                if fault:
                    seen[fault] += 1
                if edit != INSERT:
                    illegal += before is not None and before + old[:1] not in ("su", "ua", "au")
                    before = old[:1]
                    # Turns come in order, NULL first.
                    if turn is not None and turn != high:
                        low, high, distinct = turn if low is None else low, turn, distinct + 1
                if edit != DELETE:
                    text.update(f"{'' if first else chr(10)}{role}:{said}".encode())
                    first = False
            gaps = 0 if low is None else high - low + 1 - distinct
            out.append((talk.conv_id, gaps, *[seen[c] for c in counts], illegal, cost, "".join(audit), text.hexdigest()))
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
                out = []
        if out:
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})

    return _stream(faults(rows)).mapInPandas(run, kinds)


def with_empty(reports: DataFrame, conversations: DataFrame) -> DataFrame:
    """Reports of all conversations: those without rows have zeros, an empty audit and the digest of nothing."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("c")).distinct()
    joined = ids.join(reports, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    empty = {"long": F.lit(0).cast("long"), "audit": F.lit(""), "repaired_sha256": F.lit(sha256(b"").hexdigest())}
    rest = [F.coalesce(F.col(n), empty.get(n, empty["long"])).alias(n) for n in reports.columns if n != "conv_id"]
    return joined.select(F.col("c").alias("conv_id"), *rest)
