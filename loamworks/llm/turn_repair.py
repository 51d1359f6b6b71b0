"""Conversation repair: the cheapest edits that make the roles of a conversation grammatical."""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Costs of edits; roles are an optional system turn, then pairs of user and assistant.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"

#: Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may follow each state besides an opening system turn, and the state behind it.
FOLLOWS = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"


def damaged(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped, 2: repeated) of rows with faults dealt by crc32 of conv_id:turn.

    Null roles and texts become one space, as null parts of the key do. Of each 20 rows, one is dropped, one loses
    its text, one its sentence ends, one is repeated, one becomes the user's.
    """
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(part("text"), ENDS, "")).when(fault != 0, part("text"))
    role = F.when(fault == 4, "user").otherwise(part("role"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return convs.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


class Viterbi:
    """Forward dynamic programme over the four grammar states of one conversation.

    Each state carries its least (cost, audit). Two audits of one layer and state with the same cost are never
    prefixes of each other (the longer one would have paid for inserts), so the least one stays least whatever
    follows. States that can't win any more are dropped, and what all audits begin with is settled: the settled
    edits are handed out, and only rows behind them are kept.
    """

    def __init__(self):
        self.best: dict[int, tuple[int, str]] = self._closed({START: (0, "")})
        self.waiting: deque[tuple[str, str]] = deque()
        self.state = START

    @staticmethod
    def _closed(best: dict) -> dict:
        """The layer with inserts: two in a row at most, since a third would only come back to a state it has passed."""
        for _ in range(2):
            for state, (cost, audit) in list(best.items()):
                to, new = FOLLOWS[state][1], (cost + INSERT, audit + "I")
                best[to] = min(best.get(to, new), new)
        return best

    def row(self, role: str, text: str, refused: bool, cut: bool) -> Iterator[tuple[str, str, str]]:
        """The next row; refused ones have to be deleted. Yields the edits that are settled."""
        self.waiting.append((role, text))
        layer: dict[int, tuple[int, str]] = {}

        def offer(state: int, cost: int, audit: str) -> None:
            layer[state] = min(layer.get(state, (cost, audit)), (cost, audit))

        for state, (cost, audit) in self.best.items():
            offer(state, cost + DELETE, audit + "D")
            if not refused:
                follower, after = FOLLOWS[state]
                if role[:1] == follower[0]:
                    offer(after, cost + cut * CUT, audit + "K")
                elif role[:1] == "s" and state == START:
                    offer(SYSTEM, cost + cut * CUT, audit + "K")
                offer(after, cost + REROLE + cut * CUT, audit + "R")
        self.best = self._closed(layer)
        # Whatever follows the system turn can follow an assistant's; whatever follows nothing can but for one system turn.
        least = self.best[ASSISTANT][0]
        if SYSTEM in self.best and self.best[SYSTEM][0] > least:
            del self.best[SYSTEM]
        if START in self.best and self.best[START][0] > least + DELETE:
            del self.best[START]
        audits = [audit for _, audit in self.best.values()]
        if len({audit[:1] for audit in audits}) == 1:
            shared = os.path.commonprefix(audits)
            self.best = {state: (cost, audit[len(shared) :]) for state, (cost, audit) in self.best.items()}
            yield from self._settled(shared)

    def ended(self) -> Iterator[tuple[str, str, str]]:
        """The edits still open; cost is known then."""
        self.cost, audit = min(self.best[state] for state in (START, ASSISTANT) if state in self.best)
        yield from self._settled(audit)

    def _settled(self, audit: str) -> Iterator[tuple[str, str, str]]:
        for edit in audit:
            role, text = ("", "") if edit == "I" else self.waiting.popleft()
            if edit in "IR":
                role, self.state = FOLLOWS[self.state]
            elif edit == "K":
                self.state = SYSTEM if role[0] == "s" else USER if role[0] == "u" else ASSISTANT
            yield edit, role, text


class _Counter:
    """Faults, gaps and the repaired conversation's digest while its rows pass by."""

    def __init__(self, conv_id):
        self.conv_id, self.n = conv_id, dict.fromkeys(COUNTS, 0)
        self.viterbi, self.audit, self.sha, self.lines = Viterbi(), [], hashlib.sha256(), 0
        self.initial = self.lowest = self.last = None
        self.turns = 0

    def row(self, turn, role: str, text: str, seen: bool) -> Iterator[tuple]:
        if turn is not None and turn != self.last:
            self.lowest = turn if self.lowest is None else self.lowest
            self.turns, self.last = self.turns + 1, turn
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.n["illegal"] += 1
        self.initial = role[:1]
        end = text.rstrip(WHITE)[-1:]
        fault = "blank" if not end else "duplicate" if seen else "truncated" if end not in ENDS else None
        if fault:
            self.n[fault] += 1
        yield from self._edits(self.viterbi.row(role, text, fault in ("blank", "duplicate"), fault == "truncated"))

    def ended(self) -> Iterator[tuple]:
        yield from self._edits(self.viterbi.ended())
        self.n["cost"] = self.viterbi.cost
        if self.turns:
            self.n["gaps"] = self.last - self.lowest + 1 - self.turns

    def _edits(self, edits: Iterator[tuple[str, str, str]]) -> Iterator[tuple]:
        for edit, role, text in edits:
            self.audit.append(edit)
            if edit != "D":
                self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
                self.lines += 1
            yield self.conv_id, len(self.audit), edit, role, text

    def report(self) -> tuple:
        return self.conv_id, *self.n.values(), "".join(self.audit), self.sha.hexdigest()


def _walk(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[tuple]:
    """Reports, or edits if turns, of conversations whose rows come one after another, in order."""
    now = None
    for batch in batches:
        for conv_id, turn, role, text, copies, seen in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    edits = list(now.ended())
                    yield from edits if turns else [now.report()]
                now = _Counter(conv_id)
            for n in range(copies):
                edits = now.row(turn, role, text, seen or n > 0)
                for edit in edits:
                    if turns:
                        yield edit
    if now is not None:
        edits = list(now.ended())
        yield from edits if turns else [now.report()]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    for row in rows:
        kept.append(row)
        if len(kept) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)


_TYPES = {"long": pa.int64(), "string": pa.string()}


def _over(convs: DataFrame, schema: str, turns: bool) -> DataFrame:
    arrow = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in schema.split(", "))])
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    copies: Column = F.col("copies").cast("int") if "copies" in convs.columns else F.lit(1)
    rows = convs.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", copies.alias("copies"))
    rows = rows.withColumns({name: F.when(F.col("copies") > 0, blank(name)) for name in ("role", "text")})
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first(), F.col("copies").desc())
    seen = rows.repartition("conv_id").withColumn("seen", (F.row_number().over(same) > 1))  # dealt by conversation already
    seen = seen.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "seen")
    return seen.mapInArrow(lambda batches: _batches(_walk(batches, turns), arrow), schema)


def repair_report(convs: DataFrame) -> DataFrame:
    """One row for each conv_id: faults, cost and audit of the cheapest repair, SHA-256 of the repaired turns.

    convs has conv_id, turn, role, text and maybe copies (how often the row stands there; 0 only names its
    conversation). Rows go by turn, null first, then role and text; repeated rows count each. Null roles and
    texts are one space, so such texts are blank. A conversation without rows has zeros, an empty audit and the
    digest of nothing; a null conv_id is a conversation, too; an empty table gives none. Roles are told by their
    first character; a role without one, or with another than s, u or a, has to be changed or deleted. Rows are
    dealt by conversation and stream through the programme in order, sorted with spilling, so a conversation of
    any length needs memory for its audit (a byte a row) and its unsettled rows only, as SHA-256 takes turns in
    sequence. Other columns of convs are ignored.
    """
    return _over(convs, REPORT, turns=False)


def repaired_turns(convs: DataFrame) -> DataFrame:
    """The edits of repair_report in order: conv_id, place (from 1), edit (K, R, D or I), and the turn's role and text."""
    return _over(convs, TURNS, turns=True)


def digest(convs: DataFrame) -> DataFrame:
    """The report on conversations with dealt faults."""
    return repair_report(damaged(convs))
