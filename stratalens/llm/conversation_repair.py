"""Conversation structure repair by secondary-sorted streams.

Rows of a conversation, ordered by turn (nulls first; rows that tie in stored order), are
kept, given another role, deleted or complemented so that the roles read
``(s?(ua)+)?``, at least cost; of the cheapest ways the one whose edits read least.

The cheapest rest of a conversation depends on the state of the roles so far (nothing, s,
u or a) and on the rows that follow, so the programme runs from the last row to the first.
Its four costs, less the least of them, take few values: they are the states of a small
automaton (``machine``), and a row's back-pointer is the number of one of its steps.

1. ``marked`` finds each row's first fault. What was seen earlier in the conversation comes
   from an aggregation by hash, joined back to what repeats.
2. ``pointers``: rows without text, repartitioned by conversation and sorted by turn,
   latest first. A task carries the automaton's state from one Arrow batch to the next and
   spills a block of BLOCK back-pointers, a byte a row, whenever one is full: into rows of a
   table in the shared folder, so a conversation of any length takes bounded memory.
3. ``repaired``: the texts, sorted by turn, earliest first, each block of pointers just
   before its first row. A task carries the state of the roles and a running digest, and
   gives one row per conversation. Only the edits of a conversation grow in memory, a
   letter a row; they are part of its result.

Nulls count as one space each, for role and text and in the checksum that picks rows to
damage; a null conversation is one of its own. Repeated rows are rows of their own, and so
duplicates. Rows of one turn are all taken. An empty table gives an empty table. Columns
other than the four are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import SPACE, attach, ship, with_row
from stratalens.sources.staging import staged

# Costs of the edits, and what a truncated row that stays adds.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Share of damaged rows: of so many checksums each kind of damage has one.
DAMAGES = 20
DROP, EMPTY, BARE, REPEAT, RECAST = range(5)

#: States of the roles so far, by the last initial ("" at first). Both "" and "a" may end.
STATES = ("", "s", "u", "a")
ENDS = (0, 3)
#: The role that an edit may add in a state, and the state after it.
ADDED = {0: "user", 1: "user", 2: "assistant", 3: "user"}
AFTER = {0: 2, 1: 2, 2: 3, 3: 2}
#: Faults of a row, in the order in which they count.
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: Rows in a block of back-pointers.
BLOCK = 1 << 16
FAR = 1 << 40

KEY = ["conv_id", "turn", "_row", "_copy"]


# --- the automaton --------------------------------------------------------------------

def kept_state(state: int, initial: str) -> int | None:
    """The state after a row of this initial, where one may follow."""
    if initial == "s" and state == 0:
        return 1
    return AFTER[state] if initial == ADDED[state][0] else None


def kind_of(initial: str, fault: int) -> int:
    """Rows of one kind have the same edits: by initial (s, u, a, any other) and whether the
    row is truncated; rows that must be deleted are one kind."""
    if fault in (BLANK, DUPLICATE):
        return 8
    return 2 * ("sua".index(initial) if initial in ("s", "u", "a") else 3) + (fault == CUT)


KINDS = [(i, cut) for i in ("s", "u", "a", "?") for cut in (0, 1)] + [None]


def _inserted(cost: list[int], first: list[str]) -> None:
    """Let every state also insert a row. At equal cost the edit that reads less is first."""
    changed = True
    while changed:
        changed = False
        for state in range(4):
            other = cost[AFTER[state]] + INSERT
            if (other, "I") < (cost[state], first[state]):
                cost[state], first[state], changed = other, "I", True


def _step(later: tuple, kind: tuple | None) -> tuple[tuple, int, list[str]]:
    """From the costs of the rest after a row: those from before it (less their least), the
    least, and the first edit in each state."""
    cost, first = [], []
    for state in range(4):
        ways = [(DELETE + later[state], "D")]
        if kind is not None:
            extra = TRUNCATED if kind[1] else 0
            ways.append((RENAME + extra + later[AFTER[state]], "R"))
            kept = kept_state(state, kind[0])
            if kept is not None:
                ways.append((extra + later[kept], "K"))
        best = min(ways)
        cost.append(best[0])
        first.append(best[1])
    _inserted(cost, first)
    least = min(cost)
    return tuple(c - least for c in cost), least, first


def _edits(state: int, first: list[str], kind: tuple | None) -> tuple[str, int]:
    """Edits up to and with the one that takes the row, and the state after them."""
    made = ""
    while first[state] == "I":
        made, state = made + "I", AFTER[state]
    made += first[state]
    if first[state] == "R":
        state = AFTER[state]
    elif first[state] == "K":
        state = kept_state(state, kind[0])
    return made, state


class Machine:
    """All steps (fewer than 256), numbered alike wherever it is built. ``next[v][kind]`` is a step, ``into[step]``
    the state that it leads to, ``least[step]`` what it adds, ``edits[step][state of the
    roles]`` the edits and the state of the roles after the row."""

    def __init__(self):
        cost, first = [0 if s in ENDS else FAR for s in range(4)], ["" for _ in range(4)]
        _inserted(cost, first)
        self.start = tuple(cost)
        number, self.next, self.into, self.least, self.edits = {self.start: 0}, [], [], [], []
        waiting = [self.start]
        for costs in waiting:  # grows while new states are found
            steps = []
            for kind in KINDS:
                before, least, first = _step(costs, kind)
                if before not in number:
                    number[before] = len(number)
                    waiting.append(before)
                steps.append(len(self.into))
                self.into.append(number[before])
                self.least.append(least)
                self.edits.append([_edits(s, first, kind) for s in range(4)])
            self.next.append(steps)
        self.costs = waiting
        self.tail = []  # edits after the last row
        for state in range(4):
            made = ""
            while state not in ENDS:
                made, state = made + "I", AFTER[state]
            self.tail.append(made)


@lru_cache(maxsize=1)
def machine() -> Machine:
    return Machine()


# --- rows -------------------------------------------------------------------------------

def rows_of(df: DataFrame, conv: str, turn: str, role: str, text: str, damage: bool) -> DataFrame:
    """conv_id, turn, role, text, the row's number and, for repeated rows, the copy's."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                      shown(role).alias("role"), shown(text).alias("text"))
    rows = with_row(named, "_row")
    if not damage:
        return rows.withColumn("_copy", F.lit(0))
    hashed = F.crc32(F.encode(F.concat(shown("conv_id"), F.lit(":"), shown("turn")), "UTF-8"))
    rows = rows.withColumn("_damage", hashed % DAMAGES).where(F.col("_damage") != DROP)
    copies = F.when(F.col("_damage") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role_ = F.when(F.col("_damage") == RECAST, "user").otherwise(F.col("role"))
    text_ = (F.when(F.col("_damage") == EMPTY, "")
             .when(F.col("_damage") == BARE, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    return rows.select("conv_id", "turn", "_row", F.explode(copies).alias("_copy"), role_.alias("role"), text_.alias("text"))


def marked(rows: DataFrame) -> DataFrame:
    """Per row: its place (KEY), initial and first fault. No text."""
    bare = F.btrim("text", F.lit(SPACE))
    one = F.xxhash64("role", "text")
    two = F.xxhash64(F.lit(1), F.col("text"), F.col("role"))
    seen = rows.select(*KEY, F.substring("role", 1, 1).alias("initial"), (bare == "").alias("_blank"),
                       (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("_cut"), one.alias("_h"), two.alias("_g"))
    seen = staged(seen, "marks")
    place = F.struct("turn", "_row", "_copy")
    again = staged(seen.where("NOT _blank").groupBy("conv_id", "_h", "_g")
                   .agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "repeated")
    found = attach(seen, again, ["conv_id", "_h", "_g"], F.xxhash64("_row", "_copy"))
    fault = (F.when(F.col("_blank"), BLANK).when(F.coalesce(place > F.col("_first"), F.lit(False)), DUPLICATE)
             .when(F.col("_cut"), CUT).otherwise(SOUND))
    return found.select(*KEY, "initial", fault.alias("fault"))


def _streamed(df: DataFrame, order: list[Column]) -> DataFrame:
    """Conversations together, each in order. ``_conv`` tells them apart in Python, where a
    whole number with nulls would become a float."""
    named = df.withColumn("_conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    return named.repartition("conv_id").sortWithinPartitions("_conv", *order)


POINTERS = "conv_id string, turn string, row long, copy int, steps binary, faults binary, cost long"


def pointers(marks: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """Blocks of back-pointers: the key of the first row (as text), the number of a step for
    every row, its fault, and in a conversation's earliest block the cost from there on."""
    ship(marks.sparkSession)
    latest = [F.col("turn").desc_nulls_last(), F.col("_row").desc(), F.col("_copy").desc()]
    stream = _streamed(marks, latest).select("_conv", F.col("turn").cast("string").alias("turn"),
                                             "_row", "_copy", "initial", "fault")

    def spilled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps_of = machine()
        follow, into, least = steps_of.next, steps_of.into, steps_of.least
        kinds: dict = {}
        conv, state, cost, last = None, 0, 0, None
        steps, faults, ready = [], [], []

        def block(total: int | None) -> tuple:
            out = (conv[1:] if conv else None, *last, bytes(steps[::-1]), bytes(faults[::-1]), total)
            steps.clear(), faults.clear()
            return out

        for batch in batches:
            for now, turn, row, copy, initial, fault in zip(*[batch[c].tolist() for c in batch.columns]):
                if now != conv:
                    if last is not None:
                        ready.append(block(cost + steps_of.costs[state][0]))
                    conv, state, cost = now, 0, 0
                elif len(steps) >= block_rows:
                    ready.append(block(None))
                kind = kinds.get((initial, fault))
                if kind is None:
                    kind = kinds[initial, fault] = kind_of(initial, fault)
                step = follow[state][kind]
                steps.append(step), faults.append(fault)
                state, cost, last = into[step], cost + least[step], (turn, row, copy)
            if ready:
                yield _blocks(ready)
                ready = []
        if last is not None:
            yield _blocks([block(cost + steps_of.costs[state][0])])

    return stream.mapInPandas(spilled, POINTERS)


def _blocks(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in POINTERS.split(", ")], dtype=object)
    return frame.astype({"row": "int64", "copy": "int32", "cost": "Int64"})


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = f"conv_id string, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
#: Neighbouring initials that may follow each other.
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class Conversation:
    """What a task carries of one conversation."""

    def __init__(self, name: str):
        self.name, self.state, self.audit, self.digest, self.lines = name, 0, [], sha256(), 0
        self.faults, self.illegal, self.before, self.cost = [0] * 4, 0, None, 0
        self.low = self.high = None
        self.turns, self.turn = 0, None
        self.steps, self.fault, self.at = b"", b"", 0

    def block(self, steps: bytes, faults: bytes, cost: int | None) -> None:
        if self.at != len(self.steps):
            raise ValueError(f"conversation {self.name!r}: {len(self.steps) - self.at} back-pointers left over")
        self.steps, self.fault, self.at = steps, faults, 0
        if cost is not None:
            self.cost = int(cost)

    def line(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def insert(self, edits: str) -> None:
        for _ in edits:
            self.line(ADDED[self.state], "")
            self.state = AFTER[self.state]

    def row(self, turn: str | None, role: str, text: str) -> None:
        if turn is not None and turn != self.turn:
            self.turn = turn
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        initial = role[:1]
        if self.before is not None and (self.before, initial) not in LEGAL:
            self.illegal += 1
        self.before = initial
        self.faults[self.fault[self.at]] += 1
        edits, after = machine().edits[self.steps[self.at]][self.state]
        self.at += 1
        self.audit.append(edits)
        self.insert(edits[:-1])
        if edits[-1] == "K":
            self.line(role, text)
        elif edits[-1] == "R":
            self.line(ADDED[self.state], text)
        self.state = after

    def result(self) -> tuple:
        tail = machine().tail[self.state]
        self.insert(tail)
        gaps = int(self.high) - int(self.low) + 1 - self.turns if self.turns else 0
        return (self.name[1:] if self.name else None, gaps, *self.faults[BLANK:], self.illegal, self.cost,
                "".join(self.audit) + tail, self.digest.hexdigest())


def repaired(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per conversation that has rows: RESULT, with the conversation as text."""
    ship(rows.sparkSession)
    nothing = lambda kind: F.lit(None).cast(kind)
    kind = dict(rows.dtypes)
    texts = rows.select("conv_id", "turn", "_row", "_copy", F.lit(1).alias("_kind"), "role", "text",
                        nothing("binary").alias("steps"), nothing("binary").alias("faults"), nothing("string").alias("cost"))
    first = blocks.select(F.col("conv_id").cast(kind["conv_id"]).alias("conv_id"), F.col("turn").cast(kind["turn"]).alias("turn"),
                          F.col("row").alias("_row"), F.col("copy").alias("_copy"), F.lit(0).alias("_kind"),
                          nothing("string").alias("role"), nothing("string").alias("text"), "steps", "faults",
                          F.col("cost").cast("string").alias("cost"))
    earliest = [F.col("turn").asc_nulls_first(), F.col("_row"), F.col("_copy"), F.col("_kind")]
    stream = _streamed(texts.unionByName(first), earliest).select(
        "_conv", F.col("turn").cast("string").alias("turn"), "_kind", "role", "text", "steps", "faults", "cost")

    def edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        talk, done = None, []
        for batch in batches:
            for conv, turn, kind, role, text, steps, faults, cost in zip(*[batch[c].tolist() for c in batch.columns]):
                if talk is None or conv != talk.name:
                    if talk is not None:
                        done.append(talk.result())
                    talk = Conversation(conv)
                if kind:
                    talk.row(turn, role, text)
                else:
                    talk.block(steps, faults, cost)
            if done:
                yield _results(done)
                done = []
        if talk is not None:
            yield _results([talk.result()])

    return stream.mapInPandas(edited, RESULT)


def _results(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({c: "int64" for c in COUNTS})


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           damage: bool = False, block_rows: int = BLOCK) -> DataFrame:
    """Per conversation of ``df``: gaps among its turns, faults by kind, neighbours of roles
    that may not follow each other, cost and initials of the cheapest edits, and the digest
    of the repaired rows. ``damage`` first damages rows, by a checksum of conversation and
    turn; a conversation that loses all rows counts zeros. ``df`` must be a stored table."""
    rows = rows_of(df, conv, turn, role, text, damage)
    blocks = staged(pointers(marked(rows), block_rows), "pointers")
    found = repaired(rows, blocks).withColumn("conv_id", F.col("conv_id").cast(df.schema[conv].dataType))
    found = staged(found, "repaired").withColumnRenamed("conv_id", "_conv")
    every = df.select(F.col(conv).alias("conv_id")).distinct()
    out = every.join(found, every["conv_id"].eqNullSafe(found["_conv"]), "left").drop("_conv")
    empty = {**{c: 0 for c in COUNTS}, "audit": "", "repaired_sha256": sha256(b"").hexdigest()}
    return out.fillna(empty).withColumnRenamed("conv_id", conv)
