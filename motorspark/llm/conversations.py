"""Conversation structure repair by secondary-sorted streaming.

Rows are dealt by conversation and sorted by turn; repeated turns are marked
by a window over the same partitioning, so texts are shuffled once. A task
then reads its conversations row by row and carries the state of a dynamic
program across Arrow batches: for each state of the role pattern
``(s?(ua)+)?`` the least cost, the place of its edits in ASCII order, and the
running digest of the repaired rows. Rows aren't kept. What each row did is a
number of four bytes (the program has few different steps, which are kept once); long
conversations spill these to a file of the task, which goes with it, and the
edits are read backwards from there.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorspark.llm._io import small_batches

BLANKS = " \t\n\x0b\f\r"
#: Costs of edits, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
#: States of the pattern: nothing yet, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that a reroled or inserted row takes in each state.
TURN_OF = ("user", "user", "assistant", "user")
#: Inserted rows that complete the pattern.
MISSING = (0, 2, 1, 0)
FAULTS = ("", "blank", "duplicate", "truncated")
#: Back pointers in memory; rows, and characters of them, that wait in memory for their edits.
POINTERS, HELD_ROWS, HELD_CHARS = 1 << 16, 4096, 4 << 20


class _Steps:
    """Every different step of the dynamic program, made once: costs and order of the states, and the row's kind, decide it."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple[int, tuple, int]] = {}
        self.moves: list[tuple] = []

    def step(self, state: tuple, kind: str) -> tuple[int, tuple, int]:
        """The step's number, the state after it and the cost that all its states share.

        ``state`` has for each state of the pattern its cost and its place in
        ASCII order, or None. ``kind`` is the role's initial, with ``+`` for a
        truncated row, or ``-`` for one that must go. Every state's edits end
        with one row's letter and hold as many of these, so none begins
        another's: their order never depends on what follows.
        """
        found = self.known.get((state, kind))
        if found is None:
            best: list[tuple | None] = [None] * 4

            def offer(to: int, cost: int, rank: int, letters: str, source: int) -> None:
                new = (cost, rank, letters, source)
                if best[to] is None or new < best[to]:
                    best[to] = new

            for p, own in enumerate(state):
                if own is None:
                    continue
                cost, rank = own
                offer(p, cost + DELETE, rank, "D", p)
                at, letters = p, ""
                while kind != "-" and len(letters) < 3:
                    stays = cost + INSERT * len(letters) + LEFT_TRUNCATED * kind.endswith("+")
                    kept = NEXT.get((at, kind[:1]))
                    if kept is not None:
                        offer(kept, stays, rank, letters + "K", p)
                    offer(NEXT[at, TURN_OF[at][0]], stays + REROLE, rank, letters + "R", p)
                    at, letters = NEXT[at, TURN_OF[at][0]], letters + "I"
            order = {x[1:3]: i for i, x in enumerate(sorted((b for b in best if b), key=lambda b: b[1:3]))}
            least = min(b[0] for b in best if b)
            after = tuple(b and (b[0] - least, order[b[1:3]]) for b in best)
            found = self.known[state, kind] = (len(self.moves), after, least)
            self.moves.append(tuple(b and (b[3], b[2]) for b in best))
        return found


class _Pointers:
    """Numbers of steps, four bytes each; over POINTERS of them are in a file."""

    def __init__(self) -> None:
        self.now, self.file, self.blocks = array("I"), None, 0

    def add(self, step: int) -> None:
        self.now.append(step)
        if len(self.now) == POINTERS:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # of this task alone, without a name
            self.now.tofile(self.file)
            self.now, self.blocks = array("I"), self.blocks + 1

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.now)
        for k in reversed(range(self.blocks)):
            block = array("I")
            self.file.seek(k * POINTERS * block.itemsize)
            block.fromfile(self.file, POINTERS)
            yield from reversed(block)
        if self.file is not None:
            self.file.close()


class _Rows:
    """The rows of a conversation in order; more than HELD_ROWS or HELD_CHARS are in a file."""

    def __init__(self) -> None:
        self.now, self.chars, self.file = [], 0, None

    def add(self, row: tuple) -> None:
        self.now.append(row)
        self.chars += len(row[2])
        if len(self.now) >= HELD_ROWS or self.chars >= HELD_CHARS:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            pickle.dump(self.now, self.file)
            self.now, self.chars = [], 0

    def __iter__(self) -> Iterator[tuple]:
        if self.file is not None:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
            self.file.close()
        yield from self.now


class _Conversation:
    """One conversation while its rows go by."""

    def __init__(self, conv_id: str | None, steps: _Steps, keep: bool) -> None:
        self.conv_id, self.steps = conv_id, steps
        self.state, self.cost = ((0, 0), None, None, None), 0
        self.digests = [hashlib.sha256(), None, None, None]
        self.pointers, self.rows = _Pointers(), _Rows() if keep else None
        self.counts, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.first = self.last = None
        self.turns = 0

    def add(self, turn: str | None, role: str, text: str, fault: int) -> None:
        self.counts[fault] += 1
        self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        if turn is not None:
            at = int(turn)
            self.first = at if self.first is None else self.first
            self.turns += at != self.last
            self.last = at
        kind = "-" if fault in (1, 2) else role[:1] + "+" * (fault == 3)
        number, self.state, more = self.steps.step(self.state, kind)
        self.cost += more
        self.pointers.add(number)
        if self.rows is not None:
            self.rows.add((turn, role, text))
        self.digests = [m and self._digest(*m, role, text) for m in self.steps.moves[number]]

    def _digest(self, source: int, letters: str, role: str = "", text: str = ""):
        if letters in ("D", ""):
            return self.digests[source]
        out, at = self.digests[source].copy(), source
        for c in letters:
            own = role if c == "K" else TURN_OF[at]
            out.update(f"{'' if at == START else '\n'}{own}:{'' if c == 'I' else text}".encode())
            at = NEXT[at, own[:1]]
        return out

    def close(self) -> tuple[int, str, str]:
        """Cost, edits and the digest of the repaired rows."""
        _, _, at = min((own[0] + INSERT * MISSING[p], own[1], p) for p, own in enumerate(self.state) if own)
        cost, letters = self.cost + self.state[at][0] + INSERT * MISSING[at], "I" * MISSING[at]
        digest, audit = self._digest(at, letters), [letters]
        for number in self.pointers.backwards():
            at, letters = self.steps.moves[number][at]
            audit.append(letters)
        return cost, "".join(reversed(audit)), digest.hexdigest()

    def repaired(self, audit: str) -> Iterator[tuple]:
        """turn, role, text and edit of every repaired row; those that were put in have no turn."""
        at, rows = START, iter(self.rows)
        for c in audit:
            turn, role, text = (None, "", "") if c == "I" else next(rows)
            if c != "D":
                own = role if c == "K" else TURN_OF[at]
                at = NEXT[at, own[:1]]
                yield turn, own, text, c


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``present`` after the damage that crc32(``conv_id:turn``) % 20 does to a row.

    0 drops it (``present`` is false), 1 empties its text, 2 removes its
    ``[.!?]``, 3 repeats it, 4 makes its role user. Nulls are one space, in
    the hashed key too; conv_id and turn stay null.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat_ws(":", filled("conv_id"), filled("turn")), "UTF-8")) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("_kind"))
    rows = rows.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_kind") != 0).alias("present")
    )


def _fault() -> Column:
    """The number of a row's first fault."""
    inside = F.btrim(F.col("text"), F.lit(BLANKS))
    return F.when(inside == "", 1).when(F.col("_seen") > 1, 2).when(~F.right(inside, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)


SUMMARY = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id string, position long, turn string, role string, text string, edit string"


def _streamed(rows: DataFrame, turns: bool) -> DataFrame:
    small_batches(rows.sparkSession)
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    filled = lambda c: F.coalesce(F.col(c), F.lit(" "))
    own = rows.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), F.coalesce(present, F.lit(True)).alias("present"))
    # The window's keys begin with the one that rows are dealt by, so it needs no shuffle of its own.
    same = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    seen = own.repartition("conv_id").withColumn("_seen", F.row_number().over(same)).withColumn("fault", _fault())
    ordered = seen.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    ordered = ordered.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "role", "text", "fault", "present")

    names = [x.split()[0] for x in (TURNS if turns else SUMMARY).split(", ")]

    def closed(c: _Conversation) -> Iterator[tuple]:
        cost, audit, digest = c.close()
        if turns:
            yield from ((c.conv_id, i, *row) for i, row in enumerate(c.repaired(audit)))
        else:
            yield c.conv_id, 0 if c.first is None else c.last - c.first + 1 - c.turns, *c.counts[1:], c.illegal, cost, audit, digest

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        steps, now = _Steps(), None
        for pdf in batches:
            for conv_id, turn, role, text, fault, here in zip(*(pdf[c].tolist() for c in pdf.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        yield from closed(now)
                    now = _Conversation(conv_id, steps, turns)
                if here:
                    now.add(turn, role, text, fault)
        if now is not None:
            yield from closed(now)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = finished(batches)
        while out := list(itertools.islice(rows, 512)):
            yield pd.DataFrame(out, columns=names)

    found = ordered.mapInPandas(run, TURNS if turns else SUMMARY)
    found = found.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))
    return found.withColumn("turn", F.col("turn").cast(rows.schema["turn"].dataType)) if turns else found


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation: its faults, the cheapest edits that repair it, and the digest of the repaired rows.

    ``rows`` has conv_id, turn, role, text and, optionally, ``present``; a row
    where that is false counts for nothing but the conversation. ``gaps`` is
    the number of turns missing between the smallest and the largest.
    ``blank``, ``duplicate`` and ``truncated`` count each row's first fault,
    ``illegal`` the adjacent roles that don't follow each other. ``audit`` has
    the edits' initials (Keep, Rerole, Delete, Insert) in order, ties
    ASCII-least; ``repaired_sha256`` is of the lines ``role:text``.

    A conversation without rows has zeros, an empty audit and the digest of
    the empty string. Null roles and texts are one space, which is blank. Rows
    without a turn come first; rows of one turn are ordered by role and text.
    Null conv_ids are one conversation. Further columns aren't read. An empty
    table gives an empty table. A conversation is one task's stream, in memory
    that doesn't grow with it but for its ``audit``.
    """
    return _streamed(rows, turns=False)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, ``position`` from 0, turn (null where put in), role, text and ``edit`` (K, R or I).

    Odd rows as in ``repair``; a conversation without repaired rows has none
    here. Rows of long conversations wait in a file of their task until their
    edits are known.
    """
    return _streamed(rows, turns=True)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and repairs of every conversation after damage; odd rows as in ``damage`` and ``repair``."""
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
