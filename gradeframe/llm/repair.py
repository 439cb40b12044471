"""Repair the turn structure of conversations by the cheapest edits.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``.  Its rows are
kept, given another role or deleted, and empty turns are inserted; the cheapest edits win,
and among equally cheap ones those whose letters, in order, come first in ASCII.

Every choice is a weight in one integer: the high digits are the cost, the low digits the
letters of the audit, eight to a digit, the first letter in the highest place and zeros
behind the last.  The smaller integer is thus the cheaper audit, or the first of two as
cheap, and a shorter text comes before its continuations.  The nodes of the graph are
(row, state of the pattern); going from the last row to the first, a letter in front of an
audit moves it one digit down, so the minimum of plain integers at each node is all there is.

A conversation may be of any length, so it is cut into blocks of rows:

1. Spark sorts all rows by (conversation, turn) over ranges and numbers them.
2. Every block is a matrix: the least cost from each state before it to each one behind.
3. One pass over the matrices, last block first, gives the cost of everything behind a block.
4. Each block then finds its own audits with those costs as weights of its end.  Inserted
   turns belong to the row that follows, so two audits of a block never differ only in
   what follows the shorter one, and the choice inside a block is that of the whole.
5. One pass over rows and audits, first row first, reads them and hashes the repaired text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship, text_batches

# A row's code: what its role's initial is, and which fault it has.
INITIALS = {"s": 0, "u": 1, "a": 2}  # any other: 3
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)

# States of the pattern: nothing yet, after s, after u, after a; where each initial leads.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
FINAL = (START, ASSISTANT)
ANSWERS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # where an inserted or renamed turn leads
ROLES = {USER: "user", ASSISTANT: "assistant"}

# Letters as digits, in ASCII order; zero ends an audit.
DIGIT, LETTER = {"D": 1, "I": 2, "K": 3, "R": 4}, "\0DIKR"
BITS = 3
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
NEVER = 1 << 60  # a cost above all others


def suffix_weights(codes: tuple[int, ...], behind: tuple[int, ...], last: bool) -> list[list[int]]:
    """Weight of the best audit from each (row, state) on; ``behind``: costs of what follows the block.

    The last block of a conversation may insert turns at its end.
    """
    places = 3 * len(codes) + 2
    low = BITS * places
    top = low - BITS

    def led(letter: str, extra: int, weight: int) -> int:
        """``letter`` in front of an audit: its digits move down, the costs add up."""
        cost, digits = weight >> low, weight & ((1 << low) - 1)
        return (cost + COST[letter] + extra << low) | DIGIT[letter] << top | digits >> BITS

    def inserted(at: list[int]) -> list[int]:
        """With up to two inserted turns first; more would come back to the same state."""
        once = [min(at[s], led("I", 0, at[ANSWERS[s]])) for s in range(4)]
        return [min(at[s], led("I", 0, once[ANSWERS[s]])) for s in range(4)]

    now = [min(cost, NEVER) << low for cost in behind]
    if last:
        now = inserted(now)
    table = [now]
    for code in reversed(codes):
        initial, fault = code >> 2, code & 3
        here = []
        for s in range(4):
            options = [led("D", 0, now[s])]
            if fault in (SOUND, TRUNCATED):
                options.append(led("R", fault, now[ANSWERS[s]]))
                if (s, initial) in STEPS:
                    options.append(led("K", fault, now[STEPS[s, initial]]))
            here.append(min(options))
        now = inserted(here)
        table.append(now)
    return table[::-1]


@lru_cache(1 << 14)
def least_costs(codes: tuple[int, ...], last: bool) -> tuple[tuple[int, ...], ...]:
    """Least cost from each state before the block to each one behind it."""
    low = BITS * (3 * len(codes) + 2)
    ends = []
    for end in range(4):
        weights = suffix_weights(codes, tuple(0 if s == end else NEVER for s in range(4)), last)[0]
        ends.append([min(w >> low, NEVER) for w in weights])
    return tuple(zip(*ends, strict=True))


@lru_cache(1 << 14)
def audits(codes: tuple[int, ...], behind: tuple[int, ...], last: bool) -> tuple[tuple[str, int], ...]:
    """The audit of a block from each state before it, and the state behind it."""
    low = BITS * (3 * len(codes) + 2)
    out = []
    for state, weight in enumerate(suffix_weights(codes, behind, last)[0]):
        digits = [weight >> at & 7 for at in range(low - BITS, -1, -BITS)]
        letters = "".join(LETTER[d] for d in digits if d)
        row = 0
        for letter in letters:
            if letter in "RI":
                state = ANSWERS[state]
            elif letter == "K":
                state = STEPS.get((state, codes[row] >> 2), START)  # no audit at all leads here
            row += letter != "I"
        out.append((letters, state))
    return tuple(out)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats the row at the
    same turn, 4 makes its role user.  Nulls are one space, in the hashed key as well.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy"))
    return rows.drop("copy")


def faults(text: Column) -> Column:
    """Whether a text is sound, blank or truncated; white space is ASCII."""
    # the last character that is no white space
    end = F.substring(F.rtrim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), -1, 1)
    return F.when(end == "", BLANK).when(end.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)


def repair(conversations: DataFrame, rows: DataFrame | None = None, block: int = 128) -> DataFrame:
    """One row per conv_id of ``conversations``: gaps, blank, duplicate, truncated, illegal, cost
    (longs), audit, repaired_sha256.

    ``rows`` (conv_id, turn, role, text) are what is repaired, ``conversations`` itself by
    default; a conversation without rows has zeros, an empty audit and the hash of nothing.
    Rows are taken by turn, nulls first, rows of one turn by role and text, so rows that
    repeat are alike whatever their order.  Null roles and texts are one space; rows with a
    null conv_id are one conversation.  A role without characters can be renamed or deleted,
    not kept.  Texts of any length are compared by their SHA-256.  Empty tables give no rows;
    other columns are ignored.

    Sorting, faults and audits are spread over blocks however long one conversation is.  Its
    costs, a few numbers a block, and its text, a row at a time, pass through one task in
    order, as a hash of the whole text has to; neither is held there.  The audit is one value.
    """
    spark = conversations.sparkSession
    ship(spark)
    scratch = Scratch(spark, "repair")
    rows = conversations if rows is None else rows
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id"), F.col("turn").cast("bigint").alias("turn"), space("role"), space("text"))
    # the bounds of the ranges are samples of the keys, so long texts give only their beginning
    rows = rows.repartitionByRange("conv_id", "turn", F.left("role", F.lit(64)), F.left("text", F.lit(64)))
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text")
    # numbers grow with the partition, and by one inside it
    rows = scratch.keep(rows.withColumn("at", F.monotonically_increasing_id()), "rows")

    initial = F.substring("role", 1, 1)
    kind = F.coalesce(*[F.when(initial == c, n) for c, n in INITIALS.items()], F.lit(3))
    narrow = rows.select("conv_id", "at", (kind * 4 + faults(F.col("text"))).alias("code"), "role", F.sha2("text", 256).alias("digest"))
    narrow = scratch.keep(narrow, "codes")
    firsts = narrow.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at"))
    cell = F.floor(F.col("at") / block).alias("cell")
    marks = narrow.select("conv_id", "at", cell, "code").unionByName(firsts.select("conv_id", "at", cell, F.lit(-1).alias("code")))
    blocks = marks.groupBy("conv_id", "cell").agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("at", "code"))).alias("marks"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The codes of a block's rows, those that are no first of their kind as duplicates."""
        for batch in batches:
            lists = []
            for marks in batch.column(2).to_pylist():
                first = {m["at"] for m in marks if m["code"] < 0}
                lists.append([m["code"] if m["at"] in first or m["code"] & 3 == BLANK else m["code"] & ~3 | DUPLICATE for m in marks if m["code"] >= 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["conv_id", "at", "codes"])

    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    blocks = blocks.select("conv_id", "at", "marks").mapInArrow(coded, f"{conv}, at bigint, codes array<int>")

    def costs_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a conversation from the last to the first: the costs of what is behind each."""
        none = tuple(0 if s in FINAL else NEVER for s in range(4))
        conv, behind = batches, none  # no conversation yet
        for batch in batches:
            found, lasts = [], []
            for c, codes in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                last = c != conv
                if last:
                    conv, behind = c, none
                found.append(behind)
                lasts.append(last)
                matrix = least_costs(tuple(codes), last)
                behind = tuple(min(row[e] + behind[e] for e in range(4)) for row in matrix)
            columns = [*batch.columns, pa.array(found, pa.list_(pa.int64())), pa.array(lasts, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "at", "codes", "behind", "last"])

    back = blocks.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("at").desc())
    back = scratch.keep(back.mapInArrow(costs_behind, f"{conv}, at bigint, codes array<int>, behind array<bigint>, last boolean"), "costs")

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, ends = [], []
            for codes, behind, last in zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True):
                least = min(behind)  # only differences decide
                own = audits(tuple(codes), tuple(min(b - least, NEVER) for b in behind), last)
                letters.append([a for a, _ in own])
                ends.append([e for _, e in own])
            columns = [*batch.columns[:4], pa.array(letters, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "at", "codes", "behind", "letters", "ends"])

    plan = back.repartition("at").mapInArrow(edited, f"{conv}, at bigint, codes array<int>, behind array<bigint>, letters array<string>, ends array<int>")
    # a head for every conversation, a plan before the rows of each block, and the rows
    head = conversations.select("conv_id").distinct().withColumn("at", F.lit(-1).cast("bigint"))
    stream = head.unionByName(plan, allowMissingColumns=True).unionByName(rows, allowMissingColumns=True)
    # of a plan and a row with the same number, the plan has no role and comes first
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "at", F.col("role").asc_nulls_first())
    stream = stream.select("conv_id", "at", "codes", "letters", "ends", "turn", "role", "text")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = kind = None

        def table(done: list[tuple]) -> pa.RecordBatch:
            types = [kind, *[pa.int64()] * len(counts), pa.string(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", *counts, "audit", "repaired_sha256"])

        for batch in text_batches(batches, 7):
            done, kind = [], batch.column(0).type
            for conv, at, codes, letters, ends, turn, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at < 0:
                    if now:
                        done.append(now.result())
                    now = Reader(conv)
                elif not now or conv != now.conv:
                    raise ValueError("rows of a conversation that is not in the table")
                elif role is None:
                    now.block(codes, letters, ends)
                else:
                    now.row(turn, role, text)
            if done:
                yield table(done)
        if now:
            yield table([now.result()])

    schema = f"{conv}, {', '.join(f'{c} bigint' for c in counts)}, audit string, repaired_sha256 string"
    return scratch.keep(stream.mapInArrow(read, schema), "repaired")


class Reader:
    """Reads the rows of one conversation in order, with the audits of its blocks."""

    def __init__(self, conv):
        self.conv, self.state, self.role, self.audit = conv, START, START, []
        self.counts = [0] * 4  # by fault
        self.illegal = self.cost = self.turns = 0
        self.first = self.last = self.initial = None
        self.hash, self.any = hashlib.sha256(), False
        self.letters, self.at, self.codes, self.next = "", 0, (), 0

    def block(self, codes, letters, ends):
        self.finish()
        self.codes, self.next = codes, 0
        self.letters, self.at = letters[self.state], 0
        self.audit.append(self.letters)
        self.role, self.state = self.state, ends[self.state]

    def emit(self, role: str, text: str):
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def letter(self) -> str:
        """The next letter of a row, after the turns inserted before it."""
        while self.at < len(self.letters):
            letter = self.letters[self.at]
            self.at += 1
            self.cost += COST[letter]
            if letter != "I":
                return letter
            self.role = ANSWERS[self.role]
            self.emit(ROLES[self.role], "")
        return ""

    def finish(self):
        if self.letter():
            raise ValueError("an audit has letters beyond its rows")

    def row(self, turn, role: str, text: str):
        code = self.codes[self.next]
        self.next += 1
        initial, fault = role[:1], code & 3
        self.counts[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            if self.first is None:
                self.first = turn
            if turn != self.last:
                self.turns += 1
            self.last = turn
        letter = self.letter()
        if letter == "D":
            return
        self.cost += fault == TRUNCATED
        if letter == "R":
            self.role = ANSWERS[self.role]
            role = ROLES[self.role]
        else:
            self.role = STEPS[self.role, code >> 2]
        self.emit(role, text)

    def result(self):
        self.finish()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        c = self.counts
        return (self.conv, gaps, c[BLANK], c[DUPLICATE], c[TRUNCATED], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())
