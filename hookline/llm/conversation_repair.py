"""Repair of conversation structure: the cheapest edits that give role initials ``(s?(ua)+)?``.

Rows are partitioned by conversation and sorted by turn; a ``mapInPandas`` then
streams over them and carries the state of one conversation across Arrow
batches, whatever its length. Edits of a row: Keep (0), Rerole to user or
assistant (3), Delete (4, the only choice for blank and duplicate rows);
anywhere an empty user or assistant turn can be Inserted (3); a truncated row
that stays adds 3. The cheapest edits win, the ASCII-least string of their
initials among equals.

The dynamic program has four states: nothing written yet, last written s, u or
a. A step takes one row: some inserts, then D, K or R. Prefixes of the audit that
end with such a letter are never prefixes of one another (as many letters that
are not I), so the states' prefixes have a strict order, their ranks, and
comparing (cost, rank, block) keeps the least string. States more than
``LEAD`` behind can't win, so the frontier (states in rank order, with costs
above the least) takes few values: steps are looked up in a table, and a row's
backpointer is the number of its table entry. Backpointers beyond ``KEPT``
go to an unnamed spill file of the task, and are read backwards at the end.
Each state carries the running digest of its repaired text, so texts are seen once.

Edge cases: rows are ordered by (turn, role, text), nulls first; a null role or
text is one space; rows with a null id form one conversation; a row is a
duplicate if role and text equal those of an earlier row of its conversation
(found in Spark, not kept in the task); conversations all of whose rows are
marked absent have zeros, an empty audit and the digest of the empty string; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
INSERT_COST, REROLE_COST, DELETE_COST, TRUNCATED_COST = 3, 3, 4, 3
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
NONE, S, U, A = range(4)  # what was written last
NEXT = {NONE: U, S: U, U: A, A: U}  # what an insert or a new role can only be
KEEP = {"s": {NONE: S}, "u": {NONE: U, S: U, A: U}, "a": {U: A}}
ENDS = {NONE: "", A: "", U: "I", S: "II"}
ROLES = {U: "user", A: "assistant"}
LEGAL = {"su", "ua", "au"}
LEAD = 16  # no two states' costs to go differ by more than 13
KEPT = 1 << 20

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def steps(fixed: bool, truncated: bool, initial: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, block) over one row, the best block of each (from, to); ``fixed`` rows have to go."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        state = start
        for n in range(3):
            ways = [(DELETE_COST, state, "D")]
            if not fixed:
                stays = TRUNCATED_COST * truncated
                ways.append((REROLE_COST + stays, NEXT[state], "R"))
                if state in KEEP.get(initial, {}):
                    ways.append((stays, KEEP[initial][state], "K"))
            for cost, to, letter in ways:
                found = (cost + n * INSERT_COST, "I" * n + letter)
                best[start, to] = min(best.get((start, to), found), found)
            state = NEXT[state]
    return [(start, to, cost, block) for (start, to), (cost, block) in best.items()]


class Steps:
    """Table of the steps met so far: (frontier, kind of row) to the next frontier, the cost added, and its number."""

    def __init__(self) -> None:
        self.ways: dict[tuple, list] = {}
        self.table: dict[tuple, tuple] = {}
        self.moves: list[tuple[tuple[int, str], ...]] = []  # by number: for each place of the new frontier, the place before and the block

    def step(self, frontier: tuple, kind: tuple) -> tuple:
        known = self.table.get((frontier, kind))
        if known:
            return known
        ways = self.ways.setdefault(kind, steps(*kind))
        best: dict[int, tuple[int, int, str]] = {}
        for rank, (state, cost) in enumerate(frontier):
            for start, to, more, block in ways:
                if start == state:
                    found = (cost + more, rank, block)
                    best[to] = min(best.get(to, found), found)
        least = min(best.values())[0]
        order = sorted((rank, block, to, cost - least) for to, (cost, rank, block) in best.items() if cost - least <= LEAD)
        out = tuple((to, cost) for _, _, to, cost in order)
        self.moves.append(tuple((rank, block) for rank, block, _, _ in order))
        self.table[frontier, kind] = out, least, len(self.moves) - 1
        return self.table[frontier, kind]


class Spill:
    """Numbers, appended and then read from the last to the first; at most ``KEPT`` of them in memory."""

    def __init__(self) -> None:
        self.tail, self.file, self.blocks = array("I"), None, 0

    def append(self, number: int) -> None:
        self.tail.append(number)
        if len(self.tail) == KEPT:
            self.file = self.file or tempfile.TemporaryFile()
            self.tail.tofile(self.file)
            self.tail, self.blocks = array("I"), self.blocks + 1

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.tail)
        size = KEPT * self.tail.itemsize
        for k in reversed(range(self.blocks)):
            self.file.seek(k * size)
            yield from reversed(array("I", self.file.read(size)))
        if self.file:
            self.file.close()


def written(digest, state: int, block: str, role: str, text: str):
    """The digest after a block: each turn written is ``role:text``, and a line feed parts it from the one before."""
    for letter in block:
        if letter == "D":
            continue
        to = KEEP[role[:1]][state] if letter == "K" else NEXT[state]
        line = f"{role}:{text}" if letter == "K" else f"{ROLES[to]}:{text if letter == 'R' else ''}"
        digest.update((line if state == NONE else f"\n{line}").encode())
        state = to
    return digest


class Conversation:
    """What is known of the conversation that is being read."""

    def __init__(self, known: Steps) -> None:
        self.known, self.frontier, self.cost = known, ((NONE, 0),), 0
        self.digests, self.back = [hashlib.sha256()], Spill()
        self.faults = [0, 0, 0, 0]
        self.first = self.last = self.initial = None
        self.turns = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        self.faults[fault] += 1
        kind = (fault in (BLANK, DUPLICATE), fault == TRUNCATED, initial if initial in KEEP else "")
        before = self.frontier
        self.frontier, more, number = self.known.step(before, kind)
        self.cost += more
        self.back.append(number)
        self.digests = [written(self.digests[rank].copy(), before[rank][0], block, role, text) for rank, block in self.known.moves[number]]

    def result(self, conv_id: int | None) -> tuple:
        ends = [(cost + INSERT_COST * len(ENDS[state]), rank, ENDS[state]) for rank, (state, cost) in enumerate(self.frontier)]
        cost, place, audit = min(ends)
        digest = written(self.digests[place], self.frontier[place][0], audit, "", "")
        letters = [audit]
        for number in self.back.backwards():
            place, block = self.known.moves[number][place]
            letters.append(block)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (conv_id, gaps, *self.faults[1:], self.illegal, self.cost + cost, "".join(reversed(letters)), digest.hexdigest())


def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a conversation; the input has each conversation's rows together and in order."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names, dtype=object)
        return out.astype({c: "Int64" for c in names[:-2]})

    known, at, open_ = Steps(), None, None
    for batch in batches:
        done: list[tuple] = []
        for conv, null, present, turn, no_turn, role, text, fault in zip(*[batch[c].tolist() for c in batch.columns], strict=True):
            if (conv, null) != at:
                if open_:
                    done.append(open_.result(None if at[1] else at[0]))
                at, open_ = (conv, null), Conversation(known)
            if present:
                open_.add(None if no_turn else turn, role, text, fault)
        if done:
            yield frame(done)
    if open_:
        yield frame([open_.result(None if at[1] else at[0])])


def judged(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, present: Column) -> DataFrame:
    """The rows with nulls filled and each row's first fault, partitioned by conversation."""
    space = F.lit(" ")
    filled = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                         F.when(present, F.coalesce(F.col(role), space)).otherwise("").alias("role"), F.when(present, F.coalesce(F.col(text), space)).otherwise("").alias("text"),
                         F.coalesce(present, F.lit(False)).alias("present"))
    dealt = filled.repartition("conv_id")  # the window below asks for less than this, so rows move once
    nth = F.row_number().over(W.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    end = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    fault = F.when(end == "", BLANK).when(nth > 1, DUPLICATE).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return dealt.withColumn("fault", fault)


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """Faults, cost, audit and digest of the repaired turns, a row a conversation.

    Rows whose ``present`` column is not true only name their conversation.
    """
    ready = judged(rows, conv_id, turn, role, text, F.lit(True) if present is None else F.col(present))
    ordered = ready.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    zero = F.lit(0).cast("long")
    sent = ordered.select(F.coalesce("conv_id", zero).alias("conv"), F.col("conv_id").isNull().alias("null"), "present", F.coalesce("turn", zero).alias("turn"),
                          F.col("turn").isNull().alias("no_turn"), "role", "text", "fault")
    return sent.mapInPandas(stream, RESULT)


def repaired_turns(rows: DataFrame, audits: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations of ``rows``, by the audits that ``repair`` gave for them."""
    space = F.lit(" ")
    filled = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"))
    nth = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    numbered = filled.select("conv_id", nth.alias("k"), "role", "text")
    letters = audits.select(F.col("conv_id").alias("of"), F.posexplode(F.split("audit", "")).alias("p", "letter")).where("letter <> ''")
    so_far = W.partitionBy("of").orderBy("p")
    edits = letters.select("of", "letter", F.count(F.when(F.col("letter") != "I", 1)).over(so_far).alias("nth"), F.count(F.when(F.col("letter") != "D", 1)).over(so_far).alias("position")).where("letter <> 'D'")
    on = F.col("of").eqNullSafe(F.col("conv_id")) & (F.col("nth") == F.col("k")) & (F.col("letter") != "I")
    placed = edits.join(numbered, on, "left").select("of", "letter", "position", "role", "text")
    first = F.first(F.when(F.col("letter") == "K", F.substring("role", 1, 1))).over(W.partitionBy("of").orderBy("position"))
    other = F.when((F.col("position") + F.when(first == "s", 1).otherwise(0)) % 2 == 1, "user").otherwise("assistant")
    return placed.select(F.col("of").alias("conv_id"), "position", F.when(F.col("letter") == "K", F.col("role")).otherwise(other).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with faults by the CRC-32 of ``conv_id:turn``, modulo 20; nulls are one space.

    0 drops the row (it stays, with ``present`` false), 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    how = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1)))
    return how.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("how") != 0).alias("present"), times.alias("_")).drop("_")


def repair_digests(rows: DataFrame) -> DataFrame:
    """The damaged conversations' faults, and their cheapest repair."""
    return repair(damaged(rows), present="present")
