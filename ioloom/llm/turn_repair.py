"""Conversation structure repair: the cheapest edits that make roles alternate, by secondary-sorted streaming.

Rows are repartitioned by conversation once. Within a partition Spark sorts them backwards by turn; mapInPandas walks them
and carries the cost of finishing from each of four states across Arrow batches. Each row leaves with one byte of
backpointers, two bits a state. Spark's sorter turns the rows round, and a second mapInPandas walks them forwards along the
backpointers. What a giant conversation needs to remember thus lies in rows that the sorter spills, not in a task's memory; a
task holds one state vector, one hash and the audit that it is about to return.

Edits: Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert of an empty user or assistant turn 3; a truncated row
that stays adds 3; blank and duplicate rows must go. The roles' initials have to give (s?(ua)+)?. An audit fixes the
roles of what it leaves, so the least letter that is on a cheapest way, row by row, is the least audit.

Defined results: a null role or text is one space; null turns come first; equal turns are ordered by role, then text; null
ids are one conversation; an empty role has no initial, so it cannot stay; rows repeated in full are duplicates of the first; a conversation without rows has zeros, an empty audit and
the hash of the empty string; empty texts are blank; very long texts are read whole; an empty table gives no rows; columns
other than those named are ignored, whatever their names. One conversation is one task's stream, as long as it may be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn. The first and last may end.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Letters of an audit in ASCII order; a backpointer is a place in this list.
LETTERS = "DIKR"
#: Space and the five control characters that don't count as text.
BLANKS = " \t\n\x0b\x0c\r"
ENDINGS = (".", "!", "?")
#: Faults of a row, the first that applies; LOST marks rows that damage() dropped.
SOUND, BLANK, DUPLICATE, TRUNCATED, LOST = range(5)


def _turned(state: int) -> int:
    """The state after a user or assistant turn, whichever is due."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: str) -> int | None:
    """The state after a row that stays as it is, if its role is due."""
    if initial == "s":
        return SYSTEM if state == EMPTY else None
    return _turned(state) if initial == ("a" if state == USER else "u") else None


def _with_inserts(costs: list[int]) -> list[int]:
    """The costs of finishing if turns may be inserted first; two inserts lead from any state to any that it can reach."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[_turned(q)]) for q, c in enumerate(costs)]
    return costs


#: The costs of finishing after the last row.
AT_END = tuple(_with_inserts([0, 1 << 20, 1 << 20, 0]))


@lru_cache(maxsize=4096)
def step_back(after: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int]:
    """The costs of finishing before a row, less their least, and the row's backpointers; after: those behind it, less their least."""
    extra = CUT if fault == TRUNCATED else 0
    ways: list[dict[str, int]] = []
    for q in range(4):
        way = {"D": DELETE + after[q]}
        if fault not in (BLANK, DUPLICATE):
            way["R"] = REROLE + extra + after[_turned(q)]
            if (then := _kept(q, initial)) is not None:
                way["K"] = KEEP + extra + after[then]
        ways.append(way)
    before = _with_inserts([min(w.values()) for w in ways])
    byte = 0
    for q, way in enumerate(ways):
        way["I"] = INSERT + before[_turned(q)]
        letter = next(x for x in LETTERS if way.get(x) == before[q])
        byte |= LETTERS.index(letter) << 2 * q
    least = min(before)
    return tuple(c - least for c in before), byte


def walk(state: int, byte: int, initial: str) -> tuple[int, str]:
    """The state after a row and the letters spent on it."""
    said = ""
    while True:
        letter = LETTERS[byte >> 2 * state & 3]
        said += letter
        if letter == "D":
            return state, said
        then = _kept(state, initial) if letter == "K" else _turned(state)
        state = then
        if letter != "I":
            return state, said


def _backwards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the backpointers of rows that come last turn first."""
    key, costs = None, AT_END
    for frame in frames:
        out = bytearray()
        for known, k, role, fault in zip(frame["known"], frame["k"], frame["role"], frame["fault"], strict=True):
            if (known, k) != key:
                key, costs = (known, k), AT_END
            byte = 0
            if fault != LOST:
                costs, byte = step_back(costs, role[:1], fault)
            out.append(byte)
        yield frame.assign(back=pd.array(out, dtype="int32"))


class _Repair:
    """What is known of a conversation while its rows pass in order."""

    def __init__(self, key: tuple[int, str]):
        self.key, self.state, self.audit, self.hash, self.any = key, EMPTY, [], hashlib.sha256(), False
        self.faults, self.illegal, self.cost, self.last_initial = [0] * 5, 0, 0, None
        self.first, self.last, self.turns = None, None, 0

    def say(self, role: str, text: str) -> None:
        self.hash.update(f"{'\n' if self.any else ''}{role}:{text}".encode())
        self.any = True

    def due(self) -> str:
        return "assistant" if self.state == USER else "user"

    def insert(self) -> None:
        self.say(self.due(), "")
        self.state, self.cost = _turned(self.state), self.cost + INSERT

    def row(self, turn: int, turn_known: int, role: str, text: str, fault: int, byte: int) -> None:
        if fault == LOST:
            return
        if turn_known and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        initial = role[:1]
        if self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = initial
        self.faults[fault] += 1
        _, said = walk(self.state, byte, initial)
        self.audit.append(said)
        for _ in said[:-1]:
            self.insert()
        if said[-1] == "D":
            self.cost += DELETE
            return
        kept = said[-1] == "K"
        self.say(role if kept else self.due(), text)
        self.cost += (KEEP if kept else REROLE) + (CUT if fault == TRUNCATED else 0)
        self.state = _kept(self.state, initial) if kept else _turned(self.state)

    def result(self) -> tuple:
        while self.state in (SYSTEM, USER):
            self.audit.append("I")
            self.insert()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (*self.key, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


RESULT = {"known": "int", "k": "string", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"}


def _forwards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a conversation from rows in order, the conversation at hand being carried across batches."""
    now = None
    for frame in frames:
        done = []
        for known, k, *row in zip(*(frame[c] for c in ("known", "k", "turn", "turn_known", "role", "text", "fault", "back")), strict=True):
            if now is None or now.key != (known, k):
                if now is not None:
                    done.append(now.result())
                now = _Repair((known, k))
            now.row(*row)
        yield pd.DataFrame(done, columns=list(RESULT))
    if now is not None:
        yield pd.DataFrame([now.result()], columns=list(RESULT))


def damage(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with the faults that crc32(`conv_id:turn`) % 20 names: 0 drops a row, 1 empties its
    text, 2 takes .!? out of it, 3 repeats the row, 4 makes it a user's. Nulls are one space. Adds lost, true for dropped rows."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("said", "[.!?]", "")).otherwise(F.col("said"))
    rows = turns.select("conv_id", "turn", space("role").alias("by"), space("text").alias("said"), what.alias("what"))
    rows = rows.select("conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("by")).alias("role"), text.alias("text"), (F.col("what") == 0).alias("lost"), F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.select("conv_id", "turn", "role", F.when(~F.col("lost"), F.col("text")).otherwise("").alias("text"), "lost")


def repair(turns: DataFrame) -> DataFrame:
    """One row a conversation of turns (conv_id, turn, role, text, and lost, if it is there): conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lost = F.col("lost") if "lost" in turns.columns else F.lit(False)
    kind = turns.schema["conv_id"].dataType
    rows = turns.select(
        F.col("conv_id").isNotNull().cast("int").alias("known"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("k"), F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
        F.col("turn").isNotNull().cast("int").alias("turn_known"), space("role").alias("role"), space("text").alias("text"), lost.alias("lost")
    )
    key, order = ["known", "k"], ["turn_known", "turn", "role", "text", "nth"]
    # The partitioning by conversation serves both sorts and the window as well.
    same = Window.partitionBy(*key, "lost", F.sha2(F.concat_ws("\0", "role", "text").cast("binary"), 256), "role").orderBy("turn_known", "turn")
    end = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(F.col("lost"), LOST).when(end == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.right(end, F.lit(1)).isin(*ENDINGS), TRUNCATED).otherwise(SOUND)
    rows = rows.repartition(*key).withColumn("nth", F.row_number().over(same)).select(*key, *order, fault.alias("fault"))
    back = rows.sortWithinPartitions(*key, *[F.desc(c) for c in order]).mapInPandas(_backwards, "known int, k string, turn_known int, turn bigint, role string, text string, nth int, fault int, back int")
    out = back.sortWithinPartitions(*key, *order).mapInPandas(_forwards, ", ".join(f"{c} {t}" for c, t in RESULT.items()))
    return out.select(F.when(F.col("known") == 1, F.col("k").cast(kind)).alias("conv_id"), *list(RESULT)[2:])
