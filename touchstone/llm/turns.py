"""Repair of conversations: the cheapest edits that make the roles alternate.

The turns of a conversation become `(system? (user assistant)+)?` by keeping a turn (0), giving it the
role user or assistant (1), deleting it (2) or putting in an empty user or assistant turn (5). A blank
turn and one whose role and text came earlier must be deleted; a turn that breaks off costs 5 more
unless it is deleted. Of the cheapest edits those are taken whose initials, in order, sort first.

The method is Wagner-Fischer against every feasible length of the alternating string. The last r
symbols of all these targets are the same, so one table from the end, over turns and remaining
symbols, serves all lengths. A quick alignment gives the incumbent cost; only cells that a cheaper
alignment can pass are filled (Ukkonen's band). The alignments of all lengths that reach the least
cost are then traced in step, and the smallest next initial decides which go on. Of long tables only
every so many rows are kept and the others filled again, so memory grows with the band times the
square root of the turns.

A conversation is one unit of work, because its audit and its repaired text are one value each. Rows
are spread by conversation and sorted by Spark, which spills; a task holds the turns of one
conversation at a time, and of turns that must go only one byte.

Cases: turns are in the order of `turn` (null first), then role, then text. A null role or text is one
space. Rows with a null conv_id are one conversation. Repeated rows are duplicate turns. A
conversation without turns that can stay becomes empty. No rows give no rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, BREAKS_OFF = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LEGAL = {"su", "ua", "au"}
NEVER = np.int64(1 << 60)
#: Cells of a table that are kept as they are; of a larger one, only some rows.
CELLS = 1 << 20
#: Bytes of rows that go to Spark together.
SHIPPED = 4 << 20

SCHEMA = pa.schema(
    [("conv_id", pa.int64())]
    + [(name, pa.int64()) for name in ("n_turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
)
RESULT = (
    "conv_id BIGINT, n_turns BIGINT, gaps BIGINT, blank BIGINT, duplicate BIGINT, truncated BIGINT, illegal BIGINT, "
    "cost BIGINT, audit STRING, repaired ARRAY<STRUCT<role: STRING, text: STRING>>"
)


def moved_down(row: np.ndarray, last: int) -> np.ndarray:
    out = np.empty_like(row)
    out[:-1], out[-1] = row[1:], last
    return out


def moved_up(row: np.ndarray, first: int) -> np.ndarray:
    out = np.empty_like(row)
    out[1:], out[0] = row[:-1], first
    return out


@dataclass
class Alignment:
    """Turns that may stay, by initial and by whether they break off, against the alternating string.

    `left[i, d]` is the least cost of the turns from i on with r symbols left, r = d + (turns left) - below.
    """

    initials: np.ndarray
    broken: np.ndarray
    kept: dict[int, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.n = len(self.initials)
        self.bound = self.incumbent()
        if not self.bound:  # nothing is cheaper
            return
        self.below, above = self.bound // DELETE, self.bound // INSERT
        self.width = self.below + above + 1
        self.step = 1 if (self.n + 1) * self.width <= CELLS else max(1, isqrt(self.n))
        self.offsets = np.arange(self.width)
        self.ramp = INSERT * self.offsets
        self.fitting = {
            (initial, odd): np.where((self.offsets + odd) % 2 == 0, REROLE * (initial != "u"), REROLE * (initial != "a"))
            for initial in "ua " for odd in (0, 1)
        }
        self.systems = self.initials == ord("s")
        self.names = ["u" if c == ord("u") else "a" if c == ord("a") else " " for c in self.initials.tolist()]
        row = np.where(self.symbols(self.n) >= 0, INSERT * self.symbols(self.n), NEVER)
        self.kept[self.n] = row
        self.opening = np.full(self.n + 1, NEVER)  # least cost from a turn on, if the system turn is yet to come
        some = self.systems.any()
        for i in range(self.n - 1, -1, -1):
            later, row = row, self.row_before(i, row)
            if i % self.step == 0:
                self.kept[i] = row
            if some:
                ahead = self.opening[i + 1] + DELETE
                if self.systems[i]:
                    ahead = min(ahead, self.follow_system(i, later).min())
                self.opening[i] = min(ahead, NEVER)
        self.block: dict[int, np.ndarray] = {}

    def symbols(self, i: int) -> np.ndarray:
        """Symbols left for each cell of a row."""
        return self.offsets + (self.n - i) - self.below

    def incumbent(self) -> int:
        """The cost of keeping all turns with the roles in turn, the last one deleted if it is one too many."""
        first = int(self.n > 2 and self.initials[0] == ord("s"))
        rest = self.initials[first:]
        cost = REROLE * int((rest[::2] != ord("u")).sum() + (rest[1::2] != ord("a")).sum())
        cost += BREAKS_OFF * int(self.broken.sum()) + (DELETE if len(rest) % 2 else 0)
        return min(cost, DELETE * self.n)

    def stays(self, i: int) -> np.ndarray:
        """What it costs, for each cell, that the turn takes the first symbol that is left."""
        fitting = self.fitting[self.names[i], (self.n - i - self.below) % 2]
        return fitting + BREAKS_OFF if self.broken[i] else fitting

    def row_before(self, i: int, later: np.ndarray) -> np.ndarray:
        """A row from the next one; cells with fewer than no symbols left cost too much in both."""
        row = later + self.stays(i)
        np.minimum(row[:-1], later[1:] + DELETE, out=row[:-1])
        row = np.minimum.accumulate(row - self.ramp) + self.ramp
        return np.minimum(row, NEVER, out=row)

    def follow_system(self, i: int, later: np.ndarray) -> np.ndarray:
        """Costs of turn i as the system turn, for each cell of the next row."""
        left = self.symbols(i + 1)
        return np.where((left >= 2) & (left % 2 == 0), later + BREAKS_OFF * int(self.broken[i]), NEVER)

    def row(self, i: int) -> np.ndarray:
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            end = min(self.n, (i // self.step + 1) * self.step)
            row, self.block = self.kept[end], {}
            for k in range(end - 1, i - i % self.step, -1):
                row = self.block[k] = self.row_before(k, row)
        return self.block[i]

    def least(self) -> tuple[int, np.ndarray, bool]:
        """The least cost, the cells of lengths that reach it, and whether a system turn does."""
        first, left = self.row(0), self.symbols(0)
        closed = np.where((left >= 0) & (left % 2 == 0), first, NEVER)
        cost = min(int(closed.min()), int(self.opening[0]))
        return cost, closed == cost, int(self.opening[0]) == cost

    def trace(self) -> tuple[int, bytes]:
        """The least cost and the initials of its edits that sort first, all lengths in step."""
        if not self.bound:
            return 0, b"K" * self.n
        cost, alive, opening = self.least()
        rest, i, out = cost, 0, bytearray()
        while True:
            if i == self.n:
                if (alive & (self.symbols(i) == 0)).any():
                    return cost, bytes(out)
                alive = moved_down(alive, False)
                rest -= INSERT
                out += b"I"
                continue
            later = self.row(i + 1)
            gone = alive & (moved_down(later, NEVER) == rest - DELETE)
            waits = opening and int(self.opening[i + 1]) + DELETE == rest
            if gone.any() or waits:
                alive, opening, rest = moved_up(gone, False), waits, rest - DELETE
                i += 1
                out += b"D"
                continue
            put = alive & (moved_up(self.row(i), NEVER) == rest - INSERT) & (self.symbols(i) > 0)
            if put.any():
                alive, opening, rest = moved_down(put, False), False, rest - INSERT
                out += b"I"
                continue
            stays = self.stays(i)
            match = alive & (later + stays == rest)
            surplus = BREAKS_OFF * int(self.broken[i])
            kept = match & (stays == surplus)
            if opening and self.systems[i]:
                kept |= self.follow_system(i, later) == rest
            if kept.any():
                alive, rest = kept, rest - surplus
                out += b"K"
            else:
                alive, rest = match, rest - surplus - REROLE
                out += b"R"
            opening = False
            i += 1


class Conversation:
    """The turns of one conversation, in order."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.seen: set[bytes] = set()
        self.forced = bytearray()  # one byte a turn: whether it must go
        self.stay: list[tuple[str, str, bool]] = []  # role, text, breaks off
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.last: str | None = None
        self.low = self.high = self.turn = None
        self.places = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.places += 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.last = initial
        body = text.rstrip(SPACE)
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        fault = None
        if not body:
            fault = "blank"
        elif key in self.seen:
            fault = "duplicate"
        elif not body.endswith(ENDS):
            fault = "truncated"
        self.seen.add(key)
        if fault:
            self.counts[fault] += 1
        must_go = fault in ("blank", "duplicate")
        self.forced.append(must_go)
        if not must_go:
            self.stay.append((role, text, fault == "truncated"))

    def repaired(self) -> dict:
        initials = np.array([ord(role[0]) if role else 0 for role, _, _ in self.stay], np.int64)
        broken = np.array([b for _, _, b in self.stay], bool)
        cost, edits = Alignment(initials, broken).trace()
        audit, turns, at = bytearray(), [], 0
        staying, place = iter(self.stay), 0
        for must_go in self.forced:
            if must_go:
                audit += b"D"
                continue
            while edits[at : at + 1] == b"I":
                place, at = self.insert(turns, audit, place), at + 1
            (role, text, _), edit = next(staying), edits[at : at + 1]
            at += 1
            audit += edit
            if edit == b"K" and not turns and role[:1] == "s":
                turns.append({"role": role, "text": text})
            elif edit != b"D":
                turns.append({"role": role if edit == b"K" else ("user", "assistant")[place % 2], "text": text})
                place += 1
        while at < len(edits):
            place, at = self.insert(turns, audit, place), at + 1
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.places, (1 << 63) - 1)
        return {
            "conv_id": self.conv_id, "n_turns": len(self.forced), "gaps": gaps, **self.counts,
            "cost": cost + DELETE * sum(self.forced), "audit": audit.decode(), "repaired": turns,
        }

    @staticmethod
    def insert(turns: list, audit: bytearray, place: int) -> int:
        turns.append({"role": ("user", "assistant")[place % 2], "text": ""})
        audit += b"I"
        return place + 1


def repair_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: rows of conversations in order to repaired conversations."""
    current: Conversation | None = None
    done: list[dict] = []
    size = 0
    for batch in batches:
        for conv_id, turn, role, text in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            if current is None or conv_id != current.conv_id:
                if current is not None:
                    done.append(current.repaired())
                current = Conversation(conv_id)
            current.add(turn, role, text)
            size += len(text)
            if size > SHIPPED and done:
                yield pa.RecordBatch.from_pylist(done, SCHEMA)
                done, size = [], 0
    if current is not None:
        done.append(current.repaired())
    if done:
        yield pa.RecordBatch.from_pylist(done, SCHEMA)


def present(column: str) -> Column:
    """A value as text; a missing one is a space."""
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def repair(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_turns, gaps, the counts of faults, cost, audit, and the repaired turns.

    Spark spreads the rows by conversation and sorts them.
    """
    ids = [F.col(name).cast("bigint").alias(name) for name in ("conv_id", "turn")]
    rows = turns.select(*ids, present("role").alias("role"), present("text").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(repair_sorted, RESULT)


def damage(turns: DataFrame) -> DataFrame:
    """Rows with faults put in, by the CRC-32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2
    takes its sentence ends away, 3 repeats it, 4 makes it the user's."""
    kind = F.crc32(F.concat(present("conv_id"), F.lit(":"), present("turn"))) % 20
    endless = F.regexp_replace(present("text"), "[.!?]", "")
    text = F.when(kind == 1, "").when(kind == 2, endless).otherwise(present("text"))
    role = F.when(kind == 4, "user").otherwise(present("role"))
    copies = F.array_repeat(F.lit(1), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("one")).drop("one")


def report(turns: DataFrame) -> DataFrame:
    """Per conversation of the undamaged table: what the repair of its damaged rows found, with the digest of the result.

    A conversation that lost all rows has zeros, an empty audit and the digest of an empty text.
    """
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    found = repair(damage(turns)).select(
        F.col("conv_id").alias("damaged_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.sha2(text, 256).alias("repaired_sha256"),
    )
    every = turns.select(F.col("conv_id").cast("bigint")).distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("damaged_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
