"""Best-fit packing: documents into as few sequences of a fixed length as possible, by length patterns.

The plan is made from the histogram of piece lengths alone, which has at most `capacity` entries
however large the corpus is. Patterns of up to three lengths that fill a sequence are enumerated on
a grid; non-negative least squares gives each a repeat count so that together they reproduce the
histogram; the counts are rounded down to what there is. The rest is packed by best fit in
descending length, also into what the patterns leave free. All pieces of one length are alike, so
the plan works on groups of equal sequences and says which ranks of which length go where; the
pieces are then ranked within their length and looked up.

Cases: null and empty texts are one end token. Repeated rows are documents of their own. No
documents give no rows. Special tokens spelled out in a text are what the tokenizer makes of them.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchstone.llm.common import mapped, materialise, running_total, small_batches

CAPACITY = 4096
END = 1
GRID = 256
#: Words that are remembered, at some 150 bytes each; as many again are aside.
CACHE_WORDS = 100_000
#: Letters that every lower-casing treats alike, and marks.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
PIECES = "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT"
PLACES = "length BIGINT, low BIGINT, high BIGINT, per BIGINT, first_sequence BIGINT, first_offset BIGINT"


class WordEncoder(dict):
    """Ids of a text, as little-endian 32-bit numbers, from a tokenizer that drops white space and case.

    No token reaches over ASCII white space, so a text is the sequence of its words, and words
    recur. A plain word is looked up in lower case and without the marks at its end, which are tokens
    of their own. Letters do not depend on those beside them until tokens are made, so a plain word goes
    letter by letter through what the tokenizer does before, and then to its model alone: most of the time
    for a new word is spent before the model. A full memory is put aside and serves until the next one is
    full: words that recur stay. That changes no result.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        prepare, split = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = {ord(c): split(prepare(c))[0][0] for c in map(chr, range(256)) if PLAIN.fullmatch(c)}
        self.aside: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.aside = dict(self)
            self.clear()
        found = self.aside.get(word)
        if found is None:
            found = self.look_up(word.decode())
        self[word] = found
        return found

    def look_up(self, word: str) -> bytes:
        plain = PLAIN.fullmatch(word)
        if plain and (plain[2] or word != word.lower()):
            return self[plain[1].lower().encode()] + (self[plain[2].encode()] if plain[2] else b"")
        if plain:
            ids = [token.id for token in self.model.tokenize(word.translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split())) if isinstance(text, str) else b""


def cut(path: str, capacity: int = CAPACITY) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for mapInPandas: documents to their pieces."""
    end = np.array([END], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = memoryview(encoder.encode(text) + end)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def patterns(grid: int) -> np.ndarray:
    """All ways to fill `grid` units with one to three lengths: a column of multiplicities for each."""
    found = {(grid,)} | {(a, grid - a) for a in range(1, grid // 2 + 1)}
    found |= {(a, b, grid - a - b) for a in range(1, grid // 3 + 1) for b in range(a, (grid - a) // 2 + 1)}
    matrix = np.zeros((grid, len(found)))
    for column, lengths in enumerate(sorted(found)):
        for length in lengths:
            matrix[length - 1, column] += 1
    return matrix


def fit(matrix: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Non-negative least squares by active sets: non-negative x that brings matrix @ x nearest to wanted."""
    x = np.zeros(matrix.shape[1])
    active: list[int] = []
    floor = 1e-9 * max(1.0, np.abs(wanted).max())
    for _ in range(3 * matrix.shape[0]):
        gain = matrix.T @ (wanted - matrix @ x)
        gain[active] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= floor:
            break
        active.append(best)
        while active:
            part = matrix[:, active]
            solved = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(active)), part.T @ wanted)
            if solved.min() > 0:
                x[:] = 0
                x[active] = solved
                break
            now = x[active]
            shrinks = solved <= 0
            step = min(1.0, float((now[shrinks] / np.maximum(now[shrinks] - solved[shrinks], 1e-300)).min()))
            x[active] = now + step * (solved - now)
            gone = {a for a, s in zip(active, shrinks, strict=True) if s and x[a] <= floor}
            gone = gone or {active[int(solved.argmin())]}
            x[list(gone)] = 0
            active = [a for a in active if a not in gone]
    return x


def from_patterns(left: np.ndarray, capacity: int, grid: int) -> list[tuple[int, tuple]]:
    """Groups (number of equal sequences, ((length, times), ...)) from the fitted patterns; takes them off `left`."""
    unit = -(-capacity // grid)
    cell = (np.arange(1, capacity + 1) + unit - 1) // unit
    matrix = patterns(grid)
    counts = fit(matrix, np.bincount(cell, left, minlength=grid + 1)[1 : grid + 1])
    groups = []
    by_cell = {c: (np.flatnonzero(cell == c) + 1).tolist() for c in range(1, grid + 1)}

    def largest(c: int) -> int | None:
        while by_cell[c] and not left[by_cell[c][-1] - 1]:
            by_cell[c].pop()
        return by_cell[c][-1] if by_cell[c] else None

    for column in np.argsort(-counts, kind="stable"):
        repeats = int(counts[column])
        if not repeats:
            break
        cells = [c + 1 for c in np.flatnonzero(matrix[:, column]) for _ in range(int(matrix[c, column]))]
        while repeats:
            lengths = []
            for c in cells:
                length = largest(c)
                if length is None:
                    break
                lengths.append(length)
                left[length - 1] -= 1
            for length in lengths:
                left[length - 1] += 1
                if length not in by_cell[cell[length - 1]]:
                    insort(by_cell[cell[length - 1]], length)
            if len(lengths) < len(cells):
                break
            times = {length: lengths.count(length) for length in lengths}
            n = min(repeats, *(int(left[length - 1]) // t for length, t in times.items()))
            for length, t in times.items():
                left[length - 1] -= n * t
            groups.append((n, tuple(times.items())))
            repeats -= n
    return groups


def best_fit(left: np.ndarray, groups: list[tuple[int, tuple]], capacity: int) -> list[tuple[int, tuple]]:
    """Packs what is left in descending length, each piece where it leaves the least room; groups of equal sequences at once."""
    open_groups: dict[int, list] = {}
    rooms: list[int] = []

    def put(n: int, items: tuple, room: int) -> None:
        if room not in open_groups:
            open_groups[room] = []
            insort(rooms, room)
        open_groups[room].append((n, items))

    for n, items in groups:
        put(n, items, capacity - sum(length * t for length, t in items))
    for length in range(capacity, 0, -1):
        rest = int(left[length - 1])
        while rest:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                put(max(1, rest // (capacity // length)), (), capacity)
                continue
            room = rooms[at]
            n, items = open_groups[room].pop()
            if not open_groups[room]:
                del open_groups[room], rooms[at]
            fits = room // length
            full = min(n, rest // fits)
            if full:
                put(full, (*items, (length, fits)), room - fits * length)
                rest -= full * fits
            n -= full
            if n and rest:
                put(1, (*items, (length, rest)), room - rest * length)
                n, rest = n - 1, 0
            if n:
                put(n, items, room)
    return [(n, items) for room in rooms for n, items in open_groups[room] if items]


def places(histogram: dict[int, int], capacity: int = CAPACITY, grid: int = GRID) -> list[tuple[int, ...]]:
    """Rows (length, low, high, per, first_sequence, first_offset): ranks [low, high) of a length go `per` to a
    sequence, from first_sequence on, each sequence's from first_offset on."""
    left = np.zeros(capacity, dtype=np.int64)
    for length, n in histogram.items():
        left[length - 1] = n
    used = dict.fromkeys(histogram, 0)
    rows, sequence = [], 0
    for n, items in best_fit(left, from_patterns(left, capacity, min(grid, capacity)), capacity):
        offset = 0
        for length, t in items:
            rows.append((length, used[length], used[length] + n * t, t, sequence, offset))
            used[length] += n * t
            offset += length * t
        sequence += n
    return rows


def place_table(spark: SparkSession, rows: list[tuple[int, ...]]) -> DataFrame:
    """The rows as a table that goes to the JVM as Arrow: a list of rows would start Python workers of its own on the executors."""
    names = [column.split()[0] for column in PLACES.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)}))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The broadcast table of places depends on `capacity` alone: every length splits or opens only a
    few groups, so it has at most some tens of thousands of rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cut_up = mapped(docs.select("doc_id", "text"), cut(tokenizer, capacity), PIECES)
    pieces = materialise(cut_up, "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = place_table(spark, places(histogram, capacity))
    place = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(1 << 32))
    ranked = running_total(pieces, "length", place, [place, "doc_id", "piece"], F.lit(1), sum(histogram.values()))
    rank = F.col("before")
    found = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & rank.between(F.col("low"), F.col("high") - 1))
    past = rank - F.col("low")
    sequence = F.col("first_sequence") + F.expr("(before - low) div per")
    offset = F.col("first_offset") + (past % F.col("per")) * ranked["length"]
    return found.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset")
    )
