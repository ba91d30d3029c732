"""Line deduplication by winnowing over line hashes.

The lines of a document that hold words are its units. From every unit on, and up to every unit, the
fewest units that hold MIN_WORDS words together are a window. A window occurs again if the same lines
follow one another elsewhere. Every line of a repeated run of MIN_WORDS words or more lies in a window
that is inside the run, so matches need no extension to either side: what goes is the whole run. The smallest line hash of each window is its fingerprint, so equal windows share theirs,
and neighbouring windows mostly have the same one. Fingerprints are counted first; only for
those that occur at several places are the windows around them, to both sides, compared. A window is a
repeat if it occurs in an earlier document, or earlier in its own without touching it. Repeats that
overlap or follow one another make up a run; its lines, and empty lines within it, are deleted.

Documents are ordered by doc_id, null last, then by the hash of the text. What is deleted stays at its
first place.

Cases: a null text stays null and has no lines. Texts under MIN_WORDS words have no window and stay.
Lines are compared without the white space around them. Rows with the same doc_id and text are the
same document and are cut alike. No documents give no rows. A document that loses all lines stays,
with an empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchstone.llm.common import mapped, materialise, small_batches

MIN_WORDS = 50
LAST_ID = (1 << 63) - 1
MARKS = "doc BIGINT, mark BIGINT, print BIGINT, windows ARRAY<STRUCT<first: INT, last: INT, low: BIGINT, high: BIGINT>>"


def units(text: str) -> tuple[list[int], list[bytes], np.ndarray]:
    """Line numbers, stripped lines and word counts of the lines with words."""
    numbers, lines, counts = [], [], []
    for number, line in enumerate(text.encode().split(b"\n")):
        words = line.split()
        if words:
            numbers.append(number)
            lines.append(line.strip())
            counts.append(len(words))
    return numbers, lines, np.array(counts, dtype=np.int64)


def windows(counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last unit of every window; both only rise."""
    total = np.r_[0, np.cumsum(counts)]
    stop = np.searchsorted(total, total[:-1] + least)
    onward = np.flatnonzero(stop < len(total))
    upto = np.flatnonzero(total[1:] >= least)
    back = np.searchsorted(total, total[upto + 1] - least, side="right") - 1
    both = np.unique(np.c_[np.r_[onward, back], np.r_[stop[onward] - 1, upto]], axis=0)
    return both[:, 0], both[:, 1]


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def fingerprints(lines: list[bytes], counts: np.ndarray, least: int) -> Iterator[tuple[int, list[dict]]]:
    """The chosen line hashes, each with the windows that chose it."""
    first, last = windows(counts, least)
    hashes = [xxhash.xxh3_64_intdigest(line) for line in lines]
    held: list[dict] = []
    place, previous = -1, None
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if place < a:
            place = min(range(a, b + 1), key=lambda i: (hashes[i], i))
        else:
            place = min((place, *range(previous + 1, b + 1)), key=lambda i: (hashes[i], i))
        digest = xxhash.xxh3_128_digest(b"\n".join(lines[a : b + 1]))
        low, high = np.frombuffer(digest, np.int64).tolist()
        if held and held_place != place:
            yield signed(hashes[held_place]), held
            held = []
        held_place, previous = place, b
        held.append({"first": a, "last": b, "low": low, "high": high})
    if held:
        yield signed(hashes[held_place]), held


def marks(least: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, mark, text in zip(batch["doc"], batch["mark"], batch["text"], strict=True):
                if isinstance(text, str):
                    _, lines, counts = units(text)
                    rows += [(doc, mark, p, held) for p, held in fingerprints(lines, counts, least)]
            yield pd.DataFrame(rows, columns=["doc", "mark", "print", "windows"])

    return run


def kept_lines(text: str, found: list[tuple[int, int]]) -> tuple[list[str], int]:
    """The lines that stay, and the number of runs deleted; found: first and last unit of each repeat."""
    lines, numbers = text.split("\n"), units(text)[0]
    gone = np.zeros(len(lines), dtype=bool)
    covered = np.zeros(len(numbers) + 1, dtype=bool)
    for first, last in found:
        covered[first : last + 1] = True
    edges = np.flatnonzero(np.diff(np.r_[False, covered].astype(np.int8)))
    for first, stop in zip(edges[::2], edges[1::2], strict=True):
        gone[numbers[first] : numbers[stop - 1] + 1] = True
    return [line for line, g in zip(lines, gone, strict=True) if not g], len(edges) // 2


def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, found in zip(batch["text"], batch["found"], strict=True):
            if not isinstance(text, str):
                rows.append((None, 0, 0, 0, hashlib.sha256(b"").hexdigest()))
                continue
            repeats = [(f["first"], f["last"]) for f in found] if found is not None else []
            lines, runs = kept_lines(text, repeats) if repeats else (text.split("\n"), 0)
            left, before = "\n".join(lines), text.count("\n") + 1
            rows.append((left, before, before - len(lines), runs, hashlib.sha256(left.encode()).hexdigest()))
        out = pd.DataFrame(rows, columns=["kept", "n_lines", "n_removed", "n_runs", "kept_sha256"])
        yield pd.concat([batch.drop(columns=["text", "found"]).reset_index(drop=True), out], axis=1)


def deduplicate(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Per document: doc_id, lang, source, kept (the text that stays), n_lines, n_removed, n_runs, kept_sha256."""
    small_batches(docs.sparkSession)
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.select(
        "doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), mark.alias("mark"), "text", "lang", "source"
    )
    prints = materialise(texts.select("doc", "mark", "text").mapInPandas(marks(least), MARKS), "line-prints")
    # What is joined to hot fingerprints and windows is written first, so that adaptive execution can split them.
    several = materialise(prints.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print"), "line-several")
    around = materialise(prints.join(several, "print").select("doc", "mark", F.inline("windows")), "line-windows")
    origin = around.groupBy("low", "high").agg(
        F.count("*").alias("n"), F.min(F.struct("doc", "mark", "first", "last")).alias("origin")
    ).filter("n > 1")
    origin = materialise(origin, "line-origins")
    elsewhere = (F.col("doc") != F.col("origin.doc")) | (F.col("mark") != F.col("origin.mark"))
    later = around.join(origin.select("low", "high", "origin"), ["low", "high"]).filter(
        elsewhere | (F.col("first") > F.col("origin.last"))
    )
    found = later.groupBy("doc", "mark").agg(F.collect_set(F.struct("first", "last")).alias("found"))
    schema = "doc_id BIGINT, lang STRING, source STRING, kept STRING, n_lines BIGINT, n_removed BIGINT, n_runs BIGINT, kept_sha256 STRING"
    joined = texts.join(found, ["doc", "mark"], "left").select("doc_id", "lang", "source", "text", "found")
    return mapped(joined, cut, schema)
