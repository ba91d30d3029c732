"""Exact removal of repeated byte strings, with suffix arrays over what can repeat.

A string of WIDTH bytes that starts at two places has the same smallest gram at both, so all strings
are dealt by theirs: the anchor. The strings of one anchor at one place are consecutive; the bytes
they span are its segment, and its place in the segment lines segments of equal anchors up.

* An anchor that occurs once repeats nothing. Segments that are equal as a whole repeat as a whole;
  digests settle that. Both are counts by key.
* What is left are anchors with different segments, the ends of repeated runs. One segment of each
  kind is cut into cells of CELL bytes, counted from the anchor. The suffix array of the cells of a
  block of segments brings equal strings together: any string of WIDTH bytes begins less than one
  cell before at least SHARED whole cells, and suffixes with so many equal cells are neighbours.
  Within such a run of neighbours, the strings themselves are compared.
* A block holds a bounded number of segments. An anchor with more of them is spread over several
  blocks; each block then hands on one of each string of it, and these are matched by digest.

Matches never cross documents, and strings are judged on the input.

Cases: null texts are empty, texts shorter than WIDTH have no string. Repeated rows are documents of
their own and repeat each other. No documents give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchstone.llm.common import mapped, materialise, small_batches
from touchstone.llm.grouping import suffix_array

WIDTH, GRAM, CELL = 200, 24, 16
SHARED = (WIDTH - CELL + 1) // CELL
SLICE = 1 << 19
#: Enough for a place in what `stretches` yields, which is less than two slices and a string.
PLACE_BITS = np.uint64(21)
#: Segments of a block, and of one anchor in a block.
BLOCK_SEGMENTS, ANCHOR_SEGMENTS = 2048, 32_768
NO_ID = -(1 << 63)
SEGMENTS = "doc BIGINT, mark INT, anchor BIGINT, digest BIGINT, off BIGINT, lead INT, strings INT"
CUT = "doc BIGINT, mark INT, off BIGINT, anchor BIGINT, digest BIGINT, lead INT, bytes BINARY"
FOUND = "doc BIGINT, mark INT, start BIGINT, stop BIGINT, low BIGINT, high BIGINT, known BOOLEAN"


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.hash(text).alias("mark"), text.alias("text"))


def packed(texts: DataFrame) -> DataFrame:
    """The keyed documents with compressed texts, for the shuffles that bring a text to what is known of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = [pack.compress(t.encode()) for t in batch["text"]]
            yield batch.drop(columns="text").assign(packed=data)

    return mapped(texts, run, "doc_id BIGINT, doc BIGINT, mark INT, packed BINARY")


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def byte_values() -> np.ndarray:
    """A random odd-looking 64-bit number for every byte."""
    return np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each place; what reaches over the end is left out."""
    base, total = 0x9E3779B97F4A7C15, 1 << 64
    part, length = values[data], 1
    out, covered = None, 0
    while covered < GRAM:
        if GRAM & length:
            if out is None:
                out, covered = part, length
            else:
                n = min(len(out), len(part) - covered)
                out = out[: max(0, n)] * np.uint64(pow(base, length, total)) + part[covered : covered + max(0, n)]
                covered += length
        part = part[:-length] * np.uint64(pow(base, length, total)) + part[length:] if len(part) > length else part[:0]
        length *= 2
    out = out ^ (out >> np.uint64(32))
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each `width` hashes in a row, the first of equals; the leading bits are compared."""
    keys = (hashes >> PLACE_BITS << PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        keys = np.minimum(keys[:-step], keys[step:])
        covered += step
    return (keys & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)


def stretches(raw: list[bytes]) -> Iterator[list[tuple[int, int, int]]]:
    """(document, from, to) in portions of about SLICE bytes; long documents in stretches that overlap by a string."""
    portion, size = [], 0
    for i, data in enumerate(raw):
        for at in range(0, max(1, len(data) - WIDTH + 1), SLICE):
            stop = min(len(data), at + SLICE + WIDTH - 1)
            if stop - at >= WIDTH:
                portion.append((i, at, stop))
                size += stop - at
            if size >= SLICE:
                yield portion
                portion, size = [], 0
    if portion:
        yield portion


def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    values, grams = byte_values(), WIDTH - GRAM + 1
    for batch in batches:
        raw = [t.encode() for t in batch["text"]]
        doc, mark = batch["doc"].to_numpy(), batch["mark"].to_numpy()
        for portion in stretches(raw):
            joined = b"".join(raw[i][a:b] for i, a, b in portion)
            lengths = np.array([b - a for _, a, b in portion])
            begins = np.r_[0, np.cumsum(lengths)[:-1]]
            hashes = gram_hashes(np.frombuffer(joined, np.uint8), values)
            chosen = window_minima(hashes, grams)
            owner = np.repeat(np.arange(len(portion)), lengths)[: len(chosen)]
            valid = np.arange(len(chosen)) + WIDTH <= (begins + lengths)[owner]
            at = np.flatnonzero(valid)
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = (chosen[at[1:]] != chosen[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
            heads = np.flatnonzero(fresh)
            first, strings = at[heads], np.diff(np.r_[heads, len(at)])
            anchor, who = chosen[first], owner[first]
            lead = anchor - first
            digest = [
                xxhash.xxh3_64_intdigest(joined[f : f + s + WIDTH - 1], k)
                for f, s, k in zip(first.tolist(), strings.tolist(), lead.tolist(), strict=True)
            ]
            rows = np.array([i for i, _, _ in portion])[who]
            yield pd.DataFrame(
                {
                    "doc": doc[rows], "mark": mark[rows], "anchor": hashes[anchor].view(np.int64),
                    "digest": np.array(digest, dtype=np.uint64).view(np.int64),
                    "off": first - begins[who] + np.array([a for _, a, _ in portion])[who],
                    "lead": lead.astype(np.int32), "strings": strings.astype(np.int32),
                }
            )


def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the wanted segments of each document."""
    for batch in batches:
        rows = []
        for doc, mark, text, wanted in zip(batch["doc"], batch["mark"], batch["packed"], batch["wanted"], strict=True):
            data = unpacked(text)
            rows += [
                (doc, mark, w["off"], w["anchor"], w["digest"], w["lead"], data[w["off"] : w["off"] + w["strings"] + WIDTH - 1])
                for w in wanted
            ]
        yield pd.DataFrame(rows, columns=["doc", "mark", "off", "anchor", "digest", "lead", "bytes"])


def alike(pieces: list[bytes], leads: list[int]) -> Iterator[list[tuple[int, int]]]:
    """Runs of (segment, place of a cell) that share at least SHARED cells with each neighbour in the suffix array."""
    symbols: dict[bytes, int] = {}
    text, where = [], []
    for n, (data, lead) in enumerate(zip(pieces, leads, strict=True)):
        for at in range(lead % CELL, len(data) - CELL + 1, CELL):
            text.append(symbols.setdefault(data[at : at + CELL], len(symbols)))
            where.append((n, at))
        text.append(-1 - n)  # ends every suffix of the segment, unlike any other
        where.append((n, -1))
    run: list[int] = []
    previous = None
    for suffix in suffix_array(text):
        head = text[suffix : suffix + SHARED]
        if len(head) == SHARED and min(head) >= 0:
            if head == previous:
                run.append(suffix)
                continue
            if len(run) > 1:
                yield [where[s] for s in run]
            run, previous = [suffix], head
    if len(run) > 1:
        yield [where[s] for s in run]


def repeated(pieces: list[bytes], leads: list[int], anchors: list[int]) -> list[np.ndarray]:
    """For each segment, which of its strings also occur in another segment of the block."""
    marks = [np.zeros(len(p) - WIDTH + 1, dtype=bool) for p in pieces]
    for run in alike(pieces, leads):
        seen: dict[tuple, list[tuple[int, int]]] = {}
        for n, cell in run:
            for at in range(max(0, cell - CELL + 1), min(cell, len(pieces[n]) - WIDTH) + 1):
                seen.setdefault((anchors[n], pieces[n][at : at + WIDTH]), []).append((n, at))
        for places in seen.values():
            if len(places) > 1:
                for n, at in places:
                    marks[n][at] = True
    return marks


def spans(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, marks, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def match_block(block: pd.DataFrame) -> pd.DataFrame:
    """Spans of repeated strings, and for spread anchors one of each string with its digest (low, high)."""
    pieces, leads = block["bytes"].tolist(), block["lead"].tolist()
    marks = repeated(pieces, leads, block["anchor"].tolist())
    rows = []
    handed: set[bytes] = set()
    for n, (doc, mark, off, spread) in enumerate(zip(block["doc"], block["mark"], block["off"], block["spread"], strict=True)):
        rows += [(doc, mark, off + a, off + b - 1 + WIDTH, 0, 0, True) for a, b in spans(marks[n])]
        if not spread:
            continue
        for at in range(len(pieces[n]) - WIDTH + 1):
            digest = xxhash.xxh3_128_digest(pieces[n][at : at + WIDTH])
            if digest in handed:
                continue
            handed.add(digest)
            low, high = np.frombuffer(digest, np.int64).tolist()
            rows.append((doc, mark, off + at, off + at + WIDTH, low, high, bool(marks[n][at])))
    return pd.DataFrame(rows, columns=["doc", "mark", "start", "stop", "low", "high", "known"])


def taken_out(with_text: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(batch["doc_id"], batch["packed"], batch["found"], strict=True):
                data, kept, end, n_spans = unpacked(text), [], 0, 0
                last = -1
                for start, stop in sorted((f["start"], f["stop"]) for f in found) if found is not None else ():
                    if start > last:
                        kept.append(data[max(end, 0) : start])
                        n_spans += 1
                    last = max(last, stop)
                    end = last
                kept.append(data[end:])
                left = b"".join(kept)
                row = (doc_id, len(data), len(data) - len(left), n_spans, hashlib.sha256(left).hexdigest())
                rows.append((*row, left.decode(errors="ignore")) if with_text else row)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
            yield pd.DataFrame(rows, columns=names)

    return run


def ends_of_runs(texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """Repeated strings of segments that share their anchor but differ: doc, mark, start, stop."""
    per_anchor = kinds.groupBy("anchor").agg(F.count("*").alias("n_kinds"))
    blocks = max(1, -(-kinds.count() // BLOCK_SEGMENTS))
    salts = F.ceil(F.col("n_kinds") / ANCHOR_SEGMENTS)
    dealt = kinds.join(per_anchor, "anchor").select(
        "anchor", "digest", "rep.*", (salts > 1).alias("spread"), F.pmod("digest", salts).alias("salt")
    )
    wanted = dealt.groupBy("doc", "mark").agg(F.collect_list(F.struct("anchor", "digest", "off", "lead", "strings")).alias("wanted"))
    pieces = packed(texts).join(wanted, ["doc", "mark"]).select("doc", "mark", "packed", "wanted").mapInPandas(cut_out, CUT)
    block = F.pmod(F.xxhash64("anchor", "salt"), F.lit(blocks)).alias("block")
    placed = dealt.select("anchor", "digest", "spread", block)
    matched = pieces.join(placed, ["anchor", "digest"]).groupBy("block").applyInPandas(match_block, FOUND)
    return matched


def repeats(docs: DataFrame) -> DataFrame:
    """The documents keyed and packed, with `found`: (start, stop) in bytes of what repeats, unordered and overlapping."""
    small_batches(docs.sparkSession)
    texts = keyed(docs)
    parts = materialise(texts.select("doc", "mark", "text").mapInPandas(segments, SEGMENTS), "repeat-segments")
    anchors = parts.groupBy("anchor").agg(
        F.count("*").alias("n"), (F.min("digest") != F.max("digest")).alias("mixed")
    ).filter("n > 1")
    # Written first, so that the join deals both sides itself and adaptive execution can split a hot anchor.
    anchors = materialise(anchors.select("anchor", "mixed"), "repeat-anchors")
    again = materialise(parts.join(anchors, "anchor"), "repeat-again")
    rep = F.min(F.struct("doc", "mark", "off", "lead", "strings")).alias("rep")
    kinds = materialise(again.filter("mixed").groupBy("anchor", "digest").agg(F.count("*").alias("n"), rep), "repeat-kinds")
    span = [F.col("off").alias("start"), (F.col("off") + F.col("strings") - 1 + WIDTH).alias("stop")]
    whole = again.filter(~F.col("mixed")).select("doc", "mark", *span)
    copies = kinds.filter("n > 1").select("anchor", "digest")
    copied = again.filter("mixed").join(copies, ["anchor", "digest"]).select("doc", "mark", *span)
    matched = materialise(ends_of_runs(texts, kinds), "repeat-matches")
    local = matched.filter((F.col("low") == 0) & (F.col("high") == 0)).select("doc", "mark", "start", "stop")
    handed = matched.filter((F.col("low") != 0) | (F.col("high") != 0))
    twice = handed.groupBy("low", "high").agg(F.count("*").alias("n")).filter("n > 1").select("low", "high")
    across = handed.join(twice, ["low", "high"]).select("doc", "mark", "start", "stop")
    found = whole.union(copied).union(local).union(across)
    listed = found.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    return packed(texts).join(listed, ["doc", "mark"], "left")


def remove(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; also kept_text if asked for, where a
    character that lost some of its bytes is left out."""
    schema = "doc_id BIGINT, n_bytes BIGINT, n_removed BIGINT, n_spans BIGINT, kept_sha256 STRING"
    found = repeats(docs).select("doc_id", "packed", "found")
    return mapped(found, taken_out(with_text), schema + ", kept_text STRING" * with_text)
