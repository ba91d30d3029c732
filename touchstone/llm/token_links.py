"""Alignment of two tokenizers over a corpus, and how often their tokens end together.

Both tokenizers cut the same bytes. Where a token of either ends, a group ends; the two tokens that end
there are linked. How often a pair of tokens is linked is counted over all documents, and the pair a
right-hand token has most often is its best. Each document then learns the counts of its own links.

Counts are kept outside memory. A task writes its links as sorted runs of (pair, document) records,
radix-partitioned by the low bits of the right-hand token and compressed with zstd. Runs are merged a
bounded number at a time by a heap, which counts each pair; Spark adds up what the merges found. Pairs
come in right-hand order, so a token's best is known when its block ends. With these counts at hand the
runs are read once more and hand every document its share. However often a token occurs, its records
are spread over the merges by run, so no task holds all of it; what depends on the vocabulary alone is a
pair's total and the best of a token.

Cases: a document whose text is null or empty, or whose tokens of either side are not the bytes of the
text with a space before it, has no tokens: zeros and an empty text. Repeated rows are documents of
their own. Long texts are cut before a single space between words, which no token of either side
crosses. No rows give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchstone.llm.common import materialise, small_batches

#: Bits of a token id, and of the number of a document in its run.
ID_BITS, DOC_BITS = 20, 23
#: Runs are partitioned by so many low bits of the right-hand token.
RADIX_BITS = 4
#: Links or documents after which a run is closed, records of a compressed frame, and runs merged at a time.
RUN_LINKS = 1 << 21
RUN_DOCUMENTS = 1 << 15
FRAME = 1 << 16
MERGED_RUNS = 128
#: Characters that are encoded together, and after which a text may be cut.
SLICE = 1 << 20
#: Words that are remembered, and the length from which a word is not.
KNOWN_WORDS = 400_000
LONG_WORD = 32
#: ASCII and Latin letters with marks.
PLAIN = re.compile(r"[\n\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*")
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
# Fixed value: how byte-level tokenizers of this family split a text into words; here for plain characters.
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\n {LETTERS}0-9]+|[\n ]+(?![^\n ])|[\n ]+")
CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")

RUN_SCHEMA = pa.schema(
    [("run", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64())]
    + [(name, pa.int64()) for name in COUNTS]
    + [("groups", pa.string()), ("part", pa.int32()), ("records", pa.binary())]
)
RUN_COLUMNS = "run BIGINT, place INT, doc_id BIGINT, n_a BIGINT, n_b BIGINT, n_groups BIGINT, n_links BIGINT, groups STRING, part INT, records BINARY"


class Side:
    """A tokenizer: ids of texts, and the bytes and length of every token."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes]) -> None:
        self.encode = encode
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        if len(tokens) > 1 << ID_BITS:
            raise ValueError(f"token ids must fit {ID_BITS} bits")


def byte_level(path: str) -> Side:
    """A byte-level tokenizer; it sees the text with a space before it."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    # The characters that byte-level vocabularies write bytes as.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    tokens = []
    for i in range(tokenizer.get_vocab_size()):
        token = tokenizer.id_to_token(i) or ""
        known = all(c in byte_of for c in token)
        tokens.append(bytes(byte_of[c] for c in token) if known else token.encode())

    def ids_of(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return Side(WordMemory(ids_of).encode, tokens)


class WordMemory:
    """Encodes texts word by word, and remembers the ids of words.

    Only texts of plain characters are split here, where all versions of Unicode agree what a letter is;
    others go to the tokenizer whole.
    """

    def __init__(self, ids_of: Callable[[list[str]], list[list[int]]]) -> None:
        self.ids_of = ids_of
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        texts = [" " + t for t in texts]
        found: list[list[int]] = [[]] * len(texts)
        plain = [i for i, text in enumerate(texts) if PLAIN.fullmatch(text)]
        others = sorted({*range(len(texts))} - {*plain})
        for i, ids in zip(others, self.ids_of([texts[i] for i in others]), strict=True):
            found[i] = ids
        words = {i: WORDS.findall(texts[i]) for i in plain}
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        new = [w for w in {*chain.from_iterable(words.values())} if w not in self.known]
        self.known.update(zip(new, self.ids_of(new), strict=True))
        for i, own in words.items():
            found[i] = list(chain.from_iterable(map(self.known.__getitem__, own)))
        long = [w for w in new if len(w) > LONG_WORD]
        for word in long:
            del self.known[word]
        return found


def pieces(path: str) -> Side:
    """A tokenizer of word pieces, which puts the space before the text itself."""
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        tokens.append(bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode())
    return Side(lambda texts: processor.encode(texts, num_threads=1), tokens)


@lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> tuple[Side, Side, list[bytes]]:
    """Both tokenizers, and ids as text with what follows them: within a group, or at its end on either side."""
    a, b = byte_level(a_path), pieces(b_path)
    most = max(len(a.tokens), len(b.tokens))
    return a, b, [b"%d%c" % (i, end) for end in b",|;" for i in range(most)]


def stretches(text: str) -> Iterator[str]:
    """A text in parts of about SLICE characters, each to be read with a space before it."""
    at = 0
    while len(text) - at > SLICE:
        found = CUT.search(text, at + SLICE)
        if not found:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


class Document:
    """What the stretches of one document add up to."""

    def __init__(self, doc_id: int | None, whole: bool) -> None:
        self.doc_id, self.whole = doc_id, whole
        self.counts = dict.fromkeys(COUNTS, 0)
        self.pairs: list[np.ndarray] = []
        self.text: list[bytes] = []
        self.digest = hashlib.sha256()
        self.same = True

    def add(self, text: str, ids_a: list[int], ids_b: list[int], a: Side, b: Side, shown: list[bytes]) -> int:
        """Take in a stretch; returns its number of links."""
        raw = b" " + text.encode()
        if any(b"".join(map(s.tokens.__getitem__, ids)) != raw for s, ids in ((a, ids_a), (b, ids_b))):
            self.same = False
            return 0
        at_a, at_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(a.lengths[at_a]), np.cumsum(b.lengths[at_b])
        ending = np.zeros((2, len(raw) + 1), bool)
        ending[0, ends_a] = ending[1, ends_b] = True
        shared_a, shared_b = ending[1, ends_a], ending[0, ends_b]
        most = len(shown) // 3
        # Tokens in groups: those of the left side come after all earlier ones of the right side, and the other way round.
        before_a = np.cumsum(shared_a) - shared_a
        before_b = np.cumsum(shared_b) - shared_b
        tokens_b = np.concatenate([[0], np.flatnonzero(shared_b) + 1])
        tokens_a = np.flatnonzero(shared_a) + 1
        order = np.empty(len(at_a) + len(at_b), np.int64)
        order[np.arange(len(at_a)) + tokens_b[before_a]] = at_a + most * shared_a
        order[np.arange(len(at_b)) + tokens_a[before_b]] = at_b + 2 * most * shared_b
        groups = b"".join(map(shown.__getitem__, order.tolist()))
        if self.counts["n_groups"]:
            self.digest.update(b";")
        self.digest.update(groups[:-1])
        if self.whole:
            self.text.append(groups[:-1])
        self.pairs.append(paired(at_a[shared_a], at_b[shared_b]))
        n = len(self.pairs[-1])
        for name, more in zip(COUNTS, (len(at_a), len(at_b), n, n), strict=True):
            self.counts[name] += more
        return n

    def row(self) -> dict:
        if not self.same or not self.counts["n_groups"]:
            return {"doc_id": self.doc_id, **dict.fromkeys(COUNTS, 0), "groups": ""}
        groups = b";".join(self.text).decode() if self.whole else self.digest.hexdigest()
        return {"doc_id": self.doc_id, **self.counts, "groups": groups}


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A pair as one number that sorts by part, right-hand token and left-hand token."""
    b = b.astype(np.uint64)
    low = b & np.uint64((1 << RADIX_BITS) - 1)
    turned = (low << np.uint64(ID_BITS - RADIX_BITS)) | (b >> np.uint64(RADIX_BITS))
    return (turned << np.uint64(ID_BITS)) | a.astype(np.uint64)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers as one compressed frame, byte planes apart, with its length before it."""
    planes = b"".join(c.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    frame = zstandard.ZstdCompressor(level=1).compress(planes)
    return len(frame).to_bytes(8, "little") + frame


def unpacked(data: bytes, n_columns: int) -> Iterator[list[np.ndarray]]:
    """The frames of a run, one at a time."""
    at, reader = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        planes = np.frombuffer(reader.decompress(data[at + 8 : at + 8 + size]), np.uint8).reshape(n_columns, 8, -1)
        yield [np.ascontiguousarray(c.T).view("<u8").ravel() for c in planes]
        at += 8 + size


def framed(*columns: np.ndarray) -> bytes:
    return b"".join(packed(*[c[i : i + FRAME] for c in columns]) for i in range(0, len(columns[0]), FRAME))


def run_rows(run: int, documents: list[Document]) -> Iterator[dict]:
    """The rows of a run: one for each document, and one for each part with records (pair, place, times)."""
    keys = []
    for place, document in enumerate(documents):
        yield {"run": run, "place": place, **document.row()}
        if document.same:
            keys += [(pairs << np.uint64(DOC_BITS)) | np.uint64(place) for pairs in document.pairs]
    if not keys:
        return
    keys, times = np.unique(np.concatenate(keys), return_counts=True)
    pairs, places = keys >> np.uint64(DOC_BITS), keys & np.uint64((1 << DOC_BITS) - 1)
    parts = (pairs >> np.uint64(2 * ID_BITS - RADIX_BITS)).astype(np.int64)
    for part in np.unique(parts).tolist():
        first, last = np.searchsorted(parts, [part, part + 1])
        yield {"run": run, "part": part, "records": framed(pairs[first:last], places[first:last], times[first:last])}


def runs(a_path: str, b_path: str, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: doc_id and text to the rows of runs."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, shown = sides(a_path, b_path)
        first = TaskContext.get().partitionId() << 32
        number, size, held = 0, 0, []
        waiting: list[tuple[Document, str]] = []

        def encoded() -> int:
            """How many links the waiting texts have."""
            texts = [text for _, text in waiting]
            links = 0
            for (document, text), ids_a, ids_b in zip(waiting, a.encode(texts), b.encode(texts), strict=True):
                links += document.add(text, ids_a, ids_b, a, b, shown)
            waiting.clear()
            return links

        links = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if links >= RUN_LINKS or len(held) >= RUN_DOCUMENTS:
                    links += encoded()
                    yield pa.RecordBatch.from_pylist(list(run_rows(first + number, held)), RUN_SCHEMA)
                    number, size, links, held = number + 1, 0, 0, []
                held.append(Document(doc_id, whole))
                for part in stretches(text) if text else ():
                    waiting.append((held[-1], part))
                    size += len(part)
                    if size >= SLICE:
                        size, links = 0, links + encoded()
        encoded()
        if held:
            yield pa.RecordBatch.from_pylist(list(run_rows(first + number, held)), RUN_SCHEMA)

    return write


def tallies(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a run with how often they occur in it, in order, frame by frame."""
    for pairs, _, times in unpacked(data, 3):
        starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        yield pairs[starts], np.add.reduceat(times, starts)


def merged(sources: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted tallies as one: a heap gives the source whose frame begins first, and what no frame can add to is passed on."""
    frames = [next(source, None) for source in sources]
    heap = [(int(f[0][0]), i) for i, f in enumerate(frames) if f is not None]
    ends = [(int(f[0][-1]), i) for i, f in enumerate(frames) if f is not None]
    heapq.heapify(heap)
    heapq.heapify(ends)
    while heap:
        limit, taken = np.uint64(ends[0][0]), []
        while heap and heap[0][0] <= limit:
            _, i = heapq.heappop(heap)
            pairs, times = frames[i]
            cut = int(np.searchsorted(pairs, limit, "right"))
            taken.append((pairs[:cut], times[:cut]))
            frames[i] = (pairs[cut:], times[cut:]) if cut < len(pairs) else next(sources[i], None)
            if cut == len(pairs) and frames[i] is not None:
                heapq.heappush(ends, (int(frames[i][0][-1]), i))
            if frames[i] is not None:
                heapq.heappush(heap, (int(frames[i][0][0]), i))
        while ends and ends[0][0] <= limit:
            heapq.heappop(ends)
        pairs, place = np.unique(np.concatenate([p for p, _ in taken]), return_inverse=True)
        times = np.zeros(len(pairs), np.uint64)
        np.add.at(times, place, np.concatenate([t for _, t in taken]))
        yield pairs, times


def count_pairs(table: pa.Table) -> pa.Table:
    """The pairs of some runs of one part, with how often they occur."""
    sources = [tallies(data) for data in table.column("records").to_pylist()]
    found = list(merged(sources)) or [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found, strict=True)]
    return pa.table([pa.chunked_array([columns[0]]), pa.chunked_array([columns[1]])], names=["pair", "times"])


def best_pairs(table: pa.Table) -> pa.Table:
    """All pairs of a part in right-hand order, with their counts and whether it is the most of their right-hand token."""
    order = np.argsort(table.column("pair").to_numpy())
    pairs, times = (table.column(c).to_numpy()[order].astype(np.uint64) for c in ("pair", "times"))
    right = pairs >> np.uint64(ID_BITS)
    starts = np.flatnonzero(np.r_[True, right[1:] != right[:-1]])
    most = np.repeat(np.maximum.reduceat(times, starts), np.diff(np.r_[starts, len(pairs)]))
    part = pa.array([int(pairs[0] >> np.uint64(2 * ID_BITS - RADIX_BITS))], pa.int32())
    return pa.table({"part": part, "counts": pa.array([framed(pairs, times, times == most)], pa.binary())})


def contributions(records: pa.Table, counts: pa.Table) -> pa.Table:
    """What the links of each document in some runs add to its sums."""
    rows: list[list[np.ndarray]] = [[], [], [], []]
    if len(records) and len(counts):
        frames = list(unpacked(counts.column("counts")[0].as_py(), 3))
        pairs, times, best = (np.concatenate(c).astype(np.int64) for c in zip(*frames, strict=True))
        for run, data in zip(records.column("run").to_pylist(), records.column("records").to_pylist(), strict=True):
            sums = np.zeros((2, 0), np.int64)
            for own, places, n in unpacked(data, 3):
                at = np.searchsorted(pairs, own.astype(np.int64))
                places, n = places.astype(np.int64), n.astype(np.int64)
                if places.max() >= sums.shape[1]:
                    sums = np.pad(sums, ((0, 0), (0, int(places.max()) + 1 - sums.shape[1])))
                np.add.at(sums[0], places, n * best[at])
                np.add.at(sums[1], places, n * times[at])
            linked = np.flatnonzero(sums[1])
            for column, values in zip(rows, (np.full(len(linked), run), linked, *sums[:, linked]), strict=True):
                column.append(values)
    run, place, best, total = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in rows)
    return pa.table({"run": run, "place": place.astype(np.int32), "n_best": best, "count_sum": total})


def align(docs: DataFrame, a_path: str, b_path: str, whole: bool = True) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and the groups as text.

    The text is `a1,a2|b1;a3|b2,b3`, ids of either side by groups; with `whole` false, its SHA-256 instead,
    which spares writing several times the corpus.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(runs(a_path, b_path, whole), RUN_COLUMNS)
    written = materialise(rows, "token-runs")
    found = written.filter("records IS NOT NULL").select("part", "run", "records")
    groups = -(-found.select("run").distinct().count() // MERGED_RUNS) or 1
    dealt = found.withColumn("deal", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int"))
    some = dealt.groupBy("part", "deal").applyInArrow(count_pairs, "pair BIGINT, times BIGINT")
    totals = some.groupBy("pair").agg(F.sum("times").alias("times"))
    part = F.shiftright("pair", 2 * ID_BITS - RADIX_BITS).cast("int")
    counts = materialise(
        totals.groupBy(part.alias("part")).applyInArrow(best_pairs, "part INT, counts BINARY"), "token-pair-counts"
    )
    everywhere = counts.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    shares = dealt.groupBy("part", "deal").cogroup(everywhere.groupBy("part", "deal")).applyInArrow(
        contributions, "run BIGINT, place INT, n_best BIGINT, count_sum BIGINT"
    )
    sums = shares.groupBy("run", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    documents = written.filter("records IS NULL").select("run", "place", "doc_id", *COUNTS, "groups")
    none = F.lit(0).cast("bigint")
    return documents.join(sums, ["run", "place"], "left").select(
        "doc_id", *COUNTS, F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups"
    )
