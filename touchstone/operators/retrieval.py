"""Exact top-k search by inner product, and text vectors to search with.

Requests are a table. A few of them, bounded in number and bytes, go to the index where it is: every
task multiplies its batches with them. Any larger number meets the index in blocks: index rows are dealt
to blocks of bounded size, every block gets all requests after its rows, and a task holds one block while
requests stream past it. The index is shuffled once, whatever the number of requests. Both ways keep k
results per request and task or block, and merge them in two levels, never a row per pair.

Text vectors are word weights by the digest of the word, which any engine computes alike.
"""

from __future__ import annotations

import hashlib
import json
import math
import sys
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from touchstone.session import materialise
from touchstone.sources import store

# The search function travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bounds on requests that are sent to the index, on the rows of a block, and on the scores a task holds at a time.
HELD_REQUESTS = 1024
HELD_BYTES = 32 * 1024 * 1024
BLOCK_ROWS = 16_384
SCORES_HELD = 4_000_000
# Groups of blocks whose results are merged before those of all blocks are.
SHARES = 256
# Scores are compared at this many decimals, so equal vectors tie in every batch.
DECIMALS = 9
DIMENSIONS = 384


def _best(queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int):
    """The k best per query; ties go to the smaller id."""
    order = np.lexsort((ids, -scores, queries))
    queries, scores, ids = queries[order], scores[order], ids[order]
    starts = np.searchsorted(queries, queries, side="left")
    keep = np.arange(len(queries)) - starts < k
    return queries[keep], scores[keep], ids[keep]


def _candidates(scores: np.ndarray, k: int):
    """Rows and queries whose score is not below the k-th best of this batch, ties included."""
    if len(scores) > k:
        threshold = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
        return np.nonzero(scores >= threshold)
    return np.nonzero(np.ones(scores.shape, dtype=bool))


def _vectors(column: pa.Array, width: int | None) -> np.ndarray:
    """Vectors as the rows of a matrix; they must have one width."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = width if width is not None else len(values) // max(1, len(column))
    if len(values) != len(column) * width:
        raise ValueError(f"index and request vectors do not all have {width} dimensions")
    return values.reshape(len(column), width)


def _names(column: pa.Array) -> np.ndarray:
    """Ids as an array that sorts them."""
    found = column.to_numpy(zero_copy_only=False)
    return found.astype(str) if found.dtype == object else found


def _search(vectors: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int, held=None):
    """The k best of these vectors, and of those held already, for each row of the matrix of requests."""
    step = max(k, SCORES_HELD // len(matrix))
    for start in range(0, len(ids), step):
        scores = np.round(vectors[start : start + step] @ matrix.T, DECIMALS)
        rows, queries = _candidates(scores, k)
        found = queries, scores[rows, queries], ids[start : start + step][rows]
        held = _best(*(found if held is None else map(np.concatenate, zip(held, found, strict=True))), k)
    return held


def _rows(held, names: np.ndarray, block: int, schema: pa.Schema) -> pa.RecordBatch:
    queries, scores, ids = held
    columns = [names[queries].tolist(), ids.tolist(), scores.tolist(), [block] * len(ids)]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _beside_index(shared, k: int, schema: pa.Schema):
    """For mapInArrow: index rows with their id and vector, against requests that are sent along."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        held = None
        for batch in batches:
            if batch.num_rows:
                held = _search(_vectors(batch.column(1), matrix.shape[1]), _names(batch.column(0)), matrix, k, held)
        if held is not None:
            yield _rows(held, names, TaskContext.get().partitionId(), schema)

    return search


def _by_block(k: int, schema: pa.Schema):
    """For mapInArrow: blocks in order, each with its index rows before all requests."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, index = None, [], None
        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False)
            asked = batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (asked[1:] != asked[:-1]), True])
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                if block[start] != current:
                    current, parts, index = block[start], [], None
                rows = batch.slice(start, stop - start)
                if not asked[start]:
                    parts.append((_names(rows.column(2)), _vectors(rows.column(4), None)))
                    continue
                if not parts:
                    continue
                if index is None:
                    index = tuple(np.concatenate(c) for c in zip(*parts, strict=True))
                ids, vectors = index
                matrix = _vectors(rows.column(4), vectors.shape[1])
                yield _rows(_search(vectors, ids, matrix, k), _names(rows.column(3)), int(current), schema)

    return search


ARROW_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def top_k(
    index: DataFrame,
    requests: DataFrame | Iterable[tuple[int | str, Sequence[float]]],
    k: int,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    held_requests: int = HELD_REQUESTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k nearest index rows of each request, best first: query_id, the row's id, score, rank.

    Requests are a table of query_id (which tells them apart) and vector; a short list of pairs will do
    as well. Rows without a vector take no part. An index with fewer than k rows returns them all.
    More than `held_requests` requests meet the index in blocks of about `block_rows`.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = index.sparkSession
    if not isinstance(requests, DataFrame):
        listed = [(name, [float(x) for x in vector]) for name, vector in requests]
        if not listed:
            raise ValueError("no queries to search for")
        kind = "BIGINT" if isinstance(listed[0][0], int) else "STRING"
        requests = spark.createDataFrame(listed, f"query_id {kind}, vector ARRAY<DOUBLE>")
    vectors = index.select(id_column, vector_column).filter(F.col(vector_column).isNotNull())
    asked = requests.select("query_id", F.col("vector").cast("array<double>").alias("vector")).filter("vector IS NOT NULL")
    id_type, name_type = (df.schema[c].dataType.simpleString() for df, c in ((index, id_column), (requests, "query_id")))
    schema = pa.schema(
        [("query_id", ARROW_TYPES[name_type]), (id_column, ARROW_TYPES[id_type]), ("score", pa.float64()), ("block", pa.int32())]
    )
    columns = f"query_id {name_type}, {id_column} {id_type}, score DOUBLE, block INT"
    few = asked.limit(held_requests + 1).collect()
    if few and len(few) <= held_requests and len(few) * len(few[0][1]) * 8 <= HELD_BYTES:
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in few]), np.array([r[1] for r in few], dtype=np.float64)))
        hits = vectors.mapInArrow(_beside_index(shared, k, schema), columns)
    else:
        groups = max(1, -(-vectors.count() // block_rows))
        block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")
        none = F.lit(None)
        rows = vectors.select(
            block.alias("block"), F.lit(False).alias("asked"), F.col(id_column).alias("id"),
            none.cast(name_type).alias("query_id"), F.col(vector_column).cast("array<double>").alias("vector"),
        )
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
        sent = asked.select(everywhere.alias("block"), F.lit(True), none.cast(id_type), "query_id", "vector")
        ordered = rows.union(sent).repartition("block").sortWithinPartitions("block", "asked")
        hits = ordered.mapInArrow(_by_block(k, schema), columns)
    return _merged(hits, k, id_column)


def _merged(hits: DataFrame, k: int, id_column: str) -> DataFrame:
    """The k best of each request from the k best of each block: first of some blocks together, then of all."""
    order = [F.desc("score"), F.asc(id_column)]
    some = hits.withColumn("share", F.pmod("block", F.lit(SHARES)))
    halfway = Window.partitionBy("query_id", "share").orderBy(*order)
    best = some.withColumn("rank", F.row_number().over(halfway)).filter(F.col("rank") <= k).drop("rank", "share")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).drop("block")


def with_columns_of(index: DataFrame, hits: DataFrame, id_column: str, *columns: str) -> DataFrame:
    """Hits with columns of the index rows they point to. Adaptive execution sends few hits to the index."""
    return index.select(id_column, *columns).join(hits, id_column)


def citations(hits: DataFrame, name: str) -> DataFrame:
    """Per query, the names it found with their scores, best first. A query has at most k hits."""
    text = F.format_string("%s (%.2f)", F.col(name), F.col("score"))
    listed = F.array_sort(F.collect_list(F.struct("rank", text.alias("text"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda h: h["text"]), ", ").alias("retrieved"))


# ------------------------------------------------------------------ text vectors


#: Words whose bucket a task remembers.
KNOWN_WORDS = 200_000


class Buckets(dict):
    """The bucket of a word in UTF-8, by the first eight digits of its MD5; words recur, so they are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = int(hashlib.md5(word).hexdigest()[:8], 16) % DIMENSIONS
        return found

    def counts(self, text: bytes | None) -> np.ndarray:
        """How often each bucket occurs in a text; its words are what ASCII white space parts."""
        return np.bincount([self[word] for word in text.split()] if text else np.empty(0, dtype=int), minlength=DIMENSIONS)


def _lowered(text: str) -> Column:
    return F.lower(F.col(text)).cast("binary").alias("_text")


@dataclass(frozen=True)
class Embedder:
    """Weights of the buckets: those of rare words weigh more. Their number is fixed."""

    weights: tuple[float, ...]

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.weights).encode()).hexdigest()


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: how many texts of a task have each bucket, and under no bucket how many there are."""
    known, texts, total = Buckets(), np.zeros(DIMENSIONS, dtype=np.int64), 0
    for batch in batches:
        total += batch.num_rows
        for text in batch.column(0):
            texts += known.counts(text.as_py()) > 0
    yield pa.RecordBatch.from_pydict({"bucket": pa.array([*range(DIMENSIONS), None], pa.int32()), "n": [*texts.tolist(), total]})


def text_embedder(corpus: DataFrame, text: str) -> Embedder:
    """Weighs a bucket by the logarithm of how few texts have it."""
    held = corpus.select(_lowered(text)).mapInArrow(_held, "bucket INT, n BIGINT")
    frequency = dict(map(tuple, held.groupBy("bucket").agg(F.sum("n")).collect()))
    total = frequency.get(None, 0)
    return Embedder(tuple(math.log((total + 1) / (frequency.get(b, 0) + 1)) for b in range(DIMENSIONS)))


def _weighed(weights: Sequence[float]):
    """For mapInArrow: rows whose last column is a text, with its vector instead."""
    scale = np.array(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets()
        for batch in batches:
            *kept, texts = batch.columns
            rows = np.zeros((batch.num_rows, DIMENSIONS), dtype=np.float32)
            for i, text in enumerate(texts):
                weighed = known.counts(text.as_py()) * scale
                length = math.sqrt(weighed @ weighed)
                if length:
                    rows[i] = weighed / length
            starts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * DIMENSIONS)
            vectors = pa.ListArray.from_arrays(starts, pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*kept, vectors], names=[*batch.schema.names[:-1], "embedding"])

    return run


def embed(model: Embedder, df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns to keep, and `embedding`: word counts times weights, of length one, or zeros if no word weighs anything.

    A vector has a fixed number of buckets, so a text is counted where it is, and nothing is shuffled.
    """
    rows = df.select(*keep, _lowered(text))
    schema = StructType([*df.select(*keep).schema.fields, StructField("embedding", ArrayType(FloatType()))])
    return rows.mapInArrow(_weighed(model.weights), schema)


# ------------------------------------------------------------------ an index on disk


class IndexMismatch(ValueError):
    """An index that does not fit what it is to be searched with."""


def write_index(vectors: DataFrame, folder: str, embedder: str = "", vector_column: str = "embedding") -> None:
    """Write an index with what it holds: the width of its vectors, how many there are, and whose they are.

    An index whose vectors have several widths is not published.
    """
    size = F.size(vector_column)
    with store.Builder(vectors.sparkSession, folder, embedder) as builder:
        filled = F.col(vector_column).isNotNull()
        wide, narrow = F.max(F.when(filled, size)), F.min(F.when(filled, size))
        builder.write("index", vectors, measures={"width": wide, "narrowest": narrow, "vectors": F.count(vector_column)})
        if builder.measures["width"] != builder.measures["narrowest"]:
            raise IndexMismatch(f"vectors have {builder.measures['narrowest']} to {builder.measures['width']} dimensions")
        builder.publish()


def read_index(spark: SparkSession, folder: str, embedder: str | None = None, width: int | None = None) -> DataFrame:
    """The newest index of a folder; an error if it is of another embedder or width."""
    build = store.latest(spark, folder)
    if build is None or "index" not in build.tables:
        raise FileNotFoundError(f"{folder} holds no index")
    if embedder is not None and build.sources != embedder:
        raise IndexMismatch(f"the index was made by embedder {build.sources or 'unknown'}, not {embedder}")
    if width is not None and build.measures["width"] not in (width, None):
        raise IndexMismatch(f"the index has {build.measures['width']} dimensions, not {width}")
    return store.read(spark, folder, build.tables["index"])


def search_cards(cards: DataFrame, question: str, k: int, allowed: Sequence[str] | None = None) -> DataFrame:
    """The catalog cards nearest to a question, only of tables the asker may read.

    Tables are left out before ranking, so there are k results if there are k allowed tables.
    """
    cards = materialise(cards, "cards")  # read for fitting, embedding and the answer
    model = text_embedder(cards, "card")
    asked = cards.sparkSession.createDataFrame([(0, question)], "query_id BIGINT, text STRING")
    requests = embed(model, asked, "query_id").withColumnRenamed("embedding", "vector")
    readable = cards if allowed is None else cards.filter(F.col("table_name").isin(list(allowed)))
    hits = top_k(embed(model, readable, "table_name", text="card"), requests, k, "table_name")
    return with_columns_of(cards, hits, "table_name", "card").select(
        "table_name", F.round("score", 3).alias("score"), "rank", "card"
    )
