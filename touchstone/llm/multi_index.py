"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut into two halves, and each half is quantised by a codebook of its own; a cell is a pair
of centroids. A query visits the cells in order of the summed distance of its halves to the two
centroids, taken from a heap, until the visited cells hold a share of all entries; these entries are
ranked by their true distance.

The codebooks are trained, and the share is set, on a bounded sample of the vectors: the rows with the
smallest hashes of their ids, SAMPLE at most. The share is what it takes to meet RECALL of the true
neighbours of PROBES of them within the sample. Every row is indexed.

Entries are dealt by the first centroid in blocks of bounded size, so a vector that a third of all
rows share is spread over many tasks; the queries that visit a block are sent to it, in blocks too.

Cases: vectors that are null, empty, zero, or hold a null or non-finite component, and vectors of
another length than most, are neither queries nor candidates. Rows with a query's own id are not its
candidates; of queries with the same id, the smallest vector counts. Ties go to the smaller id.
Fewer candidates than k are all returned. No valid vectors give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchstone.llm.common import materialise, small_batches

CENTROIDS, SAMPLE, PROBES, RECALL, ROUNDS = 128, 16_384, 256, 0.95, 12
BLOCK_ROWS, BLOCK_QUERIES = 2048, 1024
#: Without `named` the id is null and vec_id stands for nothing: pandas would make doubles of ids next to a null.
INDEXED = "vec_id BIGINT, named BOOLEAN, vec ARRAY<DOUBLE>, first INT, second INT"
VISITS = "query_id BIGINT, vec ARRAY<DOUBLE>, first INT, seconds ARRAY<INT>"
HITS = "query_id BIGINT, vec_id BIGINT, named BOOLEAN, score DOUBLE"


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and vec (doubles) of the vectors that take part."""
    vec = F.col(column).cast("array<double>")
    held = vectors.select(F.col(id_column).alias("vec_id"), vec.alias("vec")).filter(
        F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("vec", lambda x: x != 0)
    )
    lengths = held.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    return held.filter(F.size("vec") == (lengths[0]["length"] if lengths else 0))


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)
    return np.maximum(out, 0)


def codebook(points: np.ndarray, size: int) -> np.ndarray:
    """Centroids by rounds of k-means from a spread-out start."""
    pick = np.random.default_rng(0)
    centres = points[pick.choice(len(points), min(size, len(points)), replace=False)]
    for _ in range(ROUNDS):
        nearest = squares(points, centres).argmin(1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres


def share_for(points: np.ndarray, first: np.ndarray, second: np.ndarray, k: int) -> float:
    """The share of entries that probes of the sample must visit to meet RECALL of their true neighbours."""
    half = points.shape[1] // 2
    probes = np.linspace(0, len(points) - 1, min(PROBES, len(points))).astype(int)
    true = squares(points[probes], points)
    near = [squares(points[:, :half], first), squares(points[:, half:], second)]
    cells = [d.argmin(1) for d in near]
    guess = near[0][probes][:, cells[0]] + near[1][probes][:, cells[1]]
    own = np.arange(len(probes))
    true[own, probes] = np.inf
    guess[own, probes] = -1.0
    wanted = np.argsort(true, axis=1)[:, : max(1, min(k, len(points) - 1))]
    limits = np.take_along_axis(guess, wanted, 1)
    ranks = np.stack([np.searchsorted(row, limit, side="right") for row, limit in zip(np.sort(guess, axis=1), limits, strict=True)])
    return float(np.quantile(ranks, RECALL) / len(points))


def cells_by_distance(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of centroids in ascending order of the summed distances."""
    one, two = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    a, b = first[one].tolist(), second[two].tolist()
    heap = [(a[0] + b[0], 0, 0)]
    reached = [0] * (len(a) + 1)  # of each row, how many columns have been taken
    while heap:
        _, i, j = heapq.heappop(heap)
        yield one[i], two[j]
        reached[i] = j + 1
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))


def quantise(first: np.ndarray, second: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    half = first.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                points = np.stack(batch["vec"].to_numpy())
                one, two = squares(points[:, :half], first).argmin(1), squares(points[:, half:], second).argmin(1)
                yield batch.assign(first=one.astype(np.int32), second=two.astype(np.int32))

    return run


def visits(first: np.ndarray, second: np.ndarray, counts: np.ndarray, quota: int):
    """For mapInPandas: each query with the cells it visits, by first centroid."""
    half = first.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query_id, vec in zip(batch["vec_id"], batch["vec"], strict=True):
                point, seen, chosen = np.asarray(vec)[None], 0, {}
                near = squares(point[:, :half], first)[0], squares(point[:, half:], second)[0]
                for i, j in cells_by_distance(*near):
                    if counts[i, j]:
                        chosen.setdefault(i, []).append(j)
                        seen += int(counts[i, j])
                        if seen >= quota:
                            break
                rows += [(query_id, vec, i, js) for i, js in chosen.items()]
            yield pd.DataFrame(rows, columns=["query_id", "vec", "first", "seconds"])

    return run


def rerank(k: int, centroids: int):
    """For a cogrouped block: the k nearest of the visited entries by their true distance, ties to the smaller id."""

    def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(entries) and len(queries):
            points, ids, second = np.stack(entries["vec"]), entries["vec_id"].to_numpy(), entries["second"].to_numpy()
            named = entries["named"].to_numpy(bool)
            guess = squares(np.stack(queries["vec"]), points)
            for n, (query_id, vec, seconds) in enumerate(zip(queries["query_id"], queries["vec"], queries["seconds"], strict=True)):
                visited = np.zeros(centroids, dtype=bool)
                visited[seconds] = True
                open_rows = np.flatnonzero(visited[second] & ((ids != query_id) | ~named))
                if len(open_rows) > k:
                    close = guess[n, open_rows]
                    bound = np.partition(close, k - 1)[k - 1]
                    open_rows = open_rows[close <= bound + 1e-9 * (1 + (vec**2).sum())]
                score = np.sqrt(((points[open_rows] - vec) ** 2).sum(1))
                best = np.lexsort((ids[open_rows], ~named[open_rows], score))[:k]
                nearest = open_rows[best]
                found = zip(ids[nearest].tolist(), named[nearest].tolist(), score[best].tolist(), strict=True)
                rows += [(query_id, *hit) for hit in found]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "named", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, centroids: int = CENTROIDS) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score (Euclidean distance). `vectors`: vec_id, embedding."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors)
    order = F.xxhash64("vec_id")
    sample = [r["vec"] for r in rows.orderBy(order, "vec_id").limit(SAMPLE).select("vec").collect()]
    if not sample:
        return spark.createDataFrame([], "query_id BIGINT, rank INT, vec_id BIGINT, score DOUBLE")
    points = np.array(sample)
    half = points.shape[1] // 2
    first, second = codebook(points[:, :half], centroids), codebook(points[:, half:], centroids)
    numbered = rows.select(F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNotNull().alias("named"), "vec")
    index = materialise(numbered.mapInPandas(quantise(first, second), INDEXED), "multi-index")
    asking = index.filter(F.col("named") & is_query)
    counts = np.zeros((centroids, centroids), dtype=np.int64)
    for r in index.groupBy("first", "second").count().collect():
        counts[r["first"], r["second"]] = r["count"]
    quota = max(k + 1, int(np.ceil(counts.sum() * share_for(points, first, second, k))))
    queries = asking.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    routes = queries.mapInPandas(visits(first, second, counts[: len(first), : len(second)], quota), VISITS)
    wanted = asking.count()
    parts = F.array(*[F.lit(int(max(1, -(-n // BLOCK_ROWS)))) for n in counts.sum(1)])
    row_parts, query_parts = F.element_at(parts, F.col("first") + 1), max(1, -(-wanted // BLOCK_QUERIES))
    entries = index.withColumn("row_part", F.pmod(F.xxhash64("vec_id"), row_parts).cast("int")).withColumn(
        "query_part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1)))
    )
    asked = routes.withColumn("query_part", F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int")).withColumn(
        "row_part", F.explode(F.sequence(F.lit(0), row_parts - 1))
    )
    key = ["first", "row_part", "query_part"]
    hits = entries.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(rerank(k, centroids), HITS)
    best = Window.partitionBy("query_id").orderBy("score", F.asc_nulls_last("vec_id"))
    ranked = hits.withColumn("vec_id", F.when(F.col("named"), F.col("vec_id"))).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
