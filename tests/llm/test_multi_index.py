from __future__ import annotations

import numpy as np

from touchstone.llm import multi_index
from touchstone.llm.multi_index import F

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def brute(vectors: dict[int, np.ndarray], k: int) -> dict[int, list[tuple[float, int]]]:
    return {
        q: sorted((float(np.sqrt(((v - vectors[q]) ** 2).sum())), i) for i, v in vectors.items() if i != q)[:k]
        for q in vectors
        if q % 100 == 0
    }


def test_cells_come_in_order():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.random(rng.integers(1, 9)).round(1), rng.random(rng.integers(1, 9)).round(1)
        found = list(multi_index.cells_by_distance(a, b))
        assert len(set(found)) == len(found) == len(a) * len(b)
        sums = [a[i] + b[j] for i, j in found]
        assert sums == sorted(sums)


def found_by(spark, rows, **settings):
    out: dict = {}
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("first", F.lit("clash"))
    for r in sorted(multi_index.search(docs, F.col("vec_id") % 100 == 0, **settings).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_scores_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 200)
    monkeypatch.setattr(multi_index, "BLOCK_QUERIES", 5)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    vectors = {i: (centres[i % 40] + 0.2 * rng.normal(size=16)).astype(np.float32) for i in range(2000)}
    vectors |= {2000 + i: vectors[100] for i in range(900)}  # a vector that a third of all rows share
    rows = [(i, v.tolist(), 0) for i, v in vectors.items()]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0] * 4]
    rows += [(9000 + 100 * i, v, 0) for i, v in enumerate(bad)]
    wanted = brute({i: v.astype(float) for i, v in vectors.items()}, 10)
    found = found_by(spark, rows, centroids=16)
    assert found.keys() == wanted.keys()
    hits = sum(len({i for _, i in found[q]} & {i for _, i in wanted[q]}) for q in wanted if q != 100 and q < 2000)
    assert hits >= 0.9 * 10 * sum(q != 100 and q < 2000 for q in wanted)
    assert found[100] == [(0.0, 2000 + i) for i in range(10)] and found[2500][:2] == [(0.0, 100), (0.0, 2000)]
    for q, row in found.items():
        for score, i in row:
            assert abs(score - np.sqrt(((vectors[i].astype(float) - vectors[q].astype(float)) ** 2).sum())) < 1e-12


def test_few_vectors(spark):
    rows = [(0, [1.0, 0.0, 2.0], 0), (7, [1.0, 1.0, 2.0], 0), (7, [1.0, 1.0, 2.0], 0), (200, [3.0, 0.0, 2.0], None)]
    found = found_by(spark, rows)
    assert found == {0: [(1.0, 7), (1.0, 7), (2.0, 200)], 200: [(2.0, 0), (5**0.5, 7), (5**0.5, 7)]}
    assert found_by(spark, [(0, [1.0, 2.0], 0)]) == {} and found_by(spark, []) == {} and found_by(spark, [(0, None, 0)]) == {}
