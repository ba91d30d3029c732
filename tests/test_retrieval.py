"""Exact search against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from touchstone.operators import profiling, retrieval


def brute_force(ids, vectors, query, k):
    scores = np.round(np.asarray(vectors, dtype=np.float32).astype(np.float64) @ np.asarray(query), 9)
    return sorted(zip(-scores, ids, strict=True))[:k]


@pytest.fixture(scope="module")
def vectors():
    made = np.random.default_rng(7).normal(size=(300, 8)).astype(np.float32)
    made[100:200] = made[0]  # a third of the index are copies of one vector
    return made


@pytest.fixture(scope="module")
def index(spark, vectors):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>").repartition(5)
    return df.unionByName(spark.createDataFrame([(999, None)], df.schema))


@pytest.mark.parametrize("k", [1, 7, 150, 1000])
def test_top_k(index, vectors, k, monkeypatch):
    monkeypatch.setattr(retrieval, "SCORES_HELD", 60)  # several blocks per batch
    queries = [(i, [float(x) for x in vectors[i]]) for i in (0, 5, 250)]
    found = retrieval.top_k(index, queries, k).collect()
    for name, query in queries:
        ours = sorted((-r["score"], r["vec_id"]) for r in found if r["query_id"] == name)
        expected = brute_force(range(300), vectors, query, k)
        assert [i for _, i in ours] == [i for _, i in expected]
        assert [r["rank"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == name] == list(
            range(1, len(expected) + 1)
        )


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_blocks_do_not_change_the_result(spark, index, vectors, k):
    """Requests as a table, sent along or met in blocks; a request without a vector finds nothing."""
    rows = [(f"q{i}", [float(x) for x in vectors[i]]) for i in range(40)]
    requests = spark.createDataFrame([*rows, ("none", None)], "query_id STRING, vector ARRAY<DOUBLE>").repartition(3)
    whole = sorted(map(tuple, retrieval.top_k(index, requests, k).collect()))
    assert whole == sorted(map(tuple, retrieval.top_k(index, rows, k).collect()))
    blocks = retrieval.top_k(index, requests, k, held_requests=2, block_rows=16)
    assert sorted(map(tuple, blocks.collect())) == whole


def test_no_requests_and_an_empty_index(spark, index, vectors):
    schema = "query_id BIGINT, vector ARRAY<DOUBLE>"
    assert retrieval.top_k(index, spark.createDataFrame([], schema), 3).count() == 0
    asked = spark.createDataFrame([(1, [1.0] * 8)], schema)
    assert retrieval.top_k(index.filter("vec_id < 0"), asked, 3).count() == 0
    assert retrieval.top_k(index.filter("vec_id < 0"), asked, 3, held_requests=0).count() == 0


def test_one_id_with_a_third_of_the_index(spark, vectors):
    """Rows that share an id are spread over blocks."""
    rows = [(7 if i % 3 else i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    index = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    asked = spark.createDataFrame([(1, rows[5][1])], "query_id BIGINT, vector ARRAY<DOUBLE>")
    found = retrieval.top_k(index, asked, 20, held_requests=0, block_rows=16).collect()
    wanted = brute_force([i for i, _ in rows], vectors, rows[5][1], 20)
    assert sorted((-r["score"], r["vec_id"]) for r in found) == [(s, i) for s, i in wanted]


def test_hits_get_columns(index, vectors):
    described = index.withColumn("name", index["vec_id"].cast("string"))
    hits = retrieval.top_k(index, [(0, [float(x) for x in vectors[3]])], 2)
    rows = sorted(map(tuple, retrieval.with_columns_of(described, hits, "vec_id", "name").collect()))
    assert rows[0][1] == str(rows[0][0])


def test_wrong_requests(index):
    with pytest.raises(ValueError, match="at least 1"):
        retrieval.top_k(index, [(0, [1.0] * 8)], 0)
    with pytest.raises(ValueError, match="no queries"):
        retrieval.top_k(index, [], 1)
    with pytest.raises(Exception, match="3 dimensions"):
        retrieval.top_k(index, [(0, [1.0] * 3)], 1).collect()


def test_index_on_disk(spark, index, tmp_path):
    retrieval.write_index(index, str(tmp_path / "index"))
    assert retrieval.read_index(spark, str(tmp_path / "index")).exceptAll(index).count() == 0
    path = str(tmp_path / "named")
    retrieval.write_index(index, path, "one")
    assert retrieval.read_index(spark, path, "one", 8).count() == 301
    with pytest.raises(retrieval.IndexMismatch, match="embedder one, not two"):
        retrieval.read_index(spark, path, "two")
    with pytest.raises(retrieval.IndexMismatch, match="8 dimensions, not 384"):
        retrieval.read_index(spark, path, "one", 384)
    uneven = index.unionByName(spark.createDataFrame([(5, [1.0])], index.schema))
    with pytest.raises(retrieval.IndexMismatch, match="1 to 8 dimensions"):
        retrieval.write_index(uneven, path, "one")
    assert retrieval.read_index(spark, path).count() == 301  # the index before is still the one in use
    with pytest.raises(FileNotFoundError):
        retrieval.read_index(spark, str(tmp_path / "nothing"))


def test_texts_are_found_by_their_words(spark):
    cards = spark.createDataFrame(
        [("a", "customer email and birth date"), ("b", "monthly volume per channel"), ("c", "account balance")],
        "table_name STRING, card STRING",
    )
    best = retrieval.search_cards(cards, "volume per channel", 1).first()
    assert best["table_name"] == "b" and best["rank"] == 1 and 0 < best["score"] <= 1
    allowed = retrieval.search_cards(cards, "volume per channel", 2, ["a", "c"])
    assert sorted(r["table_name"] for r in allowed.collect()) == ["a", "c"]


def test_text_vectors_have_unit_length(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "green blue"), (3, "red")], "doc_id BIGINT, text STRING")
    rows = retrieval.embed(retrieval.text_embedder(docs, "text"), docs, "doc_id").collect()
    assert all(len(r["embedding"]) == retrieval.DIMENSIONS for r in rows)
    assert [round(float(np.linalg.norm(r["embedding"])), 5) for r in rows] == [1.0, 1.0, 1.0]


def test_vectors_of_odd_texts(spark):
    """Every row has a vector, also without words; repeated rows have one each."""
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "a b"), (None, "a b"), (3, "A  a\n")], "doc_id BIGINT, text STRING")
    model = retrieval.text_embedder(docs, "text")
    rows = retrieval.embed(model, docs, "doc_id").collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 0, 1, 1, 2, 3]
    assert {r["doc_id"]: round(sum(x * x for x in r["embedding"]), 5) for r in rows} == {1: 0.0, 2: 0.0, None: 1.0, 3: 1.0}
    assert model.fingerprint == retrieval.text_embedder(docs.repartition(3), "text").fingerprint
    assert model.fingerprint != retrieval.text_embedder(docs.filter("doc_id = 3"), "text").fingerprint


def test_citations(spark):
    hits = spark.createDataFrame([(1, "b", 0.5, 2), (1, "a", 0.987, 1)], "query_id BIGINT, t STRING, score DOUBLE, rank INT")
    assert retrieval.citations(hits, "t").first()["retrieved"] == "a (0.99), b (0.50)"
    assert profiling.SAMPLES == 5
