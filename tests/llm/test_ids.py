"""Ids past 2^53 next to a null id, and stages of the pipeline that must not lose their documents."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from touchstone.llm import imatch, language, licences, lines, mixing, multi_index, near_join, packing, repeats, secret_scan
from touchstone.llm.queries import tokenizer

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
IDS = [2**53 + 1, 2**53 + 3, None, 7, -(2**62) - 1, 2**62 + 1, 2**62 + 3]


@pytest.fixture(scope="module")
def docs(spark):
    """One batch of clean, different documents; three ids would be equal as doubles."""
    rng = random.Random(4)
    parts = {"en": ["the", "this", "with", "tion"], "de": ["der", "und", "sch", "heit"]}
    rows = []
    for n, i in enumerate(IDS + list(range(100, 160))):
        lang = ("en", "de")[n % 2]
        text = " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(80))
        rows.append((i, text, lang, f"s{n % 3}", len(text)))
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


REPORTS = {
    "mix": mixing.mix, "repeats": repeats.remove, "language": language.predict, "secrets": secret_scan.report,
    "licences": licences.report, "near": near_join.join, "lines": lines.deduplicate, "imatch": imatch.report,
    "pack": lambda docs: packing.pack(docs, tokenizer()),
}


@pytest.mark.parametrize("name", REPORTS)
def test_operators_keep_ids(docs, name):
    wanted = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in REPORTS[name](docs).collect()} == wanted


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_lose_no_document(spark, docs, folder, name):
    wanted = {(r["doc_id"], r["text"]) for r in docs.collect()}
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    if name == "pack":
        assert {r["doc_id"] for r in out.collect()} == {i for i, _ in wanted}
    elif name == "mix_sources":  # takes less of some sources
        kept = {(r["doc_id"], r["text"]) for r in out.collect()}
        assert kept <= wanted and len(kept) > len(wanted) / 2
    else:
        assert {(r["doc_id"], r["text"]) for r in out.collect()} == wanted


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, folder, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame([], SCHEMA), folder).count() == 0


def test_neighbours_keep_ids(spark):
    """A vector without an id is a candidate like others, after those with one where they tie, and never a query."""
    rows = [(i, [float(n % 5), 1.0, float(n // 5), 0.0]) for n, i in enumerate([*IDS, 100, 200, 300])]
    rows.append((None, [0.0, 1.0, 0.0, 0.0]))
    vectors = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>").coalesce(1)
    found = multi_index.search(vectors, multi_index.F.col("vec_id") % 100 == 0, k=20).collect()
    assert {r["query_id"] for r in found} == {100, 200, 300}
    for query in (100, 200, 300):
        own = dict(rows)[query]
        near = sorted((sum((a - b) ** 2 for a, b in zip(own, v)) ** 0.5, i is None, i or 0) for i, v in rows if i != query)
        ours = sorted((r["rank"], r["score"], r["vec_id"]) for r in found if r["query_id"] == query)
        assert [(s, i is None, i or 0) for _, s, i in ours] == near
