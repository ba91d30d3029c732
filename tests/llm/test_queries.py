"""The registered corpus queries on the smallest test tables."""

from __future__ import annotations

import re

import pytest
from compare import connect, difference

import __spark_entry__ as contract
from touchstone.llm.queries import ORACLES, QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= contract.queries().keys() and ORACLES.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, folder, name):
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) == []


@pytest.mark.parametrize("name", ["op3_repeats", "op4_language", "op5_secrets", "op6_licences", "op7_near_join", "op8_line_dedup", "op10_imatch", "op12_token_links"])
def test_one_row_for_each_document(spark, folder, name):
    rows = QUERIES[name](spark, folder).collect()
    ids = [r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in rows) == sorted(ids)
