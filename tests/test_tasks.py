"""What one task reads, holds and sends."""

from __future__ import annotations

from touchstone.operators import contract_diff, profiling, retrieval
from touchstone.session import TASK_BYTES, TASK_SETTINGS
from touchstone.sources.derived import source_table


def test_tasks_over_the_sources_stay_small(spark, folder):
    """Rows that a task combines in memory are bounded, and a lower bound of the session stays."""
    other = spark.newSession()
    other.conf.set(TASK_SETTINGS[0], "256m")
    other.conf.set(TASK_SETTINGS[1], "1000KB")
    source_table(other, folder, "bronze_transactions")
    assert other.conf.get(TASK_SETTINGS[0]) == str(TASK_BYTES) and other.conf.get(TASK_SETTINGS[1]) == "1000KB"


def test_counts_and_samples_come_from_one_pass(spark, capsys):
    """The distinct values are sent to Python once, and counted there."""
    df = spark.range(3000).selectExpr(
        "id % 700 AS a", "CAST(id % 11 AS STRING) AS b", "CAST(-id AS DOUBLE) AS c", "CAST(id % 9 - 4 AS DECIMAL(5,1)) AS d"
    )
    profiling.measured({"t": df}).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    other = df.selectExpr("CAST(NULL AS INT) AS n", "a AS m").repartition(5)
    rows = {r["column_name"]: r for r in profiling.profiles({"t": df, "u": other}).collect()}
    assert {c: r["distinct_count"] for c, r in rows.items()} == {"a": 700, "b": 11, "c": 3000, "d": 9, "n": 0, "m": 700}
    assert rows["b"]["samples"] == ["0", "1", "10", "2", "3"] and rows["d"]["samples"] == ["-4.0", "-3.0", "-2.0", "-1.0", "0.0"]
    assert rows["c"]["samples"] == [f"{-v}.0" for v in range(2999, 2994, -1)] and rows["n"]["samples"] == []


def test_texts_are_embedded_where_they_are(spark, capsys):
    """A text vector needs no other row, so nothing is shuffled; words are told apart by their bytes."""
    docs = spark.createDataFrame([(1, "\u00c9t\u00e9 \u00e9t\u00e9\tred\u00a0red"), (2, "red"), (None, None), (2, "red")], "doc_id BIGINT, text STRING")
    model = retrieval.text_embedder(docs, "text")
    vectors = retrieval.embed(model, docs, "doc_id")
    vectors.explain()
    assert "Exchange" not in capsys.readouterr().out
    found = sorted((r["doc_id"] or 0, sum(x > 0 for x in r["embedding"])) for r in vectors.collect())
    assert found == [(0, 0), (1, 2), (2, 1), (2, 1)]


def test_a_promotion_compares_contracts_once(spark, tmp_path):
    """The headers and the change logs are made from one comparison."""
    rows = [(f"ds_{i}", "1.0.0", "d", "o", "t", "daily", [("1.0.0", "Baseline.")]) for i in range(20)]
    fields = "contract_id STRING, version STRING, domain STRING, owner STRING, description STRING, freshness STRING"
    old = spark.createDataFrame(rows, f"{fields}, change_log ARRAY<STRUCT<version: STRING, note: STRING>>")
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    changes = old.selectExpr("contract_id", "'breaking' AS classification")
    changes = changes.mapInArrow(watched, changes.schema)
    headers = contract_diff.promote(str(tmp_path / "p"), old, old.drop("change_log"), changes)
    assert {r["version"] for r in headers.collect()} == {"2.0.0"} and headers.count() == 20
    assert seen.value == 20
