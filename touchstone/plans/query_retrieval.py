"""Queries: vectors and exact nearest-neighbour search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchstone.functions import vectors
from touchstone.operators import profiling, retrieval
from touchstone.plans.access import ROLES
from touchstone.plans.lakehouse import TABLES, Lakehouse
from touchstone.plans.oracles import CTES
from touchstone.plans.query_catalog import whole_catalog
from touchstone.plans.registry import over_deployed, over_folder
from touchstone.session import drop_at_exit, scratch_path

K = 5
LONDON = ROLES["branch_ops_london"]


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    schema = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"
    return spark.read.schema(schema).parquet(f"{folder}/embeddings.parquet")


def label_requests(index: DataFrame) -> DataFrame:
    """One search request per label: the vector with the smallest id."""
    first = index.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
    return first.select(F.col("label").cast("bigint").alias("query_id"), "vector")


def labelled_table() -> Column:
    """The tables in turn, as what the vectors describe."""
    return F.element_at(F.array(*[F.lit(t) for t in TABLES]), F.col("label") % len(TABLES) + 1)


LABELLED = f"{TABLES}[label % {len(TABLES)} + 1]"
CTES["search_requests"] = "SELECT label AS query_id, arg_min(embedding, vec_id) AS wanted FROM embeddings GROUP BY label"


def _ranked(index: str, requests: str = "search_requests") -> str:
    return (
        "SELECT query_id, vec_id, table_name, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) "
        "AS rank FROM (SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, table_name, round(list_dot_product("
        "CAST(embedding AS DOUBLE[]), CAST(wanted AS DOUBLE[])), 9) AS score "
        f"FROM {requests}, (SELECT *, {LABELLED} AS table_name FROM embeddings) {index}) QUALIFY rank <= {K}"
    )


READABLE = ", ".join(f"'{t}'" for t in sorted(LONDON.grants))
CTES["nearest"] = _ranked("")
CTES["nearest_readable"] = _ranked(f"WHERE table_name IN ({READABLE})")


def nearest(index: DataFrame, requests: DataFrame, *columns: str) -> DataFrame:
    hits = retrieval.top_k(index, requests, K)
    if not columns:
        return hits
    return retrieval.with_columns_of(index, hits, "vec_id", *columns)


@over_folder(
    "cosine_topk",
    "SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM nearest",
)
def _topk(spark: SparkSession, folder: str) -> DataFrame:
    index = embeddings(spark, folder)
    return nearest(index, label_requests(index)).withColumn("score", F.round("score", 6))


@over_folder(
    "cosine_topk_scoped",
    "SELECT query_id, vec_id, table_name, round(score, 3) AS score, CAST(rank AS INTEGER) AS rank FROM nearest_readable",
)
def _topk_scoped(spark: SparkSession, folder: str) -> DataFrame:
    index = embeddings(spark, folder).withColumn("table_name", labelled_table())
    readable = index.filter(F.col("table_name").isin(sorted(LONDON.grants)))
    return nearest(readable, label_requests(index), "table_name").withColumn("score", F.round("score", 3))


@over_folder(
    "topk_citations",
    "SELECT query_id, string_agg(table_name || ' (' || printf('%.2f', score) || ')', ', ' ORDER BY rank) AS retrieved "
    "FROM nearest GROUP BY query_id",
)
def _citations(spark: SparkSession, folder: str) -> DataFrame:
    index = embeddings(spark, folder).withColumn("table_name", labelled_table())
    return retrieval.citations(nearest(index, label_requests(index), "table_name"), "table_name")


@over_folder(
    "l2_normalize",
    "SELECT vec_id, CAST(i - 1 AS INTEGER) AS position, round(CAST(embedding[i] AS DOUBLE) / "
    "sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS component "
    "FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)",
)
def _normalise(spark: SparkSession, folder: str) -> DataFrame:
    unit = embeddings(spark, folder).select("vec_id", vectors.normalised(F.col("embedding")).alias("unit"))
    return unit.select("vec_id", F.posexplode("unit").alias("position", "component")).withColumn(
        "component", F.round("component", 6)
    )


MANY = "vec_id % 7 = 0"
CTES["many_requests"] = f"SELECT vec_id AS query_id, embedding AS wanted FROM embeddings WHERE {MANY}"
CTES["nearest_of_many"] = _ranked("", "many_requests")


@over_folder(
    "cosine_topk_many",
    "SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM nearest_of_many",
)
def _topk_many(spark: SparkSession, folder: str) -> DataFrame:
    """More requests than are sent along, against an index of several blocks."""
    index = embeddings(spark, folder)
    requests = index.filter(MANY).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = retrieval.top_k(index, requests, K, held_requests=64, block_rows=512)
    return hits.withColumn("score", F.round("score", 6))


@over_folder(
    "index_on_disk",
    "SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM nearest",
)
def _index_on_disk(spark: SparkSession, folder: str) -> DataFrame:
    """An index that is written, read back for what it should hold, and searched."""
    vectors, path = embeddings(spark, folder), scratch_path(spark, "index")
    drop_at_exit(spark, path)
    retrieval.write_index(vectors, path, "embeddings")
    index = retrieval.read_index(spark, path, "embeddings")
    return nearest(index, label_requests(index)).withColumn("score", F.round("score", 6))


def _weighed(table: str, key: str, text: str) -> str:
    """Bucket weights of the texts of a table, of length one."""
    words = f"SELECT {key}, unnest(regexp_extract_all(lower({text}), '[^\\x20\\x09-\\x0D]+')) AS word FROM {table}"
    counts = f"SELECT {key}, CAST('0x' || left(md5(word), 8) AS BIGINT) % {retrieval.DIMENSIONS} AS bucket, count(*) AS n FROM ({words}) GROUP BY ALL"
    rare = f"SELECT bucket, ln((any_value(total) + 1) / (count(*) + 1)) AS weight FROM ({counts}), (SELECT count(*) AS total FROM {table}) GROUP BY bucket"
    return (
        f"SELECT {key}, bucket, n * weight / nullif(sqrt(sum(n * weight * n * weight) OVER (PARTITION BY {key})), 0) AS weight "
        f"FROM ({counts}) JOIN ({rare}) USING (bucket)"
    )


CTES["document_weights"] = _weighed("documents", "doc_id", "text")


@over_folder(
    "embed_documents",
    "SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round(CAST(CAST(weight AS FLOAT) AS DOUBLE), 5) AS weight "
    "FROM document_weights WHERE weight > 0",
)
def _embed_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.schema("doc_id BIGINT, text STRING").parquet(f"{folder}/documents.parquet")
    unit = retrieval.embed(retrieval.text_embedder(documents, "text"), documents, "doc_id")
    weights = unit.select("doc_id", F.posexplode("embedding").alias("bucket", "weight")).filter("weight > 0")
    return weights.withColumn("weight", F.round(F.col("weight").cast("double"), 5))


QUESTION = "customer email and date of birth"
CTES["cards_and_question"] = f"SELECT table_name, card FROM catalog_texts UNION ALL SELECT 'question', '{QUESTION}'"
CTES["card_words"] = (
    "SELECT table_name, CAST('0x' || left(md5(word), 8) AS BIGINT) % 384 AS bucket, count(*) AS n FROM (SELECT table_name, "
    "unnest(regexp_extract_all(lower(card), '[^\\x20\\x09-\\x0D]+')) AS word FROM cards_and_question) GROUP BY ALL"
)
CTES["card_weights"] = (
    "SELECT table_name, bucket, n * weight / sqrt(sum(n * weight * n * weight) OVER (PARTITION BY table_name)) AS weight "
    "FROM card_words JOIN (SELECT bucket, ln((SELECT count(*) + 1 FROM catalog_texts) / (count(*) FILTER (table_name <> 'question') + 1)) "
    "AS weight FROM card_words GROUP BY bucket) USING (bucket)"
)


@over_deployed(
    "search_catalog",
    "SELECT table_name, round(score, 3) AS score, CAST(rank AS INTEGER) AS rank, card FROM (SELECT c.table_name, sum(c.weight * q.weight) "
    "AS score, row_number() OVER (ORDER BY round(sum(c.weight * q.weight), 9) DESC, c.table_name) AS rank FROM card_weights c "
    f"JOIN card_weights q ON c.bucket = q.bucket AND q.table_name = 'question' WHERE c.table_name IN ({READABLE}) "
    "GROUP BY c.table_name) JOIN catalog_texts USING (table_name) WHERE rank <= 3",
)
def _search_catalog(lake: Lakehouse) -> DataFrame:
    cards = profiling.cards(whole_catalog(lake))
    return retrieval.search_cards(cards, QUESTION, 3, sorted(LONDON.grants))
