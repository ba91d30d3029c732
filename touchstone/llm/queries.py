"""The registered corpus queries, and the SQL they must agree with where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchstone.llm import imatch, language, licences, lines, mixing, multi_index, near_join, packing, repeats, secret_scan, token_links, turns, url_filter
from touchstone.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(plan: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = plan
        if oracle:
            ORACLES[name] = oracle
        return plan

    return register


@query(
    "op1_source_mix",
    r"""WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sized GROUP BY source),
weighed AS (SELECT *, CASE place % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS weight, sum(source_size) OVER () AS everything
  FROM totals),
trials AS (SELECT a.place, 3.0::DOUBLE * a.source_size / a.weight AS ratio,
  (any_value(a.everything) - coalesce(sum(3 * b.source_size) FILTER (3 * b.source_size * a.weight < 3 * a.source_size * b.weight), 0))::DOUBLE
  / sum(b.weight) FILTER (3 * b.source_size * a.weight >= 3 * a.source_size * b.weight) AS level
  FROM weighed a, weighed b GROUP BY ALL),
shares AS (SELECT *, least(3.0::DOUBLE * source_size, weight * (SELECT arg_min(level, ratio) FROM trials WHERE level <= ratio)) AS target
  FROM weighed),
laid AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized)
SELECT doc_id, size, source_size, target, source, CAST(CASE WHEN source_size = 0 THEN 0 ELSE
  CAST(round(target) AS BIGINT) // source_size * size
  + greatest(0, least(size, CAST(round(target) AS BIGINT) % source_size - before)) END AS BIGINT) AS taken
FROM laid JOIN (SELECT source AS named, source_size, target FROM shares) ON source IS NOT DISTINCT FROM named""",
)
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op9_pack")
def pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), tokenizer())


@query("op5_secrets")
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(documents(spark, folder))


@query("op4_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    return language.predict(documents(spark, folder))


@query("op10_imatch")
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.report(documents(spark, folder))


@query("op3_repeats")
def repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove(documents(spark, folder))


@query("op8_line_dedup")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.deduplicate(documents(spark, folder))
    return kept.select("doc_id", "n_lines", "n_removed", "n_runs", F.length("kept").cast("bigint").alias("n_kept"), "kept_sha256")


@query("op2_multi_index")
def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    schema = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"
    vectors = spark.read.schema(schema).parquet(f"{folder}/embeddings.parquet")
    return multi_index.search(vectors, F.col("vec_id") % 100 == 0)


@query("op7_near_join")
def near_join_documents(spark: SparkSession, folder: str) -> DataFrame:
    return near_join.join(documents(spark, folder))


@query("op6_licences")
def licence_families(spark: SparkSession, folder: str) -> DataFrame:
    return licences.report(documents(spark, folder))


@query("op13_turn_repair")
def repaired_turns(spark: SparkSession, folder: str) -> DataFrame:
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    return turns.report(spark.read.schema(schema).parquet(f"{folder}/conversations.parquet"))


URL_RULES = {
    "com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block",
}
_VALUE = r"""\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)"""


def _place(url: str) -> str:
    """host and path of a url, as columns of a SELECT."""
    return (
        f"translate(coalesce(regexp_extract({url}, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        f"'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract({url}, '://[^/?#]*([^?#]*)', 1), '') AS path"
    )


def _attribute(name: str) -> str:
    value = f"regexp_extract(tag, '(?is)\\s{name}{_VALUE}', 1)"
    bare = "regexp_replace(" + value + ", '^[\"'']|[\"'']$', '', 'g')"
    return f"regexp_replace(trim({bare}), '(?i)&amp;', '&', 'g')"


#: Names of pages as edges, followed from name to name; one step at a time, which suits few edges.
URL_ORACLE = rf"""WITH RECURSIVE rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in URL_RULES.items())}),
likely AS (SELECT url, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', '', 'g') AS html FROM pages
  WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^>]*>')) AS tag FROM likely),
links AS (SELECT url, CASE
  WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(lower({_attribute("rel")}), '(^|\s)canonical(\s|$)') THEN {_attribute("href")}
  WHEN regexp_matches(tag, '(?i)^<meta') AND lower({_attribute("http-equiv")}) = 'refresh'
  THEN trim(regexp_extract({_attribute("content")}, '(?is)^\s*[\d.]+\s*[;,]\s*url\s*=\s*["'']?([^"'']*)', 1)) END AS link FROM tags),
parts AS (SELECT url, link, regexp_extract(url, '^([^:]*:)//', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS site,
  regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(link, '^([^?#]*)', 1) AS place,
  regexp_extract(link, '(\?[^#]*)', 1) AS query FROM links),
laid AS (SELECT *, CASE WHEN link LIKE '/%' THEN place
  ELSE coalesce(nullif(regexp_extract(path, '^(.*/)?', 1), ''), '/') || place END AS whole FROM parts),
walked AS (SELECT *, list_reduce(list_transform(string_split(whole, '/'), lambda p: [p]), lambda done, p: CASE p[1] WHEN '.' THEN done
  WHEN '..' THEN done[1:greatest(len(done) - 1, 1)] ELSE done || p END) AS steps FROM laid),
targets AS (SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]') THEN link
  WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.\-]*:') OR link = '' OR link LIKE '#%' THEN NULL
  WHEN link LIKE '//%' THEN scheme || link WHEN link LIKE '?%' THEN scheme || '//' || site || path || query
  ELSE scheme || '//' || site || array_to_string(steps, '/') || CASE WHEN string_split(whole, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END
  || query END AS target FROM walked),
named AS (SELECT url, CASE WHEN host <> '' THEN host || CASE path WHEN '' THEN '/' ELSE path END
  || regexp_extract(url, '://[^?#]*(\?[^#]*)', 1) END AS node FROM (
  SELECT url, {_place("url")} FROM (SELECT url FROM pages UNION SELECT url FROM targets UNION SELECT target FROM targets))),
edges AS (SELECT a.node AS a, b.node AS b FROM targets t JOIN named a ON a.url = t.url JOIN named b ON b.url = t.target
  WHERE a.node <> b.node),
reached AS (SELECT a AS node, b AS other FROM edges UNION SELECT b, a FROM edges UNION
  SELECT r.node, e.b FROM reached r JOIN (SELECT a, b FROM edges UNION SELECT b, a FROM edges) e ON e.a = r.other),
places AS (SELECT DISTINCT host, path FROM (SELECT {_place("url")} FROM pages UNION ALL SELECT {_place("'://' || node")} FROM reached)),
ruled AS (SELECT host, path, arg_max(rule, (length(rule), verdict = 'allow', rule)) AS rule,
  arg_max(verdict, (length(rule), verdict = 'allow', rule)) AS verdict FROM places, rules
  WHERE ('.' || host) LIKE '%.' || split_part(rule, '/', 1) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY ALL),
shared AS (SELECT node, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked, min(other) AS alias_of
  FROM (SELECT node, other, {_place("'://' || other")} FROM reached) LEFT JOIN ruled USING (host, path) GROUP BY node)
SELECT page_id, p.host, p.path, rule, coalesce(ruled.verdict, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow')
  AS verdict, alias_of
FROM (SELECT page_id, url, {_place("url")} FROM pages) p LEFT JOIN ruled USING (host, path)
LEFT JOIN (SELECT DISTINCT url, node FROM named) n ON n.url = p.url LEFT JOIN shared USING (node)"""


@query("op11_url_aliases", URL_ORACLE)
def url_aliases(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.schema("page_id BIGINT, url STRING, html STRING").parquet(f"{folder}/pages.parquet")
    return url_filter.judge(pages, url_filter.rules_of(URL_RULES, pages))


@query("op12_token_links")
def token_groups(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found = token_links.align(documents(spark, folder), *paths, whole=False)
    return found.withColumnRenamed("groups", "groups_sha256")
