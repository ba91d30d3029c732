"""Allow and block decisions for web pages, carried over to their aliases.

A rule is a host with a path. It fits that host and its subdomains, for urls whose path starts with the
rule's; of several the longest counts, and of equally long ones one that allows. Pages also say that
they are another page: by a canonical link, or by a refresh that sends the reader on. These and any
table of redirects are edges between urls; all urls that they connect are one page under several
names. Where no rule fits a url itself, its page is allowed if a rule allows any of its names, else
blocked if a rule blocks any, else allowed.

Urls are told apart by host, path and query: scheme and fragment make no other page, and an empty path
is `/`. A name counts whether or not it was fetched itself.

Rules are joined by host and path prefix, never tried one by one, so their number may be large too.

Cases: a url that is null or without `://` has an empty host and path, fits no rule, has no names and
is allowed. Null or empty html has no links. Rows are returned as often as they come. Links to other
schemes than web pages, to nothing, or to the page itself are not edges. No rows give no rows. Other
columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchstone.llm.components import components
from touchstone.session import materialise

#: Markup that holds no links of the page: comments and scripts.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
TAG = r"(?is)<(?:link|meta)\s[^>]*>"
VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(url: Column) -> Column:
    """What tells pages apart: host, path and query; null where the url has no host."""
    path, query = path_of(url), F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query))


def attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"(?is)\s{name}{VALUE}", 1)
    return F.regexp_replace(F.trim(F.regexp_replace(value, r"""^["']|["']$""", "")), "(?i)&amp;", "&")


def without_dots(path: Column) -> Column:
    """A path with its `.` and `..` steps taken."""

    def step(done: Column, part: Column) -> Column:
        back = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == ".", done).when(part == "..", back).otherwise(F.concat(done, F.array(part)))

    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    taken = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.array_join(taken, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def resolved(link: Column, base: Column) -> Column:
    """A link as a whole url; null where it leads to no other page."""
    origin = F.concat(F.regexp_extract(base, r"^([^:]*)://", 1), F.lit("://"), F.regexp_extract(base, r"://([^/?#]*)", 1))
    folder = F.regexp_extract(path_of(base), r"^(.*/)?", 1)
    place, query = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"(\?[^#]*)", 1)
    beside = F.concat(F.when(folder == "", "/").otherwise(folder), place)
    return (
        F.when(link.rlike(SCHEME + "//[^/?#]"), link)
        .when(link.rlike(SCHEME) | (link == "") | link.startswith("#"), None)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)//", 1), link))
        .when(link.startswith("?"), F.concat(origin, path_of(base), query))
        .when(link.startswith("/"), F.concat(origin, without_dots(place), query))
        .otherwise(F.concat(origin, without_dots(beside), query))
    )


def declared_links(pages: DataFrame) -> DataFrame:
    """Per link that says where a page belongs: its url as `source`, and `target`."""
    likely = pages.select("url", "html").filter(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    tags = likely.select("url", F.explode(F.regexp_extract_all(F.regexp_replace("html", HIDDEN, ""), F.lit(TAG), 0)).alias("tag"))
    tag = F.col("tag")
    is_link = tag.rlike("(?i)^<link") & F.lower(attribute(tag, "rel")).rlike(r"(^|\s)canonical(\s|$)")
    is_refresh = tag.rlike("(?i)^<meta") & (F.lower(attribute(tag, "http-equiv")) == "refresh")
    goes_on = F.regexp_extract(attribute(tag, "content"), r"""(?is)^\s*[\d.]+\s*[;,]\s*url\s*=\s*["']?([^"']*)""", 1)
    link = F.when(is_link, attribute(tag, "href")).when(is_refresh, F.trim(goes_on))
    return tags.select(F.col("url").alias("source"), resolved(link, F.col("url")).alias("target")).filter("target IS NOT NULL")


def rules_of(lines: dict[str, str], like: DataFrame) -> DataFrame:
    """A rule table: rule, rule_host, rule_path, rule_verdict, from `host/path` and what it decides."""
    rows = [(rule, rule.partition("/")[0], "/" + rule.partition("/")[2], verdict) for rule, verdict in lines.items()]
    return like.sparkSession.createDataFrame(rows, "rule STRING, rule_host STRING, rule_path STRING, rule_verdict STRING")


def ruled(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule and rule_verdict for every distinct place that a rule fits.

    A place is looked up under each ending of its host, and there under its beginnings of the lengths
    that rules of that host have.
    """
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat_ws(".", F.slice(labels, n, F.size(labels))))
    distinct = places.select("host", "path").filter("host <> ''").distinct()
    under = distinct.select("host", "path", F.explode(endings).alias("rule_host"))
    lengths = rules.select("rule_host", F.length("rule_path").alias("n")).distinct()
    begun = under.join(lengths, "rule_host").filter("length(path) >= n").withColumn("rule_path", F.expr("left(path, n)"))
    fitting = begun.join(rules, ["rule_host", "rule_path"])
    order = F.struct(F.length("rule"), F.col("rule_verdict") == "allow", "rule")
    best = F.max_by(F.struct("rule", "rule_verdict"), order)
    return fitting.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.*")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the smallest of its page's names (null: it has but one).

    `redirects` may add edges: source and target, whole urls.
    """
    links = declared_links(pages)
    if redirects is not None:
        links = links.union(redirects.select("source", "target"))
    edges = links.select(name_of(F.col("source")).alias("a"), name_of(F.col("target")).alias("b")).filter("a <> b")
    names = materialise(components(edges, "aliases"), "alias-names")
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), name_of(url).alias("node"))
    whole = F.concat(F.lit("://"), F.col("node"))
    other = names.select("component", host_of(whole).alias("host"), path_of(whole).alias("path"))
    decided = materialise(ruled(rows.select("host", "path").union(other.select("host", "path")), rules), "alias-rules")
    shared = other.join(decided, ["host", "path"]).groupBy("component").agg(
        F.when(F.max(F.col("rule_verdict") == "allow"), "allow").otherwise("block").alias("shared_verdict")
    )
    aliases = names.join(shared, "component", "left").withColumnRenamed("component", "alias_of")
    return rows.join(decided, ["host", "path"], "left").join(aliases, "node", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", "shared_verdict", F.lit("allow")).alias("verdict"), "alias_of",
    )
