"""Page decisions against a plain reading of the rules and a union of names."""

from __future__ import annotations

import random
import re
from urllib.parse import urljoin

import duckdb
import pytest

from touchstone.llm import url_filter
from touchstone.llm.components import components
from touchstone.llm.queries import ORACLES, QUERIES, URL_RULES

SCHEMA = "page_id BIGINT, url STRING, html STRING"


def place(url):
    found = re.search(r"://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
    if not found:
        return "", "", None
    host = "".join(c.lower() if c.isascii() else c for c in found[1])
    return host, found[2], host + (found[2] or "/") + (found[3] or "") if host else None


def rule_for(host, path):
    fits = [
        (len(rule), verdict == "allow", rule)
        for rule, verdict in URL_RULES.items()
        for own, _, below in [rule.partition("/")]
        if ("." + host).endswith("." + own) and path.startswith("/" + below) and host
    ]
    return max(fits)[2] if fits else None


def expected(rows, links):
    """rows of (page_id, url); links of (url, whole target)."""
    group = {}

    def top(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for source, target in links:
        a, b = place(source)[2], place(target)[2]
        if a and b and a != b:
            group[max(top(a), top(b))] = min(top(a), top(b))
    members = {}
    for node in group:
        members.setdefault(top(node), []).append(node)
    out = []
    for page_id, url in rows:
        host, path, node = place(url)
        rule = rule_for(host, path)
        names = members.get(top(node), []) if node in group else []
        found = {URL_RULES.get(rule_for(*place("://" + n)[:2])) for n in names}
        verdict = URL_RULES[rule] if rule else "block" if "block" in found and "allow" not in found else "allow"
        out.append((page_id, host, path, rule, verdict, min(names) if names else None))
    return sorted(out, key=repr)


def judged(spark, rows, redirects=None):
    pages = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA + ", host STRING, rule INT")
    moved = None if redirects is None else spark.createDataFrame(redirects, "source STRING, target STRING")
    found = url_filter.judge(pages, url_filter.rules_of(URL_RULES, pages), moved)
    return sorted(map(tuple, found.collect()), key=repr)


def random_site(seed):
    chance = random.Random(seed)
    hosts = ["example.com", "www.example.com", "a.b.example.com", "xexample.com", "s.net", "t.org", "net", "Q.Org"]
    paths = ["", "/", "/en/1", "/es/2", "/fr/", "/en", "/de/x/y.html", "/de/x/"]
    tails = ["", "?q=1", "#top", "?q=1#top"]
    url = lambda: chance.choice(["http", "https"]) + "://" + chance.choice(hosts) + chance.choice(paths) + chance.choice(tails)
    rows, links = [], []
    for i in range(120):
        base, html = url(), "<p>text</p>"
        href = chance.choice([url(), url(), "/en/9", "../up", "./here?a=1", "//s.net/es/2", "?q=1", "", "#x", "mailto:a@example.com", "deep/er"])
        kind = chance.randrange(8)
        shown = href.replace("&", "&amp;")
        if kind == 0:
            html = f'<head><link rel="canonical" href="{shown}"></head>'
        elif kind == 1:
            html = f"<LINK HREF='{shown}' data-x=1 REL=Canonical>" if href else "<link rel=canonical href=''>"
        elif kind == 2:
            html = f'<meta http-equiv="refresh" content="0; URL={shown}">'
        elif kind == 3:
            html = f'<!-- <link rel="canonical" href="{shown}"> --><script>"<link rel=canonical href=/en/z>"</script>'
        elif kind == 4:
            html = f'<link rel="alternate" href="{shown}" title="canonical">'
        rows.append((i, base, html))
        if kind < 3 and href and not href.startswith(("#", "mailto")):
            links.append((base, urljoin(base, href)))
    return rows, links


@pytest.mark.parametrize("seed", range(3))
def test_against_union_find(spark, seed):
    rows, links = random_site(seed)
    assert judged(spark, rows) == expected([r[:2] for r in rows], links)


def test_sql_agrees(spark, tmp_path):
    rows, links = random_site(11)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted(map(tuple, QUERIES["op11_url_aliases"](spark, str(tmp_path)).collect()), key=repr)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        assert sorted(db.execute(ORACLES["op11_url_aliases"]).fetchall(), key=repr) == found
    assert found == expected([r[:2] for r in rows], links)


def test_odd_rows_and_redirect_table(spark):
    """Nulls, ids past 2^53 beside a null, repeated rows, long urls and html, redirects to names that were not fetched."""
    long = "https://t.org/" + "a/" * 5000
    rows = [
        (None, None, None), (2**53 + 1, "no scheme", "<link rel=canonical href=/en/1>"), (2**53 + 3, "x://", ""), (7, "http://t.org", None),
        (7, "http://t.org", None), (8, long, "<b>" * 200_000 + "canonical"), (9, "://s.net/es/", ""), (10, "http://u@h.example.com:80/en/", ""),
        (11, "http://hop.org/1", ""), (12, "http://hop.org/2", ""), (13, "http://two.org/1", ""),
    ]
    moves = [("http://hop.org/1", "http://hop.org/2"), ("http://hop.org/2", "https://s.net/fr/"), (None, "http://t.org"),
             ("http://two.org/1", "http://s.net/es/"), ("http://two.org/1", "https://www.example.com/en/"), ("http://t.org", "http://t.org/#a")]
    found = judged(spark, rows, moves)
    assert found == expected([r[:2] for r in rows], moves)
    verdicts = {row[0]: row[4] for row in found}
    assert (verdicts[11], verdicts[12], verdicts[13]) == ("block", "block", "allow")
    assert judged(spark, []) == []


def test_one_page_with_a_third_of_all_links(spark):
    links = [(f"http://p{i}.org/", "http://hub.org/es/") for i in range(900)]
    links += [(f"http://c.org/{i}", f"http://c.org/{i + 1}") for i in range(300)] + [("http://c.org/300", "http://s.net/fr/x")]
    rows = [(i, source, "") for i, (source, _) in enumerate(links)]
    found = judged(spark, rows, links)
    assert found == expected([r[:2] for r in rows], links)
    assert {r[4] for r in found if r[1] == "c.org"} == {"block"}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([("a", "a"), (None, "b")], "a STRING, b STRING"), "none").count() == 0
