"""Rows that share a doc_id, null or not, are told apart by their texts."""

from __future__ import annotations

import random
from collections import Counter

from touchstone.llm import language, mixing, near_join

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def texts(docs):
    return Counter((r["doc_id"], r["text"]) for r in docs.collect())


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))


def test_representatives(spark):
    rng = random.Random(1)
    one, two, three, copied, four, five = (words(rng, 40) for _ in range(6))
    rows = [(None, one), (None, two), (None, two), (None, three), (None, three.upper()), (7, four), (7, five), (8, copied), (None, copied), (5, five), (None, None), (None, ""), (9, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    out = texts(near_join.representatives(docs))
    third = {(None, three), (None, three.upper())}
    assert len(third & out.keys()) == 1
    wanted = [(None, one), (None, two), (7, four), (5, five), (8, copied), (None, None), (None, ""), (9, ""), (9, None)]
    assert {k: n for k, n in out.items() if k not in third} == dict.fromkeys(wanted, 1)


def test_accepted(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "this", "with", "tion"], "de": ["der", "und", "sch", "heit"]}
    known = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(60)), lang) for i in range(80) for lang in [("en", "de")[i % 2]]]
    rows = [*known, (None, known[0][1] + " this", "en"), (None, known[1][1] + " und", "de"), (None, "12 34", "en"), (None, "", "en"), (None, None, None), (3, "77", "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], SCHEMA)
    assert texts(language.accepted(docs)) == Counter((i, t) for i, t, _ in rows[:82])


def test_mixed(spark):
    rows = [(None, f"w{i} " * (30 + 20 * i), f"s{i % 3}") for i in range(40)] + [(4, f"v{i} " * 50, f"s{i % 3}") for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)
    marked = docs.withColumn("place", mixing.F.xxhash64("text"))
    mark = {r["place"]: (r["doc_id"], r["text"]) for r in marked.collect()}
    taken = mixing.mix(marked, by=["place"]).collect()
    copies = {mark[r["place"]]: int(r["taken"] / r["size"] + 0.5) for r in taken}
    assert len(taken) == len(rows) and len(set(copies.values())) > 1
    assert texts(mixing.mixed(docs)) == {k: n for k, n in copies.items() if n}
