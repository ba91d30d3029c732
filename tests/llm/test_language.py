from __future__ import annotations

import random
import zlib

import numpy as np

from touchstone.llm import language

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def greedy(text: list[int], learned: list[int]) -> int:
    """Phrases of the parse, with a search for every longest match."""
    inside = {tuple(learned[i:j]) for i in range(len(learned)) for j in range(i + 1, min(len(learned), i + 12) + 1)}
    at = count = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and tuple(text[at : at + n + 1]) in inside and tuple(text[at : at + 1]) in inside:
            n += 1
        at, count = at + n, count + 1
    return max(1, count)


def test_parse_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        learned = [rng.randint(0, 3) for _ in range(rng.randint(0, 40))]
        text = [rng.randint(0, 4) for _ in range(rng.randint(0, 60))]
        found = language.parsed([np.array(text, np.uint8)], [language.table(learned)])[0, 0]
        # a substring of at most 11 symbols: longer matches don't occur in such samples often
        if all(tuple(text[i : i + 12]) not in {tuple(learned[j : j + 12]) for j in range(len(learned))} for i in range(len(text) - 11)):
            assert found == greedy(text, learned)


def test_long_texts_are_parsed_whole():
    moves = language.table([1, 2, 3])
    texts = [np.array([1, 2, 3] * n, np.uint8) for n in (1, 400, 5)]
    stretches = [[t[i : i + 256] for i in range(0, len(t), 256)] for t in texts]
    wanted = [sum(greedy(s.tolist(), [1, 2, 3]) for s in parts) for parts in stretches]
    assert language.parsed(texts, [moves])[:, 0].tolist() == wanted


def test_letters_and_separators():
    symbols = language.alphabet({"en": "hello world"})
    assert language.encoded("Hé--llo 12 \n w", symbols).tolist().count(0) == 2
    assert language.encoded("hElLo", symbols).tolist() == language.encoded("HELLO", symbols).tolist()
    assert not language.encoded("12 - 34", symbols).any()


VOCABULARY = {"en": ["the", "this", "with", "tion", "ing", "and"], "de": ["der", "und", "sch", "heit", "ein", "über"], "fr": ["eau", "que", "ment", "les", "été", "ou"]}


def test_prediction(spark):
    rng = random.Random(2)

    def text(lang, n):
        return " ".join("".join(rng.choice(VOCABULARY[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    rows = [(i, text(lang, 60), lang, "s", 0) for i in range(150) for lang in [("en", "de", "fr")[i % 3]]]
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéü ") for _ in range(4000))
    rows += [(200, None, "en", "s", 0), (201, "12 34!", "de", "s", 0), (202, "", None, None, 0), (203, text("fr", 30_000), None, "s", 0), (204, noise, None, "s", 0), (None, text("de", 40), None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r["doc_id"]: r for r in language.predict(docs.withColumn("score", language.F.lit("x"))).collect()}
    assert len(out) == len(rows)
    for i, t, lang, *_ in rows[:150]:
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert out[i]["lang_pred"] == lang and 0 < out[i]["score"] <= 1 and out[i]["accepted"]
    for i in (200, 201, 202):
        assert (out[i]["lang_pred"], out[i]["score"], out[i]["accepted"]) == ("und", 0.0, False)
    assert out[203]["lang_pred"] == "fr" and out[None]["lang_pred"] == "de" and not out[204]["accepted"]
    kept = language.accepted(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {*range(150), 203, None}
    assert language.predict(docs.limit(0)).collect() == []
    unlabelled = docs.limit(3).withColumn("lang", language.F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.predict(unlabelled).collect()} == {"und"}
