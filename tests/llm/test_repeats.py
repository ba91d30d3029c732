from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from touchstone.llm import repeats
from touchstone.llm.grouping import suffix_array

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def brute(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - 199):
            seen[d[i : i + 200]] = seen.get(d[i : i + 200], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, dtype=bool)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array():
    rng = random.Random(0)
    for _ in range(1500):
        text = [rng.randint(0, rng.choice([0, 1, 2, 5, 50])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_window_minima_and_grams():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 900).astype(np.uint8)
    hashes = repeats.gram_hashes(data, repeats.byte_values())
    assert len(hashes) == 900 - repeats.GRAM + 1
    same: dict = {}
    for i, h in enumerate(hashes.tolist()):
        assert same.setdefault(bytes(data[i : i + repeats.GRAM]), h) == h
    assert len(set(same.values())) == len(same)
    chosen = repeats.window_minima(hashes, 177)
    leading = hashes >> repeats.PLACE_BITS
    assert chosen.tolist() == [i + int(leading[i : i + 177].argmin()) for i in range(len(hashes) - 176)]


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("anchor_segments", [repeats.ANCHOR_SEGMENTS, 3])
def test_against_brute_force(spark, monkeypatch, anchor_segments):
    """Passages, copies with changes, runs in one document, and common anchors spread over blocks."""
    monkeypatch.setattr(repeats, "ANCHOR_SEGMENTS", anchor_segments)
    monkeypatch.setattr(repeats, "BLOCK_SEGMENTS", 8)
    rng = random.Random(5)
    passages = [words(rng, n) for n in (30, 45, 60, 120)]
    common = words(rng, 55)
    texts: list[str | None] = []
    for i in range(60):
        parts = [words(rng, rng.randint(0, 60))]
        if i % 3:
            parts += [rng.choice(passages), words(rng, rng.randint(0, 30))]
        if i % 2:
            cut = rng.randint(0, 40)
            parts.insert(rng.randint(0, len(parts)), common[cut:])
        texts.append(rng.choice(["", " ", "x"]).join(parts))
    texts += [texts[3], texts[4][:-1] + "!", texts[5][50:], "a" * 700, "a" * 300, "ab" * 150, "ab" * 99, None, "", "z" * 199, "é" * 100, "é" * 100]
    texts += [texts[7][:300] + "#" + texts[7][301:], (common + " ") * 3, words(rng, 3000)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    wanted = brute(texts)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("found", repeats.F.lit("clash")).repartition(4)
    out = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove(docs).collect()}
    assert [out[i] for i in range(len(texts))] == wanted


def test_repeated_rows_long_text_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 500)
    rng = random.Random(6)
    long = words(rng, 1500)
    texts = [long, long[3000:4000], words(rng, 80), None]
    rows = [(1, texts[0]), (2, texts[1]), (None, texts[2]), (None, texts[3]), (7, texts[2]), (7, texts[2])]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    wanted = [(i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows]), strict=True)]
    assert sorted((tuple(r) for r in repeats.remove(docs).collect()), key=repr) == sorted(wanted, key=repr)
    assert repeats.remove(docs.limit(0)).collect() == []


def test_passage_beyond_the_places_of_a_portion(spark):
    """A text of over 2^PLACE_BITS bytes whose late passage recurs in a short document."""
    rng = random.Random(8)
    passage, size = "<" + "".join(rng.choices("abcdefgh", k=3000)) + ">", 1 << int(repeats.PLACE_BITS)
    long = "".join(rng.choices("abcdefgh", k=size + 200_000)) + passage + "".join(rng.choices("abcdefgh", k=100_000))
    portions = list(repeats.stretches([b"x" * 300, long.encode(), b"y" * 300]))
    assert all(sum(b - a for _, a, b in p) < size for p in portions)
    docs = spark.createDataFrame([(1, long, None, None, None), (2, "#" + passage + "#", None, None, None)], SCHEMA)
    out = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in repeats.remove(docs).collect()}
    assert out == {1: (len(passage), 1), 2: (len(passage), 1)}
