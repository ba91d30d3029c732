from __future__ import annotations

import random
import re

import numpy as np
import pytest

from touchstone.llm import near_join
from touchstone.llm.shingles import shingle_sets

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def shingles(text: str | None) -> frozenset:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def test_shingle_sets(monkeypatch):
    rng = random.Random(1)
    texts = ["", " ", "a", "A b", "b a", "a b c d e", "a b c d e f", "É é A", "x\x0by\x1cz", "a b c"]
    texts += [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 40))) for _ in range(200)] + ["word " * 3000]
    raw = [t.encode() for t in texts]
    sets = shingle_sets(raw)
    names: dict = {}
    for text, found in zip(texts, sets, strict=True):
        assert len(found) == len(shingles(text)) and (np.diff(found.astype(object)) > 0).all()
        assert names.setdefault(shingles(text), found.tobytes()) == found.tobytes()
    assert len(set(names.values())) == len(names)
    monkeypatch.setattr("touchstone.llm.shingles.LIMIT", 50)
    assert [s.tobytes() for s in shingle_sets(raw)] == [s.tobytes() for s in sets]


def test_bitmaps_never_lose_a_pair():
    rng = np.random.default_rng(2)
    sets = []
    for n in (1, 5, 30, 60, 90, 127, 130, 500, 900):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for _ in range(6):
            keep = rng.random(n) > rng.random() * 0.25
            sets.append(np.unique(np.r_[base[keep], rng.integers(0, 1 << 63, rng.integers(0, 1 + n // 6), dtype=np.uint64)]))
    sets = sorted((s for s in sets if len(s)), key=len)
    left, right = near_join.passing(np.array([len(s) for s in sets]), [near_join.bitmap(s) for s in sets])
    found = set(zip(left.tolist(), right.tolist(), strict=True))
    for j in range(len(sets)):
        for i in range(j):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                assert (i, j) in found
    assert len(found) < len(sets) ** 2 / 6


def changed(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("pqrstuvw") * 3
    return " ".join(words)


@pytest.mark.parametrize("tile_nodes,small_group", [(near_join.TILE_NODES, near_join.SMALL_GROUP), (7, 2)])
def test_against_brute_force(spark, monkeypatch, tile_nodes, small_group):
    monkeypatch.setattr(near_join, "TILE_NODES", tile_nodes)
    monkeypatch.setattr(near_join, "SMALL_GROUP", small_group)
    monkeypatch.setattr(near_join, "BUCKET_ENTRIES", 300)
    rng = random.Random(3)

    def words(n):
        return " ".join("".join(rng.choices("abcdefgh", k=3)) for _ in range(n))

    passage, origin, rows = words(40), words(120), []
    for i in range(60):
        rows.append((i * 2, words(rng.randint(1, 120)) + (" " + passage if i % 3 == 0 else "")))
    rows += [(200 + i, changed(rng, origin, rng.randint(0, 9))) for i in range(45)]
    for i in range(25):  # chains whose ends are far apart
        rows.append((301 + i, changed(rng, rows[-1][1] if i % 6 else words(100), 3)))
    for i in range(20):
        rows.append((401 + i, changed(rng, rows[rng.randrange(60)][1], 1)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "a b"), (504, "A  B"), (505, "b a"), (506, rows[3][1]), (3, rows[3][1].upper()), (7, words(9)), (7, words(9)), (None, rows[4][1]), (None, words(30)), (600, words(20_000))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumn("node", near_join.F.lit("clash"))
    out = sorted((tuple(r) for r in near_join.join(docs.repartition(5)).collect()), key=repr)
    assert out == brute(rows)


def test_representatives_and_no_documents(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(4, text, "en", "s", 1), (2, text, "de", "t", 2), (2, text, "de", "t", 2), (9, None, None, None, None)], SCHEMA)
    assert sorted(tuple(r) for r in near_join.representatives(docs).collect()) == [(2, text, "de", "t", 2), (9, None, None, None, None)]
    assert near_join.join(docs.limit(0)).collect() == []


def test_a_large_group_hands_on_no_pairs_that_join_nothing(spark, monkeypatch):
    rng = random.Random(5)
    base = " ".join("".join(rng.choices("abcdefgh", k=3)) for _ in range(120))
    rows = [(i, changed(rng, base, rng.randint(3, 9))) for i in range(150)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    tried, write = [], near_join.materialise

    def watched(df, name):
        table = write(df, name)
        if name == "near-pairs":
            tried.append(table.count())
        return table

    monkeypatch.setattr(near_join, "materialise", watched)
    monkeypatch.setattr(near_join, "TILE_NODES", 40)
    out = sorted((tuple(r) for r in near_join.join(docs).collect()), key=repr)
    assert out == brute(rows)
    assert sum(tried) <= 4 * len(rows)


def test_links_of_a_tile_join_what_its_similar_pairs_join():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[base[rng.random(60) > 0.1], rng.integers(0, 1 << 63, rng.integers(1, 6), dtype=np.uint64)]) for _ in range(80)]
    sets.sort(key=len)
    tile = near_join.pd.DataFrame({"node": range(80), "part": [n % 2 for n in range(80)], "one": 0, "two": 1})
    links = near_join.joining_links(tile, sets)

    def joined(pairs):
        label = list(range(80))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return {tuple(n for n in range(80) if label[n] == x) for x in label}

    common = {(a, b): len(np.intersect1d(sets[a], sets[b])) for b in range(80) for a in range(b) if (a - b) % 2}
    similar = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    assert set(links) <= set(similar) and len(links) < 80 < len(similar) and joined(links) == joined(similar)
