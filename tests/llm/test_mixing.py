from __future__ import annotations

import pytest
from touchstone.llm import mixing

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def brute_targets(sizes: dict, weights=(5, 2, 1), cap=3) -> dict:
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, fixed = sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        for s in over:
            fixed[s] = cap * sizes[s]
            left -= fixed[s]
        free -= over
    return fixed


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)


def test_targets_and_taken_words(spark):
    rows = [(i, "w " * (1 + i * 37 % 300), f"s{i % 7}") for i in range(200)] + [
        (200, None, None), (201, "a b c", None), (202, "", "tiny"), (203, "x", "tiny"), (203, "x", "tiny"), (None, "y z", "s1"),
    ]
    out = mixing.mix(corpus(spark, rows), block_words=64).collect()
    assert len(out) == len(rows)
    size = {}
    for r in out:
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
    wanted = brute_targets(size)
    taken = {}
    for r in out:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in wanted)
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.mix(corpus(spark, rows), block_words=64).collect()), key=repr)


def test_schedule_is_even_and_ranked(spark):
    docs = corpus(spark, [(i, "w " * 50, f"s{i % 3}") for i in range(300)])
    sizes = mixing.sized(docs)
    plan = mixing.draws(mixing.targets(sizes), 64)
    wanted = {r["source_key"]: r["slots"] for r in plan.collect()}
    steps = sorted(mixing.schedule(plan, 64).collect())
    assert len({r["step"] for r in steps}) == len(steps) == sum(wanted.values())
    seen = dict.fromkeys(wanted, 0)
    for n, r in enumerate(steps, 1):
        assert r["rank"] == seen[r["source_key"]]
        seen[r["source_key"]] += 1
        for s, total in wanted.items():  # every prefix of the schedule is near the weights
            assert abs(seen[s] - n * total / len(steps)) <= 8


@pytest.mark.parametrize("rows", [[], [(1, None, "a")], [(1, "", None), (2, "  ", "a")]])
def test_no_words(spark, rows):
    out = mixing.mix(corpus(spark, rows).withColumn("weight", mixing.F.lit(1))).collect()
    assert [(r["taken"], r["target"]) for r in out] == [(0, 0.0)] * len(rows)


def test_mixed_repeats_whole_documents(spark):
    docs = corpus(spark, [(i, f"w{i} " * 40, f"s{i % 3}") for i in range(90)] + [(99, "", "s0")])
    taken = {r["doc_id"]: int(r["taken"] / max(r["size"], 1) + 0.5) for r in mixing.mix(docs).collect()}
    found = {}
    for r in mixing.mixed(docs).collect():
        assert r["text"] == f"w{r['doc_id']} " * 40
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + 1
    assert found == {i: n for i, n in taken.items() if n} and 99 not in found
