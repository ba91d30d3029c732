from __future__ import annotations

import random

import numpy as np
from touchstone.llm import lines

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def brute(rows: list[tuple[int, str]], least: int) -> dict[int, str]:
    """Every run of lines with `least` words or more, however long, against every earlier one."""
    seen: dict[tuple, tuple[int, int]] = {}
    out = {}
    for doc_id, text in sorted(rows):
        split = text.split("\n")
        held = [(n, s.strip(), len(s.split())) for n, s in enumerate(split) if s.split()]
        gone = set()
        for i in range(len(held)):
            for j in range(i + 1, len(held) + 1):
                if sum(h[2] for h in held[i:j]) >= least:
                    first = seen.setdefault(tuple(h[1] for h in held[i:j]), (doc_id, j - 1))
                    if first[0] != doc_id or i > first[1]:
                        gone.update(range(i, j))
        removed = {held[k][0] for k in gone}
        removed |= {n for k in gone if k + 1 in gone for n in range(held[k][0], held[k + 1][0])}
        out[doc_id] = "\n".join(s for n, s in enumerate(split) if n not in removed)
    return out


def words(prefix: str, n: int) -> str:
    return " ".join(f"{prefix}{i}" for i in range(n))


def test_whole_runs_and_tails_of_copies(spark):
    run = words("a", 60) + "\n" + words("b", 20)
    copy = "\n".join(words(c, n) for c, n in (("p", 30), ("q", 30), ("r", 30), ("s", 9)))
    rows = [(1, run + "\nx"), (2, "y\n" + run + "\nz"), (3, copy), (4, copy)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    assert {r["doc_id"]: r["kept"] for r in lines.deduplicate(docs).collect()} == {1: run + "\nx", 2: "y\nz", 3: copy, 4: ""}


def test_against_all_runs(spark):
    rng = random.Random(7)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(20)]
    rows = []
    for i in range(120):
        parts = [rng.choice(pool + ["", "  "]) for _ in range(rng.randint(0, 14))]
        if i > 9 and i % 3 == 0:
            other = rows[rng.randrange(i)][1].split("\n")
            a = rng.randint(0, len(other))
            parts[2:2] = other[a : a + rng.randint(1, 9)]
        rows.append((i, "\n".join(parts)))
    rows += [(200, rows[9][1]), (201, "\n".join(["x y z"] * 40)), (202, "\n".join(pool * 2))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(4)
    assert {r["doc_id"]: r["kept"] for r in lines.deduplicate(docs, 12).collect()} == brute(rows, 12)


def test_windows_rise_together():
    rng = np.random.default_rng(3)
    for _ in range(300):
        counts = rng.integers(1, 30, rng.integers(0, 25))
        first, last = lines.windows(counts, 50)
        assert (np.diff(first) >= 0).all() and (np.diff(last) >= 0).all()
        assert all(counts[a : b + 1].sum() >= 50 and min(counts[a + 1 : b + 1].sum(), counts[a:b].sum()) < 50 for a, b in zip(first, last, strict=True))
