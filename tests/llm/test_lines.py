from __future__ import annotations

import random

from touchstone.llm import lines

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def brute(rows: list[tuple[int, str | None]], least: int) -> dict[int, str | None]:
    """Every run of lines with `least` words or more, however long, against every earlier one, in order of doc_id."""
    seen: dict[tuple, tuple[int, int]] = {}
    out: dict[int, str | None] = {}
    for doc_id, text in sorted(rows):
        if text is None:
            out[doc_id] = None
            continue
        split = text.split("\n")
        held = [(n, s.strip(" \t\r\x0b\x0c"), len(s.split())) for n, s in enumerate(split) if s.split()]
        gone = set()
        for i in range(len(held)):
            total, run, end = 0, 0, i
            for j in range(i, len(held)):
                total, run = total + held[j][2], hash((run, held[j][1]))
                if total >= least:
                    first = seen.setdefault((run, j - i), (doc_id, j))
                    if first[0] != doc_id or i > first[1]:
                        end = j + 1
            gone.update(range(i, end))
        removed = {held[k][0] for k in gone}
        removed |= {n for k in gone if k + 1 in gone for n in range(held[k][0], held[k + 1][0])}
        out[doc_id] = "\n".join(s for n, s in enumerate(split) if n not in removed)
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(25)]
    passage = [" ".join(rng.choices("abcdefgh", k=12)) for _ in range(6)]
    long = " ".join(rng.choices("abcdefgh", k=60))
    rows: list[tuple[int, str | None]] = []
    for i in range(150):
        parts = [rng.choice(pool + ["", "  "]) for _ in range(rng.randint(0, 14))]
        if i % 3 == 0:
            a = rng.randint(0, 3)
            parts[2:2] = passage[a : a + rng.randint(1, 6)]
        if i % 4 == 0:
            parts.insert(rng.randint(0, len(parts)), " " + long + "\r")
        rows.append((i, "\n".join(parts)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, rows[9][1]), (204, "\n".join(["x y z"] * 40)), (205, "\n".join([long] * 4)), (206, "q " * 40_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumn("found", lines.F.lit("clash"))
    out = lines.deduplicate(docs.repartition(4), 12).collect()
    assert {r["doc_id"]: r["kept"] for r in out} == brute(rows, 12)
    assert sum(r["n_removed"] for r in out) > 100
    assert lines.deduplicate(docs.limit(0)).collect() == []


def test_ties_and_null_ids(spark):
    line = " ".join(str(i) for i in range(60))
    rows = [(None, line), (3, line), (3, line), (3, line + "\nend"), (2, "x\n" + line)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    out = sorted((r["doc_id"] or 99, r["kept"]) for r in lines.deduplicate(docs).collect())
    assert out == [(2, "x\n" + line), (3, ""), (3, ""), (3, "end"), (99, "")]
