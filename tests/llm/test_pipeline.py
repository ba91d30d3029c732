from __future__ import annotations

import re
import zlib

import corpus_pipeline
import numpy as np
from test_lines import brute as without_repeated_lines
from test_near_join import brute as component_rows
from test_packing import PLAIN

from touchstone.llm import mixing
from touchstone.llm.common import documents, materialise
from touchstone.llm.lines import MIN_WORDS


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_against_brute_force(spark, folder):
    """Each stage on what its predecessor kept."""
    raw = documents(spark, folder)
    stages = dict(corpus_pipeline.STAGES)
    assert 4 <= len(stages) <= 5

    def step(name, docs):
        out = materialise(stages[name](spark, docs, folder), f"test-{name}")
        if name != "pack":
            assert out.columns == corpus_pipeline.COLUMNS
        return out

    known = step("known_language", raw)
    texts, before = rows_of(known), rows_of(raw)
    assert all(tuple(before[i]) == tuple(r) for i, r in texts.items())
    gone = before.keys() - texts.keys()
    assert all(not re.search(r"[^\W\d_]{30,}", before[i]["text"] or "") or len(gone) <= 2 for i in gone)

    cut = step("repeated_lines", known)
    wanted = without_repeated_lines([(i, r["text"]) for i, r in texts.items()], MIN_WORDS)
    assert {i: r["text"] for i, r in rows_of(cut).items()} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in rows_of(cut).values())

    single = step("near_copies", cut)
    found = component_rows(list(wanted.items()))
    assert sorted(rows_of(single)) == sorted(i for i, _, c in found if i == c)

    mix = step("mix_sources", single)
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(single).collect()}
    copies = {i: int(t / s + 0.5) for i, (t, s) in taken.items() if s and int(t / s + 0.5)}
    held: dict = {}
    for r in mix.collect():
        assert r["text"] == wanted[r["doc_id"]]
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + 1
    assert held == copies

    packed = step("pack", mix).collect()
    expected = []
    for r in mix.collect():
        ids = PLAIN.encode(r["text"], add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            expected.append((r["doc_id"], piece, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(tuple(r)[:5] for r in packed) == sorted(expected)
    assert len({r["sequence_id"] for r in packed}) <= -(-sum(r["length"] for r in packed) // 4096) + 2
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, folder).collect()) == sorted(expected)
