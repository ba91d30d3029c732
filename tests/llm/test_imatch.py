from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
import xxhash

from touchstone.llm import imatch

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
WORDS = ["w" + "".join(random.Random(i).choices("abcdefghij", k=4)) for i in range(400)]


def signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def term(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode(), 42)


def subsets(word: str) -> set[int]:
    out = set()
    for i, size in enumerate(imatch.SIZES):
        cell = signed(xxhash.xxh64_intdigest(size.to_bytes(4, "little"), xxhash.xxh64_intdigest(term(word).to_bytes(8, "little"), 42))) % size
        if cell < imatch.SUBSETS:
            out.add(cell + i * imatch.SUBSETS)
    return out


def terms(text: str) -> set[str]:
    return set(re.split(r"[\x20\x09-\x0D]+", text.lower())) - {""}


def expected(rows, band):
    """Edits, and likeness from the sets of terms themselves."""
    documents = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    counts: dict = {}
    for _, text in rows:
        for t in terms(text or ""):
            counts[t] = counts.get(t, 0) + 1
    least, most = max(2, len(rows) * math.exp(-band[1])), len(rows) * math.exp(-band[0])
    kept = {t: subsets(t) for t, n in counts.items() if least <= n <= max(most, least)}

    def slots(text):
        out: list[set] = [set() for _ in range(imatch.ALL)]
        for t in terms(text) & kept.keys():
            for k in kept[t]:
                out[k].add(t)
        return out

    def like(a, b):
        sa, sb = slots(a), slots(b)
        informative = [k for k in range(imatch.ALL) if sa[k] or sb[k]]
        if not informative:
            return float(terms(a) == terms(b))
        for i in reversed(range(len(imatch.SIZES))):
            own = [k for k in informative if k // imatch.SUBSETS == i]
            if len(own) >= imatch.ENOUGH:
                return sum(sa[k] == sb[k] for k in own) / len(own)
        return sum(sa[k] == sb[k] for k in informative) / len(informative)

    out = {}
    for i, (doc_id, text) in enumerate(documents):
        text, after = text or "", documents[(i + 1) % len(documents)][1] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        out[doc_id] = (len(text), hashlib.sha256(edit.encode()).hexdigest(), like(text, edit), like(text, after))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i * 3, " ".join(rng.choices(WORDS, k=rng.randint(1, 150)))) for i in range(120)]
    rows += [(1000, rows[5][1]), (1001, None), (1003, ""), (1004, "  \n"), (1005, "😀é nowhere else " * 2000), (None, "Wx " + rows[7][1]), (2000, rows[9][1]), (2000, rows[9][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumn("key", imatch.F.lit("clash")).repartition(5)
    band = (math.log(1.5), math.log(60))
    out = imatch.report(docs, band).collect()
    wanted = expected(rows, band)
    assert len(out) == len(wanted)
    for r in out:
        n, sha, edited, following = wanted[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert r["near_edited"] == pytest.approx(edited) and r["near_next"] == pytest.approx(following)
    found = {r["doc_id"]: r["fingerprint"] for r in out}
    assert found[15] == found[1000] and found[27] == found[2000] and found[1001] == found[1003] == found[1004]
    assert len(set(found.values())) >= 118


@pytest.mark.parametrize("rows", [[], [(1, "a b c d")], [(1, None)]])
def test_few_documents(spark, rows):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    assert [(r["near_edited"] in (0.0, 1.0), r["near_next"]) for r in imatch.report(docs).collect()] == [(True, 1.0)] * len(rows)
