from __future__ import annotations

import random

import numpy as np

from touchstone.llm import licences

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
WORDS = ["".join(random.Random(i).choices("abcdefghilmnorst", k=3 + i % 6)) for i in range(500)] + ["the", "of", "under", "this", "and", "is"] * 5


def ordinary(rng, n):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


def test_features_keep_paragraphs_apart():
    raw = [b"One two three.\n\n  \nFour, FIVE", b"", "é x\none two three".encode()]
    start, end, owner, feature = licences.features(raw)
    data = b"\n".join(raw)
    assert [data[a:b].decode() for a, b in zip(start, end, strict=True)] == ["One two three.", "Four, FIVE", "é x", "one two three"]
    assert np.bincount(owner).tolist() == [6, 3, 3, 6]
    assert sorted(feature[owner == 0]) == sorted(feature[owner == 3])
    for nothing in ([], [b""], [b"\n\n"]):
        assert [len(x) for x in licences.features(nothing)] == [0, 0, 0, 0]


def test_held_out_accuracy_and_unknown():
    rng = random.Random(4)
    texts, classes = licences.variants([ordinary(rng, rng.randint(1, 60)) for _ in range(1500)])
    model = licences.fit(texts[: len(texts) * 3 // 4], classes[: len(texts) * 3 // 4])
    rest, truth = texts[len(texts) * 3 // 4 :], np.array(classes[len(texts) * 3 // 4 :])
    start, _, owner, feature = licences.features([t.encode() for t in rest])
    chances = model.probabilities(len(rest), owner, feature)
    assert (chances.argmax(axis=1) == truth).mean() > 0.95
    sure = (chances.max(axis=1) >= model.least) & (chances.argmax(axis=1) < licences.CLASSES.index(licences.UNKNOWN))
    assert (chances.argmax(axis=1) == truth)[sure].mean() > 0.95 and sure.sum() > 0.5 * (truth < 6).sum()


def test_report(spark):
    rng = random.Random(5)
    notices = [(f, t) for f, ts in licences.TEMPLATES.items() if f != licences.UNKNOWN for t in ts]
    rows, wanted = [], {}
    for i in range(120):
        parts = [ordinary(rng, rng.randint(1, 50)) for _ in range(rng.randint(0, 6))]
        family = ""
        if i % 4 == 0:
            family, notice = notices[i // 4 % len(notices)]
            parts.insert(rng.randint(0, len(parts)), notice)
        rows.append((i, "\n".join(parts)))
        wanted[i] = family
    rows += [(200, None), (201, ""), (202, "Licensed under the Wobble Gnarl License."), (203, "x " * 60_000), (None, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).withColumn("licences", licences.F.lit(1))
    out = licences.report(docs).collect()
    assert len(out) == len(rows)
    found = {r["doc_id"]: r for r in out}
    assert sum(found[i]["families"] == wanted[i] for i in wanted) >= 117
    assert not any(found[i]["families"] for i in wanted if not wanted[i])
    assert (found[202]["n_licences"], found[202]["n_unknown"]) == (0, 1)
    assert [(found[i]["n_paragraphs"], found[i]["spans"]) for i in (200, 201, 203)] == [(0, ""), (0, ""), (1, "")]
    kind, a, b = found[0]["spans"].split(":")
    assert rows[0][1].encode()[int(a) : int(b)].decode() == dict(notices)[kind] or kind == wanted[0]
    assert licences.report(docs.limit(0)).collect() == []
