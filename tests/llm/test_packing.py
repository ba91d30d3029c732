from __future__ import annotations

import zlib
from itertools import product
from string import ascii_lowercase

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from touchstone.llm import packing
from touchstone.llm.queries import tokenizer

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


ENCODER = packing.WordEncoder(tokenizer())
PLAIN = Tokenizer.from_file(tokenizer())


@given(st.text(alphabet=st.sampled_from("aBÉé,. ß\n\t\x1c\x85  'lls 12!-İΣ́😀<|endoftext|>"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_words_encode_like_the_whole_text(text):
    whole = PLAIN.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == whole


def test_plain_words_go_to_the_model_alone():
    letters = [c for c in map(chr, range(0x250)) if packing.PLAIN.fullmatch(c)]
    words = letters + [a + b for a in letters for b in letters[::5]] + ["Straßenbahn", "ÉLANÇÄ", "retitioning...", "x" * 300]
    encoder = packing.WordEncoder(tokenizer())
    whole = PLAIN.encode(" ".join(words), add_special_tokens=False).ids
    encoder.tokenizer = None
    encoder[b"..."] = np.array(PLAIN.encode("...").ids, "<u4").tobytes()
    assert np.frombuffer(encoder.encode(" ".join(words)), "<u4").tolist() == whole


def test_memory_of_words_stays_small():
    encoder = packing.WordEncoder(tokenizer())
    for first in ascii_lowercase[:18]:
        encoder.encode(" ".join(first + "".join(rest) for rest in product(ascii_lowercase, repeat=3)))
    assert len(encoder) + len(encoder.aside) <= 200_000
    words = "aaaa raab zzzz raab"
    assert np.frombuffer(encoder.encode(words), "<u4").tolist() == PLAIN.encode(words, add_special_tokens=False).ids


def test_least_squares_is_optimal():
    rng = np.random.default_rng(3)
    matrix = packing.patterns(12)
    assert (matrix.T @ np.arange(1, 13) == 12).all()
    for _ in range(5):
        wanted = rng.integers(0, 50, 12).astype(float)
        x = packing.fit(matrix, wanted)
        slope = matrix.T @ (matrix @ x - wanted)
        assert x.min() >= 0 and slope.min() > -1e-4 and abs(slope[x > 0]).max() < 1e-3


@pytest.mark.parametrize("seed", range(4))
def test_places_cover_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(64, rng.lognormal(2.2, 1.0, 3000).astype(int) + 1)
    counts = dict(zip(*[v.tolist() for v in np.unique(lengths, return_counts=True)], strict=True))
    sequences: dict = {}
    ranks = {length: [] for length in counts}
    for length, low, high, per, first, offset in packing.places(counts, 64, 16):
        for rank in range(low, high):
            ranks[length].append(rank)
            n, j = divmod(rank - low, per)
            sequences.setdefault(first + n, []).append((offset + j * length, length))
    assert all(sorted(ranks[length]) == list(range(n)) for length, n in counts.items())
    for held in sequences.values():
        ends = 0
        for offset, length in sorted(held):
            assert offset == ends
            ends += length
        assert ends <= 64
    assert len(sequences) <= 1.02 * lengths.sum() / 64 + 1


def test_packed_documents(spark):
    words = ["is", "and", "retitioning", "ouen", "Élan", "x9!"]
    texts = [" ".join(words[(i + j) % 6] for j in range(i * 7 % 90)) for i in range(120)] + [None, "", "word " * 400]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s", 0), (None, "a b", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("length", packing.F.lit("clash"))
    out = packing.pack(docs, tokenizer(), 128).collect()
    wanted = []
    for doc_id, text, *_ in rows:
        ids = PLAIN.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 128)):
            part = ids[at : at + 128]
            wanted.append((doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted([tuple(r)[:5] for r in out], key=repr) == sorted(wanted, key=repr)
    held: dict = {}
    for r in out:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 128
    assert len(held) <= -(-sum(r["length"] for r in out) // 128) + 2
    assert packing.pack(docs.limit(0), tokenizer()).collect() == []


def test_places_start_no_python_workers(spark):
    rows = packing.places({4096: 3, 1000: 9, 7: 20})
    table = packing.place_table(spark, rows)
    assert "ExistingRDD" not in table._jdf.queryExecution().toString()
    assert sorted(map(tuple, table.collect())) == sorted(rows)
    none = packing.place_table(spark, [])
    assert none.count() == 0 and none.dtypes == table.dtypes == [(c.split()[0], "bigint") for c in packing.PLACES.split(", ")]
