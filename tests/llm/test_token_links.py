"""Linked tokens against a plain count over all documents."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from touchstone.llm import token_links
from touchstone.llm.queries import QUERIES

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
A, B, SHOWN = token_links.sides(*PATHS)
SCHEMA = "doc_id BIGINT, text STRING"
PLAIN = Tokenizer.from_file(PATHS[0])
PLAIN.encode_special_tokens = True


def grouped(text: str | None):
    """Groups of ids, and links, of one text, byte by byte."""
    if not text:
        return [], []
    raw = b" " + text.encode()
    ids = [side.encode([text])[0] for side in (A, B)]
    if any(b"".join(side.tokens[i] for i in own) != raw for side, own in zip((A, B), ids)):
        return [], []
    ends = []
    for side, own in zip((A, B), ids):
        at, found = 0, []
        for i in own:
            at += len(side.tokens[i])
            found.append(at)
        ends.append(found)
    shared = sorted(set(ends[0]) & set(ends[1]))
    groups, links, last = [], [], 0
    for end in shared:
        group = [[i for i, e in zip(own, places) if last < e <= end] for own, places in zip(ids, ends)]
        groups.append(group)
        links += [(i, j) for i, e in zip(ids[0], ends[0]) if e == end for j, f in zip(ids[1], ends[1]) if f == end]
        last = end
    return groups, links


def expected(rows):
    parsed = [(doc_id, *grouped(text)) for doc_id, text in rows]
    counts = Counter(link for _, _, links in parsed for link in links)
    most = defaultdict(int)
    for (_, right), n in counts.items():
        most[right] = max(most[right], n)
    out = []
    for doc_id, groups, links in parsed:
        text = ";".join("|".join(",".join(map(str, side)) for side in group) for group in groups)
        out.append((
            doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
            sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), text,
        ))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def digested(rows):
    return sorted([(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in rows], key=repr)


@pytest.fixture
def small_runs(monkeypatch):
    """Settings travel to the tasks with the module, so the tests call the functions that tasks run."""
    monkeypatch.setattr(token_links, "RUN_LINKS", 200)
    monkeypatch.setattr(token_links, "FRAME", 16)


def test_query_against_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.schema(SCHEMA).parquet(f"{folder}/documents.parquet").collect()]
    assert rows_of(QUERIES["op12_token_links"](spark, folder)) == digested(expected(rows))


def test_odd_rows(spark):
    """Nulls, ids past 2^53 beside a null, repeated rows, special tokens, odd characters, other columns."""
    texts = [
        None, "", " ", "a", "  two  spaces ", "<|endoftext|> </s> <unk> <0x41>", "é ça 日本語 😀 \x00 \n\t\r\n x", "low ▁ line", "word " * 3000,
        "x" * 5000, "the cat sat", "the cat sat", "ﬁ ① İ",
    ]
    rows = [(2**53 + 1 + 2 * i if i % 3 else None, t) for i, t in enumerate(texts)] + [(7, "the cat sat")] * 3
    wide = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", run INT, groups STRING")
    assert rows_of(token_links.align(wide, *PATHS)) == expected(rows)
    nothing = [(1, None), (2, "")]
    assert rows_of(token_links.align(spark.createDataFrame(nothing, SCHEMA), *PATHS)) == expected(nothing)
    assert token_links.align(spark.createDataFrame([], SCHEMA), *PATHS).count() == 0


@given(st.lists(st.sampled_from(["ab", " ", "  ", "é", "\n", "'s", "12", "日本", ".", " ", "x y"]), max_size=40))
@settings(max_examples=200, deadline=None)
def test_long_texts_are_cut_between_tokens(parts):
    text = "".join(parts)
    slice_, token_links.SLICE = token_links.SLICE, 3
    try:
        parts = list(token_links.stretches(text)) if text else []
    finally:
        token_links.SLICE = slice_
    assert " ".join(parts) == text
    for side in (A, B):
        assert [i for p in parts for i in side.encode([p])[0]] == (side.encode([text])[0] if text else [])


@given(st.text(alphabet=st.sampled_from("aB'sédñ ßÀÿ12 \n\t.,!-_<|>ſ²½\x1c\x85\xa0日😀\u0345"), max_size=40))
@settings(max_examples=400, deadline=None)
def test_words_have_the_ids_that_texts_have(text):
    whole = PLAIN.encode(" " + text, add_special_tokens=False).ids
    assert A.encode([text, text]) == [whole, whole]


def test_plain_words_are_split_without_unicode_tables():
    plain = "".join(c for c in map(chr, range(0x250)) if token_links.PLAIN.fullmatch(c))
    letters = [c for c in plain if re.fullmatch(f"[{token_links.LETTERS}]", c)]
    assert letters == [c for c in plain if unicodedata.category(c)[0] == "L"]
    assert [c for c in plain if unicodedata.category(c)[0] == "N"] == list("0123456789")
    assert isinstance(token_links.WORDS, re.Pattern)


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(token_links, "KNOWN_WORDS", 3)
    texts = [f"one two{i} three " + "x" * 50 for i in range(9)]
    assert [A.encode([t])[0] for t in texts] == [PLAIN.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_runs_and_merges(small_runs):
    """Many small runs of small frames give the same counts as one count over all links."""
    rng = np.random.default_rng(2)
    sources, every = [], Counter()
    for _ in range(9):
        pairs = np.sort(token_links.paired(rng.integers(0, 5, 300), rng.integers(0, 40, 300)))
        places = np.arange(300, dtype=np.uint64)
        times = rng.integers(1, 4, 300).astype(np.uint64)
        sources.append(token_links.framed(pairs, places, times))
        for p, t in zip(pairs.tolist(), times.tolist()):
            every[p] += t
        assert len(list(token_links.unpacked(sources[-1], 3))) > 10
    found = token_links.count_pairs(pa.table({"records": pa.array(sources, pa.binary())}))
    pairs, times = found.column("pair").to_pylist(), found.column("times").to_pylist()
    assert pairs == sorted(pairs) and dict(zip(pairs, times)) == every


def test_frequent_words_are_spread_over_merges(spark, monkeypatch):
    """Many merges, each with a share of one pair that every document has."""
    monkeypatch.setattr(token_links, "MERGED_RUNS", 1)
    rows = [(i, "the the the " + "abc xyz"[: i % 8]) for i in range(400)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert rows_of(token_links.align(table, *PATHS)) == expected(rows)
