"""Secrets in texts: fixed patterns, and tokens that pass a battery of randomness tests.

A token is a run of at least MIN_LENGTH characters that encodings use. Its encoding is the smallest
alphabet that holds all its characters. Three tests look at it:

* uniformity: the chi-squared statistic of its symbol counts. Under the hypothesis to reject, "an
  ordinary string", the statistic is non-central with length times the unevenness of ordinary
  strings, so its lower tail is the p-value, and short tokens can't reach a small one;
* runs above and below the middle of the alphabet, and the serial correlation of neighbours: a
  token that either calls not random at GATE has the p-value 1.

Benjamini-Hochberg control at RATE, within each class of lengths over the tokens of the whole
corpus, decides which tokens are reported. p-values are rounded up to a fixed grid for that, so the
histogram that reaches the driver has a fixed number of entries.

Cases: null and empty texts have no spans. Repeated rows are scanned each. No documents give no
rows. Offsets are code points, ends exclusive. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchstone.llm.common import mapped, materialise, small_batches

#: The patterns of the contract, with the smallest whole match or group that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

MIN_LENGTH = 20
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % MIN_LENGTH)
GATE = 0.001
RATE = 0.01
#: Steps of the p-value grid per power of ten, and its last step.
STEPS, LAST = 50, 1000
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabet, and the sum of squared symbol shares in ordinary strings of that alphabet.
ENCODINGS = (
    (DIGITS + "abcdef", 0.12),
    (DIGITS + "ABCDEF", 0.12),
    (UPPER + "234567", 0.066),
    (UPPER + LOWER + DIGITS, 0.066),
    (UPPER + LOWER + DIGITS + "+/", 0.066),
    (UPPER + LOWER + DIGITS + "-_", 0.066),
)
FOUND = (
    "doc_id BIGINT, base ARRAY<STRUCT<start: INT, kind: INT, end: INT>>, "
    "tokens ARRAY<STRUCT<start: INT, end: INT, class: INT, step: INT>>"
)


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uneven_tail(statistic: float, freedom: int, excess: float) -> float:
    """Lower tail of the non-central chi-squared distribution, by a scaled central one and its cube root."""
    scale = (freedom + 2 * excess) / (freedom + excess)
    degrees = (freedom + excess) ** 2 / (freedom + 2 * excess)
    spread = 2 / (9 * degrees)
    z = ((max(statistic, 1e-12) / (scale * degrees)) ** (1 / 3) - 1 + spread) / math.sqrt(spread)
    return 0.5 * math.erfc(-z / math.sqrt(2))


def encoding(token: str) -> tuple[str, float] | None:
    """The smallest alphabet that holds the token; None for plain numbers, and words without a digit."""
    held = set(token)
    if not held & set(DIGITS) or held <= set(DIGITS):
        return None
    return next(((a, s) for a, s in ENCODINGS if held <= set(a)), None)


def battery(token: str) -> float | None:
    """The p-value against "an ordinary string"; None if no test applies."""
    kind = encoding(token)
    if kind is None:
        return None
    alphabet, squares = kind
    size, n = len(alphabet), len(token)
    codes = np.array([alphabet.index(c) for c in token])
    counts = np.bincount(codes, minlength=size)
    statistic = float(((counts - n / size) ** 2).sum() * size / n)
    p = uneven_tail(statistic, size - 1, n * (size * squares - 1))
    upper = codes >= size / 2
    above, below = int(upper.sum()), n - int(upper.sum())
    if not above or not below:
        return 1.0
    runs = 1 + int((upper[1:] != upper[:-1]).sum())
    mean = 1 + 2 * above * below / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = normal_tail((runs - mean) / math.sqrt(variance)) if variance > 0 else 1.0
    centred = codes - codes.mean()
    spread = float((centred**2).sum())
    p_serial = normal_tail((float((centred[1:] * centred[:-1]).sum()) / spread + 1 / n) * math.sqrt(n)) if spread else 0.0
    return 1.0 if min(p_runs, p_serial) < GATE / 2 else p


def step(p: float) -> int:
    """The place of a p-value on the grid, rounded towards 1."""
    return min(LAST, int(-math.log10(max(p, 1e-300)) * STEPS))


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return sorted(spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def tested_tokens(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Tokens outside the fixed spans: start, end, class of length, place of the p-value."""
    found = []
    for m in TOKEN.finditer(text):
        if any(s <= m.start() and m.end() <= e for s, _, e in spans):
            continue
        p = battery(m[0])
        if p is not None:
            found.append((m.start(), m.end(), (m.end() - m.start()).bit_length(), step(p)))
    return found


def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            text = text if isinstance(text, str) else ""
            spans = fixed_spans(text)
            base = [{"start": s, "kind": k, "end": e} for s, k, e in spans]
            tokens = [{"start": s, "end": e, "class": c, "step": p} for s, e, c, p in tested_tokens(text, spans)]
            rows.append((doc_id, base, tokens))
        yield pd.DataFrame(rows, columns=["doc_id", "base", "tokens"])


def thresholds(histogram: list[tuple[int, int, int]], rate: float = RATE) -> dict[int, int]:
    """Benjamini-Hochberg from (class, step, count): the smallest step that is reported, by class."""
    least = {}
    for group in {c for c, _, _ in histogram}:
        steps = sorted(((s, n) for c, s, n in histogram if c == group), reverse=True)
        total, seen = sum(n for _, n in steps), 0
        for s, n in steps:
            seen += n
            if 10 ** (-s / STEPS) <= rate * seen / total:
                least[group] = s
    return least


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per document: doc_id, base and found (arrays of start, kind number, end), in order."""
    small_batches(docs.sparkSession)
    found = materialise(mapped(docs.select("doc_id", "text"), look, FOUND), "secret-tokens")
    counts = found.select(F.explode("tokens").alias("t")).groupBy("t.class", "t.step").count()
    least = thresholds([tuple(r) for r in counts.collect()], rate)
    bounds = F.create_map(*[F.lit(x) for pair in least.items() for x in pair]) if least else F.create_map(F.lit(0), F.lit(0))
    reported = F.filter("tokens", lambda t: t["step"] >= F.coalesce(F.element_at(bounds, t["class"]), F.lit(LAST + 1)))
    added = F.transform(
        reported, lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), t["end"].alias("end"))
    )
    return found.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("found"))


def listed(spans: str):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    )


def report(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    spans = scan(docs, rate)
    number = [
        F.expr(f"CAST(size(filter(found, s -> s.kind = {k})) AS BIGINT)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)
    ]
    return spans.select("doc_id", *number, F.sha2(listed("base"), 256).alias("base_sha256"), listed("found").alias("spans"))
