"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a bounded sample of labelled text. A
text is parsed against it from left to right: the longest match that occurs in the sample is one
phrase, and the next phrase starts behind it. The language that needs the fewest phrases for each
symbol wins. Texts are parsed in stretches of STRETCH symbols, all at once and in step, so a phrase
also ends where a stretch does, alike for every language.

Symbols are lower-case letters; everything else separates, and separators in a row count once. The
alphabet has a fixed size: letters beyond the most frequent of the sample share hashed symbols.

Cases: a null text, or one without a letter, is `und` with score 0, as is everything if no labelled
row is left to learn from. Ties go to the language that is first by code point. Repeated rows count
each. No documents give no rows. Only doc_id, text and (to learn) lang are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchstone.llm.common import mapped, small_batches

UNKNOWN = "und"
#: Bounds of the sample: documents of a language, characters of a document, and characters in all.
SAMPLE_DOCS, SAMPLE_DOC_CHARS, SAMPLE_CHARS = 64, 2_000, 120_000
#: Symbols: a separator, frequent letters, hashed letters, and a filler that leaves every state as it is.
SYMBOLS, HASHED = 64, 14
SEPARATOR, FILLER = 0, SYMBOLS - 1
STRETCH = 256
#: Stretches that are parsed at once.
LANES = 4096
PREDICTED = "doc_id BIGINT, lang_pred STRING, score DOUBLE, phrase_rate DOUBLE, n_symbols BIGINT, accepted BOOLEAN"
#: A text of at least so many symbols is rejected if it takes over this part of the phrases that
#: shuffled letters of its language take.
JUDGED_SYMBOLS, NOISE_PART = 100, 0.95


def held_out(doc_id: Column, parts: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 0


def sample(docs: DataFrame) -> dict[str, str]:
    """A bounded text per language, from the labelled documents with the smallest hashes."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "text")
    leading = labelled.select("lang", "doc_id", F.substring("text", 1, SAMPLE_DOC_CHARS).alias("text"))
    chosen = leading.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE_DOCS)
    texts: dict[str, list[str]] = {}
    for row in sorted(chosen.collect(), key=lambda r: (r["lang"], r["place"])):
        texts.setdefault(row["lang"], []).append(row["text"])
    share = SAMPLE_CHARS // max(1, len(texts))
    return {lang: "\n".join(parts)[:share] for lang, parts in sorted(texts.items())}


def alphabet(texts: dict[str, str]) -> np.ndarray:
    """The symbol of every code point: separator, own symbol for frequent letters, else a hashed one."""
    counts = Counter(c for text in texts.values() for c in text.lower() if c.isalpha())
    own = FILLER - 1 - HASHED
    frequent = sorted(counts, key=lambda c: (-counts[c], c))[:own]
    symbols = np.array([own + 1 + n % HASHED if chr(n).isalpha() else SEPARATOR for n in range(0x110000)], dtype=np.uint8)
    symbols[[ord(c) for c in frequent]] = np.arange(1, len(frequent) + 1)
    return symbols


def encoded(text: str, symbols: np.ndarray) -> np.ndarray:
    codes = symbols[np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")]
    repeated = np.zeros(len(codes), dtype=bool)
    repeated[1:] = (codes[1:] == SEPARATOR) & (codes[:-1] == SEPARATOR)
    return codes[~repeated]


def automaton(sequence: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton, state 0 first."""
    moves: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for symbol in sequence:
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at >= 0:
            found = moves[at][symbol]
            if longest[found] == longest[at] + 1:
                link[new] = found
            else:
                copy = len(moves)
                moves.append(dict(moves[found]))
                longest.append(longest[at] + 1)
                link.append(link[found])
                while at >= 0 and moves[at].get(symbol) == found:
                    moves[at][symbol] = copy
                    at = link[at]
                link[found] = link[new] = copy
        last = new
    return moves


def table(sequence: list[int]) -> np.ndarray:
    """Next state (times SYMBOLS) by state and symbol. Where the match ends, the complement of the state
    after a phrase that begins with the symbol. The last state is a phrase of one unknown symbol."""
    moves = automaton(sequence)
    moves.append({})
    first = np.full(SYMBOLS, (len(moves) - 1) * SYMBOLS, dtype=np.int32)
    for symbol, state in moves[0].items():
        first[symbol] = state * SYMBOLS
    out = np.tile(~first, (len(moves), 1))
    out[0] = first
    for state, targets in enumerate(moves):
        for symbol, target in targets.items():
            out[state, symbol] = target * SYMBOLS
    out[:, FILLER] = np.arange(len(moves)) * SYMBOLS
    return out.ravel()


def phrases(lanes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Phrases of each row of symbols."""
    steps = np.ascontiguousarray(lanes.T)
    state = np.zeros(len(lanes), dtype=np.int32)
    count = np.ones(len(lanes), dtype=np.int32)
    for symbols in steps:
        found = moves.take(state + symbols)
        ended = found >> 31
        count -= ended
        state = found ^ ended
    return count


def parsed(texts: list[np.ndarray], tables: list[np.ndarray]) -> np.ndarray:
    """Phrases by text and language."""
    whole = [-(-max(1, len(t)) // STRETCH) for t in texts]
    lanes = np.full((sum(whole), STRETCH), FILLER, dtype=np.uint8)
    flat, at = lanes.ravel(), 0
    for text, n in zip(texts, whole, strict=True):
        flat[at : at + len(text)] = text
        at += n * STRETCH
    starts = np.r_[0, np.cumsum(whole)[:-1]]
    return np.stack(
        [
            np.add.reduceat(np.concatenate([phrases(lanes[i : i + LANES], t) for i in range(0, len(lanes), LANES)]), starts)
            for t in tables
        ],
        axis=1,
    )


def noise_rates(texts: list[np.ndarray], tables: list[np.ndarray]) -> np.ndarray:
    """Phrases for each symbol that the shuffled sample of each language takes in that language."""
    shuffle = np.random.default_rng(0).permutation
    return np.array([parsed([shuffle(x)], [t])[0, 0] / max(1, len(x)) for x, t in zip(texts, tables, strict=True)])


def predictor(languages: list[str], symbols, tables, noise: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for mapInPandas; symbols and tables are broadcast."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [encoded(t, symbols.value) if isinstance(t, str) else np.zeros(0, np.uint8) for t in batch["text"]]
            size = np.array([len(t) for t in texts])
            known = np.array([bool(t.any()) for t in texts], dtype=bool) & bool(languages)
            names, score, rate = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts)), np.zeros(len(texts))
            rows = np.flatnonzero(known)
            if len(rows):
                counts = parsed([texts[i] for i in rows], tables.value)
                best = counts.argmin(axis=1)
                ordered = np.sort(counts, axis=1)
                names[rows] = np.array(languages, dtype=object)[best]
                score[rows] = 1 - ordered[:, 0] / ordered[:, 1] if len(languages) > 1 else 1.0
                rate[rows] = ordered[:, 0] / size[rows]
                noisy = (size[rows] >= JUDGED_SYMBOLS) & (rate[rows] > NOISE_PART * noise[best])
                known[rows[noisy]] = False
            found = {"lang_pred": names, "score": score, "phrase_rate": rate, "n_symbols": size, "accepted": known}
            yield batch.drop(columns="text").assign(**found)

    return run


def judged(docs: DataFrame, learn_from: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """PREDICTED per document, between doc_id and the rest the columns named in `by`, all of them long."""
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    texts = sample(learn_from)
    symbols = alphabet(texts)
    learned = [encoded(text, symbols) for text in texts.values()]
    tables = [table(text.tolist()) for text in learned]
    run = predictor(list(texts), context.broadcast(symbols), context.broadcast(tables), noise_rates(learned, tables))
    schema = PREDICTED.replace(",", "".join(f", {c} BIGINT" for c in by) + ",", 1)
    return mapped(docs.select("doc_id", *by, "text"), run, schema)


def predict(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (how far the second language falls behind), phrase_rate,
    n_symbols, and accepted: a language is known, and the text is not as unlike it as shuffled letters are."""
    found = judged(docs, learn_from if learn_from is not None else docs)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *found.columns[1:])


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose text is in a known language; columns as given.

    Documents are told apart by doc_id and a 64-bit hash of the text.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    known = judged(docs.withColumn("known_mark", mark), docs, ["known_mark"]).filter("accepted")
    kept = known.select(F.col("doc_id").alias("known_id"), "known_mark").distinct()
    same = docs["doc_id"].eqNullSafe(kept["known_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == kept["known_mark"])
    return docs.join(kept, same).select(*[docs[c] for c in docs.columns])
