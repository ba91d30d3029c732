"""I-Match fingerprints with randomised lexicons, in DataFrame operations only.

The lexicon is the set of terms whose inverse document frequency over all documents lies in a band.
Subsets of it are drawn by the hash of the term: SUBSETS at each of several sizes, 1/16 of the
lexicon down to 1/1024. A text's distinct terms in a subset are sorted and hashed; the fingerprint
lists these hashes, and nothing where the text has no such term. Two fingerprints are as alike as the
share of subsets that agree, of those that either has, at the smallest size that has ENOUGH of them:
large subsets tell equal texts, small ones tell how many terms two texts share.

Terms are lower-case words. A text without a term of the lexicon has the hash of all its terms
instead, and is like its equals only.

Cases: null texts are empty. Rows with the same doc_id and text count as one document. The next
document of the last is the first, so a lone document is next to itself. A null doc_id comes last.
No documents give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchstone.llm.common import materialise

#: The band: a term of the lexicon is in one of 20 to one of 500 documents, and in two at least. Each
#: document adds less than its number of distinct terms to all counts, so the lexicon has at most 500
#: times the mean of that number of terms, however many documents there are.
IDF_BAND = (math.log(20), math.log(500))
SUBSETS = 16
SIZES = (16, 64, 256, 1024)
ENOUGH = 4
ALL = SUBSETS * len(SIZES)


def words(text: Column) -> Column:
    """Distinct terms; the empty one stands for the text itself."""
    return F.array_union(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), F.array(F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64(text)))
    return docs.select("doc_id", text.alias("text"), key.alias("key"))


def next_documents(documents: DataFrame) -> DataFrame:
    """key, next_key, and half: how many code points an edit takes from the next document."""
    half = F.floor(F.length("text") / 2).cast("int")
    listed = documents.select("key", "doc_id", half.alias("half")).distinct()
    ordered = listed.orderBy(F.desc_nulls_last("doc_id"), F.desc("key")).select("key", "half")
    placed = materialise(ordered.withColumn("place", F.monotonically_increasing_id()), "imatch-order")
    part, index = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.select("key", "half", part.alias("part"), index.alias("index"))
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    ranked = numbered.join(starts, "part").select("key", "half", (F.col("start") + F.col("index")).alias("rank"))
    total = max(1, placed.count())
    follows = ranked.select(F.col("key").alias("next_key"), ((F.col("rank") - 1 + total) % total).alias("rank"))
    return ranked.join(follows, "rank").select("key", "next_key", "half")


def lexicon(documents: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """term (its hash) and subset, for every subset that holds the term."""
    terms = documents.select(F.explode(words(F.col("text"))).alias("word")).select(F.xxhash64("word").alias("term"))
    counts = terms.groupBy("term").agg(F.count("*").alias("n"))
    total = max(1, documents.count())
    least, most = max(2.0, total * math.exp(-band[1])), total * math.exp(-band[0])
    kept = counts.filter(F.col("n").between(least, max(most, least)) & (F.col("term") != F.xxhash64(F.lit(""))))
    cells = [F.pmod(F.xxhash64("term", F.lit(size)), F.lit(size)) for size in SIZES]
    member = F.array(*[F.when(c < SUBSETS, (c + i * SUBSETS).cast("int")) for i, c in enumerate(cells)])
    subsets = kept.select("term", F.explode(F.array_compact(member)).alias("subset"))
    itself = documents.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("term"), F.lit(ALL).alias("subset"))
    return subsets.union(itself)


def edited(documents: DataFrame, nexts: DataFrame) -> DataFrame:
    """Each document with its edited text: the last half replaced by the start of the next document.

    Both joins read the same columns of the documents, so they share one shuffle of the texts.
    """
    heads = documents.join(nexts.withColumnRenamed("key", "of").withColumnRenamed("next_key", "key"), "key").select(
        F.col("of").alias("key"), F.expr("substring(text, 1, half)").alias("head"), "half",
        F.col("key").alias("next_key"), F.col("doc_id").alias("next_doc_id"),
    )
    both = documents.join(heads, "key")
    return both.withColumn("edited", F.expr("concat(substring(text, 1, length(text) - half), head)"))


def fingerprints(documents: DataFrame, nexts: DataFrame, terms: DataFrame) -> DataFrame:
    """key, next_key, doc_id, n_chars, edited_sha256, and for both texts the subset hashes and the hash of all terms."""

    def all_terms(text: str) -> Column:
        return F.xxhash64(F.array_sort(words(F.col(text))))

    about = F.struct(
        "doc_id", "next_key", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        all_terms("text").alias("whole"), all_terms("edited").alias("edited_whole"), "next_doc_id",
    )
    rows = edited(documents, nexts).select("key", about.alias("about"), F.array("text", "edited").alias("texts"))
    texts = rows.select("key", "about", F.posexplode("texts").alias("which", "text"))
    found = texts.select("key", "about", "which", F.explode(words(F.col("text"))).alias("word")).select(
        "key", "which", F.when(F.col("word") == "", F.col("about")).alias("about"), F.xxhash64("word").alias("term")
    )
    members = found.join(F.broadcast(terms), "term")
    sets = members.groupBy("key", "which", "subset").agg(
        F.hash(F.array_sort(F.collect_set("term"))).alias("hash"), F.first("about", ignorenulls=True).alias("about")
    )
    held = F.col("subset") < ALL
    entries = [F.collect_list(F.when(held & (F.col("which") == w), F.struct("subset", "hash"))) for w in (0, 1)]
    whole = sets.groupBy("key").agg(
        F.first("about", ignorenulls=True).alias("about"), entries[0].alias("own"), entries[1].alias("other")
    )
    slots = [
        F.expr(f"transform(sequence(0, {ALL - 1}), i -> try_element_at(map_from_entries({c}), i))").alias(c)
        for c in ("own", "other")
    ]
    return whole.select("key", "about.*", *slots)


def shown(slots: str, whole: str) -> Column:
    """A fingerprint as text: subset hashes in order, empty where there is none; else the hash of all terms."""
    listed = F.expr(f"concat_ws('.', transform({slots}, h -> coalesce(lower(hex(h & 4294967295L)), '')))")
    return F.when(F.expr(f"exists({slots}, h -> h IS NOT NULL)"), listed).otherwise(F.concat(F.lit("x"), F.hex(whole)))


def likeness(a: str, b: str, whole_a: str, whole_b: str) -> Column:
    """The share of agreeing subsets, of 0 to 1."""

    def share(first: int, n: int) -> tuple[Column, Column]:
        pairs = f"zip_with(slice({a}, {first}, {n}), slice({b}, {first}, {n}), (x, y) -> "
        some = F.expr(f"size(filter({pairs} x IS NOT NULL OR y IS NOT NULL), v -> v))")
        same = F.expr(f"size(filter({pairs} coalesce(x = y, false)), v -> v))")
        return some, same / some

    overall, part = share(1, ALL)
    out = F.when(overall == 0, (F.col(whole_a) == F.col(whole_b)).cast("double")).otherwise(part)
    for i in range(len(SIZES)):
        some, part = share(i * SUBSETS + 1, SUBSETS)
        out = F.when(some >= ENOUGH, part).otherwise(out)
    return out


def report(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_doc_id."""
    documents = keyed(docs)
    terms = materialise(lexicon(documents, band), "imatch-lexicon")
    prints = materialise(fingerprints(documents, next_documents(documents), terms), "imatch-prints")
    following = prints.select(F.col("key").alias("next_key"), F.col("own").alias("next_own"), F.col("whole").alias("next_whole"))
    return prints.join(following, "next_key").select(
        "doc_id", "n_chars", "edited_sha256", shown("own", "whole").alias("fingerprint"),
        shown("other", "edited_whole").alias("edited_fingerprint"),
        likeness("own", "other", "whole", "edited_whole").alias("near_edited"),
        likeness("own", "next_own", "whole", "next_whole").alias("near_next"), "next_doc_id",
    )
