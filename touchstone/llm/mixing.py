"""Mixing sources to target weights with a low-discrepancy schedule.

Each source is a stream of its documents in a shuffled order, cut into blocks of equally many words.
The schedule has one step for each block that is drawn. Steps are points of the van der Corput
sequence: step t has the point reverse_bits(t), and the source whose interval of the cumulative
weights holds that point is drawn. Over all 2^m steps every integer point occurs once, so each source
is drawn exactly as often as its interval is long, and evenly spread over the schedule. The slots of
a source are ranked by step; slot r draws block r of the source, again from the first after the last.

Cases: null and empty texts have size 0 and are never taken. A null source is a source of its own,
last in order. Repeated rows are documents of their own. No documents give no rows, and a
corpus without words gives targets and shares of 0. Only doc_id, text and source are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchstone.llm.common import WORD, materialise, position_key, running_total

BLOCK_WORDS = 1024
#: Steps that one row unfolds to at most.
CHUNK = 65_536


def sized(docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select(
        "doc_id", "source", position_key(F.col("source")).alias("source_key"), size.alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("shuffled"), *by,
    )


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """One row per source: source_size, weight, and the target after resharing what lies over the caps.

    The shares rise together, in proportion to the weights, until the caps of the sources leave
    nothing to share; sources that reach their cap stay there. In order of cap over weight, the level
    at a source is what the earlier caps leave, divided by the weights from there on; the first
    level that its own source can take is the final one.
    """
    totals = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    by_name, everything = Window.orderBy("source_key"), Window.partitionBy()
    cycle = F.array(*[F.lit(w) for w in weights])
    place = F.row_number().over(by_name)
    shares = totals.withColumn("weight", F.element_at(cycle, (place - 1) % len(weights) + 1).cast("bigint"))
    shares = shares.withColumn("limit", F.col("source_size") * cap).withColumn("ratio", F.col("limit") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "source_key")
    earlier = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - earlier) / later
    shares = shares.withColumn("level", level).withColumn("place", F.row_number().over(by_ratio))
    fits = F.when(F.col("level") <= F.col("ratio"), F.col("place"))
    final = F.min_by(F.col("level"), fits).over(everything)
    return shares.withColumn("target", F.least(F.col("limit").cast("double"), final * F.col("weight"))).select(
        "source_key", "source_size", "weight", "target"
    )


def draws(shares: DataFrame, block_words: int) -> DataFrame:
    """Adds what the schedule needs: words and blocks to draw, and where the source's interval starts."""
    size, quota = F.col("source_size"), F.col("quota")
    blocks = F.ceil(size / block_words)
    slots = F.when(size > 0, F.expr("quota div source_size") * blocks + F.ceil((quota % size) / block_words))
    drawn = shares.withColumn("quota", F.round("target").cast("bigint")).withColumn("blocks", blocks)
    drawn = drawn.withColumn("slots", F.coalesce(slots, F.lit(0)))
    before = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, -1)
    return drawn.withColumn("interval", F.coalesce(F.sum("slots").over(before), F.lit(0)))


def schedule(plan: DataFrame, block_words: int) -> DataFrame:
    """The steps: step, source_key, rank within the source, block, and words (fewer in a last block)."""
    total = plan.agg(F.sum("slots")).first()[0] or 0
    bits = max(1, int(total - 1).bit_length()) if total else 1
    chunks = plan.filter("slots > 0").withColumn("chunk", F.explode(F.expr(f"sequence(0, (slots - 1) div {CHUNK})")))
    spread = chunks.repartition("source_key", "chunk")
    last = f"least(slots - 1, (chunk + 1) * {CHUNK} - 1)"
    steps = spread.withColumn("point", F.explode(F.expr(f"sequence(interval + chunk * {CHUNK}, interval + {last})")))
    reversed_bits = F.conv(F.reverse(F.lpad(F.conv(F.col("point").cast("string"), 10, 2), bits, "0")), 2, 10)
    steps = steps.withColumn("step", reversed_bits.cast("bigint"))
    place = F.shiftright(F.col("step"), bits - 32) if bits > 32 else F.shiftleft(F.col("step"), 32 - bits)
    ranked = running_total(steps, "source_key", place, ["step"], F.lit(1), total)
    block = F.col("before") % F.col("blocks")
    start = F.expr("before div blocks") * F.col("source_size") + block * block_words
    words = F.least(F.lit(block_words), F.col("source_size") - block * block_words, F.col("quota") - start)
    return ranked.select("step", "source_key", F.col("before").alias("rank"), block.alias("block"), words.alias("words"))


def pieces(sizes: DataFrame, block_words: int, by: Sequence[str] = ()) -> DataFrame:
    """The documents in shuffled order, cut where blocks end: block, and words [start, stop) of the block."""
    place = F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("bigint")
    laid = running_total(sizes, "source_key", place, ["shuffled", "doc_id", "size", *by], F.col("size"), sizes.count())
    blocks = F.expr(f"IF(size > 0, sequence(before div {block_words}, (before + size - 1) div {block_words}), NULL)")
    cut = laid.withColumn("block", F.explode_outer(blocks))
    first = F.col("block") * block_words
    return cut.withColumn("start", F.greatest(F.col("before") - first, F.lit(0))).withColumn(
        "stop", F.least(F.col("before") + F.col("size") - first, F.lit(block_words))
    )


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, block_words: int = BLOCK_WORDS, by: Sequence[str] = ()) -> DataFrame:
    """Per document: doc_id, size, source_size, target of its source, taken (words, repeats counted), source, and
    the columns named in `by`, which tell documents of one doc_id apart."""
    sizes = materialise(sized(docs, by), "mix-sizes")
    shares = materialise(draws(targets(sizes, weights, cap), block_words), "mix-targets")
    steps = schedule(shares, block_words).select("source_key", "block", "words")
    overlap = F.greatest(F.least(F.col("stop"), F.coalesce("words", F.lit(0))) - F.col("start"), F.lit(0))
    drawn = pieces(sizes, block_words, by).join(steps, ["source_key", "block"], "left")
    row = ["source_key", "bucket", "seq", "doc_id", "source", "size", *by]
    taken = drawn.groupBy(*row).agg(F.coalesce(F.sum(overlap), F.lit(0)).cast("bigint").alias("taken"))
    return taken.join(shares, "source_key").select("doc_id", "size", "source_size", "target", "taken", "source", *by)


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, whole, each as often as the mix takes at least half of it; columns as given.

    Rows of one doc_id and text count together. Documents without words are never drawn and go.
    """
    marked = docs.withColumn("mix_mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    taken = mix(marked, by=["mix_mark"], **settings).filter("taken > 0").groupBy(F.col("doc_id").alias("mix_id"), "mix_mark")
    copies = taken.agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("mix_copies")).filter("mix_copies > 0")
    same = docs["doc_id"].eqNullSafe(copies["mix_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == copies["mix_mark"])
    kept = docs.join(copies, same)
    return kept.withColumn("mix_copies", F.explode(F.expr("sequence(1, mix_copies)"))).select(*[docs[c] for c in docs.columns])
