"""Connected components by alternating stars, with every round written to the shared folder.

Each round hangs the larger neighbours of a node on its smallest neighbour, then the smaller ones too,
until all nodes of a component hang on its smallest. A hub with a third of all edges is one row per
edge throughout: minima are combined before the shuffle, and joins have a single row for a node on one
side, so adaptive execution can split the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchstone.session import materialise


def hung(pairs: DataFrame, keep_own: bool) -> DataFrame:
    """For nodes `a` with neighbours `b`: the neighbours, and with `keep_own` the node, each with the smallest of them all."""
    least = pairs.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    joined = pairs.join(least, "a")
    if keep_own:
        return joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).filter("a <> b")
    return joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node and component (its smallest node) for every end of the edges `a`, `b`.

    Nulls and edges of a node to itself are left out; no edges give no rows.
    """
    proper = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = materialise(proper.distinct(), f"{name}-edges")
    state = None
    while True:
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if not now[0] or now == state:
            break
        state = now
        both = stars.union(stars.select("b", "a"))
        larger = hung(both, keep_own=False).distinct()
        stars = materialise(hung(larger, keep_own=True).distinct(), f"{name}-stars")
    roots = stars.select(F.col("b").alias("node")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
