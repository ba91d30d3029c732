"""Documents whose word shingles overlap, by Jaccard similarity, joined and put into components.

Documents with equal shingle sets are one node. Two nodes can only be similar enough if the first
quarter of their shingles, in one order for all, have one in common; the order puts rare shingles
first, by a sketch of all counts, so that a passage many documents share is seldom looked at.
The nodes that share such a shingle are a group; large groups with the same two smallest nodes, which
mostly hold nearly the same nodes, are one. Within a group, only nodes whose sizes allow the
similarity meet, in tiles of bounded size; there a bitmap of hashed shingles bounds their overlap: each
shingle flips one bit, so two sets differ in at least as many shingles as their bitmaps in bits.
What passes is settled by intersecting the sorted sets themselves.

Links are only needed to tell components, so a large group does not hand on all its pairs. The texts of
its nodes come to the tile, which intersects the sets of pairs that no links found there join yet, and
hands on only the links that join: fewer than it has nodes.

Sets and shingles are told apart by 64-bit hashes.

Cases: null texts and texts without words have no shingles and are linked with nothing. Texts of fewer
than five words have one shingle. Repeated rows are equal nodes. A null doc_id never names a
component unless nothing else is in it. No documents give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from touchstone.llm.common import byte_slices, mapped, materialise, small_batches
from touchstone.llm.shingles import shingle_sets

#: The similarity, in per cent.
PERCENT = 75
SKETCH_BITS = 18
BUCKET_ENTRIES = 400_000
#: Nodes of a part of a group, and their shingles, on average; a tile is one part or two.
TILE_NODES = 1024
TILE_SHINGLES = 2_000_000
#: Groups up to this size hand on all pairs at once.
SMALL_GROUP = 8
#: Groups that one task call handles together, on average.
CALL_GROUPS = 2000
#: Shingles of the nodes that one task call settles together, on average.
CALL_SHINGLES = 250_000
#: Bits of the filter for texts: so many for each wanted text, and at most.
FILTER_BITS, FILTER_MOST = 16, 1 << 27
#: Groups in which arrays of fixed size are folded before the driver folds those of the groups.
PARTS = 64

NODES = "doc_id BIGINT, doc BIGINT, mark BIGINT, node BIGINT, size BIGINT, bitmap BINARY, counts BINARY"
ENTRIES = "bucket INT, shingles BINARY, nodes BINARY"
GROUPS = "gid BIGINT, nodes ARRAY<BIGINT>"
PAIRS = "a BIGINT, b BIGINT"
OPEN = "gid BIGINT, part INT, one INT, two INT, node BIGINT, size BIGINT"
NO_ID = -(1 << 63)


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def node_of(shingles: np.ndarray) -> int:
    return signed(xxhash.xxh3_64_intdigest(shingles.tobytes()))


def prefix_length(size: np.ndarray | int):
    """Shingles of which a similar set must have one: all but the overlap that is needed, and one."""
    return size - (size * PERCENT + 99) // 100 + 1


def bitmap(shingles: np.ndarray) -> bytes:
    """One bit flipped for each shingle, in a power of two of bits that the set about fills."""
    bits = max(64, 1 << int(len(shingles)).bit_length())
    flips = np.bincount((shingles >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The node of every document, and in the end one row with the sketch of all shingles of the task."""
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    names = ["doc_id", "doc", "mark", "node", "size", "bitmap", "counts"]
    for batch, raw in byte_slices(batches):
        sets = shingle_sets(raw)
        for s in sets:
            counts += np.bincount((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)) if len(s) > 4096 else 0
        small = [s for s in sets if len(s) <= 4096]
        if small:
            counts += np.bincount((np.concatenate(small) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        rows = [
            (i, d, m, node_of(s), len(s), bitmap(s), None)
            for i, d, m, s in zip(batch["doc_id"], batch["doc"], batch["mark"], sets, strict=True)
        ]
        yield pd.DataFrame(rows, columns=names)
    yield pd.DataFrame([(None, 0, 0, 0, 0, None, counts.tobytes())], columns=names)


def folded_rows(rows: DataFrame, column: str, dtype: type, fold: np.ufunc) -> np.ndarray | None:
    """Arrays of one fixed size, held in `column`, folded into one: in PARTS groups first, then here."""

    def halfway(part: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(part[column].iloc[0], dtype)
        for data in part[column].iloc[1:]:
            total = fold(total, np.frombuffer(data, dtype))
        return pd.DataFrame({column: [total.tobytes()]})

    parts = rows.select(F.pmod(F.xxhash64(column), F.lit(PARTS)).alias("part"), column)
    total = None
    for row in parts.groupBy("part").applyInPandas(halfway, f"{column} BINARY").toLocalIterator():
        some = np.frombuffer(row[column], dtype)
        total = some if total is None else fold(total, some)
    return total


def rarity(table: DataFrame) -> np.ndarray:
    """For each cell of the sketch, the magnitude of its count over all documents. The size is fixed."""
    total = folded_rows(table.filter("counts IS NOT NULL"), "counts", np.int64, np.add)
    return np.log2(total + 1).astype(np.uint8) if total is not None else np.zeros(1 << SKETCH_BITS, np.uint8)


def entries(magnitude, buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas: the leading shingles of each node, packed by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = magnitude.value.astype(np.uint64)
        for _, raw in byte_slices(batches, 8 << 20):
            found: dict[int, np.ndarray] = {}
            for s in shingle_sets(list(dict.fromkeys(raw))):
                if len(s):
                    order = classes[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(56) | s >> np.uint64(8)
                    n = int(prefix_length(len(s)))
                    found.setdefault(node_of(s), s[np.argpartition(order, n - 1)[:n]] if n < len(s) else s)
            if not found:
                continue
            shingles = np.concatenate(list(found.values()))
            owners = np.repeat(np.array(list(found), dtype=np.int64), [len(s) for s in found.values()])
            bucket = (shingles % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            shingles, owners = shingles[order], owners[order]
            rows = [
                (n, shingles[a:b].tobytes(), owners[a:b].tobytes())
                for n, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))
                if b > a
            ]
            yield pd.DataFrame(rows, columns=["bucket", "shingles", "nodes"])

    return run


def groups(bucket: pd.DataFrame) -> pd.DataFrame:
    """The distinct sets of nodes that share a shingle of the bucket, nodes in order."""
    shingles = np.frombuffer(b"".join(bucket["shingles"]), np.uint64)
    owners = np.frombuffer(b"".join(bucket["nodes"]), np.int64)
    order = np.lexsort((owners, shingles))
    shingles, owners = shingles[order], owners[order]
    fresh = np.ones(len(shingles), dtype=bool)
    fresh[1:] = (shingles[1:] != shingles[:-1]) | (owners[1:] != owners[:-1])
    shingles, owners = shingles[fresh], owners[fresh]
    starts = np.flatnonzero(np.r_[True, shingles[1:] != shingles[:-1]])
    stops = np.r_[starts[1:], len(shingles)]
    several = stops - starts > 1
    found = {}
    for a, b in zip(starts[several].tolist(), stops[several].tolist(), strict=True):
        members = owners[a:b]
        found.setdefault(node_of(members), members)
    return pd.DataFrame({"gid": pd.Series(list(found), dtype="int64"), "nodes": pd.Series(list(found.values()), dtype=object)})


def folded(data: bytes, size: int) -> np.ndarray:
    """A bitmap brought down to `size` bytes; flips of both halves add up."""
    words = np.frombuffer(data, np.uint8)
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def passing(sizes: np.ndarray, bitmaps: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of nodes in order of size, that sizes and bitmaps allow to be similar."""
    left, right = [], []
    last = np.searchsorted(sizes, sizes * 100 // PERCENT, side="right")
    widths = np.array([len(b) for b in bitmaps])
    i = 0
    while i < len(sizes):
        same = i + int(np.searchsorted(widths[i:], widths[i], side="right"))  # nodes with as small bitmaps
        stop = int(last[same - 1])
        maps = np.stack([folded(b, int(widths[i])) for b in bitmaps[i:stop]]).view(np.uint64)
        for n in range(i, same):
            if last[n] > n + 1:
                differ = np.bitwise_count(maps[n + 1 - i : last[n] - i] ^ maps[n - i]).sum(axis=1, dtype=np.int64)
                both = sizes[n] + sizes[n + 1 : last[n]]
                overlap = (both - differ) // 2
                ok = np.flatnonzero(100 * overlap >= PERCENT * (both - overlap))
                left.append(np.full(len(ok), n))
                right.append(ok + n + 1)
        i = same
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def tiles_of(call: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The tiles among the rows, each in order of size."""
    call = call.sort_values(["gid", "one", "two", "size", "node"], kind="stable")
    keys = call[["gid", "one", "two"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
        yield call.iloc[a:b]


def meeting(tile: pd.DataFrame, bitmaps: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes that may be similar; the tile is in order of size. Nodes of one part meet in its own tile."""
    left, right = passing(sizes, bitmaps)
    if tile["one"].iloc[0] != tile["two"].iloc[0]:
        part = tile["part"].to_numpy()
        across = part[left] != part[right]
        left, right = left[across], right[across]
    return left, right


def small_pairs(call: pd.DataFrame) -> pd.DataFrame:
    """For groupBy on calls: the pairs to try, of every tile among the rows."""
    found: set[tuple[int, int]] = set()
    for tile in tiles_of(call):
        left, right = meeting(tile, tile["bitmap"].tolist(), tile["size"].to_numpy())
        names = tile["node"].to_numpy()
        first, second = names[left], names[right]
        found.update(zip(np.minimum(first, second).tolist(), np.maximum(first, second).tolist(), strict=True))
    return pd.DataFrame(sorted(found), columns=["a", "b"], dtype=np.int64)


def open_nodes(call: pd.DataFrame) -> pd.DataFrame:
    """For groupBy on calls: the nodes of each tile that may be similar to another."""
    found = [call.iloc[:0]]
    for tile in tiles_of(call):
        found.append(tile.iloc[np.unique(np.concatenate(meeting(tile, tile["bitmap"].tolist(), tile["size"].to_numpy())))])
    return pd.concat(found)[["gid", "part", "one", "two", "node", "size"]]


def joining_links(tile: pd.DataFrame, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Similar pairs that join all nodes of the tile which any of its similar pairs joins."""
    sizes, names = np.array([len(s) for s in sets]), tile["node"].to_numpy()
    label = np.arange(len(sets))
    left, right = meeting(tile, [bitmap(s) for s in sets], sizes)
    shingles, flat = np.unique(np.concatenate(sets), return_inverse=True)
    places = np.split(flat, np.cumsum(sizes)[:-1])
    held = np.zeros(len(shingles), dtype=bool)
    links = []
    for centre in np.unique(left).tolist():
        others = right[np.searchsorted(left, centre) : np.searchsorted(left, centre, "right")]
        others = others[label[others] != label[centre]]
        if not len(others):
            continue
        held[places[centre]] = True
        starts = np.cumsum(sizes[others]) - sizes[others]
        common = np.add.reduceat(held[np.concatenate([places[o] for o in others])], starts, dtype=np.int64)
        held[places[centre]] = False
        for other in others[100 * common >= PERCENT * (sizes[centre] + sizes[others] - common)].tolist():
            if label[other] != label[centre]:
                links.append((int(names[centre]), int(names[other])))
                label[label == label[other]] = label[centre]
    return links


def settled(call: pd.DataFrame) -> pd.DataFrame:
    """For groupBy on calls: the links that join nodes, of every tile among the rows, from the texts of its nodes."""
    unpack = zstandard.ZstdDecompressor()
    texts = dict(zip(call["node"].tolist(), call["packed"], strict=True))
    sets = dict(zip(texts, shingle_sets([unpack.decompress(t) for t in texts.values()]), strict=True))
    found = [link for tile in tiles_of(call) for link in joining_links(tile, [sets[n] for n in tile["node"]])]
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def filter_bits(size: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size, dtype=bool)
        for batch in batches:
            bits[batch["mark"].to_numpy().view(np.uint64) % np.uint64(size)] = True
        yield pd.DataFrame({"bits": [np.packbits(bits).tobytes()]})

    return run


def wanted_texts(held) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas: compressed texts of the documents that may be wanted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, pack = held.value, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            some = bits[batch["mark"].to_numpy().view(np.uint64) % np.uint64(len(bits))]
            kept = batch[some]
            yield pd.DataFrame({"doc": kept["doc"], "mark": kept["mark"], "packed": [pack.compress(t.encode()) for t in kept["text"]]})

    return run


def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs whose sorted shingle sets overlap enough."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, len(batch), 200):
            part = batch.iloc[at : at + 200]
            texts = list(dict.fromkeys([*part["packed_a"], *part["packed_b"]]))
            sets = dict(zip(texts, shingle_sets([unpack.decompress(t) for t in texts]), strict=True))
            ok = []
            for a, b in zip(part["packed_a"], part["packed_b"], strict=True):
                x, y = sets[a], sets[b]
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield part.loc[ok, ["a", "b"]]


def texts_of(documents: DataFrame, table: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and packed, its compressed text, of the nodes wanted. A filter of bounded size lets few other texts pass."""
    places = materialise(table.join(wanted, "node").select("node", "rep.doc", "rep.mark"), "near-wanted")
    size = int(min(FILTER_MOST, max(1024, FILTER_BITS * places.count())))
    folded = folded_rows(places.select("mark").mapInPandas(filter_bits(size), "bits BINARY"), "bits", np.uint8, np.bitwise_or)
    bits = np.unpackbits(folded, count=size).astype(bool) if folded is not None else np.zeros(size, bool)
    held = documents.sparkSession.sparkContext.broadcast(bits)
    texts = documents.select("doc", "mark", "text").mapInPandas(wanted_texts(held), "doc BIGINT, mark BIGINT, packed BINARY")
    return materialise(texts.join(places, ["doc", "mark"]).select("node", "packed").dropDuplicates(["node"]), "near-texts")


def with_texts(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with the compressed texts of both nodes."""
    one = texts.select(F.col("node").alias("a"), F.col("packed").alias("packed_a"))
    two = texts.select(F.col("node").alias("b"), F.col("packed").alias("packed_b"))
    return pairs.join(one, "a").join(two, "b")


def components(links: DataFrame) -> DataFrame:
    """node and label: the smallest node that links lead to. Labels spread along links and jump to their own label's label."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = materialise(both.union(both.select(F.col("other"), F.col("node"))).distinct(), "near-links")
    labels = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label"))
    labels = materialise(labels, "near-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "label"), "other")
        nearest = seen.groupBy("node").agg(F.min("label").alias("near"))
        spread = labels.join(nearest, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = spread.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        moved = materialise(moved, "near-labels")
        labels = moved.select("node", "label")
        if not moved.filter("label < old").head(1):
            return labels


def large_tiles(groups: DataFrame, known: DataFrame) -> DataFrame:
    """The tiles of large groups. Those with the same two smallest nodes are one group; its parts meet in pairs."""
    key = F.xxhash64(F.col("nodes")[0], F.col("nodes")[1]).alias("gid")
    members = materialise(groups.select(key, F.explode("nodes").alias("node")).distinct().join(known, "node"), "near-members")
    most = F.greatest(F.count("*") / TILE_NODES, F.sum("size") / TILE_SHINGLES)
    dealt = members.join(members.groupBy("gid").agg(F.ceil(most).cast("int").alias("parts")), "gid")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumn("one", F.least("part", "other")).withColumn("two", F.greatest("part", "other"))


def in_calls(tiles: DataFrame, calls: int) -> GroupedData:
    """The rows of tiles grouped by so many calls, at least one; a tile is in one call."""
    return tiles.groupBy(F.pmod(F.xxhash64("gid", "one", "two"), F.lit(max(1, calls))).alias("call"))


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per document doc_id, mark, node and size; and per node with shingles its label and the least doc_id of the node."""
    spark = docs.sparkSession
    small_batches(spark)
    documents = keyed(docs)
    table = materialise(mapped(documents, nodes, NODES), "near-nodes")
    owners = table.filter("counts IS NULL")
    sized = owners.filter("size > 0")
    rep = F.min(F.struct("doc", "mark")).alias("rep")
    distinct = materialise(
        sized.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("bitmap").alias("bitmap"), rep),
        "near-distinct",
    )
    total = distinct.agg(F.sum(F.col("size") - F.floor((F.col("size") * PERCENT + 99) / 100) + 1)).first()[0] or 0
    buckets = int(max(1, -(-total // BUCKET_ENTRIES)))
    magnitude = spark.sparkContext.broadcast(rarity(table))
    packed = documents.select("text").mapInPandas(entries(magnitude, buckets), ENTRIES)
    shared = packed.groupBy("bucket").applyInPandas(groups, GROUPS)
    once = materialise(shared.groupBy("gid").agg(F.first("nodes").alias("nodes")), "near-groups")
    tile = ["gid", "part", "one", "two", "node", "size", "bitmap"]
    known = distinct.select("node", "size", "bitmap")
    whole = [F.lit(0).alias(c) for c in ("part", "one", "two")]
    few = once.filter(F.size("nodes") <= SMALL_GROUP)
    small = few.select("gid", F.explode("nodes").alias("node"), *whole).join(known, "node").select(tile)
    tiles = materialise(large_tiles(once.filter(F.size("nodes") > SMALL_GROUP), known).select(tile), "near-tiles")
    n_small = few.agg(F.sum(F.size("nodes"))).first()[0] or 0
    pairs = materialise(in_calls(small, n_small // (2 * CALL_GROUPS)).applyInPandas(small_pairs, PAIRS).distinct(), "near-pairs")
    opened = materialise(in_calls(tiles, tiles.count() // (2 * CALL_GROUPS)).applyInPandas(open_nodes, OPEN), "near-open")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(opened.select("node")).distinct()
    texts = texts_of(documents, distinct, wanted)
    calls = (opened.agg(F.sum("size")).first()[0] or 0) // CALL_SHINGLES
    settling = in_calls(opened.join(texts, "node"), calls).applyInPandas(settled, PAIRS)
    links = materialise(with_texts(texts, pairs).mapInPandas(similar, PAIRS).union(settling), "near-similar")
    labels = components(links)
    return owners, distinct.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def join(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to)."""
    owners, named = labelled(docs)
    least = materialise(named.groupBy("label").agg(F.min("least").alias("component_id")), "near-least")
    component = named.join(least, "label").select("node", "component_id")
    return owners.join(component, "node", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id (null last) and then text hash, and every
    document without shingles; columns as given. Rows equal in doc_id and text stay once."""
    owners, named = labelled(docs)
    linked = owners.filter("size > 0").join(named.select("node", "label"), "node")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("first")
    kept = linked.groupBy("label").agg(first).select("first.doc_id", "first.mark")
    kept = kept.union(owners.filter("size = 0").select("doc_id", "mark").distinct())
    kept = materialise(kept.toDF("kept_id", "kept_mark"), "near-kept")
    same = docs["doc_id"].eqNullSafe(kept["kept_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == kept["kept_mark"])
    rows = docs.join(kept, same).select(F.col("kept_mark"), docs["text"].isNull().alias("no_text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return rows.groupBy("row.doc_id", "kept_mark", "no_text").agg(F.min("row").alias("row")).select("row.*")
