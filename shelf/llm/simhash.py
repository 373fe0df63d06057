"""Near duplicates: SimHash fingerprints whose close pairs share a key of blocks, verified by Hamming distance; and sets of shingles
whose similar pairs share a band of MinHashes, verified by their Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelf.llm import common

BITS = 64
#: Blocks that two close fingerprints share at least. One more makes keys longer, for corpora whose keys would hold too many
#: prints to compare, and more numerous; none loses a pair.
SHARED = 2
#: Fingerprints of one key that one task compares; a larger key is dealt over pairs of tiles of half as many.
TILE = 20_000
#: Bands of ROWS MinHashes each, by which similar sets of shingles meet.
BANDS, ROWS = 24, 4
#: Sets of one key that one task compares; a larger key is dealt over pairs of tiles of half as many.
SETS = 4_000
PRINTS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
SKETCH = T.StructType([T.StructField("alike", T.StringType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def shingle_hashes(text: str | None, size: int, seeds: Sequence[int]) -> list[np.ndarray]:
    """XXH64 of each shingle of ``size`` words (A-Z lower-cased), repeats included; of all words if there are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return [np.zeros(0, np.uint64) for _ in seeds]
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    firsts = (ends - lengths)[: max(1, len(words) - size + 1)].tolist()
    shingles = [joined[i:j] for i, j in zip(firsts, ends[min(size, len(words)) - 1 :].tolist())]
    return [np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles)) for seed in seeds]


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit number; 0 of none."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(size: int, seeds: Sequence[int]):
    @F.arrow_udf(returnType=PRINTS)
    def prints(text: pa.Array) -> pa.Array:
        out = [[majority(h) for h in shingle_hashes(t, size, seeds)] for t in text.to_pylist()]
        return pa.array([{"a": x[0], "b": x[1] if len(x) > 1 else 0} for x in out], type=pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    return prints


def masks(near: int, shared: int = SHARED) -> list[int]:
    """Masks of the keys: of near + shared blocks, two prints at ``near`` bits or fewer share ``shared``; one mask for each such choice."""
    m = near + shared
    edges = [BITS * i // m for i in range(m + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, shared)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def spanning(key: np.ndarray, a: np.ndarray, b: np.ndarray, near: int, near_all: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, within runs of equal ``key``, all pairs of close fingerprints: at most one edge a row."""
    n = len(key)
    a, b = a.view(np.uint64), b.view(np.uint64)
    up = np.arange(n)
    step = 1
    at = np.nonzero(key[1:] == key[:-1])[0]
    while at.size:
        far = np.bitwise_count(a[at] ^ a[at + step])
        close = far <= near
        if near_all < 2 * BITS:
            other = np.bitwise_count(b[at] ^ b[at + step])
            close = (close | (other <= near)) & (far + other <= near_all)  # at most 128, so bytes hold the sum
        x = at[close]
        x = x[up[x] != up[x + step]]
        for i in x.tolist():
            j = i + step
            while up[i] != i:
                i = up[i]
            while up[j] != j:
                j = up[j]
            if i != j:
                up[max(i, j)] = min(i, j)
        if x.size:
            while (flat := up[up]).tobytes() != up.tobytes():
                up = flat
        step += 1
        at = at[at + step < n]
        at = at[key[at] == key[at + step]]
    ends = np.nonzero(up != np.arange(n))[0]
    return ends, up[ends]


def _linked(near: int, near_all: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "a", "b", "node")
        held = [np.zeros(0, np.int64)] * 4

        def edges(cut: int) -> pa.RecordBatch:
            key, a, b, node = (x[:cut] for x in held)
            i, j = spanning(key, a, b, near, near_all)
            return pa.RecordBatch.from_pydict({"a": node[i], "b": node[j]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

        for batch in batches:
            held = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, names)]
            if len(held[0]):
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last run may go on in the next batch
                if cut:
                    yield edges(cut)
                    held = [x[cut:] for x in held]
        yield edges(len(held[0]))

    return link


def links(classes: DataFrame, near: int, near_all: int, shared: int = SHARED) -> DataFrame:
    """Edges (a, b) between nodes of ``classes`` (node, a, b) that connect all pairs at ``near`` or fewer bits of a.

    With ``near_all`` under 128, ``near`` bits of either print will do, and both together must not differ in more than ``near_all``. A key that holds more than
    TILE fingerprints is dealt over all pairs of its tiles, so no task holds a hot key and no pair is missed.
    """
    cut = [(c, i, _signed(m)) for c in (["a", "b"] if near_all < 2 * BITS else ["a"]) for i, m in enumerate(masks(near, shared))]
    key = F.explode(F.array(*[F.xxhash64(F.lit(c), F.lit(i), F.col(c).bitwiseAND(F.lit(m))) for c, i, m in cut]))
    keyed = classes.select(key.alias("key"), "a", "b", "node")
    hot = keyed.groupBy("key").count().filter(F.col("count") > TILE).select("key", F.ceil(F.col("count") * 2 / TILE).cast("int").alias("tiles"))
    hot = common.saved(hot, "simhash-hot")
    if hot.take(1):
        own = F.pmod(F.xxhash64("node"), F.col("tiles"))
        pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.xxhash64("key", F.least(t, own), F.greatest(t, own)))
        keyed = keyed.join(hot, "key", "left").withColumn("key", F.explode(F.when(F.col("tiles").isNull(), F.array("key")).otherwise(pair)))
    dealt = keyed.select("key", "a", "b", "node").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_linked(near, near_all), "a long, b long")


def grouped(
    docs: DataFrame, keep: Sequence[str], id: str = "doc_id", text: str = "text", shingle: int = 4, near: int = 4,
    seeds: Sequence[int] = (42,), near_all: int = 2 * BITS, shared: int = SHARED,
) -> DataFrame:
    """(row, nr, a, first): ``keep`` columns as a struct, a number of the row, its fingerprint, and its group's first row (id, nr).

    Rows link where their fingerprints differ in at most ``near`` bits; with two seeds, where those of either do and both together
    differ in at most ``near_all``. Groups are the connected components. A text without words (null, empty) has fingerprint 0 and links like
    any other. The first row is that with the smallest id (a null one last), of repeated ids any one. No rows: no groups.
    """
    prints = _fingerprints(shingle, seeds)(F.col(text))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(id).alias("id"), prints.alias("p"), F.monotonically_increasing_id().alias("nr"))
    rows = common.saved(rows.select("row", "nr", F.struct(F.col("id").isNull().alias("none"), "id", "nr").alias("first"), "p.a", "p.b"), "simhash-rows")
    classes = rows.groupBy("a", "b").agg(F.min("first").alias("first")).withColumn("node", F.monotonically_increasing_id())
    classes = common.saved(classes, "simhash-classes")
    roots = common.components(common.saved(links(classes.select("node", "a", "b"), near, near_all, shared), "simhash-links"), "simhash-parts")
    placed = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("first"))
    placed = placed.drop("first").join(firsts, "root").select(F.col("a").alias("ca"), F.col("b").alias("cb"), "first")
    return rows.drop("first").join(placed, (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb"))).select("row", "nr", "a", "first")


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The different shingles of a text, by hash and in order."""
    return np.unique(shingle_hashes(text, size, (42,))[0])


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64))


def _sets(size: int):
    @F.arrow_udf(returnType=T.ArrayType(T.LongType()))
    def sets(text: pa.Array) -> pa.Array:
        return _lists([shingle_set(t, size) for t in text.to_pylist()])

    return sets


def _sketches(size: int):
    factor = (np.random.default_rng(7).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) << np.uint64(1)) | np.uint64(1)
    number = np.arange(BANDS, dtype=np.uint64)

    @F.arrow_udf(returnType=SKETCH)
    def sketch(text: pa.Array) -> pa.Array:
        alike, bands = [], []
        for t in text.to_pylist():
            have = shingle_set(t, size)
            low = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
            for i in range(0, len(have), 1 << 12):
                np.minimum(low, (factor * have[i : i + (1 << 12)]).min(axis=1), out=low)
            keys = number.copy()
            for m in low.reshape(BANDS, ROWS).T:
                keys = (keys ^ m) * np.uint64(0x9E3779B97F4A7C15)
                keys ^= keys >> np.uint64(29)
            alike.append(xxhash.xxh128_hexdigest(have.tobytes()))
            bands.append(keys)
        return pa.StructArray.from_arrays([pa.array(alike, pa.string()), _lists(bands)], names=["alike", "bands"])

    return sketch


def joining(root: np.ndarray, sets: Sequence[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of positions that join, with the roots the rows have already, all pairs of sets at a Jaccard similarity of ``least`` or more."""
    up = {r: r for r in root.tolist()}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if not sizes.all():  # nothing resembles a text without words but another, and those are one class
        at = np.nonzero(sizes)[0]
        return [(int(at[i]), int(at[j])) for i, j in joining(root[at], [sets[i] for i in at], least)] if at.size else []
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    mine = np.zeros(len(values), bool)
    found = []
    for i in range(len(sets) - 1):
        if not (root[i + 1 :] != root[i]).any():
            continue
        own = codes[begins[i] : begins[i + 1]]
        mine[own] = True
        both = np.add.reduceat(mine[codes[begins[i + 1] :]], begins[i + 1 : -1] - begins[i + 1], dtype=np.int64)
        mine[own] = False
        for j in (np.nonzero(both / (sizes[i] + sizes[i + 1 :] - both) >= least)[0] + i + 1).tolist():
            x, y = find(int(root[i])), find(int(root[j]))
            if x != y:
                up[max(x, y)] = min(x, y)
                found.append((i, j))
    return found


def _joined(least: float):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, roots, sets = None, [], [], []

        def edges() -> pa.RecordBatch:
            found = joining(np.array(roots, np.int64), sets, least) if len(nodes) > 1 else []
            return pa.RecordBatch.from_pydict(
                {"a": [nodes[i] for i, _ in found], "b": [nodes[j] for _, j in found]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())])
            )

        for batch in batches:
            held = batch.column("shingles")
            for i, (key, node, root) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("key", "node", "root")])):
                if key != last:
                    yield edges()
                    last, nodes, roots, sets = key, [], [], []
                nodes.append(node)
                roots.append(root)
                sets.append(held[i].values.to_numpy().copy())
        yield edges()

    return join


def _tiled(keyed: DataFrame, tile: int, name: str) -> DataFrame:
    """Rows of keys that hold more than ``tile`` rows are dealt over all pairs of tiles of half as many, under keys of their own."""
    hot = keyed.groupBy("key").count().filter(F.col("count") > tile).select("key", F.ceil(F.col("count") * 2 / tile).cast("int").alias("tiles"))
    hot = common.saved(hot, name)
    if not hot.take(1):
        return keyed
    own = F.pmod(F.xxhash64("node"), F.col("tiles"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.xxhash64("key", F.least(t, own), F.greatest(t, own)))
    return keyed.join(hot, "key", "left").withColumn("key", F.explode(F.when(F.col("tiles").isNull(), F.array("key")).otherwise(pair))).drop("tiles")


def _among(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``df`` whose node is in ``nodes``, and some others: held against a bitmap of at most 2 MB, so ``df`` isn't shuffled."""
    bit = F.pmod(F.xxhash64("node"), F.lit(1 << 24))
    cell, at = F.shiftright(bit, 15).alias("_cell"), bit.bitwiseAND(F.lit((1 << 15) - 1))
    bits = nodes.select(cell, at.alias("_at")).groupBy("_cell").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    found = df.withColumns({"_cell": cell, "_at": at}).join(F.broadcast(bits), "_cell")
    return found.filter("shiftright(cast(conv(hex(substring(_bits, cast(_at div 8 as int) + 1, 1)), 16, 10) as int), cast(_at % 8 as int)) & 1 = 1").select(*df.columns)


def resembling(classes: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Edges (a, b) that connect all nodes of ``classes`` (node, bands) which share a band and have a similarity of ``least`` or more.

    ``texts`` holds the text of each node; those that share a band become sets of shingles. First each node of a key is held against the key's smallest, which settles keys
    of two nodes and most larger ones. Where nodes of a key are still apart, their sets meet and all pairs are compared. No pair is
    taken without its exact similarity, and what is written is edges of forests, not pairs.
    """
    keyed = classes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = common.saved(keyed.join(shared, "key"), "resemble-keys")
    sets = common.saved(_among(texts, keyed.select("node")).select("node", _sets(shingle)("text").alias("shingles")), "resemble-sets")
    pairs = common.saved(keyed.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "resemble-pairs")
    of = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"in_{side}"))
    both = F.size(F.array_intersect("in_a", "in_b"))
    alike = both / (F.size("in_a") + F.size("in_b") - both) >= least
    edges = common.saved(pairs.join(of("a"), "a").join(of("b"), "b").filter(alike).select("a", "b"), "resemble-edges")
    roots = common.components(edges, "resemble-parts")
    placed = common.saved(keyed.filter("n > 2").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "resemble-placed")
    apart = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    rest = common.saved(placed.join(apart, "key"), "resemble-rest")
    if not rest.take(1):
        return edges
    met = _tiled(rest, SETS, "resemble-hot").join(sets, "node").select("key", "node", "root", "shingles")
    more = met.repartition("key").sortWithinPartitions("key").mapInArrow(_joined(least), "a long, b long")
    return edges.unionAll(common.saved(more, "resemble-more"))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id (a null one last); columns unchanged.

    Rows link where the Jaccard similarity of their sets of ``shingle``-word shingles is ``least`` or more, and groups are the connected
    components. Pairs meet by a band of MinHashes and are verified exactly, so none below ``least`` links; one just at 0.8 shares no
    band with a chance of (1 - 0.8 ** ROWS) ** BANDS, 3 in a million. Texts without words (null, empty) are alike.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id).alias("id"), _sketches(shingle)(F.col(text)).alias("p"), F.monotonically_increasing_id().alias("nr"))
    rows = common.saved(rows.select("row", "nr", F.struct(F.col("id").isNull().alias("none"), "id", "nr").alias("first"), "p.*"), "resemble-rows")
    classes = rows.groupBy("alike").agg(F.min("first").alias("first"), F.min_by("bands", "first").alias("bands"))
    classes = common.saved(classes.select(F.col("first.nr").alias("node"), "first", "bands"), "resemble-classes")
    edges = resembling(classes.select("node", "bands"), rows.select(F.col("nr").alias("node"), F.col("row").getField(text).alias("text")), shingle, least)
    roots = common.components(edges, "resemble-groups")
    firsts = classes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = rows.select("row", "nr").join(firsts.select(F.col("first.nr").alias("nr")), "nr", "left_semi")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
