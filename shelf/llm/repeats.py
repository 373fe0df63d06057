"""Substring deduplication by recompression: rounds name runs and pairs of tokens, so equal substrings get equal interior symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelf.llm import common

WINDOW = 35
ROUNDS = 40
#: Words before a symbol that count towards it.
LEAD = 5
#: Words parsed together by one numpy call (one text at least).
BLOCK_WORDS = 400_000
U = np.uint64
ROOTS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
#: The high half of ``place`` is the first window's number, below it the number of windows, and bit 31 where the block has the symbol once.
SEEN = pa.schema([("sym", pa.int64()), ("salt", pa.int32()), ("rng", pa.int64()), ("k", pa.int64()), ("place", pa.int64())])
SEEN_SQL = "sym long, salt int, rng long, k long, place long"
PRINT = pa.schema([("f", pa.int64()), ("g", pa.int64()), ("k", pa.int64()), ("at", pa.int32())])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), U, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(root: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, root, U)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


def stretches(h: np.ndarray, first: np.ndarray, last: np.ndarray, root: np.uint64) -> np.ndarray:
    """A hash of each stretch [first, last) of ``h``: equal stretches have equal hashes, wherever they stand."""
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * powers(root, len(h)), out=total[1:])
    back = powers(U(pow(int(root), -1, 1 << 64)), len(h) + 1)
    return mixed((total[last] - total[first]) * back[first] + (last - first).astype(U))


def anchors(h: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The start of each window of one text, and the symbol and place that stand for it.

    Each round parses the sequence anew: first runs of one word, then pairs of a left and a right symbol, sides and names by hash,
    so a name means the same words everywhere and no table of names is needed. A window keeps the symbols that its own words
    settle: an outer symbol goes where a neighbour beyond the edge could change it. Of the last round that leaves any, the least
    symbol stands for the window; equal windows get equal symbols at equal offsets, whatever stands around them.
    """
    n = len(h)
    at = np.nonzero(owner[: n - window + 1] == owner[window - 1 :])[0] if n >= window else np.zeros(0, np.int64)
    symbol, place = np.zeros(len(at), U), np.zeros(len(at), np.int64)
    left, live = at.copy(), np.arange(len(at))
    right = at + window
    s, p = h, np.arange(n)

    def take(which: np.ndarray, low: np.ndarray, high: np.ndarray):
        best = low.copy()
        for step in range(1, int((high - low).max(initial=1))):
            i = np.nonzero(low + step < high)[0]
            i = i[s[low[i] + step] < s[best[i]]]
            best[i] = low[i] + step
        symbol[which], place[which] = s[best], p[best]

    def settle(low: np.ndarray, high: np.ndarray):
        nonlocal left, right, live
        over = low >= high
        if over.any():
            take(live[over], left[over], right[over])
            live, low, high = live[~over], low[~over], high[~over]
        left, right = low, high

    head = np.ones(n, bool)
    head[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    run = np.cumsum(head) - 1
    settle(run[left] + 1, run[right - 1])
    p = np.nonzero(head)[0]
    size = np.diff(np.append(p, n))
    s = np.where(size > 1, mixed(h[p] + size.astype(U) * ROOTS[0]), h[p])
    owner = owner[p]
    for turn in range(ROUNDS):
        if not len(live):
            break
        lefty = (s * (ROOTS[1] + U(2 * turn))) >> U(63) == 1
        joins = lefty[:-1] & ~lefty[1:] & (owner[:-1] == owner[1:])
        keep = np.ones(len(s), bool)
        keep[1:] = ~joins
        number = np.concatenate([[0], np.cumsum(keep)])
        low, high = left + ~lefty[left], right - lefty[right - 1]
        high = np.maximum(high, low)
        settle(number[low], number[high])
        i = np.nonzero(joins)[0]
        s = s.copy()
        s[i] = mixed(s[i] * ROOTS[0] + s[i + 1] + U(turn))
        s, p, owner = s[keep], p[keep], owner[keep]
    if len(live):
        take(live, left, right)
    return at, symbol, place


def runs(texts: list[list[bytes]], keys: list[int], window: int) -> pa.RecordBatch:
    """Stretches of consecutive windows with one symbol. The first of a symbol in the block has salt 0, the others are known repeats.

    A short symbol recurs by chance, so it is told apart by words that the window holds for certain: the LEAD words before it, or
    those from it on where it stands nearer than that to the window's start.
    """
    h = np.concatenate([hashes(t) for t in texts])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    at, symbol, place = anchors(h, owner, window)
    if not len(at):
        return pa.RecordBatch.from_pylist([], schema=SEEN)
    after = place - at >= LEAD
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (symbol[1:] != symbol[:-1]) | (at[1:] != at[:-1] + 1) | (after[1:] != after[:-1])
    first = np.nonzero(new)[0]
    count = np.diff(np.append(first, len(at)))
    start, at_symbol, after = at[first], place[first], after[first]
    lead = stretches(h, np.where(after, at_symbol - LEAD, at_symbol), np.where(after, at_symbol, at_symbol + window - 2 * LEAD), ROOTS[1])
    sym = mixed(symbol[first] ^ lead)
    rng = stretches(h, start, start + count + window - 1, ROOTS[0])
    _, leaders, back, often = np.unique(sym, return_index=True, return_inverse=True, return_counts=True)
    salt = np.arange(1, len(sym) + 1, dtype=np.int32)
    salt[leaders] = 0
    doc = owner[start]
    begin = np.concatenate([[0], np.cumsum(sizes)])[doc]
    return pa.RecordBatch.from_arrays([
        pa.array(sym.view(np.int64)), pa.array(salt), pa.array(rng.view(np.int64)), pa.array(np.array(keys, np.int64)[doc]),
        pa.array((start - begin << 32) + np.where(often[back] > 1, 0, 1 << 31) + count),
    ], schema=SEEN)


def _parse(window: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, keys, size = [], {}, 0
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k in keys:
                    continue
                found = words(text.as_py())
                if len(found) >= window:
                    texts.append(found)
                    keys[k] = None
                    size += len(found)
                    if size >= BLOCK_WORDS:
                        yield runs(texts, list(keys), window)
                        texts, keys, size = [], {}, 0
        if texts:
            yield runs(texts, list(keys), window)

    return parse


def _prints(window: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                open_ = [(r["at"], r["cnt"]) for r in found.as_py() if r["open"]]
                if open_:
                    h = hashes(words(text.as_py()))
                    at = np.unique(np.concatenate([np.arange(a, a + n) for a, n in open_]))
                    f, g = (stretches(h, at, at + window, root).view(np.int64) for root in ROOTS)
                    yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(g), pa.array(np.full(len(at), k)), pa.array(at.astype(np.int32))], schema=PRINT)

    return prints


SUMMARY = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("sha", T.StringType())])
RESULT = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


@F.arrow_udf(returnType=SUMMARY)
def summary(text: pa.Array) -> pa.Array:
    found = [words(t) for t in text.to_pylist()]
    return pa.array([{"n_words": len(w), "sha": hashlib.sha256(b" ".join(w)).hexdigest()} for w in found], type=pa.struct([("n_words", pa.int64()), ("sha", pa.string())]))


def _removed(window: int):
    @F.arrow_udf(returnType=RESULT)
    def removed(text: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, stretches_ in zip(text, found):
            w = words(t.as_py())
            change = np.zeros(len(w) + 1, np.int64)
            for r in stretches_.as_py() or ():
                change[r["at"]] += 1
                change[r["at"] + r["cnt"] + window - 1] -= 1
            stays = np.cumsum(change[:-1]) == 0
            out.append({"n_removed": int(len(w) - stays.sum()), "kept": b" ".join([w[i] for i in np.nonzero(stays)[0].tolist()]).decode()})
        return pa.array(out, type=pa.struct([("n_removed", pa.int64()), ("kept", pa.string())]))

    return removed


def removals(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(id, k, n_words, sha, copies) of every row, and (k, n_removed, kept) of the texts that lose words but aren't copied whole.

    A word goes that a window of ``window`` words covers whose words also start elsewhere, in the same text or another. ``k`` is a
    64-bit hash of the text; a text with copies loses all words if it holds a window. Null is the empty text, with no words; a text
    shorter than a window loses nothing; repeated rows are copies of each other; an empty table gives no rows.

    1. Each text is parsed once; stretches of windows meet by symbol. A stretch that is not the first of its symbol in its block is
    known to repeat and is dealt by a salt, so a hot symbol meets itself once a block. 2. Stretches of one symbol whose words are
    equal, by hash, repeat. 3. Where a symbol stands in differing stretches, one of each is taken from its text window by window and
    verified by a 128-bit hash of its words.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("k", F.xxhash64("text"))
    base = common.saved(rows.withColumn("s", summary("text")).select("id", "k", "s.n_words", "s.sha"), "repeats-rows")
    texts = base.groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))

    seen = rows.select("k", "text").mapInArrow(_parse(window), SEEN_SQL)
    often = F.count(F.lit(1)).over(Window.partitionBy("sym", "salt"))
    once = F.col("place").bitwiseAND(F.lit(1 << 31)) != 0
    hits = seen.withColumn("n", often).filter((F.col("n") > 1) | (F.col("salt") != 0) | ~once).select(
        "sym", "rng", "k", F.shiftright("place", 32).cast("int").alias("at"), F.col("place").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("cnt")
    )
    hits = common.saved(hits, "repeats-hits")

    where = F.struct("k", "at", "cnt")
    alike = hits.groupBy("sym", "rng").agg(F.min(where).alias("one"), F.max(where).alias("other")).select("sym", "rng", "one", (F.col("one") != F.col("other")).alias("multi"))
    alike = common.saved(alike, "repeats-alike")
    done = hits.join(alike.filter("multi").select("sym", "rng"), ["sym", "rng"]).select("k", "at", "cnt", F.lit(False).alias("open"))
    mixed_ = alike.groupBy("sym").agg(F.count(F.lit(1)).alias("n"), F.min("multi").alias("all")).filter("n > 1 and not all").select("sym")
    check = alike.join(mixed_, "sym").select("one.k", "one.at", "one.cnt", F.lit(True).alias("open"))
    found = done.unionAll(check).distinct().groupBy("k").agg(F.collect_list(F.struct("at", "cnt", "open")).alias("found"))

    named = found.join(texts.select("k", "first"), "k").withColumnRenamed("k", "fk")
    joined = rows.join(named, (F.col("k") == F.col("fk")) & F.col("id").eqNullSafe(F.col("first"))).select("k", "text", "found")
    joined = common.saved(joined, "repeats-texts")
    prints = joined.select("k", "text", "found").mapInArrow(_prints(window), "f long, g long, k long, at int").distinct()
    prints = common.saved(prints, "repeats-prints")
    place = F.struct("k", "at")
    equal = prints.groupBy("f", "g").agg(F.min(place).alias("one"), F.max(place).alias("other")).filter(F.col("one") != F.col("other")).select("f", "g")
    more = prints.join(equal, ["f", "g"]).groupBy("k").agg(F.collect_list(F.struct("at", F.lit(1).alias("cnt"))).alias("more"))
    sure = F.transform(F.filter("found", lambda r: ~r["open"]), lambda r: F.struct(r["at"].alias("at"), r["cnt"].alias("cnt")))
    cut = joined.withColumn("sure", sure).drop("found").join(more, "k", "left")
    cut = cut.withColumn("all", F.concat("sure", F.coalesce("more", F.array().cast("array<struct<at:int,cnt:int>>"))))
    lost = cut.filter(F.size("all") > 0).withColumn("r", _removed(window)("text", "all")).select("k", "r.n_removed", "r.kept").dropDuplicates(["k"])
    counted = base.join(texts.select(F.col("k").alias("tk"), "copies"), F.col("k") == F.col("tk")).drop("tk")
    return counted, lost


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256): the digest is of the kept words, one blank between them."""
    rows, lost = removals(docs, id, text, window)
    lost = lost.select(F.col("k").alias("lk"), "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
    whole = (F.col("copies") > 1) & (F.col("n_words") >= window)
    return rows.join(lost, F.col("k") == F.col("lk"), "left").select(
        "id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
