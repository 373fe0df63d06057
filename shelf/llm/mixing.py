"""Mixing sources to target weights: hash-random order, prefix sums of sizes, an exact cut at each source's budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelf.llm import common

WEIGHTS = (5, 2, 1)
#: Sources up to this many are sent to every task; a row of one is a few dozen bytes.
BROADCAST_SOURCES = 10_000
CAP = 3


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, cap: int = CAP) -> DataFrame:
    """Target size of each source: (source, source_size) with ``target`` and ``budget``, the target as a whole number.

    The n-th source by code point (null last) has the n-th weight, repeating. Sources share ``share`` of all sizes by weight; none
    gets more than ``cap`` times its own size, and what it can't take is shared anew by weight. Ordered by size per weight, the
    full sources come first: each one's rate is what is left over the weights left. One row a source, so one task orders them.
    """
    places = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(places) - 1) % len(weights) + 1).cast("int"))
    by_fill = Window.partitionBy(F.lit(0)).orderBy("fill", F.col("source").isNull(), "source")
    upto = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    most = (F.col("source_size") * cap).cast("double")
    rated = (
        totals.withColumn("weight", weight)
        .withColumn("fill", most / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(whole) * share - F.coalesce(F.sum(most).over(upto), F.lit(0.0)))
        .withColumn("rate", F.col("left") / F.sum("weight").over(onward))
    )
    rate = F.max(F.when(F.col("fill") > F.col("rate"), F.struct(-F.col("fill"), F.col("rate").alias("rate")))).over(whole)["rate"]
    return (
        rated.withColumn("target", F.when(F.col("fill") <= F.col("rate"), most).otherwise(F.coalesce(F.col("weight") * rate, most)))
        .withColumn("target", F.least(F.col("target"), most))
        .select("source", "source_size", "target", F.least(F.round("target").cast("long"), F.col("source_size") * cap).alias("budget"))
    )


def mix(
    docs: DataFrame, size: Column, id: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.0,
    cap: int = CAP, seed: str = "mix",
) -> DataFrame:
    """What the mix takes of each row: (row, id, source, size, source_size, target, taken, copies, part).

    ``row`` is the whole input row, so extra columns can't clash. A source's rows stand in a hash-random order; its budget is
    filled with whole passes (``copies``) and a last one cut exactly: a row gives the ``part`` of its size that falls before the cut.
    ``taken`` is copies * size + part. Null sources are one source, the last; a null id or text counts as an empty one, size null
    as 0; repeated rows each count; a source without words gets target 0 and takes nothing; an empty table gives no rows.
    """
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id).alias("id"), F.col(source).alias("source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
    ).withColumn("key", common.order_key(seed, F.col("id"))).withColumn("bucket", common.bucket_of("key"))
    named = [F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed")]  # a key without nulls
    base = base.select("*", *named)
    sums = common.saved(base.groupBy("name", "unnamed", "bucket").agg(F.sum("size").alias("total")), "mix-sums")
    totals = sums.groupBy("name", "unnamed").agg(F.sum("total").alias("source_size"))
    plan = targets(totals.select(F.when(~F.col("unnamed"), F.col("name")).alias("source"), "source_size"), weights, share, cap)
    plan = common.saved(plan.select(*named, "source_size", "target", "budget"), "mix-targets")
    placed = common.before(base, sums, ["name", "unnamed"], "bucket", "total", ["key", "id", "size"], "size", "ahead")
    placed = placed.join(F.broadcast(plan), ["name", "unnamed"]) if plan.count() <= BROADCAST_SOURCES else placed.join(plan, ["name", "unnamed"])
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    rest = F.col("budget") - F.col("copies") * F.col("source_size") - F.col("ahead")
    return (
        placed.withColumn("copies", passes.cast("long"))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
        .select("row", "id", "source", "size", "source_size", "target", "taken", "copies", "part")
    )


def mixed(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, columns unchanged.

    The row at the cut is taken whole where at least half of it falls before the cut, so a source misses its budget by half a row at most.
    """
    half = ((F.col("part") * 2 >= F.col("size")) & (F.col("part") > 0)).cast("long")
    times = (F.col("copies") + half).cast("int")
    return mix(docs, size, **options).select(F.explode(F.array_repeat("row", times)).alias("row")).select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns]
    )
