"""Helpers that several operators share: written tables, free column names, prefix sums and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelf.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
#: First hex digits of an order key that number its bucket: 4096 buckets a group.
BUCKET_DIGITS = 3


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under the checkpoint folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: what follows neither recomputes nor changes it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: str, *values: Column) -> Column:
    """A hash-random order: 32 hex digits, the same for the same values in every run and in other SQL engines."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(v.cast("string"), F.lit("")) for v in values]))


def bucket_of(key: str) -> Column:
    return F.substring(F.col(key), 1, BUCKET_DIGITS)


def before(
    df: DataFrame, sums: DataFrame, group: Sequence[str], bucket: str, total: str, order: Sequence[str], value: str, into: str, whole: str | None = None,
) -> DataFrame:
    """Add the sum of ``value`` over the rows that stand before each row in its group, and the group's sum as ``whole`` if named.

    ``sums`` holds the ``total`` of each (group, bucket); ``order`` must agree with the buckets' order. No task sorts more
    than one bucket of a group, so a group with a third of all rows is dealt over 4096 pieces. Group columns must not be null.
    """
    start, all_ = fresh(df, "_start"), fresh(df, "_all")
    cells = [*group, bucket]
    ahead = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    right = sums.select(
        *cells, F.coalesce(F.sum(total).over(ahead), F.lit(0)).alias(start), *([F.sum(total).over(Window.partitionBy(*group)).alias(all_)] if whole else [])
    )
    # joined and numbered on the same columns, so the rows are shuffled once
    inside = Window.partitionBy(*cells).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.join(right, cells).withColumn(into, (F.col(start) + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")).drop(start)
    return placed.withColumn(whole, F.col(all_)).drop(all_) if whole else placed


def ranked(df: DataFrame, group: Sequence[str], key: str, value: str, into: str, ties: Sequence[str] = (), whole: str | None = None) -> DataFrame:
    """``before`` over buckets of a hex ``key``, its sums counted here; ``df`` is read twice, so it should be a written table."""
    bucket, total = fresh(df, "_bucket"), fresh(df, "_total")
    dealt = df.withColumn(bucket, bucket_of(key))
    sums = dealt.groupBy(*group, bucket).agg(F.sum(value).alias(total))
    return before(dealt, sums, group, bucket, total, [key, *ties], value, into, whole).drop(bucket)


def _mark(pairs: DataFrame):
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("h")).first()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): (node, root), root the smallest node; nodes without an edge are absent.

    Large-star and small-star rounds: each links a node's neighbours to the smallest of them, until the edges no longer
    change. Stars are made with a minimum per node (a partial aggregate) and a join, never with a list of neighbours.
    """
    pairs = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    mark = _mark(pairs)
    while mark["n"]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        ).distinct()
        pairs, last = saved(small, name), mark
        mark = _mark(pairs)
        if mark == last:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
