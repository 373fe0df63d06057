"""Ordered per-group columns that survive a hot group.

A plain window puts a whole group into one task, which spills but takes long for a group
with much of the table. A caller whose groups may grow so passes ``spread=True``, and the same
columns are computed in two levels, whatever the sizes: the rows are range partitioned by
(group, order) so a hot group spans many chunks, each chunk runs the
window locally, and a carry per (group, chunk) links the chunks. Only groups that cross
a chunk border need a carry, at most two rows per chunk, so the carry table is
broadcast with a known bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelf.session import checkpoint_dir, written

CHUNK = "_chunk"


def chunk_column(group: Sequence[str], order: Sequence[str]) -> str:
    """Name of the chunk tag for an order; further group columns must follow the same order to share it."""
    return "_".join([CHUNK, group[0], *order])


def chunked(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Tag rows with a chunk number so that a group's chunks are contiguous in its order."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tagged = df.repartitionByRange(parts, *group, *order).withColumn(chunk_column(group, order), F.spark_partition_id())
    # range borders come from a sample, so the tag is written once and read back
    return tagged.checkpoint()


def numbered(df: DataFrame, order: Sequence[str | Column], keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` and ``nr``, each row's number from 0 in the total order ``order`` over all rows.

    Expressions in ``order`` are worked out once a row, not again whenever the sort compares two. Rows are range partitioned, sorted and written once without their order columns; a row's number is that in its chunk and the sizes of the chunks before,
    a table of one row a chunk that may be broadcast.
    """
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    names = [o if isinstance(o, str) else f"_o{i}" for i, o in enumerate(order)]
    df = df.select(*dict.fromkeys([*keep, *[o for o in order if isinstance(o, str)]]), *[o.alias(name) for o, name in zip(order, names) if not isinstance(o, str)])
    # the number holds the partition in its upper 31 bits and the row's place there in the lower 33
    dealt = df.repartitionByRange(parts, *names).sortWithinPartitions(*names).select(*keep, F.monotonically_increasing_id().alias("_nr"))
    dealt = written(dealt, "numbered")
    sizes = dealt.groupBy(F.shiftright("_nr", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    found = dealt.join(F.broadcast(before), F.shiftright("_nr", 33) == F.col("_part"))
    return found.select(*keep, (F.col("_before") + F.col("_nr").bitwiseAND(F.lit((1 << 33) - 1))).alias("nr"))


def _local(kind: str, value: Column | None, keys: list[str], order: Sequence[str]) -> Column:
    base = Window.partitionBy(*keys).orderBy(*order)
    upto = base.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = base.rowsBetween(Window.unboundedPreceding, -1)
    if kind == "row_number":
        return F.row_number().over(base).cast("long")
    if kind == "sum":
        return F.coalesce(F.sum(value).over(upto), F.lit(0))
    if kind == "sum_before":
        return F.coalesce(F.sum(value).over(before), F.lit(0))
    if kind == "last":
        return F.last(value, ignorenulls=True).over(upto)
    if kind == "last_before":
        return F.last(value, ignorenulls=True).over(before)
    if kind == "lag":
        return F.lag(value).over(base)
    if kind == "lead":
        return F.lead(value).over(base)
    raise ValueError(f"unknown window kind {kind}")


def ordered_columns(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    spread: bool = False,
    **specs: tuple,
) -> DataFrame:
    """Add ordered columns per group; ``order`` must be a total ascending order of plain columns.

    Each spec is ``name=(kind, column)`` with kind row_number, sum, sum_before, last,
    last_before, lag or lead. No job runs to decide the form. A frame already cut into chunks for this order reuses them.
    """
    group, order = list(group), list(order)
    chunk = chunk_column(group, order)
    if chunk not in df.columns:
        if not spread:
            for name, (kind, *value) in specs.items():
                df = df.withColumn(name, _local(kind, value[0] if value else None, group, order))
            return df
        df = chunked(df, group, order)

    keys = [chunk, *group]
    position = F.struct(*order)
    carries, links = [], []
    over_chunks = Window.partitionBy(*group).orderBy(chunk)
    earlier = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
    for i, (name, (kind, *value)) in enumerate(specs.items()):
        value = value[0] if value else None
        c, link = f"_c{i}", f"_k{i}"
        if kind == "row_number":
            carries.append(F.count(F.lit(1)).alias(c))
            links.append(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(link))
        elif kind in ("sum", "sum_before"):
            carries.append(F.sum(value).alias(c))
            links.append(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(link))
        elif kind in ("last", "last_before"):
            carries.append(F.max_by(value, F.when(value.isNotNull(), position)).alias(c))
            links.append(F.last(c, ignorenulls=True).over(earlier).alias(link))
        elif kind == "lag":
            carries.append(F.max_by(F.struct(value.alias("v")), position).alias(c))
            links.append(F.lag(c).over(over_chunks)["v"].alias(link))
        elif kind == "lead":
            carries.append(F.min_by(F.struct(value.alias("v")), position).alias(c))
            links.append(F.lead(c).over(over_chunks)["v"].alias(link))
    summary = df.groupBy(*keys).agg(*carries)
    crossing = F.count(F.lit(1)).over(Window.partitionBy(*group)) > 1
    # groups crossing a chunk border: at most two (group, chunk) pairs per chunk
    carry = summary.withColumn("_cross", crossing).filter("_cross").select(*keys, *links)
    carry = carry.select(
        *[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], *[f"_k{i}" for i in range(len(specs))]
    )
    edge = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(edge)).withColumn("_cn", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    for name, (kind, *value) in specs.items():
        out = out.withColumn(name, _local(kind, value[0] if value else None, keys, order))
    match = None
    for i, k in enumerate(keys):
        cond = F.col(k).eqNullSafe(F.col(f"_g{i}"))
        match = cond if match is None else match & cond
    out = out.join(F.broadcast(carry), match, "left")
    for i, (name, (kind, *_)) in enumerate(specs.items()):
        link = F.col(f"_k{i}")
        if kind in ("row_number", "sum", "sum_before"):
            out = out.withColumn(name, F.col(name) + F.coalesce(link, F.lit(0)))
        elif kind in ("last", "last_before"):
            out = out.withColumn(name, F.coalesce(F.col(name), link))
        elif kind == "lag":
            out = out.withColumn(name, F.when(F.col("_rn") == 1, link).otherwise(F.col(name)))
        else:
            out = out.withColumn(name, F.when(F.col("_rn") == F.col("_cn"), link).otherwise(F.col(name)))
    return out.drop("_rn", "_cn", *[f"_g{i}" for i in range(len(keys))], *[f"_k{i}" for i in range(len(specs))])
