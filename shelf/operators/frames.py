"""Display order of coded pictures and the composition offsets it implies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.operators.windows import ordered_columns


def display_ranks(pictures: DataFrame, log2_max: int, spread: bool = False) -> DataFrame:
    """Rank of each picture (file_id, idx, nal_type, poc_lsb) in display order, with its sequence and order count.

    The high part of the order count is carried by the previous reference picture of the
    sequence: it steps up or down when the low part wraps. Steps only happen between
    consecutive references, so the carry is a running sum of wraps.
    """
    limit = 2**log2_max
    nal, lsb = F.col("nal_type"), F.col("poc_lsb")
    ordinal = ordered_columns(pictures, ["file_id"], ["idx"], spread, ordinal=("row_number",))
    starts = nal.isin(19, 20) | (nal.between(16, 23) & (F.col("ordinal") == 1))
    ref = ~nal.between(6, 9) & ~((nal < 16) & (nal % 2 == 0))
    marked = ordinal.withColumn("_start", starts.cast("int")).withColumn("_ref", ref)
    marked = ordered_columns(marked, ["file_id"], ["idx"], spread, _cvs=("sum", F.col("_start")), prev_lsb=("last_before", F.when(F.col("_ref"), lsb)))
    prev = F.coalesce("prev_lsb", F.lit(0))
    wrap = (
        F.when(F.col("_start") == 1, 0).when((lsb < prev) & (prev - lsb >= limit // 2), 1).when((lsb > prev) & (lsb - prev > limit // 2), -1).otherwise(0)
    )
    marked = marked.withColumn("_wrap", wrap).withColumn("_seq", F.col("_cvs"))
    carried = F.when(F.col("_ref"), F.col("_wrap")).otherwise(0)
    marked = marked.withColumn("_carried", carried)
    # wraps of earlier references within the sequence, then this picture's own
    marked = ordered_columns(marked, ["file_id", "_seq"], ["idx"], spread, _before=("sum_before", F.col("_carried")))
    poc = (F.col("_before") + F.col("_wrap")) * limit + lsb
    placed = marked.withColumn("poc", poc.cast("long")).withColumn("cvs", (F.col("_cvs") - 1).cast("long"))
    ranked = ordered_columns(placed, ["file_id"], ["cvs", "poc", "idx"], spread, rank=("row_number",))
    return ranked.select("file_id", "idx", (F.col("ordinal") - 1).alias("ordinal"), "cvs", "poc", (F.col("rank") - 1).alias("rank"))


def offsets(samples: DataFrame, ranks: DataFrame) -> DataFrame:
    """Composition offset of every sample (file_id, idx, dts); samples without a picture keep 0.

    The j-th picture shows at the decode time of the picture of its rank, plus the
    smallest delay that keeps every offset non-negative.
    """
    timed = ranks.join(samples.select("file_id", "idx", "dts"), ["file_id", "idx"])
    shown_at = timed.select("file_id", F.col("ordinal").alias("rank"), F.col("dts").alias("shown"))
    both = timed.join(shown_at, ["file_id", "rank"])
    delays = both.groupBy("file_id").agg(F.greatest(F.max(F.col("dts") - F.col("shown")), F.lit(0)).alias("delay"))
    placed = both.join(delays, "file_id").select("file_id", "idx", "delay", (F.col("shown") + F.col("delay") - F.col("dts")).alias("offset"))
    return samples.join(placed, ["file_id", "idx"], "left").select(
        "file_id", "idx", "dts", F.coalesce("offset", F.lit(0)).cast("long").alias("offset"), F.coalesce("delay", F.lit(0)).cast("long").alias("delay")
    )


def offset_runs(placed: DataFrame, spread: bool = False) -> DataFrame:
    """Runs of equal offsets in sample order: (file_id, run, samples, offset)."""
    seen = ordered_columns(placed, ["file_id"], ["idx"], spread, _prev=("lag", F.col("offset")))
    seen = seen.withColumn("_new", F.when(F.col("_prev") == F.col("offset"), 0).otherwise(1))
    seen = ordered_columns(seen, ["file_id"], ["idx"], spread, run=("sum", F.col("_new")))
    return seen.groupBy("file_id", "run", "offset").agg(F.count(F.lit(1)).alias("samples"))


def frame_audit(files: DataFrame) -> DataFrame:
    """Why a file needs no offsets, or that it does: is_mp4, has_video, has_ctts, codec, reorder."""
    verdict = (
        F.when(~F.col("is_mp4"), "not an MP4").when(~F.col("has_video"), "no video track").when(F.col("has_ctts"), "has ctts")
        .when(F.col("codec").isNull(), "no sample description").when(~F.col("codec").isin("hvc1", "hev1"), "not HEVC")
        .when(F.coalesce("reorder", F.lit(0)) == 0, "no reordering").otherwise("would repair")
    )
    return files.select("file_id", verdict.alias("verdict"))
