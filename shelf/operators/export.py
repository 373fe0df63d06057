"""Exports: playlists, sidecar inventories and item facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.functions.keys import playlist_title
from shelf.functions.names import path_stem
from shelf.operators.items import ready
from shelf.sources.inventory import MAX_TEXT


def playlist_lines(items: DataFrame, base_url: str) -> DataFrame:
    """One playlist entry per item: length in seconds (-1 unknown), title on one line, link."""
    title = playlist_title(*[F.col(c) for c in ("kind", "title", "year", "series", "season", "episode", "artist", "album")])
    secs = F.coalesce(F.floor(F.col("duration_ms") / 1000).cast("string"), F.lit("-1"))
    entry = F.concat(
        F.lit("#EXTINF:"), secs, F.lit(","), F.translate(title, "\n\r", "  "), F.lit(f"\n{base_url}/media/"), F.col("file_id").cast("string")
    )
    return items.withColumn("entry", entry)


def write_playlists(items: DataFrame, base_url: str, order: list[str], path: str) -> None:
    """Playlists by node under ``node_id=...`` folders, each in its listing's order, header line first.

    Rows are range partitioned by node and order, so a large playlist is several part
    files whose names keep the order.
    """
    lines = playlist_lines(items, base_url).select("node_id", *order, "entry")
    head = items.select("node_id").distinct().select("node_id", F.lit("#EXTM3U").alias("value"), F.lit(0).alias("_h"))
    body = lines.select("node_id", *order, F.col("entry").alias("value"), F.lit(1).alias("_h"))
    both = body.unionByName(head, allowMissingColumns=True)
    keys = ["node_id", "_h", *order]
    placed = both.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed.select("node_id", "value").write.mode("overwrite").partitionBy("node_id").text(path)


def caption_inventory(files: DataFrame, roots: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every visible video with whether a usable .srt and .rttm stand beside it, and its audio link."""
    video = ready(files).filter(F.col("kind").isin("movies", "tv")).join(roots.select("root_id", F.col("path").alias("root")), "root_id")
    # sidecars are gathered by stem, so that videos meet both kinds in one join
    ext = F.substring_index("rel_path", ".", -1)
    small = inventory.filter((F.col("size") <= MAX_TEXT) & F.col("rel_path").rlike(r"\.(srt|rttm)\z"))
    beside = small.groupBy("root_id", F.regexp_replace("rel_path", r"\.(srt|rttm)\z", "").alias("_stem")).agg(
        F.max(ext == "srt").alias("srt"), F.max(ext == "rttm").alias("rttm")
    )
    video = video.withColumn("_stem", F.coalesce(path_stem(F.col("rel_path")), F.col("rel_path"))).join(beside, ["root_id", "_stem"], "left")
    video = video.withColumn("srt", F.coalesce("srt", F.lit(False))).withColumn("rttm", F.coalesce("rttm", F.lit(False)))
    return video.select(
        F.col("file_id").alias("id"), "kind", "root", F.col("rel_path").alias("path"), "duration_ms", "srt", "rttm",
        F.concat(F.lit("/audio/"), F.col("file_id").cast("string"), F.lit(".flac")).alias("audio"),
    )
