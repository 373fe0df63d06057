"""Snapshots of media folders and the small files beside media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.functions.names import extension, let

# fixed values: media types by extension
VIDEO_TYPES = {
    "mkv": "video/x-matroska", "mp4": "video/mp4", "m4v": "video/mp4", "mov": "video/quicktime", "avi": "video/x-msvideo",
    "wmv": "video/x-ms-wmv", "webm": "video/webm", "mpg": "video/mpeg", "mpeg": "video/mpeg", "ts": "video/mp2t",
    "m2ts": "video/mp2t", "flv": "video/x-flv",
}
AUDIO_TYPES = {
    "mp3": "audio/mpeg", "flac": "audio/flac", "m4a": "audio/mp4", "aac": "audio/aac", "ogg": "audio/ogg", "opus": "audio/ogg",
    "wav": "audio/wav", "aiff": "audio/aiff", "wma": "audio/x-ms-wma",
}
MAX_TEXT = 8 * 1024 * 1024  # fixed value: largest text sidecar read
MAX_IMAGE = 32 * 1024 * 1024  # fixed value: largest picture served


def scan(spark: SparkSession, roots: DataFrame, paths: list[str]) -> DataFrame:
    """Every visible file under the given folders: (root_id, rel_path, size, mtime).

    File contents are never read: only the listing columns are selected.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        .select(
            F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"),
            F.unix_timestamp("modificationTime").alias("mtime"),
        )
    )
    return locate(listed, roots)


#: Roots up to this many are sent to every task as one map.
MAPPED_ROOTS = 1000


def locate(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Each path under its longest matching root; paths outside every root and hidden ones drop out.

    Every folder above a path is a candidate root, so paths meet roots by equality.
    """
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    named = roots.groupBy(F.regexp_replace("path", "/+$", "").alias("_root")).agg(F.min(F.struct("root_id", "kind")).alias("r"))
    keep = [c for c in files.columns if c != "path"]
    few = named.limit(MAPPED_ROOTS + 1).collect()
    if not few:
        return files.limit(0).select(F.lit(0).cast("long").alias("root_id"), F.lit("").alias("kind"), F.lit("").alias("rel_path"), *keep)
    if len(few) <= MAPPED_ROOTS:
        # configured roots are few: a literal map of them goes to every task, and no file is shuffled
        known = F.create_map(*[x for r in few for x in (F.lit(r["_root"]), F.struct(F.lit(r["r"]["root_id"]).alias("root_id"), F.lit(r["r"]["kind"]).alias("kind")))])
        # only folders as deep as some root are tried, deepest first; the root found is looked up once, in a generator that no filter repeats
        depths = sorted({r["_root"].count("/") + 1 for r in few}, reverse=True)
        tried = [F.when(F.size(parts) > n, F.substring_index("path", "/", n)) for n in depths]
        hits = [F.when(F.map_contains_key(known, p), p) for p in tried]
        fit = let(F.coalesce(*hits), lambda p: F.filter(F.array(F.struct(p.alias("_root"), F.try_element_at(known, p).alias("r"))), lambda x: x["_root"].isNotNull()))
        found = files.select("*", F.inline(fit))
    else:
        # numbered, so that equal rows stay apart
        listed = files.withColumn("_nr", F.monotonically_increasing_id()).withColumn("_root", F.explode(above)).join(named, "_root")
        best = listed.groupBy("_nr").agg(F.max_by(F.struct(*files.columns, "_root", "r"), F.length("_root")).alias("b"))
        found = best.select("b.*")
    out = found.select("r.root_id", "r.kind", F.substr("path", F.length("_root") + 2).alias("rel_path"), *keep)
    return out.filter((F.col("rel_path") != "") & ~F.col("rel_path").rlike(r"(^|/)\."))


def mime_types(spark: SparkSession) -> DataFrame:
    """The fixed table of known extensions."""
    rows = [(e, True, m) for e, m in VIDEO_TYPES.items()] + [(e, False, m) for e, m in AUDIO_TYPES.items()]
    return spark.createDataFrame(rows, "ext string, is_video boolean, mime string")


def media_files(files: DataFrame) -> DataFrame:
    """Files of the type their root holds: video under movie and TV roots, audio under music roots."""
    types = mime_types(files.sparkSession)
    keyed = files.withColumn("ext", extension(F.col("rel_path"))).withColumn("is_video", F.col("kind") != "music")
    # a fixed table of 21 rows
    return keyed.join(F.broadcast(types), ["ext", "is_video"]).drop("ext", "is_video")


def within(size: Column, cap: int) -> Column:
    return size <= cap


def read_sidecars(spark: SparkSession, paths: list[str], pattern: str, cap: int = MAX_TEXT) -> DataFrame:
    """Contents of small files by name pattern; larger ones are skipped by the length filter before reading."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(paths)
        .filter(F.col("length") <= cap)
        .select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"),
                F.unix_timestamp("modificationTime").alias("mtime"), "content")
    )
