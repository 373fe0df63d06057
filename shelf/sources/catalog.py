"""Catalog tables on disk: fixed schemas and versions, each a marker file that names the folder of every table.

A commit writes its tables to folders of its own and then creates the next version's marker, which fails if another
writer was first. Tables that a commit does not name stay where the version before has them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS: dict[str, str] = {
    "roots": "root_id long, path string, kind string",
    "files": (
        "file_id long, root_id long, rel_path string, size long, mtime long, mime string, container string, duration_ms long, "
        "width int, height int, video_codec string, audio_codec string, status string, updated_at long, nfo_mtime long, art string, "
        "added_at long, audio_profile string, audio_bitrate long, audio_sample_rate long, audio_bit_depth long, audio_channels long, "
        "edl_mtime long, frame_rate double, kind string"
    ),
    "movies": "file_id long, title string, sort_title string, year int, rating double, plot string, imdb_id string, collection string",
    "genres": "id long, name string",
    "directors": "id long, name string",
    "movie_genres": "file_id long, genre_id long",
    "track_genres": "file_id long, genre_id long",
    "movie_directors": "file_id long, director_id long",
    "tv_episodes": "file_id long, series string, season int, episode int, title string, plot string, rating double, imdb_id string, aired string",
    "tv_series": "name string, plot string, rating double, imdb_id string, premiered string",
    "tv_seasons": "series string, season int, plot string",
    "music_tracks": "file_id long, title string, artist string, album_artist string, album string, track_no int, disc_no int, year int",
    "segments": "file_id long, start_ms long, end_ms long, kind string, source string",
    "segment_prints": "file_id long, size long, mtime long, ver int, head array<long>, tail array<long>",
    "watch": "profile_id long, key string, file_id long, position_ms long, duration_ms long, watched boolean, updated_at timestamp, dismissed boolean",
}
PARTITIONED = {"files": ["kind"]}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def conform(df: DataFrame, name: str, *more: str) -> DataFrame:
    """A frame cast to a table's columns; missing columns are null. ``more`` names columns to keep beside them."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)
    ], *more)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


class CommitConflict(RuntimeError):
    """Another writer committed the version first; read the catalog anew and write again."""


def _versions(spark: SparkSession, base: str) -> list[int]:
    target, fs = _hadoop(spark, f"{base}/_versions")
    if not fs.exists(target):
        return []
    return sorted((int(s.getPath().getName()) for s in fs.listStatus(target) if s.getPath().getName().isdigit()), reverse=True)


def manifest(spark: SparkSession, base: str, version: int) -> dict | None:
    """What a version's marker says: the folder of each table, and the last batch of each stream; None where it isn't whole."""
    target, fs = _hadoop(spark, f"{base}/_versions/{version}")
    stream = fs.open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return None
    finally:
        stream.close()


def current(spark: SparkSession, base: str) -> tuple[int, dict]:
    """The newest committed version and its manifest; version 0 with no tables before the first commit."""
    for version in _versions(spark, base):
        if (found := manifest(spark, base, version)) is not None:
            return version, found
    return 0, {"tables": {}, "streams": {}}


def current_version(spark: SparkSession, base: str) -> int | None:
    """The newest committed version."""
    return current(spark, base)[0] or None


def last_batch(spark: SparkSession, base: str, stream: str) -> int | None:
    """The newest batch of a stream that the catalog holds."""
    return current(spark, base)[1]["streams"].get(stream)


def write_snapshot(spark: SparkSession, base: str, tables: dict[str, DataFrame], stream: str | None = None, batch: int | None = None) -> int:
    """Commit tables as the next version, with those not given as they stand; readers see all of it once the marker is whole.

    ``stream`` and ``batch`` are recorded with the version. Raises CommitConflict if another writer commits the same version.
    """
    before, known = current(spark, base)
    version = next_version(spark, base, before)
    folder = f"{base}/data/{version}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        writer = conform(df, name).write
        if name in PARTITIONED:
            writer = writer.partitionBy(*PARTITIONED[name])
        writer.parquet(f"{folder}/{name}")
    where = {**known["tables"], **{name: f"{folder.removeprefix(base + '/')}/{name}" for name in tables}}
    # a table written whole has its deltas in it
    deltas = {name: d for name, d in known.get("deltas", {}).items() if name not in tables}
    commit(spark, base, version, where, deltas, {**known["streams"], **({stream: batch} if stream else {})})
    return version


def next_version(spark: SparkSession, base: str, before: int) -> int:
    return max([before, *_versions(spark, base)]) + 1


def commit(spark: SparkSession, base: str, version: int, tables: dict[str, str], deltas: dict[str, list], streams: dict[str, int]) -> None:
    """Create a version's marker; raises CommitConflict if another writer was first."""
    marker, fs = _hadoop(spark, f"{base}/_versions/{version}")
    try:
        out = fs.create(marker, False)
    except Exception as e:  # the file system says which class; all mean that the marker is there or can't be made
        raise CommitConflict(f"version {version} of {base} was committed by another writer") from e
    out.write(bytearray(json.dumps({"tables": tables, "deltas": deltas, "streams": streams}).encode()))
    out.close()


def read_table(spark: SparkSession, base: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the newest (or a given) version; empty where it was never written."""
    said = manifest(spark, base, version) if version else current(spark, base)[1]
    where = (said or {"tables": {}})["tables"].get(name)
    whole = spark.createDataFrame([], schema(name)) if where is None else spark.read.schema(schema(name)).parquet(f"{base}/{where}")
    changes = (said or {}).get("deltas", {}).get(name)
    if not changes:
        return whole
    from shelf.sources import deltas

    return deltas.laid_over(spark, base, name, whole, changes)
