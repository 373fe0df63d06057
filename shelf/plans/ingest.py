"""Catalog refresh: one job graph from snapshots and sidecars to the next set of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.operators import reconcile, segments
from shelf.session import checkpoint_dir
from shelf.sources import inventory as inv
from shelf.sources import probes, sidecars
from shelf.sources.catalog import conform


@dataclass
class Found:
    """What the disk and the probes say."""

    roots: DataFrame  # root_id, path, kind
    inventory: DataFrame  # root_id, kind, rel_path, size, mtime: every visible file
    texts: DataFrame  # root_id, rel_path, text: nfo, edl and music.toml sidecars
    probes: DataFrame  # root_id, rel_path, json
    tags: DataFrame  # root_id, rel_path, title, artist, album_artist, album, genre, track_no, disc_no, year, embedded_art


def refresh(known: dict[str, DataFrame], found: Found, now: int, grace_s: int = 30) -> dict[str, DataFrame]:
    """Catalog tables after a refresh; rows whose file and sidecars stand as they did are carried over.

    The frames every table draws on are written to the checkpoint folder once, so a dozen
    output tables do not each repeat the diff and the parsing.
    """
    checkpoint_dir(found.roots.sparkSession)
    on = ["root_id", "rel_path"]
    media = inv.media_files(found.inventory)
    fresh = media.filter(F.lit(now) - F.col("mtime") < max(grace_s, 1)).select(*on)
    walk = reconcile.settled(media, now, grace_s)
    walk = reconcile.beside(walk, found.inventory, "nfo", "nfo_mtime")
    walk = reconcile.beside(walk, found.inventory, "edl", "edl_mtime")
    walk = reconcile.discover_art(walk, found.inventory)
    tomls = found.inventory.filter(F.col("rel_path").rlike("(^|/)music\\.toml$")).select(
        "root_id", reconcile.folder_of(F.col("rel_path")).alias("rel_dir"), F.col("mtime")
    )
    newest = newest_override(walk, tomls)
    walk = walk.join(newest, on, "left")

    files = known["files"]
    # a file still being written keeps its row untouched
    held = files.join(fresh, on, "left_semi")
    diffed = reconcile.diff(files.join(fresh, on, "left_anti"), walk, found.roots)
    diffed = diffed.checkpoint()
    after = reconcile.next_files(diffed, files, now).checkpoint()
    redo = after.filter(F.col("action").isin("new", "changed", "retry", "stale"))
    keep = after.filter("action = 'same'").select("file_id").unionByName(held.select("file_id"))
    keep = keep.unionByName(reconcile.untouched_roots(files, found.roots).select("file_id"))

    job = redo.select("file_id", *on, "kind")
    side = job.withColumn("_side", reconcile.sibling(F.col("rel_path"), "nfo"))
    nfo_text = found.texts.filter(F.col("rel_path").endswith(".nfo")).select("root_id", F.col("rel_path").alias("_side"), "text")
    nfo = sidecars.read_nfo(side.join(nfo_text, ["root_id", "_side"]).select("file_id", "text"))
    probed = job.join(found.probes, on).select("file_id", "json")
    tech = probes.tech_columns(probed).checkpoint()
    tagged = job.join(found.tags, on).drop(*on, "kind")
    overrides = sidecars.music_overrides(found.texts)

    nfo = nfo.checkpoint()
    film = reconcile.movie_facts(job.filter("kind = 'movies'"), nfo, tech).checkpoint()
    shows = reconcile.episode_facts(job.filter("kind = 'tv'"), nfo)
    songs = reconcile.track_facts(job.filter("kind = 'music'"), tagged.drop("embedded_art"), overrides).checkpoint()

    def carried(name: str, new: DataFrame) -> DataFrame:
        old = known[name].join(keep, "file_id", "left_semi")
        return conform(old, name).unionByName(conform(new, name))

    genres = reconcile.ensure_names(
        known["genres"], film.select(F.explode("genres").alias("name")).unionByName(songs.select(F.explode("genres").alias("name")))
    )
    genres = genres.checkpoint()
    directors = reconcile.ensure_names(known["directors"], film.select(F.explode("directors").alias("name"))).checkpoint()

    def bridged(facts: DataFrame, column: str, dimension: DataFrame, key: str) -> DataFrame:
        used = facts.select("file_id", F.explode(column).alias("n")).select("file_id", F.lower(F.trim("n")).alias("_k"))
        ids = dimension.select(F.lower("name").alias("_k"), F.col("id").alias(key))
        return used.join(ids, "_k").select("file_id", key).distinct()

    walked = diffed.filter("action <> 'vanished'").select(*on, "nfo_mtime", "edl_mtime", "found_art")
    embedded = tagged.filter("embedded_art").select("file_id", F.lit("embedded").alias("_art"))
    done = redo.join(walked, on).join(tech.drop("tag_genre"), "file_id", "left").join(embedded, "file_id", "left")
    # music without readable tags could not be read at all; video is catalogued without technical facts
    readable = tagged.select("file_id", F.lit(True).alias("_read"))
    done = done.join(readable, "file_id", "left").withColumn(
        "status", F.when((F.col("kind") == "music") & F.col("_read").isNull(), "error").otherwise("ready")
    )
    done = done.withColumn("art", F.coalesce("found_art", "_art")).withColumn("updated_at", F.lit(now).cast("long"))
    stay = files.join(keep, "file_id", "left_semi").drop("added_at").join(
        after.select("file_id", "added_at").unionByName(
            files.join(after.select("file_id"), "file_id", "left_anti").select("file_id", "added_at")
        ), "file_id",
    )
    new_files = conform(stay, "files").unionByName(conform(done, "files"))
    good = done.filter("status = 'ready'").select("file_id")

    edl_lines = side_text(job, found.texts, "edl")
    chosen = segments.discovered(
        job.filter("kind <> 'music'").join(tech.select("file_id", "duration_ms"), "file_id", "left"), edl_lines, probes.chapters(probed)
    )
    old_segments = known["segments"].join(keep.unionByName(job.select("file_id")), "file_id", "left_semi")
    series, seasons = sidecars.folder_facts(found.texts)
    return {
        "roots": found.roots,
        "files": new_files,
        "movies": carried("movies", film),
        "tv_episodes": carried("tv_episodes", shows),
        "music_tracks": carried("music_tracks", songs.join(good, "file_id", "left_semi")),
        "genres": genres,
        "directors": directors,
        "movie_genres": carried("movie_genres", bridged(film, "genres", genres, "genre_id")),
        "movie_directors": carried("movie_directors", bridged(film, "directors", directors, "director_id")),
        "track_genres": carried("track_genres", bridged(songs.join(good, "file_id", "left_semi"), "genres", genres, "genre_id")),
        "tv_series": upserted(known["tv_series"], series, ["name"]),
        "tv_seasons": upserted(known["tv_seasons"], seasons, ["series", "season"]),
        "segments": segments.replace_segments(old_segments, job.select("file_id"), chosen),
        # prints carry the size and time they were taken at, so those of a changed file are stale by themselves
        "segment_prints": known["segment_prints"].join(new_files.select("file_id"), "file_id", "left_semi"),
        "watch": known["watch"],
    }


def newest_override(media: DataFrame, tomls: DataFrame) -> DataFrame:
    """(root_id, rel_path) of music with the newest mtime among override files in the folders above."""
    music = media.filter("kind = 'music'").withColumn("_dir", reconcile.folder_of(F.col("rel_path")))
    parts = F.when(F.col("_dir") == "", F.array().cast("array<string>")).otherwise(F.split("_dir", "/"))
    above = F.transform(F.sequence(F.lit(0), F.size("_parts")), lambda i: F.array_join(F.slice("_parts", F.lit(1), i), "/"))
    dirs = music.select("root_id", "_dir").distinct().withColumn("_parts", parts)
    newest = (
        dirs.select("root_id", "_dir", F.explode(above).alias("rel_dir")).join(tomls, ["root_id", "rel_dir"])
        .groupBy("root_id", "_dir").agg(F.max("mtime").alias("override_mtime"))
    )
    return music.join(newest, ["root_id", "_dir"]).select("root_id", "rel_path", "override_mtime")


def side_text(job: DataFrame, texts: DataFrame, ext: str) -> DataFrame:
    """(file_id, text) of same-stem sidecars of a type."""
    side = job.withColumn("_side", reconcile.sibling(F.col("rel_path"), ext))
    found = texts.filter(F.col("rel_path").endswith("." + ext)).select("root_id", F.col("rel_path").alias("_side"), "text")
    return side.join(found, ["root_id", "_side"]).select("file_id", "text")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows with new ones in place of those sharing a key, string keys compared without case."""
    folded = lambda df: df.select("*", *[F.lower(F.col(k).cast("string")).alias("_k" + k) for k in key])
    marks = ["_k" + k for k in key]
    left = folded(old).join(folded(new).select(*marks), marks, "left_anti").drop(*marks)
    return left.unionByName(new.select(*old.columns))
