"""Leaf counts that mirror the listings: copies of one work count once, folders count files.

Where items have a column ``files``, a row stands for so many files that nothing here tells apart, with ``uhd``, ``rated`` and ``folder`` in
place of what they are worked out from, and a null is what a row doesn't tell (``tree.grouped``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.functions.keys import UNRATED, decade, display_album, display_artist, is_uhd, rating_bucket
from shelf.operators.merge import episode_keys, movie_keys


def files_in(items: DataFrame) -> Column:
    """The files of a group of items."""
    return F.sum("files") if "files" in items.columns else F.count(F.lit(1))


def _weight(items: DataFrame) -> list[str]:
    return ["files"] if "files" in items.columns else []


def uhd_of(items: DataFrame) -> Column:
    return F.col("uhd") if "uhd" in items.columns else is_uhd(F.col("width"), F.col("height"))


def rated_of(items: DataFrame) -> Column:
    return F.col("rated") if "rated" in items.columns else rating_bucket(F.col("rating"))


def folder_of(path: Column) -> Column:
    """The folder that holds a path, '' for one at the top."""
    rest = F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1
    return F.when(path.contains("/"), F.substring(path, F.lit(1), rest)).otherwise(F.lit(""))


def big_franchises(items: DataFrame) -> DataFrame:
    """Collections holding two or more files, by lower-case name."""
    named = items.filter("collection is not null and collection <> ''")
    return (
        named.groupBy(F.lower("collection").alias("k_collection"))
        .agg(F.min_by("collection", "file_id").alias("name"), files_in(items).alias("files"))
        .filter("files >= 2")
    )


def movie_totals(items: DataFrame) -> DataFrame:
    """One row of distinct-work counts.

    A work counts toward a column when any of its copies qualifies, so each predicate is
    a max per work; one shuffle serves every column.
    """
    marked = items.join(
        big_franchises(items).select("k_collection", F.lit(True).alias("_set")),
        F.lower("collection") == F.col("k_collection"), "left",
    )
    rated = rated_of(items)
    tests = {
        "total": F.lit(True),
        "uhd": uhd_of(items),
        "dated": F.col("year").isNotNull(),
        "with_genre": F.col("genre").isNotNull(),
        "with_director": F.col("director").isNotNull(),
        "in_franchises": F.coalesce("_set", F.lit(False)),
        "unrated": rated == UNRATED,
        **{f"rated_{i}": rated == i for i in range(5)},
    }
    works = marked.groupBy(*[c.alias(n) for n, c in movie_keys().items()]).agg(
        *[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in tests.items()]
    )
    return works.agg(*[F.count_if(F.col(n)).alias(n) for n in tests])


def movie_counts(items: DataFrame) -> DataFrame:
    """Distinct works by year, decade, genre, director, franchise and rating bucket in one job.

    A franchise counts from two files on, so files are counted along with the works.
    """
    def pair(dim: str, value: Column) -> Column:
        return F.struct(F.lit(dim).alias("dim"), value.cast("string").alias("value"))

    groups = F.array(
        pair("year", F.col("year")), pair("decade", decade(F.col("year"))), pair("genre", F.col("genre")),
        pair("director", F.col("director")), pair("rating", rated_of(items)),
        pair("franchise", F.nullif(F.lower("collection"), F.lit(""))),
    )
    keys = movie_keys()
    pairs = items.select(*[c.alias(n) for n, c in keys.items()], *_weight(items), F.explode(groups).alias("g")).filter("g.value is not null")
    works = pairs.groupBy("g.dim", "g.value", *keys).agg(files_in(items).alias("files"))
    counted = works.groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("files").alias("files"))
    return counted.filter("dim <> 'franchise' or files >= 2").select("dim", "value", "n")


def track_counts(tracks: DataFrame) -> DataFrame:
    """Tracks in total, by artist and by album of artist, from one rollup."""
    shown = tracks.select(
        display_artist(F.col("album_artist"), F.col("artist")).alias("artist"), display_album(F.col("album")).alias("album"), "genre", *_weight(tracks)
    )
    named = F.sum(F.when(F.col("genre").isNotNull(), F.col("files")).otherwise(0)) if _weight(tracks) else F.count("genre")
    return shown.rollup("artist", "album").agg(files_in(tracks).alias("n"), named.alias("with_genre"), F.grouping_id().alias("level"))


def track_genre_counts(tracks: DataFrame) -> DataFrame:
    return tracks.filter("genre is not null").groupBy("genre").agg(files_in(tracks).alias("n"))


def episode_counts(episodes: DataFrame) -> DataFrame:
    """Distinct episodes in total, by series and by season, with those above 1080p."""
    works = episodes.groupBy(*[c.alias(n) for n, c in episode_keys().items()]).agg(
        F.max(uhd_of(episodes)).alias("uhd")
    )
    return works.rollup("k_series", "k_season").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("uhd")).alias("uhd"), F.grouping_id().alias("level")
    )


def file_counts(files: DataFrame) -> DataFrame:
    """Visible files per kind and per root of a kind."""
    return files.rollup("kind", "root_id").agg(files_in(files).alias("n"), F.grouping_id().alias("level")).filter("level < 3")


def ancestors(rel_path: Column) -> Column:
    """Every folder above a file, outermost first ('' is the root itself and left out)."""
    parts = F.split(rel_path, "/")
    depth = F.size(parts) - 1
    return F.when(
        depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    ).otherwise(F.array().cast("array<string>"))


def folders(files: DataFrame) -> DataFrame:
    """(root_id, folder, files): the files that lie in each folder itself, but not at the top."""
    held = F.col("folder") if "folder" in files.columns else folder_of(F.col("rel_path"))
    return files.select("root_id", held.alias("folder"), *_weight(files)).filter("folder <> ''").groupBy("root_id", "folder").agg(files_in(files).alias("files"))


def folder_counts(files: DataFrame) -> DataFrame:
    """Files under every folder at any depth, all levels in one job; files are gathered by folder before the folders above are worked out."""
    above = ancestors(F.concat("folder", F.lit("/")))
    return folders(files).select("root_id", F.explode(above).alias("rel_dir"), "files").groupBy("root_id", "rel_dir").agg(F.sum("files").alias("n"))
