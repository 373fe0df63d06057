"""Item rows put together from the catalog's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.functions.keys import display_album, display_artist
from shelf.functions.names import sort_title, stem


def ready(files: DataFrame) -> DataFrame:
    """Only finished files are visible to readers."""
    return files.filter(F.col("status") == "ready")


def name_lists(bridge: DataFrame, dimension: DataFrame, key: str, out: str) -> DataFrame:
    """Names per file as one sorted comma list; a file has few names by nature."""
    named = bridge.join(dimension, key).select("file_id", "name")
    return named.groupBy("file_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias(out))


def movie_items(files: DataFrame, movies: DataFrame, movie_genres: DataFrame, genres: DataFrame,
                movie_directors: DataFrame, directors: DataFrame) -> DataFrame:
    """Movie rows with genre and director lists."""
    return (
        ready(files)
        .join(movies, "file_id")
        .join(name_lists(movie_genres, genres, "genre_id", "genre"), "file_id", "left")
        .join(name_lists(movie_directors, directors, "director_id", "director"), "file_id", "left")
        .withColumn("has_art", F.col("art").isNotNull())
    )


def episode_items(files: DataFrame, episodes: DataFrame) -> DataFrame:
    return ready(files).join(episodes, "file_id").withColumn("has_art", F.col("art").isNotNull())


def track_items(files: DataFrame, tracks: DataFrame, track_genres: DataFrame, genres: DataFrame) -> DataFrame:
    return (
        ready(files)
        .join(tracks, "file_id")
        .join(name_lists(track_genres, genres, "genre_id", "genre"), "file_id", "left")
        .withColumn("has_art", F.col("art").isNotNull())
    )


def any_items(files: DataFrame, movies: DataFrame, episodes: DataFrame, tracks: DataFrame) -> DataFrame:
    """A row for every visible file of any kind; untitled ones go by their file name."""
    m = movies.select("file_id", F.col("title").alias("m_title"), F.col("year").alias("m_year"), F.col("rating").alias("m_rating"))
    t = episodes.select("file_id", "series", "season", "episode", F.col("title").alias("t_title"), F.col("rating").alias("t_rating"))
    mu = tracks.select("file_id", F.col("title").alias("mu_title"), F.col("year").alias("mu_year"), "artist", "album", "track_no")
    return (
        ready(files).join(m, "file_id", "left").join(t, "file_id", "left").join(mu, "file_id", "left")
        .select(
            "file_id", "kind", "root_id", "rel_path", "mime", "size", "duration_ms", "width", "height", "updated_at",
            F.coalesce("m_title", "mu_title", "t_title", stem(F.col("rel_path"))).alias("title"),
            F.coalesce("m_year", "mu_year").alias("year"),
            F.coalesce("m_rating", "t_rating").alias("rating"),
            "series", "season", "episode", "artist", "album", "track_no",
            F.col("art").isNotNull().alias("has_art"),
        )
    )


def details(files: DataFrame, movies: DataFrame, episodes: DataFrame, tracks: DataFrame,
            movie_genre: DataFrame, track_genre: DataFrame, director: DataFrame) -> DataFrame:
    """Everything known about each visible file; the last three frames are (file_id, name list)."""
    def renamed(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("file_id", *[F.col(c).alias(prefix + c) for c in df.columns if c != "file_id"])

    joined = (
        ready(files)
        .join(renamed(movies, "m_"), "file_id", "left")
        .join(renamed(episodes, "t_"), "file_id", "left")
        .join(renamed(tracks, "u_"), "file_id", "left")
        .join(movie_genre.withColumnRenamed("genre", "m_genre"), "file_id", "left")
        .join(track_genre.withColumnRenamed("genre", "u_genre"), "file_id", "left")
        .join(director, "file_id", "left")
    )
    return joined.select(
        *[c for c in files.columns if c not in ("status", "art")],
        F.coalesce("m_title", "u_title", "t_title", stem(F.col("rel_path"))).alias("title"),
        F.from_unixtime("added_at").alias("added_at_text"),
        F.col("art").isNotNull().alias("has_art"),
        F.coalesce("m_year", "u_year").alias("year"),
        F.coalesce("m_rating", "t_rating").alias("rating"),
        F.coalesce("m_plot", "t_plot").alias("plot"),
        F.coalesce("m_imdb_id", "t_imdb_id").alias("imdb_id"),
        F.nullif(F.col("m_collection"), F.lit("")).alias("collection"),
        F.coalesce("m_genre", "u_genre").alias("genre"),
        "director",
        F.col("t_series").alias("series"), F.col("t_season").alias("season"), F.col("t_episode").alias("episode"),
        F.col("t_aired").alias("aired"),
        F.col("u_artist").alias("artist"), F.col("u_album").alias("album"), F.col("u_track_no").alias("track_no"),
        F.col("u_album_artist").alias("album_artist"),
    )


def servable(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Full path and type of each visible file; the root list is a small configured table."""
    return ready(files).join(roots.select("root_id", "path"), "root_id").select(
        "file_id", F.concat_ws("/", "path", "rel_path").alias("abs_path"), "mime"
    )


def art_sources(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Where each visible file's picture lives: in the file itself or beside it under its root."""
    embedded = F.col("art") == "embedded"
    return ready(files).filter("art is not null").join(roots.select("root_id", "path"), "root_id").select(
        "file_id",
        F.when(embedded, "embedded").otherwise("file").alias("source"),
        F.concat_ws("/", "path", F.when(embedded, F.col("rel_path")).otherwise(F.col("art"))).alias("abs_path"),
    )


def art_url(art_file_id: Column, file_id: Column, version: Column) -> Column:
    base = F.concat(F.lit("/art/"), F.coalesce(art_file_id, file_id).cast("string"))
    return F.when(version.isNull(), base).otherwise(F.concat(base, F.lit("?v="), version.cast("string")))


def genres_of_files(movie_genres: DataFrame, track_genres: DataFrame, genres: DataFrame) -> DataFrame:
    """Movie and track genres of every file, each once."""
    both = movie_genres.select("file_id", "genre_id").union(track_genres.select("file_id", "genre_id")).distinct()
    return both.join(genres, "genre_id").select("file_id", "genre_id", "name")


def with_sort_title(items: DataFrame) -> DataFrame:
    return items.withColumn("sort_title", sort_title(F.col("title")))


def with_artist(items: DataFrame) -> DataFrame:
    return items.withColumn("display_artist", display_artist(F.col("album_artist"), F.col("artist"))).withColumn(
        "display_album", display_album(F.col("album"))
    )
