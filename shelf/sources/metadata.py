"""External metadata dumps: ratings lists and provider JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.functions.text import iso_date

RATINGS = "tconst string, averageRating double, numVotes long"
MOVIE = (
    "id bigint, title string, release_date string, overview string, poster_path string, imdb_id string, "
    "genres array<struct<name: string>>, credits struct<crew: array<struct<job: string, name: string>>>, "
    "external_ids struct<imdb_id: string>, belongs_to_collection struct<name: string>"
)
SERIES = "id bigint, name string, overview string, poster_path string, first_air_date string, external_ids struct<imdb_id: string>"
SEASON = "overview string, episodes array<struct<episode_number: bigint, name: string, overview: string, air_date: string>>"


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Title ratings as published: tab separated, gzip or plain."""
    return spark.read.csv(path, sep="\t", header=True, schema=RATINGS, nullValue="\\N")


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def movie_details(dump: DataFrame) -> DataFrame:
    """Provider movie records (one JSON per row in ``json``) as typed columns."""
    d = dump.select(F.from_json("json", MOVIE).alias("d")).filter("d.id is not null")
    names = lambda a: F.coalesce(F.filter(F.transform(a, lambda x: x["name"]), lambda n: n.isNotNull()), F.array().cast("array<string>"))
    crew = F.filter("d.credits.crew", lambda p: p["job"] == "Director")
    return d.select(
        F.col("d.id").alias("tmdb_id"), F.col("d.title").alias("title"), F.substring("d.release_date", 1, 4).try_cast("int").alias("year"),
        filled(F.col("d.overview")).alias("plot"), names(F.col("d.genres")).alias("genres"), names(crew).alias("directors"),
        filled(F.coalesce("d.imdb_id", "d.external_ids.imdb_id")).alias("imdb_id"), F.col("d.belongs_to_collection.name").alias("collection"),
        F.col("d.poster_path").alias("poster_path"),
    )


def series_details(dump: DataFrame) -> DataFrame:
    d = dump.select(F.from_json("json", SERIES).alias("d")).filter("d.id is not null")
    return d.select(
        F.col("d.id").alias("tmdb_id"), F.col("d.name").alias("name"), filled(F.col("d.overview")).alias("plot"),
        filled(F.col("d.external_ids.imdb_id")).alias("imdb_id"), iso_date(F.col("d.first_air_date")).alias("premiered"),
    )


def season_details(dump: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Season records (series_id, season, json) as season overviews and as episode rows."""
    d = dump.select("series_id", "season", F.from_json("json", SEASON).alias("d"))
    overviews = d.select("series_id", "season", filled(F.col("d.overview")).alias("overview"))
    rows = d.select("series_id", "season", F.posexplode("d.episodes").alias("pos", "e")).filter("e.episode_number is not null and e.name is not null")
    last = rows.groupBy("series_id", "season", F.col("e.episode_number").alias("episode")).agg(F.max_by("e", "pos").alias("e"))
    episodes = last.select(
        "series_id", "season", "episode", F.col("e.name").alias("title"), F.coalesce("e.overview", F.lit("")).alias("plot"),
        iso_date(F.col("e.air_date")).alias("aired"),
    )
    return overviews, episodes
