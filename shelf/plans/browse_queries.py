"""Listings, counts and projections over the bridge catalog."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.functions import keys, names
from shelf.functions.keys import display_album, display_artist
from shelf.operators import counts, items, listings, merge
from shelf.operators.windows import numbered
from shelf.plans.registry import query
from shelf.session import side_by_side, written_each
from shelf.sources.bridge import view


def movies(spark: SparkSession, sf: str) -> DataFrame:
    """Visible movie items."""
    df = items.ready(view(spark, sf, "b_movies"))
    return items.with_sort_title(df).withColumn("has_art", F.col("art").isNotNull()).withColumn("updated_at", F.col("added_at") + 1)


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    return items.ready(view(spark, sf, "b_episodes")).withColumn("has_art", F.col("art").isNotNull())


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    return items.ready(view(spark, sf, "b_tracks")).withColumn("has_art", F.col("art").isNotNull())


# the merge as SQL: r1 the first-seen row, r2 the best copy; {f} filters, {o} is the first-seen order
MERGE_SQL = """
SELECT k, year, max(title) FILTER (WHERE r1=1) AS title, max(rating) FILTER (WHERE r1=1) AS rating,
  max(file_id) FILTER (WHERE r2=1) AS file_id, max(size) FILTER (WHERE r2=1) AS size, max(width) FILTER (WHERE r2=1) AS width,
  count(*)-1 AS extras, count(art) > 0 AS has_art,
  CASE WHEN max(art) FILTER (WHERE r1=1) IS NULL THEN arg_min(file_id, r1) FILTER (WHERE art IS NOT NULL) END AS art_file_id
FROM (SELECT *, lower(title) AS k,
    row_number() OVER (PARTITION BY lower(title), year ORDER BY {o}) AS r1,
    row_number() OVER (PARTITION BY lower(title), year ORDER BY coalesce(width,0)*coalesce(height,0) DESC, size DESC, {o}) AS r2
  FROM {src}) GROUP BY k, year"""


def merge_sql(where: str = "true", order: str = "file_id", src: str = "b_movies") -> str:
    return MERGE_SQL.format(o=order, src=f"(SELECT * FROM {src} WHERE status='ready' AND {where})")


def shown(df: DataFrame) -> DataFrame:
    return df.select(
        F.lower("title").alias("k"), "year", "title", "rating", "file_id", "size", "width", "extras", "has_art", "art_file_id"
    )


SORT_KEY = r"regexp_replace(regexp_replace(title, '^[^A-Za-z0-9]+', ''), '(?i)^(the|a|an) ', '')"


@query("a1_merge_movies", merge_sql())
def _(spark, sf):
    return shown(listings.all_movies(movies(spark, sf)))


@query("a2_merge_episodes", """
SELECT k_series, season, episode, max(series) FILTER (WHERE r1=1) AS series, max(title) FILTER (WHERE r1=1) AS title,
  max(file_id) FILTER (WHERE r2=1) AS file_id, count(*)-1 AS extras, count(art) > 0 AS has_art
FROM (SELECT *, lower(series) AS k_series,
    row_number() OVER (PARTITION BY lower(series), season, episode ORDER BY file_id) AS r1,
    row_number() OVER (PARTITION BY lower(series), season, episode ORDER BY width*height DESC, size DESC, file_id) AS r2
  FROM b_episodes WHERE status='ready') GROUP BY k_series, season, episode""")
def _(spark, sf):
    return listings.merged_episodes(episodes(spark, sf)).select(
        "k_series", "season", "episode", "series", "title", "file_id", "extras", "has_art"
    )


@query("a1_renditions", """
SELECT lower(title) AS k_title, year AS k_year, file_id, size,
  row_number() OVER (PARTITION BY lower(title), year ORDER BY coalesce(width,0)*coalesce(height,0) DESC, size DESC, file_id) AS quality_rank
FROM b_movies WHERE status='ready'""")
def _(spark, sf):
    return merge.renditions(movies(spark, sf), merge.movie_keys()).select("k_title", "k_year", "file_id", "size", "quality_rank")


RECENT_SQL = f"""
SELECT k, year, title, rating, file_id, size, width, extras, has_art, art_file_id FROM (
{merge_sql(order='added_at DESC, file_id DESC', src="(SELECT * FROM b_movies WHERE status='ready' ORDER BY added_at DESC, file_id DESC LIMIT 50)")}
) m JOIN (SELECT lower(title) AS k2, year AS y2, max(added_at * 1000000000000000000::HUGEINT + file_id) AS newest
  FROM (SELECT * FROM b_movies WHERE status='ready' ORDER BY added_at DESC, file_id DESC LIMIT 50) GROUP BY 1, 2) o
ON m.k=o.k2 AND m.year IS NOT DISTINCT FROM o.y2 ORDER BY newest DESC LIMIT 25"""


@query("l1_recent_movies", RECENT_SQL)
def _(spark, sf):
    return shown(listings.recent_movies(movies(spark, sf), 25))


@query("l2_recent_episodes", "SELECT file_id, series, season, episode, added_at FROM b_episodes WHERE status='ready' ORDER BY added_at DESC, file_id DESC LIMIT 25")
def _(spark, sf):
    return listings.recent(episodes(spark, sf), 25).select("file_id", "series", "season", "episode", "added_at")


@query("l2_recent_tracks", "SELECT file_id, title, artist, added_at FROM b_tracks WHERE status='ready' ORDER BY added_at DESC, file_id DESC LIMIT 25")
def _(spark, sf):
    return listings.recent(tracks(spark, sf), 25).select("file_id", "title", "artist", "added_at")


def titled_sql(where: str = "true", order: str = "file_id") -> str:
    return f"(SELECT *, lower({SORT_KEY}) AS sk FROM ({merge_sql(where, order)}))"


SHOWN_ARTIST, SHOWN_ALBUM = "lower(coalesce(album_artist, artist, 'Unknown Artist'))", "lower(coalesce(album, 'Unknown Album'))"


@query("l3_listing_orders", f"""
SELECT 'artist' AS listing, file_id, row_number() OVER (ORDER BY {SHOWN_ARTIST}, {SHOWN_ALBUM}, disc_no NULLS FIRST, track_no NULLS FIRST, file_id) AS pos FROM b_tracks WHERE status='ready'
UNION ALL SELECT 'series', file_id, row_number() OVER (ORDER BY lower(series), season, episode, file_id) FROM b_episodes WHERE status='ready'
UNION ALL SELECT 'title', file_id, row_number() OVER (ORDER BY sk, file_id) FROM {titled_sql()}
UNION ALL SELECT 'rating', file_id, row_number() OVER (ORDER BY rating DESC, sk, file_id) FROM {titled_sql("rating >= 0 AND rating < 10.1", "rating DESC, file_id")}
UNION ALL SELECT 'year', file_id, row_number() OVER (ORDER BY year NULLS FIRST, sk, file_id) FROM {titled_sql("lower(collection) = (SELECT min(lower(collection)) FROM b_movies WHERE status='ready' AND collection <> '')")}
UNION ALL SELECT 'added', file_id, row_number() OVER (ORDER BY added_at DESC, file_id DESC) FROM b_episodes WHERE status='ready'
UNION ALL SELECT 'album', file_id, row_number() OVER (ORDER BY disc_no NULLS FIRST, track_no NULLS FIRST, lower(title), file_id) FROM b_tracks WHERE status='ready'
 AND ({SHOWN_ARTIST}, {SHOWN_ALBUM}) = (SELECT min(({SHOWN_ARTIST}, {SHOWN_ALBUM})) FROM b_tracks WHERE status='ready')""")
def _(spark, sf):
    found = written_each({
        "movies": movies(spark, sf).select("file_id", "title", "year", "rating", "collection", "size", "width", "height", "has_art"),
        "episodes": episodes(spark, sf).select("file_id", "series", "season", "episode", "added_at"),
        "tracks": tracks(spark, sf).select("file_id", "title", "artist", "album_artist", "album", "disc_no", "track_no"),
    })
    m, e, t = found["movies"], found["episodes"], found["tracks"]
    first_set = m.filter("collection <> ''").agg(F.min(F.lower("collection")).alias("c")).first()["c"]
    album = t.select(display_artist(F.col("album_artist"), F.col("artist")).alias("artist"), display_album(F.col("album")).alias("album"))
    named = album.distinct().agg(F.min_by(F.struct("artist", "album"), F.struct(F.lower("artist"), F.lower("album"))).alias("a")).first()["a"]
    # a work sorts by its title, so copies need no sort titles
    shown, copy, titled = ["title", "year", "rating"], ["file_id"], items.with_sort_title
    lists = {
        "artist": (t, listings.artist_order()), "series": (e, listings.series_order()), "title": (titled(listings.merged_movies(m, None, shown, copy)), listings.title_order()),
        "rating": (titled(listings.rated(m, 0.0, 10.1, shown, copy)), listings.rating_order()),
        "year": (titled(listings.merged_movies(listings.in_franchise(m, first_set), None, shown, copy)), listings.year_order()),
        "added": (e, listings.newest_order()), "album": (listings.on_album(t, named["artist"], named["album"]), listings.album_order()),
    }
    # each listing is sorted once, and its rows are numbered where they then lie
    placed = side_by_side(spark, {name: partial(numbered, df, order, ["file_id"]) for name, (df, order) in lists.items()})
    out = None
    for name, df in placed.items():
        part = df.select(F.lit(name).alias("listing"), "file_id", (F.col("nr") + 1).alias("pos"))
        out = part if out is None else out.unionByName(part)
    return out


@query("f2_movies_of_year", merge_sql("year = 1999"))
def _(spark, sf):
    return shown(listings.of_year(movies(spark, sf), 1999))


@query("f2_movies_of_decade", merge_sql("year >= 1990 AND year < 2000"))
def _(spark, sf):
    return shown(listings.of_decade(movies(spark, sf), 1990))


@query("f3_movies_of_rating", merge_sql("rating >= 8 AND rating < 9", "rating DESC, file_id"))
def _(spark, sf):
    return shown(listings.of_rating(movies(spark, sf), 8.0, 9.0))


@query("f3_movies_unrated", merge_sql("rating IS NULL"))
def _(spark, sf):
    return shown(listings.unrated(movies(spark, sf)))


@query("f4_movies_uhd", merge_sql("(width > 1920 OR height > 1080)"))
def _(spark, sf):
    return shown(listings.by_title(listings.merged_movies(listings.uhd(movies(spark, sf)))))


@query("f4_episodes_uhd", "SELECT file_id, series, season, episode FROM b_episodes WHERE status='ready' AND (width > 1920 OR height > 1080)")
def _(spark, sf):
    return listings.all_episodes(listings.uhd(episodes(spark, sf))).select("file_id", "series", "season", "episode")


@query("f5_movies_of_franchise", merge_sql("lower(collection) = lower('BRAND#13')"))
def _(spark, sf):
    return shown(listings.of_franchise(movies(spark, sf), "BRAND#13"))


@query("a11_franchises", """
SELECT lower(collection) AS k_collection, arg_min(collection, file_id) AS name,
  arg_min(file_id, (coalesce(year, -2147483648), file_id)) FILTER (WHERE art IS NOT NULL) AS art_file_id, count(*) AS files
FROM b_movies WHERE status='ready' AND collection IS NOT NULL AND collection <> '' GROUP BY 1 HAVING count(*) >= 2""")
def _(spark, sf):
    return listings.franchises(movies(spark, sf))


@query("a10_years_decades", """
SELECT DISTINCT 'year' AS what, year AS value FROM b_movies WHERE status='ready' AND year IS NOT NULL
UNION SELECT DISTINCT 'decade', year // 10 * 10 FROM b_movies WHERE status='ready' AND year IS NOT NULL""")
def _(spark, sf):
    m = movies(spark, sf)
    return listings.years(m).select(F.lit("year").alias("what"), F.col("year").alias("value")).union(
        listings.decades(m).select(F.lit("decade"), "decade")
    )


@query("a10_artists", "SELECT DISTINCT coalesce(album_artist, artist, 'Unknown Artist') AS artist FROM b_tracks WHERE status='ready'")
def _(spark, sf):
    return listings.artists(tracks(spark, sf))


@query("a10_albums", """
SELECT coalesce(album_artist, artist, 'Unknown Artist') AS artist, coalesce(album, 'Unknown Album') AS album,
  arg_min(file_id, (coalesce(track_no, -2147483648), file_id)) FILTER (WHERE art IS NOT NULL) AS art_file_id, count(*) AS tracks
FROM b_tracks WHERE status='ready' GROUP BY 1, 2""")
def _(spark, sf):
    return listings.albums(tracks(spark, sf))


@query("a12_series_list", """
SELECT k_series, series, art_file_id, CASE WHEN y BETWEEN 1801 AND 2199 THEN y END AS year FROM (
 SELECT e.*, CAST(coalesce(substr(s.premiered,1,4), aired) AS INT) AS y FROM (
  SELECT lower(series) AS k_series, arg_min(series, file_id) AS series,
   arg_min(file_id, (season, episode, file_id)) FILTER (WHERE art IS NOT NULL) AS art_file_id, min(substr(aired,1,4)) AS aired
  FROM b_episodes WHERE status='ready' GROUP BY 1) e LEFT JOIN b_tv_series s ON lower(s.name)=e.k_series)""")
def _(spark, sf):
    return listings.series_list(episodes(spark, sf), view(spark, sf, "b_tv_series"))


@query("a12_seasons", """
SELECT lower(series) AS k_series, season, arg_min(series, file_id) AS series,
 arg_min(file_id, (episode, file_id)) FILTER (WHERE art IS NOT NULL) AS art_file_id, CAST(min(substr(aired,1,4)) AS INT) AS year
FROM b_episodes WHERE status='ready' GROUP BY 1, 2""")
def _(spark, sf):
    return listings.seasons(episodes(spark, sf))


@query("a13_artist_art", """
SELECT coalesce(album_artist, artist, 'Unknown Artist') AS artist,
 arg_min(file_id, (coalesce(lower(album), ''), coalesce(track_no, -2147483648), file_id)) FILTER (WHERE art IS NOT NULL) AS art_file_id
FROM b_tracks WHERE status='ready' GROUP BY 1""")
def _(spark, sf):
    return listings.artist_art(tracks(spark, sf))


EPISODE_WORKS = """
SELECT lower(series) AS k_series, season, episode, arg_min(rating, file_id) AS rating0,
  max(CASE WHEN r1=1 THEN coalesce(printf('%.1f', rating), '–') END) AS text, max(CASE WHEN r1=1 THEN rating END) AS rating, max(file_id) FILTER (WHERE r2=1) AS file_id
FROM (SELECT *, row_number() OVER (PARTITION BY lower(series), season, episode ORDER BY file_id) AS r1,
    row_number() OVER (PARTITION BY lower(series), season, episode ORDER BY width*height DESC, size DESC, file_id) AS r2
  FROM b_episodes WHERE status='ready') GROUP BY 1, 2, 3"""


@query("a23_rating_grid", f"""
SELECT k_series, season, string_agg(episode || '=' || text, ' ' ORDER BY episode) AS grid FROM ({EPISODE_WORKS}) WHERE episode > 0 GROUP BY 1, 2""")
def _(spark, sf):
    grid = listings.rating_grid(listings.merged_episodes(episodes(spark, sf)))
    cells = F.transform(F.map_entries("ratings"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return grid.select("k_series", "season", F.array_join(cells, " ").alias("grid"))


@query("j21_series_facts", f"""
SELECT w.k_series, w.season, w.episode, w.file_id, s.plot AS series_plot, s.rating AS series_rating, s.imdb_id AS series_imdb_id, n.plot AS season_plot
FROM ({EPISODE_WORKS}) w LEFT JOIN b_tv_series s ON lower(s.name)=w.k_series LEFT JOIN b_tv_seasons n ON lower(n.series)=w.k_series AND n.season=w.season""")
def _(spark, sf):
    works = listings.merged_episodes(episodes(spark, sf))
    facts = listings.with_series_facts(works, view(spark, sf, "b_tv_series"), view(spark, sf, "b_tv_seasons"))
    return facts.select("k_series", "season", "episode", "file_id", "series_plot", "series_rating", "series_imdb_id", "season_plot")


@query("w1_episode_neighbours", f"""
SELECT e.file_id, w.prev_file_id, w.next_file_id FROM b_episodes e JOIN (
 SELECT k_series, season, episode, lag(file_id) OVER (PARTITION BY k_series ORDER BY season, episode) AS prev_file_id,
  lead(file_id) OVER (PARTITION BY k_series ORDER BY season, episode) AS next_file_id FROM ({EPISODE_WORKS})) w
ON lower(e.series)=w.k_series AND e.season=w.season AND e.episode=w.episode WHERE e.status='ready'""")
def _(spark, sf):
    return listings.episode_neighbours(episodes(spark, sf))


@query("w1_track_neighbours", """
SELECT file_id, lag(file_id) OVER w AS prev_file_id, lead(file_id) OVER w AS next_file_id FROM b_tracks WHERE status='ready'
WINDOW w AS (PARTITION BY coalesce(album_artist, artist, 'Unknown Artist'), coalesce(album, 'Unknown Album') ORDER BY disc_no, track_no, lower(title), file_id)""")
def _(spark, sf):
    return listings.track_neighbours(tracks(spark, sf), spread=True)


WORKS = "count(DISTINCT lower(title) || chr(31) || coalesce(CAST(year AS VARCHAR), ''))"


@query("a3_movie_totals", f"""
SELECT {WORKS} AS total, {WORKS} FILTER (WHERE width > 1920 OR height > 1080) AS uhd, {WORKS} FILTER (WHERE year IS NOT NULL) AS dated,
 {WORKS} FILTER (WHERE genre IS NOT NULL) AS with_genre, {WORKS} FILTER (WHERE director IS NOT NULL) AS with_director,
 {WORKS} FILTER (WHERE lower(collection) IN (SELECT lower(collection) FROM b_movies WHERE status='ready' AND collection <> '' GROUP BY 1 HAVING count(*) >= 2)) AS in_franchises,
 {WORKS} FILTER (WHERE rating IS NULL) AS unrated,
 {WORKS} FILTER (WHERE rating >= 9 AND rating < 10.1) AS rated_0, {WORKS} FILTER (WHERE rating >= 8 AND rating < 9) AS rated_1,
 {WORKS} FILTER (WHERE rating >= 7 AND rating < 8) AS rated_2, {WORKS} FILTER (WHERE rating >= 6 AND rating < 7) AS rated_3,
 {WORKS} FILTER (WHERE rating >= 0 AND rating < 6) AS rated_4 FROM b_movies WHERE status='ready'""")
def _(spark, sf):
    return counts.movie_totals(movies(spark, sf))


@query("a4_movie_counts", f"""
WITH m AS (SELECT * FROM b_movies WHERE status='ready')
SELECT 'year' AS dim, CAST(year AS VARCHAR) AS value, {WORKS} AS n FROM m WHERE year IS NOT NULL GROUP BY year
UNION ALL SELECT 'decade', CAST(year // 10 * 10 AS VARCHAR), {WORKS} FROM m WHERE year IS NOT NULL GROUP BY year // 10
UNION ALL SELECT 'genre', genre, {WORKS} FROM m GROUP BY genre
UNION ALL SELECT 'director', director, {WORKS} FROM m GROUP BY director
UNION ALL SELECT 'rating', CASE WHEN rating IS NULL THEN '5' WHEN rating >= 9 THEN '0' WHEN rating >= 8 THEN '1' WHEN rating >= 7 THEN '2' WHEN rating >= 6 THEN '3' ELSE '4' END AS b, {WORKS} FROM m GROUP BY b
UNION ALL SELECT 'franchise', lower(collection), {WORKS} FROM m WHERE collection <> '' GROUP BY lower(collection) HAVING count(*) >= 2""")
def _(spark, sf):
    return counts.movie_counts(movies(spark, sf))


@query("a5_track_counts", """
SELECT coalesce(album_artist, artist, 'Unknown Artist') AS artist, coalesce(album, 'Unknown Album') AS album,
 count(*) AS n, count(genre) AS with_genre, grouping_id(coalesce(album_artist, artist, 'Unknown Artist'), coalesce(album, 'Unknown Album')) AS level FROM b_tracks WHERE status='ready'
GROUP BY ROLLUP (coalesce(album_artist, artist, 'Unknown Artist'), coalesce(album, 'Unknown Album'))""")
def _(spark, sf):
    return counts.track_counts(tracks(spark, sf))


@query("a5_track_genre_counts", "SELECT genre, count(*) AS n FROM b_tracks WHERE status='ready' AND genre IS NOT NULL GROUP BY genre")
def _(spark, sf):
    return counts.track_genre_counts(tracks(spark, sf))


@query("a6_episode_counts", """
SELECT k_series, k_season, count(*) AS n, count(*) FILTER (WHERE uhd) AS uhd, grouping_id(k_series, k_season) AS level FROM (
 SELECT lower(series) AS k_series, season AS k_season, episode, bool_or(width > 1920 OR height > 1080) AS uhd
 FROM b_episodes WHERE status='ready' GROUP BY 1, 2, 3) GROUP BY ROLLUP (k_series, k_season)""")
def _(spark, sf):
    return counts.episode_counts(episodes(spark, sf))


@query("a7_file_counts", """
SELECT kind, root_id, count(*) AS n, grouping_id(kind, root_id) AS level FROM b_files WHERE status='ready' GROUP BY GROUPING SETS ((kind, root_id), (kind))""")
def _(spark, sf):
    return counts.file_counts(items.ready(view(spark, sf, "b_files")))


@query("a8_folder_counts", """
SELECT root_id, array_to_string(parts[1:i], '/') AS rel_dir, count(*) AS n FROM (
 SELECT root_id, parts, unnest(range(1, len(parts))) AS i FROM (SELECT root_id, string_split(rel_path, '/') AS parts FROM b_files WHERE status='ready'))
GROUP BY 1, 2""")
def _(spark, sf):
    return counts.folder_counts(items.ready(view(spark, sf, "b_files")))
