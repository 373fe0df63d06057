"""Item projections, joins and exports over the bridge catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelf.functions import formats, keys
from shelf.operators import export, items, listings, reconcile
from shelf.plans.browse_queries import episodes, merge_sql, movies, shown, tracks
from shelf.plans.registry import query
from shelf.session import written
from shelf.plans.tree import dimension_id
from shelf.plans.tree_queries import TITLES_SQL, any_items
from shelf.sources.bridge import view


def normal_movies(spark, sf):
    """The movie view taken apart into catalog tables; a film's brand is a second genre."""
    m = view(spark, sf, "b_movies")
    files = m.select("file_id", "root_id", "rel_path", "mime", "size", "duration_ms", "width", "height", "art", "added_at", "status")
    facts = m.select("file_id", "title", "year", "rating", "collection", "plot")
    named = m.select("file_id", F.explode(F.array(F.col("genre"), F.split("rel_path", "/")[1])).alias("name"))
    genres = named.select("name").distinct().select(dimension_id(F.col("name")).alias("genre_id"), "name")
    movie_genres = named.select("file_id", dimension_id(F.col("name")).alias("genre_id")).distinct()
    directors = m.select("director").distinct().select(dimension_id(F.col("director")).alias("director_id"), F.col("director").alias("name"))
    movie_directors = m.select("file_id", dimension_id(F.col("director")).alias("director_id"))
    return files, facts, movie_genres, genres, movie_directors, directors


@query("p1_movie_items", """
SELECT file_id, title, year, least(genre, split_part(rel_path, '/', 2)) || ', ' || greatest(genre, split_part(rel_path, '/', 2)) AS genre, director, art IS NOT NULL AS has_art, rating FROM b_movies WHERE status='ready'""")
def _(spark, sf):
    return items.movie_items(*normal_movies(spark, sf)).select("file_id", "title", "year", "genre", "director", "has_art", "rating")


def normal_episodes(spark, sf):
    e = view(spark, sf, "b_episodes")
    files = e.select("file_id", "root_id", "rel_path", "mime", "size", "duration_ms", "width", "height", "art", "added_at", "status")
    return files, e.select("file_id", "series", "season", "episode", "title", "rating", "aired", "plot")


@query("p2_episode_items", "SELECT file_id, series, season, episode, title, rating, art IS NOT NULL AS has_art FROM b_episodes WHERE status='ready'")
def _(spark, sf):
    return items.episode_items(*normal_episodes(spark, sf)).select("file_id", "series", "season", "episode", "title", "rating", "has_art")


def normal_tracks(spark, sf):
    t = view(spark, sf, "b_tracks").withColumn("file_id", -F.col("file_id"))
    files = t.select("file_id", "root_id", "rel_path", "mime", "size", "duration_ms", "art", "added_at", "status")
    facts = t.select("file_id", "title", "artist", "album_artist", "album", "track_no", "disc_no", "year")
    track_genres = t.filter("genre is not null").select("file_id", dimension_id(F.col("genre")).alias("genre_id"))
    genres = t.filter("genre is not null").select("genre").distinct().select(dimension_id(F.col("genre")).alias("genre_id"), F.col("genre").alias("name"))
    return files, facts, track_genres, genres


@query("p3_track_items", "SELECT -file_id AS file_id, title, artist, album, track_no, year, genre, art IS NOT NULL AS has_art FROM b_tracks WHERE status='ready'")
def _(spark, sf):
    return items.track_items(*normal_tracks(spark, sf)).select("file_id", "title", "artist", "album", "track_no", "year", "genre", "has_art")


ANY = """
SELECT f.file_id, f.kind, coalesce(m.title, t.title, e.title, regexp_replace(regexp_extract(f.rel_path, '([^/]*)$', 1), '\\.[^.]*$', '')) AS title, coalesce(m.year, t.year) AS year, coalesce(m.rating, e.rating) AS rating
FROM b_files f LEFT JOIN (SELECT * FROM b_movies WHERE file_id % 5 > 0) m ON m.file_id=f.file_id LEFT JOIN b_tracks t ON -t.file_id=f.file_id LEFT JOIN (SELECT * FROM b_episodes WHERE file_id % 5 > 0) e ON e.file_id=f.file_id WHERE f.status='ready'"""


@query("p4_any_items", ANY)
def _(spark, sf):
    # a fifth of the films and episodes have no facts and go by their file name
    some = lambda df: df.filter("file_id % 5 > 0")
    t = view(spark, sf, "b_tracks").withColumn("file_id", -F.col("file_id"))
    got = items.any_items(view(spark, sf, "b_files"), some(view(spark, sf, "b_movies")), some(view(spark, sf, "b_episodes")), t)
    return got.select("file_id", "kind", "title", "year", "rating")


@query("p5_details", """
SELECT f.file_id, coalesce(m.title, t.title, e.title) AS title, coalesce(m.year, t.year) AS year, coalesce(m.rating, e.rating) AS rating, coalesce(m.plot, e.plot) AS plot, m.collection,
 coalesce(m.genre, t.genre) AS genre, m.director, e.series, e.season, e.episode, e.aired, t.artist, t.album, t.album_artist, strftime(make_timestamp(f.added_at::BIGINT*1000000), '%Y-%m-%d %H:%M:%S') AS added_at_text
FROM b_files f LEFT JOIN b_movies m ON m.file_id=f.file_id LEFT JOIN b_tracks t ON -t.file_id=f.file_id LEFT JOIN b_episodes e ON e.file_id=f.file_id WHERE f.status='ready'""")
def _(spark, sf):
    m, e = view(spark, sf, "b_movies"), view(spark, sf, "b_episodes")
    t = view(spark, sf, "b_tracks").withColumn("file_id", -F.col("file_id"))
    none = lambda df, *cols: df.select("*", *[F.lit(None).cast("string").alias(c) for c in cols])
    got = items.details(
        view(spark, sf, "b_files"), none(m.select("file_id", "title", "year", "rating", "plot", "collection"), "imdb_id"),
        none(e.select("file_id", "series", "season", "episode", "title", "rating", "plot", "aired"), "imdb_id"),
        t.select("file_id", "title", "artist", "album_artist", "album", "track_no", "year"), m.select("file_id", "genre"), t.select("file_id", "genre"), m.select("file_id", "director"),
    )
    return got.select("file_id", "title", "year", "rating", "plot", "collection", "genre", "director", "series", "season", "episode", "aired", "artist", "album", "album_artist", "added_at_text")


@query("p6_display_names", "SELECT file_id, coalesce(album_artist, artist, 'Unknown Artist') AS display_artist, coalesce(album, 'Unknown Album') AS display_album FROM b_tracks")
def _(spark, sf):
    return items.with_artist(view(spark, sf, "b_tracks")).select("file_id", "display_artist", "display_album")


@query("p8_uhd_flags", "SELECT file_id, coalesce(width, 0) > 1920 OR coalesce(height, 0) > 1080 AS uhd FROM b_movies")
def _(spark, sf):
    return view(spark, sf, "b_movies").select("file_id", keys.is_uhd(F.col("width"), F.col("height")).alias("uhd"))


@query("p14_servable", "SELECT file_id, r.path || '/' || rel_path AS abs_path, mime FROM b_files f JOIN b_roots r USING (root_id) WHERE status='ready'")
def _(spark, sf):
    return items.servable(view(spark, sf, "b_files"), view(spark, sf, "b_roots"))


@query("p15_art_sources", """
SELECT file_id, CASE WHEN art='embedded' THEN 'embedded' ELSE 'file' END AS source, r.path || '/' || CASE WHEN art='embedded' THEN rel_path ELSE art END AS abs_path FROM b_files f JOIN b_roots r USING (root_id) WHERE status='ready' AND art IS NOT NULL""")
def _(spark, sf):
    return items.art_sources(view(spark, sf, "b_files"), view(spark, sf, "b_roots"))


@query("p15_art_urls", f"""
SELECT k, year, '/art/' || coalesce(art_file_id, file_id) AS url FROM ({merge_sql()})""")
def _(spark, sf):
    w = shown(listings.merged_movies(movies(spark, sf)))
    return w.select("k", "year", items.art_url(F.col("art_file_id"), F.col("file_id"), F.lit(None).cast("long")).alias("url"))


@query("p16_fact_formats", """
SELECT file_id, (duration_ms//3600000) || ':' || lpad((duration_ms//60000%60)::VARCHAR, 2, '0') || ':' || lpad((duration_ms//1000%60)::VARCHAR, 2, '0') AS duration,
 CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.2f KB', size/1024.0) ELSE printf('%.2f MB', size/1048576.0) END AS size, CASE WHEN season IS NULL THEN NULL ELSE CAST(day(CAST(aired AS DATE)) AS VARCHAR) || ' ' || monthname(CAST(aired AS DATE)) || ' ' || year(CAST(aired AS DATE)) END AS aired,
 CASE WHEN file_id % 3 = 0 THEN '25' WHEN file_id % 3 = 1 THEN '23.976' ELSE '12.5' END AS fps FROM b_episodes""")
def _(spark, sf):
    e = view(spark, sf, "b_episodes")
    fps = F.when(F.col("file_id") % 3 == 0, 25.0).when(F.col("file_id") % 3 == 1, 24000 / 1001).otherwise(12.5)
    return e.select(
        "file_id", formats.human_duration(F.col("duration_ms")).alias("duration"), formats.human_size(F.col("size")).alias("size"),
        formats.long_date(F.col("aired")).alias("aired"), formats.fps_label(fps).alias("fps"),
    )


@query("p11_share_titles", """
SELECT doc_id, CASE WHEN trim(text) = '' THEN NULL WHEN length(trim(text)) <= 300 THEN trim(text) ELSE CASE WHEN contains(substr(trim(text), 1, 300), ' ') THEN regexp_replace(substr(trim(text), 1, 300), ' [^ ]*$', '', 's') ELSE substr(trim(text), 1, 300) END || '…' END AS story,
 source || ' S0' || (doc_id % 9) || 'E' || CASE WHEN doc_id % 20 < 10 THEN '0' ELSE '' END || (doc_id % 20) || ' — T' AS share, 'T (S0' || (doc_id % 9) || ' - ' || source || ')' AS tab
FROM documents""")
def _(spark, sf):
    from shelf.sources.bridge import table

    d = table(spark, sf, "documents")
    c, lit = F.col, F.lit
    null = lit(None).cast("string")
    return d.select(
        "doc_id", formats.share_text(lit("tv"), c("text"), null).alias("story"),
        formats.share_title(lit("tv"), lit("T"), lit(None).cast("int"), c("source"), c("doc_id") % 9, c("doc_id") % 20, null).alias("share"),
        formats.tab_title(lit("T"), lit(None).cast("int"), c("source"), c("doc_id") % 9).alias("tab"),
    )


@query("t11_rating_classes", "SELECT file_id, CASE WHEN rating >= 7.5 THEN 'green' WHEN rating >= 5.5 THEN 'yellow' WHEN rating IS NOT NULL THEN 'red' END AS colour FROM b_episodes")
def _(spark, sf):
    return view(spark, sf, "b_episodes").select("file_id", formats.rating_class(F.col("rating")).alias("colour"))


@query("j4_names_in_use", """
SELECT DISTINCT 'genre' AS what, name FROM (SELECT genre AS name FROM b_movies WHERE status='ready' UNION ALL SELECT split_part(rel_path, '/', 2) FROM b_movies WHERE status='ready')
UNION ALL SELECT DISTINCT 'director', director FROM b_movies WHERE status='ready'""")
def _(spark, sf):
    files, facts, movie_genres, genres, movie_directors, directors = normal_movies(spark, sf)
    seen = items.ready(files)
    g = listings.names_in_use(seen, movie_genres, genres, "genre_id").select(F.lit("genre").alias("what"), "name")
    return g.union(listings.names_in_use(seen, movie_directors, directors, "director_id").select(F.lit("director"), "name"))


@query("j5_movies_of_genre", merge_sql("(genre = 'PROMO' OR split_part(rel_path, '/', 2) = 'PROMO')"))
def _(spark, sf):
    _, _, movie_genres, genres, _, _ = normal_movies(spark, sf)
    chosen = movie_genres.join(genres.filter("name = 'PROMO'"), "genre_id", "left_semi")
    return shown(listings.of_names(movies(spark, sf), chosen))


@query("j5_movies_of_director", merge_sql("director = 'Supplier#000000007'"))
def _(spark, sf):
    _, _, _, _, movie_directors, directors = normal_movies(spark, sf)
    chosen = movie_directors.join(directors.filter("name = 'Supplier#000000007'"), "director_id", "left_semi")
    return shown(listings.of_names(movies(spark, sf), chosen, by_year=True))


@query("j6_franchise_members", """
SELECT file_id FROM b_movies WHERE status='ready' AND lower(collection) IN (SELECT lower(collection) FROM b_movies WHERE status='ready' AND collection <> '' GROUP BY 1 HAVING count(*) >= 2)""")
def _(spark, sf):
    from shelf.operators.counts import big_franchises

    m = movies(spark, sf)
    return m.join(big_franchises(m).select("k_collection"), F.lower("collection") == F.col("k_collection"), "left_semi").select("file_id")


@query("j8_album_art", """
SELECT coalesce(album_artist, artist, 'Unknown Artist') AS artist, coalesce(album, 'Unknown Album') AS album, arg_min(file_id, (track_no, file_id)) FILTER (WHERE art IS NOT NULL) AS art_file_id FROM b_tracks WHERE status='ready' GROUP BY 1, 2""")
def _(spark, sf):
    return listings.albums(tracks(spark, sf)).select("artist", "album", "art_file_id")


@query("u1_genres_of_files", """
SELECT DISTINCT file_id, name FROM (SELECT file_id, genre AS name FROM b_movies UNION ALL SELECT file_id, split_part(rel_path, '/', 2) FROM b_movies UNION ALL SELECT -file_id, genre FROM b_tracks WHERE genre IS NOT NULL)""")
def _(spark, sf):
    _, _, movie_genres, genres, _, _ = normal_movies(spark, sf)
    _, _, track_genres, more = normal_tracks(spark, sf)
    both = genres.select("genre_id", "name").union(more.select("genre_id", "name")).groupBy("genre_id").agg(F.min("name").alias("name"))
    return items.genres_of_files(movie_genres, track_genres, both).select("file_id", "name")


@query("l3_album_tracks", """
SELECT file_id, title FROM b_tracks WHERE status='ready' AND coalesce(album_artist, artist, 'Unknown Artist') = 'Supplier#000000007' AND coalesce(album, 'Unknown Album') = 'Brand#7'""")
def _(spark, sf):
    return listings.tracks_of_album(tracks(spark, sf), "Supplier#000000007", "Brand#7").select("file_id", "title")


def caption_disk(files):
    """Sidecars beside some of the files, a few too large."""
    f = files.select("root_id", "rel_path").distinct()
    n, path = F.length("rel_path"), F.col("rel_path")
    big = F.when(n % 7 == 0, 9 * 1024 * 1024).otherwise(100).cast("long")
    sides = F.array_compact(F.array(*[F.when(n % step == 0, reconcile.sibling(path, ext)) for ext, step in (("srt", 2), ("rttm", 3))]))
    return f.select("root_id", F.explode(sides).alias("rel_path"), big.alias("size"))


@query("s18_caption_inventory", """
SELECT f.file_id AS id, kind, r.path AS root, rel_path AS path, duration_ms, length(rel_path) % 2 = 0 AND length(rel_path) % 7 <> 0 AS srt, length(rel_path) % 3 = 0 AND length(rel_path) % 7 <> 0 AS rttm, '/audio/' || f.file_id || '.flac' AS audio
FROM (SELECT b_files.*, 1 AS one FROM b_files) f JOIN (SELECT root_id, path FROM b_roots) r USING (root_id) WHERE status='ready' AND kind <> 'music'""")
def _(spark, sf):
    files = written(view(spark, sf, "b_files").select("file_id", "root_id", "kind", "rel_path", "duration_ms", "status"), "media-files")
    return export.caption_inventory(files, view(spark, sf, "b_roots"), caption_disk(files))


@query("s19_playlist", f"""
SELECT p.file_id, '#EXTINF:' || coalesce(CAST(f.duration_ms//1000 AS VARCHAR), '-1') || ',' || translate(p.title, chr(10) || chr(13), '  ') || chr(10) || 'http://h/media/' || p.file_id AS entry
FROM ({TITLES_SQL}) p JOIN (SELECT DISTINCT file_id, duration_ms FROM b_files WHERE status='ready') f ON f.file_id = p.file_id""")
def _(spark, sf):
    return export.playlist_lines(any_items(spark, sf), "http://h").select("file_id", "entry")
