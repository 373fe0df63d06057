"""Names, sidecars, inventory and reconcile over the bridge files."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelf.functions import names
from shelf.functions import text as T
from shelf.functions.names import folders, path_stem, stem
from shelf.operators import items, reconcile, segments
from shelf.plans.registry import query
from shelf.session import written
from shelf.sources import inventory, probes, sidecars
from shelf.sources.bridge import table, view


@query("s1_folder_scan")
def _(spark, sf):
    roots = spark.createDataFrame([(1, sf, "movies")], "root_id int, path string, kind string")
    return inventory.scan(spark, roots, [sf])


@query("s2_media_types", """
SELECT file_id, CASE WHEN ext='mkv' AND kind<>'music' THEN 'video/x-matroska' WHEN ext='flac' AND kind='music' THEN 'audio/flac' END AS mime
FROM (SELECT *, lower(regexp_extract(rel_path, '\\.([^.]+)$', 1)) AS ext FROM b_files)""")
def _(spark, sf):
    return inventory.media_files(view(spark, sf, "b_files").drop("mime")).select("file_id", "mime")


@query("j25_locate_roots", "SELECT f.file_id, f.root_id, f.rel_path FROM b_files f JOIN b_roots r ON r.root_id=f.root_id")
def _(spark, sf):
    roots = view(spark, sf, "b_roots")
    files = view(spark, sf, "b_files").join(roots.select("root_id", "path"), "root_id")
    full = files.select("file_id", F.concat_ws("/", "path", "rel_path").alias("path"))
    return inventory.locate(full, roots).select("file_id", "root_id", "rel_path")


@query("f15_size_cap", "SELECT doc_id, n_chars <= 2000 AS readable FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", inventory.within(F.col("n_chars"), 2000).alias("readable"))


@query("t1_movie_names", "SELECT l.file_id, p_name AS title, 1970+p_size AS year FROM b_movies l JOIN part ON p_partkey = (l.file_id // 10000) % 100000")
def _(spark, sf):
    m = view(spark, sf, "b_movies").select("file_id", names.movie(stem(F.col("rel_path"))).alias("m"))
    return m.select("file_id", "m.title", "m.year")


@query("t2_episode_names", """
SELECT o_orderkey AS file_id, 'Show ' || (o_custkey % 200) AS series, abs(year(o_orderdate)-1994) AS season, 10+month(o_orderdate) AS episode, o_orderpriority AS title FROM orders""")
def _(spark, sf):
    path = F.col("rel_path")
    e = view(spark, sf, "b_episodes").select("file_id", names.episode(stem(path), folders(path)).alias("e"))
    return e.select("file_id", "e.series", "e.season", "e.episode", "e.title")


@query("t3_track_names", """
SELECT file_id, artist, regexp_extract(rel_path, '^[^/]*/([^/]*)/', 1) AS album, 10+track_no AS track_no, title || ' ' || regexp_extract(rel_path, '\\.([0-9]+)\\.flac$', 1) AS title FROM b_tracks""")
def _(spark, sf):
    path = F.col("rel_path")
    t = view(spark, sf, "b_tracks").select("file_id", names.track(stem(path), folders(path)).alias("t"))
    return t.select("file_id", "t.artist", "t.album", "t.track_no", "t.title")


@query("t4_sort_titles", """
SELECT p_partkey, regexp_replace(CASE p_partkey % 4 WHEN 0 THEN 'The ' WHEN 1 THEN '"A ' WHEN 2 THEN '...an ' ELSE '' END || p_name, '^([^A-Za-z0-9]*)(The |A |an )', '') AS sort_title FROM part""")
def _(spark, sf):
    lead = F.get(F.array(*[F.lit(x) for x in ("The ", '"A ', "...an ", "")]), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf, "part").select("p_partkey", names.sort_title(F.concat(lead, "p_name")).alias("sort_title"))


@query("t5_split_genres", "SELECT p_partkey, p_type || '|' || p_brand || '|' || p_name AS genres FROM part")
def _(spark, sf):
    raw = F.concat(F.lit(" "), "p_type", F.lit(" ; /"), "p_brand", F.lit(",, "), "p_name", F.lit("/"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(names.split_genres(raw), "|").alias("genres"))


@query("t8_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0,1) THEN CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE CAST(year(o_orderdate) AS VARCHAR) END END AS iso,
 CASE WHEN o_orderkey % 5 IN (0,1) THEN year(o_orderdate) END AS y FROM orders""")
def _(spark, sf):
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 5
    raw = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy")).when(k == 2, F.date_format(d, "dd/MM/yyyy"))
        .when(k == 3, F.concat(F.date_format(d, "yyyy"), F.lit("-13-01"))).otherwise(F.lit("1799-01-01"))
    )
    from shelf.functions.keys import year_of

    iso = T.iso_date(raw)
    return table(spark, sf, "orders").select("o_orderkey", iso.alias("iso"), year_of(iso).alias("y"))


def nfo_texts(spark, sf):
    """A description per part, some malformed, some out of range."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    text = F.concat(
        F.lit("<?xml version=\"1.0\"?>\n<movie><title> "), "p_name", F.lit(" &amp; co</title><title>second</title><year>"),
        F.when(k % 9 == 0, "1700").otherwise((F.col("p_size") + 1970).cast("string")), F.lit("</year><rating>"),
        F.when(k % 5 == 0, "NaN").when(k % 5 == 1, "11").otherwise((k % 10).cast("string")), F.lit("</rating><genre>"), "p_type",
        F.lit("</genre><genre>"), "p_brand", F.lit("</genre><director>D</director><plot><![CDATA[a <b> "), "p_name", F.lit("]]></plot><uniqueid type=\"tmdb\">5</uniqueid><uniqueid type=\"imdb\">"),
        F.when(k % 4 == 0, "tt12").otherwise(F.concat(F.lit("tt"), (k + 1000000).cast("string"))), F.lit("</uniqueid><season>-1</season><aired>2001-"),
        F.when(k % 3 == 0, "13").otherwise("10"), F.lit("-14</aired>"), F.when(k % 7 == 0, "<oops></movie>").otherwise("</movie>"),
    )
    return p.select(k.alias("file_id"), text.alias("text"))


@query("s3_nfo", """
SELECT p_partkey AS file_id, CASE WHEN ok THEN p_name || ' & co' END AS title, CASE WHEN ok AND p_partkey % 9 <> 0 THEN p_size+1970 END AS year,
 CASE WHEN ok AND p_partkey % 5 > 1 THEN CAST(p_partkey % 10 AS DOUBLE) END AS rating, CASE WHEN ok THEN p_type || '|' || p_brand ELSE '' END AS genres, CASE WHEN ok THEN 'D' ELSE '' END AS directors,
 CASE WHEN ok THEN 'a <b> ' || p_name END AS plot, CASE WHEN ok AND p_partkey % 4 <> 0 THEN 'tt' || (p_partkey+1000000) END AS imdb_id, CASE WHEN ok AND p_partkey % 3 <> 0 THEN '2001-10-14' END AS aired
FROM (SELECT *, p_partkey % 7 <> 0 AS ok FROM part)""")
def _(spark, sf):
    n = sidecars.read_nfo(nfo_texts(spark, sf))
    return n.select("file_id", "title", "year", "rating", F.array_join("genres", "|").alias("genres"), F.array_join("directors", "|").alias("directors"), "plot", "imdb_id", "aired")


@query("s4_folder_facts", """
SELECT 'series' AS what, lower(c_name) AS name, 0 AS season, 'P' || max(c_custkey) AS plot FROM customer WHERE c_custkey % 2 = 0 GROUP BY 2
UNION ALL SELECT 'season', lower(c_name), CAST(c_custkey % 9 AS INT), 'S' || max(c_custkey) FROM customer WHERE c_custkey % 2 = 1 GROUP BY 2, 3""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    show = k % 2 == 0
    texts = c.select(
        F.lit(1).alias("root_id"),
        F.when(show, F.concat("c_name", F.lit("/tvshow.nfo"))).otherwise(F.concat(F.col("c_name"), F.lit("/Season "), (k % 9).cast("string"), F.lit("/season.nfo"))).alias("rel_path"),
        F.when(show, F.concat(F.lit("<tvshow><plot>P"), k.cast("string"), F.lit("</plot><year>1999</year></tvshow>")))
        .otherwise(F.concat(F.lit("<season><plot>S"), k.cast("string"), F.lit("</plot></season>"))).alias("text"),
    )
    series, seasons = sidecars.folder_facts(texts)
    return series.select(F.lit("series").alias("what"), F.lower("name").alias("name"), F.lit(0).alias("season"), "plot").union(
        seasons.select(F.lit("season"), F.lower("series"), "season", "plot")
    )


def edl_lines(spark, sf):
    """Edit-list lines out of lineitem: one file per order key."""
    l = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("int")
    line = F.when(F.col("l_linenumber") == 7, F.lit("# note")).otherwise(
        F.concat_ws(" ", (q * 60).cast("string"), (q * 60 + F.col("l_linenumber") * 30 - 30).cast("string"), (F.col("l_partkey") % 4).cast("string"))
    )
    return l.select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("file_id"), F.lit(2600000).alias("duration_ms"),
        F.lit(0).alias("pos"), line.alias("line"), "l_suppkey",
    ).withColumn("file_id", F.col("file_id") * 10000 + F.col("l_suppkey"))


@query("s5_edl", """
SELECT file_id, s AS start_ms, e AS end_ms, CASE WHEN e >= 2590000 THEN 'credits' WHEN s <= 300000 THEN 'intro' ELSE 'commercial' END AS kind FROM (
 SELECT ((l_orderkey*10+l_linenumber)*100000+l_partkey)*10000+l_suppkey AS file_id, CAST(l_quantity AS BIGINT)*60000 AS s, CAST(l_quantity AS BIGINT)*60000 + (l_linenumber-1)*30000 AS e
 FROM lineitem WHERE l_linenumber <> 7 AND l_partkey % 4 IN (0, 3)) WHERE e > s""")
def _(spark, sf):
    return sidecars.edl_segments(edl_lines(spark, sf)).select("file_id", "start_ms", "end_ms", "kind")


def probe_json(spark, sf):
    """A probe report per order with two chapters."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    pick = lambda i, *v: F.get(F.array(*[F.lit(x) for x in v]), i.cast("int"))
    text = F.concat(
        F.lit('{"format":{"duration":"'), (k % 5000).cast("string"), F.lit('.25","format_name":"matroska,webm","tags":{"'), pick(k % 3, "genre", "GENRE", "other"),
        F.lit('":"'), "o_orderpriority", F.lit('"}},"streams":[{"codec_type":"data"},{"codec_type":"video","codec_name":"'), pick(k % 2, "h264", "hevc"),
        F.lit('","width":1920,"height":'), (k % 1000).cast("string"), F.lit(',"avg_frame_rate":"'), pick(k % 3, "25/1", "0/0", "30000/1001"),
        F.lit('","r_frame_rate":"50/1"},{"codec_type":"audio","codec_name":"'), pick(k % 4, "aac", "ac3", "dts", "pcm_s16le"), F.lit('","profile":"'),
        pick(k % 2, "LC", "DTS-HD MA"), F.lit('","bit_rate":"'), (k % 700 * 1000).cast("string"), F.lit('","channels":6,"bits_per_sample":0}],"chapters":[{"start_time":"0.000","end_time":"'),
        (k % 1200).cast("string"), F.lit('.5","tags":{"title":"Opening Credits"}},{"start_time":"x","end_time":"1"},{"start_time":"2000.0","end_time":"2060.0","tags":{"title":"End Credits"}}]}'),
    )
    return o.select(k.alias("file_id"), F.when(k % 10 == 9, F.lit("{broken")).otherwise(text).alias("json"))


@query("s9_probe", """
SELECT o_orderkey AS file_id, CASE WHEN ok THEN 'matroska' END AS container, CASE WHEN ok THEN (o_orderkey % 5000)*1000+250 END AS duration_ms, CASE WHEN ok THEN o_orderkey % 1000 END AS height,
 CASE WHEN ok THEN round(CASE o_orderkey % 3 WHEN 0 THEN 25 WHEN 1 THEN 50 ELSE 30000/1001 END, 6) END AS frame_rate, CASE WHEN ok THEN ['h264','hevc'][o_orderkey%2+1] END AS video_codec,
 CASE WHEN ok THEN CASE o_orderkey % 4 WHEN 0 THEN 'AAC LC' WHEN 1 THEN 'AC-3 (Dolby Digital)' WHEN 2 THEN 'DTS LC' ELSE 'PCM' END END AS audio_profile,
 CASE WHEN ok AND o_orderkey % 700 > 0 THEN o_orderkey % 700 END AS audio_bitrate, CASE WHEN ok AND o_orderkey % 3 < 2 THEN o_orderpriority END AS tag_genre
FROM (SELECT *, o_orderkey % 10 <> 9 AS ok FROM orders)""")
def _(spark, sf):
    t = probes.tech_columns(probe_json(spark, sf))
    return t.select("file_id", "container", "duration_ms", "height", F.round("frame_rate", 6).alias("frame_rate"), "video_codec", "audio_profile", "audio_bitrate", "tag_genre")


@query("t6_audio_labels", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'AAC LC' WHEN 1 THEN 'HE-AAC v2' ELSE 'AAC DTS-HD MA' END WHEN 1 THEN 'E-AC-3 (Dolby Digital Plus)'
 WHEN 2 THEN CASE o_orderkey % 3 WHEN 0 THEN 'DTS LC' WHEN 1 THEN 'DTS HE-AACv2' ELSE 'DTS-HD MA' END ELSE 'XYZ' END AS label FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    pick = lambda i, *v: F.get(F.array(*[F.lit(x) for x in v]), i.cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", T.audio_label(pick(k % 4, "aac", "eac3", "dts", "xyz"), pick(k % 3, "LC", "HE-AACv2", "DTS-HD MA")).alias("label"))


@query("t7_frame_rates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 2000 > 0 AND (o_orderkey % 2000)::DOUBLE / (o_orderkey % 4) <= 1000 THEN round((o_orderkey % 2000)::DOUBLE / (o_orderkey % 4), 6) END AS fps FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.round(T.frame_rate(F.concat_ws("/", (k % 2000).cast("string"), (k % 4).cast("string"))), 6).alias("fps"))


@query("s10_chapters", """
SELECT o_orderkey AS file_id, 0 AS pos, 0 AS start_ms, (o_orderkey % 1200)*1000+500 AS end_ms, 'Opening Credits' AS title FROM orders WHERE o_orderkey % 10 <> 9
UNION ALL SELECT o_orderkey, 2, 2000000, 2060000, 'End Credits' FROM orders WHERE o_orderkey % 10 <> 9""")
def _(spark, sf):
    return probes.chapters(probe_json(spark, sf))


CHAPTER_SQL = """
ch AS (SELECT o_orderkey AS file_id, 0 AS start_ms, (o_orderkey % 1200)*1000+500 AS end_ms, 'intro' AS kind, (o_orderkey % 5000)*1000+250 AS dur FROM orders WHERE o_orderkey % 10 <> 9
 UNION ALL SELECT o_orderkey, 2000000, 2060000, 'credits', (o_orderkey % 5000)*1000+250 FROM orders WHERE o_orderkey % 10 <> 9),
cs AS (SELECT file_id, start_ms, end_ms, kind FROM ch WHERE end_ms-start_ms <= 900000 AND (end_ms-start_ms)*2 <= dur)"""


@query("f8_chapter_segments", "WITH " + CHAPTER_SQL + " SELECT * FROM cs")
def _(spark, sf):
    p = probe_json(spark, sf)
    timed = probes.chapters(p).join(probes.tech_columns(p).select("file_id", "duration_ms"), "file_id")
    return segments.chapter_segments(timed).select("file_id", "start_ms", "end_ms", "kind")


@query("c7_segment_precedence", "WITH " + CHAPTER_SQL + """,
old AS (SELECT o_orderkey AS file_id, 7 AS start_ms, 9 AS end_ms, 'intro' AS kind, 'audio' AS source FROM orders UNION ALL SELECT o_orderkey, 10, 20, 'recap', 'chapters' FROM orders WHERE o_orderkey % 3 = 0),
ex AS (SELECT o_orderkey AS file_id FROM orders WHERE o_orderkey % 4 <> 1),
chosen AS (SELECT file_id, start_ms, end_ms, kind, 'chapters' AS source FROM cs WHERE file_id % 6 <> 0 AND file_id IN (SELECT file_id FROM ex) UNION ALL SELECT o_orderkey, 1000, 95000, 'intro', 'edl' FROM orders WHERE o_orderkey % 12 = 0)
SELECT * FROM chosen UNION ALL SELECT * FROM old WHERE file_id NOT IN (SELECT file_id FROM chosen) AND (source = 'audio' OR file_id NOT IN (SELECT file_id FROM ex))""")
def _(spark, sf):
    p = probe_json(spark, sf)
    videos = probes.tech_columns(p).select("file_id", F.coalesce("duration_ms", F.lit(None).cast("long")).alias("duration_ms")).filter("file_id % 4 <> 1")
    # every sixth file has an edit list, every second of those an empty one
    edl = videos.filter("file_id % 6 = 0").select("file_id", F.when(F.col("file_id") % 12 == 0, "1 95 0\n1 94 1").otherwise("# none").alias("text"))
    edl = edl.withColumn("duration_ms", F.lit(0)).drop("duration_ms")
    chosen = segments.discovered(videos.withColumn("duration_ms", F.when(F.col("file_id") % 12 == 0, F.lit(None)).otherwise(F.col("duration_ms"))), edl, probes.chapters(p).join(videos.select("file_id"), "file_id", "left_semi"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"))
    lit = lambda a, b, kind, source: [F.lit(a).cast("long").alias("start_ms"), F.lit(b).cast("long").alias("end_ms"), F.lit(kind).alias("kind"), F.lit(source).alias("source")]
    old = o.select("file_id", *lit(7, 9, "intro", "audio")).unionByName(o.filter("file_id % 3 = 0").select("file_id", *lit(10, 20, "recap", "chapters")))
    return segments.replace_segments(old, videos, chosen)


@query("p17_timeline", "WITH " + CHAPTER_SQL + " SELECT file_id, start_ms, kind FROM cs")
def _(spark, sf):
    p = probe_json(spark, sf)
    timed = probes.chapters(p).join(probes.tech_columns(p).select("file_id", "duration_ms"), "file_id")
    found = segments.chapter_segments(timed)
    strange = found.withColumn("kind", F.lit("mystery"))
    return segments.timeline(found.unionByName(strange)).select("file_id", "start_ms", "kind")


@query("s12_meter", "SELECT file_id, round(integrated, 1) AS integrated, round(-true_peak, 1) AS loudness_range, round(true_peak, 1) AS true_peak FROM b_levels WHERE file_id % 9 <> 0")
def _(spark, sf):
    lv = view(spark, sf, "b_levels")
    one = lambda c: F.format_string("%.1f", c)
    text = F.concat(
        F.lit("t: 1 I: -70.0 LUFS\n[x] Summary:\n\n  Integrated loudness:\n    I:         "), one(F.col("integrated")), F.lit(" LUFS\n    Threshold: -48.2 LUFS\n\n  Loudness range:\n    LRA:        "),
        one(-F.col("true_peak")), F.lit(" LU\n    LRA low: -9 LUFS\n\n  True peak:\n    Peak:      "), one(F.col("true_peak")), F.lit(" dBFS\n"),
    )
    return probes.meter_levels(lv.select("file_id", F.when(F.col("file_id") % 9 == 0, F.lit("no result")).otherwise(text).alias("text")))


@query("s15_music_overrides", """
SELECT s_suppkey, s_name AS artist, 'x "y"' AS album, CASE WHEN s_suppkey % 2 = 0 THEN false END AS prefix FROM supplier WHERE s_suppkey % 5 <> 0""")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    text = F.concat(
        F.lit("# overrides\nartist = \""), "s_name", F.lit("\"\nalbum = 'x \"y\"'\n"), F.when(F.col("s_suppkey") % 2 == 0, "track_number_prefix = false\n").otherwise(""),
        F.when(F.col("s_suppkey") % 5 == 0, "unknown_key = 1\n").otherwise(""),
    )
    got = sidecars.music_overrides(s.select("s_suppkey", F.lit(1).alias("root_id"), F.concat(F.col("s_suppkey").cast("string"), F.lit("/music.toml")).alias("rel_path"), text.alias("text")))
    return got.select(F.col("rel_dir").cast("long").alias("s_suppkey"), "artist", "album", F.col("track_number_prefix").alias("prefix"))


# ---- reconcile

DIFF_SQL = """
WITH d AS (SELECT coalesce(k.root_id, w.root_id) AS root_id, coalesce(k.rel_path, w.rel_path) AS rel_path,
 CASE WHEN k.rel_path IS NULL THEN 'new' WHEN w.rel_path IS NULL THEN 'vanished' WHEN k.size<>w.size OR k.mtime<>w.mtime THEN 'changed'
  WHEN length(k.rel_path) % 7 = 0 THEN 'retry' WHEN length(k.rel_path) % 5 = 0 THEN 'stale' ELSE 'same' END AS action, k.mtime AS k_at
 FROM (SELECT * FROM b_known WHERE root_id <> 4) k FULL JOIN (SELECT * FROM b_walk WHERE root_id <> 4) w ON k.root_id=w.root_id AND k.rel_path=w.rel_path)"""


def known(spark, sf):
    """The catalog's side of the diff with the sidecar state it recorded."""
    k = view(spark, sf, "b_known")
    n = F.length("rel_path")
    return k.select(
        "root_id", "rel_path", reconcile.file_id_for(F.col("root_id"), F.col("rel_path")).alias("file_id"), "size", "mtime", F.lit("movies").alias("kind"),
        F.lit("video/x-matroska").alias("mime"), F.when(n % 7 == 0, "error").otherwise("ready").alias("status"), F.when(n % 5 == 0, 1).cast("long").alias("nfo_mtime"),
        F.lit(None).cast("long").alias("edl_mtime"), F.lit(None).cast("string").alias("art"), F.col("mtime").alias("updated_at"), F.col("mtime").alias("added_at"),
    )


def walked(spark, sf):
    null = lambda t: F.lit(None).cast(t)
    return view(spark, sf, "b_walk").select(
        "root_id", "rel_path", "size", "mtime", F.lit("movies").alias("kind"), F.lit("video/x-matroska").alias("mime"), null("long").alias("nfo_mtime"),
        null("long").alias("edl_mtime"), null("string").alias("found_art"), null("long").alias("override_mtime"),
    )


def reachable(spark, sf):
    """Every root but the fourth, which is not mounted."""
    return view(spark, sf, "b_roots").filter("root_id <> 4")


def diffed(spark, sf):
    return reconcile.diff(known(spark, sf), walked(spark, sf), reachable(spark, sf))


@query("j9_snapshot_diff", DIFF_SQL + "SELECT root_id, rel_path, action FROM d")
def _(spark, sf):
    return diffed(spark, sf).select("root_id", "rel_path", "action")


@query("j10_vanished", DIFF_SQL + "SELECT root_id, rel_path FROM d WHERE action='vanished'")
def _(spark, sf):
    k = known(spark, sf).join(reachable(spark, sf).select("root_id"), "root_id", "left_semi")
    return k.join(walked(spark, sf), ["root_id", "rel_path"], "left_anti").select("root_id", "rel_path")


@query("s22_next_files", DIFF_SQL + """, k AS (SELECT root_id, regexp_replace(rel_path, '\\.[^./]*$', '') AS st, min(mtime) AS m FROM b_known GROUP BY 1, 2)
SELECT d.root_id, d.rel_path, CASE WHEN action IN ('new','changed') OR length(d.rel_path) % 7 = 0 THEN CASE WHEN action IN ('new','changed') THEN 'pending' ELSE 'error' END ELSE 'ready' END AS status,
 CASE WHEN action='new' THEN least(20990101, coalesce(k.m, 20990101)) ELSE k_at END AS added_at
FROM d LEFT JOIN k ON k.root_id=d.root_id AND k.st=regexp_replace(d.rel_path, '\\.[^./]*$', '') WHERE action <> 'vanished'""")
def _(spark, sf):
    return reconcile.next_files(diffed(spark, sf), known(spark, sf), 20990101).select("root_id", "rel_path", "status", "added_at")


@query("f7_settled", "SELECT file_id FROM b_files WHERE 19990101 - added_at >= 30")
def _(spark, sf):
    f = view(spark, sf, "b_files").withColumn("mtime", F.col("added_at"))
    return reconcile.settled(f, 19990101, 30).select("file_id")


@query("f16_unreflected", """
SELECT w.root_id, w.rel_path FROM b_walk w WHERE NOT EXISTS (SELECT 1 FROM b_known k WHERE k.root_id=w.root_id AND k.rel_path=w.rel_path AND k.size=w.size AND k.mtime=w.mtime AND length(k.rel_path) % 7 <> 0)""")
def _(spark, sf):
    return reconcile.unreflected(walked(spark, sf), known(spark, sf)).select("root_id", "rel_path")


@query("f17_unfinished", "SELECT file_id, status FROM b_files WHERE status <> 'ready'")
def _(spark, sf):
    return reconcile.unfinished(view(spark, sf, "b_files")).select("file_id", "status")


@query("j11_inherited_added_at", """
WITH f AS (SELECT root_id, rel_path, added_at, regexp_replace(rel_path, '\\.v[0-9]+\\.mkv$', '') AS st, rel_path LIKE '%.v1.mkv' AS is_new, rel_path LIKE '%.v2.mkv' AS gone FROM b_movies)
SELECT a.root_id, a.rel_path, min(least(a.added_at, coalesce(b.m, a.added_at))) AS added_at FROM f a LEFT JOIN (
 SELECT root_id, st, true AS n, min(added_at) AS m FROM f WHERE NOT is_new GROUP BY 1, 2 UNION ALL SELECT root_id, st, false, min(added_at) FROM f WHERE gone GROUP BY 1, 2) b
ON a.root_id=b.root_id AND a.st=b.st AND a.is_new=b.n WHERE NOT gone GROUP BY 1, 2""")
def _(spark, sf):
    # versions v1, v2 ... of a film become same-stem files of different types
    f = view(spark, sf, "b_movies").select("root_id", F.regexp_replace("rel_path", r"\.v(\d+)\.mkv$", ".x$1").alias("rel_path"), "added_at", F.col("rel_path").alias("shown"))
    new, gone = F.col("shown").endswith(".v1.mkv"), F.col("shown").endswith(".v2.mkv")
    rows = f.filter(~gone).withColumn("is_new", new)
    got = reconcile.inherited_added_at(rows, f.filter(~new), f.filter(gone))
    return got.groupBy("root_id", F.col("shown").alias("rel_path")).agg(F.min("added_at").alias("added_at"))


@query("j12_nearest_overrides", """
WITH t AS (SELECT file_id, rel_path, regexp_extract(rel_path, '^([^/]*)/', 1) AS a, regexp_extract(rel_path, '^([^/]*/[^/]*)/', 1) AS b FROM b_tracks),
o AS (SELECT DISTINCT a AS dir, 'A' || length(a) AS artist, NULL AS album FROM t UNION ALL SELECT DISTINCT b, CASE WHEN length(b) % 2 = 0 THEN 'B' || length(b) END, 'L' || length(b) FROM t UNION ALL SELECT '', 'top', 'top')
SELECT t.file_id, coalesce(ob.artist, oa.artist, 'top') AS over_artist, coalesce(ob.album, oa.album, 'top') AS over_album FROM t LEFT JOIN o ob ON ob.dir=t.b LEFT JOIN o oa ON oa.dir=t.a""")
def _(spark, sf):
    t = view(spark, sf, "b_tracks")
    dirs = t.select(reconcile.folder_of(F.col("rel_path")).alias("b")).distinct()
    n = lambda c: F.length(c).cast("string")
    top = spark.createDataFrame([(20, "", "top", "top")], "root_id int, rel_dir string, artist string, album string")
    a = dirs.select(F.regexp_extract("b", "^([^/]*)/", 1).alias("a")).distinct().select(F.lit(20).alias("root_id"), F.col("a").alias("rel_dir"), F.concat(F.lit("A"), n("a")).alias("artist"), F.lit(None).cast("string").alias("album"))
    b = dirs.select(F.lit(20).alias("root_id"), F.col("b").alias("rel_dir"), F.when(F.length("b") % 2 == 0, F.concat(F.lit("B"), n("b"))).alias("artist"), F.concat(F.lit("L"), n("b")).alias("album"))
    return reconcile.with_overrides(t, top.unionByName(a).unionByName(b)).select("file_id", "over_artist", "over_album")


def art_inventory(f):
    """Pictures in some folders of every kind of root, beside the files ``f``."""
    d = f.select("root_id", reconcile.folder_of(F.col("rel_path")).alias("d")).distinct()
    n = F.length("d")
    pics = [F.when(n % 3 == 0, F.concat("d", F.lit("/front.jpg"))), F.when(n % 2 == 0, F.concat("d", F.lit("/poster.png"))), F.when(n % 5 == 0, F.concat(F.regexp_replace("d", "/[^/]*$", ""), F.lit("/folder.jpg")))]
    shared = d.select("root_id", F.explode(F.array_compact(F.array(*pics))).alias("rel_path"))
    own = f.filter("file_id % 11 = 0").select("root_id", F.concat(path_stem(F.col("rel_path")), F.lit("-poster.png")).alias("rel_path"))
    return shared.unionByName(own).distinct().select("root_id", "rel_path", F.lit(10).cast("long").alias("size"), F.lit(5).cast("long").alias("mtime"))


@query("j13_discover_art", """
WITH f AS (SELECT file_id, root_id, kind, rel_path, regexp_replace(rel_path, '/[^/]*$', '') AS d FROM b_files),
d AS (SELECT DISTINCT root_id, d FROM f),
inv AS (SELECT root_id, d || '/front.jpg' AS p FROM d WHERE length(d) % 3 = 0 UNION SELECT root_id, d || '/poster.png' FROM d WHERE length(d) % 2 = 0 UNION SELECT root_id, regexp_replace(d, '/[^/]*$', '') || '/folder.jpg' FROM d WHERE length(d) % 5 = 0
 UNION SELECT root_id, regexp_replace(rel_path, '\\.[^./]*$', '') || '-poster.png' FROM f WHERE file_id % 11 = 0),
c AS (SELECT *, unnest(CASE kind WHEN 'music' THEN ['folder.jpg','front.jpg','poster.jpg','poster.png'] WHEN 'tv' THEN ['own','poster.jpg','poster.png','folder.jpg','up/poster.png','up/folder.jpg'] ELSE ['own'] END) AS n,
  generate_subscripts(CASE kind WHEN 'music' THEN ['folder.jpg','front.jpg','poster.jpg','poster.png'] WHEN 'tv' THEN ['own','poster.jpg','poster.png','folder.jpg','up/poster.png','up/folder.jpg'] ELSE ['own'] END, 1) AS rk FROM f),
p AS (SELECT file_id, rk, root_id, CASE WHEN n = 'own' THEN regexp_replace(rel_path, '\\.[^./]*$', '') || '-poster.png' WHEN n LIKE 'up/%' THEN regexp_replace(d, '/[^/]*$', '') || '/' || substr(n, 4) ELSE d || '/' || n END AS p FROM c)
SELECT f.file_id, b.art AS found_art FROM f LEFT JOIN (SELECT file_id, arg_min(p.p, rk) AS art FROM p JOIN inv ON inv.root_id=p.root_id AND inv.p=p.p GROUP BY 1) b USING (file_id)""")
def _(spark, sf):
    # files and pictures are put together once, each kind reads its own
    files = written(view(spark, sf, "b_files").select("file_id", "root_id", "kind", "rel_path"), "media-files")
    return reconcile.discover_art(files, written(art_inventory(files), "pictures")).select("file_id", "found_art")


@query("j14_sidecar_times", """
SELECT file_id, CASE WHEN p % 3 = 0 THEN 7 END AS nfo_mtime FROM (SELECT f.*, max(file_id) OVER (PARTITION BY root_id, rel_path) AS p FROM b_files f)""")
def _(spark, sf):
    f = view(spark, sf, "b_files")
    inv = f.groupBy("root_id", "rel_path").agg(F.max("file_id").alias("p")).filter("p % 3 = 0")
    inv = inv.select("root_id", reconcile.sibling(F.col("rel_path"), "nfo").alias("rel_path"), F.lit(7).cast("long").alias("mtime"))
    return reconcile.beside(f, inv, "nfo", "nfo_mtime").select("file_id", "nfo_mtime")


@query("j15_movie_facts", """
SELECT l.file_id, CASE WHEN p_partkey % 7 <> 0 THEN p_name || ' & co' ELSE p_name END AS title, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 9 <> 0 THEN p_size+1970 ELSE 1970+p_size END AS year,
 CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 > 1 THEN CAST(p_partkey % 10 AS DOUBLE) END AS rating, CASE WHEN p_partkey % 7 <> 0 THEN p_type || '|' || p_brand ELSE 'Tag' END AS genres
FROM b_movies l JOIN part ON p_partkey = (l.file_id // 10000) % 100000""")
def _(spark, sf):
    m = view(spark, sf, "b_movies")
    # the bridge's line items can repeat an id; each has one description and one tag all the same
    ids = m.select("file_id").distinct()
    part_of = ids.select("file_id", F.expr("(file_id div 10000) % 100000").alias("part"))
    n = sidecars.read_nfo(nfo_texts(spark, sf)).withColumnRenamed("file_id", "part")
    nfo = part_of.join(n, "part").drop("part")
    tags = ids.select("file_id", F.lit("Tag").alias("tag_genre"))
    facts = reconcile.movie_facts(m.select("file_id", "rel_path"), nfo, tags)
    return facts.select("file_id", "title", "year", "rating", F.array_join("genres", "|").alias("genres"))


@query("j26_affected_media", """
WITH f AS (SELECT * FROM b_files WHERE status='ready'), e AS (SELECT DISTINCT root_id, regexp_replace(rel_path, '/[^/]*$', '') AS d FROM b_files)
SELECT f.root_id, e.d || '/cover.jpg' AS event_path, f.file_id, 'folder art' AS why FROM e JOIN f ON f.root_id=e.root_id AND (regexp_replace(f.rel_path, '/[^/]*$', '') = e.d OR regexp_replace(f.rel_path, '/?[^/]*/[^/]*$', '') = e.d)
UNION ALL SELECT f.root_id, regexp_replace(f.rel_path, '\\.[^./]*$', '') || '.nfo', f.file_id, 'sidecar' FROM f WHERE file_id % 13 = 0 AND kind = 'tv'
UNION ALL SELECT f.root_id, regexp_extract(f.rel_path, '^([^/]*)/', 1) || '/music.toml', f.file_id, 'overrides' FROM f WHERE kind='music'""")
def _(spark, sf):
    # files are put together once, and so are the events made of them, which each kind of sidecar reads
    f = written(view(spark, sf, "b_files").select("root_id", "rel_path", "file_id", "kind", "status"), "media-files")
    ready = f.filter("status = 'ready'")
    art = f.select("root_id", F.concat(reconcile.folder_of(F.col("rel_path")), F.lit("/cover.jpg")).alias("event_path")).distinct()
    nfo = ready.filter("file_id % 13 = 0 and kind = 'tv'").select("root_id", reconcile.sibling(F.col("rel_path"), "nfo").alias("event_path"))
    toml = ready.filter("kind = 'music'").select("root_id", F.concat(F.regexp_extract("rel_path", "^([^/]*)/", 1), F.lit("/music.toml")).alias("event_path")).distinct()
    return reconcile.affected_media(written(art.unionByName(nfo).unionByName(toml), "sidecar-events"), f)


@query("u3_sync_roots", """
SELECT path, CASE WHEN root_id % 6 = 0 THEN 'removed' WHEN root_id % 6 = 1 THEN 'updated' ELSE 'kept' END AS change FROM b_roots UNION ALL SELECT '/new' || r_regionkey, 'added' FROM region""")
def _(spark, sf):
    old = view(spark, sf, "b_roots")
    new = old.filter("root_id % 6 <> 0").select("path", F.when(F.col("root_id") % 6 == 1, "other").otherwise(F.col("kind")).alias("kind"))
    extra = table(spark, sf, "region").select(F.concat(F.lit("/new"), F.col("r_regionkey").cast("string")).alias("path"), F.lit("tv").alias("kind"))
    return reconcile.sync_roots(old, new.unionByName(extra)).select("path", "change")


@query("u5_ensure_names", """
SELECT lower(name) AS k, count(*) AS n FROM (SELECT 'ECONOMY' AS name UNION ALL SELECT min(x) FROM (SELECT p_type AS x FROM part UNION ALL SELECT upper(p_brand) FROM part UNION ALL SELECT p_brand FROM part) WHERE lower(x) <> 'economy' GROUP BY lower(x)) GROUP BY 1""")
def _(spark, sf):
    p = table(spark, sf, "part")
    found = p.select(F.col("p_type").alias("name")).union(p.select(F.concat(F.lit(" "), F.upper("p_brand")))).union(p.select("p_brand"))
    old = spark.createDataFrame([(1, "ECONOMY")], "id long, name string")
    return reconcile.ensure_names(old, found).groupBy(F.lower("name").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("f6_delete_under", """
SELECT file_id FROM b_files WHERE NOT (kind = 'movies' AND root_id % 2 = 0 AND (starts_with(rel_path, 'ECONOMY/') OR starts_with(rel_path, 'PROMO/Brand#1/')))""")
def _(spark, sf):
    r = view(spark, sf, "b_roots").filter("kind = 'movies' and root_id % 2 = 0").select("root_id")
    gone = r.select("root_id", F.explode(F.array(F.lit("ECONOMY"), F.lit("PROMO/Brand#1"))).alias("path"))
    return reconcile.delete_under(view(spark, sf, "b_files"), gone).select("file_id")


@query("s16_ready_by_kind", "SELECT file_id, kind, size FROM b_files WHERE status='ready' AND kind='tv'")
def _(spark, sf):
    return items.ready(view(spark, sf, "b_files")).filter("kind = 'tv'").select("file_id", "kind", "size")


@query("f1_ready", "SELECT kind, count(*) AS n FROM b_files WHERE status='ready' GROUP BY 1")
def _(spark, sf):
    return items.ready(view(spark, sf, "b_files")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("s21_point_reads", """
SELECT f.file_id, f.rel_path, r.path FROM b_files f JOIN b_roots r USING (root_id) WHERE f.file_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 0)""")
def _(spark, sf):
    wanted = table(spark, sf, "orders").filter("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("file_id"))
    return view(spark, sf, "b_files").join(wanted, "file_id", "left_semi").join(view(spark, sf, "b_roots"), "root_id").select("file_id", "rel_path", "path")
