"""Audio decisions, metadata joins and sidecar texts over the bridge tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelf.operators import audio, enrich, reconcile
from shelf.plans.caption_queries import streams
from shelf.plans.registry import query
from shelf.session import checkpoint_dir
from shelf.sources import metadata, sidecars
from shelf.sources.bridge import table, view

TARGET, MIN_GAIN = -24.0, 4.0
DECIDE = """
WITH v AS (SELECT file_id, integrated, true_peak, channels, -24 - integrated AS wanted, -2 - true_peak AS headroom, least(-24 - integrated, -2 - true_peak, 20) AS g FROM b_levels)
SELECT file_id, CASE WHEN integrated <= -69 THEN 'silent' WHEN wanted < 4 THEN 'normal' WHEN g < 4 THEN 'no headroom' ELSE 'gain' END AS verdict,
 CASE WHEN wanted >= 4 AND g >= 4 THEN floor(g*10)/10 END AS gain, CASE WHEN wanted >= 4 AND g >= 4 AND channels > 2 THEN
  CASE WHEN least(-24 - integrated + 1, -2 - true_peak + 0.5, 20) >= 4 AND -24 - integrated + 1 >= 4 THEN floor(least(-24 - integrated + 1, -2 - true_peak + 0.5, 20)*10)/10
   ELSE floor(greatest(least(floor(g*10)/10, -2 - true_peak + 0.5), 0)*10)/10 END END AS mixdown_gain FROM v"""


@query("t12_gain_decision", DECIDE)
def _(spark, sf):
    lv = view(spark, sf, "b_levels").withColumn("mix_integrated", F.col("integrated") - 1).withColumn("mix_peak", F.col("true_peak") - 0.5)
    return audio.decide(lv, TARGET, MIN_GAIN).select("file_id", "verdict", "gain", "mixdown_gain")


@query("a24_stream_counts", "SELECT o_orderkey AS file_id, CAST(1 AS BIGINT) AS video, CAST(2 AS BIGINT) AS audio, CAST(least(o_orderkey % 4, 3) AS BIGINT) AS subtitle FROM orders")
def _(spark, sf):
    return audio.census(streams(spark, sf))


AUDIO = """
a AS (SELECT o_orderkey AS k, 0 AS ordinal, ['aac','ac3','dts','eac3','aac'][o_orderkey%5+1] AS codec, [2,6,8][o_orderkey%3+1] AS ch, o_orderkey%3=1 AS dflt, ['eng','fre','und','ger'][o_orderkey%4+1] AS lang,
  CASE WHEN o_orderkey%6=0 THEN 'Stereo (AAC) ' ELSE 'Main ' END AS label FROM orders
 UNION ALL SELECT o_orderkey, 1, ['aac','ac3'][o_orderkey%2+1], [2,6][o_orderkey%2+1], false, NULL, 'Second ' FROM orders)"""


@query("a20_dialogue_stream", "WITH " + AUDIO + """
SELECT k AS file_id, coalesce(min(ordinal) FILTER (WHERE dflt), arg_max(ordinal, (ch, ordinal))) AS ordinal, coalesce(arg_min(ch, ordinal) FILTER (WHERE dflt), arg_max(ch, (ch, ordinal))) AS channels FROM a GROUP BY 1""")
def _(spark, sf):
    return audio.dialogue_stream(streams(spark, sf))


@query("t13_raise_plan", "WITH " + AUDIO + """,
b AS (SELECT x.k, x.label, x.lang AS l0, x.ch AS c0, y.ch AS c1, y.codec AS k1, x.label LIKE 'Stereo%' AND (y.codec IN ('ac3','eac3') OR y.ch > 2) AS bare FROM a x JOIN a y ON x.k=y.k AND x.ordinal=0 AND y.ordinal=1)
SELECT k AS file_id, NULL AS reason, CASE WHEN bare THEN 2 ELSE 1 END AS source, CASE WHEN bare THEN c1 ELSE c0 END AS channels, CASE WHEN bare THEN 1 END AS dropped,
 CASE WHEN bare THEN '' ELSE coalesce(CASE l0 WHEN 'eng' THEN 'English ' WHEN 'fre' THEN 'French ' WHEN 'ger' THEN 'German ' END, '') END || 'Stereo Mixdown' AS mixdown_name FROM b""")
def _(spark, sf):
    return audio.raise_plan(streams(spark, sf))


@query("t14_remux_plan", "WITH " + AUDIO + """,
subs AS (SELECT o_orderkey AS k, i, ['subrip','hdmv_pgs_subtitle','ass'][(o_orderkey+i)%3+1] AS codec FROM orders, range(3) r(i) WHERE i < o_orderkey % 4),
s AS (SELECT k, count(*) FILTER (WHERE codec='hdmv_pgs_subtitle') AS pics, count(*) FILTER (WHERE codec<>'hdmv_pgs_subtitle') AS texts FROM subs GROUP BY 1),
x AS (SELECT o_orderkey AS k, a0.codec AS c0, a0.ch AS ch0, a0.label AS l0, a1.codec AS c1, coalesce(pics, 0) AS pics, coalesce(texts, 0) AS texts, o_orderkey % 9 = 0 AS srt FROM orders
 JOIN a a0 ON a0.k=o_orderkey AND a0.ordinal=0 JOIN a a1 ON a1.k=o_orderkey AND a1.ordinal=1 LEFT JOIN s ON s.k=o_orderkey),
r AS (SELECT *, CASE WHEN k % 4 = 2 THEN 'video codec vc1 is not MP4/browser material' WHEN c0='dts' THEN 'audio codec dts is not MP4-safe' WHEN pics > 0 AND NOT srt THEN 'bitmap subtitles (hdmv_pgs_subtitle) cannot live in MP4' END AS reason FROM x)
SELECT k AS file_id, reason IS NULL AS eligible, reason, CASE WHEN reason IS NULL THEN CASE WHEN c0 IN ('ac3','eac3') OR ch0 > 2 THEN 1 ELSE 0 END + CASE WHEN c1='ac3' AND l0 NOT LIKE 'Stereo%' THEN 1 ELSE 0 END END AS twins,
 reason IS NULL AND srt AND texts = 0 AS embed_srt FROM r""")
def _(spark, sf):
    s = streams(spark, sf)
    srt = s.filter("file_id % 9 = 0").select("file_id").distinct()
    return audio.remux_plan(s, srt).select("file_id", "eligible", "reason", "twins", "embed_srt")


@query("t15_track_names", "WITH " + AUDIO + """
SELECT k AS file_id, ordinal, CASE WHEN ordinal = 1 THEN 'Second' ELSE coalesce(CASE lang WHEN 'eng' THEN 'English ' WHEN 'fre' THEN 'French ' WHEN 'ger' THEN 'German ' END, '')
 || CASE ch WHEN 2 THEN 'Stereo' WHEN 6 THEN '5.1' ELSE '7.1' END || CASE codec WHEN 'ac3' THEN ' Dolby Digital' WHEN 'eac3' THEN ' Dolby Digital Plus' ELSE '' END END AS name FROM a""")
def _(spark, sf):
    a = audio.audio_streams(streams(spark, sf))
    return a.select("file_id", "ordinal", audio.track_name(F.col("own_title"), F.col("codec"), F.col("channels"), F.col("language")).alias("name"))


def looked_files(spark, sf):
    return view(spark, sf, "b_episodes").select("file_id", F.concat(F.lit("/tv/"), "rel_path").alias("path"), "size")


@query("t21_loudness_memory", """
WITH f AS (SELECT file_id, '/tv/' || rel_path AS path, regexp_replace('/tv/' || rel_path, '\\.[^./]*$', '') AS key, size FROM b_episodes)
SELECT key, CASE WHEN file_id % 4 = 3 THEN size ELSE size + 1 END AS stamp, CASE file_id % 4 WHEN 0 THEN 'looked' WHEN 2 THEN CASE WHEN file_id % 3 = 0 THEN 'raised' ELSE 'normalized earlier' END ELSE CASE WHEN file_id % 3 = 0 THEN 'raised' ELSE 'normal' END END AS note,
 CASE WHEN file_id % 4 > 0 AND file_id % 3 = 0 THEN 5.0 END AS gain FROM f WHERE file_id % 5 <> 0""")
def _(spark, sf):
    f = looked_files(spark, sf)
    k = F.col("file_id")
    third = k % 3 == 0
    memory = f.select(
        audio.memory_key(F.col("path")).alias("key"), F.regexp_replace("path", "mkv$", "avi").alias("file"), F.col("size").alias("stamp"),
        F.when(third, "raised").otherwise("normal").alias("note"), F.lit(-30.0).alias("integrated"), F.lit(-9.0).alias("true_peak"), F.when(third, 5.0).alias("gain"), "file_id",
    ).withColumn("file", F.when(k % 4 == 3, F.regexp_replace("file", "avi$", "mkv")).otherwise(F.col("file"))).drop("file_id")
    now = f.select("path", (F.col("size") + 1).alias("stamp"), "file_id")
    looked = now.filter("file_id % 4 = 0").select(
        "path", "stamp", F.lit("looked").alias("note"), F.lit(-20.0).alias("integrated"), F.lit(-1.0).alias("true_peak"), F.lit(None).cast("double").alias("gain")
    )
    left = now.filter("file_id % 5 <> 0")
    return audio.remember(memory, looked, now.filter("file_id % 4 = 1"), now.filter("file_id % 4 = 2"), left).select("key", "stamp", "note", "gain")


@query("t21_unsettled", "SELECT file_id FROM b_episodes WHERE file_id % 3 <> 0")
def _(spark, sf):
    f = looked_files(spark, sf)
    memory = f.select(audio.memory_key(F.col("path")).alias("key"), F.when(F.col("file_id") % 3 == 0, F.col("size")).otherwise(F.lit(0)).alias("stamp")).filter("stamp > 0")
    return audio.unsettled(f.withColumnRenamed("size", "stamp"), memory).select("file_id")


@query("c11_audio_report", DECIDE.replace("SELECT file_id, CASE WHEN integrated", "SELECT verdict, count(*) AS n, round(sum(gain), 1) AS total_gain FROM (SELECT file_id, CASE WHEN integrated", 1) + ") GROUP BY 1")
def _(spark, sf):
    got = audio.decide(view(spark, sf, "b_levels"), TARGET, MIN_GAIN)
    return got.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("gain"), 1).alias("total_gain"))


# ---- metadata and sidecars

def ratings(spark, sf):
    """A ratings list with one title per supplier."""
    s = table(spark, sf, "supplier")
    return s.select(F.concat(F.lit("tt"), (F.col("s_suppkey") + 1000000).cast("string")).alias("tconst"), F.round(F.col("s_suppkey") % 100 / 10, 1).alias("averageRating"), F.lit(10).cast("long").alias("numVotes"))


@query("s13_ratings", """SELECT 'tt' || (s_suppkey + 1000000) AS tconst, round(s_suppkey % 100 / 10, 1) AS rating, CAST(10 AS BIGINT) AS votes FROM supplier
 UNION ALL SELECT 'tt' || n_nationkey, NULL, NULL FROM nation""")
def _(spark, sf):
    """A ratings list written as published (gzip, tab separated, a header, null as a mark) and read back."""
    unrated = table(spark, sf, "nation").select(F.concat(F.lit("tt"), F.col("n_nationkey").cast("string")), F.lit(None).cast("double"), F.lit(None).cast("long"))
    path = f"{checkpoint_dir(spark)}/ratings-{uuid.uuid4().hex}"
    ratings(spark, sf).union(unrated).write.csv(path, sep="\t", header=True, compression="gzip", nullValue="\\N")
    return metadata.read_ratings(spark, path).select("tconst", F.col("averageRating").alias("rating"), F.col("numVotes").alias("votes"))


@query("j19_attach_ratings", """
SELECT l.file_id, CASE WHEN l.file_id % 3 = 0 AND s_suppkey IS NOT NULL THEN round(s_suppkey % 100 / 10, 1) END AS found_rating
FROM b_levels l LEFT JOIN supplier ON s_suppkey = l.file_id % 10000 AND s_suppkey % 2 = 0""")
def _(spark, sf):
    rows = view(spark, sf, "b_levels").select("file_id", F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("tt"), (F.col("file_id") % 10000 + 1000000).cast("string"))).alias("imdb_id"))
    half = ratings(spark, sf).filter("cast(substring(tconst, 3) as int) % 2 = 0")
    return enrich.attach_ratings(rows, half).select("file_id", "found_rating")


def candidates(spark, sf):
    """Provider candidates: two per part name and year, a third under another year."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    year = (F.col("p_size") + 1970).cast("int")
    row = lambda i, y, first, rank: p.select((k * 10 + i).alias("tmdb_id"), F.upper("p_name").alias("title"), y.alias("year"), F.lit(first).alias("is_primary"), rank.alias("rank"))
    return row(1, year, False, k * 0 + 1).unionByName(row(2, year, True, k * 0 + 2)).unionByName(row(3, year + 1, False, k * 0 + 3))


MATCH = """
c AS (SELECT lower(p_name) AS t, p_size+1970 AS y, p_partkey*10+1 AS id, false AS pr, 1 AS rk FROM part UNION ALL SELECT lower(p_name), p_size+1970, p_partkey*10+2, true, 2 FROM part UNION ALL SELECT lower(p_name), p_size+1971, p_partkey*10+3, false, 3 FROM part),
tasks AS (SELECT p_partkey AS task_id, lower(p_name) AS t, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN p_size+1971 ELSE p_size+1970 + CASE WHEN p_partkey % 4 = 3 THEN 100 ELSE 0 END END AS y,
  CASE WHEN p_partkey % 10 = 0 THEN CASE WHEN p_partkey % 20 = 0 THEN p_partkey*10+1 ELSE 7 END END AS pin FROM part),
m AS (SELECT task_id, arg_min(id, (CASE WHEN tasks.y IS NULL OR pr THEN 0 ELSE 1 END, rk, id)) AS match_id, min(CASE WHEN tasks.y IS NULL OR pr THEN 0 ELSE 1 END) AS tier FROM tasks JOIN c ON c.t=tasks.t AND (tasks.y IS NULL OR c.y=tasks.y) WHERE pin IS NULL GROUP BY 1)"""


@query("j23_match_metadata", "WITH " + MATCH + """
SELECT tasks.task_id, CASE WHEN pin IS NOT NULL THEN CASE WHEN pin IN (SELECT id FROM c) THEN pin END ELSE match_id END AS match_id,
 CASE WHEN pin IS NOT NULL THEN 'pin' WHEN tier = 0 THEN 'exact' WHEN tier = 1 THEN 'loose' END AS how FROM tasks LEFT JOIN m USING (task_id)""")
def _(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    year = F.col("p_size") + 1970
    tasks = p.select(
        k.alias("task_id"), F.col("p_name").alias("title"),
        F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, year + 1).when(k % 4 == 3, year + 100).otherwise(year).cast("int").alias("year"),
        F.when(k % 10 == 0, F.when(k % 20 == 0, k * 10 + 1).otherwise(F.lit(7))).alias("tmdb_id"),
    )
    return enrich.match_movies(tasks, candidates(spark, sf))


@query("j22_episode_metadata", """
SELECT o_orderkey AS task_id, CASE WHEN o_custkey % 3 = 0 THEN 'Episode ' || (o_custkey % 50) ELSE 'Title ' || c_name END AS title, CASE WHEN o_custkey % 3 <> 0 THEN '2001-02-03' END AS aired
FROM orders LEFT JOIN (SELECT c_custkey % 7 AS sid, c_custkey % 50 AS ep, max(c_name) AS c_name FROM customer GROUP BY 1, 2) ON sid = o_custkey % 7 AND ep = o_custkey % 50""")
def _(spark, sf):
    c = table(spark, sf, "customer").groupBy((F.col("c_custkey") % 7).alias("series_id"), (F.col("c_custkey") % 50).alias("episode")).agg(F.max("c_name").alias("n"))
    dump = c.select("series_id", F.lit(1).alias("season"), "episode", F.format_string('{"overview":"o","episodes":[{"episode_number":%d,"name":"Title %s","air_date":"2001-02-03"},{"name":"none"}]}', "episode", "n").alias("json"))
    _, episodes = metadata.season_details(dump)
    k = F.col("o_custkey")
    tasks = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.when(k % 3 == 0, -1).otherwise(k % 7).alias("series_id"), F.lit(1).alias("season"), (k % 50).alias("episode")
    )
    return enrich.episode_metadata(tasks, episodes).select("task_id", "title", "aired")


@query("s14_movie_details", """
SELECT p_partkey AS tmdb_id, p_name AS title, CASE WHEN p_partkey % 4 > 0 THEN 1970+p_size END AS year, CASE WHEN p_partkey % 3 > 0 THEN 'about ' || p_name END AS plot, p_type || '|' || p_brand AS genres, 'A|C' AS directors,
 CASE WHEN p_partkey % 5 > 0 THEN 'tt' || p_partkey END AS imdb_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' Set' END AS collection FROM part""")
def _(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    json = F.concat(
        F.lit('{"id":'), k.cast("string"), F.lit(',"title":"'), "p_name", F.lit('","release_date":"'), F.when(k % 4 > 0, F.concat((F.col("p_size") + 1970).cast("string"), F.lit("-05-06"))).otherwise(""),
        F.lit('","overview":"'), F.when(k % 3 > 0, F.concat(F.lit("about "), "p_name")).otherwise(""), F.lit('","genres":[{"id":1,"name":"'), "p_type", F.lit('"},{"name":"'), "p_brand",
        F.lit('"}],"credits":{"crew":[{"job":"Director","name":"A"},{"job":"Writer","name":"B"},{"job":"Director","name":"C"}]},"external_ids":{"imdb_id":"'),
        F.when(k % 5 > 0, F.concat(F.lit("tt"), k.cast("string"))).otherwise(""), F.lit('"},"belongs_to_collection":'),
        F.when(k % 2 == 0, F.concat(F.lit('{"name":"'), "p_brand", F.lit(' Set"}'))).otherwise("null"), F.lit("}"),
    )
    d = metadata.movie_details(p.select(json.alias("json")))
    return d.select("tmdb_id", "title", "year", "plot", F.array_join("genres", "|").alias("genres"), F.array_join("directors", "|").alias("directors"), "imdb_id", "collection")


@query("f13_new_arrivals", """
SELECT root_id, rel_path FROM (SELECT root_id, rel_path, max(added_at) AS a FROM b_files WHERE kind <> 'music' AND NOT (kind = 'tv' AND length(rel_path) % 5 = 0) GROUP BY 1, 2) WHERE a >= 19980101
UNION SELECT root_id, rel_path FROM b_files WHERE kind = 'tv' AND length(rel_path) % 5 = 0""")
def _(spark, sf):
    f = view(spark, sf, "b_files")
    disk = f.select("root_id", "rel_path").distinct()
    known = f.filter("not (kind = 'tv' and length(rel_path) % 5 = 0)").groupBy("root_id", "rel_path").agg(F.max("added_at").alias("added_at"))
    return enrich.new_arrivals(disk, known, view(spark, sf, "b_roots"), 19980101).select("root_id", "rel_path")


@query("f13_parse_day", "SELECT o_orderkey, CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) AS at FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", enrich.parse_day(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("at"))


def sidecar_texts(spark, sf):
    """A description beside two thirds of the films: generated in full, generated early, written by hand, or a pin."""
    m = view(spark, sf, "b_movies").select("root_id", "rel_path").distinct().withColumn("n", F.length("rel_path"))
    made = F.lit(f"<!-- {enrich.MARKER} -->\n<movie>\n  <title>T</title>\n")
    full = F.concat(made, F.lit('  <rating>7.0</rating>\n  <plot>p</plot>\n  <set></set>\n  <uniqueid type="imdb">tt1234567</uniqueid>\n  <uniqueid type=\'tmdb\'>42</uniqueid>\n</movie>\n'))
    early = F.concat(made, F.lit('  <plot>p</plot>\n  <set></set>\n  <uniqueid default="true" type="imdb">tt1234567</uniqueid>\n</movie>\n'))
    text = F.when(F.col("n") % 5 == 0, full).when(F.col("n") % 5 == 1, early).when(F.col("n") % 5 == 2, F.lit("<movie><title>Mine</title></movie>")).when(
        F.col("n") % 5 == 3, F.lit('<movie><uniqueid type="imdb"></uniqueid><uniqueid type="tmdb"> 77 </uniqueid></movie>'))
    return m.select("root_id", reconcile.sibling(F.col("rel_path"), "nfo").alias("rel_path"), text.alias("text")).filter("text is not null")


@query("t16_sidecar_state", """
SELECT DISTINCT root_id, regexp_replace(rel_path, '\\.[^./]*$', '') || '.nfo' AS rel_path, CASE length(rel_path) % 5 WHEN 0 THEN 'generated' WHEN 1 THEN 'generated' ELSE 'handwritten' END AS state,
 length(rel_path) % 5 = 0 AS has_rating, length(rel_path) % 5 = 3 AS is_pin, CASE length(rel_path) % 5 WHEN 0 THEN 42 WHEN 3 THEN 77 END AS tmdb_id, CASE WHEN length(rel_path) % 5 < 2 THEN 'tt1234567' END AS imdb_id
FROM b_movies WHERE length(rel_path) % 5 < 4""")
def _(spark, sf):
    t = sidecar_texts(spark, sf).withColumn("n", enrich.nfo_state(F.col("text")))
    return t.select("root_id", "rel_path", "n.state", "n.has_rating", "n.is_pin", "n.tmdb_id", "n.imdb_id")


@query("t17_movie_tasks", """
SELECT root_id, rel_path, CASE WHEN length(rel_path) % 5 = 2 THEN false WHEN length(rel_path) % 5 = 0 THEN false ELSE true END AS write_nfo, length(rel_path) % 3 <> 0 AS write_poster
FROM (SELECT DISTINCT root_id, rel_path FROM b_movies) WHERE length(rel_path) % 5 NOT IN (0, 2) OR length(rel_path) % 3 <> 0""")
def _(spark, sf):
    m = view(spark, sf, "b_movies").select("root_id", "rel_path").distinct()
    posters = m.filter("length(rel_path) % 3 = 0").select("root_id", F.concat(F.regexp_replace("rel_path", r"\.[^./]*$", ""), F.lit("-poster.jpg")).alias("rel_path"))
    return enrich.movie_tasks(m, sidecar_texts(spark, sf), posters).select("root_id", "rel_path", "write_nfo", "write_poster")


@query("t17_series_plans", """
WITH t AS (SELECT o_orderkey AS k, o_custkey % 3 + 10 AS root_id, 'Show ' || (o_custkey % 200) AS series, year(o_orderdate)-1994 AS dir_season, o_orderkey % 2 = 0 AS has_nfo FROM orders)
SELECT lower(series) AS k_series, count(*) FILTER (WHERE NOT has_nfo) AS episodes, true AS write_show_nfo, true AS write_poster FROM t GROUP BY 1""")
def _(spark, sf):
    e = view(spark, sf, "b_episodes").select("file_id", "root_id", "rel_path")
    full = F.lit(f'<!-- {enrich.MARKER} --><plot>p</plot><aired/><rating>1.0</rating><uniqueid type="imdb">tt1234567</uniqueid>')
    texts = e.filter("file_id % 2 = 0").select("root_id", reconcile.sibling(F.col("rel_path"), "nfo").alias("rel_path"), full.alias("text"))
    none = texts.limit(0).select("root_id", "rel_path")
    plans = enrich.series_plans(enrich.episode_tasks(e, texts, none), texts, none)
    return plans.select("k_series", "episodes", "write_show_nfo", "write_poster")


@query("c10_enrichment_report", """
SELECT CASE length(rel_path) % 5 WHEN 2 THEN 'poster only' WHEN 0 THEN 'poster only' WHEN 3 THEN 'pinned' ELSE 'search' END AS work, count(*) AS n
FROM (SELECT DISTINCT root_id, rel_path FROM b_movies) WHERE length(rel_path) % 5 NOT IN (0, 2) OR length(rel_path) % 3 <> 0 GROUP BY 1""")
def _(spark, sf):
    m = view(spark, sf, "b_movies").select("root_id", "rel_path").distinct()
    posters = m.filter("length(rel_path) % 3 = 0").select("root_id", F.concat(F.regexp_replace("rel_path", r"\.[^./]*$", ""), F.lit("-poster.jpg")).alias("rel_path"))
    tasks = enrich.movie_tasks(m, sidecar_texts(spark, sf), posters)
    work = F.when(~F.col("write_nfo"), "poster only").when(F.col("pinned"), "pinned").otherwise("search")
    return tasks.groupBy(work.alias("work")).agg(F.count(F.lit(1)).alias("n"))


@query("j20_late_ratings", """
SELECT s_suppkey, '<movie>' || chr(10) || '  <plot>p</plot>' || chr(10) || '  <rating>' || printf('%.1f', s_suppkey % 100 / 10) || '</rating>' || chr(10) || '  <uniqueid type="imdb">tt' || (s_suppkey+1000000) || '</uniqueid>' || chr(10) || '</movie>' AS new_text
FROM supplier WHERE s_suppkey % 3 > 0 AND s_suppkey % 2 = 0""")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    rated = F.when(k % 3 == 0, "  <rating>1.0</rating>\n").otherwise("")
    imdb = F.concat(F.lit("tt"), (k + 1000000).cast("string"))
    rows = s.select(k, imdb.alias("imdb_id"), F.concat(F.lit("<movie>\n  <plot>p</plot>\n"), rated, F.lit('  <uniqueid type="imdb">'), imdb, F.lit("</uniqueid>\n</movie>")).alias("text"))
    return enrich.late_ratings(rows, ratings(spark, sf).filter("cast(substring(tconst, 3) as int) % 2 = 0")).select("s_suppkey", "new_text")


@query("s20_movie_sidecars", """
SELECT p_partkey, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' || chr(10) || '<!-- generated by shelf -->' || chr(10) || '<movie>' || chr(10) || '  <title>' || p_name || ' &amp; &lt;co&gt;</title>' || chr(10)
 || CASE WHEN p_partkey % 2 = 0 THEN '  <year>' || (1970+p_size) || '</year>' || chr(10) ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '  <rating>7.5</rating>' || chr(10) ELSE '' END
 || '  <genre>' || p_type || '</genre>' || chr(10) || '  <genre>' || p_brand || '</genre>' || chr(10) || '  <set></set>' || chr(10) || '  <uniqueid type="imdb">tt1</uniqueid>' || chr(10)
 || '  <uniqueid type="tmdb" default="true">' || p_partkey || '</uniqueid>' || chr(10) || '</movie>' || chr(10) AS nfo FROM part""")
def _(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    null = F.lit(None).cast("string")
    nfo = enrich.movie_nfo(
        F.concat("p_name", F.lit(" & <co>")), F.when(k % 2 == 0, F.col("p_size") + 1970), F.when(k % 3 == 0, 7.5), null, F.array("p_type", "p_brand"),
        F.array().cast("array<string>"), null, F.lit("tt1"), k,
    )
    return p.select("p_partkey", nfo.alias("nfo"))


@query("s20_episode_sidecars", """
SELECT file_id, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' || chr(10) || '<!-- generated by shelf -->' || chr(10) || '<episodedetails>' || chr(10) || '  <showtitle>' || series || '</showtitle>' || chr(10) || '  <season>' || season || '</season>' || chr(10)
 || '  <episode>' || episode || '</episode>' || chr(10) || '  <title>' || title || '</title>' || chr(10) || '  <aired>' || aired || '</aired>' || chr(10) || '  <plot></plot>' || chr(10) || CASE WHEN rating IS NULL THEN '' ELSE '  <rating>' || printf('%.1f', rating) || '</rating>' || chr(10) END
 || '  <uniqueid type="imdb"></uniqueid>' || chr(10) || '</episodedetails>' || chr(10) AS nfo FROM b_episodes""")
def _(spark, sf):
    e = view(spark, sf, "b_episodes")
    null = F.lit(None).cast("string")
    c = F.col
    return e.select("file_id", enrich.episode_nfo(c("series"), c("season"), c("episode"), c("title"), c("aired"), null, c("rating"), null).alias("nfo"))


@query("s20_show_sidecars", """
SELECT c_custkey, c_name || ' <&> "co"' AS title, 'in ' || c_mktsegment AS plot, CASE WHEN c_custkey % 3 > 0 THEN '2001-02-03' END AS premiered, CASE WHEN c_custkey % 2 = 0 THEN 7.5 END AS rating,
 CASE WHEN c_custkey % 5 > 0 THEN 'tt' || (1000000 + c_custkey) END AS imdb_id, CAST(c_custkey % 9 AS INT) AS season, c_name AS show_title FROM customer""")
def _(spark, sf):
    """Show and season sidecars written as text and read back."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    show = enrich.show_nfo(
        F.concat("c_name", F.lit(' <&> "co"')), F.concat(F.lit("in "), "c_mktsegment"), F.when(k % 2 == 0, 7.5), F.when(k % 5 > 0, F.concat(F.lit("tt"), (k + 1000000).cast("string"))),
        F.when(k % 3 > 0, "2001-02-03"),
    )
    season = enrich.season_nfo(F.col("c_name"), k % 9, F.lit("S"))
    shows = sidecars.read_nfo(c.select("c_custkey", show.alias("text"))).select("c_custkey", "title", "plot", "premiered", "rating", "imdb_id")
    seasons = sidecars.read_nfo(c.select("c_custkey", season.alias("text"))).select("c_custkey", "season", "show_title")
    return shows.join(seasons, "c_custkey")
