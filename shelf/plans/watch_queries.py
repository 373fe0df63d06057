"""Watch history over the bridge events."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelf.functions import formats
from shelf.operators import watch
from shelf.plans.browse_queries import episodes
from shelf.plans.registry import query
from shelf.plans.tree_queries import any_items
from shelf.sources.bridge import view


def log(spark, sf):
    """Watch events with millisecond positions."""
    w = view(spark, sf, "b_watch")
    return w.select(
        "event_id", "ts", "profile_id", "key", "file_id", "event", F.floor(F.col("position_s") * 1000).cast("long").alias("position_ms"),
        F.floor(F.col("duration_s") * 1000).cast("long").alias("duration_ms"), "seen",
    )


# the fold as windows; {scope} is what a dismissal covers
FOLD = """
WITH e0 AS (SELECT event_id, ts, profile_id AS p, key, file_id, CAST(floor(position_s*1000) AS BIGINT) AS pos, CAST(floor(duration_s*1000) AS BIGINT) AS du, seen, event FROM b_watch),
e1 AS (SELECT *, CASE WHEN event='position' AND du>0 AND pos>=0.95*du THEN 'ended' ELSE event END AS e FROM e0 WHERE event <> 'dismiss'),
e2 AS (SELECT *, coalesce(last_value(CASE e WHEN 'ended' THEN 1 WHEN 'seen' THEN CAST(seen AS INT) END IGNORE NULLS) OVER (PARTITION BY p,key ORDER BY ts,event_id ROWS UNBOUNDED PRECEDING),0) AS w FROM e1),
e3 AS (SELECT *, coalesce(sum(CASE WHEN e='forget' AND w=0 THEN 1 ELSE 0 END) OVER (PARTITION BY p,key ORDER BY ts,event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS g FROM e2),
d AS (SELECT p, {scope} AS s, max((ts, event_id)) AS at FROM e0 WHERE event='dismiss' GROUP BY 1, 2),
fin AS (SELECT p, key, g, arg_max(CASE WHEN e='position' THEN pos ELSE 0 END, (ts,event_id)) AS pos,
  arg_max(du,(ts,event_id)) FILTER (WHERE e IN ('position','ended') AND du IS NOT NULL) AS du, arg_max(w,(ts,event_id)) AS w,
  max(ts) AS u, arg_max(file_id,(ts,event_id)) FILTER (WHERE e<>'forget') AS f, max((ts,event_id)) FILTER (WHERE e<>'forget') AS rep,
  max(CASE WHEN e='forget' AND w=0 THEN 1 ELSE 0 END) AS gone FROM e3 GROUP BY p,key,g),
st AS (SELECT fin.p AS profile_id, key, f AS file_id, CASE WHEN d.at > rep THEN 0 ELSE pos END AS position_ms, du AS duration_ms, w=1 AS watched, u AS updated_at, coalesce(d.at > rep, false) AS dismissed
  FROM fin LEFT JOIN d ON d.p=fin.p AND d.s={fscope} WHERE gone=0 AND rep IS NOT NULL)
"""
SERIES_SCOPE = r"CASE WHEN starts_with({k}, 'tv|') THEN regexp_replace({k}, '\|[^|]*\|[^|]*$', '|') ELSE {k} END"


def fold_sql(series_wide: bool = True) -> str:
    if series_wide:
        return FOLD.format(scope=SERIES_SCOPE.format(k="key"), fscope=SERIES_SCOPE.format(k="fin.key"))
    return FOLD.format(scope="key", fscope="fin.key")


@query("r5_watch_fold", fold_sql(False) + "SELECT * FROM st")
def _(spark, sf):
    return watch.fold(log(spark, sf), series_wide=False)


@query("r5_watch_fold_series", fold_sql() + "SELECT * FROM st")
def _(spark, sf):
    return watch.fold(log(spark, sf))


@query("l6_recent_states", fold_sql() + "SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY updated_at DESC, dismissed, key) AS pos FROM st QUALIFY pos <= 5")
def _(spark, sf):
    return watch.recent_states(watch.fold(log(spark, sf)), 5)


@query("c12_resume", fold_sql() + "SELECT profile_id, key, position_ms // 1000 AS resume_s FROM st WHERE position_ms > 9000")
def _(spark, sf):
    return watch.resume_seconds(watch.fold(log(spark, sf)))


NOW = "1706745600"


@query("t10_watch_notes", fold_sql() + f"""
, n AS (SELECT *, CAST(floor(epoch(updated_at)) AS BIGINT) AS at, {NOW} - CAST(floor(epoch(updated_at)) AS BIGINT) AS gap FROM st),
c AS (SELECT *, CASE WHEN duration_ms > position_ms THEN (duration_ms-position_ms)//1000 ELSE position_ms//1000 END AS s FROM n),
t AS (SELECT *, CASE WHEN s >= 3600 THEN (s//3600) || ':' || lpad(((s%3600)//60)::VARCHAR,2,'0') || ':' || lpad((s%60)::VARCHAR,2,'0') ELSE (s//60) || ':' || lpad((s%60)::VARCHAR,2,'0') END AS clock,
 CASE WHEN gap < 90 THEN 'just now' WHEN gap < 3600 THEN (gap//60) || ' min ago' WHEN gap < 86400 THEN (gap//3600) || ' h ago' WHEN gap < 172800 THEN 'yesterday' WHEN gap < 2592000 THEN (gap//86400) || ' days ago' ELSE strftime(updated_at, '%Y-%m-%d') END AS ago FROM c)
SELECT profile_id, key, CASE WHEN position_ms > 0 THEN CASE WHEN duration_ms > position_ms THEN clock || ' left' ELSE 'at ' || clock END || ' · ' || ago WHEN watched THEN 'watched ' || ago ELSE '' END AS note FROM t""")
def _(spark, sf):
    st = watch.fold(log(spark, sf))
    at = F.unix_timestamp(F.col("updated_at").cast("timestamp"))
    note = formats.watch_note(F.col("position_ms"), F.col("duration_ms"), F.col("watched"), at, F.lit(int(NOW)))
    return st.select("profile_id", "key", note.alias("note"))


# shows whose keys meet the bridge's watch keys
SHOWS = """
sh AS (SELECT 'show ' || CAST(prog // 10 AS VARCHAR) AS k_series, prog % 10 + 1 AS episode, prog AS file_id, 'Part ' || CAST(prog AS VARCHAR) AS title, row_number() OVER (PARTITION BY prog // 10 ORDER BY prog) AS idx
 FROM (SELECT DISTINCT file_id AS prog FROM b_watch)),
keyed AS (SELECT *, 'tv|' || k_series || '|1|' || episode AS key FROM sh)"""


def shows(spark, sf):
    """Episodes the watch events refer to."""
    prog = view(spark, sf, "b_watch").select(F.col("file_id").alias("prog")).distinct()
    series = F.concat(F.lit("show "), F.floor(F.col("prog") / 10).cast("string"))
    return prog.select(
        series.alias("k_series"), series.alias("series"), F.lit(1).alias("season"), (F.col("prog") % 10 + 1).alias("episode"),
        F.concat(F.lit("Part "), F.col("prog").cast("string")).alias("title"), F.col("prog").alias("file_id"),
    )


UP_NEXT = SHOWS + """,
seen AS (SELECT st.*, keyed.k_series, keyed.idx FROM st JOIN keyed USING (key)),
latest AS (SELECT profile_id, k_series, arg_max(idx, (updated_at, idx)) AS li, arg_max(position_ms, (updated_at, idx)) > 0 AS part_way FROM seen GROUP BY 1, 2),
un AS (SELECT l.profile_id, l.k_series, l.part_way, min(k.idx) AS idx FROM latest l JOIN keyed k ON k.k_series=l.k_series
  LEFT JOIN seen s ON s.profile_id=l.profile_id AND s.key=k.key
  WHERE (l.part_way AND k.idx=l.li) OR (NOT l.part_way AND k.idx > l.li AND NOT coalesce(s.watched, false)) GROUP BY 1, 2, 3)"""


@query("w2_up_next", fold_sql() + "," + UP_NEXT + "SELECT un.profile_id, un.k_series, un.part_way, keyed.file_id FROM un JOIN keyed ON keyed.k_series=un.k_series AND keyed.idx=un.idx")
def _(spark, sf):
    picked = watch.up_next(watch.fold(log(spark, sf)), watch.episode_places(shows(spark, sf)))
    return picked.select("profile_id", "k_series", "part_way", "file_id")


@query("w10_continue_watching", fold_sql() + "," + UP_NEXT + """,
rec AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY updated_at DESC, dismissed, key) AS pos FROM st QUALIFY pos <= 96),
dec AS (SELECT rec.*, sh.k_series FROM rec JOIN sh ON sh.file_id=rec.file_id QUALIFY row_number() OVER (PARTITION BY profile_id, sh.k_series ORDER BY pos) = 1)
SELECT dec.profile_id, keyed.file_id, keyed.title, CASE WHEN un.part_way THEN 'resume' ELSE 'next' END AS why,
 row_number() OVER (PARTITION BY dec.profile_id ORDER BY pos) AS place
FROM dec JOIN un ON un.profile_id=dec.profile_id AND un.k_series=dec.k_series JOIN keyed ON keyed.k_series=un.k_series AND keyed.idx=un.idx
WHERE NOT dec.dismissed QUALIFY place <= 12""")
def _(spark, sf):
    s = shows(spark, sf)
    st = watch.fold(log(spark, sf))
    return watch.continue_watching(st, s.withColumn("kind", F.lit("tv")), watch.episode_places(s))


@query("j24_listing_states", fold_sql() + """
SELECT e.file_id, st.position_ms, st.watched FROM b_episodes e LEFT JOIN st ON st.profile_id=7
 AND st.key = 'tv|' || lower(trim(e.series)) || '|' || e.season || '|' || e.episode WHERE e.status='ready'""")
def _(spark, sf):
    e = episodes(spark, sf).withColumn("kind", F.lit("tv")).withColumn("year", F.lit(None).cast("int"))
    return watch.with_states(e, watch.fold(log(spark, sf)), 7).select("file_id", "position_ms", "watched")


@query("t9_program_keys", """
SELECT file_id, CASE WHEN episode > 0 THEN 'tv|' || lower(trim(series)) || '|' || season || '|' || episode ELSE 'f|' || file_id END AS key FROM b_episodes WHERE status='ready'
UNION ALL SELECT file_id, 'mv|' || lower(trim(title)) || '|' || coalesce(CAST(year AS VARCHAR), '') FROM b_movies WHERE status='ready'
UNION ALL SELECT -file_id, NULL FROM b_tracks WHERE status='ready'""")
def _(spark, sf):
    from shelf.functions.keys import program_key

    got = any_items(spark, sf)
    key = program_key(*[F.col(c) for c in ("kind", "file_id", "series", "season", "episode", "title", "year")])
    return got.select("file_id", key.alias("key"))


def posts(spark, sf):
    """Raw posts built from the events, some of them malformed."""
    from shelf.sources.bridge import table

    e = table(spark, sf, "events")
    where = F.get(F.array(*[F.lit(x) for x in ("watch", "seen", "forget", "dismiss", "watch")]), (F.col("event_id") % 5).cast("int"))
    body = (
        F.when(F.col("event_id") % 11 == 0, F.lit("{not json"))
        .when(where == "seen", F.format_string('{"id": %d, "seen": %s}', F.col("user_id") * 10, F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")))
        .when(where == "watch", F.format_string('{"id": %d, "event": "%s", "position": %d, "duration": %d}', F.col("user_id") * 10, F.when(F.col("event_id") % 3 == 0, "ended").otherwise("tick"), (F.col("event_id") % 997) - 5, F.col("event_id") % 13 * 100))
        .otherwise(F.format_string('{"id": %d}', F.col("user_id") * 10))
    )
    return e.select("event_id", "ts", F.col("user_id").alias("profile_id"), where.alias("endpoint"), body.alias("body"))


@query("r6_valid_reports", """
WITH r AS (SELECT *, ['watch','seen','forget','dismiss','watch'][event_id % 5 + 1] AS endpoint, user_id*10 AS id FROM events WHERE event_id % 11 <> 0)
SELECT r.event_id, r.user_id AS profile_id, 'tv|' || lower(trim(e.series)) || '|' || e.season || '|' || e.episode AS key, e.file_id,
 CASE WHEN endpoint='watch' THEN CASE WHEN r.event_id % 3=0 THEN 'ended' ELSE 'position' END ELSE endpoint END AS event,
 CASE WHEN endpoint='watch' THEN (r.event_id % 997 - 5)*1000 END AS position_ms,
 CASE WHEN endpoint='watch' THEN CASE WHEN r.event_id % 13 > 0 THEN r.event_id % 13 * 100000 ELSE e.duration_ms END END AS duration_ms,
 CASE WHEN endpoint='seen' THEN r.event_id % 2 = 0 END AS seen
FROM r JOIN b_episodes e ON e.file_id=r.id WHERE e.status='ready' AND (endpoint <> 'watch' OR r.event_id % 997 - 5 >= 0)""")
def _(spark, sf):
    e = episodes(spark, sf).withColumn("kind", F.lit("tv")).withColumn("year", F.lit(None).cast("int"))
    return watch.valid_reports(posts(spark, sf), e).drop("ts")
