"""Views that give the driver's tables the shape of a media catalog.

The same SQL text runs on Spark and on DuckDB (as a CTE prefix), so both sides of a
check read the same rows. Only b_prints is spelled once per engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

#: Tables with enough rows for more than one task.
SPREAD = ("lineitem", "orders", "events", "documents", "pages", "conversations", "embeddings")

FILE_KEY = "((l.l_orderkey*10+l.l_linenumber)*100000+l.l_partkey)*10000+l.l_suppkey"

VIEWS: dict[str, str] = {
    "b_movies": f"""
SELECT {FILE_KEY} AS file_id,
  l.l_suppkey % 5 AS root_id,
  p.p_type || '/' || p.p_brand || '/' || p.p_name || '.' || CAST(1970+p.p_size AS STRING) || '.v' || CAST(l.l_linenumber AS STRING) || '.mkv' AS rel_path,
  CAST(round(l.l_extendedprice*100) AS BIGINT) AS size,
  year(l.l_shipdate)*10000+month(l.l_shipdate)*100+day(l.l_shipdate) AS added_at,
  CASE l.l_linestatus WHEN 'F' THEN 'ready' ELSE 'pending' END AS status,
  CASE WHEN l.l_linenumber=5 THEN NULL WHEN l.l_quantity>=40 THEN 3840 WHEN l.l_quantity>=20 THEN 1920 ELSE 1280 END AS width,
  CASE WHEN l.l_linenumber=5 THEN NULL WHEN l.l_quantity>=40 THEN 2160 WHEN l.l_quantity>=20 THEN 1080 ELSE 720 END AS height,
  CASE WHEN l.l_linenumber % 2=0 THEN 'poster.jpg' END AS art,
  CASE WHEN p.p_partkey % 2=0 THEN upper(p.p_name) ELSE p.p_name END AS title,
  CASE WHEN p.p_size=50 THEN NULL ELSE 1970+p.p_size END AS year,
  CASE WHEN p.p_partkey % 7=0 THEN NULL ELSE CAST((p.p_partkey*37) % 101 AS DOUBLE)/10 END AS rating,
  CASE WHEN p.p_partkey % 3=0 THEN p.p_brand END AS collection,
  p.p_type AS genre, s.s_name AS director,
  'video/x-matroska' AS mime, (l.l_partkey*7919) % 9000000 + 60000 AS duration_ms,
  'Plot of ' || p.p_name AS plot
FROM lineitem l JOIN part p ON p.p_partkey=l.l_partkey JOIN supplier s ON s.s_suppkey=l.l_suppkey""",
    "b_episodes": """
SELECT o_orderkey AS file_id, o_custkey % 3 + 10 AS root_id,
  CASE WHEN o_orderkey % 2=0 THEN 'Show ' ELSE 'SHOW ' END || CAST(o_custkey % 200 AS STRING) AS series,
  year(o_orderdate)-1994 AS season, month(o_orderdate) AS episode, o_orderpriority AS title,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS aired,
  CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE 'ready' END AS status,
  CAST(round(o_totalprice*100) AS BIGINT) AS size,
  CASE WHEN o_orderkey % 11=0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE)/10 END AS rating,
  'Show ' || CAST(o_custkey % 200 AS STRING) || '/Season ' || CAST(year(o_orderdate)-1994 AS STRING) || '/Show.'
    || CAST(o_custkey % 200 AS STRING) || '.S0' || CAST(abs(year(o_orderdate)-1994) AS STRING) || 'E' || CAST(10+month(o_orderdate) AS STRING)
    || '.' || o_orderpriority || '.1080p.WEB-DL.' || CAST(o_orderkey AS STRING) || '.mkv' AS rel_path,
  CASE WHEN o_custkey % 4=0 THEN 3840 ELSE 1920 END AS width, CASE WHEN o_custkey % 4=0 THEN 2160 ELSE 1080 END AS height,
  CASE WHEN o_orderkey % 3=0 THEN 'season.jpg' END AS art, 'video/mp4' AS mime,
  CAST(o_orderkey % 4000 AS BIGINT)*1000 + 600000 AS duration_ms,
  year(o_orderdate)*10000+month(o_orderdate)*100+day(o_orderdate) AS added_at,
  'Plot ' || o_orderpriority AS plot
FROM orders""",
    "b_tracks": f"""
SELECT {FILE_KEY} AS file_id, 20 AS root_id,
  p.p_name AS title, s.s_name AS artist, CASE WHEN s.s_suppkey % 4=0 THEN n.n_name END AS album_artist,
  CASE WHEN l.l_partkey % 10=0 THEN NULL ELSE p.p_brand END AS album,
  l.l_partkey % 2 + 1 AS disc_no, l.l_linenumber AS track_no,
  CASE l.l_returnflag WHEN 'R' THEN 'pending' ELSE 'ready' END AS status,
  CASE WHEN l.l_partkey % 6=0 THEN NULL ELSE p.p_type END AS genre,
  s.s_name || '/' || p.p_brand || '/' || CAST(10+l.l_linenumber AS STRING) || ' - ' || p.p_name || '.' || CAST(l.l_orderkey AS STRING) || '.flac' AS rel_path,
  CAST(round(l.l_extendedprice*10) AS BIGINT) AS size, 'audio/flac' AS mime, (l.l_partkey*613) % 400000 + 30000 AS duration_ms,
  CASE WHEN l.l_linenumber % 3=0 THEN 'embedded' END AS art,
  year(l.l_shipdate)*10000+month(l.l_shipdate)*100+day(l.l_shipdate) AS added_at, 1990 + p.p_size % 30 AS year
FROM lineitem l JOIN part p ON p.p_partkey=l.l_partkey JOIN supplier s ON s.s_suppkey=l.l_suppkey JOIN nation n ON n.n_nationkey=s.s_nationkey""",
    "b_watch": """
SELECT event_id, ts, profile_id, 'tv|show ' || CAST(CAST(floor(prog/10) AS INT) AS STRING) || '|1|' || CAST(prog % 10 + 1 AS STRING) AS key,
  prog AS file_id, event, position_s, CAST(150 AS DOUBLE) AS duration_s, CASE WHEN event='seen' THEN event_id % 3 <> 0 END AS seen
FROM (SELECT event_id, ts, user_id AS profile_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS prog,
  CASE event_type WHEN 'view' THEN 'position' WHEN 'purchase' THEN 'ended' WHEN 'click' THEN 'seen' WHEN 'error' THEN 'forget' ELSE 'dismiss' END AS event,
  value AS position_s FROM events) e""",
    "b_cues": """
SELECT conv_id AS media_id, turn AS cue_no, CAST(turn*10 AS DOUBLE) AS start_s,
  CAST(turn*10 AS DOUBLE) + least(CAST(10 AS DOUBLE), 1 + CAST(length(text) AS DOUBLE)/100) AS end_s, text FROM conversations""",
    "b_speech": """
SELECT conv_id AS media_id, role AS speaker, CAST(turn*10 AS DOUBLE) + 3 AS start_s, CAST(turn*10 AS DOUBLE) + 12 AS end_s,
  CASE WHEN turn % 3=0 THEN NULL ELSE CAST(8 + conv_id % 3 AS DOUBLE)/10 END AS confidence FROM conversations""",
    "b_levels": f"""
SELECT {FILE_KEY} AS file_id, l.l_quantity/2 - 40 AS integrated, CAST(-1 AS DOUBLE) - l.l_discount*200 AS true_peak,
  l.l_linenumber AS channels FROM lineitem l""",
    "b_known": """
SELECT root_id, rel_path, min(size) AS size, max(added_at) AS mtime FROM b_movies WHERE file_id % 10 <> 0 GROUP BY root_id, rel_path""",
    "b_walk": """
SELECT root_id, rel_path, min(size) + CASE WHEN length(rel_path) % 10=0 THEN 1 ELSE 0 END AS size, max(added_at) AS mtime
FROM b_movies WHERE file_id % 10 <> 1 GROUP BY root_id, rel_path""",
    "b_roots": """
SELECT CAST(n_nationkey AS INT) AS root_id,
  CASE WHEN n_nationkey < 10 THEN 'movies' WHEN n_nationkey < 20 THEN 'tv' ELSE 'music' END AS kind,
  '/vol' || CAST(n_nationkey AS STRING) || '/' || CASE WHEN n_nationkey < 10 THEN 'Movies' WHEN n_nationkey < 20 THEN 'TV' ELSE 'Music' END
    || CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE CAST(n_nationkey AS STRING) END AS path
FROM nation""",
    "b_tv_series": """
SELECT 'show ' || CAST(s_suppkey % 200 AS STRING) AS name, max(s_name) AS plot, CAST(max(s_suppkey) % 100 AS DOUBLE)/10 AS rating,
  'tt' || CAST(1000000 + max(s_suppkey) AS STRING) AS imdb_id,
  CASE WHEN max(s_suppkey) % 3=0 THEN NULL WHEN max(s_suppkey) % 3=1 THEN CAST(1700 + max(s_suppkey) % 400 AS STRING) ELSE CAST(1990 + max(s_suppkey) % 20 AS STRING) || '-05-06' END AS premiered
FROM supplier GROUP BY s_suppkey % 200""",
    "b_tv_seasons": """
SELECT 'SHOW ' || CAST(p_partkey % 200 AS STRING) AS series, p_size % 5 AS season, max(p_name) AS plot
FROM part GROUP BY p_partkey % 200, p_size % 5""",
    "b_files": """
SELECT file_id, root_id, 'movies' AS kind, rel_path, mime, size, duration_ms, width, height, art, added_at, added_at + 1 AS updated_at, status FROM b_movies
UNION ALL SELECT file_id, root_id, 'tv', rel_path, mime, size, duration_ms, width, height, art, added_at, added_at + 1, status FROM b_episodes
UNION ALL SELECT -file_id, root_id, 'music', rel_path, mime, size, duration_ms, NULL, NULL, art, added_at, added_at + 1, status FROM b_tracks""",
}

SPARK_ONLY = {
    "b_prints": """
SELECT source || '/' || substring_index(text,' ',1) AS season, doc_id AS episode, pos, CAST(conv(substr(md5(w),1,8),16,10) AS BIGINT) AS item
FROM (SELECT source, doc_id, text, posexplode(split(text,' ')) AS (pos, w) FROM documents)"""
}
DUCK_ONLY = {
    "b_prints": """
SELECT source || '/' || ws[1] AS season, doc_id AS episode, CAST(i-1 AS INT) AS pos, ('0x'||substr(md5(ws[i]),1,8))::BIGINT AS item
FROM (SELECT source, doc_id, ws, unnest(range(1,len(ws)+1)) AS i FROM (SELECT source, doc_id, string_split(text,' ') AS ws FROM documents))"""
}
NAMES = [*VIEWS, *SPARK_ONLY]


def _needed(sql: str, texts: dict[str, str]) -> list[str]:
    """View names a query uses, dependencies first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in NAMES:
            if name not in out and re.search(rf"\b{name}\b", text):
                visit(texts[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def duck(sql: str) -> str:
    """A DuckDB query with the bridge views it uses in front of it."""
    texts = {**VIEWS, **DUCK_ONLY}
    names = _needed(sql, texts)
    if not names:
        return sql
    prefix = ",\n".join(f"{n} AS ({texts[n].strip()})" for n in names)
    body = sql.strip()
    if body[:5].lower() == "with ":
        return f"WITH {prefix},\n{body[5:]}"
    return f"WITH {prefix}\n{body}"


_FEW: dict[tuple[str, str], bool] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; a table of fewer pieces than there are cores (one file, one row group) is dealt over all of them before any work."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    known = (spark.sparkContext.applicationId, path)
    if known not in _FEW:
        _FEW[known] = name in SPREAD and df.rdd.getNumPartitions() < cores
    return df.repartition(cores) if _FEW[known] else df


def tasks_for(spark: SparkSession, sf_dir: str, name: str, each: int = 16) -> int:
    """Into how many tasks a whole table is dealt to be sorted: ``each`` for every piece it is read in, so that a task's share stays the same as the table grows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), each * spark.read.parquet(f"{sf_dir}/{name}.parquet").rdd.getNumPartitions())


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One bridge view as a frame."""
    texts = {**VIEWS, **SPARK_ONLY}
    sql = texts[name]
    names = _needed(sql, texts)
    text = sql if not names else (
        "WITH " + ",\n".join(f"{n} AS ({texts[n]})" for n in names) + "\n" + sql.strip()
    )
    for base in BASE_TABLES:
        if re.search(rf"\b{base}\b", text):
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(text)
