"""Streaming rules: batch forms checked by SQL, and the streams themselves run over the bridge events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelf.plans.registry import query
from shelf.plans.watch_queries import fold_sql
from shelf.session import checkpoint_dir
from shelf.sources import catalog
from shelf.sources.bridge import table, view
from shelf.streaming import arrivals, watch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_events(spark, sf):
    """File events: a path per user and event type, seldom gone."""
    e = table(spark, sf, "events")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("/", (F.col("user_id") % 50).cast("string"), "event_type").alias("path"),
        F.floor(F.col("value") / 100).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), F.when(F.col("event_id") % 17 == 0, "gone").otherwise("seen").alias("kind"),
    )


EVENTS = """
ev AS (SELECT event_id, ts, (user_id % 50) || '/' || event_type AS path, CAST(floor(value/100) AS BIGINT) AS size, CASE WHEN event_id % 17 = 0 THEN 'gone' ELSE 'seen' END AS kind FROM events)"""


@query("r1_settled", "WITH " + EVENTS + """,
c AS (SELECT *, lag(struct_pack(a := size, b := kind)) OVER (PARTITION BY path ORDER BY ts, event_id) AS p FROM ev),
s AS (SELECT *, lead(ts) OVER (PARTITION BY path ORDER BY ts, event_id) AS nx FROM c WHERE p IS DISTINCT FROM struct_pack(a := size, b := kind))
SELECT path, size, CAST(epoch_us(ts + INTERVAL 30 SECOND) AS BIGINT) AS due_us FROM s WHERE kind = 'seen' AND ts + INTERVAL 30 SECOND <= coalesce(nx, TIMESTAMP '2100-01-01')""")
def _(spark, sf):
    until = F.lit("2100-01-01").cast("timestamp")
    return arrivals.settle_batch(file_events(spark, sf), until).select("path", "size", F.unix_micros("due_at").alias("due_us"))


@query("r2_retries", """
WITH l AS (SELECT event_id, ts, (user_id % 50) || '/' || event_type AS path, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS done FROM events),
e AS (SELECT *, coalesce(sum(done) OVER (PARTITION BY path ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS era FROM l)
SELECT event_id, attempt, CASE WHEN attempt <= 5 THEN CAST(least(30*2**attempt, 300) AS BIGINT) END AS delay_s FROM (
 SELECT event_id, row_number() OVER (PARTITION BY path, era ORDER BY ts, event_id) AS attempt FROM e WHERE done = 0)""")
def _(spark, sf):
    log = file_events(spark, sf).withColumn("kind", F.when(F.col("kind") == "gone", "done").otherwise("failed"))
    return arrivals.retry_schedule(log).select("event_id", "attempt", "delay_s")


BURSTS = """
b AS (SELECT CAST(user_id % 5 AS VARCHAR) AS library, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 60 SECOND THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id % 5 ORDER BY ts, event_id)),
g AS (SELECT *, sum(n) OVER (PARTITION BY library ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b),
se AS (SELECT library, min(ts) AS begin_at, max(ts) + INTERVAL 60 SECOND AS quiet_at, count(*) AS arrivals FROM g GROUP BY library, s)"""


def arrivals_of(spark, sf):
    return table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).cast("string").alias("library"))


@query("r3_bursts", "WITH " + BURSTS + "SELECT library, CAST(epoch_us(begin_at) AS BIGINT) AS begin_us, CAST(epoch_us(quiet_at) AS BIGINT) AS quiet_us, arrivals FROM se")
def _(spark, sf):
    return arrivals.bursts(arrivals_of(spark, sf)).select("library", F.unix_micros("begin_at").alias("begin_us"), F.unix_micros("quiet_at").alias("quiet_us"), "arrivals")


@query("r3_burst_runs", "WITH RECURSIVE " + BURSTS + """,
k AS (SELECT library, epoch_us(begin_at) AS b, epoch_us(quiet_at) AS q, row_number() OVER (PARTITION BY library ORDER BY begin_at) AS k FROM se),
w AS (SELECT library, k, CAST(NULL AS BIGINT) AS fired, CAST(NULL AS BIGINT) AS run, q AS due FROM k WHERE k = 1
 UNION ALL SELECT n.library, n.k, CASE WHEN w.due <= n.b THEN w.due END, CASE WHEN w.due <= n.b THEN w.due ELSE w.run END,
  greatest(n.q, coalesce(CASE WHEN w.due <= n.b THEN w.due ELSE w.run END + 600000000, n.q)) FROM w JOIN k n ON n.library = w.library AND n.k = w.k + 1)
SELECT library, CAST(fired AS BIGINT) AS run_us FROM w WHERE fired IS NOT NULL UNION ALL SELECT library, CAST(arg_max(due, k) AS BIGINT) FROM w GROUP BY library""")
def _(spark, sf):
    return arrivals.burst_runs(arrivals.bursts(arrivals_of(spark, sf))).select("library", F.unix_micros("run_at").alias("run_us"))


def catalog_events(spark, sf):
    """The walked snapshot as a batch of events, with some catalogued paths reported gone."""
    w = view(spark, sf, "b_walk")
    n = F.length("rel_path")
    present = w.select(
        F.timestamp_seconds(F.lit(0)).alias("ts"), n.alias("event_id"), "root_id", "rel_path", "size", "mtime",
        F.lit("movies").alias("kind"), F.lit("video/x-matroska").alias("mime"), F.lit(True).alias("present"),
    )
    k = view(spark, sf, "b_known").filter("length(rel_path) % 9 = 0")
    gone = k.select(
        F.timestamp_seconds(F.lit(5)).alias("ts"), n.alias("event_id"), "root_id", "rel_path", "size", "mtime", F.lit("movies").alias("kind"),
        F.lit("video/x-matroska").alias("mime"), F.lit(False).alias("present"),
    )
    return present.unionByName(gone)


R4 = """
WITH e AS (SELECT coalesce(w.root_id, k.root_id) AS root_id, coalesce(w.rel_path, k.rel_path) AS rel_path, k.mtime AS k_at, k.rel_path IS NOT NULL AND length(k.rel_path) % 9 = 0 AS gone, w.rel_path IS NOT NULL AS there,
 k.rel_path IS NOT NULL AND w.rel_path IS NOT NULL AND k.size = w.size AND k.mtime = w.mtime AS same, coalesce(w.size, k.size) AS size FROM b_known k FULL JOIN b_walk w ON w.root_id=k.root_id AND w.rel_path=k.rel_path),
st AS (SELECT root_id, regexp_replace(rel_path, '\\.[^./]*$', '') AS s, min(mtime) AS m FROM b_known GROUP BY 1, 2)
SELECT e.root_id, e.rel_path, CASE WHEN there AND NOT same THEN 'pending' ELSE 'ready' END AS status, e.size, CAST(CASE WHEN k_at IS NULL THEN least(20990101, coalesce(st.m, 20990101)) ELSE k_at END AS BIGINT) AS added_at
FROM e LEFT JOIN st ON st.root_id=e.root_id AND st.s=regexp_replace(e.rel_path, '\\.[^./]*$', '') WHERE NOT gone"""


@query("r4_applied_events", R4)
def _(spark, sf):
    from shelf.plans.ingest_queries import known

    files = known(spark, sf).withColumn("status", F.lit("ready"))
    return arrivals.apply_events(files, catalog_events(spark, sf), F.lit(20990101)).select("root_id", "rel_path", "status", "size", "added_at")


@query("r4_stream", R4)
def _(spark, sf):
    """The same events as a stream on a catalog that other commits have brought to its third version."""
    from shelf.plans.ingest_queries import known

    base = f"{checkpoint_dir(spark)}/catalog-{uuid.uuid4().hex}"
    catalog.write_snapshot(spark, base, {"files": known(spark, sf).withColumn("status", F.lit("ready"))})
    for _ in range(2):
        catalog.write_snapshot(spark, base, {"genres": spark.createDataFrame([(1, "Drama")], "id long, name string")})
    events = catalog_events(spark, sf)
    events.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
    sink = arrivals.catalog_sink(base, F.lit(20990101))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return catalog.read_table(spark, base, "files").select("root_id", "rel_path", "status", "size", "added_at")


@query("s17_snapshot", """
SELECT 'roots' AS name, count(*) AS n, CAST(sum(root_id) AS BIGINT) AS ids FROM b_roots UNION ALL SELECT 'files', count(*), CAST(sum(root_id) AS BIGINT) FROM b_known
UNION ALL SELECT 'genres', count(*), CAST(sum(root_id) AS BIGINT) FROM b_roots UNION ALL SELECT 'watch', 0, NULL""")
def _(spark, sf):
    """Two commits, the second of one table alone; every table is read back from the newest version."""
    from shelf.plans.ingest_queries import known

    base = f"{checkpoint_dir(spark)}/catalog-{uuid.uuid4().hex}"
    roots = view(spark, sf, "b_roots")
    catalog.write_snapshot(spark, base, {"roots": roots, "files": known(spark, sf)})
    catalog.write_snapshot(spark, base, {"genres": roots.select(F.col("root_id").alias("id"), F.lit("g").alias("name"))})
    ids = {"roots": "root_id", "files": "root_id", "genres": "id", "watch": "file_id"}
    counts = [
        catalog.read_table(spark, base, name).agg(F.count(F.lit(1)).alias("n"), F.sum(column).alias("ids")).select(F.lit(name).alias("name"), "n", "ids")
        for name, column in ids.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("r7_distinct_events", "SELECT DISTINCT CAST(date_trunc('hour', ts) AS VARCHAR)[1:13] AS batch, (user_id % 50) || '/' || event_type AS path FROM events WHERE event_type <> 'view'")
def _(spark, sf):
    e = table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH").alias("batch"), F.concat_ws("/", (F.col("user_id") % 50).cast("string"), "event_type").alias("path"),
        F.when(F.col("event_type") == "view", "access").otherwise("change").alias("kind"),
    )
    return arrivals.distinct_events(e).select("batch", "path")


def run_to_end(spark, stream, sink):
    """Run a stream over what is there now and wait for it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.foreachBatch(sink(f"{base}/out")).option("checkpointLocation", f"{base}/state").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{base}/out"


def event_stream(spark, sf):
    """The events table read as a stream of watch events."""
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    raw.createOrReplaceTempView("stream_events")
    from shelf.sources.bridge import VIEWS

    w = spark.sql(VIEWS["b_watch"].replace("FROM events)", "FROM stream_events)"))
    return w.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "profile_id", "key", F.col("file_id").cast("long").alias("file_id"), "event",
        F.floor(F.col("position_s") * 1000).cast("long").alias("position_ms"), F.floor(F.col("duration_s") * 1000).cast("long").alias("duration_ms"), "seen",
    )


@query("r5_watch_stream", fold_sql() + "SELECT profile_id, key, file_id, position_ms, duration_ms, watched, CAST(epoch_us(updated_at) AS BIGINT) AS updated_us, dismissed FROM st")
def _(spark, sf):
    out = run_to_end(spark, watch.fold_stream(event_stream(spark, sf)), watch.change_sink)
    states = watch.latest_states(spark.read.parquet(f"{out}/batch=*"))
    return states.select("profile_id", "key", "file_id", "position_ms", "duration_ms", "watched", F.unix_micros("updated_at").alias("updated_us"), "dismissed")


@query("r8_latest_states", fold_sql() + "SELECT profile_id, count(*) AS programs, count(*) FILTER (WHERE watched) AS seen FROM st GROUP BY 1")
def _(spark, sf):
    out = run_to_end(spark, watch.fold_stream(event_stream(spark, sf)), watch.change_sink)
    newest = watch.latest_states(spark.read.parquet(f"{out}/batch=*"))
    return newest.groupBy("profile_id").agg(F.count(F.lit(1)).alias("programs"), F.count_if("watched").alias("seen"))
