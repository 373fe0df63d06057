"""Frame order over pictures made of the bridge line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelf.operators import frames
from shelf.plans.registry import query
from shelf.sources.bridge import table, tasks_for

LOG2_MAX = 4


def pictures(spark, sf):
    """Pictures of each supplier's line items in key order; about one in sixteen starts a sequence."""
    # dealt by supplier at once, in as many tasks as the table has pieces, for the sums and the windows over them
    l = table(spark, sf, "lineitem").repartition(tasks_for(spark, sf, "lineitem"), "l_suppkey")
    idx = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey"))
    k = (F.col("l_partkey") * 7 + F.col("l_orderkey")) % 16
    nal = F.when(k == 0, 19).when(k < 6, 1).when(k < 9, 0).when(k == 9, 8).otherwise(1)
    lsb = F.when(nal == 19, 0).otherwise((F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 16)
    return l.groupBy(F.col("l_suppkey").alias("file_id"), idx.alias("idx")).agg(F.max(nal).alias("nal_type"), F.max(lsb).alias("poc_lsb"))


PICS = """
WITH p0 AS (SELECT l_suppkey AS file_id, (l_orderkey*10+l_linenumber)*100000+l_partkey AS idx, (l_partkey*7+l_orderkey) % 16 AS k, (l_orderkey*3+l_linenumber) % 16 AS lsb FROM lineitem),
p1 AS (SELECT file_id, idx, max(CASE WHEN k=0 THEN 19 WHEN k<6 THEN 1 WHEN k<9 THEN 0 WHEN k=9 THEN 8 ELSE 1 END) AS nal, max(CASE WHEN k=0 THEN 0 ELSE lsb END) AS lsb FROM p0 GROUP BY 1, 2),
p2 AS (SELECT *, row_number() OVER w AS o, nal=19 AS st, nal NOT BETWEEN 6 AND 9 AND NOT (nal < 16 AND nal % 2 = 0) AS ref FROM p1 WINDOW w AS (PARTITION BY file_id ORDER BY idx)),
p3 AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER w AS cvs, coalesce(last_value(CASE WHEN ref THEN lsb END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM p2 WINDOW w AS (PARTITION BY file_id ORDER BY idx)),
p4 AS (SELECT *, CASE WHEN st THEN 0 WHEN lsb < prev AND prev-lsb >= 8 THEN 1 WHEN lsb > prev AND lsb-prev > 8 THEN -1 ELSE 0 END AS wrap FROM p3),
p5 AS (SELECT *, (coalesce(sum(CASE WHEN ref THEN wrap ELSE 0 END) OVER (PARTITION BY file_id, cvs ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + wrap)*16 + lsb AS poc FROM p4),
p6 AS (SELECT file_id, idx, o-1 AS ordinal, CAST(cvs-1 AS BIGINT) AS cvs, CAST(poc AS BIGINT) AS poc, row_number() OVER (PARTITION BY file_id ORDER BY cvs, poc, idx)-1 AS rank FROM p5),
t AS (SELECT p6.*, idx // 100 AS dts FROM p6),
s AS (SELECT a.file_id, a.idx, a.dts, b.dts AS shown FROM t a JOIN t b ON a.file_id=b.file_id AND b.ordinal=a.rank),
d AS (SELECT file_id, greatest(max(dts-shown), 0) AS delay FROM s GROUP BY 1),
f AS (SELECT s.file_id, s.idx, s.dts, shown+delay-dts AS "offset", delay FROM s JOIN d USING (file_id))
"""


@query("w6_display_ranks", PICS + "SELECT * FROM p6")
def _(spark, sf):
    return frames.display_ranks(pictures(spark, sf), LOG2_MAX)


def placed(spark, sf):
    p = pictures(spark, sf)
    samples = p.select("file_id", "idx", F.floor(F.col("idx") / 100).cast("long").alias("dts"))
    return frames.offsets(samples, frames.display_ranks(p, LOG2_MAX))


@query("w7_composition_offsets", PICS + "SELECT * FROM f")
def _(spark, sf):
    return placed(spark, sf)


@query("w8_offset_runs", PICS + """, g AS (SELECT *, CASE WHEN lag("offset") OVER w = "offset" THEN 0 ELSE 1 END AS n FROM f WINDOW w AS (PARTITION BY file_id ORDER BY idx)),
r AS (SELECT *, sum(n) OVER (PARTITION BY file_id ORDER BY idx) AS run FROM g) SELECT file_id, run, "offset", count(*) AS samples FROM r GROUP BY 1, 2, 3""")
def _(spark, sf):
    return frames.offset_runs(placed(spark, sf))


@query("c13_frame_audit", """
SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 7 = 0 THEN 'not an MP4' WHEN o_orderkey % 5 = 0 THEN 'no video track' WHEN o_orderkey % 2 = 0 THEN 'has ctts' WHEN o_orderkey % 3 = 0 THEN 'not HEVC'
 WHEN o_custkey % 3 = 0 THEN 'no reordering' ELSE 'would repair' END AS verdict FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return frames.frame_audit(o.select(
        k.alias("file_id"), (k % 7 != 0).alias("is_mp4"), (k % 5 != 0).alias("has_video"), (k % 2 == 0).alias("has_ctts"),
        F.when(k % 3 == 0, "avc1").otherwise("hvc1").alias("codec"), (F.col("o_custkey") % 3).alias("reorder"),
    ))
