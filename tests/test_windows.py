"""Hot groups: the chunked form must equal the plain one."""

import pytest
from pyspark.sql import functions as F

from shelf.operators import frames, listings, merge, watch, windows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 11).cast("string")).alias("k"), ((F.col("id") * 7919) % 3001).alias("t"),
        F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"),
    )


def test_chunked_equals_plain(spark, rows):
    specs = dict(
        rn=("row_number",), s=("sum", F.col("v")), sb=("sum_before", F.col("v")), l=("last", F.col("v")), lb=("last_before", F.col("v")),
        lag=("lag", F.col("v")), lead=("lead", F.col("v")),
    )
    plain = windows.ordered_columns(rows, ["k"], ["t"], **specs)
    hot = windows.ordered_columns(rows, ["k"], ["t"], spread=True, **specs)
    assert hot.select(windows.chunk_column(["k"], ["t"])).distinct().count() > 1
    a = sorted(map(tuple, plain.select("k", "t", *specs).collect()), key=str)
    b = sorted(map(tuple, hot.select("k", "t", *specs).collect()), key=str)
    assert a == b


def test_null_keys(spark):
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, 1).alias("k"), F.col("id").alias("t"))
    hot = windows.ordered_columns(df, ["k"], ["t"], spread=True, rn=("row_number",))
    assert sorted(r["rn"] for r in hot.collect()) == sorted([*range(1, 201), *range(1, 201)])


def test_renditions_of_a_hot_work(spark):
    df = spark.range(600).select(
        F.col("id").alias("file_id"), F.when(F.col("id") % 2 == 0, "One").otherwise(F.concat(F.lit("T"), F.col("id").cast("string"))).alias("title"), F.lit(2000).alias("year"),
        F.lit("m").alias("mime"), (F.col("id") * 37 % 101).alias("size"), F.lit(1).alias("duration_ms"), (F.col("id") % 4).cast("int").alias("width"), F.lit(10).alias("height"),
    )
    a = merge.renditions(df, merge.movie_keys())
    b = merge.renditions(df, merge.movie_keys(), spread=True)
    pick = lambda d: sorted((r["file_id"], r["quality_rank"]) for r in d.collect())
    assert pick(a) == pick(b)


def test_hot_watch_key(spark):
    from pyspark.sql import types as T

    events = spark.range(500).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.lit(1).cast("long").alias("profile_id"), F.lit("mv|x|2000").alias("key"), F.lit(5).cast("long").alias("file_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("position", "seen", "forget", "dismiss", "ended", "position", "forget")]), (F.col("id") % 7 + 1).cast("int")).alias("event"),
        (F.col("id") * 13 % 90).cast("long").alias("position_ms"), F.when(F.col("id") % 4 > 0, 100).cast("long").alias("duration_ms"), (F.col("id") % 3 == 0).alias("seen"),
    )
    assert isinstance(events.schema, T.StructType)
    for n in (499, 480, 333, 100, 17):
        part = events.filter(F.col("event_id") <= n)
        assert watch.fold(part).collect() == watch.fold(part, spread=True).collect()


def test_frames_literals(spark):
    pics = [(19, 0), (1, 4), (1, 2), (0, 1), (0, 3), (19, 0), (1, 2), (0, 1)]
    df = spark.createDataFrame([(1, i, n, l) for i, (n, l) in enumerate(pics)], "file_id long, idx long, nal_type int, poc_lsb int")
    for hot in (False, True):
        r = frames.display_ranks(df, 8, spread=hot).orderBy("idx").collect()
        assert [x["rank"] for x in r] == [0, 4, 2, 1, 3, 5, 7, 6]
        assert max(x["cvs"] for x in r) == 1


def test_offsets_literal(spark):
    ranks = spark.createDataFrame([(1, i, i, r) for i, r in enumerate([0, 4, 2, 1, 3])], "file_id long, idx long, ordinal long, rank long")
    samples = spark.createDataFrame([(1, i, i * 10) for i in range(5)], "file_id long, idx long, dts long")
    got = frames.offsets(samples, ranks).orderBy("idx").collect()
    delay = got[0]["delay"]
    assert delay == 10 * max(i - r for i, r in enumerate([0, 4, 2, 1, 3]))
    assert [g["dts"] + g["offset"] for g in got] == [r * 10 + delay for r in [0, 4, 2, 1, 3]]
    assert min(g["offset"] for g in got) == 0


def test_hot_neighbours(spark):
    t = spark.range(300).select(
        F.col("id").alias("file_id"), F.lit(None).cast("string").alias("album_artist"), F.lit(None).cast("string").alias("artist"), F.lit(None).cast("string").alias("album"),
        (F.col("id") % 2).alias("disc_no"), (F.col("id") * 7 % 300).alias("track_no"), F.lit("t").alias("title"),
    )
    pick = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert pick(listings.track_neighbours(t)) == pick(listings.track_neighbours(t, spread=True))
