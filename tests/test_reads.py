"""How often a job reads what it is given: texts, tables and paths."""

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from shelf.operators import audio, captions, enrich, export, reconcile
from shelf.sources import inventory, probes
from shelf.streaming import arrivals
from tests.compare import compare

SF = "/root/testdata/sf0.001"
QUERIES = queries()


def plan_of(df) -> str:
    """The optimized plan as text."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def meter(i: str, lra: str, peak: str) -> str:
    return f"I: -70.0 LUFS\nSummary:\n  I:   {i} LUFS\n  LRA:  {lra} LU\n  Peak: {peak} dBFS\n"


def test_meter_text_is_read_once(spark):
    rows = spark.createDataFrame(
        [(1, meter("-23.4", "7.0", "-1.5")), (2, "I: -3 LUFS"), (3, meter("-inf", "7.0", "-1.5")), (4, meter("nan", "1", "1")), (5, meter("-9", "x", "1")), (6, None)],
        "file_id long, text string",
    )
    got = probes.meter_levels(rows)
    assert [tuple(r) for r in got.collect()] == [(1, -23.4, 7.0, -1.5)]
    assert plan_of(got).count("regexp_extract(") == 3


BLOCKS = (
    "[STREAM]\nindex=0\ncodec_type=video\ncodec_name=h264\nside_data_type=DOVI configuration\nside_data_type=other\n[/STREAM]\n"
    "[STREAM]\nindex=1\ncodec_type=audio\ncodec_name=aac\ncodec_name=ac3\r\nTAG:LANGUAGE= eng \nTAG:handler_name=Stereo (AAC)\n[/STREAM]\n"
    "[STREAM]\nindex=x\ncodec_type=audio\ncodec_name=eac3\nchannels=6\nDISPOSITION:default=0\nTAG:title=\n[/STREAM]\n"
)


def listed(spark):
    return probes.streams(spark.createDataFrame([(1, BLOCKS), (2, "[STREAM]\ncodec_type=data\n[/STREAM]"), (3, ""), (4, None)], "file_id long, text string"))


def test_stream_blocks_are_read_once(spark):
    got = listed(spark).filter("kind = 'audio' and codec <> 'none'")
    rows = [(r.idx, r.stream_index, r.codec, r.channels, r.language, r.title, r.own_title, r.is_default) for r in got.orderBy("idx").collect()]
    assert rows == [(1, 1, "ac3", 0, "eng", "Stereo (AAC)", None, False), (2, 2, "eac3", 6, None, "", "", False)]
    assert [r.dolby_vision for r in listed(spark).orderBy("file_id", "idx").collect()] == [True, False, False, False]
    # a filter on the columns of a stream reads no block again
    assert plan_of(got).count("side_data_type") <= 1


def test_raise_plan_reads_streams_once(spark):
    got = audio.raise_plan(listed(spark))
    rows = {r.file_id: (r.reason, r.source, r.channels, r.dropped, r.mixdown_name) for r in got.collect()}
    assert rows == {1: (None, 2, 6, 1, "Stereo Mixdown"), 2: ("no video stream", None, None, None, None)}
    assert plan_of(got).count("Generate ") == 1 and "Join" not in plan_of(got)


def test_embedded_captions_read_streams_once(spark):
    names = ["subrip", "hdmv_pgs_subtitle"]
    block = lambda codec, forced: f"[STREAM]\ncodec_type=subtitle\ncodec_name={codec}\nDISPOSITION:forced={forced}\nTAG:language=eng\n[/STREAM]"
    files = spark.createDataFrame([(1, block(names[0], 1) + block(names[0], 0)), (2, block(names[1], 0)), (3, "")], "file_id long, text string")
    got = captions.embedded_class(files, captions.subtitle_tracks(probes.streams(files)))
    assert {r.file_id: r.embedded for r in got.collect()} == {1: "1", 2: "bitmap", 3: "none"}
    assert plan_of(got).count("Generate ") == 1


def test_affected_media_by_folder_and_stem(spark):
    files = spark.createDataFrame(
        [(1, "a/b/My.Show.S01.mkv", "tv"), (2, "a/b/My.mkv", "tv"), (3, "a/c/d/x.flac", "music"), (4, "top.mkv", "movies"), (5, "a/My.mkv", "movies")],
        "file_id long, rel_path string, kind string",
    ).select(F.lit(1).alias("root_id"), "*", F.lit("ready").alias("status"))
    events = ["a/b/My.nfo", "a/b/My.Show.nfo", "a/b/My.Show.S01-poster.JPG", "a/Cover.jpg", "a/music.toml", "top.edl", "top.nfo", "cover.png", "a/b/other.nfo", "a/b/tvshow.nfo"]
    got = reconcile.affected_media(spark.createDataFrame([(1, p) for p in events], "root_id int, event_path string"), files)
    assert {(r.event_path, r.file_id, r.why) for r in got.collect()} == {
        ("a/b/My.nfo", 1, "sidecar"), ("a/b/My.nfo", 2, "sidecar"), ("a/b/My.Show.nfo", 1, "sidecar"), ("a/b/My.Show.S01-poster.JPG", 1, "poster"),
        ("a/Cover.jpg", 1, "folder art"), ("a/Cover.jpg", 2, "folder art"), ("a/Cover.jpg", 5, "folder art"), ("a/music.toml", 3, "overrides"),
        ("top.edl", 4, "sidecar"), ("top.nfo", 4, "sidecar"), ("cover.png", 4, "folder art"), ("cover.png", 5, "folder art"),
    } and got.count() == 12


def test_art_by_kind(spark):
    files = spark.createDataFrame(
        [(1, "S/Season 1/e1.mkv", "tv"), (2, "S/Season 2/e1.mkv", "tv"), (3, "S/Season 2/e2.mkv", "tv"), (4, "e3.mkv", "tv"), (5, "S/Season 2/t.flac", "music"),
         (6, "t.flac", "music"), (7, "S/Season 1/film.mkv", "movies"), (8, "S/film2.mkv", None)],
        "file_id long, rel_path string, kind string",
    ).withColumn("root_id", F.lit(1))
    pictures = ["S/Season 1/poster.png", "S/Season 1/folder.jpg", "S/folder.jpg", "S/Season 2/e2-poster.png", "S/Season 2/e2-poster.jpg", "S/Season 2/cover.png", "S/Season 2/front.jpg",
                "poster.jpg", "S/film2-poster.png", "S/Season 2/poster.txt"]
    got = reconcile.discover_art(files, spark.createDataFrame([(1, p) for p in pictures], "root_id int, rel_path string"))
    assert got.columns == [*files.columns, "found_art"]
    assert {r.file_id: r.found_art for r in got.collect()} == {
        1: "S/Season 1/poster.png", 2: "S/folder.jpg", 3: "S/Season 2/e2-poster.jpg", 4: None, 5: "S/Season 2/cover.png", 6: "poster.jpg", 7: None, 8: "S/film2-poster.png",
    }


@pytest.mark.parametrize("name", ["j26_affected_media", "j13_discover_art"])
def test_files_are_put_together_once(spark, name):
    assert "l_orderkey" not in plan_of(QUERIES[name](spark, SF))


def test_root_is_looked_up_once(spark):
    roots = spark.createDataFrame([(1, "/vol/", "movies"), (2, "/vol/tv", "tv"), (3, "/vol/tv/a/b", "music")], "root_id int, path string, kind string")
    paths = ["/vol/x.mkv", "/vol/tv/x.mkv", "/vol/tv/a/b/c/x.flac", "/vol/tv/a/x.mkv", "/other/x.mkv", "/vol/tv", "/vol/tv/.hid/x.mkv", "x.mkv", ""]
    files = spark.createDataFrame(list(enumerate(paths)), "n int, path string")
    got = inventory.locate(files, roots)
    assert {(r.n, r.root_id, r.kind, r.rel_path) for r in got.collect()} == {
        (0, 1, "movies", "x.mkv"), (1, 2, "tv", "x.mkv"), (2, 3, "music", "c/x.flac"), (3, 2, "tv", "a/x.mkv"), (5, 1, "movies", "tv"),
    }
    # no list of all folders above a path is made, and no filter repeats the search
    assert "Generate inline" in plan_of(got) and "sequence(" not in plan_of(got)


def test_episode_names_are_parsed_once(spark):
    media = spark.createDataFrame([(1, "Show/Season 1/Show.S01E02.Name.mkv"), (1, "Show/Season 1/Show.S01E03.mkv"), (1, "Show/extra.mkv")], "root_id int, rel_path string")
    texts = spark.createDataFrame([(1, "Show/Season 1/Show.S01E02.Name.nfo", "<episodedetails><title>Mine</title></episodedetails>")], "root_id int, rel_path string, text string")
    none = texts.limit(0).select("root_id", "rel_path")
    tasks = enrich.episode_tasks(media, texts, none)
    assert {(r.episode, r.write_nfo) for r in tasks.collect()} == {(2, False), (3, True)}
    assert plan_of(tasks).count("Generate explode(filter(") == 1
    plans = enrich.series_plans(tasks, texts, none)
    assert [(r.k_series, r.episodes, r.season_nfos) for r in plans.collect()] == [("show", 1, 1)]
    assert "S(" not in plan_of(plans) and "Generate" not in plan_of(plans)


def test_captions_are_found_in_one_join(spark):
    files = spark.createDataFrame(
        [(1, "a/x.mkv"), (2, "a/y.mkv"), (3, "a/z.1.mkv"), (4, "noext"), (5, "a/x.srt.mkv")], "file_id long, rel_path string"
    ).select("*", F.lit(1).alias("root_id"), F.lit("tv").alias("kind"), F.lit(9).alias("duration_ms"), F.lit("ready").alias("status"))
    sides = [("a/x.srt", 1), ("a/x.rttm", 1), ("a/y.srt", 9 * 1024 * 1024), ("a/z.1.rttm", 1), ("noext.srt", 1), ("a/x.srt.srt", 1), ("a/y.SRT", 1), ("a/y.txt", 1)]
    disk = spark.createDataFrame([(1, *s) for s in sides], "root_id int, rel_path string, size long")
    got = export.caption_inventory(files, spark.createDataFrame([(1, "/r")], "root_id int, path string"), disk)
    assert {r.id: (r.srt, r.rttm) for r in got.collect()} == {1: (True, True), 2: (False, False), 3: (False, True), 4: (True, False), 5: (True, False)}
    assert plan_of(got).count("Join") == 2


def test_event_batch_is_folded_once(spark):
    row = (1, "d/x.mkv", 7, 1, 1, "movies", "m", "ready", 5, 5)
    files = spark.createDataFrame([row, (1, "y.mkv", 8, *row[3:])], "root_id int, rel_path string, file_id long, size long, mtime long, kind string, mime string, status string, added_at long, updated_at long")
    events = spark.createDataFrame(
        [(0, 1, 1, "d", 1, 1, "movies", "m", False), (0, 2, 1, "y.mkv", 1, 1, "movies", "m", True), (1, 3, 1, "y.mkv", 2, 1, "movies", "m", True)],
        "ts int, event_id long, root_id int, rel_path string, size long, mtime long, kind string, mime string, present boolean",
    )
    changes = arrivals.event_changes(files, events, F.lit(99))
    assert {(r.file_id, r.size, r.status, r.added_at, r._gone) for r in changes.collect()} == {(7, 1, "ready", 5, True), (8, 2, "pending", 5, False)}
    assert "max_by(" not in plan_of(changes)


def test_a_repeated_id_brings_its_description_once(spark, tmp_path):
    """Two line items of one id are two rows, as in the SQL, not four for each."""
    part = [(k, f"red bolt {k}", "Brand#1", "BRASS", 20) for k in (1, 2, 7)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(3, "S", 0)], "s_suppkey long, s_name string, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    lines = [(5, n, k, 3, 1.0, 10.0, "F") for n, k in ((1, 1), (1, 1), (2, 2), (3, 7), (3, 7))]
    lines = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_linestatus string")
    lines.withColumn("l_shipdate", F.lit("1995-01-02").cast("date")).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("part", "supplier", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    diff, n = compare(spark, con, str(tmp_path), queries()["j15_movie_facts"], oracle_sql()["j15_movie_facts"])
    assert diff is None and n == 5
