"""Whole jobs on a small folder tree: ingest, snapshots, exports and streams."""

import json
import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelf.operators import export
from shelf.plans import ingest
from shelf.sources import catalog, inventory
from shelf.streaming import arrivals

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def put(base, rel, content="x"):
    path = os.path.join(base, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(content)
    os.utime(path, (1_600_000_000, 1_600_000_000))


@pytest.fixture()
def tree(tmp_path):
    base = str(tmp_path)
    put(base, "movies/Heat (1995).mkv")
    put(base, "movies/Heat (1995).nfo", '<movie><title>Heat</title><year>1995</year><rating>8.3</rating><genre>Crime</genre><genre>Drama</genre><director>Mann</director></movie>')
    put(base, "movies/Heat (1995)-poster.jpg")
    put(base, "movies/.hidden/No.mkv")
    put(base, "movies/notes.txt")
    put(base, "tv/The Wire/Season 1/The Wire S01E03 The Buys.mkv")
    put(base, "tv/The Wire/Season 1/The Wire S01E03 The Buys.edl", "10 95 3\n")
    put(base, "tv/The Wire/tvshow.nfo", "<tvshow><title>The Wire</title><premiered>2002-06-02</premiered></tvshow>")
    put(base, "tv/The Wire/poster.jpg")
    put(base, "music/Artist/Album/03 - Song.flac")
    put(base, "music/Artist/music.toml", 'genre = "Rock; Pop"\n')
    return base


def found(spark, base):
    roots = spark.createDataFrame([(1, f"{base}/movies", "movies"), (2, f"{base}/tv", "tv"), (3, f"{base}/music", "music")], "root_id long, path string, kind string")
    files = inventory.scan(spark, roots, [f"{base}/movies", f"{base}/tv", f"{base}/music"])
    text = inventory.read_sidecars(spark, [base], "*.{nfo,edl,toml}").select("path", F.col("content").cast("string").alias("text"))
    texts = inventory.locate(text, roots)
    probe = json.dumps({"format": {"duration": "2600", "format_name": "matroska"}, "streams": [{"codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080}], "chapters": []})
    probes = files.filter(F.col("rel_path").endswith(".mkv")).select("root_id", "rel_path", F.lit(probe).alias("json"))
    tags = files.filter(F.col("rel_path").endswith(".flac")).select(
        "root_id", "rel_path", F.lit(" Real Song ").alias("title"), *[F.lit(None).cast("string").alias(c) for c in ("artist", "album", "album_artist", "genre")],
        F.lit(None).cast("int").alias("track_no"), F.lit(1).alias("disc_no"), F.lit(2001).alias("year"), F.lit(True).alias("embedded_art"),
    )
    return ingest.Found(roots, files, texts, probes, tags)


def tables(spark, base):
    return {name: catalog.read_table(spark, base, name) for name in catalog.SCHEMAS}


def test_ingest_twice_gives_the_same_catalog(spark, tree, tmp_path):
    base = f"{tmp_path}/catalog"
    catalog.write_snapshot(spark, base, ingest.refresh(tables(spark, base), found(spark, tree), now=1_700_000_000))
    first = tables(spark, base)
    files = {r["rel_path"]: r for r in first["files"].collect()}
    assert set(files) == {"Heat (1995).mkv", "The Wire/Season 1/The Wire S01E03 The Buys.mkv", "Artist/Album/03 - Song.flac"}
    assert {r["status"] for r in files.values()} == {"ready"}
    assert files["Heat (1995).mkv"]["art"] == "Heat (1995)-poster.jpg"
    assert files["The Wire/Season 1/The Wire S01E03 The Buys.mkv"]["art"] == "The Wire/poster.jpg"
    assert files["Artist/Album/03 - Song.flac"]["art"] == "embedded"
    m = first["movies"].first()
    assert (m["title"], m["year"], m["rating"]) == ("Heat", 1995, 8.3)
    assert sorted(r["name"] for r in first["genres"].collect()) == ["Crime", "Drama", "Pop", "Rock"]
    e = first["tv_episodes"].first()
    assert (e["series"], e["season"], e["episode"], e["title"]) == ("The Wire", 1, 3, "The Buys")
    t = first["music_tracks"].first()
    assert (t["title"], t["artist"], t["album"], t["track_no"]) == ("Real Song", "Artist", "Album", 3)
    assert first["tv_series"].first()["premiered"] == "2002-06-02"
    s = first["segments"].first()
    assert (s["start_ms"], s["kind"], s["source"]) == (10_000, "intro", "edl")

    assert catalog.write_snapshot(spark, base, ingest.refresh(first, found(spark, tree), now=1_700_000_100)) == 2
    again = tables(spark, base)
    for name in ("files", "movies", "tv_episodes", "music_tracks", "genres", "movie_genres", "segments", "tv_series"):
        key = lambda df: sorted(map(str, df.collect()))
        assert key(again[name]) == key(catalog.read_table(spark, base, name, 1)), name

    # a remuxed film keeps its arrival time; an unmounted root keeps its files
    os.remove(f"{tree}/movies/Heat (1995).mkv")
    put(tree, "movies/Heat (1995).mp4", "new")
    later = found(spark, tree)
    later.roots = later.roots.filter("kind <> 'music'")
    later.inventory = later.inventory.filter("kind <> 'music'")
    catalog.write_snapshot(spark, base, ingest.refresh(again, later, now=1_800_000_000))
    files = {r["rel_path"]: r for r in catalog.read_table(spark, base, "files").collect()}
    assert "Heat (1995).mkv" not in files and files["Heat (1995).mp4"]["added_at"] == 1_700_000_000
    assert "Artist/Album/03 - Song.flac" in files


def test_playlists(spark, tmp_path):
    rows = [("n1", 2, 2, "movies", "B", 1999, None), ("n1", 1, 1, "movies", "A\nx", 2000, 61_000)]
    df = spark.createDataFrame(rows, "node_id string, n1 int, file_id long, kind string, title string, year int, duration_ms long")
    for c in ("series", "artist", "album"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.withColumn("season", F.lit(None).cast("int")).withColumn("episode", F.lit(None).cast("int"))
    export.write_playlists(df, "http://h", ["n1"], f"{tmp_path}/out")
    folder = f"{tmp_path}/out/node_id=n1"
    text = "".join(open(f"{folder}/{f}").read() for f in sorted(os.listdir(folder)) if f.startswith("part"))
    assert text == "#EXTM3U\n#EXTINF:61,A x (2000)\nhttp://h/media/1\n#EXTINF:-1,B (1999)\nhttp://h/media/2\n"


def run(spark, stream, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    name = "t" + uuid.uuid4().hex
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


START = 1_000_000  # the first watermark is the epoch, so times start well after it


def write_events(spark, tmp_path, rows, schema):
    base = f"{tmp_path}/in"
    os.makedirs(base)
    for i, part in enumerate(rows):
        frame = pd.DataFrame(part, columns=schema)
        frame["ts"] = pd.to_datetime(frame["ts"] + START, unit="s").astype("datetime64[us]").dt.tz_localize("UTC")
        frame.to_parquet(f"{base}/{i}.parquet")
        os.utime(f"{base}/{i}.parquet", (1_600_000_000 + i, 1_600_000_000 + i))
    return base


def test_settle_stream(spark, tmp_path):
    cols = ["ts", "path", "size", "mtime", "kind"]
    batches = [
        [(0, "a", 1, 1, "seen"), (0, "b", 1, 1, "seen"), (5, "c", 1, 1, "seen")],
        [(20, "a", 2, 2, "seen"), (21, "c", 1, 1, "gone")],
        [(300, "b", 0, 0, "failed"), (900, "x", 1, 1, "seen")],
        [(5000, "y", 1, 1, "seen")],
        [(9000, "z", 1, 1, "seen")],
    ]
    base = write_events(spark, tmp_path, batches, cols)
    events = spark.readStream.schema("ts timestamp, path string, size long, mtime long, kind string").option("maxFilesPerTrigger", 1).parquet(base)
    got = sorted((r["path"], r["size"], r["due_at"].timestamp() - START, r["attempt"]) for r in run(spark, arrivals.settle_stream(events, 30, "1 second"), tmp_path).collect())
    assert [g for g in got if g[0] in "abc"] == [("a", 2, 50.0, 1), ("b", 1, 30.0, 1), ("b", 1, 360.0, 2)]


def test_burst_stream_matches_batch(spark, tmp_path):
    times = [0, 10, 50, 200, 215, 900, 1000, 1010, 5000, 9000]
    batches = [[(t, "lib")] for t in times]
    base = write_events(spark, tmp_path, batches, ["ts", "library"])
    stream = spark.readStream.schema("ts timestamp, library string").option("maxFilesPerTrigger", 1).parquet(base)
    streamed = sorted(r["run_at"].timestamp() - START for r in run(spark, arrivals.burst_stream(stream, lateness="1 second"), tmp_path).collect())
    table = spark.read.schema("ts timestamp, library string").parquet(base)
    batch = sorted(r["run_at"].timestamp() - START for r in arrivals.burst_runs(arrivals.bursts(table)).collect())
    assert batch == [110.0, 710.0, 1310.0, 5060.0, 9060.0]
    assert streamed == [b for b in batch if b < 9000]


def test_catalog_sink_is_idempotent(spark, tmp_path):
    base = f"{tmp_path}/cat"
    rows = [(0, 1, 1, "a.mkv", 10, 5, "movies", "video/x-matroska", True), (0, 2, 1, "b.mkv", 10, 5, "movies", "video/x-matroska", True)]
    schema = "ts long, event_id long, root_id long, rel_path string, size long, mtime long, kind string, mime string, present boolean"
    batch = spark.createDataFrame(rows, schema)
    sink = arrivals.catalog_sink(base, F.lit(100))
    sink(batch, 0)
    sink(spark.createDataFrame([(1, 3, 1, "a.mkv", 10, 5, "movies", "video/x-matroska", False)], schema), 1)
    sink(batch, 0)
    assert [r["rel_path"] for r in catalog.read_table(spark, base, "files").collect()] == ["b.mkv"]


def test_a_stream_on_an_older_catalog_keeps_every_table(spark, tmp_path):
    base = f"{tmp_path}/cat"
    schema = "ts long, event_id long, root_id long, rel_path string, size long, mtime long, kind string, mime string, present boolean"
    files = spark.createDataFrame([(7, 1, "old.mkv", 10, 5, "movies", "ready"), (8, 1, "gone.mkv", 10, 5, "movies", "ready")], "file_id long, root_id long, rel_path string, size long, mtime long, kind string, status string")
    catalog.write_snapshot(spark, base, {
        "files": files, "movies": spark.createDataFrame([(7, "Old"), (8, "Gone")], "file_id long, title string"),
        "watch": spark.createDataFrame([(1, "k", 8)], "profile_id long, key string, file_id long"),
        "segment_prints": spark.createDataFrame([(7, 10, 5, 1)], "file_id long, size long, mtime long, ver int"),
    })
    catalog.write_snapshot(spark, base, {"genres": spark.createDataFrame([(1, "Drama")], "id long, name string")})
    catalog.write_snapshot(spark, base, {"roots": spark.createDataFrame([(1, "/m", "movies")], "root_id long, path string, kind string")})
    sink = arrivals.catalog_sink(base, F.lit(100))
    first = spark.createDataFrame([(0, 1, 1, "new.mkv", 1, 1, "movies", "video/x-matroska", True)], schema)
    second = spark.createDataFrame([(1, 2, 1, "gone.mkv", 10, 5, "movies", "video/x-matroska", False)], schema)
    sink(first, 0)
    assert {r["rel_path"] for r in catalog.read_table(spark, base, "files").collect()} == {"old.mkv", "gone.mkv", "new.mkv"}
    sink(second, 1)
    version = catalog.current_version(spark, base)
    sink(second, 1)
    sink(first, 0)
    assert catalog.current_version(spark, base) == version == 5 and catalog.last_batch(spark, base, "events") == 1
    assert {r["rel_path"] for r in catalog.read_table(spark, base, "files").collect()} == {"old.mkv", "new.mkv"}
    counts = {name: df.count() for name, df in tables(spark, base).items()}
    assert {n: c for n, c in counts.items() if c} == {"files": 2, "movies": 1, "watch": 1, "segment_prints": 1, "genres": 1, "roots": 1}


def test_a_version_has_one_writer(spark, tmp_path):
    base = f"{tmp_path}/cat"
    catalog.write_snapshot(spark, base, {"genres": spark.createDataFrame([(1, "Drama")], "id long, name string")})

    class Late:
        """A frame whose write lets another writer commit first."""
        columns = ["id", "name"]

        def select(self, *cols):
            catalog.write_snapshot(spark, base, {"genres": spark.createDataFrame([(2, "Crime")], "id long, name string")})
            return spark.createDataFrame([(3, "Noir")], "id long, name string")

    with pytest.raises(catalog.CommitConflict):
        catalog.write_snapshot(spark, base, {"genres": Late()})
    assert [r["name"] for r in catalog.read_table(spark, base, "genres").collect()] == ["Crime"]
    # a marker that a writer left unfinished is no version
    open(f"{base}/_versions/3", "w").close()
    assert catalog.current_version(spark, base) == 2
    assert catalog.write_snapshot(spark, base, {"genres": spark.createDataFrame([(4, "War")], "id long, name string")}) == 4


def test_forgotten_programs_stay_forgotten(spark, tmp_path):
    from shelf.streaming import watch

    names = ["event_id", "ts", "profile_id", "key", "file_id", "event", "position_ms", "duration_ms", "seen"]
    batches = [[(1, 100, 1, "mv|a|1", 5, "position", 10, 100, False)], [(2, 200, 1, "mv|a|1", 5, "forget", 0, 100, False)], [(3, 150, 1, "mv|a|1", 5, "position", 20, 100, False)]]
    frames = [[(e, t, *rest) for e, t, *rest in b] for b in batches]
    base = write_events(spark, tmp_path, frames, names)
    schema = "event_id long, ts timestamp, profile_id long, key string, file_id long, event string, position_ms long, duration_ms long, seen boolean"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = f"{tmp_path}/changes"
    q = watch.fold_stream(stream).writeStream.foreachBatch(watch.change_sink(out)).option("checkpointLocation", f"{tmp_path}/state").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert watch.latest_states(spark.read.parquet(f"{out}/batch=*")).count() == 0


def test_a_library_with_all_arrivals_spreads_over_days(spark):
    times = spark.range(4000).select(F.lit("lib").alias("library"), F.timestamp_seconds(F.lit(1_000_000) + F.col("id") * F.when(F.col("id") % 3 == 0, 61).otherwise(59)).alias("ts"))
    found = arrivals.bursts(times, bin_s=3600).orderBy("begin_at").collect()
    at = sorted(r["ts"].timestamp() for r in times.collect())
    want = []
    for t in at:
        if want and t - want[-1][1] < 60:
            want[-1][1] = t
            want[-1][2] += 1
        else:
            want.append([t, t, 1])
    assert [(r["begin_at"].timestamp(), r["quiet_at"].timestamp() - 60, r["arrivals"]) for r in found] == [tuple(w) for w in want]


def written_bytes(base):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(base) for f in names if f.endswith(".parquet"))


def test_a_small_batch_writes_a_small_delta(spark, tmp_path):
    base = f"{tmp_path}/cat"
    files = spark.range(200_000).select(
        F.col("id").alias("file_id"), F.lit(1).cast("long").alias("root_id"), F.concat(F.md5(F.col("id").cast("string")), F.lit(".mkv")).alias("rel_path"),
        F.lit(10).alias("size"), F.lit(5).alias("mtime"), F.lit("movies").alias("kind"), F.lit("ready").alias("status"), F.lit(7).alias("added_at"), F.lit(90).cast("long").alias("duration_ms"),
    )
    catalog.write_snapshot(spark, base, {"files": files, "movies": files.select("file_id", F.lit("t").alias("title")), "movie_genres": files.select("file_id", F.lit(1).alias("genre_id"))})
    whole = written_bytes(base)
    some = files.filter("file_id < 10").select(
        F.lit(0).alias("ts"), F.col("file_id").alias("event_id"), "root_id", "rel_path", "size", F.lit(6).alias("mtime"), "kind", F.lit("video/x-matroska").alias("mime"), (F.col("file_id") < 5).alias("present"))
    sink = arrivals.catalog_sink(base, F.lit(100), deltas_kept=2)
    sink(some, 0)
    assert written_bytes(base) - whole < whole / 50
    after = catalog.read_table(spark, base, "files")
    assert after.count() == 199_995 and after.filter("status = 'pending' and duration_ms = 90 and added_at = 7").count() == 5
    for name in ("movies", "movie_genres"):
        assert catalog.read_table(spark, base, name).count() == 199_995
    # a file that went comes back with a later batch; a third delta is one too many, and the tables are written whole
    sink(some.withColumn("present", F.lit(True)), 1)
    assert catalog.read_table(spark, base, "files").count() == 200_000 and catalog.read_table(spark, base, "movies").count() == 199_995
    sink(some.withColumn("present", F.col("event_id") != 9), 2)
    assert not catalog.current(spark, base)[1]["deltas"].get("files")
    assert catalog.read_table(spark, base, "files").count() == 199_999 and catalog.last_batch(spark, base, "events") == 2
    # an older version still reads as it did
    assert catalog.read_table(spark, base, "files", 2).count() == 199_995


def test_a_series_is_read_and_written_once_a_batch():
    from shelf.streaming import watch

    class Programs:
        def __init__(self):
            self.rows, self.calls = [], []

        def get(self):
            self.calls.append("get")
            return iter(self.rows)

        def put(self, rows):
            self.calls.append("put")
            self.rows = rows

        def clear(self):
            self.calls.append("clear")
            self.rows = []

    class Handle:
        def __init__(self):
            self.programs = Programs()

        def getListState(self, *_):
            return self.programs

    class Timers:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    handle, fold = Handle(), watch.WatchFold()
    fold.init(handle)
    report = lambda k, at, event="position": ("ts", 1, "tv|a|", k, at, at, 5, event, 10, 100, None)
    first = list(fold.handleInputRows((1, "tv|a|"), iter([report(f"tv|a|1|{i % 20}", 2_000_000 + i) for i in range(200)]), Timers(0)))
    assert len(first) == 20 and handle.programs.calls == ["get", "put"]
    hidden = list(fold.handleInputRows((1, "tv|a|"), iter([report("tv|a|1|3", 2_000_500, "dismiss"), report("tv|a|1|4", 2_000_600)]), Timers(0)))
    assert sorted(r["key"] for r in hidden if r["dismissed"]) == sorted(f"tv|a|1|{i}" for i in range(20) if i != 4)
    gone = list(fold.handleInputRows((1, "tv|a|"), iter([report(f"tv|a|1|{i}", 2_000_700, "forget") for i in range(20)]), Timers(3000)))
    assert all(r["removed"] and r["updated_us"] is None for r in gone) and handle.programs.rows == []
