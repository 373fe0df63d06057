"""Names, texts and keys on literals."""

import pytest
from pyspark.sql import functions as F

from shelf.functions import formats, keys, names, text
from shelf.operators import captions, enrich
from shelf.sources import sidecars


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("stem,title,year", [
    ("Heat (1995)", "Heat", 1995), ("Heat.1995.1080p", "Heat", 1995), ("2012", "2012", None), ("Blade.Runner.2049.2017", "Blade Runner 2049", 2017),
    ("Wall.Street.REMASTERED.1987", "Wall Street", 1987), ("Some_Film_1080p", "Some Film", None), ("1917.2019.mkv", "1917", 2019), ("(1999)", "1999)", None),
])
def test_movie_names(spark, stem, title, year):
    r = one(spark, stem, names.movie)
    assert (r["title"], r["year"]) == (title, year)


@pytest.mark.parametrize("path,expected", [
    ("The Wire S01E03 The Buys.mkv", ("The Wire", 1, 3, "The Buys")),
    ("The Wire/Season 1/1x03 The Buys.mkv", ("The Wire", 1, 3, "The Buys")),
    ("Show.S05E24E25.Last.mkv", ("Show", 5, 24, "Last")),
    ("CSI S02E01 Grave Danger 1080p Web-DL x264-OFT.mkv", ("CSI", 2, 1, "Grave Danger")),
    ("The.Boys.(2019).s01e02.1080p.mkv", ("The Boys", 1, 2, "Episode 2")),
    ("x/Specials 1/S00E07.mkv", ("Specials 1", 0, 7, "Episode 7")),
    ("S01E01.mkv", ("Unknown Series", 1, 1, "Episode 1")),
    ("no mark here.mkv", None),
])
def test_episode_names(spark, path, expected):
    r = one(spark, path, lambda p: names.episode(names.stem(p), names.folders(p)))
    assert (r and (r["series"], r["season"], r["episode"], r["title"])) == expected


def test_track_names(spark):
    r = one(spark, "Artist/Album/03 - My_Song.flac", lambda p: names.track(names.stem(p), names.folders(p)))
    assert tuple(r) == ("Artist", "Album", 3, "My Song")
    r = one(spark, "30 Minutes.flac", lambda p: names.track(names.stem(p), names.folders(p)))
    assert tuple(r) == (None, None, 30, "Minutes")


@pytest.mark.parametrize("title,expected", [
    ('"Wuthering Heights"', 'Wuthering Heights"'), ("The Game", "Game"), ("A Man", "Man"), ("an Ode", "Ode"), ("Them", "Them"), ("...", "..."), ("Été", "Été"),
])
def test_sort_titles(spark, title, expected):
    assert one(spark, title, names.sort_title) == expected


@pytest.mark.parametrize("path,stem", [
    ("Movies/The.Mummy.2026.mkv", "Movies/The.Mummy.2026"), ("Heat (1995).mp4", "Heat (1995)"), ("dir.with.dots/noext", None), (".hidden", None),
])
def test_path_stems(spark, path, stem):
    assert one(spark, path, names.path_stem) == stem


def test_split_genres(spark):
    assert one(spark, " Rock ; Pop/ Jazz,,", names.split_genres) == ["Rock", "Pop", "Jazz"]


@pytest.mark.parametrize("value,ok", [
    ("2000-10-15", True), ("2000", True), ("15/10/2000", False), ("2000-13-01", False), ("October 2000", False), ("20001015", False), ("1799-01-01", False),
])
def test_dates(spark, value, ok):
    assert one(spark, value, text.iso_date) == (value if ok else None)


def test_node_ids(spark):
    for name in ("Ärger & Söhne", "a/b c", "??>>", ""):
        code = one(spark, name, keys.encode)
        assert "=" not in code and "+" not in code and "/" not in code
        assert one(spark, code, keys.decode) == name
    assert one(spark, "!!", keys.decode) is None
    kinds = {"0": "root", "mv:year:1999": "mv:year:n", "tv:4k": "tv:4k", "dir:3": "dir", "it:7": "item", "mv:bogus": None, "mv:year:x": None, "tv:ser:U2hvdw:2": "tv:season"}
    for node, kind in kinds.items():
        r = one(spark, node, keys.parse_node)
        assert (r and r["kind"]) == kind


def test_program_keys(spark):
    def key(kind, series=None, season=None, episode=None, title="", year=None):
        df = spark.createDataFrame([(kind, 7, series, season, episode, title, year)], "kind string, file_id long, series string, season int, episode int, title string, year int")
        return df.select(keys.program_key(*[F.col(c) for c in df.columns])).first()[0]

    assert key("tv", " The Wire ", 1, 3) == key("tv", "the wire", 1, 3) == "tv|the wire|1|3"
    assert key("tv", "The Wire", 1, 0) == "f|7"
    assert key("movies", title="Heat (1995)", year=1995) == key("movies", title="8.3 · Heat", year=1995) == "mv|heat|1995"
    assert key("music", title="x") is None


def test_notes(spark):
    def note(position, duration, watched, ago):
        df = spark.createDataFrame([(position, duration, watched, 1_700_000_000 - ago)], "p long, d long, w boolean, u long")
        return df.select(formats.watch_note(F.col("p"), F.col("d"), F.col("w"), F.col("u"), F.lit(1_700_000_000))).first()[0]

    assert note(600_000, 1_450_000, False, 5) == "14:10 left · just now"
    assert note(0, None, True, 5) == "watched just now"
    assert note(0, None, True, 86_400) == "watched yesterday"
    assert note(61_000, None, False, 7200) == "at 1:01 · 2 h ago"
    assert note(0, None, False, 0) == ""
    assert note(0, None, True, 40 * 86_400) == "watched 2023-10-05"


def test_truncation(spark):
    assert one(spark, "word " * 100, formats.truncate_words) == ("word " * 59 + "word") + "…"
    assert one(spark, "short", formats.truncate_words) == "short"


def test_recorded_hash(spark):
    h = "ab" * 32
    get = lambda v: one(spark, v, captions.recorded_hash)
    assert get(captions.TAG_PREFIX + h) == h and get(captions.TAG_PREFIX + h + " ; more") == h
    assert get("Lavf63") is None and get(captions.TAG_PREFIX + "short") is None and get("") is None


def test_timestamps(spark):
    assert one(spark, "00:01:02,5", sidecars.timestamp_ms) == 62_500
    assert one(spark, "01:02.250 X1:0", sidecars.timestamp_ms) == 62_250
    assert one(spark, "junk", sidecars.timestamp_ms) is None


def test_nfo_fields(spark):
    r = one(spark, '<tvshow><title>A &amp; B</title><plot>x <![CDATA[<y>]]> z</plot><premiered>2000-10-15</premiered><uniqueid type="imdb">tt1234567</uniqueid></tvshow>', sidecars.nfo_fields)
    assert (r["title"], r["plot"], r["premiered"], r["imdb_id"]) == ("A & B", "x <y> z", "2000-10-15", "tt1234567")
    r = one(spark, "<season><seasonnumber>3</seasonnumber><showtitle>S</showtitle></season>", sidecars.nfo_fields)
    assert (r["season"], r["show_title"], r["genres"]) == (3, "S", [])
    assert one(spark, "<movie><title>broken", sidecars.nfo_fields)["title"] is None


def test_sidecar_state(spark):
    r = one(spark, "<movie><uniqueid default='true' type='tmdb'> 12 </uniqueid></movie>", enrich.nfo_state)
    assert r["is_pin"] and r["tmdb_id"] == 12 and r["state"] == "handwritten"
    assert not one(spark, '<movie><title>T</title><uniqueid type="tmdb">12</uniqueid></movie>', enrich.nfo_state)["is_pin"]
    assert one(spark, "<x><aired></aired></x>", enrich.nfo_state)["has_aired"]
    patched = one(spark, '<m>\n  <uniqueid type="imdb">tt1</uniqueid>\n</m>', lambda t: enrich.with_rating(t, F.lit(7.25)))
    assert patched.count("<rating>") == 1 and patched.index("<rating>") < patched.index("<uniqueid")
    assert one(spark, patched, lambda t: enrich.with_rating(t, F.lit(8.0))) is None


def test_decode_subtitles(spark):
    get = lambda b: one(spark, bytearray(b), text.decode_subtitle, "binary")
    assert get("﻿hé".encode("utf-8")) == "hé"
    assert get(b"\xff\xfe" + "hé".encode("utf-16-le")) == "hé" and get(b"\xfe\xff" + "hé".encode("utf-16-be")) == "hé"
    assert get(b"x" * 99 + b"\x92") == "x" * 99 + "’"
    assert get(b"\xe9\xe8\xe7") is None


def test_sizes_round_a_half_to_the_even_digit(spark):
    sizes = [5, 1023, 1024, 1152, 203_904, 203_776, 1_048_575, 1_048_576, 10_485_760 * 100 + 5243, 3 * 1024**4 + 1024**4 // 8]
    got = spark.createDataFrame([(s,) for s in sizes], "s long").select(formats.human_size(F.col("s")).alias("t")).collect()
    units = [(1024**4, "TB"), (1024**3, "GB"), (1024**2, "MB"), (1024, "KB")]
    want = [next((f"{s / u:.2f} {n}" for u, n in units if s >= u), f"{s} B") for s in sizes]
    assert [r["t"] for r in got] == want and "199.12 KB" in want


def test_tasks_of_one_title_meet_the_best_candidate_alone(spark):
    tasks = spark.createDataFrame([(i, "T", None if i % 2 else 2000, None) for i in range(40)], "task_id long, title string, year int, tmdb_id long")
    found = [(100 + i, " t ", 2000 + i % 3, i % 4 == 1, i % 5) for i in range(30)]
    candidates = spark.createDataFrame(found, "tmdb_id long, title string, year int, is_primary boolean, rank int")
    got = enrich.match_movies(tasks, candidates)
    dated = min((0 if p else 1, r, k) for k, _, y, p, r in found if y == 2000)
    plain = min((r, k) for k, _, _, _, r in found)
    assert {r["task_id"]: (r["match_id"], r["how"]) for r in got.collect()} == {
        i: (plain[1], "exact") if i % 2 else (dated[2], "loose" if dated[0] else "exact") for i in range(40)}
    joins = [n for n in str(got._jdf.queryExecution().optimizedPlan().toString()).splitlines() if "Join Inner" in n]
    assert len(joins) == 2 and "is_primary" not in "".join(joins)
