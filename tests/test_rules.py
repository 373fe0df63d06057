"""Operators on the literals of their specification, and against plain replays."""

import random

from pyspark.sql import functions as F

from shelf.operators import audio, captions, reconcile, segments, watch
from shelf.sources import probes, sidecars


def test_added_at_inheritance(spark):
    known = spark.createDataFrame([(1, "Heat (1995).mkv", 1000), (1, "Heat (1995) Extras.mkv", 700)], "root_id int, rel_path string, added_at long")
    rows = spark.createDataFrame([(1, "Heat (1995).mp4", 5000, True), (1, "Heat (1995) Extras.mkv", 700, False)], "root_id int, rel_path string, added_at long, is_new boolean")
    got = {r["rel_path"]: r["added_at"] for r in reconcile.inherited_added_at(rows, known, known.limit(0)).collect()}
    assert got == {"Heat (1995).mp4": 1000, "Heat (1995) Extras.mkv": 700}
    old = spark.createDataFrame([(1, "Heat (1995).mp4", 5000, False)], rows.schema)
    gone = spark.createDataFrame([(1, "Heat (1995).mkv", 500)], known.schema)
    assert reconcile.inherited_added_at(old, known, gone).first()["added_at"] == 500


def test_segment_precedence(spark):
    schema = "file_id long, start_ms long, end_ms long, kind string, source string"
    audio_row = spark.createDataFrame([(1, 0, 90, "intro", "audio")], schema)
    ids = spark.createDataFrame([(1,)], "file_id long")
    assert segments.replace_segments(audio_row, ids, audio_row.limit(0)).count() == 1
    edl = spark.createDataFrame([(1, 5, 9, "intro", "edl")], schema)
    assert [r["source"] for r in segments.replace_segments(audio_row, ids, edl).collect()] == ["edl"]
    assert segments.replace_segments(edl, ids, edl.limit(0)).count() == 0


def test_chapters(spark):
    rows = [
        (1, 0, 0, 60_000, "Previously On", 3_600_000), (1, 1, 60_000, 150_000, "Opening Credits", 3_600_000), (1, 2, 150_000, 900_000, "Part 1", 3_600_000),
        (1, 3, 3_400_000, 3_600_000, "End Credits", 3_600_000), (2, 0, 5_000, 3_500_000, "Intro", 3_600_000), (3, 0, 0, 600_000, "Intro", 1_100_000),
        (4, 0, 0, 1_000_000, "Intro", None), (5, 0, 0, 90_000, "OP", None),
    ]
    df = spark.createDataFrame(rows, "file_id long, pos int, start_ms long, end_ms long, title string, duration_ms long")
    got = sorted((r["file_id"], r["kind"]) for r in segments.chapter_segments(df).collect())
    assert got == [(1, "credits"), (1, "intro"), (1, "recap"), (5, "intro")]


def test_edit_lists(spark):
    lines = ["10.5 95 3", "700 880 3", "2510.25 2600 0", "1 2 2", "junk", "# x", "5 4 0"]
    df = spark.createDataFrame([(1, 2_600_000, i, l) for i, l in enumerate(lines)] + [(2, None, 0, "2510 2600 0")], "file_id long, duration_ms long, pos int, line string")
    got = sorted((r["file_id"], r["start_ms"], r["kind"]) for r in sidecars.edl_segments(df).collect())
    assert got == [(1, 10_500, "intro"), (1, 700_000, "commercial"), (1, 2_510_250, "credits"), (2, 2_510_000, "commercial")]


def test_speakers(spark):
    lines = ["SPEAKER ep 1 0.50 3.00 <NA> <NA> Alice <NA> <NA>", "SPEAKER ep 1 3.60 2.00 <NA> <NA> Bob 0.95 <NA>", "SPEAKER ep 1 bad 1 a b C", "SPEAKER ep 1 1 0 a b C <NA>", "LEXEME x"]
    speech = sidecars.rttm_segments(spark.createDataFrame([(1, l) for l in lines], "media_id long, line string"))
    assert sorted(r["speaker"] for r in speech.collect()) == ["Alice", "Bob"]
    odd = sidecars.rttm_segments(spark.createDataFrame([(1, "SPEAKER ep 1 0 1 x x <Al&ice> 0.89 x")], "media_id long, line string"))
    assert odd.first()["speaker"] == "Alice" and captions.confident(odd).count() == 0
    units = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 3.0, 4.6), (1, 3, 3.0, 4.0), (1, 4, 6.0, 9.0)], "media_id long, unit long, start_s double, end_s double")
    who = {r["unit"]: r["speaker"] for r in captions.speakers(captions.overlaps(units, speech)).collect()}
    assert who == {1: "Alice", 2: "Bob", 3: "Alice"} or who == {1: "Alice", 2: "Bob", 3: "Bob"}


def test_voice_tags(spark):
    speech = spark.createDataFrame([(1, "Alice", 0.5, 3.5, None), (1, "Bob", 3.6, 5.6, None)], "media_id long, speaker string, start_s double, end_s double, confidence double")
    vtt = "WEBVTT\n\n1\n00:00:00.000 --> 00:00:01.000\nhello\nyou\n\nNOTE x\n\n00:02.000 --> 00:05.000\n- one here\n- two here\n\n00:10.000 --> 00:11.000\nnobody\n"
    got = captions.tag_vtt(spark.createDataFrame([(1, vtt)], "media_id long, text string"), speech).first()["text"]
    assert got == (
        "WEBVTT\n\n1\n00:00:00.000 --> 00:00:01.000\n<v Alice>hello\nyou</v>\n\nNOTE x\n\n00:02.000 --> 00:05.000\n"
        "<v Alice>- one here</v>\n<v Bob>- two here</v>\n\n00:10.000 --> 00:11.000\nnobody\n"
    )
    assert captions.tag_vtt(spark.createDataFrame([(2, vtt[:-1])], "media_id long, text string"), speech).first()["text"] == vtt[:-1]


def test_gain_policy(spark):
    rows = [(1, -38.19, -12.27), (2, -34.0, -20.0), (3, -21.8, -11.7), (4, -27.0, -15.0), (5, -35.8, -5.1), (6, -60.0, -45.0), (7, -70.0, -60.0)]
    df = spark.createDataFrame([(*r, 2) for r in rows], "file_id long, integrated double, true_peak double, channels int")
    got = {r["file_id"]: (r["verdict"], r["gain"]) for r in audio.decide(df, -24.0, 4.0).collect()}
    assert got == {1: ("gain", 10.2), 2: ("gain", 10.0), 3: ("normal", None), 4: ("normal", None), 5: ("no headroom", None), 6: ("gain", 20.0), 7: ("silent", None)}


def test_meter_text(spark):
    text = "Summary: old\nx\n Summary:\n  Integrated loudness:\n    I: -38.2 LUFS\n  LRA: 20.2 LU\n  True peak:\n    Peak: -12.3 dBFS\n"
    df = spark.createDataFrame([(1, text), (2, "nothing")], "file_id long, text string")
    assert [tuple(r) for r in probes.meter_levels(df).collect()] == [(1, -38.2, 20.2, -12.3)]


def replay(log):
    """The fold one event at a time."""
    rows = {}
    for e in sorted(log, key=lambda e: (e["ts"], e["id"])):
        key, kind = (e["p"], e["key"]), e["event"]
        if kind == "position" and e["d"] and e["pos"] >= 0.95 * e["d"]:
            kind = "ended"
        r = rows.get(key)
        if kind == "dismiss":
            prefix = e["key"].rsplit("|", 2)[0] + "|" if e["key"].startswith("tv|") else None
            for (p, k), row in rows.items():
                if p == e["p"] and (k == e["key"] or (prefix and k.startswith(prefix))):
                    row.update(pos=0, dismissed=True)
        elif kind == "forget":
            if r:
                r.update(pos=0, at=e["ts"])
                if not r["watched"]:
                    del rows[key]
        else:
            r = rows.setdefault(key, dict(watched=False, d=None))
            r.update(f=e["f"], at=e["ts"], dismissed=False, pos=e["pos"] if kind == "position" else 0)
            if kind == "ended":
                r["watched"] = True
            if kind == "seen":
                r["watched"] = e["seen"]
            elif e["d"] is not None:
                r["d"] = e["d"]
    return {k: (r["f"], r["pos"], r["d"], r["watched"], r["at"], r["dismissed"]) for k, r in rows.items()}


def test_watch_fold_against_replay(spark):
    rng = random.Random(7)
    keys = ["tv|a|1|1", "tv|a|1|2", "tv|b|1|1", "mv|x|2000", "f|9"]
    log = [
        dict(id=i, ts=i // 2, p=rng.randint(1, 3), key=rng.choice(keys), f=rng.randint(1, 5), event=rng.choice(["position", "position", "ended", "seen", "forget", "dismiss"]),
             pos=rng.randint(0, 100), d=rng.choice([None, 100, 100]), seen=rng.random() < 0.5)
        for i in range(600)
    ]
    df = spark.createDataFrame(
        [(e["id"], e["ts"], e["p"], e["key"], e["f"], e["event"], e["pos"], e["d"], e["seen"]) for e in log],
        "event_id long, ts long, profile_id long, key string, file_id long, event string, position_ms long, duration_ms long, seen boolean",
    )
    for n in (600, 450, 200, 60):
        got = {
            (r["profile_id"], r["key"]): (r["file_id"], r["position_ms"], r["duration_ms"], r["watched"], r["updated_at"], r["dismissed"])
            for r in watch.fold(df.filter(F.col("event_id") < n)).collect()
        }
        assert got == replay(log[:n])


def test_up_next(spark):
    works = spark.createDataFrame([("s", "S", s, e, f"t{s}{e}", s * 10 + e) for s, e in [(1, 1), (1, 2), (1, 3), (2, 1)]], "k_series string, series string, season int, episode int, title string, file_id long")
    places = watch.episode_places(works)
    schema = "profile_id long, key string, position_ms long, watched boolean, updated_at long"

    def pick(rows):
        got = watch.up_next(spark.createDataFrame(rows, schema), places).collect()
        return [(r["season"], r["episode"], r["part_way"]) for r in got]

    assert pick([(1, "tv|s|1|2", 5, False, 9), (1, "tv|s|1|1", 0, True, 8)]) == [(1, 2, True)]
    assert pick([(1, "tv|s|1|2", 0, True, 9)]) == [(1, 3, False)]
    assert pick([(1, "tv|s|1|2", 0, True, 9), (1, "tv|s|1|3", 0, True, 3)]) == [(2, 1, False)]
    assert pick([(1, "tv|s|1|1", 5, True, 9), (1, "tv|s|1|2", 0, True, 8)]) == [(1, 1, True)]
    assert pick([(1, "tv|s|2|1", 0, True, 9)]) == []


def noise(seed, n):
    out, x = [], seed
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(x >> 32)
    return out


def test_shared_runs(spark):
    m = segments.Matching(item_s=0.5)
    shared, other = noise(99, 60), noise(98, 40)
    a = noise(1, 40) + shared + noise(2, 200) + other + noise(7, 30)
    b = noise(3, 90) + shared + noise(4, 120) + other + noise(8, 100)
    c = noise(5, 10) + shared + noise(6, 300)
    rows = [("s", "head", f, f, i, v) for f, print_ in ((1, a), (2, b), (3, c)) for i, v in enumerate(print_)]
    prints = spark.createDataFrame(rows, "season string, part string, file_id long, episode long, pos long, item long")
    offsets = segments.votes(prints, m)
    spans = segments.spans(segments.runs(segments.aligned(prints, offsets, m), m), prints, m)
    ab = sorted((r for r in spans.collect() if (r["a_id"], r["b_id"]) == (1, 2)), key=lambda r: r["place"])
    # a chance match next to a run may stretch it by up to the gap
    near = lambda got, want: all(abs(g - w) <= 3.0 for g, w in zip(got, want))
    assert len(ab) == 2 and near((ab[0]["a_start"], ab[0]["b_start"]), (20.0, 45.0)) and near((ab[1]["a_start"], ab[1]["b_start"]), (150.0, 135.0))
    files = spark.createDataFrame([("s", f, f, 400.0) for f in (1, 2, 3)], "season string, file_id long, episode long, duration_s double")
    found = {r["file_id"]: (r["start_ms"], r["end_ms"], r["kind"]) for r in segments.detect(prints, files, m).collect()}
    assert {k: v[2] for k, v in found.items()} == {1: "intro", 2: "intro", 3: "intro"}
    for file_id, want in {1: (20_000, 50_000), 2: (45_000, 75_000), 3: (5_000, 35_000)}.items():
        assert all(abs(g - w) <= 3_000 for g, w in zip(found[file_id][:2], want))
    twins = spark.createDataFrame([("s", "head", f, f, i, v) for f in (1, 2) for i, v in enumerate(a)], prints.schema)
    none = segments.detect(twins, files.filter("file_id < 3"), m)
    assert none.count() == 0


def test_consensus(spark):
    told = spark.createDataFrame([("s", "head", 1, a, b) for a, b in [(10.0, 40.0), (11.0, 41.0), (90.0, 95.0)]] + [("s", "head", 2, 1.0, 2.0)], "season string, part string, file_id long, start double, end double")
    need = lambda n: spark.createDataFrame([("s", n)], "season string, need int")
    assert [(r["file_id"], r["start"], r["end"]) for r in segments.consensus(told, need(2)).collect()] == [(1, 11.0, 41.0)]
    assert segments.consensus(told, need(1)).count() == 2
