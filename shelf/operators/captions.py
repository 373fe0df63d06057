"""Captions: speakers by time overlap, voice tags, track choice and the sidecar audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelf.functions.text import words
from shelf.operators.windows import ordered_columns

MIN_CONFIDENCE = 0.9  # fixed value
BIN_S = 10.0

# fixed values: subtitle codecs that hold text, and those that hold pictures
TEXT_CODECS = ["subrip", "srt", "ass", "ssa", "mov_text", "webvtt", "text", "subviewer"]
BITMAP_CODECS = ["hdmv_pgs_subtitle", "dvd_subtitle", "dvb_subtitle", "xsub"]
TAG_PREFIX = "shelf; captions=srt:sha256:"


def confident(speech: DataFrame) -> DataFrame:
    """Speech scored at 0.9 or above, and speech without a score."""
    return speech.filter(F.col("confidence").isNull() | (F.col("confidence") >= MIN_CONFIDENCE))


def overlaps(units: DataFrame, speech: DataFrame, bin_s: float = BIN_S) -> DataFrame:
    """Pairs of a caption unit (media_id, unit, start_s, end_s) and speech that share time, with the shared seconds.

    Both sides are cut into time bins and meet by (media, bin), so a long film spreads
    over many keys; a pair is kept only in the first bin both touch.
    """
    def binned(df: DataFrame) -> DataFrame:
        low, high = F.floor(F.col("start_s") / bin_s), F.floor(F.col("end_s") / bin_s)
        return df.filter("end_s > start_s").withColumn("bin", F.explode(F.sequence(low, high)))

    c = binned(units.select("media_id", "unit", "start_s", "end_s")).alias("c")
    s = binned(speech.select("media_id", "speaker", F.col("start_s"), F.col("end_s"))).alias("s")
    both = c.join(s, (F.col("c.media_id") == F.col("s.media_id")) & (F.col("c.bin") == F.col("s.bin")))
    first = F.greatest(F.floor(F.col("c.start_s") / bin_s), F.floor(F.col("s.start_s") / bin_s)) == F.col("c.bin")
    meets = (F.col("s.start_s") < F.col("c.end_s")) & (F.col("s.end_s") > F.col("c.start_s"))
    shared = F.least("c.end_s", "s.end_s") - F.greatest("c.start_s", "s.start_s")
    return both.filter(first & meets).select(
        F.col("c.media_id").alias("media_id"), F.col("c.unit").alias("unit"), F.col("s.speaker").alias("speaker"),
        F.col("s.start_s").alias("speech_start"), shared.alias("shared_s"),
    )


def speakers(pairs: DataFrame) -> DataFrame:
    """The speaker heard longest in each unit; a tie goes to whoever speaks first."""
    totals = pairs.groupBy("media_id", "unit", "speaker").agg(
        F.round(F.sum("shared_s"), 9).alias("total"), F.min("speech_start").alias("first")
    )
    return totals.groupBy("media_id", "unit").agg(F.min_by("speaker", F.struct(-F.col("total"), "first", "speaker")).alias("speaker"))


def seconds(stamp: Column) -> Column:
    """hh:mm:ss.mmm or mm:ss.mmm as seconds."""
    parts = F.split(stamp, ":")
    n = F.size(parts)
    value = lambda i: F.get(parts, i).try_cast("double")
    secs = F.replace(F.get(parts, n - 1), F.lit(","), F.lit(".")).try_cast("double")
    mins = F.when(n >= 2, value(n - 2)).otherwise(F.lit(0.0))
    hours = F.when(n >= 3, value(n - 3)).otherwise(F.lit(0.0))
    return F.when(n <= 3, hours * 3600.0 + mins * 60.0 + secs)


def vtt_text(srt: Column) -> Column:
    """SubRip text as WebVTT: a header, and points for commas on timing lines."""
    body = F.regexp_replace(F.regexp_replace(srt, "\r\n", "\n"), "\n$", "")
    lines = F.transform(F.split(body, "\n"), lambda l: F.when(l.contains("-->"), F.translate(l, ",", ".")).otherwise(l))
    return F.when(srt == "", F.lit("WEBVTT\n\n")).otherwise(F.concat(F.lit("WEBVTT\n\n"), F.array_join(lines, "\n"), F.lit("\n")))


def is_dash_line(line: Column) -> Column:
    return line.rlike(r"^\s*(<[^>]*>\s*)*[-–—]")


def vtt_lines(texts: DataFrame) -> DataFrame:
    """WebVTT texts (media_id, text) as lines, each cue's payload marked with its cue and time slice.

    A text is one sidecar of at most 8 MiB, so a window per text is bounded. Lines of a
    dashed cue take slices of its time in proportion to their length.
    """
    split = texts.select("media_id", F.posexplode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line_no", "raw"))
    split = split.withColumn("line", F.regexp_replace("raw", "\r$", ""))
    by_text = Window.partitionBy("media_id").orderBy("line_no")
    sides = F.split("line", "-->", 2)
    start = seconds(F.trim(F.get(sides, F.lit(0))))
    end = seconds(F.regexp_extract(F.get(sides, F.lit(1)), r"^\s*(\S+)", 1))
    df = split.withColumn("block", F.sum(F.when(F.trim("line") == "", 1).otherwise(0)).over(by_text))
    timed = F.when(F.col("line").contains("-->") & (end >= start), F.struct(start.alias("s"), end.alias("e"), F.col("line_no").alias("at")))
    in_block = Window.partitionBy("media_id", "block")
    df = df.withColumn("cue", F.min_by(timed, F.when(timed.isNotNull(), F.col("line_no"))).over(in_block))
    payload = F.col("cue").isNotNull() & (F.col("line_no") > F.col("cue.at")) & (F.trim("line") != "")
    df = df.withColumn("cue_no", F.when(payload, F.col("cue.at")))
    per_cue = Window.partitionBy("media_id", "cue_no")
    so_far = per_cue.orderBy("line_no")
    length = F.greatest(F.length("line"), F.lit(1))
    df = df.withColumn("_n", F.when(payload, F.count(F.lit(1)).over(per_cue)))
    df = df.withColumn("dashed", payload & (F.col("_n") > 1) & F.min(is_dash_line(F.col("line"))).over(per_cue))
    share = (F.col("cue.e") - F.col("cue.s")) * length / F.sum(length).over(per_cue)
    df = df.withColumn("_share", F.when(F.col("dashed"), share))
    before = F.coalesce(F.sum("_share").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    df = df.withColumn("_before", F.when(F.col("dashed"), before)).withColumn("_r", F.when(payload, F.row_number().over(so_far)))
    return df.select(
        "media_id", "line_no", "line", "cue_no", "dashed",
        F.when(payload, F.when(F.col("dashed"), F.col("line_no")).otherwise(F.col("cue_no"))).alias("unit"),
        F.when(F.col("dashed"), F.col("cue.s") + F.col("_before")).otherwise(F.col("cue.s")).alias("start_s"),
        F.when(F.col("dashed"), F.col("cue.s") + F.col("_before") + F.col("_share")).otherwise(F.col("cue.e")).alias("end_s"),
        (F.col("_r") == 1).alias("opens"), (F.col("_r") == F.col("_n")).alias("closes"),
    )


def tag_vtt(texts: DataFrame, speech: DataFrame) -> DataFrame:
    """WebVTT texts with each cue in a voice span of its speaker; untouched where nobody is found."""
    lines = vtt_lines(texts)
    units = lines.filter("unit is not null").select("media_id", "unit", "start_s", "end_s").distinct()
    who = speakers(overlaps(units, confident(speech)))
    named = lines.join(who, ["media_id", "unit"], "left")
    single = F.col("dashed")
    opened = F.when(F.col("speaker").isNotNull() & (single | F.col("opens")), F.concat(F.lit("<v "), "speaker", F.lit(">"))).otherwise(F.lit(""))
    closed = F.when(F.col("speaker").isNotNull() & (single | F.col("closes")), F.lit("</v>")).otherwise(F.lit(""))
    voiced = named.select("media_id", "line_no", F.concat(opened, "line", closed).alias("out"))
    # the lines of one sidecar, at most 8 MiB
    rebuilt = voiced.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "out"))).alias("l"))
    ends = texts.select("media_id", F.when(F.col("text").endswith("\n"), "\n").otherwise("").alias("tail"))
    return rebuilt.join(ends, "media_id").select("media_id", F.concat(F.array_join("l.out", "\n"), "tail").alias("text"))


def is_english() -> Column:
    tag = F.lower("language")
    named = F.array_contains(words(F.coalesce("title", F.lit(""))), "english")
    return F.when(tag.isin("eng", "en"), True).when(tag.isNotNull() & (tag != "und"), False).otherwise(named)


def is_sdh() -> Column:
    return F.col("hearing_impaired") | F.arrays_overlap(
        words(F.coalesce("title", F.lit(""))), F.array(*[F.lit(w) for w in ("sdh", "cc", "hoh", "hearing")])
    )


def subtitle_tracks(streams: DataFrame) -> DataFrame:
    """Subtitle streams with their ordinal among the file's subtitle streams; a file has few streams."""
    ordinal = F.row_number().over(Window.partitionBy("file_id").orderBy("idx")) - 1
    return streams.filter("kind = 'subtitle'").withColumn("ordinal", ordinal)


def best_text_track(tracks: DataFrame) -> DataFrame:
    """The text track to show: not forced, English, for the hard of hearing, default, earliest."""
    chosen = tracks.filter(F.col("codec").isin(TEXT_CODECS))
    return chosen.groupBy("file_id").agg(F.max_by("ordinal", _text_rank()).alias("ordinal"))


def _text_rank() -> Column:
    return F.struct(~F.col("forced"), is_english(), is_sdh(), F.col("is_default"), -F.col("ordinal"))


def embedded_class(files: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per file: the text track's ordinal, 'bitmap' when it only has pictures, or 'none'; tracks are read once."""
    text = F.when(F.col("codec").isin(TEXT_CODECS), _text_rank())
    found = tracks.groupBy("file_id").agg(F.count(F.lit(1)).alias("tracks"), F.max_by("ordinal", text).alias("ordinal"))
    return (
        files.select("file_id").join(found, "file_id", "left")
        .select("file_id", F.when(F.col("ordinal").isNotNull(), F.col("ordinal").cast("string"))
                .when(F.col("tracks") > 0, "bitmap").otherwise("none").alias("embedded"))
    )


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def recorded_hash(encoder: Column, prefix: str = TAG_PREFIX) -> Column:
    """The sidecar hash in a file's encoder tag, null when the tag is not ours."""
    quoted = "".join("\\" + ch if not ch.isalnum() and ch not in " _" else ch for ch in prefix)
    return F.nullif(F.regexp_extract(F.trim(encoder), rf"^{quoted}([0-9a-fA-F]{{64}})(?:[\s;].*)?$", 1), F.lit(""))


def cues_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """media_id and whether two cue tables (media_id, pos, start_ms, end_ms, words) say the same in order.

    Cues are numbered per text and matched by number, never gathered into one list.
    """
    def numbered(df: DataFrame) -> DataFrame:
        return ordered_columns(df, ["media_id"], ["pos"], n=("row_number",)).drop("pos")

    left, right = numbered(a).alias("l"), numbered(b).alias("r")
    pair = left.join(right, (F.col("l.media_id") == F.col("r.media_id")) & (F.col("l.n") == F.col("r.n")), "full")
    same = (
        (F.col("l.start_ms") == F.col("r.start_ms")) & (F.col("l.end_ms") == F.col("r.end_ms")) & (F.col("l.words") == F.col("r.words"))
    )
    return pair.groupBy(F.coalesce("l.media_id", "r.media_id").alias("media_id")).agg(
        F.min(F.coalesce(same, F.lit(False))).alias("same")
    )


def caption_action(pairs: DataFrame, adopt_all: bool = False) -> DataFrame:
    """What to do with each (video, sidecar) pair.

    ``pairs`` has media, is_mp4, srt_bytes, srt_text (null when undecodable), video_streams,
    text_tracks, encoder, canonical (remembered hash) and cues_same.
    """
    own = content_hash(F.col("srt_text"))
    known = F.coalesce(recorded_hash(F.col("encoder")), F.col("canonical"))
    action = (
        F.when(~F.col("is_mp4"), "not mp4")
        .when(F.col("srt_bytes").isNull(), "no .srt sidecar")
        .when(F.col("srt_bytes") == 0, "srt is empty")
        .when(F.col("srt_text").isNull(), "srt encoding unrecognized")
        .when(F.col("video_streams") == 0, "no video stream")
        .when(F.col("text_tracks") == 0, "embed")
        .when(known == own, "up to date")
        .when((F.col("text_tracks") != 1) & known.isNotNull(), "subtitle layout changed since embedding")
        .when(F.col("text_tracks") != 1, "already has text subtitles")
        .when(known.isNotNull(), "replace")
        .when(F.col("cues_same"), "adopt")
        .when(F.lit(adopt_all), "replace")
        .otherwise("already has text subtitles; they differ from the sidecar")
    )
    done = action.isin("embed", "replace", "adopt", "up to date")
    return pairs.withColumn("action", action).withColumn("new_canonical", F.when(done, own))


def changed_pairs(pairs: DataFrame, memory: DataFrame, adopt_all: bool = False) -> DataFrame:
    """Pairs (media, media_stamp, srt_stamp) that differ from their last look, with the remembered hash."""
    past = memory.select("media", F.col("media_stamp").alias("_m"), F.col("srt_stamp").alias("_s"), "canonical")
    same = F.col("_m").eqNullSafe(F.col("media_stamp")) & F.col("_s").eqNullSafe(F.col("srt_stamp")) & F.col("_m").isNotNull()
    again = F.lit(adopt_all) & F.col("canonical").isNull()
    return pairs.join(past, "media", "left").filter(~same | again).drop("_m", "_s")


def remember(memory: DataFrame, looked: DataFrame, seen: DataFrame, walked_roots: DataFrame) -> DataFrame:
    """The memory after a run: new looks in, a skip keeping its old hash, vanished pairs under walked roots out."""
    news = looked.select("media", "media_stamp", "srt_stamp", "note", F.col("canonical").alias("_new"))
    old = memory.select("media", F.col("media_stamp").alias("_m"), F.col("srt_stamp").alias("_s"), F.col("note").alias("_n"), F.col("canonical").alias("_old"))
    joined = old.join(news, "media", "full").select(
        "media", F.coalesce("media_stamp", "_m").alias("media_stamp"), F.coalesce("srt_stamp", "_s").alias("srt_stamp"),
        F.coalesce("note", "_n").alias("note"), F.coalesce("_new", "_old").alias("canonical"),
    )
    return forget_unseen(joined, seen, walked_roots)


def forget_unseen(memory: DataFrame, seen: DataFrame, walked_roots: DataFrame) -> DataFrame:
    """Entries stay when seen, or when they lie under no walked root."""
    parts = F.split("media", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    roots = walked_roots.select(F.regexp_replace("path", "/+$", "").alias("_root")).distinct()
    unseen = memory.join(seen.select("media").distinct(), "media", "left_anti")
    gone = unseen.select("media", F.explode(above).alias("_root")).join(roots, "_root", "left_semi").select("media")
    return memory.join(gone, "media", "left_anti")
