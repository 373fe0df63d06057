"""Decisions about audio tracks: loudness raises, source choice, remux eligibility and track names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelf.operators.captions import BITMAP_CODECS, TEXT_CODECS

# fixed values: decibels, and the label of a stereo twin
CEILING = -2.0
MAX_GAIN = 20.0
SILENCE = -69.0
TWIN_LABEL = "Stereo (AAC)"
MARK = "(shelf)"

# fixed values: codecs an MP4 can carry, and those that get a stereo twin
VIDEO_OK = ["h264", "hevc", "av1"]
AUDIO_COPY = ["aac", "mp3", "opus", "alac", "ac3", "eac3"]
AUDIO_TWIN = ["ac3", "eac3"]

# fixed values: language tags by the name shown to viewers
LANGUAGES = {
    "English": ["eng", "en"], "French": ["fre", "fra", "fr"], "German": ["ger", "deu", "de"], "Spanish": ["spa", "es"],
    "Italian": ["ita", "it"], "Portuguese": ["por", "pt"], "Dutch": ["dut", "nld", "nl"], "Swedish": ["swe", "sv"],
    "Norwegian": ["nor", "nob", "no"], "Danish": ["dan", "da"], "Finnish": ["fin", "fi"], "Polish": ["pol", "pl"],
    "Czech": ["cze", "ces", "cs"], "Hungarian": ["hun", "hu"], "Greek": ["gre", "ell", "el"], "Russian": ["rus", "ru"],
    "Ukrainian": ["ukr", "uk"], "Turkish": ["tur", "tr"], "Hebrew": ["heb", "he"], "Arabic": ["ara", "ar"], "Hindi": ["hin", "hi"],
    "Japanese": ["jpn", "ja"], "Korean": ["kor", "ko"], "Chinese": ["chi", "zho", "zh"], "Thai": ["tha", "th"],
}


def verdict(integrated: Column, peak: Column, target: float, min_gain: float) -> Column:
    """struct(verdict, gain, wanted, headroom): how far a track can be raised towards the target without clipping."""
    wanted = F.lit(target) - integrated
    headroom = F.lit(CEILING) - peak
    gain = F.least(wanted, headroom, F.lit(MAX_GAIN))
    kind = F.when(wanted < min_gain, "normal").when(gain < min_gain, "no headroom").otherwise("gain")
    return F.struct(
        kind.alias("verdict"), F.when(kind == "gain", F.floor(gain * 10) / 10).alias("gain"), wanted.alias("wanted"), headroom.alias("headroom")
    )


def decide(levels: DataFrame, target: float, min_gain: float) -> DataFrame:
    """Levels (file_id, integrated, true_peak, channels and optionally mix_integrated, mix_peak) with the raise they get.

    A quiet source wider than stereo also gets a mixdown: its own gain where it earns
    one, else as much of the source's as its peaks allow.
    """
    df = levels
    for c in ("mix_integrated", "mix_peak"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    df = df.withColumn("_v", verdict(F.col("integrated"), F.col("true_peak"), target, min_gain))
    df = df.withColumn("_m", verdict(F.col("mix_integrated"), F.col("mix_peak"), target, min_gain))
    silent = F.col("integrated") <= SILENCE
    kind = F.when(silent, "silent").otherwise(F.col("_v.verdict"))
    rest = F.floor(F.greatest(F.least(F.col("_v.gain"), F.lit(CEILING) - F.col("mix_peak")), F.lit(0.0)) * 10) / 10
    wide = (kind == "gain") & (F.col("channels") > 2) & F.col("mix_peak").isNotNull()
    return df.select(
        *[c for c in levels.columns], kind.alias("verdict"), F.when(kind == "gain", F.col("_v.gain")).alias("gain"),
        F.when(wide, F.when(F.col("_m.verdict") == "gain", F.col("_m.gain")).otherwise(rest)).alias("mixdown_gain"),
    )


def gain_text(gain: Column) -> Column:
    return F.format_string("%+.1f dB", gain)


def raised_label(gain: Column, twin: bool, mark: str = MARK) -> Column:
    """The name a raised track carries, by which later runs know the file is done."""
    head = f"{TWIN_LABEL}, normalized " if twin else "Normalized "
    return F.concat(F.lit(head), gain_text(gain), F.lit(" " + mark))


def is_marked(label: Column, mark: str = MARK) -> Column:
    return F.lower(label).contains("normalized") & F.lower(label).contains(mark.lower())


def census(streams: DataFrame) -> DataFrame:
    """Streams per file by kind."""
    return streams.groupBy("file_id").pivot("kind", ["video", "audio", "subtitle"]).agg(F.count(F.lit(1))).na.fill(0)


def audio_streams(streams: DataFrame) -> DataFrame:
    """Audio streams with their ordinal and the one behind them; a file has few streams."""
    order = Window.partitionBy("file_id").orderBy("idx")
    behind = F.lead(F.struct("stream_index", "codec", "channels", "language")).over(order)
    return streams.filter("kind = 'audio'").withColumn("ordinal", F.row_number().over(order) - 1).withColumn("behind", behind)


def dialogue_stream(streams: DataFrame) -> DataFrame:
    """The default-flagged stream, else the widest (the later of equals)."""
    a = audio_streams(streams)
    flagged = F.min_by(F.struct("ordinal", "channels"), F.when(F.col("is_default"), F.col("ordinal")))
    widest = F.max_by(F.struct("ordinal", "channels"), F.struct("channels", "ordinal"))
    return a.groupBy("file_id").agg(F.coalesce(flagged, widest).alias("d")).select("file_id", "d.ordinal", "d.channels")


def language_name(tag: Column) -> Column:
    out = None
    for name, tags in LANGUAGES.items():
        hit = F.lower(tag).isin(*tags)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def layout_name(channels: Column) -> Column:
    return (
        F.when(channels == 0, "").when(channels == 1, "mono").when(channels == 2, "stereo").when(channels == 6, "5.1")
        .when(channels == 8, "7.1").otherwise(F.concat(channels.cast("string"), F.lit("ch")))
    )


def track_name(title: Column, codec: Column, channels: Column, language: Column) -> Column:
    """A track's own title, else its language, layout and Dolby kind."""
    own = F.nullif(F.trim(title), F.lit(""))
    dolby = F.when(codec == "ac3", " Dolby Digital").when(codec == "eac3", " Dolby Digital Plus").otherwise("")
    layout = F.when(channels == 1, "Mono").when(channels == 2, "Stereo").otherwise(layout_name(channels))
    return F.coalesce(own, F.trim(F.concat_ws(" ", language_name(language), F.concat(layout, dolby))))


def twin_name(language: Column) -> Column:
    return F.concat_ws(" ", language_name(language), F.lit("Stereo Mixdown"))


def raise_plan(streams: DataFrame, mark: str = MARK) -> DataFrame:
    """What a raise would be made from: (file_id, reason, source, channels, dropped, mixdown_name).

    The playing track, or the multichannel or Dolby track behind a bare stereo twin,
    which is then dropped.
    """
    audio = F.col("kind") == "audio"
    # a file has few streams; gathered by file before the shuffle, they are read once and not sorted as rows
    fields = F.struct("idx", "stream_index", "codec", "channels", "language", "label", "is_default")
    per = streams.groupBy("file_id").agg(
        F.count_if(F.col("kind") == "video").alias("videos"), F.max(F.when(audio, is_marked(F.col("label"), mark))).alias("marked"),
        F.sort_array(F.collect_list(F.when(audio, fields))).alias("a"),
    )
    flagged = F.array_position(F.transform("a", lambda s: s["is_default"]), True)
    at = F.greatest(flagged - 1, F.lit(0)).cast("int")
    df = per.select("file_id", "videos", "marked", F.get("a", at).alias("p"), F.get("a", at + 1).alias("behind"))
    back = F.col("behind")
    bare = F.col("p.label").contains(TWIN_LABEL) & back.isNotNull() & (back["codec"].isin(AUDIO_TWIN) | (back["channels"] > 2))
    bare = F.coalesce(bare, F.lit(False))
    reason = (
        F.when(F.col("videos") == 0, "no video stream").when(F.col("marked"), "already carries a normalized track")
        .when(F.col("p").isNull(), "no audio stream")
    )
    fine = reason.isNull()
    language = F.when(bare, back["language"]).otherwise(F.col("p.language"))
    return df.select(
        "file_id", reason.alias("reason"), F.when(fine, F.when(bare, back["stream_index"]).otherwise(F.col("p.stream_index"))).alias("source"),
        F.when(fine, F.greatest(F.when(bare, back["channels"]).otherwise(F.col("p.channels")), F.lit(1))).alias("channels"),
        F.when(fine & bare, F.col("p.stream_index")).alias("dropped"), F.when(fine, twin_name(language)).alias("mixdown_name"),
    )


def remux_plan(streams: DataFrame, srt_files: DataFrame) -> DataFrame:
    """Whether each file can become an MP4, the first thing against it in stream order, and what would be added.

    ``srt_files`` lists file_ids with a usable sidecar: with one, picture subtitles are
    dropped instead of refused, and it is embedded where no text track survives.
    """
    order = Window.partitionBy("file_id").orderBy("idx")
    audio_order = Window.partitionBy("file_id", "kind").orderBy("idx")
    df = streams.join(srt_files.select("file_id").distinct().withColumn("_srt", F.lit(True)), "file_id", "left").withColumn("_srt", F.coalesce("_srt", F.lit(False)))
    kind, codec = F.col("kind"), F.col("codec")
    playing = F.coalesce(
        F.min(F.when((kind == "audio") & F.col("is_default"), F.col("idx"))).over(Window.partitionBy("file_id")),
        F.min(F.when(kind == "audio", F.col("idx"))).over(Window.partitionBy("file_id")),
    )
    twinned = F.coalesce(F.lag("label").over(audio_order).contains(TWIN_LABEL), F.lit(False))
    twin = (kind == "audio") & ~twinned & (codec.isin(AUDIO_TWIN) | ((F.col("idx") == playing) & (F.col("channels") > 2)))
    refused = (
        F.when((kind == "video") & F.col("dolby_vision"), "Dolby Vision (MP4 signalling is unreliable)")
        .when((kind == "video") & ~codec.isin(VIDEO_OK), F.concat(F.lit("video codec "), codec, F.lit(" is not MP4/browser material")))
        .when((kind == "audio") & ~codec.isin(AUDIO_COPY), F.concat(F.lit("audio codec "), codec, F.lit(" is not MP4-safe")))
        .when((kind == "subtitle") & codec.isin(BITMAP_CODECS) & ~F.col("_srt"), F.concat(F.lit("bitmap subtitles ("), codec, F.lit(") cannot live in MP4")))
        .when((kind == "subtitle") & ~codec.isin(BITMAP_CODECS) & ~codec.isin(TEXT_CODECS), F.concat(F.lit("subtitle codec "), codec, F.lit(" unknown")))
    )
    note = (
        F.when((kind == "subtitle") & codec.isin(BITMAP_CODECS), F.concat(codec, F.lit(" bitmap subtitles dropped, .srt sidecar covers them")))
        .when((kind == "subtitle") & codec.isin("ass", "ssa"), "ASS subtitle styling reduced to plain mov_text")
    )
    marked = df.withColumn("_twin", twin).withColumn("_no", refused).withColumn("_note", note)
    marked = marked.withColumn("_reason", F.when(F.col("_twin"), F.trim(F.concat(codec, F.lit(" "), layout_name(F.col("channels"))))))
    # equal neighbours among the notes count once
    marked = marked.withColumn("_last", F.last("_note", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("_note", F.when(~F.col("_last").eqNullSafe(F.col("_note")), F.col("_note")))
    listed = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("idx", F.col(c).alias("v")))))
    per = marked.groupBy("file_id").agg(
        F.min_by("_no", F.when(F.col("_no").isNotNull(), F.col("idx"))).alias("_first_no"), F.count_if(kind == "video").alias("videos"),
        F.count_if(kind == "audio").alias("audios"), F.count_if(F.col("_twin")).alias("twins"),
        F.count_if((kind == "subtitle") & codec.isin(TEXT_CODECS)).alias("texts"), F.max("_srt").alias("_srt"),
        listed("_reason").alias("_reasons"), listed("_note").alias("_notes"),
    )
    against = F.coalesce(F.col("_first_no"), F.when(F.col("videos") == 0, "no video stream").when(F.col("audios") == 0, "no audio stream"))
    embed = against.isNull() & F.col("_srt") & (F.col("texts") == 0)
    notes = F.concat(F.transform("_notes", lambda x: x["v"]), F.when(embed, F.array(F.lit(".srt sidecar embedded as the subtitle track"))).otherwise(F.array().cast("array<string>")))
    fine = against.isNull()
    return per.select(
        "file_id", fine.alias("eligible"), against.alias("reason"), F.when(fine, F.col("twins")).alias("twins"),
        F.when(fine, F.array_join(F.transform("_reasons", lambda x: x["v"]), ", ")).alias("twin_reasons"), embed.alias("embed_srt"),
        F.when(fine, F.array_join(notes, "; ")).alias("notes"),
    )


def memory_key(path: Column) -> Column:
    """Loudness memory is keyed without the extension, so a remux keeps its entry."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def unsettled(files: DataFrame, memory: DataFrame) -> DataFrame:
    """Files (path, stamp) whose stamp differs from the remembered one."""
    past = memory.select("key", F.col("stamp").alias("_stamp"))
    df = files.withColumn("key", memory_key(F.col("path"))).join(past, "key", "left")
    return df.filter(~F.col("_stamp").eqNullSafe(F.col("stamp"))).drop("_stamp")


def remember(memory: DataFrame, looked: DataFrame, restamped: DataFrame, done: DataFrame, existing: DataFrame) -> DataFrame:
    """Loudness memory (key, file, stamp, note, integrated, true_peak, gain) after a run.

    New looks replace entries; restamped files keep their measurement under a new stamp;
    files found done keep a known gain or get a note; entries of vanished files go.
    """
    cols = ["key", "file", "stamp", "note", "integrated", "true_peak", "gain"]
    keyed = lambda df, tag: df.select(memory_key(F.col("path")).alias("key"), F.col("path").alias(f"_{tag}_file"), F.col("stamp").alias(f"_{tag}_stamp"))
    new = looked.select(memory_key(F.col("path")).alias("key"), F.col("path").alias("file"), "stamp", "note", "integrated", "true_peak", "gain")
    old = memory.select(*cols).join(new.select("key"), "key", "left_anti")
    old = old.join(keyed(restamped, "r"), "key", "left").withColumn("stamp", F.coalesce("_r_stamp", "stamp")).withColumn("file", F.coalesce("_r_file", "file"))
    joined = old.select(*cols).join(keyed(done, "d"), "key", "full_outer")
    found = F.col("_d_file").isNotNull()
    kept = found & F.col("gain").isNotNull()
    clear = lambda c: F.when(found & ~kept, F.lit(None)).otherwise(F.col(c)).alias(c)
    settled = joined.select(
        "key", F.coalesce("_d_file", "file").alias("file"), F.coalesce("_d_stamp", "stamp").alias("stamp"),
        F.when(found & ~kept, "normalized earlier").otherwise(F.col("note")).alias("note"), clear("integrated"), clear("true_peak"), clear("gain"),
    )
    settled = settled.join(new.select("key"), "key", "left_anti")
    return settled.unionByName(new).join(existing.select(F.col("path").alias("file")).distinct(), "file", "left_semi").select(*cols)
