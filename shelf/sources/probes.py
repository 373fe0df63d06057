"""Output of media probes as tables: format and stream JSON, stream listings, meter summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.functions.names import let
from shelf.functions.text import audio_label, frame_rate

PROBE = """
format struct<duration: string, format_name: string, tags: struct<genre: string, GENRE: string, Genre: string>>,
streams array<struct<codec_type: string, codec_name: string, profile: string, width: bigint, height: bigint,
  avg_frame_rate: string, r_frame_rate: string, bit_rate: string, sample_rate: string, channels: string,
  bits_per_raw_sample: string, bits_per_sample: string>>,
chapters array<struct<start_time: string, end_time: string, tags: struct<title: string>>>
"""


def _probe(json: Column) -> Column:
    return F.from_json(json, PROBE)


def tech_columns(probes: DataFrame) -> DataFrame:
    """(file_id, json) probe output with the technical columns of a catalog file; unreadable JSON gives nulls."""
    p = probes.withColumn("p", _probe(F.col("json")))

    def first(kind: str) -> Column:
        # the first stream of its type that names a codec
        return F.try_element_at(
            F.filter("p.streams", lambda s: (s["codec_type"] == kind) & s["codec_name"].isNotNull()), F.lit(1)
        )

    v, a = first("video"), first("audio")
    num = lambda name: a[name].try_cast("long")
    positive = lambda c: F.when(c > 0, c)
    fmt = F.col("p.format")
    genre = F.coalesce(*[F.get_json_object("json", f"$.format.tags.{k}") for k in ("genre", "GENRE", "Genre")])
    return p.select(
        *[c for c in probes.columns if c != "json"],
        F.element_at(F.split(fmt["format_name"], ","), 1).alias("container"),
        (fmt["duration"].try_cast("double") * 1000).cast("long").alias("duration_ms"),
        v["width"].alias("width"), v["height"].alias("height"),
        F.coalesce(frame_rate(v["avg_frame_rate"]), frame_rate(v["r_frame_rate"])).alias("frame_rate"),
        v["codec_name"].alias("video_codec"), a["codec_name"].alias("audio_codec"),
        F.when(a["codec_name"].isNotNull(), audio_label(a["codec_name"], a["profile"])).alias("audio_profile"),
        positive(F.floor(num("bit_rate") / 1000).cast("long")).alias("audio_bitrate"), num("sample_rate").alias("audio_sample_rate"),
        positive(F.coalesce(num("bits_per_raw_sample"), num("bits_per_sample"))).alias("audio_bit_depth"),
        num("channels").alias("audio_channels"), genre.alias("tag_genre"),
    )


def chapters(probes: DataFrame) -> DataFrame:
    """Chapter rows with both times known."""
    ms = lambda c: (c.try_cast("double") * 1000).cast("long")
    rows = probes.select("file_id", F.posexplode(_probe(F.col("json"))["chapters"]).alias("pos", "c"))
    return rows.select(
        "file_id", "pos", ms(F.col("c.start_time")).alias("start_ms"), ms(F.col("c.end_time")).alias("end_ms"),
        F.coalesce("c.tags.title", F.lit("")).alias("title"),
    ).filter("start_ms is not null and end_ms is not null")


# fixed values: what a stream's block calls its columns, in lower case
STREAM_KEYS = {
    "index": "index", "kind": "codec_type", "codec": "codec_name", "channels": "channels", "language": "tag:language", "own": "tag:title",
    "handler": "tag:handler_name", "default": "disposition:default", "forced": "disposition:forced", "impaired": "disposition:hearing_impaired",
}


def streams(listings: DataFrame) -> DataFrame:
    """Stream listings (file_id, text of [STREAM] blocks) as one row per stream.

    Serves every census: subtitle choice, audio choice, remux and caption decisions. A
    key repeated within a block counts by its last value; tag names come in either case.
    A block is read inside the generator, so no filter on a stream's columns reads it again.
    """
    blocks = F.regexp_extract_all("text", F.lit(r"(?s)\[STREAM\](.*?)\[/STREAM\]"), 1)

    def pair(line: Column) -> Column:
        value = F.substr(line, F.instr(line, "=") + 1)
        return F.struct(
            F.lower(F.ltrim(F.substring_index(line, "=", 1), F.lit(" \t"))).alias("key"), F.trim(F.substring_index(value, "\r", 1)).alias("value")
        )

    def read(b: Column, at: Column) -> Column:
        value = lambda key: F.get(b["values"], (F.array_position(b["keys"], key) - 1).cast("int"))
        dovi = F.exists(b["pairs"], lambda p: (p["key"] == "side_data_type") & F.lower(p["value"]).contains("dovi"))
        # each key is looked up once, whatever uses its value
        return let(F.struct(*[value(key).alias(name) for name, key in STREAM_KEYS.items()], dovi.alias("dovi")), lambda v: made(v, at))

    def made(v: Column, at: Column) -> Column:
        flag = lambda c: F.coalesce(c == "1", F.lit(False))
        handler, own, kind = v["handler"], v["own"], v["kind"]
        return F.struct(
            at.alias("idx"), F.coalesce(v["index"].try_cast("int"), at).alias("stream_index"),
            F.when(kind.isin("video", "audio", "subtitle"), kind).otherwise("other").alias("kind"),
            F.coalesce(v["codec"], F.lit("")).alias("codec"), F.coalesce(v["channels"].try_cast("int"), F.lit(0)).alias("channels"),
            v["language"].alias("language"), F.coalesce(own, F.when(handler != "SubtitleHandler", handler)).alias("title"), own.alias("own_title"),
            F.concat(F.coalesce(F.concat(own, F.lit(" ")), F.lit("")), F.coalesce(F.concat(handler, F.lit(" ")), F.lit(""))).alias("label"),
            flag(v["default"]).alias("is_default"), flag(v["forced"]).alias("forced"), flag(v["impaired"]).alias("hearing_impaired"),
            F.coalesce(v["dovi"], F.lit(False)).alias("dolby_vision"),
        )

    def stream(block: Column, at: Column) -> Column:
        lines = F.filter(F.split(block, "\n"), lambda line: line.contains("="))
        # the last of equal keys comes first
        found = let(F.reverse(F.transform(lines, pair)), lambda p: F.struct(p.alias("pairs"), p["key"].alias("keys"), p["value"].alias("values")))
        return let(found, lambda b: read(b, at))

    return listings.select("file_id", F.inline(F.transform(blocks, stream)))


def meter_levels(summaries: DataFrame) -> DataFrame:
    """Loudness-meter output (file_id, text) as integrated, range and peak; without a summary no row.

    The values are read inside a generator: a filter above a projection would read the text again for each of its terms.
    """
    tail = F.when(F.col("text").contains("Summary:"), F.substring_index("text", "Summary:", -1))

    def value(text: Column, label: str) -> Column:
        v = F.regexp_extract(text, rf"(?m)^[ \t]*{label}:[ \t]*(\S+)", 1).try_cast("double")
        return let(v, lambda v: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v))

    labels = {"integrated": "I", "loudness_range": "LRA", "true_peak": "Peak"}
    levels = let(tail, lambda t: F.struct(*[value(t, label).alias(name) for name, label in labels.items()]))
    whole = F.filter(F.array(levels), lambda s: s["integrated"].isNotNull() & s["loudness_range"].isNotNull() & s["true_peak"].isNotNull())
    return summaries.select("file_id", F.inline(whole))
