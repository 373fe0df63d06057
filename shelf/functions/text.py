"""Text clean-up and validity rules shared by the sidecar readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS = 8 * 1024  # fixed value: longest stored text

# fixed values: what the bytes 0x80 to 0x9F stand for in Windows-1252, unassigned ones kept as they are
CP1252 = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹",
    0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™",
    0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}


def clean(text: Column) -> Column:
    """Trimmed text without control characters (line breaks and tabs stay), bounded; null when empty."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"[\p{Cc}&&[^\n\t]]", "")
    return F.nullif(F.substring(bare, 1, MAX_CHARS), F.lit(""))


def iso_date(text: Column) -> Column:
    """YYYY-MM-DD or YYYY from 1801 to 2199; anything else is null."""
    t = F.trim(text)
    shaped = t.rlike(r"^\d{4}(-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01]))?$")
    year = F.when(shaped, F.substring(t, 1, 4).try_cast("int"))
    return F.when((year >= 1801) & (year < 2200), t)


def decode_subtitle(content: Column) -> Column:
    """Subtitle bytes as text: UTF-16 by its mark, UTF-8, or Windows-1252 when at least 95 % ASCII."""
    mark = F.hex(F.substring(content, 1, 2))
    body = F.substring(content, 3, 2**31 - 1)
    even = F.substring(body, F.lit(1), (F.length(body) - F.length(body) % 2).cast("int"))
    raw = content.cast("string")
    single = F.decode(content, "ISO-8859-1")
    ascii_bytes = F.length(F.regexp_replace(single, r"[^\x00-\x7F]", ""))
    western = F.translate(single, "".join(map(chr, CP1252)), "".join(CP1252.values()))
    return (
        F.when(mark == "FFFE", F.decode(even, "UTF-16LE"))
        .when(mark == "FEFF", F.decode(even, "UTF-16BE"))
        .when(F.is_valid_utf8(raw), F.regexp_replace(raw, "^﻿", ""))
        .when(ascii_bytes / F.length(content) >= 0.95, western)
    )


def frame_rate(text: Column) -> Column:
    """A rational such as 24000/1001 as frames per second, over 0 and up to 1000."""
    parts = F.split(text, "/")
    top = F.trim(F.get(parts, F.lit(0))).try_cast("double")
    bottom = F.when(F.size(parts) == 1, F.lit(1.0)).otherwise(F.trim(F.get(parts, F.lit(1))).try_cast("double"))
    fps = F.try_divide(top, bottom)
    return F.when((fps > 0) & (fps <= 1000), fps)


def audio_label(codec: Column, profile: Column) -> Column:
    """Readable name of an audio codec with its profile."""
    fixed = {  # fixed values
        "ac3": "AC-3 (Dolby Digital)", "eac3": "E-AC-3 (Dolby Digital Plus)", "truehd": "Dolby TrueHD", "mp3": "MP3",
        "mp2": "MP2", "flac": "FLAC", "alac": "ALAC (Apple Lossless)", "opus": "Opus", "vorbis": "Vorbis",
    }
    aac = (
        F.when(profile.isNull() | (profile == "LC"), "AAC LC").when(profile == "HE-AAC", "HE-AAC")
        .when(profile == "HE-AACv2", "HE-AAC v2").otherwise(F.concat(F.lit("AAC "), profile))
    )
    dts = F.when(profile.isNull(), "DTS").otherwise(F.replace(F.concat(F.lit("DTS "), profile), F.lit("DTS DTS"), F.lit("DTS")))
    out = F.when(codec == "aac", aac).when(codec == "dts", dts).when(codec.startswith("pcm_"), "PCM")
    for name, label in fixed.items():
        out = out.when(codec == name, label)
    return out.otherwise(F.upper(codec))


def words(text: Column) -> Column:
    """Lower-case alphanumeric words of a label."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")
