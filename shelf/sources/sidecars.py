"""Sidecar texts read in bulk: descriptions, edit lists, diarizations, captions, music overrides.

Readers take a table of files (a key and the text) and return typed columns or rows, so
any number of files is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.functions.names import base_name, folders, let
from shelf.functions.text import clean, iso_date

NFO_XML = (
    "title array<string>, showtitle array<string>, year array<string>, season array<string>, seasonnumber array<string>, "
    "episode array<string>, plot array<string>, aired array<string>, premiered array<string>, genre array<string>, "
    "director array<string>, rating array<string>, `set` array<string>, "
    "uniqueid array<struct<_VALUE: string, _type: string>>, _corrupt_record string"
)


def nfo_fields(text: Column) -> Column:
    """Description XML as typed columns; malformed text gives nulls and empty lists."""
    parsed = F.from_xml(text, NFO_XML, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return let(parsed, lambda x: _nfo_struct(text, x))


def _nfo_struct(text: Column, x: Column) -> Column:
    sound = x["_corrupt_record"].isNull()

    def values(name: str) -> Column:
        kept = F.filter(F.transform(x[name], clean), lambda v: v.isNotNull() & ~v.startswith("<"))
        return F.when(sound, kept)

    def first(name: str) -> Column:
        return F.try_element_at(values(name), F.lit(1))

    def listed(name: str) -> Column:
        return F.coalesce(values(name), F.array().cast("array<string>"))

    def valid(array: Column, test) -> Column:
        return F.try_element_at(F.filter(array, test), F.lit(1))

    year = first("year").try_cast("int")
    # two names for one number; the one that stands first in the document counts
    named = F.regexp_instr(text, F.lit(r"<season[\s>]")) < F.regexp_instr(text, F.lit(r"<seasonnumber[\s>]"))
    either = F.coalesce(first("season"), first("seasonnumber"))
    season = F.when(first("season").isNotNull() & first("seasonnumber").isNotNull() & ~named, first("seasonnumber")).otherwise(either).try_cast("int")
    number = first("episode").try_cast("int")
    ratings = F.transform(values("rating"), lambda v: v.try_cast("double"))
    ids = F.when(sound, F.filter(x["uniqueid"], lambda u: (u["_type"] == "imdb") & F.trim(u["_VALUE"]).rlike(r"^tt\d{7,9}$")))
    return F.struct(
        first("title").alias("title"), F.when((year >= 1801) & (year < 2200), year).alias("year"),
        listed("genre").alias("genres"), listed("director").alias("directors"),
        valid(ratings, lambda r: ~F.isnan(r) & (r >= 0) & (r <= 10)).alias("rating"), first("plot").alias("plot"),
        F.trim(F.try_element_at(ids, F.lit(1))["_VALUE"]).alias("imdb_id"), first("set").alias("collection"),
        first("showtitle").alias("show_title"), F.when(season >= 0, season).alias("season"), F.when(number >= 0, number).alias("episode"),
        valid(F.transform(values("aired"), iso_date), lambda d: d.isNotNull()).alias("aired"),
        valid(F.transform(values("premiered"), iso_date), lambda d: d.isNotNull()).alias("premiered"),
    )


def read_nfo(texts: DataFrame) -> DataFrame:
    """(path, text) files with their description fields."""
    return texts.withColumn("n", nfo_fields(F.col("text"))).select(*[c for c in texts.columns if c != "text"], "n.*")


def folder_facts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Series and season tables out of tvshow.nfo and season.nfo files: (root_id, rel_path, text)."""
    n = read_nfo(texts)
    name = base_name(F.col("rel_path"))
    above = folders(F.col("rel_path"))
    parent, grand = F.try_element_at(above, F.lit(-1)), F.try_element_at(above, F.lit(-2))
    # one row per name: the last path wins, as a later ingest overwrites an earlier one
    order = F.struct("root_id", "rel_path")
    shows = (
        n.filter(name == "tvshow.nfo")
        .withColumn("name", F.coalesce("title", parent)).filter("name is not null")
        .withColumn("premiered", F.coalesce("premiered", F.col("year").cast("string")))
    )
    series = shows.groupBy(F.lower("name").alias("k_series")).agg(
        F.max_by(F.struct("name", "plot", "rating", "imdb_id", "premiered"), order).alias("r")
    ).select("r.*")
    number = F.coalesce("season", F.regexp_extract(parent, r"(\d+)", 1).try_cast("int"))
    named = n.filter(name == "season.nfo").select(
        "root_id", "rel_path", F.coalesce("show_title", grand).alias("series"), number.alias("season"), "plot"
    ).filter("series is not null and season is not null")
    seasons = named.groupBy(F.lower("series").alias("k_series"), "season").agg(
        F.max_by(F.struct("series", "plot"), order).alias("r")
    ).select("r.series", "season", "r.plot")
    return series, seasons


def words_of(line: Column) -> Column:
    return F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")


def edl_segments(lines: DataFrame) -> DataFrame:
    """Edit-list lines (file_id, duration_ms, pos, line) as skippable segments, kind by position."""
    p = words_of(F.col("line"))
    start, end = F.get(p, F.lit(0)).try_cast("double"), F.get(p, F.lit(1)).try_cast("double")
    action = F.coalesce(F.get(p, F.lit(2)).try_cast("double").cast("int"), F.lit(0))
    df = lines.filter(~F.trim("line").startswith("#")).select(
        "file_id", "duration_ms", "pos", (start * 1000).cast("long").alias("start_ms"), (end * 1000).cast("long").alias("end_ms"), action.alias("action")
    )
    df = df.filter(F.col("action").isin(0, 3) & (F.col("start_ms") >= 0) & (F.col("end_ms") > F.col("start_ms")))
    kind = (
        F.when(F.col("end_ms") >= F.col("duration_ms") - 10_000, "credits")
        .when(F.col("start_ms") <= 300_000, "intro").otherwise("commercial")
    )
    return df.select("file_id", "pos", "start_ms", "end_ms", kind.alias("kind"), F.lit("edl").alias("source"))


def rttm_segments(lines: DataFrame) -> DataFrame:
    """Diarization lines (media_id, line) as speech: start, end, speaker, confidence."""
    p = words_of(F.col("line"))
    num = lambda i: F.get(p, F.lit(i)).try_cast("double")
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    start, length, score = num(3), num(4), num(8)
    label = F.substring(F.translate(F.get(p, F.lit(7)), "<>&", ""), 1, 64)
    return (
        lines.filter((F.get(p, F.lit(0)) == "SPEAKER") & (F.size(p) >= 8) & sound(start) & sound(length) & (start >= 0) & (length > 0))
        .select("media_id", start.alias("start_s"), (start + length).alias("end_s"), label.alias("speaker"),
                F.when(sound(score), score).alias("confidence"))
    )


def timestamp_ms(text: Column) -> Column:
    """HH:MM:SS,mmm or MM:SS.mmm as milliseconds; what follows a blank is ignored."""
    first = F.regexp_extract(text, r"^\s*(\S+)", 1)
    whole = r"^(\d+(?::\d+)*)[,.](\d+)$"
    clock = F.split(F.regexp_extract(first, whole, 1), ":")
    part = F.substring(F.rpad(F.regexp_extract(first, whole, 2), 3, "0"), 1, 3).cast("long")
    total = F.aggregate(clock, F.lit(0).cast("long"), lambda t, c: t * 60 + c.cast("long"))
    return F.when(first.rlike(whole), total * 1000 + part)


def caption_cues(texts: DataFrame) -> DataFrame:
    """Caption texts (media_id, text) as cues: pos, start_ms, end_ms, words without tags."""
    unified = F.regexp_replace(F.col("text"), "\r\n?", "\n")
    blocks = F.split(unified, r"\n[ \t]*(?:\n[ \t]*)+")
    df = texts.select("media_id", F.posexplode(blocks).alias("pos", "block"))
    lines = F.transform(F.split("block", "\n"), lambda l: F.trim(l))

    def timing(line: Column) -> Column:
        sides = F.split(line, "-->", 2)
        return F.struct(timestamp_ms(F.get(sides, F.lit(0))).alias("a"), timestamp_ms(F.get(sides, F.lit(1))).alias("b"))

    df = df.select("media_id", "pos", lines.alias("lines"), F.transform(lines, timing).alias("t"))
    at = F.array_position(F.transform("t", lambda t: t["a"].isNotNull() & t["b"].isNotNull()), True).cast("int")
    df = df.withColumn("at", at).filter("at > 0")
    body = F.array_join(F.slice("lines", F.col("at") + 1, F.size("lines")), " ")
    text = F.regexp_replace(body, r"<[^>]*>|\{\\[^}]*\}", " ")
    spoken = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    cue = F.element_at("t", F.col("at"))
    return df.select("media_id", "pos", cue["a"].alias("start_ms"), cue["b"].alias("end_ms"), spoken.alias("words")).filter("words <> ''")


def music_overrides(texts: DataFrame) -> DataFrame:
    """music.toml files (root_id, rel_path, text) as one row per folder; a file with an unknown key is ignored."""
    text = F.col("text")
    known = "artist|album_artist|album|genre|track_number_prefix"
    bare = F.regexp_replace(text, r"(?m)^\s*(#.*)?$\n?", "")
    line = rf"""(?:{known})\s*=\s*(?:"(?:[^"\\]|\\.)*"|'[^']*'|true|false)\s*(?:#.*)?"""
    sound = bare.rlike(rf"^(?:\s*{line}(?:\n|$))*\s*$")

    def value(key: str) -> Column:
        v = F.regexp_extract(text, rf"""(?m)^\s*{key}\s*=\s*(?:"((?:[^"\\]|\\.)*)"|'[^']*')""", 1)
        single = F.regexp_extract(text, rf"""(?m)^\s*{key}\s*=\s*'([^']*)'""", 1)
        plain = F.regexp_replace(F.when(v != "", v).otherwise(single), r"\\(.)", "$1")
        return F.when(text.rlike(rf"(?m)^\s*{key}\s*="), plain)

    flag = F.nullif(F.regexp_extract(text, r"(?m)^\s*track_number_prefix\s*=\s*(true|false)", 1), F.lit("")).cast("boolean")
    folder = F.array_join(folders(F.col("rel_path")), "/")
    return texts.filter(sound & (base_name(F.col("rel_path")) == "music.toml")).select(
        "root_id", folder.alias("rel_dir"), value("artist").alias("artist"), value("album_artist").alias("album_artist"),
        value("album").alias("album"), value("genre").alias("genre"), flag.alias("track_number_prefix"),
    )
