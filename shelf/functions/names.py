"""Title, episode and track names parsed out of file paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words dropped from the end of a movie title
MOVIE_TAIL_WORDS = [
    "remastered", "unrated", "extended", "uncut", "repack", "proper", "imax", "theatrical", "criterion", "restored", "bluray",
    "brrip", "webrip", "hdrip", "dvdrip", "2160p", "1080p", "720p", "4k", "x264", "x265", "hevc",
]

# fixed value: pattern of the words an episode title is cut at
EPISODE_CUT_WORDS = (
    r"2160p|1080p|720p|480p|4k|webrip|web-?dl|web|bluray|blu-ray|brrip|bdrip|hdtv|hdrip|dvdrip|hevc|x264|x265|h\.?264|h\.?265|av1|aac\d*|ac3|"
    r"dd[p+]?[\d\.]*|dts(-?hd)?|atmos|repack|proper|internal|remastered|extended|uncut|unrated|amzn|nf|hulu|dsnp|hmax|10bit|8bit|hdr\d*|dv|sdr|"
    r"multi|dubbed|subbed"
)

# what comes before the mark, season and number in either spelling, what comes after
EPISODE_SHAPE = r"(?is)^(.*?)(?:S(\d{1,2})[. _-]*E(\d{1,3})(?:[. _-]*E\d{1,3})*|(\d{1,2})x(\d{2,3}))(.*)$"
PIECE = "\u0001"


def let(value: Column, then) -> Column:
    """Use a computed value several times in an expression while computing it once per row."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folders(path: Column) -> Column:
    """Folder names above a file, outermost first."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def stem(path: Column) -> Column:
    """File name without its last extension; the whole path when it has none."""
    name = base_name(path)
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(path)


def path_stem(path: Column) -> Column:
    """Path without extension, null when there is none or the name only starts with a dot."""
    return F.when(
        base_name(path).rlike(r"^.+\.[^.]*$"), F.regexp_replace(path, r"\.[^./]*$", "")
    )


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def squeeze(text: Column) -> Column:
    """Whitespace runs to one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def clean_name(text: Column) -> Column:
    """Dots and underscores to blanks, blanks collapsed, stray separators off both ends."""
    spaced = squeeze(F.translate(text, "._", "  "))
    return F.regexp_replace(spaced, r"^[-( \[]+|[-( \[]+$", "")


def sort_title(title: Column) -> Column:
    """Title without leading punctuation or a leading English article."""
    bare = F.regexp_replace(title, r"^[^\p{IsAlphabetic}\p{N}]+", "")
    return F.regexp_replace(F.when(bare == "", title).otherwise(bare), r"(?i)^(the|a|an) ", "")


def _drop_tail_words(title: Column) -> Column:
    words = "|".join(MOVIE_TAIL_WORDS)
    return F.regexp_replace(title, rf"(?i)(?<=.)( (?:{words}))+$", "")


def movie(name: Column) -> Column:
    """struct(title, year): the last delimited 19xx/20xx that follows some title is the year."""
    delimiter = r"[. _\-()\[\]]"
    # the year's own delimiters are not consumed, so each of two adjacent years is found
    shape = rf"(?s)^(.*{delimiter})((?:19|20)\d\d)(?=$|{delimiter}).*$"

    def made(p: Column) -> Column:
        title = _drop_tail_words(clean_name(F.get(p, F.lit(0))))
        year = F.get(p, F.lit(1)).try_cast("int")
        return let(
            F.struct(title.alias("t"), year.alias("y")),
            lambda m: F.when(m["y"].isNotNull() & (m["t"] != ""), F.struct(m["t"].alias("title"), m["y"].alias("year"))).otherwise(
                F.struct(_drop_tail_words(clean_name(name)).alias("title"), F.lit(None).cast("int").alias("year"))
            ),
        )

    return let(F.split(F.regexp_replace(name, shape, f"$1{PIECE}$2"), PIECE), made)


def without_series_year(series: Column) -> Column:
    bare = F.trim(F.regexp_replace(series, r"\s*\(?(19|20)\d{2}\)?\s*$", ""))
    return F.when(bare == "", series).otherwise(bare)


def episode_title(text: Column) -> Column:
    """Text up to the first release word, stray separators off both ends."""
    cut = rf"(?is)(?:^| )[(\[]*(?:{EPISODE_CUT_WORDS})\b.*$"
    return F.regexp_replace(F.regexp_replace(squeeze(text), cut, ""), r"^[-( \[]+|[-( \[]+$", "")


def episode(name: Column, parents: Column) -> Column:
    """struct(series, season, episode, title), null without an episode mark."""
    some = lambda c: F.nullif(c, F.lit(""))

    def near(_: Column) -> Column:
        cleaned = F.transform(F.reverse(parents), lambda d: clean_name(d))
        outer = F.filter(cleaned, lambda d: ~F.lower(d).rlike("^(season|series|$)"))
        return some(without_series_year(F.get(outer, F.lit(0))))

    def made(p: Column) -> Column:
        at = lambda i: F.get(p, F.lit(i))
        number = F.coalesce(some(at(2)), at(4)).try_cast("int")
        own = let(without_series_year(clean_name(at(0))), lambda o: F.coalesce(some(o), near(o), F.lit("Unknown Series")))
        title = F.coalesce(some(episode_title(clean_name(at(5)))), F.concat(F.lit("Episode "), number.cast("string")))
        fields = F.struct(
            own.alias("series"), F.coalesce(some(at(1)), at(3)).try_cast("int").alias("season"), number.alias("episode"), title.alias("title")
        )
        return F.when(F.size(p) > 1, fields)

    pieces = PIECE.join(f"${i}" for i in range(1, 7))
    return let(F.split(F.regexp_replace(name, EPISODE_SHAPE, pieces), PIECE), made)


def track(name: Column, parents: Column) -> Column:
    """struct(artist, album, track_no, title) from Artist/Album/NN - Title paths."""
    pattern = r"(?s)^(\d{1,3})[. _-]+(.+)$"
    number = F.regexp_extract(name, pattern, 1)
    numbered = number != ""
    return F.struct(
        clean_name(F.try_element_at(parents, F.lit(-2))).alias("artist"),
        clean_name(F.try_element_at(parents, F.lit(-1))).alias("album"),
        F.when(numbered, number.try_cast("int")).alias("track_no"),
        clean_name(F.when(numbered, F.regexp_extract(name, pattern, 2)).otherwise(name)).alias("title"),
    )


def split_genres(text: Column) -> Column:
    """Genre names out of one tag."""
    return F.filter(F.transform(F.split(text, "[;/,]"), lambda g: F.trim(g)), lambda g: g != "")
