"""Node ids, work keys and display titles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_ARTIST = "Unknown Artist"
UNKNOWN_ALBUM = "Unknown Album"

# fixed values: (label, low, high) with low <= rating < high; the last bucket is the unrated one
RATING_BUCKETS = [
    ("9 and above", 9.0, 10.1),
    ("8 – 9", 8.0, 9.0),
    ("7 – 8", 7.0, 8.0),
    ("6 – 7", 6.0, 7.0),
    ("Below 6", 0.0, 6.0),
]
UNRATED = len(RATING_BUCKETS)


def rating_bucket(rating: Column) -> Column:
    """Bucket number of a rating; null for a rating outside every bucket."""
    out = F.when(rating.isNull(), F.lit(UNRATED))
    for i, (_, low, high) in enumerate(RATING_BUCKETS):
        out = out.when((rating >= low) & (rating < high), F.lit(i))
    return out


def bucket_title(bucket: Column) -> Column:
    labels = F.array(*[F.lit(label) for label, _, _ in RATING_BUCKETS])
    return F.coalesce(F.get(labels, bucket), F.lit("Unrated"))


def is_uhd(width: Column, height: Column) -> Column:
    """Above 1080p in either direction."""
    return (F.coalesce(width, F.lit(0)) > 1920) | (F.coalesce(height, F.lit(0)) > 1080)


def display_artist(album_artist: Column, artist: Column) -> Column:
    return F.coalesce(album_artist, artist, F.lit(UNKNOWN_ARTIST))


def display_album(album: Column) -> Column:
    return F.coalesce(album, F.lit(UNKNOWN_ALBUM))


def decade(year: Column) -> Column:
    return (year / 10).cast("int") * 10


def encode(text: Column) -> Column:
    """Base64 with the URL alphabet and no padding."""
    plain = F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[=\r\n]", "")
    return F.translate(plain, "+/", "-_")


def decode(text: Column) -> Column:
    """Reverse of encode; null for malformed input, invalid text or control characters."""
    whole = text.rlike(r"^[A-Za-z0-9_-]*$") & (F.length(text) % 4 != 1)
    padded = F.rpad(text, (F.ceil(F.length(text) / 4) * 4).cast("int"), F.lit("="))
    raw = F.when(whole, F.unbase64(F.translate(padded, "-_", "+/")))
    out = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    # a sloppy tail would decode but not encode back to itself
    return F.when((encode(out) == text) & ~out.rlike(r"\p{Cc}"), out)


def node_id(prefix: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), *[p.cast("string") for p in parts])


def dir_id(root_id: Column, rel_dir: Column) -> Column:
    """Folder node: dir:root for the top, dir:root:name below it."""
    return F.when(rel_dir == "", node_id("dir", root_id)).otherwise(node_id("dir", root_id, encode(rel_dir)))


def parse_node(node: Column) -> Column:
    """struct(kind, arg1, arg2) of a node id, null for text that is no node id."""
    parts = F.split(node, ":")
    n = F.size(parts)
    head = F.get(parts, F.lit(0))
    view = F.get(parts, F.lit(1))
    a = F.get(parts, F.lit(2))
    b = F.get(parts, F.lit(3))
    whole = r"^[+-]?\d{1,18}$"

    def made(kind: Column, first=None, second=None) -> Column:
        null = F.lit(None).cast("string")
        return F.struct(
            kind.alias("kind"), (null if first is None else first).alias("arg1"), (null if second is None else second).alias("arg2")
        )

    section = {
        "mv": ["all", "recent", "4k", "year", "decade", "genre", "director", "set", "rating", "dir"],
        "mu": ["recent", "artist", "album", "genre", "dir"],
        "tv": ["4k", "recent", "dir"],
    }
    plain = head.isin(*section) & (n == 1) | (n == 2) & F.concat(head, F.lit(":"), view).isin(
        *[f"{h}:{v}" for h, views in section.items() for v in views]
    )
    two = F.concat(head, F.lit(":"), view)
    numbered = (n == 3) & two.isin("mv:year", "mv:decade", "mv:genre", "mv:director", "mv:rating", "mu:genre") & a.rlike(whole)
    numbered = numbered & ((two != "mv:rating") | a.rlike(r"^\+?\d+$"))
    named = (n == 3) & two.isin("mv:set", "mu:artist", "tv:ser") & decode(a).isNotNull()
    album = (n == 4) & (two == "mu:album") & decode(a).isNotNull() & decode(b).isNotNull()
    season = (n == 4) & (two == "tv:ser") & decode(a).isNotNull() & b.rlike(whole)
    top = (n == 2) & (head == "dir") & view.rlike(whole)
    below = (n == 3) & (head == "dir") & view.rlike(whole) & decode(a).isNotNull()
    item = (n == 2) & (head == "it") & view.rlike(whole)
    return (
        F.when(node == "0", made(F.lit("root")))
        .when(plain, made(node))
        .when(numbered, made(F.concat(two, F.lit(":n")), a.cast("long").cast("string")))
        .when(named, made(F.concat(two, F.lit(":name")), decode(a)))
        .when(album, made(F.lit("mu:album:name"), decode(a), decode(b)))
        .when(season, made(F.lit("tv:season"), decode(a), b.cast("long").cast("string")))
        .when(top, made(F.lit("dir"), view.cast("long").cast("string"), F.lit("")))
        .when(below, made(F.lit("dir"), view.cast("long").cast("string"), decode(a)))
        .when(item, made(F.lit("item"), view.cast("long").cast("string")))
    )


def two_digits(n: Column) -> Column:
    return F.when(n >= 100, n.cast("string")).otherwise(F.lpad(n.cast("string"), 2, "0"))


def with_year(title: Column, year: Column) -> Column:
    return F.when(year.isNull(), title).otherwise(F.concat(title, F.lit(" ("), year.cast("string"), F.lit(")")))


def with_score(title: Column, rating: Column) -> Column:
    """'8.5 · Title', the title alone when unrated."""
    return F.when(rating.isNull(), title).otherwise(
        F.concat(F.format_string("%.1f", rating), F.lit(" · "), title)
    )


def qualified_episode(series: Column, season: Column, episode: Column, title: Column) -> Column:
    """'Series SxxEyy - Title'."""
    name = F.coalesce(series, F.lit("Unknown Series"))
    mark = F.when(
        season.isNotNull() & episode.isNotNull(),
        F.concat(F.lit(" S"), two_digits(season), F.lit("E"), two_digits(episode)),
    ).otherwise(F.lit(""))
    return F.concat(name, mark, F.lit(" - "), title)


def qualified_track(artist: Column, album: Column, title: Column) -> Column:
    """'Artist - Album - Title', without the album when there is none."""
    return F.concat_ws(" - ", F.coalesce(artist, F.lit(UNKNOWN_ARTIST)), album, title)


def playlist_title(kind: Column, title: Column, year: Column, series: Column, season: Column, episode: Column,
                   artist: Column, album: Column) -> Column:
    """Title that stands on its own outside its listing."""
    number = F.concat(two_digits(episode), F.lit(" - "))
    bare = F.when(
        episode.isNotNull() & F.startswith(title, number), F.substr(title, F.length(number) + 1)
    ).otherwise(title)
    tv = F.when(series.isNotNull() & F.startswith(title, series), title).otherwise(
        qualified_episode(series, season, episode, bare)
    )
    music = F.when(artist.isNotNull() & F.startswith(title, artist), title).otherwise(qualified_track(artist, album, title))
    dated = F.endswith(title, F.concat(F.lit("("), year.cast("string"), F.lit(")")))
    film = F.when(year.isNotNull() & ~dated, with_year(title, year)).otherwise(title)
    return F.when(kind == "tv", tv).when(kind == "music", music).otherwise(film)


def season_title(season: Column, year: Column) -> Column:
    base = F.when(season == 0, F.lit("Specials")).otherwise(F.concat(F.lit("Season "), season.cast("string")))
    return with_year(base, year)


def undecorated_movie_title(title: Column, year: Column) -> Column:
    """Movie title without the year suffix and the score prefix that listings add."""
    t = F.trim(title)
    suffix = F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))
    t = F.when(
        year.isNotNull() & F.endswith(t, suffix), F.substr(t, F.lit(1), F.length(t) - F.length(suffix))
    ).otherwise(t)
    return F.regexp_replace(t, r"^\d+\.\d · ", "")


def program_key(kind: Column, file_id: Column, series: Column, season: Column, episode: Column,
                title: Column, year: Column) -> Column:
    """Identity watch state hangs on; null for music."""
    numbered = series.isNotNull() & season.isNotNull() & (episode > 0)
    tv = F.when(
        numbered, F.concat_ws("|", F.lit("tv"), F.lower(F.trim(series)), season.cast("string"), episode.cast("string"))
    ).otherwise(F.concat(F.lit("f|"), file_id.cast("string")))
    film = F.concat(
        F.lit("mv|"), F.lower(F.trim(undecorated_movie_title(title, year))), F.lit("|"),
        F.coalesce(year.cast("string"), F.lit("")),
    )
    return F.when(kind == "tv", tv).when(kind == "movies", film)


def year_of(date: Column) -> Column:
    """Year in the first four characters of a stored date, 1801 to 2199."""
    y = F.when(F.length(date) >= 4, F.substring(date, 1, 4).try_cast("int"))
    return F.when((y >= 1801) & (y < 2200), y)
