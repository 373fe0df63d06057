"""Facts about items as short display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60, 3600, 86_400


def _s(n: Column) -> Column:
    return n.cast("string")


def _two(n: Column) -> Column:
    return F.lpad(_s(n), 2, "0")


def _div(a: Column, b: int) -> Column:
    """Whole part of a division of non-negative numbers."""
    return F.floor(a / F.lit(b)).cast("long")


def human_duration(ms: Column) -> Column:
    secs = _div(ms, 1000)
    return F.concat(_s(_div(secs, HOUR)), F.lit(":"), _two(_div(secs % HOUR, MINUTE)), F.lit(":"), _two(secs % MINUTE))


def clock(ms: Column) -> Column:
    """12:34, or 1:02:03 from an hour on."""
    secs = _div(ms, 1000)
    short = F.concat(_s(_div(secs, MINUTE)), F.lit(":"), _two(secs % MINUTE))
    return F.when(secs >= HOUR, human_duration(ms)).otherwise(short)


def human_size(size: Column) -> Column:
    """Bytes in 1024 steps up to TB, two decimals from KB on, a half to the even digit."""
    def hundredths(unit: int) -> Column:
        part = (size % unit) * 100
        digits, rest = _div(part, unit), (part % unit) * 2
        up = (rest > unit) | ((rest == unit) & (digits % 2 == 1))
        digits = digits + F.when(up, 1).otherwise(0)
        return F.concat(_s(_div(size, unit) + _div(digits, 100)), F.lit("."), _two(digits % 100))

    out = F.when(size < 1024, F.concat(_s(size), F.lit(" B")))
    for power, unit in enumerate(["KB", "MB", "GB"], start=1):
        out = out.when(size < 1024 ** (power + 1), F.concat(hundredths(1024**power), F.lit(" " + unit)))
    return out.otherwise(F.concat(hundredths(1024**4), F.lit(" TB")))


def fps_label(fps: Column) -> Column:
    """Whole rates plain, others with up to three decimals."""
    exact = F.regexp_replace(F.format_string("%.3f", fps), "0+$", "")
    label = F.when(F.abs(fps - F.round(fps)) < 0.005, _s(F.round(fps).cast("long"))).otherwise(exact)
    return F.when(fps.isNotNull(), label)


def layout_name(channels: Column) -> Column:
    return (
        F.when(channels == 1, "Mono").when(channels == 2, "Stereo").when(channels == 6, "5.1").when(channels == 8, "7.1")
        .otherwise(F.concat(_s(channels), F.lit(" channels")))
    )


def long_date(iso: Column) -> Column:
    """14 October 2001 for a full date, anything else as it is."""
    parts = F.split(iso, "-")
    month = F.get(parts, F.lit(1)).try_cast("int")
    day = F.get(parts, F.lit(2)).try_cast("int")
    names = F.array(*[F.lit(m) for m in (
        "January February March April May June July August September October November December".split()
    )])
    full = (F.size(parts) == 3) & (month >= 1) & (month <= 12) & (day >= 0)
    return F.when(full, F.concat_ws(" ", _s(day), F.get(names, month - 1), F.get(parts, F.lit(0)))).otherwise(iso)


def rating_class(rating: Column) -> Column:
    return F.when(rating >= 7.5, "green").when(rating >= 5.5, "yellow").when(rating.isNotNull(), "red")


def age(updated_at: Column, now: Column) -> Column:
    """'just now', '5 min ago', 'yesterday' ... for two epoch seconds."""
    gap = now - updated_at
    return (
        F.when(gap < 90, "just now")
        .when(gap < HOUR, F.concat(_s(_div(gap, MINUTE)), F.lit(" min ago")))
        .when(gap < DAY, F.concat(_s(_div(gap, HOUR)), F.lit(" h ago")))
        .when(gap < 2 * DAY, "yesterday")
        .when(gap < 30 * DAY, F.concat(_s(_div(gap, DAY)), F.lit(" days ago")))
        .otherwise(F.date_format(F.timestamp_seconds(updated_at), "yyyy-MM-dd"))
    )


def watch_note(position_ms: Column, duration_ms: Column, watched: Column, updated_at: Column, now: Column) -> Column:
    """'12:34 left · 2 h ago', 'watched yesterday' or nothing."""
    left = F.when(duration_ms > position_ms, F.concat(clock(duration_ms - position_ms), F.lit(" left"))).otherwise(
        F.concat(F.lit("at "), clock(position_ms))
    )
    when = age(updated_at, now)
    return (
        F.when(position_ms > 0, F.concat(left, F.lit(" · "), when))
        .when(watched, F.concat(F.lit("watched "), when))
        .otherwise(F.lit(""))
    )


def truncate_words(text: Column, most: int = 300) -> Column:
    """Text cut on a word boundary with an ellipsis."""
    head = F.substring(text, 1, most)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, r"(?s) [^ ]*$", "")).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def _year_suffix(title: Column, year: Column) -> Column:
    return F.when(year.isNull(), title).otherwise(F.concat(title, F.lit(" ("), _s(year), F.lit(")")))


def _pad(n: Column) -> Column:
    return F.when(n >= 100, _s(n)).otherwise(_two(n))


def tab_title(title: Column, year: Column, series: Column, season: Column) -> Column:
    episode = F.concat(title, F.lit(" (S"), _pad(season), F.lit(" - "), series, F.lit(")"))
    return F.when(series.isNotNull() & season.isNotNull(), episode).otherwise(_year_suffix(title, year))


def share_title(kind: Column, title: Column, year: Column, series: Column, season: Column, episode: Column, artist: Column) -> Column:
    numbered = series.isNotNull() & season.isNotNull() & episode.isNotNull()
    tv = F.concat(series, F.lit(" S"), _pad(season), F.lit("E"), _pad(episode), F.lit(" — "), title)
    music = F.concat(artist, F.lit(" — "), title)
    return F.when(numbered, tv).when((kind == "music") & artist.isNotNull(), music).otherwise(_year_suffix(title, year))


def share_text(kind: Column, plot: Column, album: Column) -> Column:
    """Plot, else a track's album, cut at 300 characters."""
    story = F.when(F.trim(plot) != "", plot)
    text = F.trim(F.coalesce(story, F.when(kind == "music", album)))
    return F.when(text != "", truncate_words(text))
