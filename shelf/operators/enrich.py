"""Enrichment: what sidecars lack, matching titles to metadata, ratings, and the sidecar texts written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.functions import names
from shelf.functions.names import base_name, folders, stem
from shelf.operators.reconcile import folder_of, sibling
from shelf.session import written

MARKER = "generated by shelf"
SEASON_DIR = r"(?i)^(season[ ._-]*\d*|s\d{1,2})$"


def unique_id(text: Column, kind: str) -> Column:
    """The first non-empty uniqueid of a kind, whatever the quotes and attribute order."""
    attrs = F.regexp_extract_all(text, F.lit(r"(?s)<uniqueid([^>]*)>([^<]*)"), 1)
    values = F.regexp_extract_all(text, F.lit(r"(?s)<uniqueid([^>]*)>([^<]*)"), 2)
    pairs = F.arrays_zip(attrs.alias("a"), values.alias("v"))
    fits = F.filter(pairs, lambda p: p["a"].rlike(rf"""type=(?:"{kind}"|'{kind}')""") & (F.trim(p["v"]) != ""))
    return F.trim(F.try_element_at(fits, F.lit(1))["v"])


def nfo_state(text: Column) -> Column:
    """What a sidecar holds: missing, generated or handwritten, and which fields are there."""
    t = F.coalesce(text, F.lit(""))
    state = F.when(t == "", "missing").when(t.contains(MARKER), "generated").otherwise("handwritten")
    tmdb = unique_id(t, "tmdb").try_cast("long")
    has_title = _any(t, ("<title>", "<title "))
    return F.struct(
        state.alias("state"), t.contains("<rating>").alias("has_rating"), t.contains("<plot>").alias("has_plot"),
        t.contains('type="imdb"').alias("has_imdb"), t.contains("<set").alias("has_set"), has_title.alias("has_title"),
        _any(t, ("<aired>", "<aired/>")).alias("has_aired"), _any(t, ("<premiered>", "<premiered/>")).alias("has_premiered"),
        tmdb.alias("tmdb_id"), unique_id(t, "imdb").alias("imdb_id"),
        ((state == "handwritten") & tmdb.isNotNull() & ~has_title).alias("is_pin"),
    )


def _any(text: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


def _with_state(media: DataFrame, texts: DataFrame, inventory: DataFrame) -> DataFrame:
    """Media with the state of the same-stem sidecar and whether a poster of its own is there."""
    # a text is judged before it meets its media, so that the join carries what it says and not the text
    nfo = texts.filter(F.col("rel_path").endswith(".nfo")).select("root_id", F.col("rel_path").alias("_nfo"), nfo_state(F.col("text")).alias("n"))
    posters = inventory.filter(F.col("rel_path").endswith("-poster.jpg")).select("root_id", F.col("rel_path").alias("_poster"), F.lit(True).alias("_there"))
    df = media.withColumn("_nfo", sibling(F.col("rel_path"), "nfo"))
    df = df.withColumn("_poster", F.concat(F.coalesce(names.path_stem(F.col("rel_path")), F.col("rel_path")), F.lit("-poster.jpg")))
    df = df.join(nfo, ["root_id", "_nfo"], "left").join(posters, ["root_id", "_poster"], "left")
    none = nfo_state(F.lit(None).cast("string"))
    return df.withColumn("n", F.coalesce("n", none)).withColumn("has_poster", F.coalesce("_there", F.lit(False))).drop("_nfo", "_poster", "_there")


def movie_tasks(media: DataFrame, texts: DataFrame, inventory: DataFrame, refresh: bool = False, force: bool = False,
                ratings: bool = True, posters: bool = True) -> DataFrame:
    """Movies that need a sidecar or a poster: (root_id, rel_path, title, year, write_nfo, write_poster, tmdb_id, pinned)."""
    df = _with_state(media, texts, inventory)
    n = F.col("n")
    lacks = F.lit(refresh) | (~n["has_rating"] & F.lit(ratings)) | ~n["has_imdb"] | ~n["has_set"]
    write_nfo = (
        F.when(n["state"] == "missing", True).when(n["state"] == "generated", lacks).when(n["is_pin"], True).otherwise(F.lit(refresh and force))
    )
    write_poster = F.lit(posters) & (~F.col("has_poster") | (F.lit(refresh) & (n["state"] == "generated")))
    parsed = names.movie(stem(F.col("rel_path")))
    return df.select(
        "root_id", "rel_path", parsed["title"].alias("title"), parsed["year"].alias("year"), write_nfo.alias("write_nfo"),
        write_poster.alias("write_poster"), n["tmdb_id"].alias("tmdb_id"), n["is_pin"].alias("pinned"),
    ).filter("write_nfo or write_poster")


def episode_tasks(media: DataFrame, texts: DataFrame, inventory: DataFrame, refresh: bool = False, force: bool = False) -> DataFrame:
    """Episodes with their series folder and what they need; files whose name holds no episode drop out."""
    path = F.col("rel_path")
    # names are parsed inside a generator: a filter above a projection would parse them again
    parsed = F.filter(F.array(names.episode(stem(path), folders(path)).alias("e")), lambda e: e.isNotNull())
    df = _with_state(media, texts, inventory).select("*", F.explode(parsed).alias("e"))
    folder = folder_of(path)
    is_season = base_name(folder).rlike(SEASON_DIR)
    series_dir = F.when(is_season, F.regexp_replace(folder, "/?[^/]*$", "")).otherwise(folder)
    n = F.col("n")
    lacks = F.lit(refresh) | ~n["has_plot"] | ~n["has_imdb"] | ~n["has_aired"]
    write = F.when(n["state"] == "missing", True).when(n["state"] == "generated", lacks).otherwise(F.lit(refresh and force))
    return df.select(
        "root_id", "rel_path", F.lower("e.series").alias("k_series"), F.col("e.series").alias("series"), F.col("e.season").alias("season"),
        F.col("e.episode").alias("episode"), series_dir.alias("series_dir"), F.when(is_season, folder).alias("season_dir"), (series_dir == "").alias("loose"),
        write.alias("write_nfo"), "has_poster",
        (~write & (n["state"] == "generated") & ~n["has_rating"] & n["imdb_id"].isNotNull()).alias("unrated"), n["imdb_id"].alias("imdb_id"),
    )


def _by_season(tasks: DataFrame, refresh: bool) -> DataFrame:
    """Tasks gathered per (series, season); series rows are gathered from these, so tasks are parsed once."""
    at = F.struct("root_id", "rel_path")
    poster = F.col("loose") & (~F.col("has_poster") | F.lit(refresh))
    return tasks.groupBy("k_series", "season").agg(
        F.min(F.struct(at.alias("at"), "series")).alias("first"),
        F.max(F.when(~F.col("loose"), F.struct(at.alias("at"), "root_id", "series_dir"))).alias("placed"),
        F.min(F.when(F.col("season_dir").isNotNull(), F.struct(at.alias("at"), "root_id", "season_dir"))).alias("dir"),
        F.count_if("write_nfo").alias("episodes"), F.count_if(poster).alias("loose_posters"),
    )


def _folder_sidecar(df: DataFrame, texts: DataFrame, folder: str, name: str) -> DataFrame:
    nfo = texts.filter(F.col("rel_path").endswith("/" + name)).select("root_id", F.col("rel_path").alias("_nfo"), "text")
    return df.withColumn("_nfo", F.concat(folder, F.lit("/" + name))).join(nfo, ["root_id", "_nfo"], "left").withColumn("n", nfo_state(F.col("text")))


def _needed(lacks: Column, refresh: bool, force: bool) -> Column:
    state = F.col("n.state")
    return F.when(state == "missing", True).when(state == "generated", F.lit(refresh) | lacks).otherwise(F.lit(refresh and force))


def series_plans(tasks: DataFrame, texts: DataFrame, inventory: DataFrame, refresh: bool = False, force: bool = False) -> DataFrame:
    """One row per series with work: its folder, episodes to describe, posters and folder sidecars to write."""
    # a row a season, which both the series and the seasons are made from
    by_season = written(_by_season(tasks, refresh), "seasons")
    grouped = by_season.groupBy("k_series").agg(
        F.min("first").alias("first"), F.max("placed").alias("d"), F.sum("episodes").alias("episodes"), F.sum("loose_posters").alias("loose_posters"),
    ).select("k_series", F.col("first.series").alias("series"), "d.root_id", "d.series_dir", "episodes", "loose_posters")
    there = inventory.filter(F.col("rel_path").endswith("/poster.jpg")).select("root_id", F.col("rel_path").alias("_poster"), F.lit(True).alias("_there"))
    df = _folder_sidecar(grouped, texts, "series_dir", "tvshow.nfo").withColumn("_poster", F.concat("series_dir", F.lit("/poster.jpg")))
    df = df.join(there, ["root_id", "_poster"], "left")
    foldered = F.col("series_dir").isNotNull()
    lacks = ~F.col("n.has_plot") | ~F.col("n.has_imdb") | ~F.col("n.has_premiered")
    write_poster = foldered & (F.col("_there").isNull() | F.lit(refresh))
    seasons = _season_sidecars(by_season, texts, refresh, force).groupBy("k_series").agg(F.count(F.lit(1)).alias("season_nfos"))
    df = df.join(seasons, "k_series", "left").select(
        "k_series", "series", "root_id", "series_dir", "episodes", "loose_posters", (foldered & _needed(lacks, refresh, force)).alias("write_show_nfo"),
        write_poster.alias("write_poster"), F.coalesce("season_nfos", F.lit(0)).alias("season_nfos"),
    )
    return df.filter("episodes > 0 or write_poster or loose_posters > 0 or write_show_nfo or season_nfos > 0")


def _season_sidecars(by_season: DataFrame, texts: DataFrame, refresh: bool, force: bool) -> DataFrame:
    dirs = by_season.filter("dir is not null").select("k_series", "season", "dir.root_id", "dir.season_dir")
    found = _folder_sidecar(dirs, texts, "season_dir", "season.nfo")
    return found.filter(_needed(~F.col("n.has_plot"), refresh, force)).select("k_series", "season", "root_id", "season_dir")


def season_sidecars(tasks: DataFrame, texts: DataFrame, refresh: bool = False, force: bool = False) -> DataFrame:
    """Season folders whose season.nfo is missing or lacks a plot: (k_series, season, root_id, season_dir)."""
    return _season_sidecars(_by_season(tasks, refresh), texts, refresh, force)


def match_movies(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Tasks (task_id, title, year, tmdb_id) with the metadata id they match, null when none does.

    A pinned id settles it. Else candidates (tmdb_id, title, year, is_primary, rank) meet
    by title and year: the exact release year first, any regional year next; a known
    year is never dropped.
    """
    pinned = tasks.filter("tmdb_id is not null").join(
        candidates.select(F.col("tmdb_id").alias("match_id")).distinct(), F.col("tmdb_id") == F.col("match_id"), "left"
    ).select("task_id", "match_id", F.lit("pin").alias("how"))
    open_ = tasks.filter("tmdb_id is null").select("task_id", F.lower(F.trim("title")).alias("_t"), "year")
    # candidates of one title (and year) are ranked alike for every task, so a task meets the best of them and not each
    c = candidates.select(
        F.lower(F.trim("title")).alias("_t"), F.col("year").alias("_y"), F.when(F.col("is_primary"), 0).otherwise(1).alias("tier"), "rank", F.col("tmdb_id").alias("match_id")
    )
    released = c.groupBy("_t", F.col("_y").alias("year")).agg(F.min_by("match_id", F.struct("tier", "rank", "match_id")).alias("match_id"), F.min("tier").alias("tier"))
    titled = c.groupBy("_t").agg(F.min_by("match_id", F.struct("rank", "match_id")).alias("match_id"), F.lit(0).alias("tier"))
    dated = open_.filter("year is not null").join(released, ["_t", "year"])
    plain = open_.filter("year is null").join(titled, "_t")
    best = dated.select("task_id", "match_id", "tier").unionByName(plain.select("task_id", "match_id", "tier"))
    searched = open_.select("task_id").join(best, "task_id", "left").select(
        "task_id", "match_id", F.when(F.col("tier") == 0, "exact").when(F.col("tier") == 1, "loose").alias("how")
    )
    return pinned.unionByName(searched)


def attach_ratings(rows: DataFrame, ratings: DataFrame) -> DataFrame:
    """Rows with the rating of their imdb_id; the ratings list is first cut to the ids asked for."""
    needed = rows.select(F.col("imdb_id").alias("tconst")).filter("tconst is not null").distinct()
    wanted = ratings.join(needed, "tconst", "left_semi").select(F.col("tconst").alias("imdb_id"), F.col("averageRating").alias("found_rating"))
    return rows.join(wanted, "imdb_id", "left")


def with_rating(text: Column, rating: Column) -> Column:
    """Sidecar text with a rating line before its imdb id; null when it has one already or no such line."""
    anchor = '(?s)^(.*?)([^\\n]*<uniqueid type="imdb">.*)$'
    line = F.concat(F.lit("  <rating>"), F.format_string("%.1f", rating), F.lit("</rating>\n"))
    fits = ~text.contains("<rating>") & text.contains('<uniqueid type="imdb">')
    return F.when(fits, F.concat(F.regexp_extract(text, anchor, 1), line, F.regexp_extract(text, anchor, 2)))


def late_ratings(unrated: DataFrame, ratings: DataFrame) -> DataFrame:
    """Generated sidecars (root_id, rel_path, text, imdb_id) without a rating, patched where one is now known."""
    patched = attach_ratings(unrated, ratings).filter("found_rating is not null")
    return patched.withColumn("new_text", with_rating(F.col("text"), F.col("found_rating"))).filter("new_text is not null")


def episode_metadata(tasks: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episode tasks (series_id, season, episode) with title, plot and air date; unknown ones are 'Episode N'."""
    e = episodes.select("series_id", "season", "episode", F.col("title").alias("_title"), F.col("plot").alias("_plot"), "aired")
    return tasks.join(e, ["series_id", "season", "episode"], "left").select(
        *tasks.columns, F.coalesce("_title", F.concat(F.lit("Episode "), F.col("episode").cast("string"))).alias("title"),
        F.coalesce("_plot", F.lit("")).alias("plot"), "aired",
    )


def new_arrivals(inventory: DataFrame, files: DataFrame, roots: DataFrame, since: int) -> DataFrame:
    """Videos (root_id, rel_path) that entered the catalog at or after the cutoff, or are not in it yet."""
    video = roots.filter(F.col("kind").isin("movies", "tv")).select("root_id")
    added = files.select("root_id", "rel_path", "added_at")
    return (
        inventory.join(video, "root_id", "left_semi").join(added, ["root_id", "rel_path"], "left")
        .filter(F.col("added_at").isNull() | (F.col("added_at") >= since))
    )


def parse_day(text: Column) -> Column:
    """YYYY-MM-DD as epoch seconds at the start of that day."""
    shaped = F.trim(text).rlike(r"^(19[7-9]\d|[2-9]\d{3})-(0?[1-9]|1[0-2])-(0?[1-9]|[12]\d|3[01])$")
    parts = F.split(F.trim(text), "-")
    whole = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    first = F.make_date(whole(0), whole(1), F.lit(1))
    return F.when(shaped, F.unix_date(first).cast("long") * 86400 + (whole(2) - 1) * 86400)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def _line(tag: str, value: Column, attrs: str = "") -> Column:
    return F.concat(F.lit(f"  <{tag}{attrs}>"), escape(F.coalesce(value.cast("string"), F.lit(""))), F.lit(f"</{tag}>\n"))


def _optional(tag: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(_line(tag, value))


def _rating_line(rating: Column) -> Column:
    return F.when(rating.isNull(), F.lit("")).otherwise(F.concat(F.lit("  <rating>"), F.format_string("%.1f", rating), F.lit("</rating>\n")))


def _document(root: str, *lines: Column) -> Column:
    head = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<!-- {MARKER} -->\n<{root}>\n'
    return F.concat(F.lit(head), *lines, F.lit(f"</{root}>\n"))


def movie_nfo(title: Column, year: Column, rating: Column, plot: Column, genres: Column, directors: Column, collection: Column,
              imdb_id: Column, tmdb_id: Column) -> Column:
    """Movie sidecar; the set and both ids are written even when empty, so a later run sees they were looked up."""
    each = lambda tag, values: F.array_join(F.transform(values, lambda v: _line(tag, v)), "")
    return _document(
        "movie", _line("title", title), _optional("year", year), _rating_line(rating), _optional("plot", plot), each("genre", genres),
        each("director", directors), _line("set", collection), _line("uniqueid", imdb_id, ' type="imdb"'), _line("uniqueid", tmdb_id, ' type="tmdb" default="true"'),
    )


def show_nfo(name: Column, plot: Column, rating: Column, imdb_id: Column, premiered: Column) -> Column:
    return _document(
        "tvshow", _line("title", name), _line("plot", plot), _line("premiered", premiered), _rating_line(rating), _line("uniqueid", imdb_id, ' type="imdb"')
    )


def season_nfo(show: Column, season: Column, plot: Column) -> Column:
    return _document("season", _line("showtitle", show), _line("seasonnumber", season), _line("plot", plot))


def episode_nfo(show: Column, season: Column, number: Column, title: Column, aired: Column, plot: Column, rating: Column, imdb_id: Column) -> Column:
    return _document(
        "episodedetails", _line("showtitle", show), _line("season", season), _line("episode", number), _line("title", title), _line("aired", aired),
        _line("plot", plot), _rating_line(rating), _line("uniqueid", imdb_id, ' type="imdb"'),
    )
