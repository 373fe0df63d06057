"""Making the catalog match the disk: snapshot diff, sidecar joins, inheritance and the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelf.functions import names
from shelf.functions.names import base_name, folders, let, path_stem, stem

# fixed values: picture names that stand for a whole folder, in order of preference
DIR_ART = ["cover.jpg", "cover.png", "folder.jpg", "front.jpg", "poster.jpg", "poster.png"]
SHOW_ART = ["poster.jpg", "poster.png", "folder.jpg"]


def settled(files: DataFrame, now: int, grace_s: int) -> DataFrame:
    """Files not touched within the grace period (at least a second)."""
    return files.filter(F.lit(now) - F.col("mtime") >= max(grace_s, 1))


def unreflected(events: DataFrame, files: DataFrame) -> DataFrame:
    """Events the catalog does not already show with this size and mtime."""
    done = files.filter("status = 'ready'").select("root_id", "rel_path", "size", "mtime")
    return events.join(done, ["root_id", "rel_path", "size", "mtime"], "left_anti")


def unfinished(files: DataFrame) -> DataFrame:
    return files.filter("status <> 'ready'")


def folder_of(path: Column) -> Column:
    """The folder of a path, empty at the top; matched from the front, since a pattern tied to the end is tried at every place."""
    return F.regexp_extract(path, r"(?s)^(.*)/", 1)


def sibling(path: Column, ext: str) -> Column:
    """The path with another extension."""
    return F.concat(F.coalesce(path_stem(path), path), F.lit("." + ext))


def beside(media: DataFrame, inventory: DataFrame, ext: str, column: str) -> DataFrame:
    """Media with the mtime of the same-stem sidecar of a type, null without one."""
    side = inventory.filter(F.col("rel_path").endswith("." + ext)).select(
        "root_id", F.col("rel_path").alias("_side"), F.col("mtime").alias(column)
    )
    return media.withColumn("_side", sibling(F.col("rel_path"), ext)).join(side, ["root_id", "_side"], "left").drop("_side")


def discover_art(media: DataFrame, inventory: DataFrame) -> DataFrame:
    """Media with ``found_art``: the best picture beside each file, by kind.

    Movies take only their own poster; episodes their own, the folder's, then the folder
    above's, never one in the root itself; tracks take the folder's cover. Folder pictures
    are settled once per folder.
    """
    pictures = inventory.filter(F.lower("rel_path").rlike(r"\.(jpg|png)$")).select("root_id", F.col("rel_path").alias("art_path"))
    poster = r"^(.*)-poster\.(jpg|png)$"
    own = pictures.filter(F.col("art_path").rlike(poster)).groupBy("root_id", F.regexp_extract("art_path", poster, 1).alias("_stem")).agg(
        F.min("art_path").alias("_own")  # jpg sorts before png
    )
    # folder pictures by preference: those of an album, and those of a show or season
    at = lambda names: F.when(base_name(F.col("art_path")).isin(names), F.array_position(F.array(*[F.lit(n) for n in names]), base_name(F.col("art_path"))))
    shared = pictures.filter(base_name(F.col("art_path")).isin(sorted({*DIR_ART, *SHOW_ART}))).groupBy("root_id", folder_of(F.col("art_path")).alias("_dir")).agg(
        F.min_by("art_path", at(DIR_ART)).alias("_cover"), F.min_by("art_path", at(SHOW_ART)).alias("_show")
    )
    placed = media.withColumn("_dir", folder_of(F.col("rel_path"))).withColumn("_stem", F.coalesce(path_stem(F.col("rel_path")), F.col("rel_path")))
    is_music, is_movie = F.col("kind").eqNullSafe("music"), F.coalesce(F.col("kind") == "movies", F.lit(True))
    # each kind meets the pictures that it may take, so tracks meet no posters and movies no folders
    covers = placed.filter(is_music).join(shared.select("root_id", "_dir", "_cover"), ["root_id", "_dir"], "left").withColumn("found_art", F.col("_cover"))
    named = placed.filter(~is_music).join(own, ["root_id", "_stem"], "left")
    films = named.filter(is_movie).withColumn("found_art", F.col("_own"))
    dirs = placed.filter(~is_music & ~is_movie & (F.col("_dir") != "")).select("root_id", "_dir").distinct()
    shows = shared.filter("_show is not null").select("root_id", F.col("_dir").alias("_at"), "_show")
    above = F.when(F.col("_dir").contains("/"), folder_of(F.col("_dir")))
    tried = dirs.select("root_id", "_dir", F.posexplode(F.array_compact(F.array(F.col("_dir"), above))).alias("_rank", "_at"))
    best = tried.join(shows, ["root_id", "_at"]).groupBy("root_id", "_dir").agg(F.min_by("_show", "_rank").alias("_shared"))
    episodes = named.filter(~is_movie).join(best, ["root_id", "_dir"], "left").withColumn("found_art", F.coalesce("_own", "_shared"))
    columns = [*media.columns, "found_art"]
    return covers.select(*columns).unionByName(films.select(*columns)).unionByName(episodes.select(*columns))


def with_overrides(media: DataFrame, overrides: DataFrame) -> DataFrame:
    """Media with each override field from the nearest folder above that sets it.

    Resolved once per folder, not per file: folders meet overrides by each ancestor.
    """
    fields = [c for c in overrides.columns if c not in ("root_id", "rel_dir")]
    placed = media.withColumn("_dir", folder_of(F.col("rel_path")))
    parts = F.when(F.col("_dir") == "", F.array().cast("array<string>")).otherwise(F.split("_dir", "/"))
    above = F.transform(F.sequence(F.lit(0), F.size("_parts")), lambda i: F.array_join(F.slice("_parts", F.lit(1), i), "/"))
    dirs = placed.select("root_id", "_dir").distinct().withColumn("_parts", parts)
    reach = dirs.select("root_id", "_dir", F.posexplode(above).alias("depth", "rel_dir")).join(overrides, ["root_id", "rel_dir"])
    nearest = reach.groupBy("root_id", "_dir").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("depth"))).alias(f"over_{f}") for f in fields]
    )
    return placed.join(nearest, ["root_id", "_dir"], "left").drop("_dir")


def diff(known: DataFrame, walk: DataFrame, reachable: DataFrame) -> DataFrame:
    """Catalog against disk with one action per path.

    ``known`` carries root_id, rel_path, file_id, size, mtime, status, nfo_mtime,
    edl_mtime, art, updated_at; ``walk`` the media found with nfo_mtime, edl_mtime,
    found_art and override_mtime. Only reachable roots take part, so an unmounted one
    loses nothing.
    """
    roots = reachable.select("root_id").distinct()
    k = known.join(roots, "root_id", "left_semi").select(
        "root_id", "rel_path", *[F.col(c).alias("k_" + c) for c in known.columns if c not in ("root_id", "rel_path")]
    )
    w = walk.join(roots, "root_id", "left_semi").withColumn("_there", F.lit(True))
    both = k.join(w, ["root_id", "rel_path"], "full_outer")
    embedded = F.col("k_art") == "embedded"
    art_stale = F.when(embedded, F.col("found_art").isNotNull()).otherwise(~F.col("k_art").eqNullSafe(F.col("found_art")))
    stale = (
        ~F.col("k_nfo_mtime").eqNullSafe(F.col("nfo_mtime")) | ~F.col("k_edl_mtime").eqNullSafe(F.col("edl_mtime")) | art_stale
        | F.coalesce(F.col("override_mtime") > F.col("k_updated_at"), F.lit(False))
    )
    action = (
        F.when(F.col("k_file_id").isNull(), "new")
        .when(F.col("_there").isNull(), "vanished")
        .when((F.col("k_size") != F.col("size")) | (F.col("k_mtime") != F.col("mtime")), "changed")
        .when(F.col("k_status") != "ready", "retry")
        .when(stale, "stale")
        .otherwise("same")
    )
    return both.withColumn("action", action).drop("_there")


def inherited_added_at(rows: DataFrame, known: DataFrame, vanished: DataFrame) -> DataFrame:
    """Rows (root_id, rel_path, added_at, is_new) with added_at lowered to that of a same-stem sibling.

    A new file takes the earliest of its catalogued siblings; one already catalogued only
    takes that of a sibling that vanished.
    """
    key = ["root_id", "_stem"]
    stemmed = lambda df: df.withColumn("_stem", path_stem(F.col("rel_path")))
    every = stemmed(known).filter("_stem is not null").groupBy(*key).agg(F.min("added_at").alias("_known"))
    gone = stemmed(vanished).filter("_stem is not null").groupBy(*key).agg(F.min("added_at").alias("_gone"))
    joined = stemmed(rows).join(every, key, "left").join(gone, key, "left")
    sibling_time = F.when(F.col("is_new"), F.col("_known")).otherwise(F.col("_gone"))
    return joined.withColumn("added_at", F.least("added_at", sibling_time)).drop("_stem", "_known", "_gone")


def file_id_for(root_id: Column, rel_path: Column) -> Column:
    """Stable id of a path, so that re-running a batch gives the same ids."""
    return F.xxhash64(root_id, rel_path)


def next_files(diffed: DataFrame, known: DataFrame, now: int) -> DataFrame:
    """The files table after a diff: new and changed rows pending, vanished ones gone, the rest as they were."""
    vanished = diffed.filter("action = 'vanished'").select("root_id", "rel_path", F.col("k_added_at").alias("added_at"))
    live = diffed.filter("action <> 'vanished'")
    fresh = F.col("action").isin("new", "changed")
    pick = lambda c: F.when(fresh, F.col(c)).otherwise(F.col("k_" + c))
    rows = live.select(
        F.coalesce("k_file_id", file_id_for(F.col("root_id"), F.col("rel_path"))).alias("file_id"), "root_id", "rel_path",
        pick("size").alias("size"), pick("mtime").alias("mtime"), pick("kind").alias("kind"), pick("mime").alias("mime"),
        F.when(fresh, "pending").otherwise(F.col("k_status")).alias("status"),
        F.coalesce("k_added_at", F.lit(now)).cast("long").alias("added_at"),
        F.when(fresh, F.lit(now)).otherwise(F.col("k_updated_at")).cast("long").alias("updated_at"),
        (F.col("action") == "new").alias("is_new"), "action",
    )
    return inherited_added_at(rows, known.select("root_id", "rel_path", "added_at"), vanished)


def untouched_roots(known: DataFrame, reachable: DataFrame) -> DataFrame:
    """Rows of roots that could not be reached, kept as they are."""
    return known.join(reachable.select("root_id").distinct(), "root_id", "left_anti")


def sync_roots(existing: DataFrame, configured: DataFrame) -> DataFrame:
    """The roots table after matching the configured list (path, kind), with what happened to each.

    Known paths keep their id, new ones get a stable one of 63 bits, dropped ones are listed so their files can go. Two roots
    that would share an id stop the job, since their files would merge.
    """
    old = existing.select("path", "root_id", F.col("kind").alias("_old"))
    new = configured.select("path", "kind").distinct().withColumn("_in", F.lit(True))
    joined = old.join(new, "path", "full_outer")
    change = (
        F.when(F.col("_in").isNull(), "removed").when(F.col("root_id").isNull(), "added")
        .when(F.col("_old") != F.col("kind"), "updated").otherwise("kept")
    )
    made = F.xxhash64("path").bitwiseAND(F.lit(2**63 - 1))
    found = joined.select(F.coalesce(F.col("root_id").cast("long"), made).alias("root_id"), "path", F.coalesce("kind", "_old").alias("kind"), change.alias("change"))
    same = F.count(F.lit(1)).over(Window.partitionBy("root_id"))
    clash = F.raise_error(F.concat(F.lit("two roots share the id of "), "path")).cast("long")
    return found.withColumn("root_id", F.when(same > 1, clash).otherwise(F.col("root_id")))


def ensure_names(dimension: DataFrame, found: DataFrame) -> DataFrame:
    """A name dimension (id, name) with every new name added once whatever its case, under a stable id."""
    clean = found.select(F.trim("name").alias("name")).filter("name <> ''")
    new = clean.groupBy(F.lower("name").alias("_k")).agg(F.min("name").alias("name"))
    missing = new.join(dimension.select(F.lower("name").alias("_k")), "_k", "left_anti")
    stable = F.conv(F.substring(F.md5("_k"), 1, 15), 16, 10).cast("long")
    return dimension.select("id", "name").unionByName(missing.select(stable.alias("id"), "name"))


def under(files: DataFrame, removed: DataFrame) -> DataFrame:
    """(root_id, rel_path) of the files at or beneath removed paths (root_id, path).

    Each file meets removals by equality on itself and every folder above it.
    """
    parts = F.split("rel_path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return (
        files.select("root_id", "rel_path", F.explode(up).alias("path"))
        .join(removed.select("root_id", "path").distinct(), ["root_id", "path"], "left_semi")
        .select("root_id", "rel_path").distinct()
    )


def delete_under(files: DataFrame, removed: DataFrame) -> DataFrame:
    """Files left after removing paths (root_id, path): the path itself and all beneath it."""
    return files.join(under(files, removed), ["root_id", "rel_path"], "left_anti")


def affected_media(events: DataFrame, files: DataFrame) -> DataFrame:
    """Visible media a sidecar event concerns: (root_id, event_path, file_id, why).

    Same-stem sidecars concern their media, a poster its media, folder art the folder and
    one level down, music.toml everything beneath.

    What concerns whole folders is settled folder by folder, and files meet it once. Of the prefixes that a file could be
    named by, only those are tried that have as many points as an event in its folder.
    """
    f = files.filter("status = 'ready'").select("root_id", "rel_path", "file_id", "kind").withColumn("_dir", folder_of(F.col("rel_path")))
    path, name = F.col("event_path"), F.lower(base_name(F.col("event_path")))
    e = events.withColumn("_dir", folder_of(path))
    dirs = f.groupBy("root_id", "_dir").agg(F.max(F.col("kind") == "music").alias("_music"))
    art = e.filter(name.isin(DIR_ART)).select("root_id", "event_path", F.col("_dir").alias("_key"))
    near = dirs.select("root_id", "_dir", F.explode(F.array_distinct(F.array(F.col("_dir"), folder_of(F.col("_dir"))))).alias("_key"))
    toml = e.filter(base_name(path) == "music.toml").select("root_id", "event_path", F.col("_dir").alias("_key"))
    parts = F.when(F.col("_dir") == "", F.array().cast("array<string>")).otherwise(F.split("_dir", "/"))
    above = F.transform(F.sequence(F.lit(0), F.size("_parts")), lambda i: F.array_join(F.slice("_parts", F.lit(1), i), "/"))
    music = dirs.filter("_music").withColumn("_parts", parts).select("root_id", "_dir", F.explode(above).alias("_key"))
    shared = near.join(art, ["root_id", "_key"]).select("root_id", "_dir", "event_path", F.lit("folder art").alias("why")).unionByName(
        music.join(toml, ["root_id", "_key"]).select("root_id", "_dir", "event_path", F.lit("overrides").alias("why"))
    )
    # a media path starts with the sidecar's stem and a point
    side = e.filter(name.rlike(r"\.(nfo|edl)$") & ~name.isin("tvshow.nfo", "season.nfo")).withColumn("_key", F.regexp_replace(path, r"(?i)\.(nfo|edl)$", ""))
    poster = e.filter(name.rlike(r"-poster\.(jpg|png)$")).withColumn("_key", F.regexp_replace(path, r"(?i)-poster\.(jpg|png)$", ""))
    stems = side.select("root_id", "_dir", "event_path", "_key", F.lit("sidecar").alias("why")).unionByName(
        poster.select("root_id", "_dir", "event_path", "_key", F.lit("poster").alias("why"))
    )
    points = lambda text: F.size(F.split(base_name(text), r"\."))
    # at most as many numbers a folder as a name has points
    tried = stems.groupBy("root_id", "_dir").agg(F.collect_set(points(F.col("_key"))).alias("_tried"))
    # the numbers are known before the name is split, and it is split once
    def prefixes(dots: Column) -> Column:
        start = lambda n: F.array_join(F.slice(dots, F.lit(1), n), ".")
        fits = F.filter("_tried", lambda n: n < F.size(dots))
        return F.transform(fits, lambda n: F.when(F.col("_dir") == "", start(n)).otherwise(F.concat("_dir", F.lit("/"), start(n))))

    keys = let(F.split(base_name(F.col("rel_path")), r"\."), prefixes)
    keyed = f.join(tried, ["root_id", "_dir"]).select("root_id", "file_id", F.explode(keys).alias("_key"))
    by_stem = stems.join(keyed, ["root_id", "_key"]).select("root_id", "event_path", "file_id", "why")
    by_folder = f.select("root_id", "_dir", "file_id", "kind").join(shared, ["root_id", "_dir"])
    by_folder = by_folder.filter("why <> 'overrides' or kind = 'music'").select("root_id", "event_path", "file_id", "why")
    return by_stem.unionByName(by_folder)


def movie_facts(media: DataFrame, nfo: DataFrame, probes: DataFrame) -> DataFrame:
    """Movie rows: the sidecar over the parsed name over the container's tag, field by field."""
    n = nfo.select("file_id", *[F.col(c).alias("n_" + c) for c in nfo.columns if c != "file_id"])
    df = media.join(n, "file_id", "left").join(probes.select("file_id", "tag_genre"), "file_id", "left")
    df = df.withColumn("m", names.movie(stem(F.col("rel_path"))))
    title = F.coalesce("n_title", "m.title")
    genres = F.when(F.size("n_genres") > 0, F.col("n_genres")).otherwise(
        F.coalesce(names.split_genres(F.col("tag_genre")), F.array().cast("array<string>"))
    )
    return df.select(
        "file_id", title.alias("title"), names.sort_title(title).alias("sort_title"), F.coalesce("n_year", "m.year").alias("year"),
        F.col("n_rating").alias("rating"), F.col("n_plot").alias("plot"), F.col("n_imdb_id").alias("imdb_id"),
        F.col("n_collection").alias("collection"), genres.alias("genres"),
        F.coalesce("n_directors", F.array().cast("array<string>")).alias("directors"),
    )


def episode_facts(media: DataFrame, nfo: DataFrame) -> DataFrame:
    """Episode rows: the sidecar over the parsed name."""
    n = nfo.select("file_id", *[F.col(c).alias("n_" + c) for c in nfo.columns if c != "file_id"])
    path = F.col("rel_path")
    df = media.join(n, "file_id", "left").withColumn("e", names.episode(stem(path), folders(path)))
    return df.select(
        "file_id", F.coalesce("n_show_title", "e.series", F.lit("Unknown Series")).alias("series"),
        F.coalesce("n_season", "e.season", F.lit(0)).alias("season"), F.coalesce("n_episode", "e.episode", F.lit(0)).alias("episode"),
        F.coalesce(F.col("n_title"), F.col("e.title"), names.clean_name(stem(path))).alias("title"), F.col("n_plot").alias("plot"),
        F.col("n_rating").alias("rating"), F.col("n_imdb_id").alias("imdb_id"), F.col("n_aired").alias("aired"),
    )


def track_facts(media: DataFrame, tags: DataFrame, overrides: DataFrame) -> DataFrame:
    """Track rows: folder overrides over tags over the path; tags are (file_id, title, artist, ...)."""
    path = F.col("rel_path")
    t = tags.select("file_id", *[F.col(c).alias("t_" + c) for c in tags.columns if c != "file_id"])
    df = with_overrides(media, overrides).join(t, "file_id", "left").withColumn("p", names.track(stem(path), folders(path)))
    filled = lambda c: F.nullif(F.trim("t_" + c), F.lit(""))
    title = F.coalesce(filled("title"), F.col("p.title"))
    number = F.coalesce("t_track_no", "p.track_no")
    # leading digits belong to the title, unless the title came from a tag
    whole = ~F.coalesce("over_track_number_prefix", F.lit(True)) & (title == F.col("p.title"))
    genres = names.split_genres(F.coalesce("over_genre", "t_genre"))
    return df.select(
        "file_id", F.when(whole, names.clean_name(stem(path))).otherwise(title).alias("title"),
        F.coalesce(F.col("over_artist"), filled("artist"), F.col("p.artist")).alias("artist"),
        F.coalesce(F.col("over_album_artist"), filled("album_artist")).alias("album_artist"),
        F.coalesce(F.col("over_album"), filled("album"), F.col("p.album")).alias("album"),
        F.when(whole & number.eqNullSafe(F.col("p.track_no")), F.lit(None)).otherwise(number).alias("track_no"),
        F.col("t_disc_no").alias("disc_no"), F.col("t_year").alias("year"), F.coalesce(genres, F.array().cast("array<string>")).alias("genres"),
    )
