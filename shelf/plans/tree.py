"""The browse tree as two tables: nodes, and the items each leaf listing shows, both with the keys of their order.

An order key is a string whose text order is the listing's order; behind the keys of its ancestors it places a row in the whole tree,
so a flattened container is sorted by one column. Names hold no control characters, which part the keys.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.functions import keys as K
from shelf.operators import counts, listings
from shelf.operators.counts import folder_of
from shelf.operators.merge import COPY, episode_keys, merge_renditions, movie_keys
from shelf.operators.windows import numbered, ordered_columns
from shelf.session import written, written_together

FOLDER = "object.container.storageFolder"
MOVIE_GENRE = "object.container.genre.movieGenre"
MUSIC_GENRE = "object.container.genre.musicGenre"
ARTIST = "object.container.person.musicArtist"
PERSON = "object.container.person"
ALBUM = "object.container.album.musicAlbum"

# fixed values: the nodes that exist whatever the catalog holds: (id, parent, title, kind of root they need)
FIXED_NODES = [
    ("mv", "0", "Movies", "movies"), ("mu", "0", "Music", "music"), ("tv", "0", "TV Shows", "tv"),
    ("mv:all", "mv", "All Movies", "movies"), ("mv:recent", "mv", "Recently Added", "movies"), ("mv:4k", "mv", "4K", "movies"),
    ("mv:year", "mv", "By Year", "movies"), ("mv:decade", "mv", "By Decade", "movies"), ("mv:genre", "mv", "By Genre", "movies"),
    ("mv:director", "mv", "By Director", "movies"), ("mv:set", "mv", "By Franchise", "movies"),
    ("mv:rating", "mv", "By Rating", "movies"), ("mv:dir", "mv", "Folders", "movies"),
    ("mu:recent", "mu", "Recently Added", "music"), ("mu:artist", "mu", "Artists", "music"), ("mu:album", "mu", "Albums", "music"),
    ("mu:genre", "mu", "Genres", "music"), ("mu:dir", "mu", "Folders", "music"),
    ("tv:recent", "tv", "Recently Added", "tv"), ("tv:4k", "tv", "4K", "tv"), ("tv:dir", "tv", "Folders", "tv"),
]

ITEM_FIELDS = ["kind", "title", "year", "rating", "genre", "director", "artist", "album", "series", "season", "episode",
               "size", "duration_ms", "width", "height", "extras", "art_file_id"]
FOLDER_FIELDS = ["folder_root", "folder"]
#: The kinds of leaf listing; "tv:ser" is a season, "dir" a folder.
LISTINGS = ["mv:all", "mv:4k", "mv:year", "mv:decade", "mv:genre", "mv:director", "mv:set", "mv:rating", "mv:recent",
            "mu:album", "mu:genre", "mu:recent", "tv:ser", "tv:4k", "tv:recent", "dir"]
MARK = "\u0001"
#: What nodes and counts tell files of a kind apart by, in sets that none of them needs together; pictures by more.
TOLD_APART = {
    "movies": [["root_id", "folder"], ["title", "year", "director", "directors"], ["title", "year", "genre", "genres", "collection", "rated", "uhd", "has_art"]],
    "episodes": [["root_id", "folder", "series", "season", "episode", "aired", "uhd", "has_art"]],
    "tracks": [["root_id", "folder", "artist", "album_artist", "album", "genre", "genres", "has_art", "track_no"]],
}


@dataclass
class Library:
    """Frames of one catalog snapshot, visible rows only, each written once so that it may be read several times.

    A frame that no listing asked for reads (``node_items``) may be None, and a column that it doesn't show may be left out.
    """

    movies: DataFrame  # movie items with sort_title, collection, added_at, and genres and directors as arrays of (id, name)
    episodes: DataFrame
    tv_series: DataFrame
    tracks: DataFrame  # with genres as an array of (id, name)
    files: DataFrame  # any_items: every visible file of any kind
    roots: DataFrame  # root_id, kind, path


def grouped(kind: str, items: DataFrame, art: bool = True) -> DataFrame:
    """Items of a kind ("movies", "episodes" or "tracks") put together where no node or count tells them apart: ``files`` of them, the smallest ``file_id``.

    Each set of ``TOLD_APART`` holds every file once, with nulls for the other sets' columns. ``split`` makes of it frames of a library that serves ``nodes``
    and ``node_counts``; without ``art`` its nodes have no pictures. Every aggregate is a number, so tasks sort no files.
    """
    made = {"folder": folder_of(F.col("rel_path"))}
    if kind != "tracks":
        made["uhd"] = counts.uhd_of(items)
    if kind == "movies":
        made["rated"] = counts.rated_of(items)
    if kind == "episodes":
        made["aired"] = F.substring("aired", 1, 4)
    items = items.withColumns(made)
    pictured = ["has_art", "track_no"]
    sets = [[x for x in told if x in items.columns and (art or x not in pictured)] for told in TOLD_APART[kind]]
    keys = list(dict.fromkeys(x for told in sets for x in told))
    groups = items.groupBy(*keys) if len(sets) == 1 else items.groupingSets([[F.col(x) for x in told] for told in sets], *[F.col(x) for x in keys])
    out = groups.agg(F.min("file_id").alias("file_id"), F.count(F.lit(1)).alias("files"))
    return out if art else out.withColumns({"has_art": F.lit(False), "track_no": F.lit(None).cast("int")})


def split(kind: str, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``grouped`` gives as items of the kind and as files (kind, root_id, folder, files)."""
    part = groups.filter("folder is not null").select(F.lit("tv" if kind == "episodes" else "music" if kind == "tracks" else kind).alias("kind"), "root_id", "folder", "files")
    return groups.filter("folder is null") if len(TOLD_APART[kind]) > 1 else groups, part


def with_names(items: DataFrame, bridge: DataFrame, key: str, out: str) -> DataFrame:
    """Items with an array ``out`` of (id, name) from a bridge (file_id, key, name); a file has few names by nature."""
    listed = bridge.groupBy("file_id").agg(F.collect_list(F.struct(F.col(key).cast("long").alias("id"), "name")).alias(out))
    return items.join(listed, "file_id", "left").withColumn(out, F.coalesce(out, F.array().cast("array<struct<id:bigint,name:string>>")))


def dimension_id(name: Column) -> Column:
    """Stable id of a genre or director name, whatever its case."""
    return F.conv(F.substring(F.md5(F.lower(F.trim(name))), 1, 15), 16, 10).cast("long")


def number_key(value: Column) -> Column:
    """Text that sorts as the numbers do, to a thousandth, nulls first; for numbers below 4e15."""
    return F.coalesce(F.lpad((F.floor(value.cast("double") * 1000 + 0.5) + (1 << 62)).cast("string"), 19, "0"), F.lit("0"))


def id_key(value: Column) -> Column:
    """Text that sorts as the ids do, for ids of 62 bits."""
    return F.lpad((value.cast("long") + (1 << 62)).cast("string"), 19, "0")


def joined_key(*parts: Column) -> Column:
    """Keys one after another, each ended by a mark that sorts before any letter; a null is an empty key."""
    return F.concat(*[x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit(MARK))])


def root_titles(roots: DataFrame) -> DataFrame:
    """Folder-view roots: the last path part, with its parent where the name is ambiguous within a kind."""
    parts = F.split("path", "/")
    base = F.element_at(parts, -1)
    same = roots.groupBy("kind", base.alias("base")).agg(F.count(F.lit(1)).alias("same"))
    above = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    named = roots.withColumn("base", base).join(same, ["kind", "base"])
    return named.select(
        "root_id", "kind", "path", F.when(F.col("same") > 1, F.concat("base", F.lit(" ("), above, F.lit(")"))).otherwise(F.col("base")).alias("title")
    )


def section_of(kind: Column) -> Column:
    return F.when(kind == "movies", "mv").when(kind == "music", "mu").when(kind == "tv", "tv")


def _made(df: DataFrame, node: Column, parent: Column, title: Column, key: Column, cls: str | Column = FOLDER, art: Column | None = None,
          canonical: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("long")
    return df.select(
        node.alias("node_id"), parent.alias("parent_id"), title.cast("string").alias("title"), (F.lit(cls) if isinstance(cls, str) else cls).alias("class"),
        (null if art is None else art).alias("art_file_id"), (node if canonical is None else canonical).alias("count_id"), key.alias("key"),
    )


def _names_in_use(items: DataFrame, names: str) -> DataFrame:
    """(id, name) of the genres or directors of visible items: distinct pairs first, which are few."""
    pairs = items.select(F.explode(names).alias("x")).select("x.id", "x.name").distinct()
    return pairs.groupBy("id").agg(F.min("name").alias("name"))


def _series_names(lib: Library) -> DataFrame:
    """The spelling that each series goes by."""
    return lib.episodes.groupBy(F.lower("series").alias("k_series")).agg(F.min_by("series", "file_id").alias("series"))


def nodes(lib: Library) -> DataFrame:
    """Every container: id, parent, title, class, picture, the id its count hangs on, and ``key``, its place among its siblings."""
    spark = lib.roots.sparkSession
    c = F.col
    fixed = spark.createDataFrame([(*n, i) for i, n in enumerate(FIXED_NODES)], "node string, parent string, name string, kind string, nr int")
    fixed = fixed.join(lib.roots.select("kind").distinct(), "kind", "left_semi")
    top = spark.createDataFrame([("0", "0", "Media")], "node string, parent string, name string")
    out = [_made(top, c("node"), c("parent"), c("name"), F.lit("")), _made(fixed, c("node"), c("parent"), c("name"), number_key(c("nr")))]
    buckets = spark.range(K.UNRATED + 1).select(c("id").cast("int").alias("b"))
    out.append(_made(buckets, K.node_id("mv:rating", c("b")), F.lit("mv:rating"), K.bucket_title(c("b")), number_key(c("b"))))
    roots = root_titles(lib.roots)
    out.append(_made(roots, K.dir_id(c("root_id"), F.lit("")), F.concat(section_of(c("kind")), F.lit(":dir")), c("title"), joined_key(c("path"))))

    m = lib.movies
    dates = m.select("year").distinct()
    for found, column, text in (
        (listings.years(dates, ordered=False), "year", c("year").cast("string")),
        (listings.decades(dates, ordered=False), "decade", F.concat(c("decade").cast("string"), F.lit("s"))),
    ):
        view = f"mv:{column}"
        out.append(_made(found, K.node_id(view, c(column)), F.lit(view), text, number_key(-c(column))))
    for items, names, view, cls in (
        (m, "genres", "mv:genre", MOVIE_GENRE), (m, "directors", "mv:director", PERSON), (lib.tracks, "genres", "mu:genre", MUSIC_GENRE),
    ):
        out.append(_made(_names_in_use(items, names), K.node_id(view, c("id")), F.lit(view), c("name"), joined_key(c("name")), cls))
    out.append(_made(
        listings.franchises(m, ordered=False), K.node_id("mv:set", K.encode(c("name"))), F.lit("mv:set"), c("name"), joined_key(c("k_collection")),
        art=c("art_file_id"), canonical=K.node_id("mv:set", K.encode(c("k_collection"))),
    ))
    artist = K.node_id("mu:artist", K.encode(c("artist")))
    out.append(_made(listings.artist_art(lib.tracks), artist, F.lit("mu:artist"), c("artist"), joined_key(F.lower("artist"), c("artist")), ARTIST, c("art_file_id")))
    out.append(_made(listings.albums(lib.tracks, ordered=False), K.node_id("mu:album", K.encode(c("artist")), K.encode(c("album"))), artist, c("album"),
                     album_key(c("artist"), c("album")), ALBUM, c("art_file_id")))

    shows = listings.series_list(lib.episodes, lib.tv_series, ordered=False)
    series, folded = K.node_id("tv:ser", K.encode(c("series"))), K.node_id("tv:ser", K.encode(c("k_series")))
    out.append(_made(shows, series, F.lit("tv"), K.with_year(c("series"), c("year")), series_key(c("k_series")), art=c("art_file_id"), canonical=folded))
    # a season stands under its series' spelling
    seasons = listings.seasons(lib.episodes, ordered=False).drop("series").join(_series_names(lib), "k_series")
    out.append(_made(
        seasons, K.node_id("tv:ser", K.encode(c("series")), c("season")), series, K.season_title(c("season"), c("year")), number_key(c("season")),
        art=c("art_file_id"), canonical=K.node_id("tv:ser", K.encode(c("k_series")), c("season")),
    ))
    dirs = counts.folders(lib.files).select("root_id", F.explode(counts.ancestors(F.concat("folder", F.lit("/")))).alias("rel_dir")).distinct()
    above, name = folder_of(c("rel_dir")), F.substring_index("rel_dir", "/", -1)
    out.append(_made(dirs, K.dir_id(c("root_id"), c("rel_dir")), K.dir_id(c("root_id"), above), name, joined_key(F.lower(name), name)))

    return written_together(out, "tree-nodes")


def series_key(k_series: Column) -> Column:
    """Series come after the fixed views of their section."""
    return F.concat(number_key(F.lit(len(FIXED_NODES))), joined_key(k_series))


def album_key(artist: Column, album: Column) -> Column:
    return joined_key(F.lower(album), F.lower(artist), album, artist)


def _shaped(df: DataFrame, node: Column, kind: str | Column, title: Column, order: list[Column], at: Column | None = None, view: Column | None = None,
            fields: Collection[str] = ITEM_FIELDS, **known: Column) -> DataFrame:
    """One listing's rows with the item columns ``fields``, nulls where the listing has none.

    ``key`` orders the listing. ``at`` is its node's place among all nodes that a container above shows, ``view`` that in a wider
    view, where the order is another; a folder has its root's place in ``view`` and gets the rest in ``scopes``.
    """
    types = {"year": "int", "rating": "double", "season": "int", "episode": "int", "size": "long", "duration_ms": "long",
             "width": "int", "height": "int", "extras": "long", "art_file_id": "long"}
    none = F.lit("")
    cols = [node.alias("node_id"), F.col("file_id"), F.concat(joined_key(*order), id_key(F.col("file_id"))).alias("key"),
            (none if at is None else at).alias("at"), (none if view is None else view).alias("view")]
    for name in fields:
        if name == "kind":
            value = F.lit(kind) if isinstance(kind, str) else kind
        elif name == "title":
            value = title
        elif name in known:
            value = known[name]
        elif name in df.columns:
            value = F.col(name)
        else:
            value = F.lit(None)
        cols.append(value.cast(types.get(name, "string")).alias(name))
    cols.append(known.get("folder_root", F.lit(None)).cast("long").alias("folder_root"))
    cols.append(known.get("folder", F.lit(None)).cast("string").alias("folder"))
    return df.select(*cols)


def _movie_works(lib: Library, leaves: Collection[str] = LISTINGS, fields: Collection[str] = ITEM_FIELDS) -> DataFrame:
    """Works of the movie listings ``leaves`` but the newest: copies stand once for each of their groups and are merged in one aggregate."""
    c = F.col
    carry = ["title", "sort_title", "year", "rating", "v_name", *[x for x in ("genre", "director") if x in fields]]
    copy = ["file_id", *[x for x in COPY if x in fields]]
    m = lib.movies.select("file_id", "size", "width", "height", "has_art", "collection", "genres", "directors", *[x for x in carry if x != "v_name"],
                          *[x for x in copy if x not in ("file_id", "size", "width", "height")])
    group = lambda tag, v: F.struct(F.lit(tag).alias("tag"), v.cast("string").alias("v"))
    null, rated, named = F.lit(None), K.rating_bucket(c("rating")), F.nullif(F.lower("collection"), F.lit(""))
    # the year is part of a work, so All Movies' works serve the year and decade views too
    dated = [tag for tag in ("mv:all", "mv:year", "mv:decade") if tag in leaves]
    asked = {
        "mv:4k": F.when(K.is_uhd(c("width"), c("height")), group("mv:4k", null)), "mv:rating": F.when(rated.isNotNull(), group("mv:rating", rated)),
        "mv:set": F.when(named.isNotNull(), group("mv:set", named)),
    }
    own = [group("mv:all", null)] * bool(dated) + [g for tag, g in asked.items() if tag in leaves]
    parts = []
    if own:
        rows = m.drop("genres", "directors").select("*", F.lit(None).cast("string").alias("v_name"), F.explode(F.array(*own)).alias("_g"))
        parts.append(rows.filter("_g is not null").select("*", "_g.tag", "_g.v").drop("_g"))
    for names, tag in (("genres", "mv:genre"), ("directors", "mv:director")):
        if tag in leaves:
            more = m.select("*", F.explode(names).alias("_x")).drop("genres", "directors")
            parts.append(more.select("*", c("_x.name").alias("v_name"), F.lit(tag).alias("tag"), c("_x.id").cast("string").alias("v")).drop("_x"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.withColumn("_r", F.coalesce(F.when(c("tag") == "mv:rating", -c("rating")), F.lit(0.0)))
    film = merge_renditions(rows, {"tag": c("tag"), "v": c("v"), **movie_keys()}, carry, [c("_r"), c("file_id")], copy)
    if "mv:set" in leaves:
        big = counts.big_franchises(lib.movies).select(c("k_collection").alias("k_set"), c("name").alias("set_name"))
        film = film.join(big, (c("tag") == "mv:set") & (c("v") == c("k_set")), "left").filter("tag <> 'mv:set' or set_name is not null")
    else:
        film = film.withColumn("set_name", F.lit(None).cast("string"))
    if not dated:
        return film
    years = {"mv:all": F.struct("tag", "v"), "mv:year": F.when(c("year").isNotNull(), group("mv:year", c("year"))),
             "mv:decade": F.when(c("year").isNotNull(), group("mv:decade", K.decade(c("year"))))}
    spread = F.when(c("tag") == "mv:all", F.array_compact(F.array(*[years[tag] for tag in dated]))).otherwise(F.array(F.struct("tag", "v")))
    return film.withColumn("_g", F.explode(spread)).drop("tag", "v").select("*", "_g.tag", "_g.v").drop("_g")


def node_items(lib: Library, recent: int = 25, leaves: Collection[str] = LISTINGS, fields: Collection[str] = ITEM_FIELDS) -> DataFrame:
    """Items of every leaf listing, merged as that listing merges them, with its titles and the keys of its order.

    ``leaves`` names the kinds of listing to make (of ``LISTINGS``), each whole, and ``fields`` the item columns; ``kind`` always comes. Ordering a listing is
    ``orderBy("key")``; no row is numbered here, so the listing that holds the whole library never has to pass through one task.
    Listings that are merged or cut are written. Those that show the library's own rows, which are most of all, are not written a second time but made of them whenever they are read.
    """
    c = F.col
    fields = [x for x in ITEM_FIELDS if x == "kind" or x in fields]
    made, own = [], []

    def add(*shape, **known) -> None:
        made.append(_shaped(*shape, fields=fields, **known))

    def show(*shape, **known) -> None:
        own.append(_shaped(*shape, fields=fields, **known))

    newest = [number_key(-c("added_at")), id_key(-c("file_id"))]
    if any(x.startswith("mv:") and x != "mv:recent" for x in leaves):
        film = _movie_works(lib, leaves, fields)
        tag, v = c("tag"), c("v")
        rated, by_year = tag == "mv:rating", tag.isin("mv:set", "mv:director")
        title = F.when(rated, K.with_score(c("title"), c("rating"))).otherwise(c("title"))
        title = F.when(tag == "mv:year", title).otherwise(K.with_year(title, c("year")))
        n1 = F.when(rated, F.coalesce(-c("rating"), F.lit(0.0))).when(by_year, c("year").cast("double")).otherwise(F.lit(0.0))
        node = F.when(v.isNull(), tag).when(tag == "mv:set", K.node_id("mv:set", K.encode(c("set_name")))).otherwise(F.concat_ws(":", tag, v))
        place = (
            F.when(tag.isin("mv:year", "mv:decade"), number_key(-v.cast("int"))).when(rated, number_key(v.cast("int")))
            .when(tag == "mv:set", joined_key(v)).when(v.isNotNull(), joined_key(c("v_name"))).otherwise(F.lit(""))
        )
        add(film, node, "movies", title, [number_key(n1), F.lower("sort_title")], place)
    if "mv:recent" in leaves:
        fresh = listings.recent_movies(lib.movies, recent)
        add(fresh, F.lit("mv:recent"), "movies", K.with_year(c("title"), c("year")), [number_key(c("_ord.o0")), id_key(c("_ord.o1"))])

    t = lib.tracks
    artist, album = K.display_artist(c("album_artist"), c("artist")), K.display_album(c("album"))
    if "mu:album" in leaves:
        on_album = [number_key(c("disc_no")), number_key(c("track_no")), F.lower("title")]
        show(t, K.node_id("mu:album", K.encode(artist), K.encode(album)), "music", c("title"), on_album,
             F.concat(joined_key(F.lower(artist), artist), album_key(artist, album)), album_key(artist, album))
    if "mu:genre" in leaves:
        genre = t.select("*", F.explode("genres").alias("_x"))
        show(genre, K.node_id("mu:genre", c("_x.id")), "music", c("title"), [F.lower("title")], joined_key(c("_x.name")))
    if "mu:recent" in leaves:
        add(listings.recent(t, recent), F.lit("mu:recent"), "music", K.qualified_track(c("artist"), c("album"), c("title")), newest)

    e = lib.episodes
    if "tv:ser" in leaves:
        copy = ["file_id", *[x for x in COPY if x in fields]]
        carry = [x for x in listings.EPISODE_FIELDS if x in ("series", "season", "episode", "title") or x in fields]
        works = merge_renditions(e, episode_keys(), carry, copy=copy).join(_series_names(lib).withColumnRenamed("series", "series_name"), "k_series")
        numbered_title = F.concat(K.two_digits(c("episode")), F.lit(" - "), c("title"))
        season = F.concat(series_key(c("k_series")), number_key(c("season")))
        add(works, K.node_id("tv:ser", K.encode(c("series_name")), c("season")), "tv", numbered_title, [number_key(c("episode"))], season)
    full = K.qualified_episode(c("series"), c("season"), c("episode"), c("title"))
    if "tv:4k" in leaves:
        show(listings.uhd(e), F.lit("tv:4k"), "tv", full, [F.lower("series"), number_key(c("season")), number_key(c("episode"))])
    if "tv:recent" in leaves:
        add(listings.recent(e, recent), F.lit("tv:recent"), "tv", full, newest)

    if "dir" in leaves:
        folder = c("folder") if "folder" in lib.files.columns else folder_of(c("rel_path"))
        placed = lib.files.join(lib.roots.select("root_id", joined_key(c("path")).alias("root_key")), "root_id")
        show(placed, K.dir_id(c("root_id"), folder), c("kind"), c("title"), [F.lower("title")], view=c("root_key"), folder_root=c("root_id"), folder=folder)

    out = written_together(made, "tree-items") if made else own.pop()
    for listing in own:
        out = out.unionByName(listing)
    return out


def children(tree: DataFrame, node: str) -> DataFrame:
    """Containers directly under a node in their order; the album view lists every album."""
    below = (F.col("class") == ALBUM) if node == "mu:album" else (F.col("parent_id") == node) & (F.col("node_id") != node)
    return tree.filter(below).orderBy("key", "node_id")


def children_of(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """Containers under each of the nodes ``asked`` (node): what ``children`` gives, for any number of them at once; ``key`` is their order."""
    below = tree.filter(F.col("parent_id") != F.col("node_id")).withColumn("node", F.col("parent_id"))
    every = tree.filter(F.col("class") == ALBUM).withColumn("node", F.lit("mu:album"))
    return below.unionByName(every).join(asked.select("node"), "node", "left_semi")


def listing(items: DataFrame, node: str) -> DataFrame:
    """Items of one leaf node in its order."""
    return items.filter(F.col("node_id") == node).orderBy("key")


def node_counts(lib: Library, recent: int = 25) -> DataFrame:
    """Playable items below every container, keyed by count_id."""
    c = F.col

    def made(df: DataFrame, node: Column, n: Column) -> DataFrame:
        return df.select(node.alias("count_id"), n.cast("long").alias("n"))

    def fanned(one_row: DataFrame, values: dict[str, Column]) -> DataFrame:
        pairs = [F.struct(F.lit(node).alias("node"), n.cast("long").alias("n")) for node, n in values.items()]
        return one_row.select(F.explode(F.array(*pairs)).alias("p")).select(c("p.node").alias("count_id"), c("p.n").alias("n"))

    films = counts.movie_totals(lib.movies)
    capped = F.least(c("total"), F.lit(recent))
    out = [fanned(films, {
        "mv": c("total"), "mv:all": c("total"), "mv:recent": capped, "mv:4k": c("uhd"), "mv:year": c("dated"),
        "mv:decade": c("dated"), "mv:genre": c("with_genre"), "mv:director": c("with_director"),
        "mv:set": c("in_franchises"), "mv:rating": c("total"),
    })]

    by = counts.movie_counts(lib.movies)
    node = (
        F.when(c("dim") == "franchise", K.node_id("mv:set", K.encode(c("value"))))
        .when(c("dim").isin("genre", "director"), F.concat(F.lit("mv:"), c("dim"), F.lit(":"), dimension_id(c("value")).cast("string")))
        .otherwise(F.concat(F.lit("mv:"), c("dim"), F.lit(":"), c("value")))
    )
    out.append(made(by, node, c("n")))
    spark = lib.roots.sparkSession
    empty = spark.range(K.UNRATED + 1).select(K.node_id("mv:rating", c("id")).alias("count_id"), F.lit(0).cast("long").alias("n"))

    music = counts.track_counts(lib.tracks)
    artist, album = K.encode(c("artist")), K.encode(c("album"))
    out.append(made(music.filter("level = 0"), K.node_id("mu:album", artist, album), c("n")))
    out.append(made(music.filter("level = 1"), K.node_id("mu:artist", artist), c("n")))
    whole = music.filter("level = 3")
    out.append(fanned(whole, {
        "mu": c("n"), "mu:recent": F.least(c("n"), F.lit(recent)), "mu:artist": c("n"), "mu:album": c("n"), "mu:genre": c("with_genre"),
    }))
    out.append(made(counts.track_genre_counts(lib.tracks), K.node_id("mu:genre", dimension_id(c("genre"))), c("n")))

    tv = counts.episode_counts(lib.episodes)
    series = K.encode(c("k_series"))
    out.append(made(tv.filter("level = 0"), K.node_id("tv:ser", series, c("k_season")), c("n")))
    out.append(made(tv.filter("level = 1"), K.node_id("tv:ser", series), c("n")))
    whole = tv.filter("level = 3")
    out.append(fanned(whole, {"tv": c("n"), "tv:recent": F.least(c("n"), F.lit(recent)), "tv:4k": c("uhd")}))

    per = counts.file_counts(lib.files)
    out.append(made(per.filter("level = 1"), F.concat(section_of(c("kind")), F.lit(":dir")), c("n")))
    out.append(made(per.filter("level = 0"), K.dir_id(c("root_id"), F.lit("")), c("n")))
    out.append(made(counts.folder_counts(lib.files), K.dir_id(c("root_id"), c("rel_dir")), c("n")))

    # a bucket nothing falls into still shows a zero
    return written_together([*out, empty], "tree-counts").groupBy("count_id").agg(F.max("n").alias("n"))


SECTIONS = ["mv", "mu", "tv"]


def leaves_under(scope: Column) -> Column:
    """The kinds of leaf listing (of ``LISTINGS``) that ``scopes`` finds under a container; none for what is no container."""
    head = F.concat_ws(":", F.slice(F.split(scope, ":"), 1, 2))
    these = lambda *leaves: F.array(*[F.lit(x) for x in leaves])
    return (
        F.when(scope == "0", these("mv:all", "mu:album", "tv:ser")).when(scope == "mv", these("mv:all")).when((scope == "mu") | (head == "mu:artist"), these("mu:album"))
        .when(scope == "tv", these("tv:ser")).when(scope.startswith("dir:") | head.isin(*[f"{x}:dir" for x in SECTIONS]), these("dir"))
        .when(head.isin(*LISTINGS), F.array(head)).otherwise(F.array().cast("array<string>"))
    )


def asked_leaves(asked: DataFrame) -> list[str]:
    """The kinds of leaf listing that any of the containers ``asked`` (scope) shows, at most as many as there are; all where none shows any."""
    found = {r["leaf"] for r in asked.select(F.explode(leaves_under(F.col("scope"))).alias("leaf")).distinct().collect()}
    return [x for x in LISTINGS if x in found or not found]


def scopes() -> Column:
    """(scope, place) of the containers whose subtree shows a leaf listing when one exhaustive view stands for each section.

    ``place`` is where the listing stands among those of the container. A folder is reached from at most five levels up.
    """
    node, kind = F.col("node_id"), F.col("kind")
    at, view = F.col("at"), F.col("view")
    names = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/"))
    # folders stand before the files beside them
    inside = F.concat(F.array_join(F.transform(names, lambda x: F.concat(F.lit("0"), joined_key(F.lower(x), x))), ""), F.lit("1"))
    parts = F.split(node, ":")
    head = F.concat_ws(":", F.slice(parts, 1, 2))
    artist = K.node_id("mu:artist", F.get(parts, F.lit(2)))
    series = K.node_id("tv:ser", F.get(parts, F.lit(2)))
    levels = F.when(F.col("folder") == "", F.lit(0)).otherwise(F.size(F.split("folder", "/")))

    def pair(scope: Column, place: Column) -> Column:
        return F.struct(scope.alias("scope"), place.alias("place"))

    def top(section: str, place: Column) -> Column:
        return pair(F.lit("0"), F.concat(F.lit(str(SECTIONS.index(section))), place))

    # the folder itself and up to five above it, by cutting names off the end
    up = [F.when(levels >= i, pair(K.dir_id(F.col("folder_root"), F.when(levels == i, F.lit("")).otherwise(
        F.regexp_replace("folder", rf"(/[^/]*){{{i}}}$", "") if i else F.col("folder"))), inside)) for i in range(6)]
    whole = F.when(levels <= 4, pair(F.concat(section_of(kind), F.lit(":dir")), F.concat(view, inside)))
    return (
        F.when(node == "mv:all", F.array(pair(node, at), pair(F.lit("mv"), at), top("mv", at)))
        .when(head == "mu:album", F.array(pair(node, at), pair(artist, at), pair(F.lit("mu:artist"), at), pair(F.lit("mu:album"), view), pair(F.lit("mu"), view), top("mu", view)))
        .when(head == "tv:ser", F.array(pair(node, at), pair(series, at), pair(F.lit("tv"), at), top("tv", at)))
        .when(F.col("folder").isNotNull(), F.array_compact(F.array(*up, whole)))
        .when(F.size(parts) == 3, F.array(pair(node, at), pair(head, at)))
        .otherwise(F.array(pair(node, at)))
    )


# containers whose children can show one file twice; all others split their files among their children
SHARED_SCOPES = ["mv:genre", "mv:director", "mu:genre"]


def leaves_of(items: DataFrame) -> DataFrame:
    """(node_id, scopes): the containers over each listing of ``items``. A genre spelled in several ways stands where its first spelling does."""
    same = ["node_id", "kind", "view", "folder_root", "folder"]
    return items.select(*same, "at").distinct().groupBy(*same).agg(F.min("at").alias("at")).select("node_id", scopes().alias("scopes"))


def listed_order() -> list[Column | str]:
    """The order of items inside their listings, a key without the id that ends it before the id itself, which then isn't sorted and shuffled twice."""
    own = F.substr("key", F.lit(1), F.length("key") - F.length(id_key(F.col("file_id"))))
    return ["node_id", F.when(F.endswith("key", id_key(F.col("file_id"))), own).otherwise(F.col("key")), "file_id"]


def places(items: DataFrame) -> DataFrame:
    """(node_id, file_id, title if there, place): items with their places in their listings, from 1.

    All items are sorted and numbered once, whatever their listing; a place is the distance from the listing's first item.
    """
    shown = [x for x in ("node_id", "file_id", "title") if x in items.columns]
    ranked = numbered(items.select(*shown, "key"), listed_order(), shown)
    firsts = written(ranked.groupBy("node_id").agg(F.min("nr").alias("first")), "tree-firsts")
    return ranked.join(firsts, "node_id").select(*shown, (F.col("nr") - F.col("first") + 1).alias("place"))


def flatten(items: DataFrame) -> DataFrame:
    """(scope, file_id, place): items under every container, each file once per container; ``place`` numbers a container's files from 1, as a walk of the tree meets them.

    Items are sorted and numbered once, inside their listings. Of a container only its listings are put in order: the items in those before give the
    number from which a listing counts on, so what is sorted and shuffled doesn't grow with the containers over an item. In the few containers
    whose children overlap, that number tells where a file is met first, and what is left is numbered anew. No two listings of a container
    share a place in it: roots differ in path, folders, series and albums in name.
    """
    ranked = numbered(items.select("node_id", "file_id", "key"), listed_order(), ["node_id", "file_id"])
    sizes = ranked.groupBy("node_id").agg(F.min("nr").alias("first"), F.count(F.lit(1)).alias("n"))
    over = leaves_of(items).join(sizes, "node_id").select("node_id", "first", "n", F.explode("scopes").alias("s"))
    over = ordered_columns(over.select("node_id", "first", "n", "s.scope", "s.place"), ["scope"], ["place", "node_id"], True, before=("sum_before", F.col("n")))
    begins = over.groupBy("node_id").agg(F.collect_list(F.struct("scope", (F.col("before") - F.col("first") + 1).alias("from"))).alias("begins"))
    # written, so that a table of few listings is known to be small before items are shuffled to meet it
    met = ranked.join(written(begins, "tree-begins"), "node_id")
    shared = lambda s: s["scope"].isin(SHARED_SCOPES)
    listed = lambda which: met.select("file_id", "nr", F.explode(F.filter("begins", which)).alias("s")).select("s.scope", "file_id", (F.col("nr") + F.col("s.from")).alias("place"))
    first = listed(shared).groupBy("scope", "file_id").agg(F.min("place").alias("place"))
    first = numbered(first, ["scope", "place"], ["scope", "file_id"])
    start = first.groupBy("scope").agg(F.min("nr").alias("first"))  # a row for each of the shared scopes
    first = first.join(F.broadcast(start), "scope").select("scope", "file_id", (F.col("nr") - F.col("first") + 1).alias("place"))
    return listed(lambda s: ~shared(s)).unionByName(first)


def shown_in(items: DataFrame, asked: DataFrame, *carry: str) -> DataFrame:
    """(scope, file_id, carry): the items under each of the containers ``asked`` (scope), each file once as a walk first meets it.

    The asked containers of a listing are worked out once a listing; only those with overlapping children need a shuffle of their items.
    """
    over = leaves_of(items).select("node_id", F.explode("scopes").alias("s")).select("node_id", "s.scope", "s.place").join(asked.select("scope").distinct(), "scope", "left_semi")
    over = written(over.groupBy("node_id").agg(F.collect_list(F.struct("scope", "place")).alias("scopes")), "tree-over")
    spread = items.select("node_id", "file_id", "key", *carry).join(over, "node_id").select("file_id", "key", *carry, F.explode("scopes").alias("s"))
    shared = F.col("s.scope").isin(SHARED_SCOPES)
    first = spread.filter(shared).groupBy("s.scope", "file_id").agg(*[F.min_by(x, F.concat("s.place", "key")).alias(x) for x in carry])
    return spread.filter(~shared).select("s.scope", "file_id", *carry).unionByName(first)


def scope_items(items: DataFrame, scope: str, wanted: Column | None = None) -> DataFrame:
    """Items under one container, each file once, with ``place``, which sorts as a walk does; with ``wanted`` only those that it is true of.

    A file in several listings is shown as the first of them shows it, so where children overlap an item that isn't wanted still stands before the file's later ones,
    but it brings no fields to where they meet.
    """
    wanted = F.lit(True) if wanted is None else wanted
    fields = [x for x in ITEM_FIELDS if x in items.columns]
    if scope not in SHARED_SCOPES:
        # its listings split its files, so each row answers for itself
        at = F.get(F.filter(scopes(), lambda s: s["scope"] == scope), F.lit(0))["place"]
        return items.filter(wanted).select("file_id", *fields, F.concat(at, "key").alias("place")).filter("place is not null")
    leaves = leaves_of(items).select("node_id", F.explode("scopes").alias("s")).filter(F.col("s.scope") == scope).select("node_id", "s.place")
    leaves = written(leaves, "tree-leaves")  # so that few listings are known to be few and items needn't be shuffled to meet them
    inside = items.join(leaves, "node_id").select("file_id", F.concat("place", "key").alias("place"), F.when(wanted, F.struct(*fields)).alias("i"))
    first = inside.groupBy("file_id").agg(F.min(F.struct("place", "i")).alias("first")).filter("first.i is not null")
    return first.select("file_id", "first.i.*", "first.place")


def flatten_scope(items: DataFrame, scope: str) -> DataFrame:
    """Items under one container in the order of a walk."""
    return scope_items(items, scope).orderBy("place")


def node_detail(tree: DataFrame, totals: DataFrame) -> DataFrame:
    """Nodes with their counts; a node without one shows none."""
    return tree.join(totals, "count_id", "left")
