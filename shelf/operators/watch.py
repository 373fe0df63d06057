"""Watch history: reports folded to state per profile and program, and what to watch next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelf.functions.keys import program_key
from shelf.operators.windows import ordered_columns

FINISHED = 0.95  # fixed value: share of the running time that counts as the end
RESUME_FROM_MS = 9000  # fixed value: positions up to here start over

REPORT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("event", T.StringType()), T.StructField("position", T.DoubleType()),
    T.StructField("duration", T.DoubleType()), T.StructField("seen", T.BooleanType()),
])


def valid_reports(raw: DataFrame, details: DataFrame) -> DataFrame:
    """Raw posts (event_id, ts, profile_id, endpoint, body) as watch events with keys.

    ``details`` is the catalog: file_id, kind, series, season, episode, title, year,
    duration_ms. Malformed bodies, unknown files and music are left out.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    r = raw.select("event_id", "ts", "profile_id", "endpoint", F.from_json("body", REPORT).alias("r")).select(
        "event_id", "ts", "profile_id", "endpoint", "r.*"
    )
    position = F.coalesce("position", F.lit(0.0))
    watch = F.col("endpoint") == "watch"
    r = r.filter(F.col("id").isNotNull() & (~watch | finite(position) & (position >= 0)))
    r = r.filter((F.col("endpoint") != "seen") | F.col("seen").isNotNull())
    key = program_key(*[F.col(c) for c in ("kind", "file_id", "series", "season", "episode", "title", "year")])
    known = details.select("file_id", key.alias("key"), F.col("duration_ms").alias("catalog_ms")).filter("key is not null")
    own = F.when(finite(F.col("duration")) & (F.col("duration") > 0), (F.col("duration") * 1000).cast("long"))
    event = F.when(watch, F.when(F.col("event") == "ended", "ended").otherwise("position")).otherwise(F.col("endpoint"))
    return r.join(known, r["id"] == known["file_id"]).select(
        "event_id", "ts", "profile_id", "key", "file_id", event.alias("event"),
        F.when(watch, (position * 1000).cast("long")).alias("position_ms"),
        F.when(watch, F.coalesce(own, F.col("catalog_ms"))).alias("duration_ms"), "seen",
    )


def dismissal_group(key: Column) -> Column:
    """What one dismissal covers: every episode of a series, or the one program."""
    return F.when(key.startswith("tv|"), F.regexp_replace(key, r"\|[^|]*\|[^|]*$", "|")).otherwise(key)


def fold(events: DataFrame, series_wide: bool = True, spread: bool = False) -> DataFrame:
    """Latest state per (profile, key) out of a log of watch events.

    Rows are replayed in (ts, event_id) order: a position past 95 % ends the program,
    forgetting an unseen program removes its row, dismissing zeroes the position and
    hides it until the next report. A program without a report has no row.
    """
    group, order = ["profile_id", "key"], ["ts", "event_id"]
    at = F.struct("ts", "event_id")
    ended = (F.col("event") == "position") & (F.col("duration_ms") > 0) & (F.col("position_ms") >= FINISHED * F.col("duration_ms"))
    log = events.filter(F.col("event") != "dismiss").withColumn("e", F.when(ended, "ended").otherwise(F.col("event")))
    setter = F.when(F.col("e") == "ended", 1).when(F.col("e") == "seen", F.col("seen").cast("int"))
    log = ordered_columns(log, group, order, spread, w=("last", setter)).withColumn("w", F.coalesce("w", F.lit(0)))
    gone = F.when((F.col("e") == "forget") & (F.col("w") == 0), 1).otherwise(0)
    # the generation a row belongs to: removals before it
    log = ordered_columns(log, group, order, spread, g=("sum_before", gone))
    report = F.col("e") != "forget"
    rows = log.groupBy(*group, "g").agg(
        F.max_by(F.when(F.col("e") == "position", F.greatest(F.col("position_ms"), F.lit(0))).otherwise(F.lit(0)), at).alias("position_ms"),
        F.max_by("duration_ms", F.when(F.col("e").isin("position", "ended") & F.col("duration_ms").isNotNull(), at)).alias("duration_ms"),
        F.max_by("w", at).alias("w"),
        F.max("ts").alias("updated_at"),
        F.max_by("file_id", F.when(report, at)).alias("file_id"),
        F.max(F.when(report, at)).alias("_report"),
        F.max(gone).alias("_gone"),
    )
    rows = rows.filter(F.col("_report").isNotNull() & (F.col("_gone") == 0))
    scope = dismissal_group(F.col("key")) if series_wide else F.col("key")
    dismissals = (
        events.filter(F.col("event") == "dismiss")
        .groupBy("profile_id", scope.alias("_scope")).agg(F.max(at).alias("_dismissed"))
    )
    rows = rows.withColumn("_scope", scope).join(dismissals, ["profile_id", "_scope"], "left")
    hidden = F.coalesce(F.col("_dismissed") > F.col("_report"), F.lit(False))
    return rows.select(
        *group, "file_id", F.when(hidden, 0).otherwise(F.col("position_ms")).alias("position_ms"), "duration_ms",
        (F.col("w") == 1).alias("watched"), "updated_at", hidden.alias("dismissed"),
    )


def with_states(items: DataFrame, states: DataFrame, profile_id: int) -> DataFrame:
    """A listing with one profile's state beside each item; music has none."""
    key = program_key(*[F.col(c) for c in ("kind", "file_id", "series", "season", "episode", "title", "year")])
    own = states.filter(F.col("profile_id") == profile_id).select(
        "key", "position_ms", F.col("duration_ms").alias("watch_duration_ms"), "watched", "updated_at", "dismissed"
    )
    return items.withColumn("key", key).join(own, "key", "left")


def recent_states(states: DataFrame, n: int) -> DataFrame:
    """Each profile's n latest rows; the limit runs in every map task before the shuffle."""
    latest = Window.partitionBy("profile_id").orderBy(F.desc("updated_at"), "dismissed", "key")
    return states.withColumn("pos", F.row_number().over(latest)).filter(F.col("pos") <= n)


def resume_seconds(states: DataFrame) -> DataFrame:
    """Where playback picks up, in whole seconds."""
    far = F.col("position_ms") > RESUME_FROM_MS
    return states.filter(far).select("profile_id", "key", F.floor(F.col("position_ms") / 1000).cast("long").alias("resume_s"))


def episode_places(works: DataFrame, spread: bool = False) -> DataFrame:
    """Merged episodes numbered in series order, with their watch key."""
    key = program_key(F.lit("tv"), F.col("file_id"), F.col("series"), F.col("season"), F.col("episode"), F.lit(""), F.lit(None))
    placed = ordered_columns(works.withColumn("key", key), ["k_series"], ["season", "episode", "file_id"], spread, idx=("row_number",))
    return placed.select("k_series", "series", "season", "episode", "title", "file_id", "key", "idx")


def up_next(states: DataFrame, places: DataFrame) -> DataFrame:
    """One episode per (profile, series): the latest one when part-way, else the first unseen after it.

    Seen episodes right behind the latest form a run; the pick is the place after the
    run, so each pick is one lookup rather than a pass over all episodes.
    """
    seen = states.filter(F.col("key").startswith("tv|")).join(places.select("key", "k_series", "idx"), "key")
    group = ["profile_id", "k_series"]
    latest = seen.groupBy(*group).agg(
        F.max_by(F.struct("idx", "position_ms"), F.struct("updated_at", "idx")).alias("l"), F.max("updated_at").alias("latest_at")
    ).select(*group, F.col("l.idx").alias("latest_idx"), (F.col("l.position_ms") > 0).alias("part_way"), "latest_at")
    behind = seen.filter("watched").join(latest.filter("not part_way"), group).filter("idx > latest_idx")
    ranked = behind.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("idx")))
    run = ranked.filter("idx - r = latest_idx").groupBy(*group).agg(F.count(F.lit(1)).alias("run"))
    pick = F.when(F.col("part_way"), F.col("latest_idx")).otherwise(F.col("latest_idx") + F.coalesce("run", F.lit(0)) + 1)
    picked = latest.join(run, group, "left").select(*group, "part_way", "latest_at", pick.alias("idx"))
    return picked.join(places, ["k_series", "idx"])


def continue_watching(states: DataFrame, items: DataFrame, places: DataFrame, n: int = 12,
                      scope_files: DataFrame | None = None) -> DataFrame:
    """Each profile's gallery: programs left part-way and the next episode of each series, latest first.

    ``items`` is the catalog by file (file_id, kind, series, title); the latest row of a
    series decides for the whole series.
    """
    recent = recent_states(states, max(8 * n, 60)).join(
        items.select("file_id", "kind", "title", F.lower("series").alias("k_series")), "file_id"
    )
    tv = (F.col("kind") == "tv") & F.col("k_series").isNotNull()
    first = Window.partitionBy("profile_id", "k_series").orderBy("pos")
    deciding = recent.filter(tv).withColumn("r", F.row_number().over(first)).filter("r = 1 and not dismissed")
    next_up = up_next(states, places).select(
        "profile_id", "k_series", F.col("file_id").alias("next_file_id"), F.col("title").alias("next_title"), "part_way"
    )
    shows = deciding.select("profile_id", "k_series", "pos").join(next_up, ["profile_id", "k_series"]).select(
        "profile_id", "pos", F.col("next_file_id").alias("file_id"), F.col("next_title").alias("title"),
        F.when(F.col("part_way"), "resume").otherwise("next").alias("why"),
    )
    films = recent.filter(~tv & (F.col("position_ms") > 0) & ~F.col("dismissed")).select(
        "profile_id", "pos", "file_id", "title", F.lit("resume").alias("why")
    )
    entries = shows.unionByName(films)
    if scope_files is not None:
        entries = entries.join(scope_files.select("file_id").distinct(), "file_id", "left_semi")
    order = Window.partitionBy("profile_id").orderBy("pos")
    return entries.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).drop("pos")
