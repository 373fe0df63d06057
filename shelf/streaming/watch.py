"""Watch reports folded as they arrive, one state per profile and series (or single program)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelf.operators.watch import FINISHED, dismissal_group

CHANGE = (
    "profile_id long, key string, file_id long, position_ms long, duration_ms long, watched boolean, updated_us long, "
    "dismissed boolean, removed boolean"
)
NAMES = [c.split()[0] for c in CHANGE.split(", ")]
PROGRAM = "key string, file_id long, position_ms long, duration_ms long, watched boolean, updated_us long, dismissed boolean, gone boolean"
#: What the fold reads of an event, in this order.
EVENT = ["key", "at", "event_id", "file_id", "event", "position_ms", "duration_ms", "seen"]


class WatchFold(StatefulProcessor):
    """Holds every program of one series, so that one dismissal reaches all its episodes.

    A series is read and written whole, once a batch: calls to the state are what a series of few reports costs. Reports older than
    what a program's state already reflects are dropped; a forgotten program keeps the time it was
    forgotten at until the watermark has passed it, so no late report brings it back.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.programs = handle.getListState("programs", PROGRAM)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = {p[0]: tuple(p)[1:] for p in self.programs.get()}
        touched = set()
        for k, at, _, file_id, event, position_ms, duration, seen in sorted((r[-len(EVENT):] for r in rows), key=lambda e: (e[1], e[2])):
            if event == "dismiss":
                for k, s in held.items():
                    if not s[6] and at >= s[4]:
                        held[k] = (s[0], 0, s[2], s[3], s[4], True, False)
                        touched.add(k)
                continue
            s = held.get(k)
            if s is not None and at < s[4]:
                continue
            if s is not None and s[6]:
                s = None
            position = max(position_ms or 0, 0)
            kept = duration if duration is not None else (s[2] if s else None)
            watched = bool(s[3]) if s else False
            if event == "forget":
                if s is None:
                    continue
                new = (s[0], 0, s[2], True, at, s[5], False) if watched else (None, 0, None, False, at, False, True)
            elif event == "seen":
                new = (file_id, 0, s[2] if s else None, bool(seen), at, False, False)
            elif event == "ended" or (duration and duration > 0 and position >= duration * FINISHED):
                new = (file_id, 0, kept, True, at, False, False)
            else:
                new = (file_id, position, kept, watched, at, False, False)
            held[k] = new
            touched.add(k)

        passed = timerValues.getCurrentWatermarkInMs() * 1000
        stays = [(k, *s) for k, s in held.items() if not (s[6] and s[4] < passed)]
        if stays:
            if touched or len(stays) < len(held):
                self.programs.put(stays)
        elif held:
            self.programs.clear()
        for k in touched:
            s = held[k]
            yield Row(**dict(zip(NAMES, (key[0], k, *s[:4], None if s[6] else s[4], *s[5:]))))

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """State changes out of a stream of watch events; a removed row is marked."""
    reports = events.withColumn("scope", dismissal_group(F.col("key"))).withWatermark("ts", lateness)
    changes = (
        reports.select("ts", "profile_id", "scope", F.unix_micros("ts").alias("at"), *[c for c in EVENT if c != "at"])
        .select("ts", "profile_id", "scope", *EVENT)
        .groupBy("profile_id", "scope")
        .transformWithState(statefulProcessor=WatchFold(), outputStructType=CHANGE, outputMode="Update", timeMode="EventTime")
    )
    return changes.select(*[F.timestamp_micros("updated_us").alias("updated_at") if c == "updated_us" else c for c in NAMES])


def change_sink(path: str):
    """A foreachBatch sink that keeps each batch's changes under its number, so a repeated batch is written once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest_states(changes: DataFrame) -> DataFrame:
    """The newest change per program, removed ones left out: what dashboards read."""
    rest = [c for c in changes.columns if c not in ("profile_id", "key", "batch_id", "batch")]
    newest = changes.groupBy("profile_id", "key").agg(F.max_by(F.struct(*rest), "batch_id").alias("s"))
    return newest.select("profile_id", "key", "s.*").filter("not removed").drop("removed")
