"""File arrivals: settle detection with retries, arrival bursts, and events applied to the catalog.

Each rule has a stateful streaming form and a batch form over the same event log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelf.operators import reconcile
from shelf.operators.windows import ordered_columns
from shelf.session import written
from shelf.sources import catalog, deltas

SETTLE_S = 30  # fixed value: seconds a file must hold still
MAX_RETRIES = 5  # fixed value
MAX_BACKOFF_S = 300  # fixed value
QUIET_S = 60  # fixed value: seconds without an arrival that end a burst
MIN_INTERVAL_S = 600  # fixed value: least seconds between two units of work

#: Columns of files that events set; the others stay with the file.
APPLIED = ["root_id", "rel_path", "size", "mtime", "kind", "mime", "status", "added_at", "updated_at"]
#: Tables whose rows go with their file; what viewers did stays.
HANGING = ["movies", "tv_episodes", "music_tracks", "movie_genres", "track_genres", "movie_directors", "segments", "segment_prints"]

SETTLED = "path string, size long, mtime long, due_at timestamp, attempt int"


class Settle(StatefulProcessor):
    """Per path: emit once (size, mtime) has held for the window; a failed attempt is tried again later.

    Input rows are (ts, path, size, mtime, kind) with kind seen, gone, failed or done.
    """

    def __init__(self, window_s: int = SETTLE_S):
        self.window_ms = window_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "size long, mtime long, since long, failures int, due long, not_before long")

    def _arm(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at >= 0:
            self.handle.registerTimer(at)

    def _emit(self, key, size, mtime, due, failures) -> pd.DataFrame:
        return pd.DataFrame({
            "path": [key[0]], "size": [size], "mtime": [mtime], "due_at": [pd.Timestamp(due, unit="ms")], "attempt": [failures + 1],
        })

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one path's events of one micro-batch
        events = pd.concat(list(rows)).sort_values("ts")
        state = self.entry.get() if self.entry.exists() else None
        for e in events.itertuples():
            ts = int(e.ts.value // 1_000_000)
            if state is not None and 0 <= state[4] <= ts:
                yield self._emit(key, state[0], state[1], state[4], state[3])
                state = (*state[:4], -1, state[5])
            if e.kind in ("gone", "done"):
                state = None
            elif e.kind == "failed":
                if state is not None and state[3] < MAX_RETRIES:
                    failures = state[3] + 1
                    delay = min(self.window_ms * 2**failures, MAX_BACKOFF_S * 1000)
                    state = (state[0], state[1], state[2], failures, max(ts + delay, state[2] + self.window_ms), ts + delay)
            elif state is None:
                state = (int(e.size), int(e.mtime), ts, 0, ts + self.window_ms, -1)
            elif (state[0], state[1]) != (int(e.size), int(e.mtime)):
                # a change starts the window anew, but does not cut a running back-off short
                held = state[5] if state[5] > ts else -1
                state = (int(e.size), int(e.mtime), ts, state[3], max(ts + self.window_ms, held), held)
        if state is None:
            self.entry.clear()
            self._arm(-1)
        else:
            self.entry.update(state)
            self._arm(state[4])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            state = self.entry.get()
            if 0 <= state[4] <= expiredTimerInfo.getExpiryTimeInMs():
                self.entry.update((*state[:4], -1, state[5]))
                yield self._emit(key, state[0], state[1], state[4], state[3])

    def close(self) -> None:
        pass


def settle_stream(events: DataFrame, window_s: int = SETTLE_S, lateness: str = "1 minute") -> DataFrame:
    """Settled paths out of a stream of events, in event time."""
    return (
        events.withWatermark("ts", lateness).groupBy("path")
        .transformWithStateInPandas(
            statefulProcessor=Settle(window_s), outputStructType=SETTLED, outputMode="Append", timeMode="EventTime",
        )
    )


def settle_batch(events: DataFrame, until: Column, window_s: int = SETTLE_S, spread: bool = False) -> DataFrame:
    """First settling of every (size, mtime) a path held for the window, from a log without retries."""
    order = ["ts", "event_id"]
    same = F.struct("size", "mtime", F.col("kind").alias("kind"))
    seen = ordered_columns(events, ["path"], order, spread, _prev=("lag", same))
    starts = seen.filter(~F.col("_prev").eqNullSafe(F.struct("size", "mtime", "kind"))).drop("_prev")
    runs = ordered_columns(starts, ["path"], order, spread, _next=("lead", F.col("ts")))
    due = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + window_s * 1_000_000)
    held = due <= F.coalesce(F.col("_next").cast("timestamp"), until)
    return runs.filter((F.col("kind") == "seen") & held).select("path", "size", "mtime", due.alias("due_at"))


def retry_schedule(log: DataFrame, window_s: int = SETTLE_S, spread: bool = False) -> DataFrame:
    """When each failed attempt (path, ts, event_id, kind) is tried again; null once the retries are used up.

    A success (done) or the file's end (gone) forgets the failures before it; without ``kind`` all rows are failures.
    """
    if "kind" not in log.columns:
        log = log.withColumn("kind", F.lit("failed"))
    log = ordered_columns(log, ["path"], ["ts", "event_id"], spread, _era=("sum_before", F.col("kind").isin("done", "gone").cast("long")))
    k = ordered_columns(log.filter("kind = 'failed'"), ["path", "_era"], ["ts", "event_id"], spread, attempt=("row_number",))
    delay = F.least(F.lit(window_s) * F.pow(F.lit(2), F.least("attempt", F.lit(MAX_RETRIES + 1))), F.lit(MAX_BACKOFF_S)).cast("long")
    return k.select("path", "ts", "event_id", "attempt", F.when(F.col("attempt") <= MAX_RETRIES, delay).alias("delay_s"))


class Bursts(StatefulProcessor):
    """Per library: one unit of work per burst of arrivals, with a least interval between units."""

    def __init__(self, quiet_s: int = QUIET_S, interval_s: int = MIN_INTERVAL_S):
        self.quiet, self.interval = quiet_s * 1000, interval_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("s", "last_add long, last_run long, pending boolean")

    def _due(self, s) -> int:
        due = s[0] + self.quiet
        return due if s[1] < 0 else max(due, s[1] + self.interval)

    def _run(self, key, due) -> pd.DataFrame:
        return pd.DataFrame({"library": [key[0]], "run_at": [pd.Timestamp(due, unit="ms")]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = self.state.get() if self.state.exists() else (-1, -1, False)
        for ts in pd.concat(list(rows))["ts"].sort_values():
            at = int(ts.value // 1_000_000)
            if s[2] and self._due(s) <= at:
                due = self._due(s)
                yield self._run(key, due)
                s = (s[0], due, False)
            s = (max(at, s[0]), s[1], True)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.state.update(s)
        self.handle.registerTimer(self._due(s))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self.state.get()
        due = self._due(s)
        if s[2] and due <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((s[0], due, False))
            yield self._run(key, due)

    def close(self) -> None:
        pass


def burst_stream(arrivals: DataFrame, quiet_s: int = QUIET_S, interval_s: int = MIN_INTERVAL_S, lateness: str = "1 minute") -> DataFrame:
    """Units of work due, out of a stream of arrivals (ts, library)."""
    return (
        arrivals.withWatermark("ts", lateness).groupBy("library")
        .transformWithStateInPandas(
            statefulProcessor=Bursts(quiet_s, interval_s), outputStructType="library string, run_at timestamp", outputMode="Append",
            timeMode="EventTime",
        )
    )


def bursts(arrivals: DataFrame, quiet_s: int = QUIET_S, bin_s: int = 86_400) -> DataFrame:
    """Bursts of arrivals per library: begin, the moment quiet returned, and how many arrived.

    Arrivals of one library and day meet in one task, which folds them to that day's bursts; then bursts that touch over
    midnight are joined, of which there are few: at most one chain of a library's days. A library that holds all arrivals
    so spreads over its days. Smaller bins spread it further.
    """
    gap = quiet_s * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    marked = arrivals.select("library", at.alias("at")).groupBy("library", "at").agg(F.count(F.lit(1)).alias("n"))
    marked = marked.withColumn("bin", F.floor(F.col("at") / (bin_s * 1_000_000)))
    in_bin = Window.partitionBy("library", "bin").orderBy("at")
    new = F.coalesce(F.col("at") - F.lag("at").over(in_bin) >= gap, F.lit(True)).cast("int")
    part = marked.withColumn("new", new).withColumn("s", F.sum("new").over(in_bin)).groupBy("library", "bin", "s").agg(
        F.min("at").alias("b"), F.max("at").alias("q"), F.sum("n").alias("n")
    )
    return _chained(part, ["library"], gap).select(
        "library", F.timestamp_micros("b").alias("begin_at"), F.timestamp_micros(F.col("q") + gap).alias("quiet_at"), F.col("n").alias("arrivals")
    )


def _chained(part: DataFrame, group: list[str], gap: int) -> DataFrame:
    """Join the parts (b, q, n) of a group of which one begins within the gap after the one before ended."""
    order = ["b"]
    parts = ordered_columns(part, group, order, True, _last=("lag", F.col("q")))
    parts = parts.withColumn("_new", F.coalesce(F.col("b") - F.col("_last") >= gap, F.lit(True)).cast("long"))
    parts = ordered_columns(parts, group, order, True, _run=("sum", F.col("_new")))
    return parts.groupBy(*group, "_run").agg(F.min("b").alias("b"), F.max("q").alias("q"), F.sum("n").alias("n"))


def burst_runs(found: DataFrame, interval_s: int = MIN_INTERVAL_S) -> DataFrame:
    """When work runs for each library's bursts: at the return of quiet, but not within the interval of the last run.

    A burst waiting out the interval is joined by a later one that starts before it ends. What went before matters no longer
    after a pause of two intervals, so bursts are first cut into stretches at such pauses, and each stretch is
    walked by itself: a library's bursts meet in one task only as far as they follow each other that closely.
    """
    gap = interval_s * 1_000_000
    rows = found.select("library", F.unix_micros("begin_at").alias("b"), F.unix_micros("quiet_at").alias("q"))
    rows = ordered_columns(rows, ["library"], ["b"], True, _last=("lag", F.col("q")))
    # a run is due one interval after the burst before at the latest, and holds back the next for one more
    rows = rows.withColumn("_new", F.coalesce(F.col("b") - F.col("_last") >= 2 * gap, F.lit(True)).cast("long"))
    rows = ordered_columns(rows, ["library"], ["b"], True, stretch=("sum", F.col("_new"))).select("library", "stretch", "b", "q")
    return (
        rows.repartition("library", "stretch").sortWithinPartitions("library", "stretch", "b")
        .mapInPandas(lambda parts: walk_runs(parts, gap), "library string, run_us long")
        .select("library", F.timestamp_micros("run_us").alias("run_at"))
    )


def walk_runs(parts: Iterator[pd.DataFrame], gap: int) -> Iterator[pd.DataFrame]:
    """Runs of sorted bursts; holds the current stretch's last run and due time only."""
    at, run, due = None, None, None
    for part in parts:
        out = []
        for library, stretch, b, q in part[["library", "stretch", "b", "q"]].itertuples(index=False):
            if (library, stretch) != at:
                if due is not None:
                    out.append((at[0], due))
                at, run, due = (library, stretch), None, None
            if due is not None and due <= b:
                out.append((library, due))
                run = due
            due = q if run is None else max(q, run + gap)
        yield pd.DataFrame(out, columns=["library", "run_us"])
    if due is not None:
        yield pd.DataFrame([(at[0], due)], columns=["library", "run_us"])


def distinct_events(events: DataFrame, lateness: str | None = None) -> DataFrame:
    """Events worth handling, one per path: accesses are ignored, repeats within the lateness dropped."""
    wanted = events.filter(F.col("kind") != "access")
    if lateness is None:
        return wanted.dropDuplicates(["batch", "path"])
    return wanted.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["path"])


def latest_events(events: DataFrame) -> DataFrame:
    """The last event per path of a batch."""
    rest = [c for c in events.columns if c not in ("root_id", "rel_path")]
    return events.groupBy("root_id", "rel_path").agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("e")).select("root_id", "rel_path", "e.*")


FILE_COLUMNS = ["root_id", "rel_path", "file_id", "size", "mtime", "kind", "mime", "status", "added_at", "updated_at"]


def event_changes(files: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """What a batch of events (ts, event_id, root_id, rel_path, size, mtime, kind, mime, present) changes in the files table.

    Rows to put in place of those of the same file, and with ``_gone`` true the rows that leave. Vanished paths go with all beneath
    them, after handing their arrival time to a same-stem sibling, new or old; present ones become pending unless the catalog
    already shows them.
    """
    key = ["root_id", "rel_path"]
    # what several parts of the change draw on is written once
    last = written(latest_events(events), "latest-events")
    removed = last.filter("not present")
    # those named by an event hand on their time, those beneath one only go
    vanished = files.join(removed.select(*key), key, "left_semi")
    lost = written(reconcile.under(files, removed.select("root_id", F.col("rel_path").alias("path"))), "lost-files")
    news = written(reconcile.unreflected(last.filter("present"), files).select(*key, "size", "mtime", "kind", "mime"), "new-files")
    old = files.join(lost, key, "left_anti").select(*key, "file_id", F.col("added_at").alias("_old"))
    joined = news.join(old, key, "left")
    touched = joined.select(
        *key, F.coalesce("file_id", reconcile.file_id_for(F.col("root_id"), F.col("rel_path"))).alias("file_id"), "size", "mtime", "kind",
        "mime", F.lit("pending").alias("status"), F.coalesce(F.col("_old"), now).cast("long").alias("added_at"), now.cast("long").alias("updated_at"),
        F.col("_old").isNull().alias("is_new"),
    )
    stem = reconcile.path_stem(F.col("rel_path")).alias("stem")
    stems = vanished.select("root_id", stem).filter("stem is not null").distinct()
    stay = files.join(lost, key, "left_anti").join(news.select(*key), key, "left_anti")
    heirs = stay.select("*", stem).join(stems, ["root_id", "stem"], "left_semi").select(*FILE_COLUMNS, F.lit(False).alias("is_new"))
    known = files.select(*key, "added_at")
    upserts = reconcile.inherited_added_at(touched.select(*FILE_COLUMNS, "is_new").unionByName(heirs), known, vanished.select(*key, "added_at"))
    upserts = upserts.select(*FILE_COLUMNS, F.lit(False).alias("_gone"))
    gone = files.join(lost, key, "left_semi").join(news.select(*key), key, "left_anti").select(*FILE_COLUMNS, F.lit(True).alias("_gone"))
    return upserts.unionByName(gone)


def apply_events(files: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """The files table after a batch of events, of which ``event_changes`` says what they change."""
    changes = event_changes(files, events, now)
    kept = files.join(changes.select("root_id", "rel_path"), ["root_id", "rel_path"], "left_anti").select(*FILE_COLUMNS, F.lit(False).alias("_gone"))
    return kept.unionByName(changes).filter("not _gone").select(*FILE_COLUMNS)


def catalog_sink(base: str, now: Column, stream: str = "events", deltas_kept: int = 16):
    """A foreachBatch sink that applies events to the catalog under ``base``; a repeated batch of the stream is written once.

    A batch is written as a delta in proportion to its events, which takes the rows of vanished files out of the tables that hang on them
    too; after ``deltas_kept`` of them the tables are written whole again. The catalog records the last batch of each stream
    beside its version, so other commits don't count.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = catalog.last_batch(spark, base, stream)
        if done is not None and batch_id <= done:
            return
        files = catalog.read_table(spark, base, "files", catalog.current_version(spark, base))
        changes = event_changes(files, batch, now).join(files.drop(*APPLIED), "file_id", "left")
        deltas.write(spark, base, "files", changes, HANGING, stream, batch_id)
        deltas.compact(spark, base, deltas_kept)

    return write
