"""Small commits to catalog tables: a delta holds the new rows of some files and the ids of files that went.

Readers lay the deltas over the table as it was last written whole: of each file, the rows of the newest delta that names it
stand. A commit so writes in proportion to its batch; ``compact`` folds the deltas of a table into it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.sources import catalog

KEY = "file_id"


def write(spark: SparkSession, base: str, name: str, changes: DataFrame, hanging: list[str], stream: str | None = None, batch: int | None = None) -> int:
    """Commit ``changes`` (rows of table ``name``, and ``_gone`` true for ids that leave) as the next version.

    The rows of gone ids leave the tables ``hanging`` too, which then share the delta. Raises CommitConflict as ``write_snapshot`` does.
    """
    before, known = catalog.current(spark, base)
    version = catalog.next_version(spark, base, before)
    path = f"data/{version}-{uuid.uuid4().hex}/{name}.delta"
    catalog.conform(changes, name, "_gone").write.parquet(f"{base}/{path}")
    deltas = {**known.get("deltas", {})}
    deltas[name] = [*deltas.get(name, []), {"version": version, "path": path, "rows": True}]
    # the written delta is read, so the batch is worked out once
    if spark.read.parquet(f"{base}/{path}").filter("_gone").take(1):
        for other in hanging:
            deltas[other] = [*deltas.get(other, []), {"version": version, "path": path, "rows": False}]
    catalog.commit(spark, base, version, known["tables"], deltas, {**known["streams"], **({stream: batch} if stream else {})})
    return version


def laid_over(spark: SparkSession, base: str, name: str, whole: DataFrame, deltas: list[dict]) -> DataFrame:
    """The table with its deltas; ids meet the whole table in an anti join, whose small side is the deltas' ids."""
    out = None
    for d in deltas:
        part = spark.read.schema(catalog.schema(name).add("_gone", "boolean")).parquet(f"{base}/{d['path']}").withColumn("_at", F.lit(d["version"]))
        part = part if d["rows"] else part.filter("_gone")
        out = part if out is None else out.unionByName(part)
    newest = out.groupBy(KEY).agg(F.max("_at").alias("_at"))
    rows = out.join(newest, [KEY, "_at"], "left_semi").filter("not _gone").select(*whole.columns)
    return whole.join(newest.select(KEY), KEY, "left_anti").unionByName(rows)


def compact(spark: SparkSession, base: str, most: int = 16) -> int | None:
    """Write tables with more than ``most`` deltas whole again; returns the version, None if there was nothing to do."""
    known = catalog.current(spark, base)[1]
    names = [n for n, d in known.get("deltas", {}).items() if len(d) > most]
    return catalog.write_snapshot(spark, base, {n: catalog.read_table(spark, base, n) for n in names}) if names else None
