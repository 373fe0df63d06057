"""Session settings shared by tests, the bench and command-line use."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def build(cpus: int | str = 8, app: str = "shelf", scratch: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the session comes from spark-submit.

    ``scratch`` is its checkpoint folder, which on a cluster spark.checkpoint.dir names.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: what the session has set, else the cluster's spark.checkpoint.dir."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back, so that several readers share one computation and prune columns."""
    path = f"{_scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")  # read again soon and by few, so space counts for more than the time to unpack
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, calls: dict[str, Callable[[], DataFrame]], at_once: int = 8) -> dict[str, DataFrame]:
    """What each call returns; calls that run jobs of their own, several at once."""
    with ThreadPoolExecutor(at_once) as pool:
        jobs = {name: pool.submit(inheritable_thread_target(spark)(call)) for name, call in calls.items()}
        return {name: job.result() for name, job in jobs.items()}


def written_each(frames: dict[str, DataFrame], at_once: int = 8) -> dict[str, DataFrame]:
    """``written`` for several frames, by jobs of their own, several at once."""
    spark = next(iter(frames.values())).sparkSession
    return side_by_side(spark, {name: partial(written, df, name) for name, df in frames.items()}, at_once)


def written_together(parts: list[DataFrame], name: str) -> DataFrame:
    """The union of frames with the same columns, each written by a job of its own.

    A union of many aggregates is one plan that is optimised anew whenever one of its stages ends; small plans are not.
    """
    done = list(written_each({f"{name}-{i}": df for i, df in enumerate(parts)}).values())
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def discard(spark: SparkSession) -> None:
    """Delete what ``written`` has left of this application; frames that still read it fail."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
